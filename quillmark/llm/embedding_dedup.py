"""Links between vectors of one label by cosine, by an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import components, settle, ship
from quillmark.llm.vectors import commonest_width, component_type, distances, matrix, packed, picked, portions, squares, usable

SLACK = 1e-6
AT_ONCE = 512  # rows of a block that meet the other block at a time
FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(squares(x))[:, None]


def _cells(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether it is the row's own: each row in its nearest pivot's cell, and in each that may hold a vector
    within reach.

    For y within e of x and nearest to p_j, the triangle inequality gives d(x, p_j) <= d(x, p_i) + 2e; in Euclidean space
    also the plane between p_i and p_j is within e of x.
    """
    d = distances(_unit(x), pivots)
    home = d.argmin(1)
    own = d[np.arange(len(d)), home]
    apart = distances(pivots[home], pivots)
    to_plane = (d**2 - own[:, None] ** 2) / np.maximum(2 * apart, 1e-12)
    near = (d <= own[:, None] + 2 * reach + SLACK) & ((to_plane <= reach + SLACK) | (apart < 1e-9))
    near[np.arange(len(d)), home] = True
    row, cell = np.nonzero(near)
    return row, cell, home[row] == cell


def _joiner(least: float, component: str):
    def join(key, group):
        block = group.column("block").to_numpy()
        mine = (block == key[2].as_py()) & group.column("home").to_numpy(zero_copy_only=False)
        other = block == key[3].as_py()
        if not mine.any() or not other.any():
            return FOUND.empty_table()
        ids, n = group.column("id").to_numpy(), group.column("n").to_numpy()
        x = matrix(group.column("vector").to_pylist(), component)
        size = np.sqrt(squares(x))
        a, b = np.flatnonzero(mine), np.flatnonzero(other)
        links, seen, found = np.zeros(len(a), np.int64), np.zeros(len(b), bool), []
        for i in range(0, len(a), AT_ONCE):
            rows = a[i : i + AT_ONCE]
            linked = ((x[rows] @ x[b].T) / (size[rows][:, None] * size[b][None]) >= least) & (ids[rows][:, None] != ids[b][None])
            links[i : i + AT_ONCE] = linked @ n[b]
            seen |= linked.any(0)
            found.append(linked)
        used = links > 0
        if not used.any():
            return FOUND.empty_table()
        root_a, root_b = ids[a], ids[b]
        most = np.iinfo(np.int64).max
        while True:  # least ids spread along links until nothing changes
            before = root_a.copy(), root_b.copy()
            for i, linked in zip(range(0, len(a), AT_ONCE), found):
                part = root_a[i : i + AT_ONCE]
                part[:] = np.minimum(part, np.where(linked, root_b[None], most).min(1))
                root_b = np.minimum(root_b, np.where(linked, part[:, None], most).min(0))
            if (before[0] == root_a).all() and (before[1] == root_b).all():
                break
        return pa.table([np.concatenate([ids[a][used], ids[b][seen]]), np.concatenate([links[used], np.zeros(seen.sum(), np.int64)]), np.concatenate([root_a[used], root_b[seen]])], schema=FOUND)

    return join


def link_vectors(vectors: DataFrame, least: float = 0.98, cell_rows: int = 4000, most_pivots: int = 16_384, block_rows: int = 8192) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for each row: links to other rows of the same label at cosine >= ``least``.

    Columns read: vec_id, embedding (an array of any numbers), label. ``component_id`` is the smallest vec_id reachable by
    links, the row's own included. Rows whose label is null, and vectors that are null, empty, zero, hold null or
    non-finite components or are of another width than most, have no links. A row with a null vec_id has none either and
    a null component. Rows that share a vec_id are told apart in counts but are one in components. An empty table gives
    an empty result.

    Equal vectors of a label are one class with a count and a number of its own. Pivots part the classes into cells: as
    many as the largest label has times ``cell_rows``, but not more than the root of its rows or ``most_pivots``, chosen
    by hash. Every class is copied to the cells whose vectors may be within reach, so that its own cell has all its
    partners. Cells are cut into blocks, and a task has the home rows of one block and all rows of another. It gives
    counts and the roots of its own groups, not pairs.
    """
    spark = vectors.sparkSession
    ship(spark)
    component = component_type(vectors, "embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("vector", nonzero=True)
    widths = {r.w: r.n for r in rows.where(fine).groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).collect()}
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not widths:
        return alone(rows)
    fine = fine & (F.size("vector") == commonest_width(widths))
    part = packed(rows.where(fine), component, digest=True)
    classes = part.groupBy("label", "digest").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.any_value("vector").alias("vector"))
    classes = settle(classes.withColumn("id", F.monotonically_increasing_id()))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    number = max(1, min(most_pivots, -(-largest // cell_rows), int(largest**0.5)))
    pivots = np.unique(_unit(matrix([bytes(r.vector) for r in picked(classes, number, "digest", "digest", "vector").collect()], component)), axis=0)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, len(pivots)):
            row, cell, _ = _cells(matrix(batch.column(1).to_pylist(), component), pivots, reach)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(cell, pa.int32())], ["label", "cell"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, len(pivots)):
            row, cell, home = _cells(matrix(batch.column(3).to_pylist(), component), pivots, reach)
            label, i, n, vector = (batch.column(k).take(pa.array(row)) for k in range(4))
            yield pa.RecordBatch.from_arrays([label, pa.array(cell, pa.int32()), pa.array(home), i, n, vector], ["label", "cell", "home", "id", "n", "vector"])

    blocks = classes.select("label", "vector").mapInArrow(sizes, "label string, cell int").groupBy("label", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    copies = classes.select("label", "id", "n", "vector").mapInArrow(dealt, "label string, cell int, home boolean, id long, n long, vector binary")
    copies = copies.join(blocks, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = F.transform(every, lambda h: F.struct(h.alias("h"), F.col("block").alias("o")))
    asked = F.when(F.col("home"), F.transform(every, lambda o: F.struct(F.col("block").alias("h"), o.alias("o")))).otherwise(F.array())
    tasks = copies.withColumn("task", F.explode(F.array_distinct(F.concat(met, asked)))).select("label", "cell", "task.h", "task.o", "home", "block", "id", "n", "vector")
    found = settle(tasks.groupBy("label", "cell", "h", "o").applyInArrow(_joiner(least, component), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = part.select("vec_id", "label", "digest").join(classes.select("label", "digest", "id", "n", "first"), ["label", "digest"])
    several = named.groupBy("vec_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("vec_id", "a")
    bridges = named.join(several, "vec_id").where("id <> a").select("a", F.col("id").alias("b"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(bridges))
    placed = classes.select("id", "first").join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "first")
    least_id = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = placed.join(least_id, "component").select("id", "component_id").join(links, "id", "left")
    known = named.join(placed, "id").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    known = known.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return known.unionByName(alone(rows.where(~fine)))
