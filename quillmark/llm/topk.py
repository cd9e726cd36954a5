"""Exact top-k by integer inner product, by a Voronoi join: pivots group both sides, bounds say where data must go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.common import scratch, ship
from quillmark.llm.vectors import commonest_width, component_type, distances, matrix, packed, picked, portions, squares, usable

NONE = -(2**62)  # below any score
SLACK = 1e-6  # relative; bounds are loosened by it, so rounding never loses a neighbour
AT_ONCE = 256  # queries


def _integers(column: pa.Array | pa.ChunkedArray, component: str, scale: int) -> np.ndarray:
    return np.floor(matrix(column.to_pylist(), component) * scale)


def _summaries(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, component: str, scale: int, k: int) -> Iterator[pa.RecordBatch]:
    """Of each cell the k + 1 candidates of this partition that are nearest to its pivot, each vec_id once."""
    kept: dict[int, dict[int, float]] = {}
    for batch in portions(batches, len(pivots)):
        d = distances(_integers(batch.column(1), component, scale), pivots)
        cell = d.argmin(1)
        own, ids = d[np.arange(len(d)), cell], batch.column(0).to_numpy()
        for c in np.unique(cell).tolist():
            at = np.flatnonzero(cell == c)
            near = kept.setdefault(c, {})
            for i in at[np.argsort(own[at], kind="stable")].tolist():
                if len(near) > k and own[i] >= max(near.values()):
                    break
                near[int(ids[i])] = min(float(own[i]), near.get(int(ids[i]), np.inf))
                if len(near) > k + 1:
                    del near[max(near, key=near.__getitem__)]
    rows = [(c, i, x) for c, xs in kept.items() for i, x in xs.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["cell", "vec_id", "distance"])


def _bounded(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, near: np.ndarray, centres: np.ndarray, component: str, scale: int) -> Iterator[pa.RecordBatch]:
    """Each query's group, its distance to the group's centre, and a score that its k-th best reaches at least.

    near[c] is a distance from pivot c within which k + 1 candidates lie (infinite if the cell has fewer): q.x >= q.p - |q| d.
    """
    full = np.isfinite(near)
    reach = np.where(full, near, 0.0)  # a cell with fewer gives no bound, to a zero vector neither
    for batch in portions(batches, max(len(pivots), len(centres))):
        q = _integers(batch.column(1), component, scale)
        sure = np.where(full[None], (q @ pivots.T) - np.sqrt(squares(q))[:, None] * reach[None], -np.inf)
        d = distances(q, centres)
        group = d.argmin(1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(group, pa.int32()), pa.array(d[np.arange(len(d)), group]), pa.array(sure.max(1)), batch.column(1)],
            ["query_id", "group", "radius", "floor", "vector"],
        )


def _needed(batch: pa.RecordBatch, centres: np.ndarray, radius: np.ndarray, floor: np.ndarray, component: str, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and group of each candidate that a group may need: q.x <= p.x + r |x| for q within r of centre p."""
    x = _integers(batch.column(1), component, scale)
    most = x @ centres.T + np.sqrt(squares(x))[:, None] * radius[None]
    return np.nonzero(most * (1 + SLACK * np.sign(most)) + 1 >= floor[None])


def _solver(k: int, component: str, scale: int, block: int = 4096):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def solve(left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q, ids = _integers(left.column("vector"), component, scale), left.column("query_id").to_numpy()
        rows = sorted(set(zip(right.column("vec_id").to_pylist(), right.column("vector").to_pylist())))  # a row repeated in full is one
        keys, x = np.array([r[0] for r in rows], np.int64), np.floor(matrix([r[1] for r in rows], component) * scale)
        if np.abs(q).max() * np.abs(x).max() * q.shape[1] >= 2**52:
            q, x = q.astype(np.int64), x.astype(np.int64)
        out = []
        for i in range(0, len(q), AT_ONCE):
            own = ids[i : i + AT_ONCE, None]
            best_s = np.zeros((len(own), 0), np.int64)
            best_k = np.zeros_like(best_s)
            for j in range(0, len(x), block):
                s = (q[i : i + AT_ONCE] @ x[j : j + block].T).astype(np.int64)
                names = np.broadcast_to(keys[j : j + block], s.shape)
                s = np.where(names == own, NONE, s)
                best_s, best_k = np.concatenate([best_s, s], 1), np.concatenate([best_k, names], 1)
                if best_s.shape[1] > 4 * k:  # only those that reach the k-th best need an order
                    reached = best_s >= -np.partition(-best_s, k - 1, axis=1)[:, k - 1 : k]
                    wide = int(reached.sum(1).max())
                    at = np.argsort(~reached, axis=1, kind="stable")[:, :wide]
                    best_s, best_k = np.where(np.take_along_axis(reached, at, 1), np.take_along_axis(best_s, at, 1), NONE), np.take_along_axis(best_k, at, 1)
                top = np.argsort(-best_s, axis=1, kind="stable")[:, :k]
                best_s, best_k = np.take_along_axis(best_s, top, 1), np.take_along_axis(best_k, top, 1)
            found = best_s != NONE
            out.append((np.broadcast_to(own, best_s.shape)[found], best_k[found], best_s[found]))
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], schema=schema)

    return solve


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, query_block: int = 1024, data_block: int = 20_000, most_groups: int = 4096, pivots: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each query row the ``k`` best other rows by inner product of floor(scale * x).

    Columns read: vec_id, embedding (an array of any numbers). Ties go to the smaller vec_id; fewer rows come if there are
    fewer candidates. Vectors that are null, empty, or hold null or non-finite components take no part, nor do null
    vec_ids, nor vectors of another width than most have; a row is no candidate for a query of its own vec_id; rows
    repeated in full are one. An empty table gives an empty result.

    ``pivots`` rows, chosen by hash (a quarter of the root of the rows, from 16 to 1024), part the candidates into cells,
    and as many query rows as there are blocks of queries part the queries into groups. Summaries of the cells (the k + 1
    candidates nearest to each pivot) give each query a score that its k-th best surely reaches; each group keeps the
    lowest of these and its radius; a candidate goes only to the groups where the bound q.x <= p.x + r|x| allows it.
    Groups and what they are dealt are cut into blocks of queries and candidates by hash, so that no task gets more than
    a block of each, however large a cell is; the best of the blocks are merged. Only pivots, centres, summaries and group
    bounds, all limited by 1024 pivots and ``most_groups``, are sent around.
    """
    spark = vectors.sparkSession
    ship(spark)
    base, component = scratch(spark, "topk"), component_type(vectors, "embedding")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = stored(packed(clean.where(F.col("vec_id").isNotNull() & usable("vector")), component), "rows")
    counts: dict[int, list[int]] = {}
    for r in rows.groupBy(F.length("vector").alias("w")).agg(F.count("*").alias("n"), F.count_if("q").alias("q")).collect():
        counts[r.w] = [r.n, r.q]
    wide = commonest_width({w: n for w, (n, _) in counts.items()}) if counts else 0
    if not counts or not counts[wide][1]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.where(F.length("vector") == wide)
    candidates, asked = rows.select("vec_id", "vector"), rows.where("q").select("vec_id", "vector")

    def sample(df: DataFrame, number: int) -> np.ndarray:
        return np.unique(np.floor(matrix([bytes(r.vector) for r in picked(df, number, "vec_id", "vec_id", "vector").collect()], component) * scale), axis=0)

    chosen = sample(candidates, pivots or min(1024, max(16, int(counts[wide][0] ** 0.5 / 4))))
    centres = sample(asked, min(most_groups, -(-counts[wide][1] // query_block)))
    cells = candidates.mapInArrow(lambda b: _summaries(b, chosen, component, scale, k), "cell int, vec_id long, distance double").groupBy("cell", "vec_id").agg(F.min("distance").alias("distance"))
    ranked = cells.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("distance"))).where(F.col("r") == k + 1)
    near = np.full(len(chosen), np.inf)
    for r in ranked.collect():
        near[r.cell] = r.distance * (1 + SLACK) + 1
    queries = stored(asked.mapInArrow(lambda b: _bounded(b, chosen, near, centres, component, scale), "query_id long, group int, radius double, floor double, vector binary"), "queries")
    stats = sorted(queries.groupBy("group").agg(F.max("radius").alias("r"), F.min("floor").alias("f"), F.count("*").alias("n")).collect())
    groups = np.array([s.group for s in stats])
    radius = np.array([s.r for s in stats]) * (1 + SLACK) + 1
    floor = np.array([s.f for s in stats])
    floor = floor - np.abs(np.where(np.isfinite(floor), floor, 0)) * SLACK - 1

    def sizes(batches):
        n = np.zeros(len(groups), np.int64)
        for batch in portions(batches, len(groups)):
            n += np.bincount(_needed(batch, centres[groups], radius, floor, component, scale)[1], minlength=len(groups))
        yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(n)], ["group", "n"])

    def dealt(batches):
        for batch in portions(batches, len(groups)):
            row, at = _needed(batch, centres[groups], radius, floor, component, scale)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(groups[at], pa.int32()), batch.column(0).take(taken), batch.column(1).take(taken)], ["group", "vec_id", "vector"])

    size = {r.group: r.n for r in candidates.mapInArrow(sizes, "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame([(int(s.group), -(-s.n // query_block), max(1, -(-size.get(s.group, 0) // data_block))) for s in stats], "group int, qs int, ds int")
    plan = F.broadcast(plan)  # at most ``most_groups`` rows
    left = queries.join(plan, "group").withColumn("qb", F.pmod(F.xxhash64("query_id"), "qs").cast("int")).withColumn("db", F.explode(F.sequence(F.lit(0), F.col("ds") - 1)))
    right = candidates.mapInArrow(dealt, "group int, vec_id long, vector binary").join(plan, "group")
    right = right.withColumn("db", F.pmod(F.xxhash64("vec_id"), "ds").cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    left = left.select("group", "qb", "db", "query_id", "vector")
    right = right.select("group", "qb", "db", "vec_id", "vector")
    found = left.groupBy("group", "qb", "db").cogroup(right.groupBy("group", "qb", "db")).applyInArrow(_solver(k, component, scale), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
