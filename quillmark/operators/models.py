"""Models of a change between two sentences, of a document's level, and of a sentence's author; fit, score, explain, save.

Linear models and the tree are Spark's own, trained on the executors. The two networks are numpy: they train on one task's
rows by design (a bounded sample, stated by ``most``), and score batch by batch wherever the rows are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = 1


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with weight N / (k n_c), so that the k classes weigh the same; the classes are few and their counts are sent around."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"), F.count("*").alias("__k"))
    weights = counts.crossJoin(F.broadcast(total)).select(label, (F.col("__t") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return rows.join(F.broadcast(weights), label)


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the vector ``features`` of the columns, numbers or arrays of them."""
    arrays = [f.name for f in rows.schema if f.name in columns and isinstance(f.dataType, T.ArrayType)]
    vectors = rows.withColumns({f"__v_{c}": array_to_vector(F.col(c).cast("array<double>")) for c in arrays})
    return VectorAssembler(inputCols=[f"__v_{c}" if c in arrays else c for c in columns], outputCol="features", handleInvalid="error").transform(vectors)


def valid(rows: DataFrame, columns: list[str]) -> bool:
    """Whether no value is null, NaN or infinite and labels are 0 or 1."""
    big = F.lit(float("inf"))
    bad = F.coalesce(F.greatest(*[(F.isnan(c) | (F.abs(c) == big) | F.col(c).isNull()).cast("int") for c in columns], F.lit(0)), F.lit(1))
    return rows.where((bad == 1) | ~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).isEmpty()


def feature_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Least, greatest, mean and population deviation of each column, a row for each."""
    value = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    each = rows.select(value.alias("x")).select("x.*").groupBy("column")
    return each.agg(F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"), F.coalesce(F.stddev_pop("v"), F.lit(0.0)).alias("deviation"))


def baselines(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows of each class, and the macro-F1 of always 0 and of always 1."""
    n = rows.agg(F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) == 0).alias("zeros"))
    f1 = lambda c: F.try_divide(F.col(c), 2 * F.col(c) + F.when(F.lit(c == "ones"), F.col("zeros")).otherwise(F.col("ones")))
    return n.select("ones", "zeros", F.coalesce(f1("zeros"), F.lit(0.0)).alias("always_0"), F.coalesce(f1("ones"), F.lit(0.0)).alias("always_1"))


def impurity(counts: list[float], kind: str = "gini") -> float:
    """Gini impurity, or entropy in natural logarithms, of weighted class counts."""
    total = sum(counts)
    shares = [c / total for c in counts if c > 0] if total else []
    return (1 - sum(p * p for p in shares) if shares else 0.0) if kind == "gini" else -sum(p * float(np.log(p)) for p in shares)


def fit_logistic(rows: DataFrame, columns: list[str], l2: float = 1e-4, iterations: int = 200, balanced: bool = True):
    data = assembled(class_weights(rows) if balanced else rows.withColumn("weight", F.lit(1.0)), columns)
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=iterations).fit(data)


def fit_softmax(rows: DataFrame, columns: list[str], l2: float = 1e-3, iterations: int = 200):
    data = assembled(class_weights(rows), columns)
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", regParam=l2, maxIter=iterations).fit(data)


def fit_tree(rows: DataFrame, columns: list[str], depth: int = 15, min_leaf: int = 2, min_gain: float = 0.0, bins: int = 255, balanced: bool = True, kind: str = "gini"):
    """A tree over quantile bins of each column. A leaf has ``min_leaf`` rows at least."""
    data = assembled(class_weights(rows) if balanced else rows.withColumn("weight", F.lit(1.0)), columns)
    return DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="weight", impurity=kind, maxDepth=depth, minInstancesPerNode=min_leaf, minInfoGain=min_gain, maxBins=bins, seed=42).fit(data)


def score(rows: DataFrame, model, columns: list[str], name: str = "score") -> DataFrame:
    """Probability of class 1 from a fitted Spark model, or all classes' as an array for a softmax."""
    out = model.transform(assembled(rows, columns))
    p = vector_to_array("probability")
    return out.select(*rows.columns, (p if model.numClasses > 2 else p[1]).alias(name))


def top_weights(model, columns: list[str], most: int = 15) -> list[tuple[str, float]]:
    return sorted(zip(columns, model.coefficients.toArray().tolist()), key=lambda x: (-abs(x[1]), x[0]))[:most]


@dataclass
class Network:
    """Dense layers with rectifiers between them; weights[k] is inputs by outputs."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]

    @classmethod
    def start(cls, sizes: list[int], seed: int = 42) -> Network:
        rng = np.random.default_rng(seed)
        return cls([rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])], [np.zeros(b) for b in sizes[1:]])

    def forward(self, x: np.ndarray, drop: float = 0.0, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        """Outputs, and for each layer its input and, after a hidden one, what passed."""
        kept = []
        for k, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = x @ w + b
            passed = None
            if k + 1 < len(self.weights):
                passed = (z > 0).astype(float)
                if drop and rng is not None:
                    passed = passed * (rng.random(z.shape) >= drop) / (1 - drop)
                z = z * passed
            kept.append((x, passed))
            x = z
        return x, kept

    def backward(self, gradient: np.ndarray, kept: list) -> list[np.ndarray]:
        """Gradients of weights and biases, in turn, from that of the outputs."""
        out: list[np.ndarray] = []
        for k in range(len(self.weights) - 1, -1, -1):
            x, passed = kept[k]
            if passed is not None:
                gradient = gradient * passed
            out = [x.T @ gradient, gradient.sum(0), *out]
            gradient = gradient @ self.weights[k].T
        return out

    def parameters(self) -> list[np.ndarray]:
        return [p for pair in zip(self.weights, self.biases) for p in pair]


class Adam:
    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.parameters, self.rate, self.t = parameters, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.parameters, gradients, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def binary_loss(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float) -> tuple[float, list[np.ndarray]]:
    """Weighted cross-entropy with L2 on the weights, and its gradients."""
    return _binary(net, *net.forward(x), y, weight, l2)


def _binary(net: Network, out: np.ndarray, kept: list, y: np.ndarray, weight: np.ndarray, l2: float) -> tuple[float, list[np.ndarray]]:
    z = out[:, 0]
    total = weight.sum()
    loss = float((weight * (np.logaddexp(0, z) - y * z)).sum() / total) + 0.5 * l2 * sum(float((w * w).sum()) for w in net.weights)
    g = net.backward((weight * (sigmoid(z) - y) / total)[:, None], kept)
    return loss, [x + l2 * p if k % 2 == 0 else x for k, (x, p) in enumerate(zip(g, net.parameters()))]


def fit_network(x: np.ndarray, y: np.ndarray, hidden: tuple[int, ...] = (128, 64, 32), epochs: int = 100, rate: float = 1e-3, batch: int = 64, l2: float = 1e-4, drop: float = 0.3, patience: int = 10, seed: int = 42) -> Network:
    """Trained on four fifths of the rows; stops when the weighted loss on the others hasn't fallen for ``patience`` epochs."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[: max(1, len(y) // 5)], order[max(1, len(y) // 5) :]
    counts = np.bincount(y.astype(int), minlength=2)
    weight = np.where(y == 1, len(y) / (2 * max(1, counts[1])), len(y) / (2 * max(1, counts[0])))
    net = Network.start([x.shape[1], *hidden, 1], seed)
    adam, best, since, saved = Adam(net.parameters(), rate), np.inf, 0, [p.copy() for p in net.parameters()]
    for _ in range(epochs):
        rng.shuffle(own)
        for i in range(0, len(own), batch):
            at = own[i : i + batch]
            adam.step(_binary(net, *net.forward(x[at], drop, rng), y[at], weight[at], l2)[1])
        loss = binary_loss(net, x[held], y[held], weight[held], l2)[0]
        if loss < best - 1e-6:
            best, since, saved = loss, 0, [p.copy() for p in net.parameters()]
        elif (since := since + 1) >= patience:
            break
    return Network(saved[0::2], saved[1::2])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def triplet_loss(net: Network, a: np.ndarray, p: np.ndarray, n: np.ndarray, margin: float) -> tuple[float, list[np.ndarray]]:
    """Mean of max(0, margin + |a - p|^2 - |a - n|^2) over unit vectors, and its gradients."""
    raw, kept = net.forward(np.concatenate([a, p, n]))
    norm = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
    e = raw / norm
    m = len(a)
    ea, ep, en = e[:m], e[m : 2 * m], e[2 * m :]
    gap = margin + ((ea - ep) ** 2).sum(1) - ((ea - en) ** 2).sum(1)
    on = (gap > 0).astype(float)[:, None] / m
    g = np.concatenate([2 * on * (en - ep), -2 * on * (ea - ep), 2 * on * (ea - en)])
    g = (g - e * (g * e).sum(1, keepdims=True)) / norm
    return float(np.maximum(gap, 0).mean()), net.backward(g, kept)


def fit_embedding(
    x: np.ndarray, triplets: np.ndarray, hidden: tuple[int, ...] = (128,), dim: int = 32, epochs: int = 30, batch: int = 64, rate: float = 1e-3, margin: float = 0.5, l2: float = 1e-4,
    patience: int = 5, seed: int = 42, held: tuple[np.ndarray, np.ndarray] | None = None,
) -> Network:
    """triplets: anchor, positive, and candidates for the negative, of which the nearest to the anchor is taken.

    Every triplet is seen once an epoch, in a new order. Training stops when the mean loss on ``held``, vectors and triplets
    of documents that were not trained on, hasn't fallen for ``patience`` epochs; without them all epochs run.
    """
    rng = np.random.default_rng(seed)
    net = Network.start([x.shape[1], *hidden, dim], seed)
    adam, best, since, saved = Adam(net.parameters(), rate), np.inf, 0, [p.copy() for p in net.parameters()]
    for _ in range(epochs if len(triplets) else 0):
        order = rng.permutation(len(triplets))
        for i in range(0, len(order), batch):
            t = triplets[order[i : i + batch]]
            _, g = triplet_loss(net, x[t[:, 0]], x[t[:, 1]], x[hardest(net, x, t)], margin)
            adam.step([v + l2 * p if k % 2 == 0 else v for k, (v, p) in enumerate(zip(g, net.parameters()))])
        if held is None or not len(held[1]):
            continue
        loss = triplet_evaluation(net, *held, margin)[0]
        if loss < best - 1e-6:
            best, since, saved = loss, 0, [p.copy() for p in net.parameters()]
        elif (since := since + 1) >= patience:
            break
    return net if held is None or not len(held[1]) else Network(saved[0::2], saved[1::2])


def hardest(net: Network, x: np.ndarray, triplets: np.ndarray) -> np.ndarray:
    """Of each triplet's candidates the one nearest to the anchor; only rows of these triplets go through the net."""
    if triplets.shape[1] == 3:
        return triplets[:, 2]
    used, at = np.unique(np.delete(triplets, 1, 1), return_inverse=True)
    e = unit(net.forward(x[used])[0])[at.reshape(len(triplets), -1)]
    return triplets[np.arange(len(triplets)), 2 + (e[:, 1:] * e[:, :1]).sum(2).argmax(1)]


def triplet_evaluation(net: Network, x: np.ndarray, triplets: np.ndarray, margin: float = 0.5) -> tuple[float, float]:
    """Mean loss with each triplet's first candidate, and the share with the positive nearer than it, strictly."""
    if not len(triplets):
        return 0.0, 0.0
    e = [unit(net.forward(x[triplets[:, k]])[0]) for k in range(3)]
    near, far = (e[0] * e[1]).sum(1), (e[0] * e[2]).sum(1)
    return float(np.maximum(0, margin + 2 * (far - near)).mean()), float((near > far).mean())


@dataclass(frozen=True)
class TripletPolicy:
    """How triplets are drawn: by what author counts tell, or from adjacent segments only; how often the positive comes from
    another segment of the anchor's author; and how often a candidate comes from another document."""

    candidates: int = 4
    cross_document: float = 0.0
    author_counts: bool = True
    far_positive: float = 0.2


def relation_of(i: int, j: int, segments: int, authors: int) -> str:
    """What is known of the authors of segments i and j of a document; 0 authors: unknown."""
    if i == j:
        return "same"
    if abs(i - j) == 1 or authors == segments:
        return "different"
    return ("same" if (i - j) % 2 == 0 else "different") if authors == 2 else "unknown"


def draw_triplets(rows: list[tuple[int, int, int]], number: int, policy: TripletPolicy = TripletPolicy(author_counts=False), authors: dict[int, int] | None = None, seed: int = 42) -> np.ndarray:
    """rows: document, segment (from 0), row. ``authors``: how many a document has, where that is known.

    Anchors are sentences with a possible positive and a possible negative. Without author counts positives come from the
    anchor's segment and negatives from adjacent ones.
    """
    rng = np.random.default_rng(seed)
    by: dict[int, dict[int, list[int]]] = {}
    for d, s, r in rows:
        by.setdefault(d, {}).setdefault(s, []).append(r)
    places = [(d, s, r) for d, s, r in rows]

    def others(d: int, s: int, kind: str) -> list[int]:
        known = (authors or {}).get(d, 0) if policy.author_counts else 0
        return [j for j in by[d] if j != s and relation_of(s, j, len(by[d]), known) == kind]

    kinds = {(d, s): (others(d, s, "same") if policy.author_counts and policy.far_positive >= 0 else [], others(d, s, "different")) for d in by for s in by[d]}
    anchors = [(d, s, r) for d, s, r in places if kinds[d, s][1] and (len(by[d][s]) > 1 or kinds[d, s][0])]
    pick = lambda values: values[int(rng.integers(len(values)))]
    out = []
    for _ in range(number if anchors else 0):
        d, s, a = pick(anchors)
        far, apart = kinds[d, s]
        near = [r for r in by[d][s] if r != a]
        positive = pick(by[d][pick(far)]) if far and (not near or rng.random() < policy.far_positive) else pick(near)
        negatives = []
        for _ in range(max(1, policy.candidates)):
            if policy.cross_document and len(by) > 1 and rng.random() < policy.cross_document:
                while (other := pick(places))[0] == d:
                    pass
                negatives.append(other[2])
            else:
                negatives.append(pick(by[d][pick(apart)]))
        out.append([a, positive, *negatives])
    return np.array(out, np.int64).reshape(-1, 2 + max(1, policy.candidates))


def random_units(rows: int, dim: int, seed: int = 7) -> np.ndarray:
    """Random directions, the baseline of every embedding."""
    return unit(np.random.default_rng(seed).normal(size=(rows, dim)))


def apply_network(rows: DataFrame, net: Network, columns: list[str], name: str = "score", embed: bool = False) -> DataFrame:
    """The network's probability, or its unit vector, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]) if batch.num_rows else np.zeros((0, len(columns)))
            out = net.forward(x)[0]
            made = pa.array(unit(out).tolist(), pa.list_(pa.float64())) if embed else pa.array(sigmoid(out[:, 0]), pa.float64())
            yield pa.RecordBatch.from_pydict({f: batch.column(k) for k, f in enumerate(batch.schema.names)} | {name: made})

    kind = T.ArrayType(T.DoubleType()) if embed else T.DoubleType()
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, kind)]))


@dataclass(frozen=True)
class Saved:
    """What a model directory says of itself."""

    kind: str
    threshold: float
    signature: str
    columns: list[str]
    description: str = ""
    format: int = FORMAT


def save(spark: SparkSession, path: str, meta: Saved, net: Network | None = None, model=None) -> None:
    """A directory with ``meta`` and either a network's layers or a Spark model."""
    spark.createDataFrame([(json.dumps(asdict(meta)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    if net is not None:
        rows = [(k, w.shape[0], w.shape[1], w.ravel().tolist(), b.tolist()) for k, (w, b) in enumerate(zip(net.weights, net.biases))]
        spark.createDataFrame(rows, "layer int, rows int, columns int, weights array<double>, biases array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/layers")
    if model is not None:
        model.write().overwrite().save(f"{path}/model")


SPARK_MODELS = {"logistic": LogisticRegressionModel, "softmax": LogisticRegressionModel, "tree": DecisionTreeClassificationModel}
ORDER = ("neural", "logistic", "tree", "retrieval")  # in which a model is looked for where none is named


def load(spark: SparkSession, path: str) -> tuple[Saved, object]:
    """The directory's description and its model: a network, or a Spark model. Other formats and kinds are refused."""
    raw = json.loads(spark.read.text(f"{path}/meta").first().value)
    if raw.get("format") != FORMAT:
        raise ValueError(f"format {raw.get('format')} is not {FORMAT}; train the model again")
    meta = Saved(**raw)
    if meta.kind in SPARK_MODELS:
        return meta, SPARK_MODELS[meta.kind].load(f"{path}/model")
    if meta.kind not in ("neural", "retrieval"):
        raise ValueError(f"unknown kind {meta.kind}")
    rows = sorted(spark.read.parquet(f"{path}/layers").collect(), key=lambda r: r.layer)
    return meta, Network([np.array(r.weights).reshape(r.rows, r["columns"]) for r in rows], [np.array(r.biases) for r in rows])


def resolved(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ORDER) -> tuple[str, Saved, object]:
    """The first of the kinds that ``folder`` has a model of, with why the others were passed over in the error."""
    reasons = []
    for kind in kinds:
        try:
            return kind, *load(spark, f"{folder}/{kind}")
        except (ValueError, AnalysisException) as e:
            reasons.append(f"{kind}: {str(e).splitlines()[0]}")
    raise ValueError("no model: " + "; ".join(reasons))


def change_scores(pairs: DataFrame, model, columns: list[str], name: str = "score") -> DataFrame:
    """The chance of a change for rows of pairs, by whatever model of pairs it is."""
    return apply_network(pairs, model, columns, name) if isinstance(model, Network) else score(pairs, model, columns, name)


@dataclass(frozen=True)
class Node:
    """A node of a tree: a leaf has no column. ``left`` takes values up to the threshold."""

    column: str | None
    threshold: float
    left: int
    right: int
    probability: float


def nodes(model, columns: list[str], prune: bool = True) -> list[Node]:
    """The fitted tree as a list of nodes, the root first. With ``prune``, splits whose sides decide alike are leaves with
    the weighted share of both."""
    out: list[Node] = []

    def add(node) -> int:
        stats = list(node.impurityStats().stats())
        leaf = node.subtreeDepth() == 0
        at = len(out)
        out.append(Node(None, 0.0, -1, -1, stats[1] / max(sum(stats), 1e-300)))
        if not leaf:
            left, right = add(node.leftChild()), add(node.rightChild())
            a, b = out[left], out[right]
            if prune and a.column is None and b.column is None and (a.probability > 0.5) == (b.probability > 0.5):
                del out[at + 1 :]
            else:
                out[at] = Node(columns[node.split().featureIndex()], float(node.split().threshold()), left, right, out[at].probability)
        return at

    add(model._call_java("rootNode"))
    return out


def rules(tree: list[Node]) -> list[str]:
    """A line for each leaf: its conditions and its probability."""
    out = []

    def walk(at: int, conditions: list[str]) -> None:
        n = tree[at]
        if n.column is None:
            out.append(f"{' and '.join(conditions) or 'always'} -> {n.probability:.3f}")
        else:
            walk(n.left, [*conditions, f"{n.column} <= {n.threshold:.4g}"])
            walk(n.right, [*conditions, f"{n.column} > {n.threshold:.4g}"])

    walk(0, [])
    return out


def explained(rows: DataFrame, tree: list[Node], name: str = "path") -> DataFrame:
    """``rows`` with the conditions that each one passes, as an array of lines with the probability last."""

    def walk(at: int, passed: list):
        n = tree[at]
        if n.column is None:
            return F.array(*passed, F.lit(f"probability {n.probability:.3f}"))
        value = lambda sign: F.format_string(f"{n.column} = %.4f {sign} {n.threshold:.4f}", F.col(n.column).cast("double"))
        return F.when(F.col(n.column) <= n.threshold, walk(n.left, [*passed, value("<=")])).otherwise(walk(n.right, [*passed, value(">")]))

    return rows.withColumn(name, walk(0, []))


def splits(tree: list[Node]) -> dict[str, int]:
    """How often each column splits."""
    out: dict[str, int] = {}
    for n in tree:
        if n.column is not None:
            out[n.column] = out.get(n.column, 0) + 1
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0])))


def simplest_best(results: list[tuple[object, float]], tolerance: float = 0.005) -> object:
    """Of settings in order of complexity with their validation scores: the first within ``tolerance`` of the best."""
    best = max(v for _, v in results)
    return next(s for s, v in results if v >= best - tolerance)


def grid_search(fit, score_of, settings: list, tolerance: float = 0.0) -> tuple[object, object, list[tuple[object, float]]]:
    """Fits every setting (simplest first) and keeps the simplest of the best: ``(setting, model, results)``."""
    fitted = [(s, fit(s)) for s in settings]
    results = [(s, float(score_of(m))) for s, m in fitted]
    chosen = simplest_best(results, tolerance)
    return chosen, next(m for s, m in fitted if s == chosen), results


# The grids of the three models of pairs.
GRIDS = {"tree": (5, 10, 15, 20), "logistic": (0.01, 0.1, 1.0), "neural": ((16,), (32, 16), (64, 32), (128, 64, 32))}
