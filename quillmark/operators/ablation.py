"""Ablations: a model fitted and measured again and again with other columns, parameters or features, as a table of runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.config import REPRESENTATIONS, FeatureConfig
from quillmark.operators import features, metrics, models, retrieval

SEEDS = (42, 43, 44, 45, 46)


@dataclass(frozen=True)
class Parameters:
    """The defaults of the three models of pairs."""

    max_depth: int = 15
    min_samples_leaf: int = 2
    min_impurity_decrease: float = 0.0
    split_bins: int = 255
    class_weights: bool = True
    iterations: int = 200
    l2_lambda: float = 1e-4
    hidden_layers: tuple[int, ...] = (128, 64, 32)
    dropout: float = 0.3
    learning_rate: float = 1e-3
    batch_size: int = 64
    patience: int = 10
    epochs: int = 100


# What the sweeps try. A tree here has no least number of rows to split, and a linear model no learning rate.
SWEEPS: dict[str, dict[str, tuple]] = {
    "tree": {
        "max_depth": (1, 2, 3, 4, 5, 6, 8, 10, 15, 20), "min_samples_leaf": (1, 2, 5, 10, 25, 100), "min_impurity_decrease": (0.0, 1e-5, 1e-4, 1e-3, 1e-2), "class_weights": (True, False),
        "split_bins": (16, 32, 64, 128, 255),
    },
    "logistic": {"iterations": (100, 500, 1000, 2500, 5000, 10000), "l2_lambda": (0.0, 1e-4, 1e-3, 1e-2, 1e-1), "class_weights": (True, False)},
    "neural": {
        "hidden_layers": ((16,), (32, 16), (64, 32), (128, 64, 32), (128, 64, 32, 16, 8)), "l2_lambda": (0.0, 1e-4, 1e-3, 1e-2, 1e-1), "dropout": (0.0, 0.1, 0.2, 0.3, 0.5),
        "learning_rate": (1e-4, 5e-4, 1e-3, 5e-3, 1e-2), "batch_size": (32, 64, 128, 256), "patience": (0, 3, 8),
    },
}
DEPTHS, LEAVES = (5, 10, 15, 20, 25), (1, 5, 25, 100)


def with_baseline(values: Iterable, baseline: object) -> list:
    """The values of a sweep with the baseline's among them; numbers in order."""
    out = list(values)
    if baseline not in out:
        out.append(baseline)
        if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in out):
            out.sort()
    return out


def thinned(values: list) -> list:
    """The first, the middle and the last, for a quick study."""
    return values if len(values) <= 3 else [values[0], values[len(values) // 2], values[-1]]


@dataclass(frozen=True)
class Selection:
    name: str
    columns: tuple[str, ...]


def groups(config: FeatureConfig = FeatureConfig()) -> dict[str, tuple[str, ...]]:
    """Columns of a pair by feature group."""
    return {g: tuple(features.pair_columns(g, config)) for g in features.GROUPS}


def selections(columns: Iterable[str], by_group: dict[str, tuple[str, ...]]) -> list[Selection]:
    """ALL, then without each group, then with each alone; groups without columns here are passed over. The overall distance
    stays where two absolute differences or more are left, for ``selected`` to measure it anew."""
    have = list(columns)
    present = {g: tuple(c for c in have if c in cs) for g, cs in by_group.items()}
    present = {g: cs for g, cs in present.items() if cs}

    def of(kept: Iterable[str]) -> tuple[str, ...]:
        kept = [c for c in kept if c != features.OVERALL]
        return (*kept, features.OVERALL) if features.OVERALL in have and sum(c.startswith("abs_") for c in kept) > 1 else tuple(kept)

    out = [Selection("ALL", tuple(have))]
    out += [Selection(f"ALL - {g}", of(c for c in have if c not in cs)) for g, cs in present.items() if len(cs) < len(have)]
    return out + [Selection(f"ONLY {g}", of(cs)) for g, cs in present.items()]


def selected(pairs: DataFrame, selection: Selection, *keep: str) -> DataFrame:
    """The selection's columns, with the overall distance over the absolute differences that are left."""
    gaps = [c for c in selection.columns if c.startswith("abs_")]
    again = F.sqrt(sum((F.col(c) * F.col(c) for c in gaps), F.lit(0.0)) / max(1, len(gaps)))
    return pairs.select(*keep, *[again.alias(c) if c == features.OVERALL and selection.name != "ALL" else F.col(c) for c in selection.columns])


def study(chosen: list[Selection], run: Callable[[tuple[str, ...], int], float], seeds: tuple[int, ...] = (42,)) -> list[tuple[str, int, float, float]]:
    """``(experiment, seeds, mean, deviation)`` of a measure; equal column sets run once for a seed."""
    known: dict[tuple[tuple[str, ...], int], float] = {}
    out = []
    for s in chosen:
        values = []
        for seed in seeds:
            if (s.columns, seed) not in known:
                known[s.columns, seed] = run(s.columns, seed)
            values.append(known[s.columns, seed])
        out.append((s.name, len(values), float(np.mean(values)), float(np.std(values, ddof=1)) if len(values) > 1 else 0.0))
    return out


@dataclass(frozen=True)
class Data:
    """Pairs ``(doc_id, sent_idx, level, label, columns)``: what is learned from, what chooses the threshold, what is measured."""

    train: DataFrame
    validation: DataFrame
    test: DataFrame
    columns: tuple[str, ...]


def fitted(kind: str, p: Parameters, train: DataFrame, columns: list[str], seed: int = 42, most: int = 150_000):
    """A model of one kind. The network trains on at most ``most`` rows, the first in hash order."""
    if kind == "tree":
        return models.fit_tree(train, columns, p.max_depth, p.min_samples_leaf, p.min_impurity_decrease, p.split_bins, p.class_weights)
    if kind == "logistic":
        return models.fit_logistic(train, columns, p.l2_lambda, p.iterations, p.class_weights)
    if kind != "neural":
        raise ValueError(f"no model {kind!r}")
    rows = train.orderBy(F.xxhash64(F.lit(seed), "doc_id", "sent_idx"), "doc_id", "sent_idx").limit(most).select("label", *columns).toArrow()
    x = np.column_stack([rows.column(c).to_numpy() for c in columns])
    return models.fit_network(x, rows.column("label").to_numpy().astype(float), p.hidden_layers, p.epochs, p.learning_rate, p.batch_size, p.l2_lambda, p.dropout, p.patience, seed)


def run_once(kind: str, p: Parameters, data: Data, selection: Selection | None = None, seed: int = 42) -> dict[str, float]:
    """One run: fit, the threshold with the best macro-F1 on the validation pairs, and the macro-F1 of all three tables; of
    the test also by level, under that threshold and under each level's own."""
    selection = selection or Selection("ALL", data.columns)
    columns = list(selection.columns)
    part = {k: selected(getattr(data, k), selection, "doc_id", "sent_idx", "level", "label") for k in ("train", "validation", "test")}
    model = fitted(kind, p, part["train"], columns, seed)
    scored = {k: models.change_scores(rows, model, columns).select("doc_id", "level", "label", "score").persist() for k, rows in part.items()}
    cut = float(metrics.best_threshold(scored["validation"]).first().threshold)
    out = {f"{k}_macro_f1": float(metrics.confusion(rows, threshold=cut).first().macro_f1) for k, rows in scored.items()}
    own = metrics.best_threshold(scored["validation"], "level").select("level", "threshold")
    tuned = scored["test"].join(F.broadcast(own), "level", "left").withColumn("threshold", F.coalesce("threshold", F.lit(cut)))
    out |= {f"pooled_{r.level}": r.macro_f1 for r in metrics.confusion(scored["test"], "level", threshold=cut).collect()}
    out |= {f"tuned_{r.level}": r.macro_f1 for r in metrics.confusion(tuned, "level", threshold=F.col("threshold")).collect()}
    for rows in scored.values():
        rows.unpersist()
    return out | {"threshold": cut}


@dataclass
class Runs:
    """Runs that are asked again are not run again; each asked run is a row of ``table``."""

    data: Data
    seeds: tuple[int, ...] = (42,)
    known: dict = field(default_factory=dict)
    table: list[dict] = field(default_factory=list)

    def add(self, section: str, kind: str, experiment: str, p: Parameters = Parameters(), selection: Selection | None = None, param: str = "", value: object = "", data: Data | None = None) -> dict:
        found = []
        for seed in self.seeds:
            key = (kind, p, selection.columns if selection else None, seed, id(data or self.data))
            if key not in self.known:
                self.known[key] = run_once(kind, p, data or self.data, selection, seed)
            found.append(self.known[key])
        names = sorted(set().union(*found))
        mean = {f"{n}_mean": float(np.mean([f[n] for f in found if n in f])) for n in names}
        std = {f"{n}_std": float(np.std([f[n] for f in found if n in f], ddof=1)) if len(found) > 1 else 0.0 for n in names}
        self.table.append({"section": section, "model": kind, "experiment": experiment, "param": param, "value": str(value), "seeds": len(found)} | mean | std)
        return self.table[-1]

    def features(self, kind: str, config: FeatureConfig = FeatureConfig()) -> None:
        for s in selections(self.data.columns, groups(config)):
            self.add("features", kind, s.name, selection=s)

    def parameters(self, kind: str, quick: bool = False) -> None:
        base = Parameters()
        for param, values in SWEEPS[kind].items():
            values = with_baseline(values, getattr(base, param))
            for v in thinned(values) if quick else values:
                self.add("parameters", kind, f"{param}={v}", replace(base, **{param: v}), param=param, value=v)
        if kind == "tree":
            for depth in thinned(list(DEPTHS)) if quick else DEPTHS:
                for leaf in thinned(list(LEAVES)) if quick else LEAVES:
                    self.add("grid", kind, f"depth={depth} leaf={leaf}", replace(base, max_depth=depth, min_samples_leaf=leaf), param="depth x leaf", value=f"{depth} x {leaf}")

    def pipeline(self, kind: str, build: Callable[[FeatureConfig], Data], chosen: list[tuple[str, str, FeatureConfig]]) -> None:
        """Each variant's pairs are built anew."""
        for what, name, config in chosen:
            self.add("pipeline", kind, f"{what}: {name}", param=what, value=name, data=build(config))


def variants(base: FeatureConfig = FeatureConfig()) -> list[tuple[str, str, FeatureConfig]]:
    """The settings of feature extraction that are tried, one changed at a time."""
    orders = [(n,) for n in range(1, 6)] + [(1, 2), (2, 3), (3, 4), (3, 4, 5), (1, 2, 3, 4, 5), ()]
    name = lambda o: "n=" + ",".join(map(str, o)) if o else "none"
    tried: list[tuple[str, str, dict]] = [("casing", c, {"casing": c}) for c in ("preserve", "lower", "hybrid")]
    tried += [("char_n", name(o), {"char_orders": o}) for o in orders]
    tried += [("char_buckets", f"buckets={b}", {"char_buckets": b}) for b in (16, 32, 64, 128, 256, 512, 1024, 2048)]
    tried += [("char_typed", n, {"char_typed": t}) for n, t in (("all", False), ("typed", True))]
    tried += [("pos_n", name(o), {"pos_orders": o}) for o in ((), (1,), (2,), (3,), (1, 2), (1, 2, 3))]
    tried += [("pos_buckets", f"buckets={b}", {"pos_buckets": b}) for b in (32, 64, 128, 256, 512)]
    tried += [("function_words", n, {"function_word_profile": t}) for n, t in (("off", False), ("on", True))]
    tried += [("pair_representation", r.lower(), {"representation": r}) for r in REPRESENTATIONS]
    tried += [("z_clip", f"{c:g}" if c else "off", {"z_clip": c}) for c in (0.0, 3.0, 5.0, 10.0)]
    tried += [("block_differences", n, {"full": t}) for n, t in (("measures", False), ("every bucket", True))]
    return [(what, label, replace(base, **change)) for what, label, change in tried]


def retrieval_variants(base: retrieval.Settings = retrieval.Settings()) -> list[tuple[str, str, retrieval.Settings]]:
    """The settings of the retrieval model that are tried, one changed at a time."""
    own = {f.name for f in fields(retrieval.Settings)}
    tried: list[tuple[str, str, dict]] = [("baseline", "baseline", {})]
    tried += [("embedding_size", f"dim={d}", {"dim": d}) for d in (8, 16, 64)] + [("margin", f"margin={m}", {"margin": m}) for m in (0.2, 1.0)]
    tried += [("hidden", "linear", {"hidden": ()}), ("hidden", "256,128", {"hidden": (256, 128)}), ("mining", "1 negative", {"candidates": 1}), ("mining", "hardest of 8", {"candidates": 8})]
    tried += [("sampling", "adjacent segments", {"author_counts": False}), ("sampling", "no far positives", {"far_positive": 0.0}), ("sampling", "half far positives", {"far_positive": 0.5})]
    tried += [("negatives", "half from other documents", {"cross_document": 0.5})] + [("profile_scale", f"scale={x:g}", {"profile_scale": x}) for x in (0.0, 2.0, 8.0)]
    tried += [("window", f"window={w}", {"windows": (w,)}) for w in (1, 3, 5)] + [("char_ngram", f"n={n}", {"char_orders": (n,)}) for n in range(1, 6)]
    tried += [("char_ngram", "n=1,2,3,4,5", {"char_orders": (1, 2, 3, 4, 5)})] + [("char_buckets", f"buckets={b}", {"char_buckets": b}) for b in (64, 128, 512, 1024)]
    tried += [("casing", c, {"casing": c}) for c in ("preserve", "lower", "hybrid")] + [("features", "no tag profile", {"pos_orders": ()}), ("features", "no function words", {"function_word_profile": False}), ("features", "no characters", {"char_orders": ()})]
    out = []
    for what, label, change in tried:
        parts = {k: v for k, v in change.items() if k in own}
        policy = {k: v for k, v in change.items() if k in {f.name for f in fields(models.TripletPolicy)}}
        config = {k: v for k, v in change.items() if k not in own and k not in policy}
        out.append((what, label, replace(base, **parts, policy=replace(base.policy, **policy), features=replace(base.features, **config))))
    return out


def retrieval_study(training: DataFrame, validation: DataFrame, test: DataFrame | None, chosen: list[tuple[str, str, retrieval.Settings]]) -> list[dict]:
    """A row for each variant: its window, threshold, and what the learned vectors measure."""
    rows = []
    for what, label, settings in chosen:
        r = retrieval.run(training, validation, test, settings)
        rows.append({"variant": what, "value": label, "window": r.window, "validation_auc": r.validation_auc, "threshold": r.threshold} | r.measures["learned"])
    return rows
