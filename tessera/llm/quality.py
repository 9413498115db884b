"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of the whole text are Spark column expressions. On a bounded sample of labelled documents,
shallow boosted trees are grown; every path from a root to a node is a candidate rule, a conjunction of
thresholds. A logistic model with an L1 penalty weighs the rules and drops most of them, and the remaining
rules are compiled back into one Spark column, so scoring any corpus is a single narrow pass.

Null and empty texts have all statistics 0 and are scored as such. Scores depend on the text alone. If the
labels hold one class only (or none), the score is that class's smoothed share. Rows that repeat a label are
merged by their largest value; labels with nulls are ignored. Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, whole_text

#: Labelled documents that the model is fitted on, at most: those whose hashed doc_id is smallest.
SAMPLE = 8_000
TREES, DEPTH, RATE, BINS, LEAF = 40, 3, 0.3, 32, 20
PENALTY, STEPS = 2e-3, 600
FOLDS, HELD_OUT = 3, 1


def _left(text: Column, dropped: str) -> Column:
    """Characters left when the pattern's matches are dropped."""
    return F.length(F.regexp_replace(text, dropped, "")).cast("double")


def counts(text: Column) -> dict[str, Column]:
    """Counts over a whole text, by name; each reads the text."""
    words, lines = F.split(text, r"[\x20\x09-\x0D]+"), F.split(text, "\n")
    return {
        "size": F.length(text).cast("double"),
        "words": F.when(text == "", F.lit(0.0)).otherwise(F.size(words).cast("double")),
        "different_words": F.when(text == "", F.lit(0.0)).otherwise(F.size(F.array_distinct(words)).cast("double")),
        "lines": F.size(lines).cast("double"),
        "different_lines": F.size(F.array_distinct(lines)).cast("double"),
        "solid": _left(text, r"[\x20\x09-\x0D]+"),
        "letters": _left(text, r"[^\p{L}]+"),
        "upper": _left(text, r"[^\p{Lu}]+"),
        "digits": _left(text, r"[^0-9]+"),
        "marks": _left(text, r"[^.,;:!?]+"),
        "symbols": _left(text, r"[^#$%&*|<>{}=+~^@_\\\[\]]+"),
        "exclaimed": _left(text, r"[^!?]+"),
        "unrepeated": _left(text, r"(?<![^ \n])([^ \n]++)(?: \1(?![^ \n]))++"),
    }


def statistics(n: dict[str, Column]) -> dict[str, Column]:
    """Statistics from counts, by name."""
    at_least_one = lambda c: F.greatest(c, F.lit(1.0))
    return {
        "log_words": F.log1p(n["words"]),
        "word_length": n["solid"] / at_least_one(n["words"]),
        "distinct_words": n["different_words"] / at_least_one(n["words"]),
        "repeated": (n["size"] - n["unrepeated"]) / at_least_one(n["size"]),
        "distinct_lines": n["different_lines"] / n["lines"],
        "line_length": n["size"] / n["lines"],
        "letters": n["letters"] / at_least_one(n["solid"]),
        "upper": n["upper"] / at_least_one(n["letters"]),
        "digits": n["digits"] / at_least_one(n["solid"]),
        "marks": n["marks"] / at_least_one(n["words"]),
        "symbols": n["symbols"] / at_least_one(n["words"]),
        "exclaimed": n["exclaimed"] / at_least_one(n["words"]),
    }


def with_statistics(docs: DataFrame, text: Column) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with the counts of ``text`` as ``_tessera_`` columns, and the statistics over them.

    The counts come out of a generator, through which the optimizer pushes no filter; else a filter on the
    score would read the text once for every threshold of every rule.
    """
    counted = docs.select("*", F.inline(F.array(F.struct(*[c.alias(f"_tessera_{k}") for k, c in counts(text).items()]))))
    return counted, statistics({k: F.col(f"_tessera_{k}") for k in counts(text)})


@dataclass
class RuleModel:
    """score = sigmoid(intercept + sum of the weights of the rules that hold); a rule is a tuple of (name, is_above, threshold)."""

    intercept: float = 0.0
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]] = field(default_factory=list)

    def column(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, above, at in conditions:
                holds = holds & ((stats[name] > at) if above else (stats[name] <= at))
            total = total + holds.cast("double") * F.lit(weight)
        return 1.0 / (1.0 + F.exp(-total))

    def score(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        total = np.full(len(next(iter(rows.values()))), self.intercept)
        for conditions, weight in self.rules:
            total = total + weight * _holds(conditions, rows)
        return 1.0 / (1.0 + np.exp(-total))


def _holds(conditions, rows: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(rows.values()))), bool)
    for name, above, at in conditions:
        out &= rows[name] > at if above else rows[name] <= at
    return out


def _grow(binned: np.ndarray, edges: list[np.ndarray], names: list[str], residual: np.ndarray, at: np.ndarray, path: tuple, found: set, fitted: np.ndarray) -> None:
    """Splits the rows ``at`` by the best threshold for the squared error; notes every path and the leaf means."""
    fitted[at] = residual[at].mean()
    if path:
        found.add(path)
    if len(path) >= DEPTH or len(at) < 2 * LEAF:
        return
    best = (1e-9, None, None)
    total, n = residual[at].sum(), len(at)
    for k in range(binned.shape[1]):
        counts = np.cumsum(np.bincount(binned[at, k], minlength=BINS + 1))[:-1]
        sums = np.cumsum(np.bincount(binned[at, k], weights=residual[at], minlength=BINS + 1))[:-1]
        fits = (counts >= LEAF) & (n - counts >= LEAF)
        gain = np.where(fits, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(n - counts, 1) - total**2 / n, -1)
        gain = gain[: len(edges[k])]
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), k, int(gain.argmax()))
    _, k, cut = best
    if k is None:
        return
    above = binned[at, k] > cut
    for side in (False, True):
        _grow(binned, edges, names, residual, at[above == side], (*path, (names[k], side, float(edges[k][cut]))), found, fitted)


def fit_rules(rows: dict[str, np.ndarray], label: np.ndarray) -> RuleModel:
    share = (label.sum() + 1) / (len(label) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(label) < 2 * LEAF or label.min() == label.max():
        return RuleModel(prior)
    names = list(rows)
    edges = [np.unique(np.quantile(rows[k], np.arange(1, BINS) / BINS)) for k in names]
    binned = np.stack([np.searchsorted(e, rows[k], side="left") for e, k in zip(edges, names)], axis=1)
    rng, found, logit = np.random.default_rng(7), set(), np.full(len(label), prior)
    for _ in range(TREES):
        residual = label - 1 / (1 + np.exp(-logit))
        chosen = np.sort(rng.choice(len(names), max(2, 2 * len(names) // 3), replace=False))
        part, fitted = np.flatnonzero(rng.random(len(label)) < 0.7), np.zeros(len(label))
        paths: set = set()
        if len(part) < 2 * LEAF:
            continue
        _grow(binned[:, chosen], [edges[k] for k in chosen], [names[k] for k in chosen], residual, part, (), paths, fitted)
        for path in paths:
            if len(path) == DEPTH or not any(path == p[: len(path)] and len(p) > len(path) for p in paths):
                inside = _holds(path, rows)
                logit[inside] += RATE * 4 * residual[inside].mean() if inside.any() else 0
        found |= {tuple(sorted(set(p))) for p in paths}
    rules = sorted(found)
    held = np.stack([_holds(r, rows) for r in rules], axis=1)
    weights, intercept = _lasso_logistic(held, label)
    return RuleModel(intercept, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6])


def _lasso_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the mean logistic loss plus an L1 penalty on rules scaled to unit variance."""
    mean = x.mean(axis=0)
    scale = np.maximum(np.sqrt(mean * (1 - mean)), 1e-3)  # of zeros and ones
    z = (x - mean) / scale
    step = 4.0 / (np.linalg.eigvalsh(z.T @ z)[-1] / len(y) + 1)
    w = v = np.zeros(z.shape[1])
    b = c = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    t = 1.0
    for _ in range(STEPS):
        error = (1 / (1 + np.exp(-(z @ v + c))) - y) / len(y)
        moved = v - step * (z.T @ error)
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
        new_b, new_t = c - step * error.sum(), (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w / scale, float(b - (w / scale) @ mean)


def held_out() -> Column:
    """Rows kept from training: crc32 of doc_id's text leaves the remainder 1."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows, so it may be broadcast
    known_docs = docs.select("doc_id", whole_text().alias("_text")).join(F.broadcast(chosen), "doc_id")
    rows, stats = with_statistics(known_docs, F.col("_text"))
    frame = rows.select("doc_id", "_label", *[c.alias(k) for k, c in stats.items()]).orderBy("doc_id").toPandas()
    return fit_rules({k: frame[k].to_numpy(float) for k in stats}, frame["_label"].to_numpy(float))


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """All columns of ``docs`` with ``_tessera_score``."""
    counted, stats = with_statistics(docs, whole_text())
    return counted.select(*docs.columns, model.column(stats).alias("_tessera_score"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts."""
    return scored(docs, fit(docs, labels)).where("_tessera_score >= 0.5").select(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out().alias("held_out"), F.col("_tessera_score").alias("score"), (F.col("_tessera_score") >= 0.5).cast("int").alias("predicted"))
