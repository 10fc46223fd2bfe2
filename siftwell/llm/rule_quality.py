"""A quality classifier of few rules over text statistics.

Boosted shallow trees over statistics of labelled texts propose conjunctions of
thresholds (every path from a root); a logistic regression with an L1 penalty keeps
few of them; those become one Spark column expression. Statistics are built-in
functions too, so scoring is native.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm._shared import id_and_text, unused_name
from siftwell.llm.toxicity import held_out, labelled_sample

#: Labelled texts that a model is fitted to at most.
SAMPLE, THRESHOLD = 10_000, 0.3
#: A rule is (feature, is greater, threshold) conditions that all hold.
Rule = tuple[tuple[str, bool, float], ...]


def pieces(text: Column) -> dict[str, Column]:
    """What the statistics of a text are made from."""
    return {"text": text, "words": F.array_remove(F.split(text, r"\s+"), ""), "lines": F.array_remove(F.split(text, "\n"), "")}


def statistics(of: dict[str, Column]) -> dict[str, Column]:
    """Numbers that describe a text, from its pieces; all are defined (0 where there is nothing to divide by)."""
    text, words, lines = of["text"], of["words"], of["lines"]
    n, n_words, n_lines = F.length(text).cast("double"), F.size(words).cast("double"), F.size(lines).cast("double")
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    kept = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", ""))
    only = lambda char: n - F.length(F.replace(text, F.lit(char), F.lit("")))
    return {
        "log_words": F.log1p(n_words),
        "word_length": ratio(n, n_words),
        "distinct_words": ratio(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": ratio(F.size(F.array_distinct(lines)), n_lines),
        "words_per_line": ratio(n_words, n_lines),
        "bars": ratio(only("|"), n),
        "symbols": ratio(kept("#*$%&<>{}\\[\\]=^~@_"), n),
        "digits": ratio(kept("0-9"), n),
        "capitals": ratio(kept("A-Z"), n),
        "stops": ratio(kept(".!?"), n_words),
        "commas": ratio(only(","), n_words),
        "marks": ratio(only("!"), n),
        "slashes": ratio(only("/"), n),
    }


def with_statistics(df: DataFrame, text_col: str, name: str, used: set[str]) -> DataFrame:
    """``df`` and a struct of the statistics in ``used``.

    Both steps are generated rows (one for one), as the optimizer copies plain projections into
    every rule that uses them, which would compute a statistic once for each use.
    """
    of = unused_name(df, "_pieces")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    cut = df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in pieces(text).items()]))).alias(of))
    stats = {k: c for k, c in statistics({k: F.col(f"{of}.{k}") for k in ("text", "words", "lines")}).items() if k in used}
    return cut.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array(F.struct(*[c.alias(k) for k, c in stats.items()]))).alias(name))


FEATURES = ("log_words", "word_length", "distinct_words", "distinct_lines", "words_per_line", "bars", "symbols", "digits", "capitals", "stops", "commas", "marks", "slashes")


@dataclass
class RuleModel:
    """Weights of rules over the statistics, and the bias."""

    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def raw(self, values: dict[str, np.ndarray]) -> np.ndarray:
        out = np.full(len(next(iter(values.values()))), self.bias)
        for rule, w in self.rules:
            out += w * holds(rule, values)
        return out

    def column(self, stats: dict[str, Column]) -> Column:
        """The score as a column expression over columns of the statistics."""
        total = F.lit(self.bias)
        for rule, w in self.rules:
            condition = F.lit(True)
            for name, greater, at in rule:
                condition = condition & (stats[name] > at if greater else stats[name] <= at)
            total = total + F.when(condition, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(values.values()))), bool)
    for name, greater, at in rule:
        out &= values[name] > at if greater else values[name] <= at
    return out


def tree_rules(values: dict[str, np.ndarray], residual: np.ndarray, hessian: np.ndarray, depth: int, least: int, cuts: dict[str, np.ndarray], rng: np.random.Generator, path: Rule = (), at: np.ndarray | None = None) -> tuple[list[Rule], np.ndarray]:
    """All paths of a regression tree on half of the features, and its fitted step."""
    at = np.arange(len(residual)) if at is None else at
    step = np.zeros(len(residual))
    step[at] = residual[at].sum() / (hessian[at].sum() + 1.0)
    if not depth or len(at) < 2 * least:
        return [], step
    best = None
    for name in rng.permutation(FEATURES)[: len(FEATURES) // 2 + 1]:
        x = values[name][at]
        bins = np.searchsorted(cuts[name], x, "left")
        g = np.bincount(bins, residual[at], len(cuts[name]) + 1).cumsum()
        h = np.bincount(bins, hessian[at], len(cuts[name]) + 1).cumsum()
        c = np.bincount(bins, minlength=len(cuts[name]) + 1).cumsum()
        for k in range(len(cuts[name])):
            if c[k] >= least and c[-1] - c[k] >= least:
                gain = g[k] ** 2 / (h[k] + 1) + (g[-1] - g[k]) ** 2 / (h[-1] - h[k] + 1)
                if best is None or gain > best[0] + 1e-12:
                    best = gain, str(name), float(cuts[name][k])
    if best is None:
        return [], step
    _, name, cut = best
    low = values[name][at] <= cut
    rules, out = [], np.zeros(len(residual))
    for side, greater in ((at[low], False), (at[~low], True)):
        own = (*path, (name, greater, cut))
        more, fitted = tree_rules(values, residual, hessian, depth - 1, least, cuts, rng, own, side)
        rules += [own, *more]
        out[side] = fitted[side]
    return rules, out


def lasso(x: np.ndarray, y: np.ndarray, strength: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with an L1 penalty, by accelerated proximal steps."""
    n = len(y)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w, b = np.zeros(x.shape[1]), math.log(share / (1 - share))
    v, c, t = w.copy(), b, 1.0
    rate = 4 / (np.linalg.norm(np.hstack([x, np.ones((n, 1))]), 2) ** 2 / n)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y
        new = v - rate * (x.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * strength, 0)
        bias = c - rate * error.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), bias + (t - 1) / t2 * (bias - b)
        w, b, t = new, bias, t2
    return w, b


def fit(values: dict[str, np.ndarray], y: np.ndarray, trees: int = 40, depth: int = 3, strength: float = 0.002, seed: int = 5) -> RuleModel:
    """Rules from boosted trees, weighted by the lasso. With one label only, or no rows, the score is its smoothed share."""
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel(math.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    cuts = {f: np.unique(np.quantile(values[f], np.linspace(0.01, 0.99, 60))) for f in FEATURES}
    raw, rules = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        more, step = tree_rules(values, y - p, p * (1 - p), depth, max(10, len(y) // 500), cuts, rng)
        rules += more
        raw += 0.3 * step
    kept: dict[bytes, Rule] = {}
    for rule in sorted(set(rules), key=lambda r: (len(r), r)):
        h = holds(rule, values)
        if 0.002 < h.mean() < 0.998:
            kept.setdefault(h.tobytes(), rule)
    kept_rules = list(kept.values())
    if not kept_rules:
        return RuleModel(math.log(y.mean() / (1 - y.mean())))
    x = np.stack([holds(r, values) for r in kept_rules], 1).astype(float)
    w, b = lasso(x, y, strength)
    return RuleModel(float(b), [(r, float(k)) for r, k in zip(kept_rules, w, strict=True) if abs(k) > 1e-4])


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """A model of ``labels.quality``, fitted to at most ``most`` rows whose crc32(doc_id) mod 5 is not 0.

    Rows with a null id or label aren't used; a null text is empty; rows that repeat count as often.
    With no row, or one label only, every score is the smoothed share of label 1. Only the statistics
    of the sample reach the driver. Other columns are not read, so their names can't clash.
    """
    sample = labelled_sample(docs, labels, "quality", 5, 0, most, id_col, text_col).select("text", "y").repartition(16)
    pdf = with_statistics(sample, "text", "x", set(FEATURES)).select("y", "x.*").toPandas().sort_values(["y", *FEATURES])
    return fit({f: pdf[f].to_numpy(float) for f in FEATURES}, pdf.y.to_numpy(float))


def _with_score(docs: DataFrame, model: RuleModel, text_col: str, score: str) -> DataFrame:
    """``docs`` and the score; the statistics are computed once and leave again."""
    stats = unused_name(docs, "_statistics")
    used = {name for rule, _ in model.rules for name, _, _ in rule} or {"log_words"}
    return with_statistics(docs, text_col, stats, used).withColumn(score, model.column({k: F.col(f"{stats}.{k}") for k in used})).drop(stats)


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    A null text is empty; an empty text has statistics of 0 and a score like any other. Null ids
    aren't held out. Rows that repeat are each scored, with equal scores. No rows: no rows. Other
    columns are not read, so their names can't clash.
    """
    scored = _with_score(id_and_text(docs, id_col, text_col), model, "text", "score")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text's score is under ``threshold``; all columns stay, whatever their names.

    A null text is empty; an empty text has a score like any other. Rows that repeat have equal
    scores, so all or none of them stay; ids aren't read. No rows: no rows.
    """
    name = unused_name(docs, "_score")
    return _with_score(docs, model, text_col, name).filter(F.col(name) >= threshold).drop(name)
