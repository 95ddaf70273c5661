"""Learned decision lists over statistics of texts.

Sequential covering: a rule is a conjunction of thresholds, grown condition by
condition for information gain on two thirds of the labelled rows, pruned from
its end on the others, and kept if it is precise there; the rows that it covers
leave and the next rule is learned.  The ordered rules become one Spark
conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm import docstats
from contactloom.llm.blocks import checkpoint

#: Labelled rows that are learned from at most, those of the least hash of the id.
SAMPLE = 40_000
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 48
#: A rule must be this precise on the rows kept for pruning.
PRECISION = 0.95

FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "digits_per_word": ("n_digits", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "same_as_last_share": ("n_same_as_last", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def features(prefix: str = "") -> dict[str, Column]:
    """The statistics that rules test; 0 where there is nothing to divide by."""
    return {k: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)) for k, (a, b) in FEATURES.items()}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        c = features()[self.feature]
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)

    def test(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    hit = np.ones(len(next(iter(x.values()))), dtype=bool)
    for c in rule:
        hit &= c.test(x)
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0:
            break
        best, gain = None, 1e-9
        base = math.log2(p0 / (p0 + n0))
        for name in sorted(x):
            v, b = x[name][inside], bad[inside]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS), method="lower"))
            order = np.argsort(v, kind="stable")
            v, total = v[order], np.concatenate(([0], np.cumsum(b[order])))
            upto = np.searchsorted(v, cuts, "right")
            # halfway to the next value that occurs
            after = np.append(v, v[-1])[upto]
            for cut, k in zip(((cuts + after) / 2).tolist(), upto.tolist(), strict=True):
                for above, p, n in ((False, total[k], k - total[k]), (True, p0 - total[k], n0 - (k - total[k]))):
                    if p > 0 and p + n < p0 + n0:
                        g = p * (math.log2(p / (p + n)) - base)
                        if g > gain:
                            best, gain = Condition(name, above, float(cut)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.test(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float]:
    best, worth, precision = rule, -2.0, 0.0
    for k in range(len(rule), 0, -1):
        hit = _covers(rule[:k], x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        w = (p - n) / (p + n) if p + n else -1.0
        if w >= worth and p + n:
            best, worth, precision = rule[:k], w, p / (p + n)
    return best, precision


def learn(x: dict[str, np.ndarray], bad: np.ndarray, order: np.ndarray) -> list[Rule]:
    """Ordered rules for `bad` rows; `order` deals rows to growing (two of three) and pruning."""
    grow = order % 3 != 0
    left, rules, banned = np.ones(len(bad), dtype=bool), [], set()
    while len(rules) < MAX_RULES:
        g, p = left & grow, left & ~grow
        if (g & bad).sum() < 3 or not p.any():
            break
        rule = _grow({k: v[g] for k, v in x.items() if k not in banned}, bad[g])
        if not rule:
            break
        first = rule[0].feature
        rule, precision = _prune(rule, {k: v[p] for k, v in x.items()}, bad[p])
        hit = _covers(rule, x) & left
        if precision < PRECISION or not (hit & bad & grow).any():
            banned.add(first)  # the next rule begins elsewhere
            continue
        rules.append(rule)
        left &= ~hit
    return rules


def as_column(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, or null, as one conditional expression."""
    out = None
    for i, rule in enumerate(rules):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))


_NAMES = (*docstats.COUNTS, *docstats.MORE)
_SCHEMA = "doc_id long, " + ", ".join(f"{k} long" for k in _NAMES)


def _run(batches):
    for batch in batches:
        got = docstats.statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[k], pa.int64()) for k in _NAMES)], names=["doc_id", *_NAMES])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts for each row of `docs`; see docstats.statistics."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_run, _SCHEMA)


def base_failed() -> Column:
    """Fewer than 10 words, or more than a fifth of the words in repeated 5-word windows."""
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def learned_rules(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules for quality 0, from at most `sample` labelled rows that pass the base tests.

    Labels with a null id or quality are left out; without rows of both kinds
    there are no rules.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id is not null and quality is not null").dropDuplicates(["doc_id"])
    known = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(sample)
    rows = stats.filter(~base_failed()).join(known, "doc_id").select("h", "quality", *[c.alias(k) for k, c in features().items()]).dropDuplicates(["h"]).orderBy("h").limit(sample).toPandas()
    bad = (rows["quality"] == 0).to_numpy()
    if not bad.any() or bad.all():
        return []
    x = {k: rows[k].to_numpy(float) for k in FEATURES}
    return learn(x, bad, np.arange(len(bad)))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Counts of each text and whether it is kept.

    base_failed: fewer than 10 words, or more than a fifth of the words in
    repeated 5-word windows.  rule: the first learned rule that holds, else
    null; kept: neither.  One row for each row, repeated and null ids included;
    null texts have no words; other columns are not read.
    """
    stats = checkpoint(text_statistics(docs, id_col, text_col))
    rules = learned_rules(stats, labels, sample)
    out = stats.withColumns({"base_failed": base_failed(), "rule": as_column(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
