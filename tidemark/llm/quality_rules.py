"""Operator 5, quality rules: learned decision lists over text statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_texts, table
from .text_stats import ratios, with_stats

#: Labelled rows that rules are learned from, at most.
SAMPLE = 12_000
#: Share of rejected rows that must be bad, on rows that the rule was not grown on.
PRECISION = 0.95
#: Candidate thresholds of a feature, at most.
CUTS = 32
MIN_ROWS, MAX_WORDS_REPEATED, MIN_WORDS = 5, 30, 20


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.cut if self.at_least else x[self.feature] < self.cut

    def column(self) -> Column:
        value, cut = F.col(self.feature), F.lit(self.cut)
        return value >= cut if self.at_least else value < cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.cut:g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(n, bool))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    """Adds the condition of the highest information gain until only bad rows are left or none helps."""
    rule: list[Condition] = []
    inside = rows.copy()
    while bad[inside].mean() < 1:
        p0, base = bad[inside].sum(), np.log2(bad[inside].mean())
        best = (0.0, None)
        for name, values in x.items():
            own, is_bad = values[inside], bad[inside]
            for cut in np.unique(np.quantile(own, np.linspace(0, 1, CUTS))):
                for at_least in (True, False):
                    hit = own >= cut if at_least else own < cut
                    p = is_bad[hit].sum()
                    if p >= MIN_ROWS and p < hit.size and not hit.all():
                        gain = p * (np.log2(p / hit.sum()) - base)
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(name, at_least, float(cut)))
        if best[1] is None or p0 == 0:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    """The leading conditions that keep the most of (bad - good) / rows on the pruning rows."""
    worth = []
    for k in range(1, len(rule) + 1):
        hit = _holds(rule[:k], x, len(bad)) & rows
        worth.append(((2 * bad[hit].sum() - hit.sum()) / max(hit.sum(), 1), -k))
    return rule[: -max(worth)[1]] if worth else rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = PRECISION, seed: int = 7) -> list[Rule]:
    """Ordered rules that reject: sequential covering. Each rule is grown on two thirds of the rows that are left, pruned on the rest, and kept if it is precise there; else its rows are set aside and the covering goes on."""
    n = len(bad)
    rules: list[Rule] = []
    left = np.ones(n, bool)  # rows that no rule rejects
    open_ = left.copy()  # those that rules are still grown on: the rows of an imprecise rule are set aside
    grown = np.random.default_rng(seed).random(n) < 2 / 3
    while bad[open_ & grown].sum() >= MIN_ROWS:
        rule = _grow(x, bad, open_ & grown)
        if not rule:
            break
        rule = _prune(rule, x, bad, open_ & ~grown)
        hit = _holds(rule, x, n) & left
        checked = hit & ~grown
        if bad[hit].sum() >= MIN_ROWS and checked.any() and bad[checked].mean() >= precision:
            rules.append(rule)
            left &= ~hit
        open_ &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        test = reduce(lambda a, b: a & b, (c.column() for c in rule))
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_rules(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> list[Rule]:
    """Rules from at most `bound` labelled documents, one row a key. No labels: no rules."""
    features = ratios()
    rows = with_stats(labelled_texts(docs, labels, "quality", 0, 0, bound)).select("label", *(v.alias(k) for k, v in features.items())).collect()
    if not rows:
        return []
    x = {k: np.array([r[k] for r in rows]) for k in features}
    return learn(x, np.array([r["label"] == 0 for r in rows]))


def filter_quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts of the whole text, base_failed and kept for every row; DataFrame functions only.

    A null or empty text has no words and fails the base rule; repeated rows each get their verdict; an
    empty table gives no row; further columns are ignored.
    """
    counted = with_stats(docs.select("doc_id", "text"))
    ratio = {k: v for k, v in ratios().items() if k != "n_words"}
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_WORDS_REPEATED * F.col("n_words"))
    judged = counted.select("*", *(v.alias(k) for k, v in ratio.items())).withColumn("base_failed", failed)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return filter_quality(docs, learn_rules(docs, table(spark, sf_dir, "labels")))
