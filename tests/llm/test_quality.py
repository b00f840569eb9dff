import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import additive, common, quality_model, quality_rules
from tidemark.llm.text_stats import COUNTS, with_stats

from .cases import documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w, places, covered = WORD.findall(t), defaultdict(list), set()
    for k in range(len(w) - 7):
        places[tuple(w[k : k + 8])].append(k)
    for own in places.values():
        if len(own) > 1:
            covered.update(x for k in own for x in range(k, k + 8))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_counts_against_brute_force(spark):
    got = with_stats(documents(spark)).select("doc_id", *COUNTS[:5]).collect()
    assert Counter(map(tuple, got)) == Counter((doc, *counts(t)) for doc, t, *_ in rows())
    assert with_stats(documents(spark, [])).count() == 0


def test_rules_are_learned_and_judge(spark, sf):
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    rules = quality_rules.learn_rules(docs, labels)
    assert rules and all(str(c) for rule in rules for c in rule)
    got = {r.doc_id: r for r in quality_rules.filter_quality(docs, rules).collect()}
    for r in docs.collect():
        n, chars, symbols, dup, repeat = counts(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert g.base_failed == (n < 20 or 100 * repeat > 30 * n) and not (g.base_failed and g.kept)
    judged = [(got[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in got]
    clean = [g.kept for g, q in judged if q == 1 and not g.base_failed]
    junk = [g.kept for g, q in judged if q == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.4


def test_rules_without_labels_keep_all_that_pass(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.learn_rules(documents(spark), empty) == []
    got = quality_rules.filter_quality(documents(spark), []).collect()
    assert len(got) == len(rows()) and all(r.kept != r.base_failed for r in got)


def test_scores_equal_brute_force(spark):
    """The additive model's score from its tables, a text at a time, its statistics counted without Spark."""
    sf = "/root/testdata/sf0.001"
    model = quality_model.train(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"))
    texts = {k: t for k, t, *_ in rows() if k is not None}
    share = lambda a, b: a / max(b, 1)
    for r in quality_model.classify(documents(spark, [x for x in rows() if x[0] is not None]), model).collect():
        t = texts[r.doc_id] or ""
        n, chars, symbols, dup, repeat = counts(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        x = {"n_words": n, "word_length": share(chars, n), "symbols_per_word": share(symbols, n), "dup_line_share": share(dup, len(lines)), "repeat_share": share(repeat, n)}
        x |= {"distinct_share": share(len({*WORD.findall(t)}), n), "words_per_line": share(n, len(lines)), "upper_share": share(len(re.findall("[A-ZÀ-ÖØ-Þ]", t)), len(t))}
        x |= {"digit_share": share(len(re.findall("[0-9]", t)), len(t)), "exclaim_per_word": share(t.count("!"), n), "punct_per_word": share(len(re.findall("[.,;:!?]", t)), n)}
        bins = [sum(v >= c for c in cuts) for v, cuts in zip((x[k] for k in model.names), model.cuts)]
        margin = model.intercept + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[bins[a], bins[b]] for a, b, t in model.pairs)
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))) < 1e-9


def test_covering_goes_on_after_an_imprecise_rule():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(4000), "b": rng.random(4000)}
    bad = (x["a"] >= 0.7) & (rng.random(4000) < 0.6) | (x["b"] >= 0.97)
    rules = quality_rules.learn(x, bad)
    assert any(c.feature == "b" for rule in rules for c in rule)


def test_decision_list_on_a_known_rule():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] >= 0.8) & (x["b"] < 0.5)
    rules = quality_rules.learn(x, bad)
    said = np.zeros(3000, bool)
    for rule in rules:
        said |= quality_rules._holds(rule, x, 3000)
    assert (said == bad).mean() > 0.98


def test_the_learned_expression_equals_the_rules(spark):
    rule = [(quality_rules.Condition("a", True, 0.5), quality_rules.Condition("b", False, 2.0)), (quality_rules.Condition("b", True, 9.0),)]
    df = spark.createDataFrame([(0.6, 1.0), (0.6, 3.0), (0.1, 9.0), (0.1, 1.0)], "a double, b double")
    assert [r.v for r in df.select(quality_rules.verdict(rule).alias("v")).collect()] == [False, True, False, True]


def test_additive_model_finds_effects_and_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((6000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = additive.fit(["a", "b", "c"], x, y)
    assert (0, 1) in [(a, b) for a, b, _ in model.pairs]
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95
    flat = additive.fit(["a"], np.empty((0, 1)), np.empty(0))
    assert flat.score(np.zeros((2, 1))).tolist() == [0.5, 0.5]


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    got = quality_model.classify(docs, quality_model.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_classifier_scores_every_row(spark, sf):
    model = quality_model.train(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"))
    got = quality_model.classify(documents(spark), model).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
    assert quality_model.classify(documents(spark, []), model).count() == 0


def test_held_out_labels_are_never_learned_from(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    sample = common.labelled_sample(labels, "quality", 5, 0, 100_000).select("doc_id", common.crc_mod(F.col("doc_id"), 5).alias("fold")).collect()
    import zlib

    assert len(sample) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(5000))
    assert all(r.fold != 0 and zlib.crc32(str(r.doc_id).encode()) % 5 == r.fold for r in sample)
