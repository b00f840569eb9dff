import difflib
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scores, timecode
from tidemark.functions import text as T
from tidemark.operators import quality, search


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_timecodes(spark):
    assert value(spark, timecode.srt(F.lit(3661.5))) == "01:01:01,500"
    assert value(spark, timecode.seconds(F.lit("00:05:03.820"))) == pytest.approx(303.82)
    assert value(spark, timecode.ass(F.lit(3661.509))) == "1:01:01.51"
    assert value(spark, timecode.short(F.lit(75.25))) == "1:15.25"
    assert value(spark, timecode.on_frame(F.lit(2.5 / 30), 30)) == pytest.approx(2 / 30)


def test_scores(spark):
    t = lambda d: value(spark, scores.trapezoid(F.lit(float(d)), 18.0, 28.0, 38.0, 45.0))
    assert t(28) == t(38) == 1 and t(17.9) == t(45.1) == 0 and t(23) == pytest.approx(0.7)
    assert value(spark, scores.fit(F.lit(0.85), 0.85, 1.3)) == 1 and value(spark, scores.fit(F.lit(2.0), 0.85, 1.3)) == 0
    assert value(spark, scores.nearest_rank(F.array(*map(F.lit, range(1, 11))), 0.9)) == 10
    assert value(spark, scores.alpha(F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(5.0), F.lit(1.0))) == 0.5
    assert value(spark, scores.overlap(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0))) == 0


def test_text_functions(spark):
    assert value(spark, T.redact_credentials(F.lit("http://u:p@h:1"))) == "http://***@h:1"
    assert value(spark, T.slug(F.lit(" Al-Infitar: 6, 9! "))) == "al-infitar-6-9"
    assert value(spark, T.strip_article(F.lit("Ash-Shura"))) == "Shura"
    assert value(spark, T.strip_markup(F.lit("a<sup>1</sup> <b>b</b><script>x</script>"))) == "a b"
    assert value(spark, T.english_tokens(F.lit("The believers' gas, ALL-hearing"))) == ["the", "believer", "gas", "all", "hearing"]
    assert value(spark, T.skeleton(F.lit("banana"))) == "bnn" and value(spark, T.skeleton(F.lit("aeb"))) == "aeb"
    assert value(spark, T.first_object(F.lit('x {"a": {"b": 1}} y {'))) == '{"a": {"b": 1}}'
    assert value(spark, T.first_object(F.lit("none { here"))) is None


def test_arabic_forms(spark):
    letters = lambda x, keep=False: value(spark, T.arabic_letters(F.lit(x), keep))
    assert letters("ٱلرَّحْمَٰنِ") == "الرحمن" and letters("ٱلرَّحْمَٰنِ", True) == "الرحمان"
    assert letters("أَإِآٱ ىئ ةؤ ء xyz") == "اااا يي هو" and letters(None) == ""
    assert value(spark, T.arabic_tokens(F.lit("يَٰٓأَيُّهَا ٱلنَّاسُ"), True)) == ["يا", "ايها", "الناس"]
    assert value(spark, T.arabic_skeleton(F.lit("داوود"))) == "دد"
    decomposed, composed = "آ", "آ"
    assert spark.createDataFrame([(decomposed,)], "t string").select(T.nfc("t").alias("v")).first().v == composed


def test_split_even(spark):
    split = lambda text, n: value(spark, T.split_even(F.lit(text), n))
    assert split("a b, c d e f", 2) == ["a b,", "c d e f"]
    assert split("a b", 4) == ["a", "b", "", ""] and split("a b", 1) == ["a b"]
    rng = random.Random(1)
    for _ in range(12):
        words = [f"w{k}" + rng.choice(["", "", ",", ";"]) for k in range(rng.randrange(1, 25))]
        n = rng.randrange(2, 6)
        out = split(" ".join(words), n)
        assert len(out) == n and " ".join(x for x in out if x) == " ".join(words)
        assert len(words) <= n or all(out)


def enumerated(tokens, width):
    """The definition of balanced lines, by trying every break."""
    if not tokens:
        return []
    wide = lambda lines: max(len(" ".join(x)) for x in lines)
    greedy, line = [], []
    for t in tokens:
        if line and len(" ".join([*line, t])) > width:
            greedy.append(line)
            line = []
        line.append(t)
    n = len(greedy) + 1
    ways = [[tokens[a:b] for a, b in zip((0, *cuts), (*cuts, len(tokens)))] for cuts in itertools.combinations(range(1, len(tokens)), n - 1)]
    least = min(map(wide, ways))
    return [" ".join(x) for x in next(w for w in ways if wide(w) == least)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), max_size=9), st.integers(3, 20))
def test_balanced_wrap_equals_enumeration(tokens, width):
    assert T.balanced_lines(tokens, width) == enumerated(tokens, width)


def test_greedy_wrap(spark):
    assert value(spark, T.wrap_greedy(F.lit("aa bbb c ddddddd e"), 6)) == ["aa bbb", "c", "ddddddd", "e"]
    assert value(spark, T.wrap_greedy(F.lit("  "), 6)) == []


def test_similarity_is_not_edit_distance(spark):
    assert value(spark, T.similarity(F.lit("abcd"), F.lit("bcde"))) == difflib.SequenceMatcher(None, "abcd", "bcde").ratio()


def test_hopping_windows(spark):
    starts = lambda n: [x.start for x in value(spark, search.hopping(F.array(*(F.lit(str(k)) for k in range(n))))) or []]
    assert starts(12) == [0] and starts(13) == [0, 3] and starts(5) == [0] and starts(18) == [0, 3, 6]


def test_search_falls_back_only_without_an_exact_posting(spark):
    docs = spark.createDataFrame([(1, "banana split"), (2, "bonono cake"), (3, "cake cake cake")], "doc_id long, text string")
    texts = search.worded(docs, "doc_id", T.words)
    queries = spark.createDataFrame([(1, 0, "banana"), (2, 0, "benene"), (3, 0, "cake"), (4, 0, "zzz")], "query long, qi int, token string")
    hits, totals = search.matches(texts, queries, T.skeleton, 3)
    assert sorted((r["query"], r.doc) for r in hits.collect()) == [(1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (3, 3), (3, 3)]
    assert {r["query"]: round(r.total_w, 6) for r in totals.collect()}[4] == 1.0


def test_contiguity_counts_runs(spark):
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "jumps fox red")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, k, w) for k, w in enumerate(["red", "fox", "jumps"])], "query long, qi int, token string")
    got = search.ranked(*search.matches(search.worded(docs, "doc_id", T.words), queries, T.skeleton, 2), 5).orderBy("rank").collect()
    assert [r.doc for r in got] == [1, 2] and got[0].score - got[1].score == pytest.approx(2 * 1.2 / (3 * 0.693147), abs=1e-4)


def test_reconciliation_never_demotes(spark):
    told = lambda m, r: value(spark, quality.reconciled(F.lit(m).cast("boolean"), F.lit(r)))
    assert [told(None, True), told(True, True), told(False, False), told(True, False), told(False, True)] == ["unknown", "ok", "ok", "promote", "conflict"]
