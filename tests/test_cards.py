import json
import math
import random

from pyspark.sql import functions as F

from tidemark.operators import cards as C
from tidemark.sources import captions


def best_break(words):
    """The rule by enumeration: (too many words a line, wider line, words of the first line)."""
    if len(words) == 1 or (len(words) <= 4 and len(" ".join(words)) <= 20):
        return False, len(" ".join(words)), 0
    tries = [(max(k, len(words) - k) > 4, max(len(" ".join(words[:k])), len(" ".join(words[k:]))), -k) for k in range(1, len(words))]
    over, widest, back = min(tries)
    return over, widest, -back


def test_lines_equal_enumeration(spark):
    rng = random.Random(3)
    given = [["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 9))] for _ in range(80)]
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(given)], "k int, w array<string>").select("k", C.lines(F.col("w")).alias("b")).collect()
    assert {r["k"]: (r["b"]["over"], r["b"]["widest"], -r["b"]["back"]) for r in rows} == {k: best_break(w) for k, w in enumerate(given)}


def test_cards_are_even_and_whole(spark):
    given = [[str(i) for i in range(n)] for n in (0, 1, 8, 9, 17, 40)]
    rows = spark.createDataFrame([(w,) for w in given], "w array<string>").select("w", C.cards(F.col("w")).alias("c")).collect()
    for r in rows:
        assert [x for c in r["c"] for x in c] == r["w"] and all(0 < len(c) <= 8 for c in r["c"])
        assert len(r["c"]) == (math.ceil(len(r["w"]) / math.ceil(len(r["w"]) / math.ceil(len(r["w"]) / 8))) if r["w"] else 0)


def test_fit_of_null_empty_unmeasured_and_repeated_texts(spark):
    docs = [(1, None, 9), (2, " .. ", 9), (3, "one two", None), (4, "one two", 5), (4, "one two", 5), (5, "aa bb cc dd ee ff gg hh", 99), (6, "one two", 9)]
    rows = C.card_fit(spark.createDataFrame(docs, "id int, text string, cap int"), "id", "text", F.col("cap")).collect()
    got = {r["id"]: (r["cards"], r["fat"], r["wide"], r["unmeasured"], round(r["score"], 6)) for r in rows}
    assert got == {1: (0, 0, 0, 0, 0.0), 2: (0, 0, 0, 0, 0.0), 3: (1, 0, 0, 1, 1.0), 4: (2, 0, 2, 0, 0.45), 5: (1, 0, 0, 0, 1.0), 6: (1, 0, 0, 0, 1.0)}
    assert C.card_fit(spark.createDataFrame([], "id int, text string, cap int"), "id", "text", F.col("cap")).count() == 0


def test_chunks_of_a_hot_clip_an_instant_and_times_unknown(spark):
    points = [(1, float(t)) for t in range(0, 100)] + [(2, 7.0), (2, None), (3, None), (4, 0.0), (4, 25.0), (5, 0.0), (5, 26.0)]
    rows = C.chunked(spark.createDataFrame(points, "clip int, t double"), "clip", "t", 25.0, 3.0).orderBy("clip", "chunk").collect()
    got = {}
    for r in rows:
        got.setdefault(r["clip"], []).append((r["s"], r["e"], r["n"]))
    assert got[1] == [(0.0, 25.0, 25), (22.0, 47.0, 25), (44.0, 69.0, 25), (66.0, 91.0, 25), (88.0, 99.0, 12)]
    assert got[2] == [(7.0, 7.0, 1)] and 3 not in got
    assert got[4] == [(0.0, 25.0, 2)]
    assert got[5] == [(0.0, 25.0, 1), (22.0, 26.0, 1)]


def test_places_beside_a_subject(spark):
    shots = [(False, 1500, 200, 300, 400), (False, 300, 200, 300, 400), (False, None, None, None, None), (True, 300, 200, 300, 400), (True, 900, 200, 300, 1000), (True, None, None, None, None)]
    rows = spark.createDataFrame(shots, "upright boolean, cx long, w long, h long, bottom long")
    w, h = F.lit(1920).cast("long"), F.lit(1080).cast("long")
    place = C.caption_place(w, h, F.col("upright"), F.col("cx"), F.col("w"), F.col("h"), F.col("bottom"))
    got = rows.select(place.alias("p"), C.upright_window(w, h, F.col("cx")).alias("c")).collect()
    assert [tuple(r["p"]) for r in got] == [(-260, None), (200, None), (-480, None), (0, 535), (0, 842), (0, None)]
    assert [tuple(r["c"]) for r in got] == [(1197, 606), (0, 606), (657, 606), (0, 606), (597, 606), (657, 606)]


def test_chapters_flattened(spark, tmp_path):
    verses = [{"numberInSurah": 1, "text": "قَالَ رَبِّ"}, {"numberInSurah": 2, "text": "هُوَ"}]
    nested = {"data": {"surahs": [{"number": 1, "name": "أ", "englishName": "First", "ayahs": verses}, {"number": 2, "name": "ب", "ayahs": verses[:1]}, {"number": 3, "name": "ج", "ayahs": []}]}}
    (tmp_path / "edition.json").write_text(json.dumps(nested, indent=1))
    (tmp_path / "other.json").write_text('{"data": {}}')
    rows = captions.read_chapters(spark, str(tmp_path)).orderBy("chapter", "verse").collect()
    assert [(r["chapter"], r["name"], r["local_name"], r["verse"]) for r in rows] == [(1, "First", "أ", 1), (1, "First", "أ", 2), (2, "ب", "ب", 1)]
    assert rows[0]["text"] == "قَالَ رَبِّ" and rows[0]["words"] == ["قال", "رب"] and rows[1]["words"] == ["هو"]
