import colorsys

from pyspark.sql import functions as F

from tidemark.functions import style as Y
from tidemark.operators import naming as N


def values(spark, kinds, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, kinds).select(*columns).collect()]


def test_colours_like_a_hue_round_trip(spark):
    lift, keep = 0.179, 0.9
    codes = [f"#{(k * 99_991) % 2**24:06x}" for k in range(400)] + ["000000", "#ffffff", "#808080", "##FF0000", "#12", "xyzxyz", None]
    got = values(spark, "c string", [(c,) for c in codes], Y.rgb(F.col("c")).alias("a"), Y.drawn_before(Y.rgb(F.col("c")), lift, keep).alias("b"))
    for code, (seen, drawn) in zip(codes[:-3], got):
        digits = code.lstrip("#")
        assert tuple(seen) == tuple(int(digits[k : k + 2], 16) for k in (0, 2, 4))
        h, l, s = colorsys.rgb_to_hls(*(v / 255 for v in seen))
        want = [v * 255 for v in colorsys.hls_to_rgb(h, max(0.0, 1 - (1 - l) / (1 - lift)), min(1.0, s / keep))]
        assert all(abs(g - w) <= 0.5 + 1e-6 for g, w in zip(drawn, want)), code
    assert got[-3:] == [(None, None)] * 3


def test_settings_and_names(spark):
    assert [r[0] for r in values(spark, "v string", [(None,), ("ON",), (" true",), ("1",), ("2",), ("0",), ("no",), ("",)], Y.switched_on(F.col("v")))] == [True, True, True, True, True, False, False, False]
    assert values(spark, "v string, k string", [("7", "int"), ("5", "int"), ("0.12345", "float"), ("true", "bool"), (None, "int"), ("x", "int")], Y.scaled(F.col("v"), F.col("k"), 0.5)) == [("4",), ("2",), ("0.0617",), ("true",), (None,), (None,)]
    assert values(spark, "v string", [("7",), ("8",), ("-3",), ("x",), (None,)], Y.made_even(F.col("v"))) == [("6",), ("8",), ("-4",), ("x",), (None,)]
    assert values(spark, "a string, b string, c string", [("one", "two", "lines"), ("one", "two", None), ("one", "", "x"), (None, None, None)], Y.caption(F.col("a"), F.col("b"), F.col("c"))) == [("two lines",), ("two",), ("one",), ("",)]
    assert values(spark, "a string", [("Al Name!",), (None,)], Y.derived_name(F.col("a"), F.lit("CH"), F.lit(1), F.lit(4))) == [("AL-NAME-CH-1-4.mp4",), ("UNKNOWN-CH-1-4.mp4",)]
    got = values(spark, "a string, b string", [(" h:1 , , https://u:p@k ", None), (None, "z")], Y.endpoints([("a", F.col("a")), ("b", F.col("b"))]))
    assert [[tuple(e) for e in r[0]] for r in got] == [[("a", "http://h:1", "a http://h:1"), ("a", "https://u:p@k", "a k")], [("b", "http://z", "b http://z")]]


def test_small_rules(spark):
    assert values(spark, "a int, d int", [(900, 1000), (1000, 1001), (2000, 1001), (5, 0), (5, None), (None, 9)], Y.cover_at(F.col("a"), F.col("d"))) == [(900,), (1000,), (500,), (5,), (5,), (None,)]
    assert values(spark, "a double, b double", [(1.0, 2.0), (1.0, 9.0), (None, 1.0)], F.when(F.col("a").isNotNull(), Y.inside_gap(F.col("a"), F.col("b")))) == [(1.5,), (1.75,), (None,)]
    assert values(spark, "a long, d double", [(100_000, 0.1), (99_999, 5.0), (200_000, 0.0), (200_000, None), (None, 1.0)], Y.is_usable(F.col("a"), F.col("d"))) == [(True,), (False,), (False,), (False,), (False,)]
    assert values(spark, "c int", [(540,), (100,), (0,), (1040,)], Y.most_chars(F.col("c"), F.lit(1080), F.lit(64), F.lit(40))) == [(74,), (10,), (10,), (10,)]
    assert values(spark, "v long", [(1204,), (None,)], Y.arabic_digits(F.col("v"))) == [("١٢٠٤",), (None,)]


def test_names_are_resolved(spark):
    frame = spark.createDataFrame
    clips = frame([("b", "X-1.mp4"), ("a", "X-1.mp4"), ("c", "Y-2.mp4"), ("c", "Y-2.mp4"), ("d", "Z-3.mp4")], "clip string, derived string")
    files = frame([("X-1.mp4",), ("x-1.MP4",), ("Y-2.mp4",), ("Y-2.mp4",), ("lone.mp4",)], "file string")
    asked = frame([(1, "c"), (2, "d"), (3, "x-1"), (4, "Y-2.MP4"), (5, "LONE"), (6, "z-3"), (7, None), (8, "")], "id int, arg string")
    got = {r.id: (r.clip, r.file) for r in N.resolved(asked, clips, files).collect()}
    assert got == {1: ("c", "Y-2.mp4"), 2: ("d", None), 3: ("a", "X-1.mp4"), 4: ("c", "Y-2.mp4"), 5: (None, "lone.mp4"), 6: (None, None), 7: (None, None), 8: (None, None)}


def test_upper_median_and_anchor(spark):
    rows = [(1, v) for v in (4.0, 1.0, 4.0, 9.0)] + [(2, 7.0), (3, None)]
    got = {r.k: (r.median, r.n) for r in N.upper_median(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    assert got == {1: (4.0, 4), 2: (7.0, 1)}
    blocks = spark.createDataFrame([(1, 900.0, 1000.0), (1, 900.0, 1040.0), (2, 10.0, None)], "k int, top double, bottom double")
    assert [tuple(r) for r in N.centred_blocks(blocks, "k", 1000, 0.5).collect()] == [(1, 0.03, 0.48, 0.5)]


def test_a_channel_beside_a_half_rounds_as_the_sql_does(spark):
    """Lightness and chroma of #49fa0e put a channel at 52.5 less a last bit: the order of the products decides."""
    assert [tuple(r) for (r,) in values(spark, "c string", [("#49fa0e",)], Y.drawn_before(Y.rgb(F.col("c")), 0.18, 0.9))] == [(52, 210, 0)]
