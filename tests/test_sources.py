import glob

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import captions, config


def test_vtt(spark, tmp_path):
    (tmp_path / "a.vtt").write_text(
        "WEBVTT\n\n00:00:01.000 --> 00:00:03.000\nold line\none<00:00:01.500><c> two</c><00:00:02.000><c> three</c>\n\n"
        "00:00:03.000 --> 00:00:03.010\none two three\n\n00:00:01.002 --> 00:00:04.000\none four\n"
    )
    got = sorted((r.t, r.word) for r in captions.read_vtt(spark, str(tmp_path / "a.vtt")).collect())
    assert got == [(1.0, "one"), (1.002, "four"), (1.5, "two"), (2.0, "three")]


def test_flat_meta_round_trip(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("id: 'x1'\nwidth: 1920\nfps: 29.97\nok: true\nnone: null\n# note\nlist:\n  - a\n  inner: 3\n")
    got = {r.key: (r.kind, r.value) for r in captions.read_flat_meta(spark, str(tmp_path / "m.yaml")).collect()}
    assert got == {"id": ("string", "x1"), "width": ("int", "1920"), "fps": ("float", "29.97"), "ok": ("bool", "true"), "none": ("null", None), "list": ("null", None)}
    captions.write_flat_meta(spark.createDataFrame([("x", None, 3)], "id string, url string, zz int"), str(tmp_path / "out"), ["url", "id"])
    assert "".join(open(p).read() for p in glob.glob(f"{tmp_path}/out/part-*")).strip() == "url: null\nid: x\nzz: 3"


def test_env_and_transcripts(spark, tmp_path):
    (tmp_path / "e").write_text("# c\nexport A='x y'\nB=2\nB = 3\n")
    assert {r.key: r.value for r in captions.read_env(spark, str(tmp_path / "e")).collect()} == {"A": "x y", "B": "3"}
    (tmp_path / "t.json").write_text('{"words": [{"w": "a", "t0": 0.0, "t1": 1.0, "p": 1}, {"w": "b", "t0": 0.9, "t1": 3.0, "p": 1}, {"w": "c", "t0": 5.0, "t1": 6.0, "p": 1}]}')
    got = [(r.word, r.s, r.e) for r in captions.read_words(spark, str(tmp_path / "t.json"), 2.0, 5.0).collect()]
    assert got == [("b", 0.0, 1.0)]


def test_subtitles(spark, tmp_path):
    cards = spark.createDataFrame([("c1", 0.0, 1.5, "one"), ("c1", 2.0, 3.0, "two")], "clip string, s double, e double, text string")
    captions.write_srt(cards, str(tmp_path / "srt"))
    told = "".join(open(p).read() for p in glob.glob(f"{tmp_path}/srt/clip=c1/part-*"))
    assert told.split("\n\n")[0] == "1\n00:00:00,000 --> 00:00:01,500\none" and "2\n00:00:02,000" in told
    captions.write_ass(cards, str(tmp_path / "ass"))
    assert r"Dialogue: 0,0:00:00.00,0:00:01.50,Default,,0,0,0,,{\fad(200,200)}one" in "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/ass/part-*")))


def test_detections(spark):
    rows = spark.createDataFrame([(1, 'Sure:\n```json\n{"frames": [{"present": true, "confidence": 0.5}]}\n``` {'), (2, "no")], "id int, said string")
    got = captions.read_detections(rows, "said").collect()
    assert [(r.id, r.frame, r.detection.confidence) for r in got] == [(1, 0, 0.5)]


def test_closed_configuration(spark):
    schema = T.StructType().add("style", "string").add("trim", T.ArrayType(T.DoubleType()))
    rows = spark.createDataFrame([("a", '{"style": "bars"}'), ("b", '{"styel": "x"}'), ("c", "{}")], "name string, raw string")
    typed, odd = config.closed(rows, "raw", schema, {"style": "plain"})
    assert {r.name: r.style for r in typed.collect()} == {"a": "bars", "c": "plain"}
    assert [(r.name, r.key) for r in odd.collect()] == [("b", "styel")]
    over = spark.range(1).select(config.overlaid({"glow": "1", "snow": "0"}, F.create_map(F.lit("snow"), F.lit("1"))).alias("m")).first().m
    assert over == {"glow": "1", "snow": "1"}


def test_upserts_and_partitions(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, config.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    path = str(tmp_path / "p")
    config.write_partition(spark.createDataFrame([("x", 1), ("y", 2)], "style string, v int"), path, "style")
    config.write_partition(spark.createDataFrame([("y", 3)], "style string, v int"), path, "style")
    assert [r.v for r in config.read_partition(spark, path, "style", "x").collect()] == [1]
    assert [r.v for r in config.read_partition(spark, path, "style", "y").collect()] == [3]


def test_stale_and_key(spark):
    why = lambda a, b: spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(config.stale(F.col("a"), F.col("b")).alias("v")).first().v
    assert why(None, [0.0, 1.0]) == "no stamp" and why([0.0, None], [0.005, None]) is None
    assert why([0.0, 1.0], [0.5, 1.0]) == "start moved" and why([0.0, 1.0], [0.0, None]) == "end moved"
    assert len(spark.range(1).select(config.cache_key(F.lit("a"), F.lit("b")).alias("v")).first().v) == 8
