import json
import os
import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import reports as R
from tidemark.sources import cache


def test_cuts_follow_anchors_like_the_fold(spark):
    rng = random.Random(4)
    cuts, pairs, words, want = [], [], [], {}
    for clip in range(150):
        n, at = rng.randrange(3, 14), sorted(rng.sample(range(1, 30), rng.randrange(1, 4)))
        own = sorted(rng.sample(range(34), rng.randrange(6, 30)))
        there = sorted(rng.sample(range(n + 8), min(len(own), n + 8)))
        own = own[: len(there)]
        cuts += [(clip, i, c) for i, c in enumerate(at)]
        pairs += [(clip, a, min(b, n - 1)) for a, b in zip(own, there)]
        words.append((clip, n))
        out = []
        for i, c in enumerate(at):
            met = next(((a, min(b, n - 1)) for a, b in zip(own, there) if a >= c), None)
            if met is None or met[0] - c > 2 or n < len(at) + 1:
                out = None
                break
            out.append(min(max(met[1], out[-1] + 1 if out else 1), n - (len(at) - i)))
        want[clip] = out
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    got = {}
    for r in R.anchored_cuts(frame(cuts, "u long, i int, cut int"), frame(pairs, "u long, a int, b int"), frame(words, "u long, n int"), "u").orderBy("u", "i").collect():
        got.setdefault(r.u, []).append(r.anchor)
    assert {u: None if None in a else a for u, a in got.items()} == want
    assert sum(v is not None for v in want.values()) > 20 and None in want.values()


def test_findings_of_cuts(spark):
    rng = random.Random(3)
    cuts = [(rng.randrange(3), k, *(float(rng.randrange(-5, 100)) for _ in range(2)), 90.0) for k in range(60)] + [(0, 99, None, 4.0, 90.0)]
    phrases = [(rng.randrange(3), k, s, s + rng.randrange(0, 40)) for k in range(40) for s in [float(rng.randrange(90))]] + [(0, 99, None, 1.0)]
    want = Counter()
    known = [c for c in cuts if c[2] is not None]
    for u, c, s, e, length in known:
        want["order", c, None] += s >= e
        want["bounds", c, None] += s < 0 or e > length + 1e-6
        for v, p, a, b in phrases:
            want["phrase", c, p] += u == v and a is not None and s < b and a < e
    for u in range(3):
        own = sorted((s, e, c) for v, c, s, e, _ in known if u == v)
        for (_, a, c), (b, _, d) in zip(own, own[1:]):
            want["overlap", c, d] += b < a
    got = R.cut_findings(spark.createDataFrame(cuts, "u long, cut long, s double, e double, length double"), spark.createDataFrame(phrases, "u long, phrase long, ps double, pe double"), "u", 8.0)
    assert Counter((r.rule, r.cut, r.other) for r in got.collect()) == +want


def test_report_of_coverage(spark):
    said = ["a", "a", None, "b", None, None, None, None, "a", "c", None, None, None, None, None]
    place = {"a": 3, "b": 5, "c": 4, None: 0}
    rows = [(1, float(k), k, w, place[w], 0.4 if w == "b" else 0.8) for k, w in enumerate(said)] + [(2, 0.0, 1, None, 0, 0.0)]
    got = {r.u: r.asDict() for r in R.coverage_report(spark.createDataFrame(rows, "u long, t double, id long, label string, place int, conf double"), "u").collect()}
    one = got[1]
    assert (one["n_words"], one["segments"], one["unsure"], one["labels"], one["backward"], one["span"], one["stretches"]) == (15, 4, 1, 3, 1, 9.0, 2)
    assert abs(one["coverage"] - 5 / 15) < 1e-9 and abs(one["mean_conf"] - 0.7) < 1e-9
    assert (got[2]["n_words"], got[2]["segments"], got[2]["mean_conf"], got[2]["span"]) == (1, 0, None, None)


def test_quorum(spark):
    rows = [(1, 5), (1, 1), (1, 3), (1, 9), (2, 4), (2, None), (2, None), (3, 7), (3, None), (4, None)] + [(5, k % 3) for k in range(300)]
    got = {r.u: (r.hits, r.v) for r in R.quorum_medians(spark.createDataFrame(rows, "u long, v int"), "u", ["v"]).collect()}
    assert got == {1: (4, 5), 2: (1, None), 3: (1, 7), 4: (0, None), 5: (300, 1)}


def test_markers_in_all_nine_cases(spark):
    three = [True, False, None]
    rows = [(3 * i + j, a, at, b) for i, a in enumerate(three) for j, b in enumerate(three) for at in ["2024-01-02"]] + [(20, None, None, True), (21, False, " ", True)]
    frame = spark.createDataFrame(rows, "id int, record boolean, at string, seen boolean")
    got = {r.id: (r.m.value, r.m.at, r.m.action) for r in frame.select("id", R.marked(F.col("record"), F.col("at"), F.col("seen")).alias("m")).collect()}
    day = "2024-01-02"
    assert [got[k] for k in range(9)] == [(True, day, "ok"), (True, day, "conflict"), (True, day, "unseen"), (True, day, "promote"), (False, day, "ok"), (False, day, "unseen"), (True, day, "promote"), (False, "", "settle"), (None, day, "unseen")]
    assert got[20] == (True, "unknown", "promote") and got[21] == (True, "unknown", "promote")
    tags = spark.createDataFrame([(["x", "Green"],), (["Red", "Green"],), (["Red"],), (["x"],), ([],), (None,)], "tags array<string>")
    assert [r.m for r in tags.select(R.marker(F.col("tags"), ["Green"], ["Red"]).alias("m")).collect()] == [True, True, False, None, None, None]


def test_only_changed_files_are_read(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.txt").write_text(f"v{k}")
    parse = lambda content: F.to_json(F.struct(content.cast("string").alias("v")))

    def run():
        rows, read = cache.refreshed(spark, str(folder), store, parse)
        return {os.path.basename(r.path): json.loads(r.value)["v"] for r in rows.collect()}, sorted(os.path.basename(r.path) for r in read.collect())

    assert run() == ({"0.txt": "v0", "1.txt": "v1", "2.txt": "v2"}, ["0.txt", "1.txt", "2.txt"])
    assert run()[1] == []
    (folder / "1.txt").write_text("longer")
    assert run() == ({"0.txt": "v0", "1.txt": "longer", "2.txt": "v2"}, ["1.txt"])
    os.utime(folder / "2.txt", (1, 1))
    (folder / "0.txt").unlink()
    assert run() == ({"1.txt": "longer", "2.txt": "v2"}, ["2.txt"])
    torn = cache.entries(spark, store).withColumn("value", F.when(F.col("path").endswith("1.txt"), '{"v": ').otherwise(F.col("value")))
    torn.write.parquet(store + ".torn")
    assert cache.refreshed(spark, str(folder), store + ".torn", parse)[1].count() == 1
