from tidemark import catalogue
from tidemark.streaming import sessions as S


def test_sessions_of_a_stream_are_sessions_of_the_batch(spark, sf, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in/events.parquet")
    stream = S.sessions(S.read_events(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("found").select("user_id", "n", "total").collect()
    batch = catalogue.queries()["session_islands"](spark, sf)
    known = {(r.user_id, r.n, r.total) for r in batch.collect()}
    assert len(got) > 0.9 * batch.count() and all((r.user_id, r.n, r.total) in known for r in got)
