"""Caption and metadata files as tables, and tables as caption files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, timecode

STAMP = r"([0-9]+:[0-9]{2}:[0-9]{2}\.[0-9]{3})"


def read_vtt(spark: SparkSession, path: str, shortest: float = 0.05) -> DataFrame:
    """(file, t, word) of WebVTT files: of each cue the last line, its words timed by the stamps inside it, else by the cue.

    Cues shorter than `shortest` only repeat the screen and are left out. A word counts once for a time
    rounded to hundredths, at its earliest exact time.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    blocks = files.select("file", F.explode(F.split("value", r"\n\s*\n")).alias("block"))
    head = STAMP + r"\s+-->\s+" + STAMP
    cues = blocks.where(F.col("block").rlike(head)).select(
        "file",
        timecode.seconds(F.regexp_extract("block", head, 1)).alias("s"),
        timecode.seconds(F.regexp_extract("block", head, 2)).alias("e"),
        F.try_element_at(F.filter(F.split(F.regexp_replace("block", "(?s)^.*?-->[^\n]*\n?", ""), "\n"), lambda x: F.trim(x) != ""), F.lit(-1)).alias("line"),
    )
    timed = cues.where((F.col("e") - F.col("s") >= shortest) & F.col("line").isNotNull())
    # Put the cue's own start before the line, then cut it at stamps: each piece starts with its time.
    marked = F.concat(F.lit("<"), timecode.stamp(F.col("s")), F.lit(">"), "line")
    pieces = F.filter(F.split(marked, "<(?=[0-9]+:)"), lambda x: x != "")
    words = timed.select("file", F.explode(pieces).alias("piece")).select(
        "file",
        timecode.seconds(F.regexp_extract("piece", "^" + STAMP, 1)).alias("t"),
        F.explode(F.filter(F.split(F.regexp_replace("piece", f"^{STAMP}>|<[^>]*>", " "), r"\s+"), lambda w: w != "")).alias("word"),
    )
    return words.groupBy("file", F.round("t", 2).alias("at"), "word").agg(F.min("t").alias("t")).select("file", "t", "word")


def scalar(value: Column) -> Column:
    """A flat metadata value with its kind: (kind, value), kind one of bool, null, int, float, string."""
    v = F.trim(value)
    bare = F.regexp_replace(v, "^(['\"])(.*)\\1$", "$2")
    kind = (
        F.when(F.lower(v).isin("true", "false"), "bool")
        .when(F.lower(v).isin("null", "~", ""), "null")
        .when(v.rlike("^[+-]?[0-9]+$"), "int")
        .when(v.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "float")
        .otherwise("string")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "null", F.lit(None)).when(kind == "bool", F.lower(v)).otherwise(bare).alias("value"))


def read_flat_meta(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, kind, value) of flat `key: value` files; indented lines, comments and lists under a key are left out."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    pattern = r"^([A-Za-z_][A-Za-z0-9_]*):(?:\s+(.*?))?\s*$"
    kept = lines.where(F.col("value").rlike(pattern) & ~F.col("value").rlike(r"^\s|^#"))
    parsed = kept.select("file", F.regexp_extract("value", pattern, 1).alias("key"), scalar(F.regexp_extract("value", pattern, 2)).alias("x"))
    return parsed.select("file", "key", "x.kind", "x.value")


def write_flat_meta(rows: DataFrame, path: str, columns: list[str]) -> None:
    """One text of `key: value` lines a row, in a fixed order of columns, null as null; then the columns that are not listed, by name."""
    order = [c for c in columns if c in rows.columns] + sorted(set(rows.columns) - set(columns))
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in order]
    rows.select(F.concat_ws("\n", *lines).alias("value")).write.mode("overwrite").text(path)


def write_srt(cards: DataFrame, path: str, clip: str = "clip") -> None:
    """SubRip cues of cards (clip, s, e, text), numbered and in order within a clip, in a folder a clip."""
    order = Window.partitionBy(clip).orderBy("s", "e")
    cue = F.concat_ws("\n", F.row_number().over(order).cast("string"), F.concat(timecode.srt(F.col("s")), F.lit(" --> "), timecode.srt(F.col("e"))), F.col("text"), F.lit(""))
    numbered = cards.select(clip, "s", "e", cue.alias("value"))
    # Rows of a clip are in one task and in order after the window; only the cue is written.
    numbered.repartition(clip).sortWithinPartitions(clip, "s", "e").select(clip, "value").write.mode("overwrite").partitionBy(clip).text(path)


def write_ass(cards: DataFrame, path: str, fade_ms: int = 200, style: str = "Default") -> None:
    """Event lines of cards (s, e, text); a fade takes at most half of its card."""
    fade = F.least(F.lit(fade_ms), F.floor((F.col("e") - F.col("s")) * 500)).cast("string")
    line = F.concat(F.lit("Dialogue: 0,"), timecode.ass(F.col("s")), F.lit(","), timecode.ass(F.col("e")), F.lit(f",{style},,0,0,0,,{{\\fad("), fade, F.lit(","), fade, F.lit(")}"), "text")
    cards.orderBy("s", "e").select(line.alias("value")).write.mode("overwrite").text(path)


#: Detections of a frame, as a model returns them.
DETECTIONS = "frames array<struct<present: boolean, confidence: double, facing: string, boxes: array<struct<x: double, y: double, w: double, h: double>>>>"


def read_detections(rows: DataFrame, column: str) -> DataFrame:
    """(…, frame, detection) of a column of noisy model output: the first object in it, fences or not, typed; what doesn't parse is a miss and gives no row."""
    from ..functions.text import first_object

    parsed = rows.withColumn("__o", F.from_json(first_object(column), DETECTIONS, {"mode": "PERMISSIVE"}))
    return parsed.select(*rows.columns, F.posexplode("__o.frames").alias("frame", "detection"))


def read_words(spark: SparkSession, path: str, start: float = 0.0, end: float | None = None) -> DataFrame:
    """(file, word, s, e) of transcripts that overlap [start, end), shifted to its start and clamped there; without an end, open."""
    schema = "words array<struct<w: string, t0: double, t1: double, p: double>>, backend string, model string"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.input_file_name().alias("file"), F.explode("words").alias("x"))
    inside = rows.where((F.col("x.t1") > start) & (F.lit(True) if end is None else F.col("x.t0") < end))
    return inside.select("file", F.col("x.w").alias("word"), F.greatest(F.lit(0.0), F.col("x.t0") - start).alias("s"), F.greatest(F.lit(0.0), F.col("x.t1") - start).alias("e"))


def read_env(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of `KEY=value` lines, with or without export and quotes; comments are left out, and the last of a key counts."""
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where(F.col("line").rlike(pattern) & ~F.col("line").rlike(r"^\s*#"))
    value = F.regexp_replace(F.regexp_extract("line", pattern, 2), "^(['\"])(.*)\\1$", "$2")
    return lines.groupBy(F.regexp_extract("line", pattern, 1).alias("key")).agg(F.max_by(value, "at").alias("value"))


CHAPTERS = "array<struct<number:int,name:string,englishName:string,ayahs:array<struct<numberInSurah:int,text:string>>>>"


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """(file, chapter, name, local_name, verse, text, words) of editions: JSON files that nest verses in chapters under data.surahs.

    A chapter without an English name takes its own; one without verses, and a file without chapters, has no row. words
    are the verse's letters without marks, as searched for.
    """
    files = spark.read.schema(f"data struct<surahs:{CHAPTERS}>").json(path, multiLine=True)
    chapters = files.select(F.input_file_name().alias("file"), F.explode("data.surahs").alias("c"))
    verses = chapters.select("file", F.col("c.number").alias("chapter"), F.coalesce("c.englishName", "c.name").alias("name"), F.col("c.name").alias("local_name"), F.explode("c.ayahs").alias("v"))
    return verses.select("file", "chapter", "name", "local_name", F.col("v.numberInSurah").alias("verse"), F.col("v.text").alias("text"), text.arabic_tokens(F.col("v.text")).alias("words"))
