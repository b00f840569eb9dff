"""Statistics of a text as Spark columns: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

BLANKS = r"[\x20\x09-\x0D]+"
#: The characters that count as symbols.
SYMBOLS = r"#*$%&|<>"
WINDOW = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_chars", "n_upper", "n_digits", "n_exclaim", "n_punct"]


def let(value: Column, body) -> Column:
    """body applied to value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def chars_in(text: Column, kind: str) -> Column:
    """How many characters of the text are in a class."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def covered(hashes: Column, size: int) -> Column:
    """Positions covered by the windows of `size` whose hash occurs twice or more."""

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(
        ordered,
        lambda s: F.aggregate(
            starts(s),
            F.struct(F.lit(0).alias("total"), F.lit(-size).alias("last")),
            lambda a, i: F.struct((a["total"] + F.least(F.lit(size), i - a["last"])).alias("total"), i.alias("last")),
            lambda a: a["total"],
        ),
    )


def repeated_words(h: Column, size: int = WINDOW) -> Column:
    """Words in windows of `size` words that the text holds twice or more, from the words' hashes."""
    windows = F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda i: F.xxhash64(F.slice(h, i, size)))
    found = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w, size)))
    return F.when(F.size(h) <= size, F.lit(0)).otherwise(found)


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the columns COUNTS of their whole text, all long; a null text counts as empty. Columns of these names are replaced."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hashed = F.transform(words_of(t), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_word = let(hashed, lambda h: F.struct(F.size(h).alias("n_words"), F.size(F.array_distinct(h)).alias("n_distinct"), repeated_words(h).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    plain = {
        "word_chars": F.length(F.regexp_replace(t, BLANKS, "")),
        "n_symbols": chars_in(t, SYMBOLS),
        "n_chars": F.length(t),
        "n_upper": chars_in(t, "A-ZÀ-ÖØ-Þ"),
        "n_digits": chars_in(t, "0-9"),
        "n_exclaim": chars_in(t, "!"),
        "n_punct": chars_in(t, ".,;:!?"),
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in COUNTS]
    by, of = fresh([*docs.columns, *COUNTS], "by_word", "by_line")
    got = docs.select(*kept, by_word.alias(by), by_line.alias(of), *(v.cast("long").alias(k) for k, v in plain.items()))
    nested = {k: F.col(by)[k] for k in ("n_words", "n_distinct", "n_repeat_words")} | {k: F.col(of)[k] for k in ("n_lines", "n_dup_lines")}
    return got.select(*kept, *((nested[k].cast("long").alias(k) if k in nested else F.col(k)) for k in COUNTS))


def ratios() -> dict[str, Column]:
    """Features of a text that don't depend on its length, and its length in words, from the columns COUNTS."""
    words, chars, lines = (F.greatest(F.col(k), F.lit(1)).cast("double") for k in ("n_words", "n_chars", "n_lines"))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct") / words,
        "words_per_line": F.col("n_words") / lines,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "exclaim_per_word": F.col("n_exclaim") / words,
        "punct_per_word": F.col("n_punct") / words,
    }
