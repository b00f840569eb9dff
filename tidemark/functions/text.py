"""Text functions as Spark columns."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Combining marks and annotation signs that carry no letter.
ARABIC_MARKS = "[\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u06D6-\\u06ED\\u0640\\u08D3-\\u08FF]"
NOT_ARABIC_LETTER = "[^\\u0621-\\u063A\\u0641-\\u064A\\u0671-\\u06D5]+"
#: Letters and what they fold to; the last one folds to nothing.
FOLD_FROM = "آأإٱٲٳٵىئةؤۆۇکیھء"
FOLD_TO = "اااااااييهوووكيه"
LONG_A, WEAK_ARABIC, VOCATIVE = "ٰ", "اويه", "يا"
WEAK_LATIN = "aeiouy"


def words(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def normalized(text: Column) -> Column:
    """The words of a text, joined by single blanks."""
    return F.array_join(words(text), " ")


def without(word: Column, letters: str) -> Column:
    """A word without some letters, or the word itself where fewer than two would be left."""
    short = F.translate(word, letters, "")
    return F.when(F.length(short) >= 2, short).otherwise(word)


def skeleton(word: Column) -> Column:
    """Coarse key of a Latin word: without vowels."""
    return without(word, WEAK_LATIN)


def arabic_letters(text: Column, keep_long_a: bool = False) -> Column:
    """Bare letters of an Arabic text, for matching only: marks dropped, variants of a letter folded, all else a blank. Null: empty."""
    t = F.coalesce(text, F.lit(""))
    t = F.replace(t, F.lit(LONG_A), F.lit("ا")) if keep_long_a else t
    t = F.translate(F.regexp_replace(t, ARABIC_MARKS, ""), FOLD_FROM, FOLD_TO)
    return F.trim(F.regexp_replace(t, NOT_ARABIC_LETTER, " "))


def arabic_tokens(text: Column, keep_long_a: bool = False) -> Column:
    """Tokens of the bare letters; a vocative prefix joined to a word of five letters or more is a token of its own."""
    split = F.filter(F.split(arabic_letters(text, keep_long_a), " "), lambda w: w != "")
    cut = F.transform(split, lambda w: F.when(w.startswith(VOCATIVE) & (F.length(w) >= 5), F.array(F.lit(VOCATIVE), F.substring(w, 3, 10_000))).otherwise(F.array(w)))
    return F.flatten(cut)


def arabic_skeleton(word: Column) -> Column:
    return without(word, WEAK_ARABIC)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, which no edit distance gives."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def english_tokens(text: Column) -> Column:
    """Lower-cased words of letters, a final s off those of more than four."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0), lambda w: F.when((F.length(w) > 4) & w.endswith("s"), F.regexp_replace(w, "s$", "")).otherwise(w))


def slug(text: Column) -> Column:
    """Lower-cased, runs of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def redact_credentials(text: Column) -> Column:
    return F.regexp_replace(text, "(https?://)[^@/\\s]+@", "$1***@")


def strip_article(name: Column) -> Column:
    """A transliterated name without its leading article."""
    return F.regexp_replace(name, "^(?i)(adh|ash|al|an|ar|as|at|az|ad)-", "")


def strip_markup(html: Column) -> Column:
    """Text of a markup fragment: scripts, styles, comments and superscripts dropped with their content, tags as blanks, blanks collapsed."""
    t = F.regexp_replace(html, "(?s)<script.*?</script>|<style.*?</style>|<sup.*?</sup>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), "\\s+", " "))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#:]+)", 1)


def split_even(text: Column, n: int) -> Column:
    """n chunks of about equally many words, cut where a comma or semicolon ends a word within three of the even place. Fewer words than chunks: the words, then empty chunks."""
    if n <= 1:
        return F.array(text)
    return F.transform(F.array(F.split(F.trim(text), "\\s+")), lambda w: _cut_even(w, n))[0]  # the words are split once


def _cut_even(w: Column, n: int) -> Column:
    size = F.size(w)

    def cut(state: Column, k: Column) -> Column:
        target = F.bround(size / F.lit(float(n)) * k).cast("int")
        tries = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda o: F.array(target + o, target - o)))
        stops = F.filter(tries, lambda c: (c > 0) & (c < size) & F.coalesce(F.get(w, c - 1).rlike("[,;]$"), F.lit(False)))
        best = F.coalesce(F.get(stops, F.lit(0)), target)
        at = F.greatest(state["start"] + 1, F.least(best, size - (n - F.size(state["chunks"]) - 1)))
        chunk = F.array_join(F.slice(w, state["start"] + 1, at - state["start"]), " ")
        return F.struct(F.concat(state["chunks"], F.array(chunk)).alias("chunks"), at.alias("start"))

    start = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit(0).alias("start"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), start, cut, lambda s: F.concat(s["chunks"], F.array(F.array_join(F.slice(w, s["start"] + 1, size), " "))))
    return F.when(size <= n, F.concat(w, F.array_repeat(F.lit(""), F.lit(n) - size))).otherwise(folded)


def wrap_greedy(text: Column, width: int) -> Column:
    """Lines of at most `width` characters, each taking words while they fit; a longer word is a line of its own."""
    w = F.filter(F.split(F.trim(text), "\\s+"), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def add(s: Column, x: Column) -> Column:
        fits = F.length(s["line"]) + 1 + F.length(x) <= width
        return (
            F.when(s["line"] == "", F.struct(s["lines"].alias("lines"), x.alias("line")))
            .when(fits, F.struct(s["lines"].alias("lines"), F.concat(s["line"], F.lit(" "), x).alias("line")))
            .otherwise(F.struct(F.concat(s["lines"], F.array(s["line"])).alias("lines"), x.alias("line")))
        )

    return F.aggregate(w, start, add, lambda s: F.when(s["line"] == "", s["lines"]).otherwise(F.concat(s["lines"], F.array(s["line"]))))


def balanced_lines(tokens: list[str], width: int) -> list[str]:
    """As few lines as greedy wrapping needs, their widest as narrow as can be, then each break as early as can be."""
    if not tokens:
        return []
    n = len(tokens)
    before = [0]
    for t in tokens:
        before.append(before[-1] + len(t) + 1)
    wide = lambda i, j: before[j] - before[i] - 1  # noqa: E731  of the words i to j - 1 on a line
    count, i = 0, 0
    while i < n:
        j = i + 1
        while j < n and wide(i, j + 1) <= width:
            j += 1
        count, i = count + 1, j
    least = [[float("inf")] * (n + 1) for _ in range(count + 1)]
    least[0][n] = 0
    for k in range(1, count + 1):
        for i in range(n - 1, -1, -1):
            least[k][i] = min(max(wide(i, j), least[k - 1][j]) for j in range(i + 1, n + 1))
    lines, i = [], 0
    for k in range(count, 0, -1):
        j = next(j for j in range(i + 1, n + 1) if max(wide(i, j), least[k - 1][j]) <= max(least[count][0], 0))
        lines.append(" ".join(tokens[i:j]))
        i = j
    return lines


@F.pandas_udf(T.ArrayType(T.StringType()))
def wrap_balanced(text: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([balanced_lines((x or "").split(), int(w)) for x, w in zip(text, width)])


@F.pandas_udf(T.StringType())
def first_object(text: pd.Series) -> pd.Series:
    """The first balanced {...} of a noisy text, by counting braces; null if none closes."""

    def find(x: str | None) -> str | None:
        start = (x or "").find("{")
        depth = 0
        for k in range(start, len(x or "")) if start >= 0 else ():
            depth += (x[k] == "{") - (x[k] == "}")
            if not depth:
                return x[start : k + 1]
        return None

    return text.map(find)
