"""Caption cards: whether texts break into short lines, chunks that overlap, and where a caption goes beside a subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import sentences

# Fixed values.
CARD_WORDS, LINE_WORDS, ONE_LINE = 8, 4, 20
WIDE_CREDIT = 0.45
LOWEST, CHIN = 0.78, 0.45


def cards(words: Column, most: int = CARD_WORDS) -> Column:
    """The words of a verse in as few cards of at most `most` words as it takes, all but the last of one size."""
    n = F.size(words)
    size = F.ceil(n / F.ceil(n / F.lit(float(most)))).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, size), lambda i: F.slice(words, i + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def lines(card: Column) -> Column:
    """(over, widest, back) of a card's best break: whether a line has too many words, the wider line's characters, and the words of the first line, negated (0: one line).

    Few short words stay on one line, a word alone too. Otherwise a break that keeps both lines short comes first, then
    the narrower one, then the later one.
    """
    n, total = F.size(card), _width(card)

    def broken(k: Column) -> Column:
        over = (k > LINE_WORDS) | (n - k > LINE_WORDS)
        return F.struct(over.alias("over"), F.greatest(_width(F.slice(card, F.lit(1), k)), _width(F.slice(card, k + 1, n))).alias("widest"), (-k).alias("back"))

    whole = F.struct(F.lit(False).alias("over"), total.alias("widest"), F.lit(0).alias("back"))
    alone = (n == 1) | ((n <= LINE_WORDS) & (total <= ONE_LINE))
    return F.when(alone, whole).otherwise(F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), broken)))


def _width(words: Column) -> Column:
    return F.length(F.array_join(words, " "))


def fits(widest: Column, cap: Column) -> Column:
    """Whether all lines are within a cap; null where it isn't known."""
    return widest <= cap


def card_fit(docs: DataFrame, key: str, text: str, cap: Column) -> DataFrame:
    """(key, cards, fat, wide, unmeasured, score): how a text's verses break into cards.

    fat cards have too many words a line and count nothing, wide ones are over the cap and count in part; a card whose
    cap is unknown counts in full. A null text, or one without a word, has no card and a score of 0. Cards are rows, so a
    long text's are counted as they come.
    """
    verse = docs.select(key, cap.alias("__cap"), F.explode_outer(sentences(F.col(text))).alias("__words"))
    card = verse.select(key, "__cap", F.explode_outer(cards(F.col("__words"))).alias("__card"))
    cut = card.select(key, "__cap", F.when(F.size("__card") > 0, lines(F.col("__card"))).alias("__cut"))
    fit, over = fits(F.col("__cut.widest"), F.col("__cap")), F.col("__cut.over")
    counted = cut.groupBy(key).agg(F.count("__cut").alias("cards"), F.count_if(over).alias("fat"), F.count_if(~over & ~fit).alias("wide"), F.count_if(~over & fit.isNull()).alias("unmeasured"))
    score = (F.col("cards") - F.col("fat") - F.col("wide") + WIDE_CREDIT * F.col("wide")) / F.col("cards")
    return counted.withColumn("score", F.when(F.col("cards") > 0, score).otherwise(0.0))


def chunked(points: DataFrame, clip: str, at: str, size: float, overlap: float) -> DataFrame:
    """(clip, chunk, s, e, n): windows of one size over each clip, each beginning `overlap` before the last one's end, until one reaches the clip's end; n points lie in [s, e), or at the clip's end.

    A point goes to the chunks that its time says, so nothing is joined by range; chunks without a point are there too.
    Points without a time count nowhere.
    """
    hop = size - overlap
    timed = points.where(F.col(at).isNotNull())
    span = timed.groupBy(clip).agg(F.min(at).alias("__from"), F.max(at).alias("__to"))
    last = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("__to") - F.col("__from") - size) / hop))
    reach = span.withColumn("__last", last)
    every = reach.select(clip, "__from", "__to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last"))).alias("chunk"))
    since = F.col(at) - F.col("__from")
    first = F.greatest(F.lit(0).cast("long"), F.floor((since - size) / hop) + 1)
    in_chunks = F.sequence(F.least(first, F.col("__last")), F.least(F.floor(since / hop), F.col("__last")))
    counts = timed.join(reach, clip).select(clip, F.explode(in_chunks).alias("chunk")).groupBy(clip, "chunk").agg(F.count("*").alias("n"))
    begin = F.col("__from") + F.col("chunk") * hop
    out = every.join(counts, [clip, "chunk"], "left")
    return out.select(clip, "chunk", begin.alias("s"), F.least(begin + size, F.col("__to")).alias("e"), F.coalesce("n", F.lit(0)).alias("n"))


def _half(x: Column) -> Column:
    return F.floor(x / 2)


def upright_window(width: Column, height: Column, cx: Column, across: int = 1080, down: int = 1920) -> Column:
    """(x, w): the window of full height around a subject's centre, or the middle without one, kept inside the frame."""
    w = _half(F.floor(height * across / F.lit(float(down)))) * 2
    return F.struct(F.greatest(F.lit(0).cast("long"), F.least(width - w, F.coalesce(cx, _half(width)) - _half(w))).alias("x"), w.alias("w"))


def caption_place(width: Column, height: Column, upright: Column, cx: Column, w: Column, h: Column, bottom: Column) -> Column:
    """(x_offset, top): upright, a caption stands in the middle under the subject's chin, not below LOWEST; else in the middle of the wider free side, the left one where they are equal or nothing was seen. top is null where the caption is centred."""
    left = F.coalesce(cx - _half(w), _half(width))
    right = F.coalesce(width - cx - _half(w), _half(width))
    middle = F.when(right > left, width - _half(right)).otherwise(_half(left))
    top = F.when(upright & cx.isNotNull(), F.least(F.floor(height * LOWEST), bottom + F.floor(h * CHIN)))
    return F.struct(F.when(upright, F.lit(0).cast("long")).otherwise(middle - _half(width)).alias("x_offset"), top.alias("top"))
