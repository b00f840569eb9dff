"""Sizes, colours, switches and names of a rendering configuration as Spark columns. A null gives a null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LATIN_DIGITS, ARABIC_DIGITS = "0123456789", "٠١٢٣٤٥٦٧٨٩"
TRUE_WORDS = ("1", "true", "yes", "on")
LEAST_CHARS, LEAST_BYTES, GAP_CAP = 10, 100_000, 0.75


def arabic_digits(number: Column) -> Column:
    """A whole number in Arabic-Indic digits."""
    return F.translate(number.cast("string"), LATIN_DIGITS, ARABIC_DIGITS)


def switched_on(value: Column, default: bool = True) -> Column:
    """Whether a setting written as a word or number is on; a missing one takes the default, an unknown word is off."""
    word = F.lower(F.trim(value))
    return F.when(value.isNull(), F.lit(default)).otherwise(word.isin(*TRUE_WORDS) | F.coalesce(word.try_cast("double") != 0, F.lit(False)))


def rgb(hex_colour: Column) -> Column:
    """(r, g, b) of a colour in six hexadecimal digits, with or without a hash; null if it isn't one."""
    digits = F.regexp_extract(hex_colour, "^#*([0-9A-Fa-f]{6})", 1)
    part = lambda k: F.conv(F.substring(digits, k, 2), 16, 10).cast("int")
    return F.when(digits != "", F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def drawn_before(colour: Column, lift: float, keep: float) -> Column:
    """(r, g, b) to draw so that a screen that lifts lightness by a share, and keeps a share of saturation, ends at the colour.

    With the hue kept, a channel's distance from the lightness scales with the chroma, so no hue is computed. The scale
    is divided out before a channel is multiplied by it: in another order some channels end beside a half and round away from it.
    """
    room = lambda x: 1 - F.abs(2 * x - 1)  # noqa: E731  the chroma of full saturation
    once = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  a value that is asked for often is worked out once

    def drawn(c: Column) -> Column:
        high, low = F.greatest(*(c[k] for k in "rgb")), F.least(*(c[k] for k in "rgb"))
        tone = F.struct(((high + low) / 2).alias("light"), (high - low).alias("chroma"))
        return once(tone, lambda t: once(scaled(t), lambda s: F.struct(*(F.bround((s["dark"] + s["scale"] * (c[k] - s["light"])) * 255).cast("int").alias(k) for k in "rgb"))))

    def scaled(t: Column) -> Column:
        darker = F.greatest(F.lit(0.0), 1 - (1 - t["light"]) / F.lit(1 - lift))
        scale = F.when(t["chroma"] > 0, F.least(F.lit(1.0), t["chroma"] / room(t["light"]) / F.lit(keep)) * room(darker) / t["chroma"]).otherwise(0.0)
        return F.struct(t["light"].alias("light"), darker.alias("dark"), scale.alias("scale"))

    shares = once(colour, lambda c: F.when(c.isNotNull(), F.struct(*((c[k] / F.lit(255.0)).alias(k) for k in "rgb"))))
    return once(shares, lambda c: F.when(c.isNotNull(), drawn(c)))


def cover_at(ms: Column, duration: Column) -> Column:
    """A cover's offset, at half a duration that it would reach past; an unknown or empty duration moves nothing."""
    return F.when((duration > 0) & (ms >= duration), F.floor(duration / 2).cast("long")).otherwise(ms.cast("long"))


def inside_gap(start: Column, end: Column) -> Column:
    """Half across a gap, at most GAP_CAP after its start."""
    return F.least((start + end) / 2, start + GAP_CAP)


def is_timestamp(spec: Column) -> Column:
    """Whether a trimmed literal is made of digits, colons and points only."""
    return F.trim(spec).rlike("^[0-9:.]+$")


def is_usable(size: Column, duration: Column) -> Column:
    """Whether a file has some size and a known duration above zero; nulls are no."""
    return F.coalesce((size >= LEAST_BYTES) & (duration > 0), F.lit(False))


def most_chars(center: Column, width: Column, margin: Column, size: Column, ratio: float = 0.32) -> Column:
    """Characters a line centred at `center` may have before it reaches the nearer margin, LEAST_CHARS at least."""
    half = F.greatest(F.lit(1), F.least(center - margin, width - margin - center))
    return F.greatest(F.lit(LEAST_CHARS), F.floor(2 * half / (size * F.lit(ratio))).cast("int"))


def scaled(value: Column, kind: Column, scale: float) -> Column:
    """A value, written as text, of kind "int", "float" or another at a scale: whole numbers stay whole (half to even), others keep four decimals; other kinds, and all at a scale of 1, stay as written."""
    if scale == 1.0:
        return value
    number = value.try_cast("double") * F.lit(scale)
    return F.when(kind == "int", F.bround(number).cast("long").cast("string")).when(kind == "float", F.bround(number, 4).cast("string")).otherwise(value)


def made_even(value: Column) -> Column:
    """A whole number, written as text, one less if odd; anything else as it is."""
    whole = value.try_cast("long")
    return F.when(F.pmod(whole, F.lit(2)) == 1, (whole - 1).cast("string")).otherwise(value)


def caption(one: Column, first: Column, second: Column) -> Column:
    """What a caption shows: its two lines where the first is set, else its one; empty where neither is."""
    two = F.concat_ws(" ", first, F.when(second != "", second))
    return F.when(first != "", two).otherwise(F.coalesce(one, F.lit("")))


def derived_name(owner: Column, chapter: Column, first: Column, last: Column) -> Column:
    """The file name that an owner's chapter and range give; an owner without a name is unknown."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(owner, F.lit("unknown"))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat_ws("-", F.upper(slug), chapter, first.cast("string"), F.concat(last.cast("string"), F.lit(".mp4")))


def endpoints(tiers: list[tuple[str, Column]]) -> Column:
    """Endpoints (tier, url, label) of comma-separated settings, in the order of the tiers and of each setting: blanks left out, a scheme put in front where there is none, and a label without credentials."""

    def listed(tier: str, setting: Column) -> Column:
        entries = F.filter(F.transform(F.split(F.coalesce(setting, F.lit("")), ","), lambda e: F.trim(e)), lambda e: e != "")
        urls = F.transform(entries, lambda e: F.when(e.contains("://"), e).otherwise(F.concat(F.lit("http://"), e)))
        return F.transform(urls, lambda u: F.struct(F.lit(tier).alias("tier"), u.alias("url"), F.concat(F.lit(tier + " "), F.substring_index(u, "@", -1)).alias("label")))

    return reduce(lambda a, b: F.concat(a, b), (listed(*t) for t in tiers))
