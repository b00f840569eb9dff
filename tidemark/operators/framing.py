"""Framing: the window of a shot that puts a measured head in its place, holds the body and keeps clear of obstructions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


@dataclass(frozen=True)
class Style:
    """across : down is the aspect, caption the share of the width that a column of text takes (none: no column), canvas the width in pixels that the caption's place is told in; x, y and zoom weigh the cost, gate is how far aside of its target the head may be."""

    across: int
    down: int
    caption: float | None
    canvas: int
    x: float
    y: float
    zoom: float
    gate: float


# Fixed values.
STYLES = {
    "bars": Style(16, 9, 0.45, 1920, 3.0, 2.0, 0.5, 0.16),
    "horizontal": Style(16, 9, 0.504, 1920, 3.0, 2.0, 0.5, 0.16),
    "vertical": Style(9, 16, None, 1080, 1.0, 2.0, 1.5, 0.25),
}
LEAST_GAP, FACE_AT, FACE_BAND, HEADROOM = 0.02, 0.275, (0.24, 0.34), 0.08
FACE_IN_HEAD, REACH = (0.50, 0.85), 1.3
ZOOMS, ZOOM_STEP, LEAST_WIDTH, PAD = 26, 0.02, 160, 6
MOVE_X, MOVE_Y = 0.16, 0.05
CONTENT_ZOOM, CONTENT_X = 0.92, 0.02

MEASURES = ["cx", "cy", "head_w", "head_h", "face", "body_left", "body_right"]


def within(x: Column, interval: tuple[Column, Column]) -> Column:
    """The value of an interval nearest to x; the lower end of an empty one."""
    return F.greatest(interval[0], F.least(interval[1], x))


def face_in_head(cy: Column, head_h: Column, face: Column) -> tuple[Column, Column]:
    """(crown, face): the top of the head's box, and the face moved to where a box of that height has one."""
    crown = cy - head_h / 2.0
    return crown, within(face, (crown + FACE_IN_HEAD[0] * head_h, crown + FACE_IN_HEAD[1] * head_h))


def silhouette(width: Column, cx: Column, head_w: Column, left: Column, right: Column) -> Column:
    """(left, right, trimmed): the body's edges in pixels, no farther from the head than a body reaches, and whether that took off more than half a pixel."""
    reach = REACH * head_w * width
    low, high = G.meeting((left * width, right * width), (cx * width - reach, cx * width + reach), (F.lit(0.0), width.cast("double")))
    return F.struct(low.alias("left"), high.alias("right"), ((low > left * width + 0.5) | (high < right * width - 0.5)).alias("trimmed"))


def room_aside(width: Column, w: Column, head: tuple[Column, Column], body: Column, on_left: Column, column: tuple[Column, Column] | None) -> Column:
    """(lo, hi, contained): where the left edge of a window of width w may be.

    The head stays beside the caption's column (from, to; shares of the window), and both of the body's edges inside
    the window where that leaves any room: containment yields to the caption, never the other way round.
    """
    frame = (F.lit(0.0), (width - w).cast("double"))
    low, high = frame
    if column:
        low = F.when(on_left, low).otherwise(within(head[1] - column[0] * w, frame))
        high = F.when(on_left, within(head[0] - column[1] * w, frame)).otherwise(high)

    def held(m: Column) -> Column:
        return F.struct(m["low"].alias("low"), m["high"].alias("high"), F.greatest(m["low"], body["right"] - w).alias("from"), F.least(m["high"], body["left"]).alias("to"))

    def chosen(m: Column) -> Column:
        holds = m["from"] <= m["to"]
        return F.struct(F.when(holds, m["from"]).otherwise(m["low"]).alias("lo"), F.when(holds, m["to"]).otherwise(m["high"]).alias("hi"), holds.alias("contained"))

    ends = G.once(F.struct(low.alias("low"), high.alias("high")), lambda m: F.struct(m["low"].alias("low"), F.greatest(m["low"], m["high"]).alias("high")))
    return G.once(G.once(ends, held), chosen)


def _windows(style: Style) -> Column:
    """The windows of all zooms that the frame has room for, each with its places."""
    width, height = F.col("width"), F.col("height")
    largest = F.least(width.cast("double"), height * style.across / F.lit(float(style.down)))

    def sized(i: Column) -> Column:
        scale = 1.0 - ZOOM_STEP * i
        w = G.even(largest * scale)
        return F.struct(i.alias("i"), scale.alias("scale"), w.alias("w"), G.even(w * style.down / F.lit(float(style.across))).alias("h"))

    def targeted(z: Column) -> Column:
        middle = F.struct(F.lit(0.5).alias("fx"), F.lit(0.5).alias("cap"))
        gaps = middle if style.caption is None else G.equal_gaps(F.least(F.col("head_w") * width / z["w"], F.lit(1.0)), style.caption, F.col("on_left"), LEAST_GAP)
        return F.struct(*(z[name].alias(name) for name in ("i", "scale", "w", "h")), gaps.alias("gaps"))

    def ranged(z: Column) -> Column:
        half = None if style.caption is None else style.caption / 2.0
        column = None if half is None else (z["gaps"]["cap"] - half, z["gaps"]["cap"] + half)
        head = tuple((F.col("cx") + side * F.col("head_w") / 2.0) * width for side in (-1, 1))
        aside = room_aside(width, z["w"], head, F.col("body"), F.col("on_left"), column)
        tall = G.height_band(F.col("crown") * height, F.col("face") * height, z["h"], height, FACE_AT, FACE_BAND, HEADROOM)
        return F.struct(*(z[name].alias(name) for name in ("i", "scale", "w", "h", "gaps")), aside.alias("aside"), tall.alias("tall"))

    def started(z: Column) -> Column:
        last = G.even_down(width - z["w"])
        low = F.least(F.greatest(F.lit(0).cast("long"), -G.even_down(-z["aside"]["lo"])), last)
        high = F.least(F.greatest(low, G.even_down(z["aside"]["hi"])), last)
        return F.struct(*(z[name].alias(name) for name in ("i", "scale", "w", "h", "gaps", "tall")), z["aside"]["contained"].alias("contained"), low.alias("lo"), high.alias("hi"), F.col("boxes").alias("boxes"))

    def stepped(z: Column) -> Column:
        start = G.even(within(F.col("cx") * width - z["gaps"]["fx"] * z["w"], (z["lo"].cast("double"), z["hi"].cast("double"))))
        step = F.greatest(F.lit(8).cast("long"), F.floor(z["w"] / 100))
        return F.struct(*(z[name].alias(name) for name in ("i", "scale", "w", "h", "gaps", "tall", "contained", "lo", "hi", "boxes")), start.alias("start"), step.alias("step"))

    fits = lambda z: (z["w"] >= LEAST_WIDTH) & (z["w"] <= width) & (z["h"] <= height)
    out = F.filter(F.transform(F.sequence(F.lit(0), F.lit(ZOOMS - 1)), sized), fits)
    for step in (targeted, ranged, started, stepped):
        out = F.transform(out, step)
    return out


def _moved(z: Column, near: bool = False) -> Column:
    """A window's places aside (x, and the boxes in its columns of pixels) and in height, nearest to its start first; with near, only those that may be best where there are no boxes.

    A step is 8 pixels at least and a start the even place nearest to its target. So a move that ends farther than two
    pixels from the start is farther from the target, too, and only the first one to either side, cut short by the
    edge of the range, can end nearer than that; every longer move then ends at that edge as well.
    """
    none = F.lit(0).cast("long")
    moves = (lambda limit, step: F.when(limit >= step, F.array(none, step, -step)).otherwise(F.array(none))) if near else G.offsets
    kept = (lambda places, start: F.filter(places, lambda v: F.abs(v - start) <= 2)) if near else lambda places, start: F.array_distinct(places)
    width, height = F.col("width"), F.col("height")
    across = kept(F.transform(moves(F.floor(z["w"] * MOVE_X), z["step"]), lambda d: within(G.even(within(z["start"] + d, (z["lo"], z["hi"]))), (z["lo"], z["hi"]))), z["start"])
    last = G.even_down(height - z["h"])
    down = kept(F.transform(moves(F.floor(z["h"] * MOVE_Y), z["step"]), lambda d: within(G.even(within((z["tall"]["y"] + d).cast("double"), (z["tall"]["lo"], z["tall"]["hi"]))), (F.lit(0).cast("long"), last))), z["tall"]["y"])

    def beside(x: Column, k: Column) -> Column:
        aside = F.abs((F.col("cx") * width - x) / z["w"] - z["gaps"]["fx"])
        there = F.filter(z["boxes"], lambda b: (x < b["x"] + b["w"]) & (b["x"] < x + z["w"]))
        return F.struct(k.alias("k"), x.alias("x"), aside.alias("aside"), there.alias("boxes"))

    def above(y: Column, k: Column) -> Column:
        return F.struct(k.alias("k"), y.alias("y"), F.abs((F.col("face") * height - y) / z["h"] - FACE_AT).alias("off"))

    return F.struct(*(z[name].alias(name) for name in ("scale", "i", "w", "h", "gaps", "contained")), F.transform(across, beside).alias("columns"), F.transform(down, above).alias("rows"))


def _best_of_zoom(style: Style, z: Column, clear: bool = True) -> Column:
    """The best place of one window: within the gate, clear, cheap, near to where it would stand. Without clear, as if there were no boxes."""

    def placed(x: Column, y: Column) -> Column:
        hit = F.exists(x["boxes"], lambda b: (y["y"] < b["y"] + b["h"]) & (b["y"] < y["y"] + z["h"])) if clear else F.lit(False)
        cost = style.x * x["aside"] + style.y * y["off"] + style.zoom * (1.0 - z["scale"])
        return F.struct(
            (x["aside"] > style.gate).alias("forced"), hit.alias("blocked"), cost.alias("cost"), z["i"].alias("zoom"), x["k"].alias("kx"), y["k"].alias("ky"),
            x["x"].alias("x"), y["y"].alias("y"), z["w"].alias("w"), z["h"].alias("h"), z["contained"].alias("contained"), (x["aside"] < CONTENT_X).alias("near"), z["gaps"]["cap"].alias("cap"),
        )

    best_beside = lambda x: F.array_min(F.transform(z["rows"], lambda y: placed(x, y)))
    return F.array_min(F.transform(z["columns"], best_beside))


def _tries(style: Style) -> Column:
    """(scale, place) of the zooms that may have the best place of theirs and all larger ones, in turn; all places of a zoom are tried only where need be.

    The place that a window has without boxes is its best one if it meets none. If it does, no place of that zoom is
    better than it would be if it were clear: where that is no better than what zooms tried before it, or
    for a small zoom any zoom, have clear, the zoom is left out; else all its places are tried.
    """

    def freely(z: Column) -> Column:
        return F.struct(z.alias("z"), _best_of_zoom(style, z["near"], False).alias("p"))

    def met(t: Column) -> Column:
        p = t["p"]
        hit = F.exists(t["z"]["boxes"], lambda b: (p["x"] < b["x"] + b["w"]) & (b["x"] < p["x"] + p["w"]) & (p["y"] < b["y"] + b["h"]) & (b["y"] < p["y"] + p["h"]))
        return F.struct(t["z"].alias("z"), p.alias("p"), hit.alias("hit"))

    def tried(free: Column, clear: Column, best: Column) -> Column:
        def one(t: Column) -> Column:
            z, p = t["z"], t["p"]
            before = F.array_min(F.transform(F.filter(clear, lambda c: c["z"]["i"] < z["i"]), lambda c: c["p"]))
            limit = F.when(z["scale"] > CONTENT_ZOOM, before).otherwise(best)
            whole = G.once(_moved(z), lambda m: _best_of_zoom(style, m))
            place = F.when(~t["hit"], p).when(F.coalesce(p < limit, F.lit(True)), whole)
            return F.struct(z["scale"].alias("scale"), place.alias("place"))

        return F.filter(F.transform(free, one), lambda t: t["place"].isNotNull())

    near = F.transform("windows", lambda z: F.struct(*(z[name].alias(name) for name in ("i", "scale", "w", "h", "gaps", "tall", "contained", "lo", "hi", "boxes", "start", "step")), _moved(z, True).alias("near")))
    free = F.transform(F.transform(near, freely), met)
    return G.once(free, lambda f: G.once(F.filter(f, lambda t: ~t["hit"]), lambda c: G.once(F.array_min(F.transform(c, lambda t: t["p"])), lambda best: tried(f, c, best))))


def _first_content(tries: Column) -> Column:
    """The best place over the zooms in turn, with no zoom looked at after a large one has left the best clear, ungated and close to its target."""
    best = F.array_min(F.transform(tries, lambda t: t["place"]))

    def so_far(t: Column) -> Column:
        return F.array_min(F.transform(F.filter(tries, lambda u: u["scale"] >= t["scale"]), lambda u: u["place"]))

    reached = F.transform(F.filter(tries, lambda t: t["scale"] > CONTENT_ZOOM), so_far)
    content = F.filter(reached, lambda p: ~p["forced"] & ~p["blocked"] & p["near"])
    return F.coalesce(F.get(content, F.lit(0)), best)


def framed(shots: DataFrame, key: str, style: Style) -> DataFrame:
    """(key, state, zoom, x, y, w, h, contained, cost, x_offset): a window for each shot.

    shots: key, width and height in pixels, MEASURES as shares of the frame, facing, and boxes (an array of x, y, w, h,
    as shares; null: none). Every zoom has a grid of places around the one that the gaps ask for; the grid is an array in
    the row, so shots are never multiplied out. state: "framed"; "blocked" (all places meet a box); "forced" (no place
    within the gate); "centred" (a measure is null, or no window is wide enough: the largest centred window).
    """
    width, height = F.col("width"), F.col("height")
    crown, face = face_in_head(F.col("cy"), F.col("head_h"), F.col("face"))
    padded = F.transform("boxes", lambda b: F.struct((b["x"] * width - PAD).alias("x"), (b["y"] * height - PAD).alias("y"), (b["w"] * width + 2 * PAD).alias("w"), (b["h"] * height + 2 * PAD).alias("h")))
    known = F.forall(F.array(*MEASURES), lambda v: v.isNotNull())
    session = shots.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    rows = shots.repartition(tasks).select(  # a row is small and takes milliseconds: dealt out by work, not by size
        key, "width", "height", "cx", "head_w", crown.alias("crown"), face.alias("face"), known.alias("known"),
        F.coalesce(padded, F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")).alias("boxes"),
        G.caption_on_left(F.col("facing"), F.col("cx")).alias("on_left"),
        silhouette(width, F.col("cx"), F.col("head_w"), F.col("body_left"), F.col("body_right")).alias("body"),
    )
    tried = rows.withColumn("windows", F.when(F.col("known"), _windows(style))).withColumn("tries", _tries(style))
    best = tried.withColumn("b", F.when(F.size("tries") > 0, _first_content(F.col("tries")))).withColumn("c", G.centred(width, height, style.across, style.down))
    state = F.when(F.col("b").isNull(), "centred").when(F.col("b.forced"), "forced").when(F.col("b.blocked"), "blocked").otherwise("framed")
    placed = [F.coalesce(f"b.{name}", f"c.{name}").alias(name) for name in ("x", "y", "w", "h")]
    offset = F.coalesce(F.bround((F.col("b.cap") - 0.5) * style.canvas).cast("long"), F.lit(0).cast("long"))
    return best.select(key, state.alias("state"), F.col("b.zoom").alias("zoom"), *placed, F.col("b.contained").alias("contained"), F.col("b.cost").alias("cost"), offset.alias("x_offset"))
