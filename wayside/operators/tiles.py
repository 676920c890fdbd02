"""Detections of a frame and of its tiles brought together in the frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.functions import boxes
from wayside.operators.perception import FRAME, suppress

EDGES = ("x1", "y1", "x2", "y2")


def looks(frames: DataFrame, tile: int = 640, overlap: int = 128) -> DataFrame:
    """What a detector looks at for each of ``frames`` (run_id, frame_id, width, height): look, x, y, w, h in pixels.

    Look 0 is the whole frame: what a tile's edge would cut stays whole there. Overlapping tiles follow, row by row, where
    the frame's shorter side is longer than ``tile``.
    """
    return frames.select(*FRAME, "width", "height", F.posexplode(_looks(tile, overlap)).alias("look", "t")).select(*FRAME, "width", "height", "look", "t.*")


def whole_looks(frames: DataFrame, tile: int = 640, overlap: int = 128) -> DataFrame:
    """The looks of each frame in its row: ``looks``, an array of struct (look, x, y, w, h)."""
    numbered = F.transform(_looks(tile, overlap), lambda t, n: F.struct(n.alias("look"), *[t[c].alias(c) for c in ("x", "y", "w", "h")]))
    return frames.select(*FRAME, "width", "height", numbered.alias("looks"))


def _looks(tile: int, overlap: int) -> Column:
    whole = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"))
    cut = F.transform(boxes.tiles(F.col("width"), F.col("height"), tile, overlap), lambda t: F.struct(*[t[c].cast("long").alias(c) for c in ("x", "y", "w", "h")]))
    large = F.least("width", "height") > tile
    return F.when(large, F.concat(F.array(whole), cut)).otherwise(F.array(whole))


def merge_looks(anchors: DataFrame, looks: DataFrame, classes: list[str], known: DataFrame | None = None, size: int = 640, threshold: float = 0.25, iou: float = 0.45, keep: int = 20) -> DataFrame:
    """Detections (run_id, frame_id, det_seq, cls, box, confidence, severity, evidence) from the raw anchors of all looks.

    ``anchors`` (run_id, frame_id, look, anchor_id, cx, cy, w, h, scores) are in the square of ``size`` pixels that each look was
    fitted into; ``looks`` as of that function. Each box is set back into its look and moved by the look's corner. Boxes of a class
    are suppressed over all looks together, before they are cut to the frame, so an object seen twice in an overlap is one; the ``keep``
    surest of a frame stay. Then boxes of under 2 thousandths a side go, and classes that are not in ``known`` (cls, label), where given.
    Anchors of looks that don't exist, and null scores, go. Equal confidences: the earlier look, then the earlier anchor.
    """
    at = looks.select(*FRAME, "look", "width", "height", F.col("x").alias("_x"), F.col("y").alias("_y"), _fit(F.col("w"), F.col("h"), size))
    return _merged(_sure(anchors, threshold).join(at, [*FRAME, "look"]), classes, known, iou, keep, False)


def merge_whole_looks(frames: DataFrame, classes: list[str], known: DataFrame | None = None, size: int = 640, threshold: float = 0.25, iou: float = 0.45, keep: int = 20) -> DataFrame:
    """As ``merge_looks``, from frames that lie whole in a row, so that nothing is joined or shuffled.

    ``frames`` is (run_id, frame_id, width, height, looks), ``looks`` an array of struct (look, x, y, w, h, anchors) and ``anchors``
    an array of struct (anchor_id, cx, cy, w, h, scores). A frame is one row.
    """
    # outer, as Spark would else work out the arrays twice, to leave out empty ones; these go with the null scores
    each = frames.select(*FRAME, "width", "height", F.explode_outer("looks").alias("_l"))
    # what a look's anchors share is worked out before they are rows
    at = each.select(*FRAME, "width", "height", "_l.look", F.col("_l.x").alias("_x"), F.col("_l.y").alias("_y"), _fit(F.col("_l.w"), F.col("_l.h"), size), F.col("_l.anchors").alias("_a"))
    rows = at.withColumn("_a", F.explode_outer("_a")).select("*", "_a.*").drop("_a")
    return _merged(_sure(rows, threshold), classes, known, iou, keep, True)


def _fit(width: Column, height: Column, size: int) -> Column:
    return boxes.letterbox(width.cast("double"), height.cast("double"), F.lit(float(size))).alias("_fit")


def _sure(anchors: DataFrame, threshold: float) -> DataFrame:
    return anchors.withColumn("confidence", F.array_max("scores")).filter(F.col("confidence") >= threshold)


def _merged(placed: DataFrame, classes: list[str], known: DataFrame | None, iou: float, keep: int, together: bool) -> DataFrame:
    """Detections from sure anchors that know their look: its corner (_x, _y), how it was fitted (_fit), and the frame's width and height."""
    names = F.array(*[F.lit(c) for c in classes])
    placed = placed.withColumn("_px", boxes.undo_letterbox(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.col("_fit")))
    shift = {"x": F.col("_x"), "y": F.col("_y")}
    moved = boxes.make_box(*[F.col(f"_px.{c}") + shift[c[0]] for c in EDGES])
    cls = F.get(names, (F.array_position("scores", F.col("confidence")) - 1).cast("int"))
    # numbered in the order of looks, so that ties are broken alike however the rows come
    order = F.col("look") * F.lit(1 << 32) + F.col("anchor_id")
    whole = placed.withColumn("_moved", moved).select(*FRAME, order.alias("det_seq"), cls.alias("cls"), "confidence", boxes.from_pixels(F.col("_moved"), F.col("width"), F.col("height")).alias("box"))
    kept = suppress(whole, iou, keep, together)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), F.col(f"box.{c}")))
    cut = kept.withColumn("box", boxes.make_box(*[clamp(c) for c in EDGES])).filter("box.x2 - box.x1 >= 2 and box.y2 - box.y1 >= 2")
    named = cut.withColumn("label", F.replace("cls", F.lit("_"), F.lit(" "))) if known is None else cut.join(F.broadcast(known.select("cls", "label")), "cls")
    return named.select(
        *FRAME, "det_seq", "cls", "box", F.round("confidence", 3).alias("confidence"), boxes.severity_from(F.col("cls"), F.col("confidence"), F.col("box")).alias("severity"),
        F.format_string("%s, %.0f%% sure, on %.1f%% of the image", F.lower("label"), F.col("confidence") * 100, boxes.area_fraction(F.col("box")) * 100).alias("evidence"),
    )
