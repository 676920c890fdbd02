"""Image boxes, struct<x1,y1,x2,y2:double> on a 0..1000 scale, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the association of two sightings.
MIN_IOU, MOVED_UP, MAX_SHIFT, MIN_WIDTH = 0.10, 60.0, 2.5, 40.0
# Base severity of distress types; others have 3.
SEVERITY_BASE = {
    "pothole": 4, "depression": 4, "rutting": 4, "alligator_crack": 3, "shoving": 3, "edge_crack": 3, "ravelling": 3,
    "longitudinal_crack": 2, "transverse_crack": 2, "bleeding": 2, "patching": 1,
}


def make_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box["x2"] - box["x1"]) * F.greatest(F.lit(0.0), box["y2"] - box["y1"])


def area_fraction(box: Column) -> Column:
    return area(box) / 1_000_000.0


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area; 0 where there is none."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    both = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    joint = area(a) + area(b) - both
    return F.when(joint > 0, both / joint).otherwise(F.lit(0.0))


def association(prev: Column, cur: Column) -> Column:
    """How well two sightings look like one object that comes nearer; -1 refuses."""
    shared = iou(prev, cur)
    centre = lambda b, axis: (b[axis + "1"] + b[axis + "2"]) / 2.0
    shift = F.abs(centre(cur, "x") - centre(prev, "x")) / F.greatest(prev["x2"] - prev["x1"], F.lit(MIN_WIDTH))
    refused = (centre(cur, "y") < centre(prev, "y") - MOVED_UP) | (shift > MAX_SHIFT) | ((shared < MIN_IOU) & (shift > 1.0))
    return F.when(refused, F.lit(-1.0)).otherwise(shared + F.greatest(F.lit(0.0), 1.0 - shift / MAX_SHIFT))


def coerce_box(raw: Column) -> Column:
    """A box from an array of any four numbers, null if it can't be one.

    Values all within 0..1 are taken for fractions; corners are put in order and clamped. Slivers
    under 2 and boxes over 92 % of the frame on both axes are refused.
    """
    numbers = F.transform(raw, lambda x: x.cast("double"))
    sound = (F.size(raw) == 4) & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x))
    fractions = F.forall(numbers, lambda x: (x >= 0) & (x <= 1.0))
    scaled = F.transform(numbers, lambda x: F.when(fractions, x * 1000.0).otherwise(x))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), x))
    at = lambda i: F.get(scaled, F.lit(i))
    box = make_box(clamp(F.least(at(0), at(2))), clamp(F.least(at(1), at(3))), clamp(F.greatest(at(0), at(2))), clamp(F.greatest(at(1), at(3))))
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    return F.when(sound & (w >= 2) & (h >= 2) & ~((w > 920) & (h > 920)), box)


def to_pixels(box: Column, width: Column, height: Column) -> Column:
    return make_box(box["x1"] / 1000.0 * width, box["y1"] / 1000.0 * height, box["x2"] / 1000.0 * width, box["y2"] / 1000.0 * height)


def from_pixels(box: Column, width: Column, height: Column) -> Column:
    return make_box(box["x1"] / width * 1000.0, box["y1"] / height * 1000.0, box["x2"] / width * 1000.0, box["y2"] / height * 1000.0)


def letterbox(width: Column, height: Column, size: Column) -> Column:
    """struct(scale, pad_x, pad_y) that fits a frame into a square of ``size`` pixels."""
    scale = F.least(size / width, size / height)
    pad = lambda n: ((size - F.bround(n * scale, 0)) / 2.0).alias
    return F.struct(scale.alias("scale"), pad(width)("pad_x"), pad(height)("pad_y"))


def undo_letterbox(cx: Column, cy: Column, w: Column, h: Column, fit: Column) -> Column:
    """Centre, width and height in the square to corners in the frame's pixels."""
    x = lambda v: (v - fit["pad_x"]) / fit["scale"]
    y = lambda v: (v - fit["pad_y"]) / fit["scale"]
    return make_box(x(cx - w / 2), y(cy - h / 2), x(cx + w / 2), y(cy + h / 2))


def severity_from(cls: Column, confidence: Column, box: Column) -> Column:
    """Base of the class, one more if sure and large, one less if unsure, within 1..5."""
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_BASE.items() for x in kv]), cls), F.lit(3))
    step = F.when((confidence >= 0.70) & (area_fraction(box) > 0.02), 1).when(confidence < 0.40, -1).otherwise(0)
    return F.greatest(F.lit(1), F.least(F.lit(5), base + step))


def crop_rectangle(box: Column, width: Column, height: Column, pad: float) -> Column:
    """Pixel rectangle around a box, widened by ``pad`` of its size, within the frame; under 8 px null."""
    px = to_pixels(box, width, height)
    dx, dy = (px["x2"] - px["x1"]) * pad, (px["y2"] - px["y1"]) * pad
    left, top = F.greatest(F.lit(0), F.floor(px["x1"] - dx)), F.greatest(F.lit(0), F.floor(px["y1"] - dy))
    right, bottom = F.least(width, F.ceil(px["x2"] + dx)), F.least(height, F.ceil(px["y2"] + dy))
    rect = F.struct(left.cast("long").alias("left"), top.cast("long").alias("top"), right.cast("long").alias("right"), bottom.cast("long").alias("bottom"))
    return F.when((right - left >= 8) & (bottom - top >= 8), rect)


def tiles(width: Column, height: Column, tile: int, overlap: int) -> Column:
    """Array of struct(x, y, w, h) that covers a frame with overlapping tiles; use with explode."""
    step = max(tile - overlap, 64)
    starts = lambda n: F.sequence(F.lit(0), F.greatest(n - overlap, F.lit(1)) - 1, F.lit(step))
    one = lambda x, y: F.struct(
        x.alias("x"), y.alias("y"), F.least(F.lit(tile), width - x).alias("w"), F.least(F.lit(tile), height - y).alias("h")
    )
    return F.flatten(F.transform(starts(height), lambda y: F.transform(starts(width), lambda x: one(x, y))))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))
