"""Whether detections lie on the carriageway: the zone's polygon beside the road mask it was drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.functions import geo
from wayside.operators.zone import in_polygon

FRAME = ["run_id", "frame_id"]


def verdicts(detections: DataFrame, rules: DataFrame, polygons: DataFrame, masks: DataFrame, width: int, height: int) -> DataFrame:
    """Detections with what polygon and mask say of the pixel that they stand on.

    ``detections`` (run_id, frame_id, det_seq, cls, geometry, box, ...), ``rules`` (cls, carriageway_only), ``polygons``
    (run_id, frame_id, polygon), ``masks`` as runs (run_id, frame_id, row_no, col_start, col_end). The pixel is the
    anchor, rounded up on both axes, for both tests alike.

    ``on_carriageway`` is the polygon's word: null where the class may be anywhere or the frame has no zone, which is
    not the same as outside. ``on_mask`` is null only where the frame has no mask; a pixel beyond the image is on none.
    ``state`` is anywhere, no_zone, outside, inside, or slack: inside the simplified outline, yet on no road pixel.
    Only ``outside`` is ``rejected``; the mask never decides. Null or unknown classes may be anywhere.
    """
    known = F.broadcast(rules.select("cls", F.col("carriageway_only").alias("_only")))
    up = lambda c: F.ceil(c).cast("long")
    geometry = F.coalesce("geometry", F.lit("point"))
    placed = detections.join(known, "cls", "left").withColumns({
        "col": up(geo.anchor_u(F.col("box"), F.lit(float(width)))), "row_no": up(geo.anchor_v(F.col("box"), F.lit(float(height)), geometry)), "_only": F.coalesce("_only", F.lit(False)),
    })
    points = placed.select(*FRAME, "row_no", "col").distinct().filter(F.col("row_no").between(0, height - 1) & F.col("col").between(0, width - 1))
    # masks and what comes of them have far more rows than their size may tell where they are exploded, so none is broadcast
    hits = points.join(masks.hint("merge"), [*FRAME, "row_no"]).filter(F.col("col").between(F.col("col_start"), F.col("col_end"))).select(*FRAME, "row_no", "col").distinct().withColumn("_hit", F.lit(True))
    masked = masks.select(*FRAME).distinct().withColumn("_masked", F.lit(True))
    both = placed.join(polygons.select(*FRAME, "polygon"), FRAME, "left").join(masked.hint("merge"), FRAME, "left").join(hits.hint("merge"), [*FRAME, "row_no", "col"], "left")
    zone = F.when(F.col("_only"), in_polygon(F.col("col").cast("double"), F.col("row_no").cast("double"), F.col("polygon")))
    said = both.withColumns({"on_carriageway": zone, "on_mask": F.when(F.col("_masked"), F.coalesce("_hit", F.lit(False)))})
    state = (
        F.when(~F.col("_only"), "anywhere").when(F.col("on_carriageway").isNull(), "no_zone").when(~F.col("on_carriageway"), "outside")
        .when(~F.coalesce("on_mask", F.lit(True)), "slack").otherwise("inside")
    )
    return said.withColumns({"state": state, "rejected": state == "outside"}).drop("polygon", "_only", "_masked", "_hit")


def gate_counts(judged: DataFrame) -> DataFrame:
    """For each run how many detections were checked against a zone, rejected, and at odds with the mask."""
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return judged.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), count(F.col("on_carriageway").isNotNull(), "checked"), count(F.col("rejected"), "rejected"),
        count(F.col("state") == "slack", "slack"), count(F.col("rejected") & F.col("on_mask"), "on_mask_only"), count(F.col("state") == "no_zone", "no_zone"),
    )


def keep(judged: DataFrame) -> DataFrame:
    """What is not proven to be off the road; no opinion keeps."""
    return judged.filter(~F.col("rejected"))
