"""Checks before and after a run: clocks, what a model can see, truth files, truth that is unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.operators.evaluate import on_legs


def clock_readings(clips: DataFrame, tracks: DataFrame) -> DataFrame:
    """How a clip's clock lies to its track's: run_id, status, reading, overlap_s, other_s, video_start, offset_s, displaced_m, detail.

    ``clips`` (run_id, duration_s, created), ``tracks`` (run_id, start, span_s, length_m), times as timestamps. Cameras write
    ``created`` when they begin or when they have finished: both are tried, and the one that overlaps the track longer
    is taken, the beginning if they tie. ``offset_s`` is when the clip begins on the track's clock; under a second is ``ok``,
    else ``apply`` it; over an hour is more likely another time zone, ``zone``. Without one of the times ``unknown``.
    """
    seconds = lambda c: F.unix_micros(c) / 1e6
    j = clips.select("run_id", "duration_s", "created").join(tracks.select("run_id", "start", "span_s", "length_m"), "run_id", "left")
    j = j.withColumns({"_c": seconds("created"), "_t": seconds("start")})
    overlap = lambda begin: F.least(begin + F.col("duration_s"), F.col("_t") + F.col("span_s")) - F.greatest(begin, F.col("_t"))
    known = F.col("_c").isNotNull() & F.col("_t").isNotNull() & F.col("duration_s").isNotNull() & F.col("span_s").isNotNull()
    j = j.withColumns({"as_start": F.when(known, overlap(F.col("_c"))), "as_end": F.when(known, overlap(F.col("_c") - F.col("duration_s")))})
    at_end = F.col("as_end") > F.col("as_start")
    begin = F.when(at_end, F.col("_c") - F.col("duration_s")).otherwise(F.col("_c"))
    j = j.withColumns({"reading": F.when(known, F.when(at_end, "end").otherwise("start")), "video_start": F.when(known, F.timestamp_micros(F.round(begin * 1e6).cast("long"))), "offset_s": F.when(known, begin - F.col("_t"))})
    size = F.abs("offset_s")
    status = F.when(~known, "unknown").when(size < 1, "ok").when(size > 3600, "zone").otherwise("apply")
    displaced = F.when(status == "apply", F.coalesce(size * F.try_divide("length_m", "span_s"), F.lit(0.0)))
    detail = (
        F.when(F.col("_c").isNull(), "no creation time").when(~known, "no time on the track")
        .otherwise(F.concat(F.format_string("read as the %s, %.3f s in common against %.3f s; ", "reading", F.greatest("as_start", "as_end"), F.least("as_start", "as_end")),
                            F.when(status == "zone", F.format_string("%+.3f s apart, perhaps a time zone", "offset_s")).otherwise(F.format_string("offset %+.2f s", "offset_s"))))
    )
    return j.select("run_id", status.alias("status"), "reading", F.greatest("as_start", "as_end").alias("overlap_s"), F.least("as_start", "as_end").alias("other_s"), "video_start", "offset_s", displaced.alias("displaced_m"), detail.alias("detail"))


def rules_by_run(runs: DataFrame, rules: DataFrame, models: DataFrame) -> DataFrame:
    """Every rule of absence for every run, with ``detectable``: whether the run's model could have seen its asset.

    ``runs`` (run_id, model), ``rules`` (absence_key, asset, ...), ``models`` (model, cls): what a model is limited to. A
    model that isn't in ``models``, or none, is taken to see everything. Rules and models are small dimensions.
    """
    limited = F.broadcast(models.select("model").distinct().withColumn("_limited", F.lit(True)))
    sees = F.broadcast(models.select("model", F.col("cls").alias("asset")).distinct().withColumn("_sees", F.lit(True)))
    every = runs.select("run_id", "model").crossJoin(F.broadcast(rules))
    both = every.join(limited, "model", "left").join(sees, ["model", "asset"], "left")
    return both.withColumn("detectable", F.col("_limited").isNull() | F.col("_sees").isNotNull()).drop("_limited", "_sees")


def skipped_rules(by_run: DataFrame) -> DataFrame:
    """Rules that were not applied, as their model can't see the asset: not looked for is not missing."""
    return by_run.filter(~F.col("detectable")).select("run_id", "model", "absence_key", "asset")


def split_truth(frames: DataFrame, keys: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each frame, and each frame that only predictions name: run_id, frame_id, status, predictions.

    ``keys`` (run_id, key) are times to two places for which truth was written, an empty one too. ``scored`` frames have a
    key; ``unknown_truth`` ones have none, and what was predicted there is neither right nor wrong; ``orphan`` are
    frames of predictions that the run doesn't have.
    """
    said = keys.select("run_id", "key").distinct().withColumn("_said", F.lit(True))
    known = frames.select("run_id", "frame_id", F.format_string("%.2f", "t_sec").alias("key")).join(said, ["run_id", "key"], "left").withColumn("_frame", F.lit(True))
    made = predictions.groupBy("run_id", "frame_id").agg(F.count(F.lit(1)).alias("_n"))
    both = known.join(made, ["run_id", "frame_id"], "full_outer")
    status = F.when(F.col("_frame").isNull(), "orphan").when(F.col("_said").isNull(), "unknown_truth").otherwise("scored")
    return both.select("run_id", "frame_id", status.alias("status"), F.coalesce("_n", F.lit(0)).cast("long").alias("predictions"))


def truth_counts(split: DataFrame) -> DataFrame:
    """For each run how many frames are scored, of unknown truth and orphans, and the predictions on each."""
    of = lambda s: F.col("status") == s
    total = lambda s: F.coalesce(F.sum(F.when(of(s), F.col("predictions"))), F.lit(0))
    return split.groupBy("run_id").agg(
        F.count_if(of("scored")).alias("scored"), F.count_if(of("unknown_truth")).alias("unknown_truth"), F.count_if(of("orphan")).alias("orphans"),
        total("scored").alias("predicted"), total("unknown_truth").alias("predicted_on_unknown"), total("orphan").alias("predicted_on_orphans"),
    )


def lint_truth(defects: DataFrame, marks: DataFrame, frames: DataFrame, taxonomy: DataFrame, horizon: float = 0.52) -> DataFrame:
    """What is odd about hand-marked truth: run_id, obj, fault, n.

    ``defects`` (run_id, obj, cls, evidence), ``marks`` (run_id, obj, t, box of 0..1000 or null). unknown_class, no_track and
    bad_box (n marks) speak for themselves, and nothing else is said of such a defect. Else: no_evidence, a blank text;
    degenerate_box, on n frames; above_horizon, boxes of point classes on n frames that end in the upper ``horizon`` of the image,
    where nothing is ranged; no_keyframe, and one_keyframe, which can't be triangulated.
    """
    known = F.broadcast(taxonomy.select("cls", "geometry").withColumn("_known", F.lit(True)))
    own = marks.groupBy("run_id", "obj").agg(F.count(F.lit(1)).alias("marks"), F.count_if(F.col("box").isNull()).alias("bad"))
    d = defects.select("run_id", "obj", "cls", "evidence").join(known, "cls", "left").join(own, ["run_id", "obj"], "left")
    first = F.when(F.col("_known").isNull(), "unknown_class").when(F.col("marks").isNull(), "no_track").when(F.col("bad") > 0, "bad_box")
    d = d.withColumn("first", first)
    sound = marks.join(d.filter("first is null").select("run_id", "obj", "geometry"), ["run_id", "obj"])
    on = on_legs(sound.select("run_id", "obj", "t", "box"), frames, lone=True)
    side = {c: F.round(F.col(f"box.{c}"), 1) for c in ("x1", "y1", "x2", "y2")}
    flat = (side["x2"] <= side["x1"]) | (side["y2"] <= side["y1"])
    hits = on.groupBy("run_id", "obj").agg(
        F.count_if(~flat).alias("hits"), F.count_if(flat).alias("flat"), F.count_if(~flat & (side["y2"] < 1000 * horizon)).alias("high"))
    d = d.join(hits, ["run_id", "obj"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    fault = lambda when, name, n: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("fault"), n.cast("long").alias("n")))
    fine, one = F.col("first").isNull(), F.lit(1)
    rows = F.array_compact(F.array(
        F.when(~fine, F.struct(F.col("first").alias("fault"), F.when(F.col("first") == "bad_box", F.col("bad")).otherwise(1).cast("long").alias("n"))),
        fault(fine & (F.trim(F.coalesce("evidence", F.lit(""))) == ""), "no_evidence", one), fault(fine & (F.col("flat") > 0), "degenerate_box", F.col("flat")),
        fault(fine & (F.col("geometry") == "point") & (F.col("high") > 0), "above_horizon", F.col("high")),
        fault(fine & (F.col("hits") == 0), "no_keyframe", one), fault(fine & (F.col("hits") == 1), "one_keyframe", one),
    ))
    return d.select("run_id", "obj", F.explode(rows).alias("f")).select("run_id", "obj", "f.*")
