"""All steps from detections to scored runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.operators.absence import absence_gaps, coverage_report, infer_absences
from wayside.operators.findings import cluster_detections
from wayside.operators.localize import localize
from wayside.operators.route import chainage
from wayside.operators.score import build_segments, summarize
from wayside.sources.sinks import written

SCORED = ["run_id", "finding_id", "cls", "severity", "confidence", "t_sec"]


def summarize_runs(detections: DataFrame, frames: DataFrame, taxonomy: DataFrame, rules: DataFrame, camera: dict[str, float], by_run: DataFrame | None = None, absence_weight: float = 1.5) -> dict[str, DataFrame]:
    """Every run's findings, absences, segments, coverage and summary, by these names.

    ``detections`` (run_id, frame_id, det_seq, cls, box, severity, confidence), ``rules`` of absence with an optional
    ``weight``; ``by_run`` says which rules a run's model can be held to (``checks.rules_by_run``). Frames with their
    chainage, findings and absences are written once, as what follows reads them several times. All runs go through each
    step together.
    """
    along = written(chainage(frames.select("run_id", "frame_idx", "frame_id", "t_sec", "lat", "lon", "heading_deg", "width", "height")), "frames")
    frames = along.drop("cum_m")
    placed = localize(detections, frames, taxonomy, camera)
    found = written(cluster_detections(placed, frames, taxonomy, camera), "findings")
    missing = written(infer_absences(absence_gaps(frames, found, rules, by_run=by_run, along=along), frames), "absences")
    every = found.select(SCORED).unionByName(missing.select(SCORED))
    weight = F.coalesce("weight", F.lit(absence_weight)) if "weight" in rules.columns else F.lit(absence_weight)
    classes = taxonomy.select("cls", "weight").unionByName(rules.select(F.col("absence_key").alias("cls"), weight.alias("weight")))
    segments = written(build_segments(frames, every, classes, along=along), "segments")
    return {
        "findings": found, "absences": missing, "segments": segments,
        "coverage": coverage_report(frames, found, missing, rules, along), "summary": summarize(every, segments),
    }
