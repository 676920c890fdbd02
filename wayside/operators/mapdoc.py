"""Map documents of runs, one row for each line of text, so that no run's document is ever one row.

Rows (run_id, part, item, step, line); in this order they are the document. Parts: head, styles, findings, stretches
without an asset, heat lines, route, the drive in time, a tour, end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayside.functions import text
from wayside.operators.export import tour_stops
from wayside.sources.sinks import written

HEAD, STYLES, FINDINGS, STRETCHES, HEAT, ROUTE, DRIVE, TOUR, END = range(9)
#: Lines of one item: what opens it, its places or times, then its places in time, what closes it.
OPEN, FIRST, SECOND, CLOSE = range(4)
LINE = "<LineString><altitudeMode>clampToGround</altitudeMode><tessellate>1</tessellate><coordinates>"


def _row(part: int, item, step, line: Column, run: Column | None = None) -> list[Column]:
    whole = lambda v: (F.lit(v) if isinstance(v, int) else v).cast("long")
    return [run if run is not None else F.col("run_id"), F.lit(part).alias("part"), whole(item).alias("item"), whole(step).alias("step"), line.alias("line")]


def _around(runs: DataFrame, part: int, opening: str, closing: str) -> DataFrame:
    """An opening and a closing line for each run."""
    return runs.select(*_row(part, OPEN, 0, F.lit(opening))).unionByName(runs.select(*_row(part, CLOSE, 0, F.lit(closing))))


def _place(lat: str = "lat", lon: str = "lon") -> Column:
    return text.coordinates(F.col(lon), F.col(lat))


def style_lines(runs: DataFrame, taxonomy: DataFrame, absences: DataFrame) -> DataFrame:
    """A style for each class and each kind of absence (absence_key, color), and one for the route, in each of ``runs``."""
    style = lambda key, color, scale, icon: F.concat(
        F.lit('<Style id="c-'), text.xml_escape(key), F.lit('"><IconStyle><color>'), text.map_color(color), F.lit(f"</color><scale>{scale}</scale><Icon><href>{icon}</href></Icon></IconStyle>"),
        F.lit("<LineStyle><color>"), text.map_color(color, "c8"), F.lit("</color><width>7</width></LineStyle></Style>"))
    kinds = taxonomy.select(F.col("cls").alias("key"), style(F.col("cls"), F.col("color"), "1.1", "img/pin.png").alias("line")).unionByName(
        absences.select(F.col("absence_key").alias("key"), style(F.col("absence_key"), F.col("color"), "1.4", "img/gap.png").alias("line")))
    route = runs.select(*_row(STYLES, 1, 0, F.lit('<Style id="route"><LineStyle><color>ffe6edf3</color><width>3</width></LineStyle></Style>')))
    numbered = kinds.withColumn("step", F.row_number().over(Window.orderBy("key")) - 1)  # a dimension of a few rows
    return runs.crossJoin(F.broadcast(numbered)).select(*_row(STYLES, 0, F.col("step"), F.col("line"))).unionByName(route)


def finding_lines(findings: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """A pin for each finding with a place, in order of time, stamped where the run has a clock (``ts``)."""
    label = F.coalesce("_label", text.title(F.col("cls")))
    named = findings.filter("lat is not null and lon is not null").join(F.broadcast(taxonomy.select("cls", F.col("label").alias("_label"))), "cls", "left")
    stamp = F.coalesce(F.concat(F.lit("<TimeStamp><when>"), stamp_text(F.col("ts")), F.lit("</when></TimeStamp>")), F.lit("")) if "ts" in findings.columns else F.lit("")
    line = F.concat(F.lit("<Placemark><name>"), text.xml_escape(label), F.lit(", severity "), F.col("severity").cast("string"), F.lit("</name><styleUrl>#c-"), text.xml_escape(F.col("cls")),
                    F.lit("</styleUrl>"), stamp, F.lit("<Point><coordinates>"), _place(), F.lit("</coordinates></Point></Placemark>"))
    order = F.row_number().over(Window.partitionBy("run_id").orderBy("t_sec", "finding_id"))
    return named.select(*_row(FINDINGS, FIRST, order, line))


def stretch_lines(stretches: DataFrame) -> DataFrame:
    """A line along each stretch without an asset: ``stretches`` (run_id, rule_ord, absence_key, label, start_m, end_m, step, lat, lon).

    Its places come from ``absence.gap_polyline``; each is a row.
    """
    item = F.dense_rank().over(Window.partitionBy("run_id").orderBy("rule_ord", "start_m")) * 4
    s = written(stretches.withColumn("_item", item), "stretches")  # read for each kind of line
    last = s.groupBy("run_id", "_item").agg(F.first("absence_key").alias("key"), F.first("label").alias("label"), (F.first("end_m") - F.first("start_m")).alias("long"))
    opening = F.concat(F.lit("<Placemark><name>"), text.xml_escape(F.col("label")), F.format_string(", %.1f m", "long"), F.lit("</name><styleUrl>#c-"), text.xml_escape(F.col("key")), F.lit(f"</styleUrl>{LINE}"))
    return (
        last.select(*_row(STRETCHES, F.col("_item") + OPEN, 0, opening))
        .unionByName(s.select(*_row(STRETCHES, F.col("_item") + FIRST, F.col("step"), _place())))
        .unionByName(last.select(*_row(STRETCHES, F.col("_item") + CLOSE, 0, F.lit("</coordinates></LineString></Placemark>"))))
    )


def heat_lines(segments: DataFrame) -> DataFrame:
    """A coloured line for each scored segment."""
    ends = F.concat_ws(" ", text.coordinates(F.col("start.lon"), F.col("start.lat")), text.coordinates(F.col("end.lon"), F.col("end.lat")))
    line = F.concat(F.format_string("<Placemark><name>Segment %d, index %.1f</name><Style><LineStyle><color>", F.col("seg_id").cast("long"), "quality_index"), text.map_color(F.col("color"), "dc"),
                    F.lit(f"</color><width>8</width></LineStyle></Style>{LINE}"), ends, F.lit("</coordinates></LineString></Placemark>"))
    return segments.select(*_row(HEAT, FIRST, F.col("seg_id"), line))


def route_lines(frames: DataFrame) -> DataFrame:
    """The way driven, a place in each row."""
    runs = frames.select("run_id").distinct()
    opening = f"<Placemark><name>Route</name><styleUrl>#route</styleUrl>{LINE}"
    return _around(runs, ROUTE, opening, "</coordinates></LineString></Placemark>").unionByName(frames.select(*_row(ROUTE, FIRST, F.col("frame_idx"), _place())))


def stamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def drive_lines(frames: DataFrame) -> DataFrame:
    """The vehicle along the time slider: first all times, then all places; frames without a time (``ts``) are left out."""
    timed = frames.filter("ts is not null")
    opening = "<Placemark><name>Camera</name><styleUrl>#route</styleUrl><gx:Track><altitudeMode>clampToGround</altitudeMode>"
    when = F.concat(F.lit("<when>"), stamp_text(F.col("ts")), F.lit("</when>"))
    place = F.format_string("<gx:coord>%.7f %.7f 0</gx:coord>", "lon", "lat")
    return (
        _around(timed.select("run_id").distinct(), DRIVE, opening, "</gx:Track></Placemark>")
        .unionByName(timed.select(*_row(DRIVE, FIRST, F.col("frame_idx"), when))).unionByName(timed.select(*_row(DRIVE, SECOND, F.col("frame_idx"), place)))
    )


def look_at(lat: str, lon: str, far_m: int, tilt: int) -> Column:
    return F.format_string(f"<LookAt><longitude>%.8f</longitude><latitude>%.8f</latitude><altitude>0</altitude><heading>0</heading><tilt>{tilt}</tilt><range>{far_m}</range></LookAt>", lon, lat)


def tour_lines(findings: DataFrame, frames: DataFrame, k: int = 40) -> DataFrame:
    """A flight over the ``k`` worst findings in order of the route, from a look at its beginning."""
    stops = written(tour_stops(findings, k).filter("stop > 0").drop("finding_id"), "stops")  # at most k for each run, read for each kind of line
    starts = frames.groupBy("run_id").agg(*[F.min_by(c, "frame_idx").alias(c) for c in ("lat", "lon")])
    fly = lambda seconds, mode, view: F.concat(F.lit(f"<gx:FlyTo><gx:duration>{seconds}</gx:duration><gx:flyToMode>{mode}</gx:flyToMode>"), view, F.lit("</gx:FlyTo>"))
    runs = stops.select("run_id").distinct()
    ahead = starts.join(runs, "run_id", "left_semi").select(*_row(TOUR, FIRST, 0, fly(3, "bounce", look_at("lat", "lon", 400, 55))))
    over = stops.select(*_row(TOUR, FIRST, F.col("stop"), F.concat(fly(2, "smooth", look_at("lat", "lon", 110, 60)), F.lit("<gx:Wait><gx:duration>1</gx:duration></gx:Wait>"))))
    return _around(runs, TOUR, "<gx:Tour><name>Tour</name><gx:Playlist>", "</gx:Playlist></gx:Tour>").unionByName(ahead).unionByName(over)


def document_lines(frames: DataFrame, findings: DataFrame, segments: DataFrame, stretches: DataFrame, taxonomy: DataFrame, absences: DataFrame, k: int = 40) -> DataFrame:
    """All lines of all runs' documents; frames may carry ``ts``, the time of each. Folders that would be empty are left out."""
    frames, findings, segments = written(frames, "frames"), written(findings, "findings"), written(segments, "segments")
    runs = frames.select("run_id").distinct()
    namespace = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document>'
    head = runs.select(*_row(HEAD, 0, 0, F.concat(F.lit(namespace), F.format_string("<name>Run %s</name>", F.col("run_id").cast("string")))))
    out = head.unionByName(runs.select(*_row(END, 0, 0, F.lit("</Document></kml>"))))
    out = out.unionByName(style_lines(runs, taxonomy, absences))
    folders = [("Findings", FINDINGS, finding_lines(findings, taxonomy)), ("Missing assets", STRETCHES, stretch_lines(stretches)), ("Heat map", HEAT, heat_lines(segments)), ("Route", ROUTE, route_lines(frames))]
    for name, part, lines in folders:
        some = lines.select("run_id").distinct()
        # the folder's own lines stand before and behind all items
        out = out.unionByName(lines).unionByName(some.select(*_row(part, -1, 0, F.lit(f"<Folder><name>{name}</name>")))).unionByName(some.select(*_row(part, (1 << 62), 0, F.lit("</Folder>"))))
    if "ts" in frames.columns:
        out = out.unionByName(drive_lines(frames))
    return out.unionByName(tour_lines(findings, frames, k))


def write_documents(lines: DataFrame, path: str) -> None:
    """Text files in a folder for each run; a run's files, by name, are its document. Runs are cut where a task is full."""
    order = ["run_id", "part", "item", "step"]
    by = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(by, *order).sortWithinPartitions(*order).select("run_id", "line").write.mode("overwrite").partitionBy("run_id").text(path)
