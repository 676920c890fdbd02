"""Sightings linked to tracks, tracks merged to findings."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside.functions import boxes, geo
from wayside.operators.localize import camera_columns
from wayside.sources.sinks import written

MAX_GAP = 2  # frames between two sightings of a track, at most
#: Metres of a degree of latitude by great circle, for splitting into islands.
SPHERE_M_PER_DEG = geo.EARTH_RADIUS_M * math.pi / 180


def link_candidates(detections: DataFrame) -> DataFrame:
    """Pairs of sightings of a class one or two frames apart that may be one object, with score."""
    later = detections.select("run_id", "cls", F.col("frame_idx").alias("to_frame"), F.col("det_seq").alias("to_seq"), F.col("box").alias("to_box"))
    ahead = detections.withColumn("to_frame", F.explode(F.array(F.col("frame_idx") + 1, F.col("frame_idx") + 2)))
    return (
        ahead.join(later, ["run_id", "cls", "to_frame"])
        .withColumn("score", boxes.association(F.col("box"), F.col("to_box")))
        .filter("score > 0")
        .select("run_id", "cls", F.col("det_seq").alias("from_seq"), "to_seq", "score")
    )


def _islands(df: DataFrame, keys: list[str], starts: Column, order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.when(starts, 1).otherwise(0)).withColumn("island", F.sum("_new").over(w)).drop("_new")


def _association(a, b) -> float:
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    size = lambda r: max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
    joint = size(a) + size(b) - both
    shared = both / joint if joint > 0 else 0.0
    shift = abs(b[0] + b[2] - a[0] - a[2]) / 2 / max(a[2] - a[0], boxes.MIN_WIDTH)
    if (b[1] + b[3]) / 2 < (a[1] + a[3]) / 2 - boxes.MOVED_UP or shift > boxes.MAX_SHIFT:
        return -1.0
    if shared < boxes.MIN_IOU and shift > 1.0:
        return -1.0
    return shared + max(0.0, 1.0 - shift / boxes.MAX_SHIFT)


def extend_tracks(state: list, frame: int, seq: int, box) -> int:
    """Put one sighting on the open track it fits best, or on a new one; returns the track's first seq.

    ``state`` holds [first seq, last frame, last box] of open tracks, oldest first; of equal scores
    the oldest wins. Tracks that nothing can join any more are dropped.
    """
    state[:] = [t for t in state if frame - t[1] <= MAX_GAP]
    best, score = None, 0.0
    for track in state:
        if frame > track[1]:
            s = _association(track[2], box)
            if s > score:
                best, score = track, s
    if best is None:
        best = [seq, frame, box]
        state.append(best)
    best[1], best[2] = frame, box
    return best[0]


def build_tracks(detections: DataFrame) -> DataFrame:
    """``detections`` with track, the det_seq of the track's first sighting.

    A sighting joins a track of its class and run at most two frames after the track's last. Where
    three frames or more pass without one, no track can cross, so such islands are separate groups
    and a run is never one task. Within an island sightings are taken in order. Rows keep all their
    columns on the way through the kernel, so nothing is joined back; rows without run_id or det_seq go.
    """
    keys = ["run_id", "cls"]
    w = Window.partitionBy(*keys).orderBy("frame_idx", "det_seq")
    gap = F.col("frame_idx") - F.lag("frame_idx").over(w)
    known = detections.filter("run_id is not null and det_seq is not null")
    split = _islands(known.withColumn("_gap", gap), keys, F.coalesce(F.col("_gap") > MAX_GAP, F.lit(True)), ["frame_idx", "det_seq"]).drop("_gap")
    columns = ["run_id", "det_seq", *[c for c in detections.columns if c not in ("run_id", "det_seq")]]
    schema = T.StructType([*detections.select(columns).schema, T.StructField("track", T.LongType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = [], None
        for batch in batches:
            tracks = []
            box = batch.column("box")
            corners = [pc.struct_field(box, c).to_pylist() for c in ("x1", "y1", "x2", "y2")]
            order = [batch.column(c).to_pylist() for c in ("run_id", "cls", "island", "frame_idx", "det_seq")]
            for run_id, cls, own, frame, seq, *xyxy in zip(*order, *corners, strict=True):
                if (run_id, cls, own) != last:
                    state, last = [], (run_id, cls, own)
                tracks.append(extend_tracks(state, frame, seq, xyxy))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(tracks, pa.int64())], [*columns, "track"])

    # islands follow each other in a task, so the kernel holds the open tracks of one
    dealt = split.repartition(*keys, "island").sortWithinPartitions(*keys, "island", "frame_idx", "det_seq")
    return dealt.mapInArrow(kernel, schema)


def _merge(rows: list[dict]) -> list[tuple[int, int, int]]:
    """Merge tracks of one island, first pair first, until none lie within the radius: (track, cluster, part)."""
    if len(rows) == 1:
        return [(rows[0]["track"], rows[0]["track"], 0)]
    rows = sorted(rows, key=lambda r: (r["t_first"], r["track"]))
    clusters = [[[r["track"]], list(r["lats"]), list(r["lons"])] for r in rows]
    radius = rows[0]["radius"]

    def median(values):
        s, m = sorted(values), len(values) // 2
        return s[m] if len(s) % 2 else (s[m - 1] + s[m]) / 2

    def near(a, b):
        p1, p2 = math.radians(a[0]), math.radians(b[0])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(h)) <= radius

    centre = [(median(c[1]), median(c[2])) for c in clusters]
    # Pairs before ``i`` have been found apart; a merge only changes pairs with the merged one.
    i = 0
    while i < len(clusters):
        j = next((j for j in range(i + 1, len(clusters)) if near(centre[i], centre[j])), None)
        if j is None:
            i += 1
            continue
        for part in range(3):
            clusters[i][part] += clusters[j][part]
        del clusters[j], centre[j]
        centre[i] = (median(clusters[i][1]), median(clusters[i][2]))
        first = next((e for e in range(i) if near(centre[e], centre[i])), None)
        if first is not None:
            i = first
    return [(track, c[0][0], n) for c in clusters for n, track in enumerate(c[0])]


def _merge_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tracks with their clusters, from islands that follow each other; one island is held at a time."""
    rows = (row for batch in batches for row in batch.to_pylist())
    held: list[tuple[int, int, int, int]] = []

    def packed() -> pa.RecordBatch:
        names = ("run_id", "track", "cluster", "part")
        out = pa.RecordBatch.from_pydict({n: pa.array([h[i] for h in held], pa.int64()) for i, n in enumerate(names)})
        held.clear()
        return out

    for (run_id, _, _), island in groupby(rows, key=lambda r: (r["run_id"], r["cls"], r["island"])):
        held += [(run_id, *x) for x in _merge(list(island))]
        if len(held) >= 4096:
            yield packed()
    yield packed()


def _placed_islands(placed: DataFrame, keys: list[str], low: str, high: str, gap: Column) -> DataFrame:
    """``island`` numbers within ``keys``: tracks ordered by ``low`` part where ``gap`` exceeds the radius."""
    w = Window.partitionBy(*keys).orderBy(low, "track")
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return _islands(placed.withColumn("_reach", reach), keys, F.coalesce(gap > F.col("radius"), F.lit(True)), [low, "track"]).drop("_reach")


def merge_tracks(tracked: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``tracked`` (with lat, lon, t_sec, track) with cluster and part, the order of merging.

    Clusters of a class merge while their median positions lie within the class's radius. A median
    lies between its members, and the distance between two places is at least that of their
    latitudes: tracks sorted by latitude and parted by more than the radius from all before them
    can never meet. Within such an island the same holds of longitudes, on the island's parallel
    farthest from the equator. Tracks without a position stay alone.
    """
    tracked = written(tracked, "tracked")
    tracks = tracked.groupBy("run_id", "cls", "track").agg(
        F.min("t_sec").alias("t_first"), F.min("lat").alias("lo"), F.max("lat").alias("hi"),
        F.min("lon").alias("west"), F.max("lon").alias("east"),
        F.array_sort(F.collect_list(F.struct("det_seq", "lat", "lon"))).alias("_at"),
    ).withColumns({"lats": F.col("_at.lat"), "lons": F.col("_at.lon")}).drop("_at")
    placed = tracks.filter("lo is not null").join(F.broadcast(taxonomy.select("cls", F.col("cluster_radius_m").alias("radius"))), "cls")
    south = _placed_islands(placed, ["run_id", "cls"], "lo", "hi", (F.col("lo") - F.col("_reach")) * SPHERE_M_PER_DEG)
    band = Window.partitionBy("run_id", "cls", "island")
    parallel = F.cos(F.radians(F.least(F.lit(90.0), F.max(F.greatest(F.abs("lo"), F.abs("hi"))).over(band))))
    wide = F.max("east").over(band) - F.min("west").over(band) >= 180  # across the antimeridian, perhaps
    banded = south.withColumn("_parallel", F.when(wide, 0.0).otherwise(parallel)).withColumnRenamed("island", "band")
    far = 2 * geo.EARTH_RADIUS_M * F.asin(F.col("_parallel") * F.sin(F.radians(F.col("west") - F.col("_reach")) / 2))
    islands = _placed_islands(banded, ["run_id", "cls", "band"], "west", "east", far)
    islands = islands.withColumn("island", F.struct("band", "island")).select("run_id", "cls", "island", "track", "t_first", "lats", "lons", "radius")
    dealt = islands.repartition("run_id", "cls", "island").sortWithinPartitions("run_id", "cls", "island")
    merged = dealt.mapInArrow(_merge_kernel, "run_id long, track long, cluster long, part long")
    return tracked.join(merged, ["run_id", "track"], "left").withColumns(
        {"cluster": F.coalesce("cluster", "track"), "part": F.coalesce("part", F.lit(0))}
    )


def triangulate(rays: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares meeting point of bearing rays (keys, lat, lon, bearing) of each group.

    Returns t_lat, t_lon, residual_m, parallax_deg, n_rays, with nulls for fewer than two rays,
    parallel ones, and points behind a camera. Most groups are single rays: nothing is summed for these.
    """
    groups = rays.groupBy(*keys).agg(
        F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"), F.count(F.lit(1)).alias("n_rays"),
        F.collect_list(F.struct("lat", "lon", "bearing")).alias("rays"),
    )
    groups = groups.withColumn("rays", F.when(F.col("n_rays") >= 2, F.col("rays")))
    lat0, lon0, listed = F.col("lat0"), F.col("lon0"), F.col("rays")
    ne, nn = (lambda r: F.cos(F.radians(r["bearing"]))), (lambda r: -F.sin(F.radians(r["bearing"])))
    e, n = (lambda r: geo.local_east(r["lon"], lat0, lon0)), (lambda r: geo.local_north(r["lat"], lat0))
    total = lambda f: F.aggregate(listed, F.lit(0.0), lambda acc, r: acc + f(r))
    offset = lambda r: ne(r) * e(r) + nn(r) * n(r)
    sums = groups.withColumns({
        "saa": total(lambda r: ne(r) * ne(r)), "sab": total(lambda r: ne(r) * nn(r)), "sbb": total(lambda r: nn(r) * nn(r)),
        "sac": total(lambda r: ne(r) * offset(r)), "sbc": total(lambda r: nn(r) * offset(r)),
    }).withColumn("det", F.col("saa") * F.col("sbb") - F.col("sab") * F.col("sab"))
    meets = (F.col("n_rays") >= 2) & (F.abs("det") >= 1e-9)
    solved = sums.withColumns({
        "east": F.when(meets, (F.col("sac") * F.col("sbb") - F.col("sbc") * F.col("sab")) / F.col("det")),
        "north": F.when(meets, (F.col("sbc") * F.col("saa") - F.col("sac") * F.col("sab")) / F.col("det")),
    })
    miss = lambda r: ne(r) * (F.col("east") - e(r)) + nn(r) * (F.col("north") - n(r))
    widest = F.array_max(F.flatten(F.transform(listed, lambda a: F.transform(listed, lambda b: geo.angle_between(a["bearing"], b["bearing"])))))
    fixed = solved.withColumns({
        "t_lat": geo.offset_lat(lat0, F.col("north")), "t_lon": geo.offset_lon(lat0, lon0, F.col("east")),
        "residual_m": F.sqrt(total(lambda r: miss(r) * miss(r)) / F.col("n_rays")), "parallax_deg": widest,
    })
    behind = F.exists(listed, lambda r: geo.ray_forward_m(r["lat"], r["lon"], r["bearing"], F.col("t_lat"), F.col("t_lon")) < 0)
    sound = F.col("east").isNotNull() & ~F.coalesce(behind, F.lit(False))
    # a column of its own: within lambdas a name may mean the new column of a select
    return fixed.withColumn("_sound", sound).select(
        *keys, "n_rays", *[F.when(F.col("_sound"), F.col(c)).alias(c) for c in ("t_lat", "t_lon", "residual_m", "parallax_deg")]
    )


def _median(listed: str) -> Column:
    """The median of an array's numbers, null where it has none."""
    n, s = F.size(F.array_compact(listed)), F.array_sort(F.array_compact(listed))
    at = lambda i: F.get(s, F.floor(i / 2).cast("int")).cast("double")
    return F.when(F.size(listed) == 1, F.get(listed, F.lit(0)).cast("double")).when(n > 0, (at(n - 1) + at(n)) / 2)


def roll_up(clustered: DataFrame, taxonomy: DataFrame, fixes: DataFrame | None = None, min_parallax_deg: float = 8.0, max_residual_m: float = 4.0) -> DataFrame:
    """Findings from clustered sightings.

    Position is the median, severity the half-even median, confidence the mean scaled by how many
    sightings agree. A triangulated fix that is wide and close enough takes the position's place.
    ``evidence`` lists sightings in track order. Ids count findings of a run by the time of the
    first sighting, then class and track.
    """
    # one list for each cluster: most hold a single sighting, whose medians need no sorting
    fields = ["part", "frame_idx", "det_seq", "frame_id", "box", "severity", "confidence", "lat", "lon", "range_m"]
    listed = clustered.groupBy("run_id", "cls", "cluster").agg(F.collect_list(F.struct(*fields, "t_sec")).alias("_all"))
    one = F.size("_all") == 1
    listed = listed.withColumn("_all", F.when(one, F.col("_all")).otherwise(F.array_sort("_all")))
    conf = F.array_compact("_all.confidence")
    mean = F.when(one, F.get("_all.confidence", F.lit(0))).when(F.size(conf) > 0, F.aggregate(conf, F.lit(0.0), lambda a, x: a + x) / F.size(conf))
    found = listed.select(
        "run_id", "cls", "cluster", _median("_all.lat").alias("m_lat"), _median("_all.lon").alias("m_lon"), F.bround(_median("_all.severity"), 0).cast("int").alias("severity"),
        mean.alias("mean_conf"), F.size("_all").cast("long").alias("n_evidence"), F.array_min("_all.t_sec").alias("t_sec"), F.get("_all.t_sec", F.lit(0)).alias("t_first"),
        F.transform("_all", lambda x: x.dropFields("t_sec")).alias("evidence"),
    )
    if fixes is None:
        nulls = {c: F.lit(None).cast("double") for c in ("t_lat", "t_lon", "residual_m", "parallax_deg")}
        found = found.withColumns(nulls | {"n_rays": F.lit(0).cast("long")})
    else:
        found = found.join(fixes, ["run_id", "cls", "cluster"], "left")
    fixed = F.col("t_lat").isNotNull()
    good = F.coalesce((F.col("parallax_deg") >= min_parallax_deg) & (F.round("residual_m", 2) >= 0) & (F.col("residual_m") <= max_residual_m), F.lit(False))
    agreed = F.col("mean_conf") * F.least(F.lit(1.0), 0.75 + 0.08 * (F.col("n_evidence") - 1))
    sure = F.when(good & (F.round("residual_m", 2) < 1.0), F.least(F.lit(0.99), agreed * 1.10)).otherwise(agreed)
    names = taxonomy.select("cls", "label", "geometry", F.col("ord").alias("_ord"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("t_first", "_ord", "cls", "cluster")) - 1
    return found.join(F.broadcast(names), "cls", "left").select(
        "run_id", F.concat(F.lit("f-"), F.lpad(rank.cast("string"), 4, "0")).alias("finding_id"), "cls",
        F.coalesce("label", F.initcap(F.replace("cls", F.lit("_"), F.lit(" ")))).alias("label"), F.coalesce("geometry", F.lit("point")).alias("geometry"),
        F.when(good, F.col("t_lat")).otherwise(F.col("m_lat")).alias("lat"), F.when(good, F.col("t_lon")).otherwise(F.col("m_lon")).alias("lon"),
        "severity", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 3).alias("confidence"), "t_sec", "n_evidence",
        F.when(good, "triangulated").when(F.col("m_lat").isNull(), "camera").otherwise("ground_plane").alias("pos_method"),
        F.round("residual_m", 2).alias("pos_residual_m"), F.when(fixed, F.col("n_rays")).otherwise(0).alias("n_rays"),
        F.round("parallax_deg", 2).alias("parallax_deg"), "evidence",
    )


def cluster_detections(localized: DataFrame, frames: DataFrame, taxonomy: DataFrame, camera: dict[str, float] | None = None) -> DataFrame:
    """Findings of all runs from localized detections; those of unknown frames drop out here."""
    place = frames.select(
        "run_id", "frame_id", "frame_idx", "t_sec", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"), "heading_deg", "width", "height"
    )
    seen = localized.drop("frame_idx", "t_sec").join(place, ["run_id", "frame_id"])
    clustered = written(merge_tracks(build_tracks(seen), taxonomy), "clustered")
    fixes = None
    if camera:
        vfov = camera_columns(camera)["vfov_deg"]
        rays = clustered.withColumn("bearing", geo.bearing_to_box(F.col("box"), F.col("width"), F.col("height"), vfov, F.col("heading_deg")))
        rays = rays.select("run_id", "cls", "cluster", F.col("f_lat").alias("lat"), F.col("f_lon").alias("lon"), "bearing")
        fixes = triangulate(rays, ["run_id", "cls", "cluster"])
    return roll_up(clustered, taxonomy, fixes)


def best_sighting(evidence: Column) -> Column:
    """The sighting with the largest box, the first of equal ones."""
    areas = F.transform(evidence, lambda d: boxes.area(d["box"]))
    return F.get(evidence, (F.array_position(areas, F.array_max(areas)) - 1).cast("int"))


def unnest_evidence(findings: DataFrame) -> DataFrame:
    return findings.select("run_id", "finding_id", "cls", F.posexplode("evidence").alias("position", "sighting")).select(
        "run_id", "finding_id", "cls", "position", "sighting.*"
    )


def predictions(detections: DataFrame, findings: DataFrame, source: str) -> DataFrame:
    """Boxes (run_id, frame_id, cls, box, confidence) to be scored: the ``detections``, or the evidence nested in ``findings``.

    Of evidence each sighting is a row, under the class of its finding. Sightings without a frame go.
    """
    if source not in ("detections", "findings"):
        raise ValueError(f"no source {source!r}; there are detections and findings")
    rows = detections if source == "detections" else unnest_evidence(findings)
    return rows.filter("frame_id is not null").select("run_id", "frame_id", "cls", "box", "confidence")
