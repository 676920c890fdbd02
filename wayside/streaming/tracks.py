"""Tracks of a live stream of sightings: closed by event time, late rows set apart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayside.operators.findings import MAX_GAP, extend_tracks
from wayside.streaming import live

SEEN = "run_id long, kind string, frame long, seq long, x1 double, y1 double, x2 double, y2 double, ms long"
OPEN = "run_id long, kind string, first long, frame long, x1 double, y1 double, x2 double, y2 double, ms long, start_frame long, start_ms long"
OUT = "run_id long, kind string, late boolean, track long, first_frame long, last_frame long, start_ms long, end_ms long, det_seqs array<long>"


class ClosedTracks(StatefulProcessor):
    """Puts out tracks of a run's class once nothing can join them, and late rows at once, for the runs of a lane.

    Sightings wait until the watermark passes them and are then taken in order of frames, so rows out
    of order within the watermark's delay change nothing. Waiting sightings, open tracks and the numbers
    of their members are all the state there is.
    """

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", SEEN)
        self.open = handle.getListState("open", OPEN)
        self.members = handle.getListState("members", "run_id long, kind string, first long, seq long")

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs()
        seen = pd.concat(list(rows))
        seen = seen[seen["det_seq"].notna()].astype({"run_id": "int64", "frame_idx": "int64", "det_seq": "int64", "ms": "int64"})
        columns = ["run_id", "kind", "frame_idx", "det_seq", "x1", "y1", "x2", "y2", "ms"]
        late, in_time = [], []
        for r in zip(*[seen[c].tolist() for c in columns], strict=True):
            past = mark > 0 and r[8] <= mark  # 0 stands for no watermark yet
            (late if past else in_time).append(r)
        out = [(r[0], r[1], True, None, r[2], r[2], r[8], r[8], [r[3]]) for r in late]
        yield self.packed(out + self.advance(mark, in_time))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self.packed(self.advance(timerValues.getCurrentWatermarkInMs(), []))

    def advance(self, mark: int, fresh: list[tuple]) -> list[tuple]:
        """Take what the watermark has passed, in order, and close what can't go on."""
        waiting = [tuple(r) for r in self.waiting.get()] + fresh
        state: dict = {}
        for r in map(tuple, self.open.get()):
            state.setdefault(r[:2], {})[r[2]] = list(r[2:])
        members: dict = {}
        for run, kind, first, seq in map(tuple, self.members.get()):
            members.setdefault((run, kind, first), []).append(seq)
        done = []

        def close(own: tuple, tracks: list[int]) -> None:
            for first in tracks:
                _, frame, *_, ms, start_frame, start_ms = state[own].pop(first)
                done.append((*own, False, first, start_frame, frame, start_ms, ms, members.pop((*own, first))))

        for run, kind, frame, seq, *box, ms in sorted(r for r in waiting if r[8] <= mark):
            own = (run, kind)
            mine = state.setdefault(own, {})
            close(own, [first for first, t in mine.items() if frame - t[1] > MAX_GAP])
            tracks = [[first, t[1], tuple(t[2:6])] for first, t in mine.items()]
            first = extend_tracks(tracks, frame, seq, tuple(box))
            old = mine.get(first, [first, frame, *box, ms, frame, ms])
            mine[first] = [first, frame, *box, ms, *old[7:]]
            members.setdefault((*own, first), []).append(seq)
        for own, mine in state.items():
            close(own, [first for first, t in mine.items() if t[6] + self.quiet_ms < mark])
        still = [r for r in waiting if r[8] > mark]
        left = [(*own, *t) for own, mine in state.items() for t in mine.values()]
        self.keep(self.waiting, still)
        self.keep(self.open, left)
        self.keep(self.members, [(*k, seq) for k, own in members.items() for seq in own])
        self.wake([r[8] for r in still] + [t[8] + self.quiet_ms for t in left])
        return done

    @staticmethod
    def keep(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def wake(self, times: list[int]) -> None:
        """One timer at a time: for the next thing that the watermark will pass."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if times:
            self.handle.registerTimer(min(times) + 1)

    @staticmethod
    def packed(rows: list[tuple]) -> pd.DataFrame:
        names = ("run_id", "kind", "late", "track", "first_frame", "last_frame", "start_ms", "end_ms", "det_seqs")
        return pd.DataFrame(rows, columns=list(names)).astype({"run_id": "int64", "track": "Int64", "late": "bool"})


def closed_tracks(detections: DataFrame, delay: str, quiet: str) -> DataFrame:
    """The tracks of a stream of sightings (run_id, cls, frame_idx, det_seq, x1..y2, ts), each once, when it is closed.

    A track is the same as in ``findings.build_tracks`` over all sightings in time: it is put out when its run and
    class have gone on more than MAX_GAP frames, or when the watermark (the latest ``ts`` less ``delay``) is more than
    ``quiet`` past its last sighting; ``quiet`` has to be longer than MAX_GAP frames take. Sightings come in any order
    within ``delay``. Those that the watermark has passed when they come join no track: they are put out as rows with
    ``late`` true and no track. Rows without det_seq only move the watermark. Frames of a run rise with ``ts``.
    Returns run_id, cls, late, track (its first det_seq), first_frame, last_frame, start_ms, end_ms, det_seqs.
    """
    spark = detections.sparkSession
    quiet_ms = int(spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {quiet})").first()[0])
    marked = detections.withWatermark("ts", delay)
    # a column computed from ts carries no watermark, so late rows reach the processor instead of being dropped
    rows = marked.select("run_id", F.col("cls").alias("kind"), "frame_idx", "det_seq", "x1", "y1", "x2", "y2", F.unix_millis("ts").alias("ms"))
    # a row without a run, as a last sign of life has, goes to a lane like any other
    tracks = rows.withColumn("lane", live.lane("run_id", "kind")).groupBy("lane").transformWithStateInPandas(ClosedTracks(quiet_ms), OUT, "Append", "EventTime")
    return tracks.withColumnRenamed("kind", "cls")


def split_late(stream: DataFrame, path: str, log: str):
    """Write closed tracks and late rows as two tables, ``path``/late=false and ``path``/late=true. Returns the query."""
    return stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", log).partitionBy("late").format("parquet").option("path", path).start()


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """What ``split_late`` has written so far; a filter on ``late`` reads one table only."""
    return spark.read.schema(OUT.replace("kind", "cls")).parquet(path)
