"""Track identities over frames: reconnection, line crossings, predicted crossings.

A video is one sequential state machine, so the unit of parallel work is the
video, or with eviction a segment of it: after a pause longer than the reconnect
window nothing old can be reconnected, and segments are independent.
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.names import lookup
from ..functions.ordering import previous_by_order

# fixed values: labels of one family
FAMILIES = {
    "car_like": ("ambulance", "car", "minivan", "pickup", "policecar", "suv", "taxi", "van"),
    "large_vehicle": ("army vehicle", "bus", "garbagevan", "human hauler", "minibus", "truck"),
    "two_wheeler": ("bicycle", "motorbike", "scooter"),
    "three_wheeler": ("auto rickshaw", "rickshaw", "three wheelers -cng-"),
}
FAMILY_OF = {name: family for family, names in FAMILIES.items() for name in names}

OUT_SCHEMA = (
    "video_id string, frame bigint, display_id bigint, raw_track_id bigint, class_name string, cx double, cy double, "
    "kind string, crossed boolean, reconnected boolean, count bigint"
)
COLUMNS = ["video_id", "frame", "raw_track_id", "class_name", "cx", "cy", "width", "height"]


@dataclass(frozen=True)
class TrackRules:
    line: float
    vertical: bool = True
    window: int = 90
    distance: float = 180.0
    min_ratio: float = 0.35
    max_ratio: float = 3.0
    predict: bool = True
    evict: bool = False


def class_family(name: Column) -> Column:
    return lookup(FAMILY_OF, F.lower(F.trim(name)))


def crosses(before: float, now: float, line: float) -> bool:
    return before < line <= now or now <= line < before


class Tracks:
    """State of one video: ``tracks`` by display number, ``alias`` from a raw number to it, the next number and the count."""

    def __init__(self, rules: TrackRules, next_number: int = 1, count: int = 0) -> None:
        self.rules = rules
        self.next, self.count = next_number, count
        self.alias: dict[int, int] = {}
        self.tracks: dict[int, dict] = {}

    def _axis(self, x: float, y: float) -> float:
        return x if self.rules.vertical else y

    @staticmethod
    def _expected(t: dict, frame: int) -> tuple[float, float]:
        if t["before"] is None:
            return t["x"], t["y"]
        f0, x0, y0 = t["before"]
        steps = max(frame - t["frame"], 0) / max(t["frame"] - f0, 1)
        return t["x"] + (t["x"] - x0) * steps, t["y"] + (t["y"] - y0) * steps

    def _lost_match(self, d: dict, frame: int, active: set[int], present: set[int]) -> int | None:
        r, found = self.rules, []
        area = max(d["width"] * d["height"], 1.0)
        for number, t in self.tracks.items():
            gap = frame - t["frame"]
            ratio = area / max(t["w"] * t["h"], 1.0)
            if number in active or t["raw"] in present or not 0 < gap <= r.window or t["family"] != d["family"] or not r.min_ratio <= ratio <= r.max_ratio:
                continue
            x, y = self._expected(t, frame)
            away = math.hypot(d["cx"] - x, d["cy"] - y)
            reach = r.distance + 0.5 * max(d["width"], d["height"], t["w"], t["h"])
            if away <= reach:
                found.append((away / max(reach, 1.0) + 0.01 * gap, len(found), number))
        return min(found)[2] if found else None

    def _fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def frame(self, frame: int, detections: list[dict]) -> Iterator[dict]:
        """Advance by one frame; yields a row per detection and per predicted crossing."""
        r = self.rules
        if r.evict:
            self.tracks = {k: t for k, t in self.tracks.items() if frame - t["frame"] <= r.window}
            self.alias = {raw: k for raw, k in self.alias.items() if k in self.tracks}
        present, active = {d["raw"] for d in detections}, set()
        for d in detections:
            number, again = self.alias.get(d["raw"]), False
            if number is None:
                number = self._lost_match(d, frame, active, present)
                again = number is not None
                number = number if again else self._fresh()
            elif number in active:
                number = self._fresh()
            self.alias[d["raw"]] = number
            t, hit = self.tracks.get(number), False
            if t and not t["counted"] and crosses(self._axis(t["x"], t["y"]), self._axis(d["cx"], d["cy"]), r.line):
                hit = True
                self.count += 1
            self.tracks[number] = {
                "raw": d["raw"], "family": d["family"], "frame": frame, "x": d["cx"], "y": d["cy"], "w": d["width"], "h": d["height"],
                "before": [t["frame"], t["x"], t["y"]] if t else None, "counted": hit or bool(t and t["counted"]), "class": d["class_name"],
            }
            active.add(number)
            yield self._row(frame, number, d["raw"], d["class_name"], d["cx"], d["cy"], "seen", hit, again)
        if not r.predict:
            return
        for number, t in self.tracks.items():
            if number in active or t["counted"] or t["before"] is None or not 0 < frame - t["frame"] <= r.window:
                continue
            x, y = self._expected(t, frame)
            if crosses(self._axis(t["x"], t["y"]), self._axis(x, y), r.line):
                t["counted"] = True
                self.count += 1
                yield self._row(frame, number, t["raw"], t["class"], x, y, "predicted", True, False)

    def _row(self, frame, number, raw, name, x, y, kind, crossed, again) -> dict:
        return {
            "frame": frame, "display_id": number, "raw_track_id": raw, "class_name": name, "cx": x, "cy": y, "kind": kind,
            "crossed": crossed, "reconnected": again, "count": self.count,
        }


def _detections(rows: Iterable) -> list[dict]:
    out = []
    for r in rows:
        name = str(r.class_name)
        out.append({
            "raw": int(r.raw_track_id), "class_name": name, "family": FAMILY_OF.get(name.strip().lower(), name.strip().lower()),
            "cx": float(r.cx), "cy": float(r.cy), "width": float(r.width), "height": float(r.height),
        })
    return out


def _frame(video: str, rows: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUT_SCHEMA.split(", ")]
    return pd.DataFrame([{"video_id": video, **r} for r in rows], columns=names)


def _segments(detections: DataFrame, window: int) -> DataFrame:
    """Number of the segment per (video, block of frames): a new one after a pause longer than the window.

    Within a block of ``window`` frames no such pause fits, so only the least and
    greatest frame of each block are looked at.
    """
    blocks = detections.groupBy("video_id", F.expr(f"frame div {window}").alias("block")).agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    order = Window.partitionBy("video_id").orderBy("block")  # one row per block
    start = F.coalesce(F.col("a") - F.lag("b").over(order) > window, F.lit(False)).cast("int")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("s", start).select("video_id", "block", F.sum("s").over(running).cast("bigint").alias("segment"))


def track_reconnect(detections: DataFrame, rules: TrackRules) -> DataFrame:
    """Batch form.  Rows are sorted inside partitions and streamed through the state
    machine batch by batch, so memory holds the live tracks and not the video."""
    rows = detections.select(*[F.col(c) for c in COLUMNS]).withColumn("video_id", F.col("video_id").cast("string"))
    if rules.evict:
        rows = rows.withColumn("block", F.expr(f"frame div {rules.window}")).join(_segments(rows, rules.window), ["video_id", "block"]).drop("block")
    else:
        rows = rows.withColumn("segment", F.lit(0).cast("bigint"))
    ordered = rows.repartition("video_id", "segment").sortWithinPartitions("video_id", "segment", "frame", "raw_track_id")

    names = [c.split()[0] for c in OUT_SCHEMA.split(", ")] + ["segment"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, number, held, state, out = None, None, [], None, []

        def close() -> None:
            for row in state.frame(number, _detections(held)) if held else ():
                out.append({"video_id": key[0], "segment": key[1], **row})

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if (r.video_id, r.segment) != key or r.frame != number:
                    close()
                    held = []
                    if (r.video_id, r.segment) != key:
                        key, state = (r.video_id, r.segment), Tracks(rules)
                    number = int(r.frame)
                held.append(r)
            if out:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        close()
        if out:
            yield pd.DataFrame(out, columns=names)

    tracked = ordered.mapInPandas(run, OUT_SCHEMA + ", segment bigint")
    if not rules.evict:
        return tracked.drop("segment")
    # display numbers and counts go on from segment to segment
    ends = tracked.groupBy("video_id", "segment").agg(F.max("display_id").alias("ids"), F.max("count").alias("n"))
    before = Window.partitionBy("video_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # one row per segment
    offsets = ends.select(
        "video_id", "segment", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0")
    )
    joined = tracked.join(offsets, ["video_id", "segment"])
    return joined.withColumn("display_id", F.col("display_id") + F.col("ids0")).withColumn("count", F.col("count") + F.col("n0")).drop("segment", "ids0", "n0")


def closing_mark(detections: DataFrame, time_col: str, delay: str) -> DataFrame:
    """One row without a video that follows the last detection: it moves the watermark past
    every frame, so that a stream that has ended gives all its rows."""
    last = detections.agg(F.max(time_col).alias("last"))
    after = F.col("last") + F.expr(f"interval {delay}") + F.expr("interval 1 minute")
    return last.select(*[(after if f.name == time_col else F.lit(None)).cast(f.dataType).alias(f.name) for f in detections.schema])


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRACK = "raw bigint, family string, frame bigint, x double, y double, w double, h double, before_frame bigint, before_x double, before_y double, counted boolean, class string"
WAITING = "frame bigint, raw_track_id bigint, class_name string, cx double, cy double, width double, height double, at bigint"
DETECTION = namedtuple("DETECTION", [c.split()[0] for c in WAITING.split(", ")])


class TrackProcessor(StatefulProcessor):
    """The state machine of a video on Spark's own state variables.

    A map holds a row per live track, another one the raw numbers' aliases, a list
    the rows whose frames the watermark has not passed, and a value the next
    number and the count.  A trigger writes the tracks that changed and no others.
    A timer lets out the next frame; with ``idle_ms`` another one drops the tracks
    of a video that has been silent for so long, but not its numbers.
    """

    def __init__(self, rules: TrackRules, idle_ms: int | None) -> None:
        self.rules, self.idle_ms = rules, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "next bigint, count bigint, last bigint")
        self.tracks = handle.getMapState("tracks", "number bigint", TRACK)
        self.alias = handle.getMapState("alias", "raw bigint", "number bigint")
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues):
        if key[0] is None:  # closing marks only
            return
        new = []
        for pdf in rows:
            at = pdf["at"].map(lambda t: int(t.timestamp() * 1000))
            new += pdf.assign(at=at)[list(DETECTION._fields)].itertuples(index=False, name=None)
        new = [(int(f), int(raw), str(name), *map(float, numbers), at) for f, raw, name, *numbers, at in new]
        yield from self._advance(key[0], new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advance(key[0], [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, video: str, new: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        """Take the new rows in, let out the frames that the watermark has passed, set the next timer."""
        held = [DETECTION(*r) for r in (*self.waiting.get(), *new)] if self.waiting.exists() else [DETECTION(*r) for r in new]
        frames: dict[int, list] = {}
        for row in sorted(held, key=lambda r: (r.frame, r.raw_track_id)):
            frames.setdefault(row.frame, []).append(row)
        latest = {number: max(r.at for r in group) for number, group in frames.items()}
        done = []
        for number in frames:
            if latest[number] > mark:
                break
            done.append(number)
        next_number, count, last = self.totals.get() if self.totals.exists() else (1, 0, 0)
        if done:
            state, was = self._load(next_number, count)
            made = [row for number in done for row in state.frame(number, _detections(frames.pop(number)))]
            self._store(state, was)
            next_number, count = state.next, state.count
            if made:
                yield _frame(video, made)
        last = max([last, *(r[-1] for r in new)])
        self.totals.update((next_number, count, last))
        left = [tuple(r) for group in frames.values() for r in group]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(max(latest[next(iter(frames))], mark + 1))
            return
        self.waiting.clear()
        if self.idle_ms is not None and self.tracks.exists():
            if mark >= last + self.idle_ms:
                self.tracks.clear()
                self.alias.clear()
            else:
                self.handle.registerTimer(last + self.idle_ms)

    def _load(self, next_number: int, count: int) -> tuple[Tracks, dict]:
        state = Tracks(self.rules, next_number, count)
        was = {int(k[0]): tuple(v) for k, v in self.tracks.iterator()} if self.tracks.exists() else {}
        names = [c.split()[0] for c in TRACK.split(", ")]
        for number in sorted(was):  # display numbers rise in the order in which tracks begin
            t = dict(zip(names, was[number], strict=True))
            seen = t.pop("before_frame"), t.pop("before_x"), t.pop("before_y")
            state.tracks[number] = t | {"before": list(seen) if seen[0] is not None else None}
        if self.alias.exists():
            state.alias = {int(k[0]): int(v[0]) for k, v in self.alias.iterator()}
        return state, {"tracks": was, "alias": dict(state.alias)}

    def _store(self, state: Tracks, was: dict) -> None:
        for number in was["tracks"].keys() - state.tracks.keys():
            self.tracks.removeKey((number,))
        for raw in was["alias"].keys() - state.alias.keys():
            self.alias.removeKey((raw,))
        for number, t in state.tracks.items():
            row = (t["raw"], t["family"], t["frame"], t["x"], t["y"], t["w"], t["h"], *(t["before"] or (None, None, None)), t["counted"], t["class"])
            if was["tracks"].get(number) != row:
                self.tracks.updateValue((number,), row)
        for raw, number in state.alias.items():
            if was["alias"].get(raw) != number:
                self.alias.updateValue((raw,), (number,))


def stream_track_reconnect(detections: DataFrame, rules: TrackRules, time_col: str, delay: str, idle_ms: int | None = None) -> DataFrame:
    """Streaming form: a frame waits in the state until the watermark has passed all its rows
    and those of the frames before it, so rows that come out of order within ``delay`` are
    sorted first and later ones are dropped.  A ``closing_mark`` at the end lets out the last frames.

    With ``rules.evict`` tracks older than the window leave the state.  With ``idle_ms``
    the tracks of a video without rows for so much event time leave it by a timer; the
    result is the batch's as long as that time is no less than the window's frames take.
    State variables need the RocksDB state store, which the session is set to.
    """
    detections.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    rows = detections.withWatermark(time_col, delay).select(*COLUMNS, F.col(time_col).alias("at")).withColumn("video_id", F.col("video_id").cast("string"))
    return rows.groupBy("video_id").transformWithStateInPandas(TrackProcessor(rules, idle_ms), OUT_SCHEMA, "append", "EventTime")


def line_crossings(tracked: DataFrame, keys: list[str], order: list[str], coordinate: str, line: float) -> DataFrame:
    """First crossing of the line per track (half-open rule): ``(keys, order)``.

    The position before is handed on from slice to slice of the order, so a track
    with very many positions is spread over all tasks.
    """
    placed = previous_by_order(tracked.select(*keys, *order, coordinate), keys, order, coordinate, "__p")
    now, was = F.col(coordinate), F.col("__p")
    hit = ((was < line) & (now >= line)) | ((now <= line) & (was > line))
    crossed = placed.filter(hit)
    return crossed.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__o")).select(*keys, "__o.*")


def frame_records(tracked: DataFrame) -> DataFrame:
    """Per frame the detections sorted by display id and the running count."""
    seen = F.when(F.col("kind") == "seen", F.struct("display_id", "class_name", "cx", "cy"))
    return tracked.groupBy("video_id", "frame").agg(F.array_sort(F.collect_list(seen)).alias("detections"), F.max("count").alias("count"))


def track_summary(tracked: DataFrame) -> DataFrame:
    """Totals per video; the crossed ids are the rows with ``crossed``."""
    return tracked.groupBy("video_id").agg(
        F.max("count").alias("total_crossed"), F.countDistinct("frame").alias("frames"), F.max("display_id").alias("tracks"),
        F.count_if(F.col("kind") == "predicted").alias("predicted"), F.count_if("reconnected").alias("reconnected"),
    )
