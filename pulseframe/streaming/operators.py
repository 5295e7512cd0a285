"""Structured Streaming forms of the operators; each agrees with its batch form on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import IntervalMap


def tumbling(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts and mean value per window and key, within a watermark."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "mean")


def sliding(stream: DataFrame, time: str, width: str, step: str, late: str, *keys: str) -> DataFrame:
    w = stream.withWatermark(time, late).groupBy(F.window(time, width, step), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "mean")


def sessions(stream: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Bursts of activity: sessions that end after a gap."""
    w = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def refractory(stream: DataFrame, key: str, gap_us: int) -> DataFrame:
    """Events of (key, us) at least ``gap_us`` after the last kept one of their key, in order of arrival time."""

    def keep(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("us", kind="stable")
        out = []
        for us in rows["us"].tolist():
            if last is None or us - last >= gap_us:
                out.append(us)
                last = us
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), "us": out}).astype({"us": "int64"})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, "us").groupBy(key).applyInPandasWithState(keep, f"{key} {kind}, us long", "last long", "append", GroupStateTimeout.NoTimeout)


def interval_union(stream: DataFrame, key: str) -> DataFrame:
    """Merged periods and gaps of (key, start, end) intervals, kept as an ordered disjoint map per key.

    Update mode: after every batch the whole current list of the keys it touched, with its version.
    Intervals may come in any order; unusable ones (missing bound, end not after start) change nothing.
    """

    def insert(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends, version = state.get if state.exists else ([], [], 0)
        held = IntervalMap(starts, ends)
        for pdf in parts:
            ok = pdf.dropna(subset=["start", "end"])
            for s, e in zip(ok["start"].tolist(), ok["end"].tolist()):
                if e > s:
                    held.insert(int(s), int(e))
        version += 1
        state.update((held.starts, held.ends, version))
        rows = [("period", *p) for p in held.periods()] + [("gap", *g) for g in held.gaps()]
        yield pd.DataFrame({key: [k[0]] * len(rows), "seg_kind": [r[0] for r in rows], "start": [r[1] for r in rows], "end": [r[2] for r in rows], "version": [version] * len(rows)}).astype({"start": "int64", "end": "int64", "version": "int64"})

    out = f"{key} string, seg_kind string, start long, end long, version long"
    return stream.select(F.col(key).cast("string").alias(key), "start", "end").groupBy(key).applyInPandasWithState(insert, out, "starts array<long>, ends array<long>, version long", "update", GroupStateTimeout.NoTimeout)
