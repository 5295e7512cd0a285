"""Waveform analysis of long recordings: detect, window, parameterise.

A recording is a table of chunks, ``(recording_id, fs, chunk_id, sample_offset, samples)``. Every chunk
is completed by a halo from its neighbours, so detection and features run chunk by chunk and a
recording may be of any length; an event belongs to the chunk that holds its peak.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SpikeConfig
from ..functions import signals
from ..functions.spikefit import FEATURES, POINTS, waveform_features
from ..scratch import materialize
from .ranges import range_join


def with_halo(chunks: DataFrame, halo: int) -> DataFrame:
    """Add ``before`` and ``after``: the last and first ``halo`` samples of the neighbouring chunks.

    Repeated chunks count once (the one that arrived last where ``arrived_at`` exists); null samples are empty.
    """
    order = [F.col("arrived_at").desc()] if "arrived_at" in chunks.columns else [F.lit(1)]
    first = Window.partitionBy("recording_id", "chunk_id").orderBy(*order)
    c = chunks.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("recording_id", "fs", "chunk_id", "sample_offset", F.coalesce("samples", F.array().cast("array<double>")).alias("samples"))
    head, tail = F.slice("samples", 1, halo), F.when(F.size("samples") > halo, F.slice("samples", -halo, halo)).otherwise(F.col("samples"))
    c = materialize(c, "chunks")
    # neighbours meet at the sample where one ends and the other begins: an equality join of edges, no sort of a recording
    full = c.filter(F.size("samples") > 0)
    ends = full.select("recording_id", (F.col("sample_offset") + F.size("samples")).alias("sample_offset"), tail.alias("before")).dropDuplicates(["recording_id", "sample_offset"])
    starts = full.select("recording_id", F.col("sample_offset").alias("_end"), head.alias("after")).dropDuplicates(["recording_id", "_end"])
    c = c.withColumn("_end", F.col("sample_offset") + F.size("samples"))
    c = c.join(ends, ["recording_id", "sample_offset"], "left").join(starts, ["recording_id", "_end"], "left")
    none = F.array().cast("array<double>")
    return c.select("recording_id", "fs", "chunk_id", "sample_offset", "samples", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))


def _detect_chunk(x: np.ndarray, own: tuple[int, int], fs: float, c: SpikeConfig) -> np.ndarray:
    x = -x if c.flip else x
    at = signals.find_peaks(x, c.threshold, c.distance(fs))
    pad = (int(sum(c.window_ms) * fs / 1000) + 1) // 5
    at = signals.recentre(x, at, pad)
    return at[(at >= own[0]) & (at < own[1])]


def detect(chunks: DataFrame, config: SpikeConfig = SpikeConfig(), halo: int | None = None) -> DataFrame:
    """(recording_id, fs, sample_idx, t_us, wf): events whose whole window lies inside the recording."""
    halo = halo or 4096
    schema = "recording_id string, fs double, sample_idx long, t_us long, wf array<double>"

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("recording_id", "fs", "sample_idx", "t_us", "wf")}
            for r in b.to_pylist():
                pre = len(r["before"])
                x = np.array([*r["before"], *r["samples"], *r["after"]], float)
                before, after = config.samples(r["fs"])
                for i in _detect_chunk(x, (pre, pre + len(r["samples"])), r["fs"], config):
                    if i < before or i + after + 1 > len(x):
                        continue
                    at = r["sample_offset"] + int(i) - pre
                    w = x[i - before : i + after + 1]
                    for k, v in zip(out, (r["recording_id"], r["fs"], at, round(at / r["fs"] * 1e6), (-w if config.flip else w).tolist())):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("recording_id", pa.string()), ("fs", pa.float64()), ("sample_idx", pa.int64()), ("t_us", pa.int64()), ("wf", pa.list_(pa.float64()))]))

    return with_halo(chunks, halo).mapInArrow(run, schema)


def correlated(events: DataFrame, threshold: float) -> DataFrame:
    """Events whose window correlates above ``threshold`` with the other windows of its recording on average.

    The correlations of a window with all n windows add up to its product with the sum of the standardised
    windows, so no pair is formed. Constant windows correlate with none; a recording's only event is dropped.
    """
    mean = F.aggregate("wf", F.lit(0.0), lambda a, v: a + v) / F.size("wf")
    centred = events.withColumn("_m", mean).withColumn("_c", F.transform("wf", lambda v: v - F.col("_m")))
    z = centred.withColumn("_n", F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, v: a + v * v))).withColumn("_z", F.when(F.col("_n") > 0, F.transform("_c", lambda v: v / F.col("_n"))))
    part = z.filter("_z is not null").select("recording_id", F.posexplode("_z").alias("_p", "_v")).groupBy("recording_id", "_p").agg(F.sum("_v").alias("_s"), F.count(F.lit(1)).alias("_k"))
    total = part.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_s"))), lambda x: x["_s"]).alias("_t"), F.max("_k").alias("_k"))
    j = z.join(total, "recording_id").withColumn("_d", F.aggregate(F.zip_with("_z", "_t", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v))
    return j.filter((F.col("_k") > 1) & ((F.col("_d") - 1) / (F.col("_k") - 1) > threshold)).select(*events.columns)


def other_signal(events: DataFrame, chunks: DataFrame, ref: str = "peak", window_ms: tuple[float, float] = (10.0, 10.0), bucket: int = 1 << 14, halo: int = 4096) -> DataFrame:
    """(recording_id, fs, sample_idx, wf): windows of a second signal around a control point of each event.

    ``events`` has fs, sample_idx and the column ``ref`` (a sample of the first signal); ``chunks`` the second signal
    under the same recording_id, of any rate. Points are rescaled to that rate. Events without the point, or whose
    window leaves the second signal, are left out. A window side must not be longer than ``halo``.
    """
    second = with_halo(chunks, halo).withColumn("_end", F.col("sample_offset") + F.size("samples")).withColumnRenamed("fs", "_fs2").withColumnRenamed("sample_offset", "_off")
    rate = chunks.groupBy("recording_id").agg(F.max("fs").alias("_rate"))
    at = events.filter(F.col(ref).isNotNull()).select("recording_id", F.col("fs").alias("_fs1"), "sample_idx", F.col(ref).alias("_ref")).join(rate, "recording_id")
    at = at.withColumn("_at", (F.col("_ref") / F.col("_fs1") * F.col("_rate")).cast("long"))
    j = range_join(at, second, "recording_id", "_at", "_off", "_end", bucket)
    side = [F.floor(F.lit(w) * F.col("_fs2") / 1000).cast("int") for w in window_ms]
    start = F.size("before") + (F.col("_at") - F.col("_off")).cast("int") - side[0]
    whole = F.concat("before", "samples", "after")
    j = j.withColumn("_x", whole).withColumn("_s", start).filter((F.col("_s") >= 0) & (F.col("_s") + side[0] + side[1] + 1 <= F.size("_x")))
    return j.select("recording_id", F.col("_fs2").alias("fs"), "sample_idx", F.slice("_x", F.col("_s") + 1, side[0] + side[1] + 1).alias("wf"))


def features(events: DataFrame, config: SpikeConfig = SpikeConfig()) -> DataFrame:
    """Add control points (absolute samples) and features to detected events; null where a waveform has none."""
    schema = "recording_id string, fs double, sample_idx long, t_us long, " + ", ".join(f"{p} long" for p in POINTS) + ", " + ", ".join(f"{f} double" for f in FEATURES)

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                got = waveform_features(np.array(r["wf"]), r["fs"], config)
                shift = r["sample_idx"] - config.samples(r["fs"])[0]
                points = {k: v + shift for k, v in got[0].items()} if got else dict.fromkeys(POINTS)
                values = {k: v if np.isfinite(v) else None for k, v in got[1].items()} if got else dict.fromkeys(FEATURES)
                rows.append({k: r[k] for k in ("recording_id", "fs", "sample_idx", "t_us")} | points | values)
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return events.select("recording_id", "fs", "sample_idx", "t_us", "wf").mapInArrow(run, schema)


_SCHEMA = pa.schema([("recording_id", pa.string()), ("fs", pa.float64()), ("sample_idx", pa.int64()), ("t_us", pa.int64()), *((p, pa.int64()) for p in POINTS), *((f, pa.float64()) for f in FEATURES)])


def inter_event(df: DataFrame, windows_ms: tuple[int, ...] = (50, 200)) -> DataFrame:
    """Add isi, isi_prev (ms) and the numbers of events in the preceding windows."""
    from .inter_event import count_preceding, isi_next, isi_prev, ordered

    w = ordered("recording_id", "t_us")
    return df.withColumns({"isi": isi_next("t_us", w), "isi_prev": isi_prev("t_us", w), **{f"n_spikes_{m}ms": count_preceding("t_us", "recording_id", m * 1000) for m in windows_ms}})


def fit(chunks: DataFrame, config: SpikeConfig = SpikeConfig()) -> DataFrame:
    """Detection, features and inter-event features in one table, one row per event; windows unlike the others are dropped where asked."""
    found = detect(chunks, config)
    if config.corr_threshold is not None:
        found = correlated(found, config.corr_threshold)
    return inter_event(features(found, config))


def quality_filter(df: DataFrame, least_inflection_ms: float = 0.0, r2_ramp: float = 0.5, r2_exp: float = 0.5, most_width_ms: float = 10.0) -> DataFrame:
    """Events whose inflection time is larger, whose width is at most, and whose fits are at least the bounds."""
    return df.filter((F.col("inflection_time") > least_inflection_ms) & (F.col("peak_width") <= most_width_ms) & (F.col("r2_ramp") >= r2_ramp) & (F.col("r2_exp") >= r2_exp))


def process(df: DataFrame) -> DataFrame:
    """log10 of both intervals instead of the intervals; fit qualities dropped."""
    log = lambda c: F.when(F.col(c) > 0, F.log10(c))
    return df.withColumns({"log_isi": log("isi"), "log_isi_prev": log("isi_prev")}).drop("isi", "isi_prev", "r2_ramp", "r2_exp")


def alt(events: DataFrame, func: Callable, names: list[str], column: str = "wf", errors: bool = False) -> DataFrame:
    """Apply ``func(window, fs)`` to each event's window; its value or values become the double columns ``names``.

    An error or a wrong number of values gives nulls, and its text in the column ``alt_error`` where ``errors`` is set.
    """
    keep = [c for c in events.columns if c != column]
    base = events.select(*keep, column)

    def run(batches):
        for b in batches:
            got, said = [], []
            for w, fs in zip(b.column(column).to_pylist(), b.column("fs").to_pylist()):
                try:
                    v = np.atleast_1d(np.asarray(func(np.array(w, float), fs), float)).tolist()
                    said.append(None if len(v) == len(names) else f"{len(v)} values for {len(names)} names")
                except Exception as e:  # the user's function may raise anything
                    v = []
                    said.append(f"{type(e).__name__}: {e}")
                got.append([x if x == x else None for x in v] if len(v) == len(names) else [None] * len(names))
            cols = [b.column(c) for c in keep] + [pa.array([g[i] for g in got], pa.float64()) for i in range(len(names))]
            more = [pa.array(said, pa.string())] if errors else []
            yield pa.RecordBatch.from_arrays([*cols, *more], names=[*keep, *names, *(["alt_error"] if errors else [])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != column)
    return base.mapInArrow(run, schema + ", " + ", ".join(f"`{n}` double" for n in names) + (", alt_error string" if errors else ""))


def write_recording(spark, recording_id: str, x: np.ndarray, fs: float, chunk: int) -> DataFrame:
    """A signal held in memory as a table of chunks (tests and small files)."""
    rows = [(recording_id, float(fs), k, a, [float(v) for v in x[a : a + chunk]]) for k, a in enumerate(range(0, len(x), chunk))]
    return spark.createDataFrame(rows, "recording_id string, fs double, chunk_id int, sample_offset long, samples array<double>")
