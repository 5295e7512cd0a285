"""Queries of the core data-pipeline operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.drift import canonical_names, layout_changes, parse_lines, unified_table
from ..operators.faults import measurement_faults
from ..operators.grid import regular_grid
from ..operators.intervals import merge_intervals, micros
from ..scratch import folder, materialize

BURST_LISTS = ("high_bursts", "low_bursts", "rest_bursts")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous burst periods and the gaps between them, per recording and burst list."""
    rows = _burst_pieces(_table(spark, d, "burst_lists"))
    merged = merge_intervals(rows, "key", "s", "e")
    part = F.split("key", r"\|", 2)
    return merged.select(part[1].alias("recording_id"), part[0].alias("burst_list"), "seg_kind", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


def _burst_pieces(b: DataFrame) -> DataFrame:
    b = b.filter("recording_id is not null")
    lists = F.array(*[F.struct(F.lit(n).alias("burst_list"), F.col(n).alias("pieces")) for n in BURST_LISTS])
    long = b.select("recording_id", "time_unit", F.inline(lists)).select("recording_id", "burst_list", "time_unit", F.inline("pieces"))
    return long.select(F.concat_ws("|", "burst_list", "recording_id").alias("key"), micros(F.col("t_start"), F.col("time_unit")).alias("s"), micros(F.col("t_end"), F.col("time_unit")).alias("e"))


def p4_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same periods and gaps by a stream of pieces into keyed state, one ordered map per recording and list."""
    from ..streaming.operators import interval_union
    from .models import _drain

    pieces = _burst_pieces(_table(spark, d, "burst_lists"))
    src = folder(spark, "stream")
    pieces.write.parquet(src)
    seen = _drain(spark, interval_union(spark.readStream.schema(pieces.schema).parquet(src).select("key", F.col("s").alias("start"), F.col("e").alias("end")), "key"), "update")
    last = seen.groupBy("key").agg(F.max("version").alias("version"))
    part = F.split("key", r"\|", 2)
    return seen.join(last, ["key", "version"]).select(part[1].alias("recording_id"), part[0].alias("burst_list"), "seg_kind", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


P4_SQL = """
with x as (select recording_id, 'high_bursts' burst_list, time_unit, unnest(high_bursts) p from burst_lists
 union all select recording_id, 'low_bursts', time_unit, unnest(low_bursts) from burst_lists
 union all select recording_id, 'rest_bursts', time_unit, unnest(rest_bursts) from burst_lists),
u as (select *, case time_unit when 'ms' then 1e3 when 's' then 1e6 end f from x where p.t_start is not null and p.t_end is not null and not isnan(p.t_start) and not isnan(p.t_end)),
i as (select distinct recording_id, burst_list, cast(round(p.t_start * f) as bigint) s, cast(round(p.t_end * f) as bigint) e from u),
r as (select *, max(e) over (partition by recording_id, burst_list order by s, e rows between unbounded preceding and 1 preceding) reach from i where e > s),
g as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by recording_id, burst_list order by s, e rows unbounded preceding) island from r),
p as (select recording_id, burst_list, island, min(s) s, max(e) e from g group by all),
n as (select *, lag(e) over (partition by recording_id, burst_list order by s) pe from p)
select recording_id, burst_list, 'period' seg_kind, s start_us, e end_us from p
union all select recording_id, burst_list, 'gap', pe, s from n where pe is not null
"""


def _recording_spans(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "recordings").select(F.col("recording_id").alias("source"), "duration_ms").filter("source is not null").groupBy("source").agg(F.max("duration_ms").alias("duration_ms"))


def p5_series(spark: SparkSession, d: str) -> DataFrame:
    """Regular two-second series of log_isi and peak_amp_cluster for every recording with spikes."""
    spikes = _table(spark, d, "cluster_df").select(F.col("recording_id").alias("source"), F.col("spk_times_ms").alias("t"), "log_isi", "peak_amp_cluster")
    spans = _recording_spans(spark, d).join(spikes.select("source").distinct(), "source", "left_semi")
    label = F.lower(F.trim("peak_amp_cluster"))
    number = regular_grid(spikes.select("source", "t", F.col("log_isi").alias("v")), spans, 2000.0)
    labels = regular_grid(spikes.select("source", "t", F.when(label.isin("low", "mid", "high"), label).alias("v")), spans, 2000.0, kind="label")
    none = F.lit(None)
    out = lambda df, name, v, text: df.select(F.col("source").alias("recording_id"), F.lit(name).alias("series_name"), "slot_no", "status", v.alias("value"), text.alias("label"))
    return out(number, "log_isi", F.round("value", 5), none.cast("string")).unionByName(out(labels, "peak_amp_cluster", none.cast("double"), F.col("value")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_series(spark, d).filter("status != 'observed'").select("recording_id", "series_name", "slot_no")


P5_SQL = """
with r as (select recording_id, max(duration_ms) d from recordings where recording_id in (select recording_id from cluster_df) group by 1),
g as (select recording_id, series_name, unnest(range(0, cast(ceil(d / 2000) as bigint))) slot_no from r, (values ('log_isi'), ('peak_amp_cluster')) n(series_name)),
v as (select recording_id, 'log_isi' series_name, spk_times_ms t from cluster_df where log_isi is not null and not isnan(log_isi)
  union all select recording_id, 'peak_amp_cluster', spk_times_ms from cluster_df where lower(trim(peak_amp_cluster)) in ('low', 'mid', 'high')),
h as (select distinct v.recording_id, series_name, cast(floor(t / 2000) as bigint) slot_no from v join r using (recording_id) where t >= 0 and t < d and not isnan(t))
select recording_id, series_name, slot_no from g anti join h using (recording_id, series_name, slot_no)
"""


def _series_sql(name: str, value: str, test: str, number: bool) -> str:
    """One series by two as-of joins of the grid with the slots that hold readings."""
    closer = "case when z is null or m - a.t <= z.t - m then a.v else z.v end"
    linear = "case when z.t > a.t then a.v + (z.v - a.v) * ((m - a.t) / (z.t - a.t)) when a is not null and z is not null then a.v end"
    result = f"case when o then coalesce({linear}, {closer}) else {linear} end" if number else closer
    shown = f"round({result}, 5) as value, cast(null as varchar) as label" if number else f"cast(null as double) as value, {result} as label"
    return f"""select recording_id, '{name}' series_name, slot_no, case when o then 'observed' when ({result}) is not null then 'filled' else 'missing' end status, {shown} from (
 with r as (select recording_id, max(duration_ms) d from recordings where recording_id in (select recording_id from cluster_df) group by 1),
 x as (select c.recording_id, spk_times_ms t, {value} v, floor(spk_times_ms / 2000) s, (floor(spk_times_ms / 2000) + 0.5::double) * 2000 m from cluster_df c join r using (recording_id) where spk_times_ms >= 0 and not isnan(spk_times_ms) and spk_times_ms < d and {test}),
 h as (select recording_id, cast(s as bigint) s, min({{'t': t, 'v': v}}) lo, max({{'t': t, 'v': v}}) hi, max({{'t': t, 'v': v}}) filter (where t <= m) b, min({{'t': t, 'v': v}}) filter (where t >= m) f from x group by 1, 2),
 g as (select recording_id, unnest(range(0, cast(ceil(d / 2000) as bigint))) slot_no from r)
 select g.recording_id, slot_no, (slot_no + 0.5::double) * 2000 m, h.s is not null o,
  case when h.s is not null then h.b when slot_no - p.s <= 5 then p.hi end a, case when h.s is not null then h.f when n.s - slot_no <= 5 then n.lo end z
 from g left join h on h.recording_id = g.recording_id and h.s = slot_no
 asof left join h p on p.recording_id = g.recording_id and p.s < slot_no
 asof left join h n on n.recording_id = g.recording_id and n.s > slot_no)"""


P5_SERIES_SQL = _series_sql("log_isi", "log_isi", "log_isi is not null and not isnan(log_isi)", True) + " union all " + _series_sql("peak_amp_cluster", "lower(trim(peak_amp_cluster))", "lower(trim(peak_amp_cluster)) in ('low', 'mid', 'high')", False)


def _export_lines(spark: SparkSession, d: str) -> DataFrame:
    return materialize(parse_lines(_table(spark, d, "cluster_exports")), "lines")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of layout between successive versions of a recording's export."""
    return layout_changes(_export_lines(spark, d)).drop("conversion")


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    """All readable export lines as one table under canonical field names."""
    lines = _export_lines(spark, d)
    t = unified_table(lines, canonical_names(materialize(layout_changes(lines), "changes"), lines))
    return t.withColumn("conflicts", F.to_json("conflicts"))


P7_FIELDS = {"peak_amp": "value", "peak_width": "positive", "exp_lambda": "positive", "spk_times_ms": "time"}


def p7_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every faulty reading with the kind of its fault."""
    spikes = _table(spark, d, "cluster_df").select(F.col("recording_id").alias("source"), F.col("spk_id").alias("id"), *P7_FIELDS)
    spans = _table(spark, d, "recordings").select(F.col("recording_id").alias("source"), F.col("duration_ms").alias("duration"))
    return measurement_faults(spikes, P7_FIELDS, spans).withColumnRenamed("id", "spk_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_faults(spark, d).select("spk_id", "field_name")


def queries() -> dict:
    return {"p3_found": p3_found, "p3_table": p3_table, "p4_found": p4_found, "p4_stream": p4_stream, "p5_found": p5_found, "p5_series": p5_series, "p7_found": p7_found, "p7_faults": p7_faults}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p4_stream": P4_SQL, "p5_found": P5_SQL, "p5_series": P5_SERIES_SQL}
