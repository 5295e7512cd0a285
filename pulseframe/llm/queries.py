"""Queries of the llm operators over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import similarity_groups
from .leaks import find_leaks
from .nearest_time import nearest_time_join
from .packing import pack_texts
from .percentiles import group_percentiles, merge_counts, percentiles_from_counts, value_counts
from .truncation import truncated_texts


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _us(c, scale: float):
    """Whole microseconds; null for null, NaN and infinite times."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 9e12), F.round(c * scale).cast("long"))


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every spike with a time, its nearest spectral bin within 250 ms (or null) and the distance."""
    spikes = _table(spark, d, "cluster_df").select(F.col("recording_id").alias("ent"), _us(F.col("spk_times_ms"), 1e3).alias("t"), F.col("spk_id").alias("id")).filter("t is not null")
    bins = _table(spark, d, "spectral").filter("exponent is not null and not isnan(exponent)").select(F.col("recording_id").alias("ent"), _us(F.col("t_bins_s"), 1e6).alias("t"), F.col("bin_id").alias("id"))
    return nearest_time_join(spikes, bins, 250_000).select(F.col("left_id").alias("spk_id"), F.col("right_id").alias("bin_id"), "delta_us")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).filter("bin_id is not null").select("spk_id", "bin_id")


P1_SQL = """
with s as (select distinct recording_id, spk_id, cast(round(spk_times_ms * 1000) as bigint) t from cluster_df
           where spk_times_ms is not null and not isnan(spk_times_ms) and not isinf(spk_times_ms) and recording_id is not null),
b as (select recording_id, cast(round(t_bins_s * 1000000) as bigint) t, min(bin_id) bin_id from spectral
      where exponent is not null and not isnan(exponent) and t_bins_s is not null and not isnan(t_bins_s) group by all),
x as (select s.spk_id, s.t, p.t pt, p.bin_id pb, n.t nt, n.bin_id nb from s
      asof left join b p on s.recording_id = p.recording_id and s.t >= p.t
      asof left join b n on s.recording_id = n.recording_id and s.t < n.t),
y as (select spk_id, case when pt is not null and (nt is null or t - pt <= nt - t) then pb else nb end bin_id,
             case when pt is not null and (nt is null or t - pt <= nt - t) then t - pt else nt - t end delta_us from x)
"""

QS = {"p05": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def _fit_qualities(spark: SparkSession, d: str) -> DataFrame:
    """(recording_id, field_name, v): every spike once, both fit qualities, absent values left out."""
    once = _table(spark, d, "cluster_df").select("spk_id", "recording_id", "r2_ramp", "r2_exp").dropDuplicates(["spk_id"])
    long = once.select("recording_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("v")) for f in ("r2_exp", "r2_ramp")])))
    return long.filter("v is not null and not isnan(v) and recording_id is not null")


def _types(spark: SparkSession, d: str) -> DataFrame:
    """(recording_id, cell_type): the cell of a recording by ``recordings``, its type by ``cells``."""
    rec = _table(spark, d, "recordings").filter("recording_id is not null and cell is not null").groupBy("recording_id").agg(F.max("cell").alias("cell"))
    types = _table(spark, d, "cells").filter("cell_type is not null").groupBy("cell").agg(F.max("cell_type").alias("cell_type"))
    return rec.join(types, "cell").select("recording_id", "cell_type")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of both fit qualities per cell type."""
    typed = _fit_qualities(spark, d).join(_types(spark, d), "recording_id").withColumn("g", F.concat_ws("|", "cell_type", "field_name"))
    out = group_percentiles(typed, "g", "v", QS)
    part = F.split("grp", r"\|")
    return out.select(part[0].alias("cell_type"), part[1].alias("field_name"), "n_values", *[F.round(q, 9).alias(q) for q in QS])


def p2_merged(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per field from count tables made apart, of recordings with even and odd numbers, values to 0.001 (error 0.0005 at most)."""
    v = _fit_qualities(spark, d)
    even = F.substring("recording_id", -1, 1).isin(*"02468")
    apart = [value_counts(v.filter(c), "field_name", "v", resolution=0.001) for c in (even, ~even)]
    out = percentiles_from_counts(merge_counts(*apart), QS)
    return out.select(F.col("grp").alias("field_name"), "n_values", *[F.round(q, 6).alias(q) for q in QS])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Recordings whose own median lies below the 10th percentile of their cell type."""
    types = _types(spark, d)
    per_rec = _fit_qualities(spark, d).join(types, "recording_id").groupBy("cell_type", "field_name", "recording_id", "v").agg(F.count(F.lit(1)).alias("n"))
    scope = F.array(
        F.concat_ws("|", F.lit("r"), "field_name", "cell_type", "recording_id"),
        F.concat_ws("|", F.lit("t"), "field_name", "cell_type"),
    )
    counts = per_rec.select(F.explode(scope).alias("grp"), (F.col("v") + F.lit(0.0)).alias("v"), "n").groupBy("grp", "v").agg(F.sum("n").alias("n"))
    q = percentiles_from_counts(counts, {"p10": 0.10, "p50": 0.50}).withColumn("part", F.split("grp", r"\|", 4))
    q = q.select(F.col("part")[0].alias("scope"), F.col("part")[1].alias("field_name"), F.col("part")[2].alias("cell_type"), F.get("part", F.lit(3)).alias("recording_id"), "p10", "p50")
    own = q.filter("scope = 'r'").select("recording_id", "field_name", "cell_type", "p50")
    all_ = q.filter("scope = 't'").select("field_name", "cell_type", "p10")
    return own.join(all_, ["field_name", "cell_type"]).filter("p50 < p10").select("recording_id", "field_name")


_P2_LONG = """
with once as (select spk_id, any_value(recording_id) recording_id, any_value(r2_ramp) r2_ramp, any_value(r2_exp) r2_exp from cluster_df group by spk_id),
long as (select recording_id, 'r2_exp' field_name, r2_exp v from once union all select recording_id, 'r2_ramp', r2_ramp from once),
types as (select r.recording_id, c.cell_type from (select recording_id, max(cell) cell from recordings group by 1) r join cells c using (cell) where c.cell_type is not null),
v as (select long.*, cell_type from long join types using (recording_id) where v is not null and not isnan(v))
"""


P6_FEATURES = ["peak_sharpness", "inflection_time", "exp_lambda"]


def _groups(spark: SparkSession, d: str):
    spikes = _table(spark, d, "cluster_df").select(F.col("recording_id").alias("source"), F.col("spk_id").alias("id"), *P6_FEATURES)
    return similarity_groups(spikes, P6_FEATURES)


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical spikes of every group."""
    return _groups(spark, d)[1].select(F.col("source").alias("recording_id"), F.col("group_id").alias("first_spk_id"), "n_members", F.concat_ws(",", F.transform("typical", lambda x: x.cast("string"))).alias("typical_spk_ids"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)[0].filter("id != group_id").select(F.col("group_id").alias("first_spk_id"), F.col("id").alias("spk_id"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Which text lies in which container of 1,024 tokens."""
    return pack_texts(_table(spark, d, "documents").select("doc_id", "text"))


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of unused space."""
    held = p8_containers(spark, d).filter("container_id is not null").groupBy("container_id").agg(F.sum("piece_tokens").alias("tokens"))
    return held.agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.round(1 - F.sum("tokens") / (F.count(F.lit(1)) * 1024), 6).alias("unused_share"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_containers(spark, d).filter("n_tokens > 1024 and piece_no = 0").select("doc_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold passages of evaluation items, with the running words found."""
    return find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("item_id", "doc_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items by the number of documents that hold them."""
    return p9_leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("most_words"))


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text with the evidence for a cut."""
    return truncated_texts(_table(spark, d, "documents").select("doc_id", "source", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_texts(spark, d).filter("truncated").select("doc_id")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts."""
    t = p10_texts(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("truncated").cast("long")).alias("n_truncated"), F.max("at_limit").alias("has_limit"))
    return t.select("*", F.round(F.col("n_truncated") / F.col("n_texts"), 6).alias("share"))


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_matches": p1_matches,
        "p2_found": p2_found,
        "p2_percentiles": p2_percentiles,
        "p2_merged": p2_merged,
        "p6_found": p6_found,
        "p6_groups": p6_groups,
        "p8_found": p8_found,
        "p8_containers": p8_containers,
        "p8_usage": p8_usage,
        "p9_found": p9_found,
        "p9_leaks": p9_leaks,
        "p9_items": p9_items,
        "p10_found": p10_found,
        "p10_texts": p10_texts,
        "p10_sources": p10_sources,
    }


def oracle_sql() -> dict[str, str]:
    cut = ", ".join(f"round(quantile_cont(v, {q}), 9) {n}" for n, q in QS.items())
    return {
        "p1_found": P1_SQL + "select spk_id, bin_id from y where delta_us <= 250000",
        "p1_matches": P1_SQL + "select spk_id, case when delta_us <= 250000 then bin_id end bin_id, case when delta_us <= 250000 then delta_us end delta_us from y",
        "p2_found": _P2_LONG
        + ", own as (select recording_id, field_name, cell_type, quantile_cont(v, 0.5) m from v group by all), t as (select cell_type, field_name, quantile_cont(v, 0.1) p from v group by all)"
        " select recording_id, field_name from own join t using (cell_type, field_name) where m < p",
        "p2_percentiles": _P2_LONG + f"select cell_type, field_name, count(*) n_values, {cut} from v group by all",
        "p2_merged": _P2_LONG + ", m as (select field_name, round(v / 0.001::double) * 0.001::double v from long where v is not null and not isnan(v) and recording_id is not null) select field_name, count(*) n_values, " + ", ".join(f"round(quantile_cont(v, {q}), 6) {n}" for n, q in QS.items()) + " from m group by 1",
        "p8_found": r"select doc_id from documents where len(regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_\s]+')) > 1024 group by doc_id",
    }
