"""Queries of the reference's operators over the recording tables: cells, recordings, spikes, LFP bins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranks
from ..operators import waveform as wf
from .base import S, table, waveforms


def r6(c):
    return F.round(c, 6)


def _value(c):
    """A double that is absent if null, NaN or infinite."""
    return F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300), F.col(c))


def _label(c):
    v = F.lower(F.trim(c))
    return F.when(v.isin("low", "mid", "high"), v)


def _spikes(s, d, *cols):
    """Every spike once: a row delivered twice repeats its values."""
    df = table(s, d, "cluster_df").select("spk_id", "recording_id", "cell", "peak_amp_cluster", "exp_const_cluster", *cols).dropDuplicates(["spk_id"])
    return df.withColumns({c: _value(c) for c in cols} | {c: _label(c) for c in ("peak_amp_cluster", "exp_const_cluster")})


def cell_metadata(s, d):
    """Cells by cleaned patch type with their numbers of recordings."""
    rec = table(s, d, "recordings").filter("recording_id is not null").groupBy("cell").agg(F.countDistinct("recording_id").alias("n_recordings"))
    c = table(s, d, "cells").select("cell", F.lower(F.trim("patch_type")).alias("patch_type"), "cell_type")
    return c.join(rec, "cell", "left").select("cell", "patch_type", "cell_type", F.coalesce("n_recordings", F.lit(0)).alias("n_recordings"))


def cluster_table(s, d):
    """Distinct labels per recording and clustered feature."""
    x = _spikes(s, d).unpivot(["spk_id", "recording_id"], ["peak_amp_cluster", "exp_const_cluster"], "feature", "label")
    g = x.filter("label is not null").groupBy("recording_id", "feature").agg(F.countDistinct("label").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.select("recording_id", F.regexp_replace("feature", "_cluster$", "").alias("feature"), "k", "n")


def cluster_balance(s, d):
    """Share of the rarest label per recording and feature with two labels or more."""
    x = _spikes(s, d).unpivot(["spk_id", "recording_id"], ["peak_amp_cluster", "exp_const_cluster"], "feature", "label").filter("label is not null")
    n = x.groupBy("recording_id", "feature", "label").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("recording_id", "feature").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"), F.sum("n").alias("all"))
    return g.filter("k > 1").select("recording_id", "feature", r6(F.col("lo") / F.col("all")).alias("minority"))


def isi_independence(s, d):
    """Kruskal-Wallis H of log_isi by waveform label and eta squared H/(n-1), per recording."""
    x = _spikes(s, d, "log_isi").filter("log_isi is not null and peak_amp_cluster is not null")
    k = ranks.kruskal(x, "log_isi", "peak_amp_cluster", ["recording_id"]).filter("k > 1 and n > 10")
    return k.select("recording_id", "k", "n", F.round("h", 5).alias("h"), r6("eta2_h").alias("eta2"))


def fit_quality(s, d):
    """Mean fit qualities of the spikes of each cell type."""
    types = table(s, d, "cells").select("cell", "cell_type")
    rec = table(s, d, "recordings").filter("cell is not null").groupBy("recording_id").agg(F.max("cell").alias("rec_cell"))
    x = _spikes(s, d, "r2_ramp", "r2_exp").join(rec, "recording_id").join(types, F.col("rec_cell") == types["cell"])
    return x.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r2_ramp")).alias("r2_ramp"), r6(F.avg("r2_exp")).alias("r2_exp"))


def feature_correlations(s, d):
    """Pearson correlations between waveform features per recording with more than four spikes."""
    x = _spikes(s, d, "peak_sharpness", "inflection_time", "log_isi")
    c = lambda a, b: r6(ranks.corr(a, b))
    g = x.filter("peak_sharpness is not null and inflection_time is not null and log_isi is not null").groupBy("recording_id")
    return g.agg(F.count(F.lit(1)).alias("n"), c("peak_sharpness", "inflection_time").alias("r_si"), c("peak_sharpness", "log_isi").alias("r_sl")).filter("n > 4")


def quality_spikes(s, d):
    """The four range predicates of the quality filter over the spikes."""
    x = _spikes(s, d, "inflection_time", "peak_width", "r2_ramp", "r2_exp")
    return x.filter("inflection_time > 0 and peak_width > 0 and peak_width <= 10 and r2_ramp >= 0.5 and r2_exp >= 0.5").select("spk_id", r6("peak_width").alias("peak_width"))


def exponent_windows(s, d):
    """Mean and spread of the aperiodic exponent in closed ten-second windows of a recording."""
    b = table(s, d, "spectral").select("bin_id", "recording_id", "t_bins_s", _value("exponent").alias("exponent")).dropDuplicates(["bin_id"]).filter("exponent is not null and t_bins_s is not null and not isnan(t_bins_s)")
    return b.groupBy("recording_id", F.floor(F.col("t_bins_s") / 10).cast("long").alias("win")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("exponent"), 9).alias("mean"), r6(F.stddev_pop("exponent")).alias("std"))


def trim_edge_bins(s, d):
    """Bins at least half a second from the first and last of their epoch."""
    b = table(s, d, "spectral").select("bin_id", "recording_id", "t_bins_s").dropDuplicates(["bin_id"]).filter("t_bins_s is not null and not isnan(t_bins_s)")
    g = b.groupBy("recording_id").agg(F.min("t_bins_s").alias("lo"), F.max("t_bins_s").alias("hi"))
    return b.join(g, "recording_id").filter("t_bins_s >= lo + 0.5 and t_bins_s <= hi - 0.5").groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"))


def best_recording(s, d):
    """The recording with the most spikes of each cell, the smaller id of equals."""
    n = _spikes(s, d).filter("cell is not null").groupBy("cell", "recording_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cell").orderBy(F.desc("n"), "recording_id")
    return n.withColumn("r", F.row_number().over(w)).filter("r = 1").select("cell", "recording_id", "n")


def signal_classes(s, d):
    """Waveforms as ramp, falling or other by the correlation of sample and place."""
    x = waveforms(s, d).select("vec_id", F.posexplode("wf").alias("pos", "x"))
    r = x.groupBy("vec_id").agg(ranks.corr("pos", "x").alias("r"))
    return r.select("vec_id", r6("r").alias("r"), F.when(F.col("r") > 0.3, "ramp").when(F.col("r") < -0.3, "falling").otherwise("other").alias("kind"))


def active_epoch(s, d):
    """First and last sample of at least 0.2 in magnitude, padded by two samples and clamped."""
    w = waveforms(s, d).select("vec_id", wf.absolute(F.col("wf")).alias("a"))
    w = w.withColumn("on", F.transform("a", lambda v: (v >= 0.2).cast("int"))).filter("array_contains(on, 1)")
    first, last = F.array_position("on", F.lit(1)) - 1, F.size("on") - F.array_position(F.reverse("on"), F.lit(1))
    return w.select("vec_id", F.greatest(first - 2, F.lit(0)).cast("long").alias("start"), F.least(last + 2, F.lit(63)).cast("long").alias("end"))


def event_shape(s, d):
    """Baseline at the edges, height over it, samples above half height and share left eight samples after the peak."""
    w = waveforms(s, d).withColumn("p", wf.argmax(F.col("wf"))).filter("p + 8 < 64")
    base = (F.element_at("wf", 1) + F.element_at("wf", 2) + F.element_at("wf", 63) + F.element_at("wf", 64)) / 4
    w = w.withColumn("base", base).withColumn("h", F.array_max("wf") - F.col("base"))
    above = F.size(F.filter("wf", lambda v: v >= F.col("base") + F.col("h") / 2)).cast("long")
    left = (F.element_at("wf", (F.col("p") + 9).cast("int")) - F.col("base")) / F.col("h")
    return w.select("vec_id", r6("base").alias("base"), r6("h").alias("height"), above.alias("width"), r6(left).alias("post_frac"))


NAMES = "cell_metadata cluster_table cluster_balance isi_independence fit_quality feature_correlations quality_spikes exponent_windows trim_edge_bins best_recording signal_classes active_epoch event_shape"


def queries():
    return {n: globals()[n] for n in NAMES.split()}


def oracle_sql():
    fin = lambda c: f"case when {c} is not null and not isnan({c}) and not isinf({c}) then {c} end"
    lab = lambda c: f"case when lower(trim({c})) in ('low', 'mid', 'high') then lower(trim({c})) end"
    x = (
        "with x as (select spk_id, any_value(recording_id) recording_id, any_value(cell) cell, any_value("
        + lab("peak_amp_cluster")
        + ") pa, any_value("
        + lab("exp_const_cluster")
        + ") ec"
        + "".join(f", any_value({fin(c)}) {c}" for c in ("log_isi", "r2_ramp", "r2_exp", "peak_sharpness", "inflection_time", "peak_width"))
        + " from cluster_df group by spk_id), l as (select spk_id, recording_id, 'peak_amp' f, pa v from x union all select spk_id, recording_id, 'exp_const', ec from x) "
    )
    b = f"with b as (select bin_id, any_value(recording_id) recording_id, any_value(t_bins_s) t, any_value({fin('exponent')}) e from spectral where t_bins_s is not null and not isnan(t_bins_s) group by 1) "
    return {
        "cell_metadata": "select cell, lower(trim(patch_type)) patch_type, cell_type, (select count(distinct recording_id) from recordings r where r.cell = c.cell) n_recordings from cells c",
        "cluster_table": x + "select recording_id, f feature, count(distinct v) k, count(*) n from l where v is not null group by 1, 2",
        "cluster_balance": x + ", n as (select recording_id, f, v, count(*) n from l where v is not null group by all) select recording_id, f || '_cluster' feature, round(min(n) / sum(n), 6) minority from n group by 1, 2 having count(*) > 1",
        "isi_independence": x
        + ", y as (select recording_id g, pa, log_isi v from x where log_isi is not null and pa is not null), r as (select g, pa, v, rank() over (partition by g order by v) + (count(*) over (partition by g, v) - 1) / 2.0::double rk from y), s as (select g, pa, count(*) n, sum(rk) rs from r group by 1, 2), t as (select g, sum(n) total, sum(n::double * n * n - n) ties from (select g, v, count(*) n from y group by 1, 2) group by 1), h as (select g, count(*) k, any_value(total)::double n, any_value(ties) ties, sum(rs * rs / n) q from s join t using (g) group by 1), z as (select g, k, n, (12.0::double / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) h from h where k > 1 and n > 10) select g recording_id, k, cast(n as bigint) n, round(h, 5) h, round(h / (n - 1), 6) eta2 from z",
        "fit_quality": x + ", r as (select recording_id, max(cell) rc from recordings where cell is not null group by 1) select cell_type, count(*) n, round(avg(r2_ramp), 6) r2_ramp, round(avg(r2_exp), 6) r2_exp from x join r using (recording_id) join cells c on c.cell = rc group by 1",
        "feature_correlations": x + "select recording_id, count(*) n, round(corr(peak_sharpness, inflection_time), 6) r_si, round(corr(peak_sharpness, log_isi), 6) r_sl from x where peak_sharpness is not null and inflection_time is not null and log_isi is not null group by 1 having count(*) > 4",
        "quality_spikes": x + "select spk_id, round(peak_width, 6) peak_width from x where inflection_time > 0 and peak_width > 0 and peak_width <= 10 and r2_ramp >= 0.5 and r2_exp >= 0.5",
        "exponent_windows": b + "select recording_id, cast(floor(t / 10) as bigint) win, count(*) n, round(avg(e), 9) mean, round(stddev_pop(e), 6) std from b where e is not null group by 1, 2",
        "trim_edge_bins": b + ", g as (select *, min(t) over (partition by recording_id) lo, max(t) over (partition by recording_id) hi from b) select recording_id, count(*) n from g where t >= lo + 0.5::double and t <= hi - 0.5::double group by 1",
        "best_recording": x + ", n as (select cell, recording_id, count(*) n from x where cell is not null group by 1, 2) select cell, recording_id, n from n qualify row_number() over (partition by cell order by n desc, recording_id) = 1",
        "signal_classes": S + ", r as (select vec_id, corr(pos, x) r from s group by 1) select vec_id, round(r, 6) r, case when r > 0.3 then 'ramp' when r < -0.3 then 'falling' else 'other' end kind from r",
        "active_epoch": S + 'select vec_id, greatest(min(pos) - 2, 0) start, least(max(pos) + 2, 63) "end" from s where abs(x) >= 0.2 group by 1',
        "event_shape": S + ", m as (select vec_id, max(x) t, (sum(x) filter (where pos = 0) + sum(x) filter (where pos = 1) + sum(x) filter (where pos = 62) + sum(x) filter (where pos = 63)) / 4 base from s group by 1), p as (select s.vec_id, min(pos) p from s join m using (vec_id) where x = t group by 1) select s.vec_id, round(any_value(base), 6) base, round(any_value(t - base), 6) height, count(*) filter (where x >= base + (t - base) / 2) width, round((sum(x) filter (where pos = p + 8) - any_value(base)) / any_value(t - base), 6) post_frac from s join m using (vec_id) join p using (vec_id) where p + 8 < 64 group by 1",
    }
