"""Queries of the analyses that combine features, labels and LFP bins of recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks
from ..operators.hot import row_windows
from ..operators.rangescan import number_rows
from .base import table, waveforms
from .recordings import _label, _spikes, _value, r6

#: Closed bands of a decay rate, the first that holds a value counts; fixed values.
BANDS = (("slow", 0.0, 1.0), ("middle", 1.0, 2.0), ("fast", 2.0, 10.0))


def _bins(s, d):
    """Every spectral bin with a time once."""
    b = table(s, d, "spectral").select("bin_id", "recording_id", "cell", _value("t_bins_s").alias("t"), _value("exponent").alias("e")).dropDuplicates(["bin_id"])
    return b.filter("t is not null and recording_id is not null")


def format_p(p):
    """Plain decimal with four places, '< 0.0001' below, 'n/a' where absent."""
    return F.when(p.isNull() | F.isnan(p), "n/a").when(p < 0.0001, "< 0.0001").otherwise(F.format_string("%.4f", p))


def formatted_p(s, d):
    """p-values as text with stars."""
    p = (F.col("p_size") * F.col("p_size") / 2500.0) * (F.col("p_size") / 50.0) - 0.0002
    p = F.when(F.col("p_size") == 7, F.lit(None)).otherwise(F.greatest(p, F.lit(0.0)))
    star = F.when(F.col("p").isNull(), "").when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise("ns")
    g = table(s, d, "part").select("p_partkey", p.alias("p"))
    return g.select("p_partkey", format_p(F.col("p")).alias("text"), F.trim(F.concat_ws(" ", format_p(F.col("p")), star)).alias("with_stars"))


def band_slots(s, d):
    """Number and mean of the decay rates in each band, one column per band, per recording."""
    x = _spikes(s, d, "exp_lambda").filter("exp_lambda is not null and recording_id is not null")
    band = F.coalesce(*[F.when(F.col("exp_lambda").between(lo, hi), name) for name, lo, hi in BANDS])
    g = x.withColumn("band", band).groupBy("recording_id")
    cols = [c for n, _, _ in BANDS for c in (F.count(F.when(F.col("band") == n, 1)).alias(f"n_{n}"), r6(F.avg(F.when(F.col("band") == n, F.col("exp_lambda")))).alias(f"mean_{n}"))]
    return g.agg(*cols)


def average_pre_post(s, d):
    """Mean of a recording's exponents before and after 30 s, or whichever exists."""
    g = _bins(s, d).groupBy("recording_id").agg(F.avg(F.when(F.col("t") < 30, F.col("e"))).alias("pre"), F.avg(F.when(F.col("t") >= 30, F.col("e"))).alias("post"))
    # means of few short decimals: nine places keep away from halves
    r9 = lambda c: F.round(c, 9)
    return g.select("recording_id", r9("pre").alias("pre"), r9("post").alias("post"), r9(F.coalesce((F.col("pre") + F.col("post")) / 2, "pre", "post")).alias("mean"))


def pre_post_within(s, d):
    """Paired effects of after against before 30 s over the recordings of a cell: dz, its corrected form gz, share of rises."""
    p = average_pre_post(s, d).filter("pre is not null and post is not null").withColumn("x", F.col("post") - F.col("pre"))
    cells = table(s, d, "recordings").filter("cell is not null and recording_id is not null").groupBy("recording_id").agg(F.max("cell").alias("cell"))
    g = p.join(cells, "recording_id").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"), F.avg((F.col("x") > 0).cast("double")).alias("up"))
    dz = F.col("m") / F.col("sd")
    return g.filter("n > 2 and sd > 0").select("cell", "n", F.round(dz, 5).alias("dz"), F.round(dz * (1 - 3 / (4.0 * (F.col("n") - 1) - 1)), 5).alias("gz"), r6("up").alias("rises"))


def label_bin_groups(s, d):
    """LFP bins under each label of each clustered feature: the bins in the second of a spike with that label."""
    x = table(s, d, "cluster_df").select("spk_id", "recording_id", _value("spk_times_ms").alias("ms"), _label("peak_amp_cluster").alias("peak_amp"), _label("exp_const_cluster").alias("exp_const")).dropDuplicates(["spk_id"])
    x = x.filter("ms is not null").withColumn("sec", F.floor(F.col("ms") / 1000)).unpivot(["recording_id", "sec"], ["peak_amp", "exp_const"], "feature", "label").filter("label is not null").distinct()
    b = _bins(s, d).withColumn("sec", F.floor("t"))
    return b.join(x, ["recording_id", "sec"]).groupBy("recording_id", "feature", "label").agg(F.count(F.lit(1)).alias("n_bins"), r6(F.avg("e")).alias("exponent"))


def metadata_update(s, d):
    """Spikes per recording with the cleaned metadata of its cell."""
    cells = table(s, d, "cells").select("cell", F.lower(F.trim("patch_type")).alias("patch_type"), "cortical_depth")
    n = _spikes(s, d).filter("cell is not null").groupBy("recording_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    # cells are few at every scale, but their size is left to the optimizer
    return n.join(cells, "cell", "left").select("recording_id", "cell", "n", "patch_type", "cortical_depth")


def window_order(s, d):
    """Place of every spike among its recording's spikes by the interval that follows, ties by number."""
    x = _spikes(s, d, "log_isi").filter("log_isi is not null and recording_id is not null").select("recording_id", "spk_id", "log_isi")
    ranked = number_rows(x.withColumn("_k", F.xxhash64("recording_id")), "_k", ["recording_id", "log_isi", "spk_id"])
    return ranked.select("spk_id", (F.col("rank") + 1).alias("place"))


def subsample_clip(s, d):
    """2,000 spikes drawn without replacement by the hash of their number, clipped at the 99th percentile of the draw."""
    x = _spikes(s, d, "peak_sharpness").filter("peak_sharpness is not null")
    drawn = x.orderBy(F.md5(F.col("spk_id").cast("string"))).limit(2000).select("spk_id", "peak_sharpness")
    top = drawn.agg(F.percentile("peak_sharpness", 0.99).alias("top"))
    return drawn.join(F.broadcast(top)).select("spk_id", r6(F.least("peak_sharpness", "top")).alias("clipped"))


def within_between_scalar(s, d):
    """Mean distance of a cell's values to its own mean, and to the means of the other cells."""
    x = _spikes(s, d, "peak_sharpness").filter("peak_sharpness is not null and cell is not null")
    means = x.groupBy("cell").agg(F.avg("peak_sharpness").alias("m"))
    # one array of the cells' means; there are as many as cells, not spikes
    held = means.agg(F.collect_list("m").alias("all"))
    j = x.join(means, "cell").join(F.broadcast(held))
    own = F.abs(F.col("peak_sharpness") - F.col("m"))
    away = F.aggregate("all", F.lit(0.0), lambda a, v: a + F.abs(F.col("peak_sharpness") - v))
    g = j.select("cell", own.alias("own"), ((away - own) / (F.size("all") - 1)).alias("other"))
    return g.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("own")).alias("d_within"), r6(F.avg("other")).alias("d_between"), r6(F.avg((F.col("own") > F.col("other")).cast("double"))).alias("exceeds"))


def temporal_stability(s, d):
    """Pooled slope of a value's distance from its cell's mean against the share of the recording that has passed."""
    x = _timed(s, d)
    span = table(s, d, "recordings").filter("recording_id is not null").groupBy("recording_id").agg(F.max("duration_ms").alias("dur"))
    means = x.groupBy("cell").agg(F.avg("v").alias("m"))
    j = x.join(span, "recording_id").join(means, "cell").filter("dur > 0").select("cell", (F.col("ms") / F.col("dur")).alias("t"), F.abs(F.col("v") - F.col("m")).alias("a"))
    return j.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("a", "t"), 5).alias("slope"), F.round(F.regr_intercept("a", "t"), 5).alias("intercept")).filter("n >= 30")


def _timed(s, d):
    x = table(s, d, "cluster_df").select("spk_id", "recording_id", "cell", _value("spk_times_ms").alias("ms"), _value("peak_sharpness").alias("v"), _label("peak_amp_cluster").alias("label")).dropDuplicates(["spk_id"])
    return x.filter("ms is not null and v is not null and cell is not null and recording_id is not null")


def slope_and_rho(s, d):
    """Per recording of thirty spikes or more: slope of the distance from the mean in spreads against time, and rank correlation of time with the alphabetical code of the label."""
    x = _timed(s, d).filter("label is not null").withColumn("code", F.when(F.col("label") == "high", 0).when(F.col("label") == "low", 1).otherwise(2))
    g = x.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("sd")).filter("n >= 30 and sd > 0")
    j = x.join(g, "recording_id")
    slope = j.groupBy("recording_id").agg(F.round(F.regr_slope(F.abs(F.col("v") - F.col("m")) / F.col("sd"), F.col("ms") / 1000), 6).alias("slope"))
    rho = ranks.spearman(j.select("recording_id", "ms", F.col("code").cast("double").alias("code")), "ms", "code", ["recording_id"])
    return slope.join(rho, "recording_id").select("recording_id", "n", "slope", r6("rho").alias("rho"))


def fit_and_decay(s, d):
    """Fit quality of a recording beside the correlation of its decay rate with its sharpness."""
    x = _spikes(s, d, "r2_exp", "exp_lambda", "peak_sharpness").filter("recording_id is not null")
    fit = x.groupBy("recording_id").agg(F.avg("r2_exp").alias("mean_r2"), F.max("r2_exp").alias("max_r2"))
    c = x.filter("exp_lambda is not null and peak_sharpness is not null").groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), ranks.corr("exp_lambda", "peak_sharpness").alias("r")).filter("n >= 10")
    return fit.join(c, "recording_id").select("recording_id", "n", r6("mean_r2").alias("mean_r2"), r6("max_r2").alias("max_r2"), F.round("r", 5).alias("r"))


EFFECTS = ("peak_sharpness", "inflection_time", "peak_width", "log_isi")


def _effects(s, d):
    """Standardised difference of high against low spikes by amplitude, per recording and feature."""
    x = _spikes(s, d, *EFFECTS).filter("recording_id is not null and peak_amp_cluster in ('low', 'high')").unpivot(["recording_id", "peak_amp_cluster"], list(EFFECTS), "feature", "v").filter("v is not null")
    k = lambda l: F.when(F.col("peak_amp_cluster") == l, F.col("v"))  # noqa: E731, E741
    g = x.groupBy("recording_id", "feature").agg(*[f(k(l)).alias(f"{n}_{l}") for l in ("low", "high") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]).filter("n_low > 4 and n_high > 4")
    pooled = F.sqrt(((F.col("n_low") - 1) * F.col("v_low") + (F.col("n_high") - 1) * F.col("v_high")) / (F.col("n_low") + F.col("n_high") - 2))
    return g.withColumn("sd", pooled).filter("sd > 0").select("recording_id", "feature", F.round((F.col("m_high") - F.col("m_low")) / F.col("sd"), 6).alias("d"))


def effect_correlations(s, d):
    """Rank correlation over recordings of the sizes of effect of every two features, with five recordings or more."""
    e = _effects(s, d).withColumn("a", F.abs("d"))
    # pairs of features of one recording, not of recordings
    p = e.alias("x").join(e.alias("y"), (F.col("x.recording_id") == F.col("y.recording_id")) & (F.col("x.feature") < F.col("y.feature"))).select(F.concat_ws("|", "x.feature", "y.feature").alias("pair"), F.col("x.a").alias("a"), F.col("y.a").alias("b"))
    r = ranks.spearman(p, "a", "b", ["pair"]).filter("n >= 5")
    return r.select("pair", "n", r6("rho").alias("rho"))


def nonredundant_features(s, d):
    """Features by mean size of effect, without those whose effects correlate above 0.9 with one already taken."""
    strength = {r["feature"]: r["m"] for r in _effects(s, d).groupBy("feature").agg(F.avg(F.abs("d")).alias("m")).collect()}  # one row per feature
    rho = {tuple(r["pair"].split("|")): r["rho"] for r in effect_correlations(s, d).collect()}
    kept: list[str] = []
    for f in sorted(strength, key=lambda f: (-strength[f], f)):
        near = [rho.get((min(f, k), max(f, k))) for k in kept]
        if not any(r is not None and abs(r) >= 0.9 for r in near):
            kept.append(f)
    return s.createDataFrame([(i + 1, f, round(strength[f], 6)) for i, f in enumerate(kept)], "place int, feature string, strength double")


def significant_combos(s, d):
    """Per feature the recording with the largest effect, its sign and class, and the share of recordings above half a spread."""
    e = _effects(s, d)
    g = e.groupBy("feature").agg(F.max_by(F.struct("recording_id", "d"), F.struct(F.abs("d"), "recording_id")).alias("top"), F.count(F.lit(1)).alias("n"), F.avg((F.abs("d") >= 0.5).cast("double")).alias("share"))
    size = F.abs("top.d")
    return g.select("feature", F.col("top.recording_id").alias("recording_id"), F.col("top.d").alias("d"), F.when(size >= 0.8, "large").when(size >= 0.5, "medium").otherwise("small").alias("size"), "n", r6("share").alias("share"))


def population_scatter(s, d):
    """Pooled r2 of inflection times predicted by each recording's own line over sharpness, for recordings with r2 of 0.01 or more."""
    x = _spikes(s, d, "inflection_time", "peak_sharpness").filter("inflection_time is not null and peak_sharpness is not null and recording_id is not null")
    g = x.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("inflection_time", "peak_sharpness").alias("b"), F.regr_intercept("inflection_time", "peak_sharpness").alias("a"), F.regr_r2("inflection_time", "peak_sharpness").alias("r2")).filter("n >= 20 and r2 >= 0.01")
    j = x.join(g, "recording_id").withColumn("p", F.col("a") + F.col("b") * F.col("peak_sharpness"))
    return j.agg(F.countDistinct("recording_id").alias("recordings"), F.count(F.lit(1)).alias("n"), F.round(F.pow(ranks.corr("inflection_time", "p"), 2), 5).alias("r2"))


def window_expansion(s, d):
    """r2 of the next interval against the mean of the last 1, 2, 4 and 8 intervals of a recording, and against another spike's as control."""
    x = _spikes(s, d, "log_isi").filter("log_isi is not null and recording_id is not null").select("recording_id", "spk_id", "log_isi")
    sizes = (1, 2, 4, 8)
    frames = {f"m{k}": (lambda w, k=k: F.avg("log_isi").over(w.rowsBetween(-k, -1))) for k in sizes} | {"i": lambda w: F.lag("log_isi", 8).over(w), "far": lambda w: F.lead("log_isi", 16).over(w)}
    w = row_windows(x, "recording_id", ["spk_id"], 8, 16, frames).filter("i is not null and far is not null")
    cols = F.array(*[F.struct(F.lit(k).alias("window"), F.col(f"m{k}").alias("m")) for k in sizes])
    e = w.select("log_isi", "far", F.inline(cols))
    return e.groupBy("window").agg(F.count(F.lit(1)).alias("n"), r6(F.pow(ranks.corr("log_isi", "m"), 2)).alias("r2"), r6(F.pow(ranks.corr("far", "m"), 2)).alias("control"))


def tukey_hsd(s, d):
    """Studentised ranges of all pairs of segments' mean balances, from moments."""
    g = table(s, d, "customer").groupBy("c_mktsegment").agg(F.count("c_acctbal").alias("n"), F.avg("c_acctbal").alias("m"), F.var_pop("c_acctbal").alias("v"))
    t = g.agg(F.sum("n").alias("nn"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("v")) / (F.sum("n") - F.count(F.lit(1)))).alias("ms"))
    a, b = g.alias("a"), g.alias("b")
    # pairs of group means; groups are categories
    j = a.join(b, F.col("a.c_mktsegment") < F.col("b.c_mktsegment")).join(F.broadcast(t))
    q = F.abs(F.col("a.m") - F.col("b.m")) / F.sqrt(F.col("ms") / 2 * (1 / F.col("a.n") + 1 / F.col("b.n")))
    return j.select(F.col("a.c_mktsegment").alias("a"), F.col("b.c_mktsegment").alias("b"), r6(q).alias("q"), F.col("k").cast("long").alias("k"), (F.col("nn") - F.col("k")).alias("df"))


def recording_status(s, d):
    """What an analysis of each recording would come to: ok, skipped (no samples) or error (no rate), with the number of chunks."""
    r = table(s, d, "recordings").filter("recording_id is not null").groupBy("recording_id").agg(F.countDistinct("chunk_id").alias("chunks"), F.max(F.coalesce(F.size("samples") > 0, F.lit(False))).alias("any"), F.max("fs").alias("fs"))
    return r.select("recording_id", "chunks", F.when(F.col("fs").isNull() | ~(F.col("fs") > 0), "error").when(~F.col("any"), "skipped").otherwise("ok").alias("status"))


def flatten_nested(s, d):
    """Nested burst lists as rows: usable pieces and their total length per recording and list, lists without any skipped."""
    lists = F.array(*[F.struct(F.lit(n).alias("burst_list"), F.col(n).alias("pieces")) for n in ("high_bursts", "low_bursts", "rest_bursts")])
    b = table(s, d, "burst_lists").filter("recording_id is not null").withColumn("scale", F.when(F.col("time_unit") == "s", 1000.0).otherwise(1.0))
    p = b.dropDuplicates(["recording_id", "chunk_id"]).select("recording_id", "scale", F.inline(lists)).select("recording_id", "burst_list", "scale", F.inline("pieces"))
    p = p.filter("t_start is not null and t_end is not null and not isnan(t_start) and not isnan(t_end) and t_end > t_start")
    return p.groupBy("recording_id", "burst_list").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum((F.col("t_end") - F.col("t_start")) * F.col("scale")), 3).alias("total_ms"))


def trough_segments(s, d):
    """Nine samples centred on each waveform's lowest one, without their mean; null beyond the ends."""
    w = waveforms(s, d).withColumn("p", F.array_position("wf", F.array_min("wf")).cast("int"))
    seg = F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda k: F.when((F.col("p") + k >= 1) & (F.col("p") + k <= F.size("wf")), F.get("wf", F.col("p") + k - 1)))
    w = w.withColumn("seg", seg).withColumn("m", F.aggregate(F.filter("seg", lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v) / F.size(F.filter("seg", lambda v: v.isNotNull())))
    return w.select("vec_id", F.posexplode("seg").alias("k", "v"), "m").select("vec_id", F.col("k").cast("long").alias("k"), r6(F.col("v") - F.col("m")).alias("v"))


NAMES = "formatted_p band_slots average_pre_post pre_post_within label_bin_groups metadata_update window_order subsample_clip within_between_scalar temporal_stability slope_and_rho fit_and_decay effect_correlations nonredundant_features significant_combos population_scatter window_expansion tukey_hsd recording_status flatten_nested trough_segments"


def queries():
    return {n: globals()[n] for n in NAMES.split()}


def oracle_sql():
    fin = lambda c: f"case when {c} is not null and not isnan({c}) and not isinf({c}) then {c} end"
    lab = lambda c: f"case when lower(trim({c})) in ('low', 'mid', 'high') then lower(trim({c})) end"
    feats = ("log_isi", "r2_exp", "peak_sharpness", "inflection_time", "peak_width", "exp_lambda", "spk_times_ms")
    x = f"with x as (select spk_id, any_value(recording_id) recording_id, any_value(cell) cell, any_value({lab('peak_amp_cluster')}) pa, any_value({lab('exp_const_cluster')}) ec" + "".join(f", any_value({fin(c)}) {c}" for c in feats) + " from cluster_df group by spk_id) "
    b = f"with b as (select bin_id, any_value(recording_id) recording_id, any_value({fin('t_bins_s')}) t, any_value({fin('exponent')}) e from spectral group by 1), pp as (select recording_id, avg(case when t < 30 then e end) pre, avg(case when t >= 30 then e end) post from b where t is not null and recording_id is not null group by 1) "
    p = "with p as (select p_partkey, case when p_size = 7 then null else greatest((p_size * p_size / 2500.0::double) * (p_size / 50.0::double) - 0.0002::double, 0.0::double) end p from part), f as (select *, case when p is null then 'n/a' when p < 0.0001 then '< 0.0001' else printf('%.4f', p) end t from p) "
    bands = ", ".join(f"count(*) filter (where b = '{n}') n_{n}, round(avg(exp_lambda) filter (where b = '{n}'), 6) mean_{n}" for n, _, _ in BANDS)
    eff = x + "".join(
        ", e as (select recording_id, feature, count(*) filter (where pa = 'low') n1, count(*) filter (where pa = 'high') n2, avg(v) filter (where pa = 'low') m1, avg(v) filter (where pa = 'high') m2, var_samp(v) filter (where pa = 'low') v1, var_samp(v) filter (where pa = 'high') v2 from ("
        + " union all ".join(f"select recording_id, pa, '{f}' feature, {f} v from x" for f in EFFECTS)
        + ") where v is not null and recording_id is not null and pa in ('low', 'high') group by 1, 2), f as (select recording_id, feature, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) sd, m2 - m1 dm from e where n1 > 4 and n2 > 4), d as (select recording_id, feature, round(dm / sd, 6) d from f where sd > 0) "
    )
    timed = x + ", y as (select recording_id, cell, spk_times_ms ms, peak_sharpness v, pa from x where spk_times_ms is not null and peak_sharpness is not null and cell is not null and recording_id is not null) "
    lists = " union all ".join(f"select recording_id, time_unit, '{n}' burst_list, unnest({n}) p from o" for n in ("high_bursts", "low_bursts", "rest_bursts"))
    return {
        "formatted_p": p + "select p_partkey, t as text, trim(t || ' ' || case when p is null then '' when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else 'ns' end) with_stars from f",
        "band_slots": x + f"select recording_id, {bands} from (select *, " + "coalesce(" + ", ".join(f"case when exp_lambda between {lo} and {hi} then '{n}' end" for n, lo, hi in BANDS) + ") b from x where exp_lambda is not null and recording_id is not null) group by 1",
        "average_pre_post": b + "select recording_id, round(pre, 9) pre, round(post, 9) post, round(coalesce((pre + post) / 2, pre, post), 9) mean from pp",
        "pre_post_within": b + ", c as (select recording_id, max(cell) cell from recordings where cell is not null group by 1), g as (select cell, count(*) n, avg(x) m, stddev_samp(x) sd, avg(case when x > 0 then 1.0::double else 0 end) up from (select recording_id, round(post, 9) - round(pre, 9) x from pp) join c using (recording_id) where x is not null group by 1) select cell, n, round(m / sd, 5) dz, round(m / sd * (1 - 3 / (4.0::double * (n - 1) - 1)), 5) gz, round(up, 6) rises from g where n > 2 and sd > 0",
        "label_bin_groups": x + f", b as (select bin_id, any_value(recording_id) recording_id, any_value({fin('t_bins_s')}) t, any_value({fin('exponent')}) e from spectral group by 1), l as (select distinct recording_id, floor(spk_times_ms / 1000) s, f, v from (select recording_id, spk_times_ms, 'peak_amp' f, pa v from x union all select recording_id, spk_times_ms, 'exp_const', ec from x) where v is not null and spk_times_ms is not null) select b.recording_id, f feature, v as label, count(*) n_bins, round(avg(e), 6) exponent from b join l on b.recording_id = l.recording_id and floor(b.t) = l.s group by 1, 2, 3",
        "metadata_update": x + "select recording_id, n.cell, n, lower(trim(patch_type)) patch_type, cortical_depth from (select recording_id, cell, count(*) n from x where cell is not null group by 1, 2) n left join cells c on c.cell = n.cell",
        "window_order": x + "select spk_id, row_number() over (partition by recording_id order by log_isi, spk_id) place from x where log_isi is not null and recording_id is not null",
        "subsample_clip": x + ", s as (select spk_id, peak_sharpness v from x where peak_sharpness is not null order by md5(spk_id::varchar) limit 2000) select spk_id, round(least(v, (select quantile_cont(v, 0.99) from s)), 6) clipped from s",
        "within_between_scalar": x + ", m as (select cell, avg(peak_sharpness) m from x where cell is not null and peak_sharpness is not null group by 1), j as (select x.cell, spk_id, max(abs(peak_sharpness - m)) filter (where m.cell = x.cell) own, avg(abs(peak_sharpness - m)) filter (where m.cell != x.cell) other from x, m where x.cell is not null and peak_sharpness is not null group by 1, 2) select cell, count(*) n, round(avg(own), 6) d_within, round(avg(other), 6) d_between, round(avg(case when own > other then 1.0::double else 0 end), 6) exceeds from j group by 1",
        "temporal_stability": timed + ", r as (select recording_id, max(duration_ms) dur from recordings group by 1), m as (select cell, avg(v) m from y group by 1) select cell, count(*) n, round(regr_slope(abs(v - m), ms / dur), 5) slope, round(regr_intercept(abs(v - m), ms / dur), 5) intercept from y join r using (recording_id) join m using (cell) where dur > 0 group by 1 having count(*) >= 30",
        "slope_and_rho": timed + ", z as (select recording_id, ms, v, case pa when 'high' then 0 when 'low' then 1 else 2 end code from y where pa is not null), g as (select recording_id, count(*) n, avg(v) m, stddev_pop(v) sd from z group by 1 having count(*) >= 30 and stddev_pop(v) > 0), k as (select recording_id, n, ms, v, m, sd, rank() over (partition by recording_id order by ms) + (count(*) over (partition by recording_id, ms) - 1) / 2.0::double ra, rank() over (partition by recording_id order by code) + (count(*) over (partition by recording_id, code) - 1) / 2.0::double rb from z join g using (recording_id)) select recording_id, any_value(n) n, round(regr_slope(abs(v - m) / sd, ms / 1000), 6) slope, round(case when min(rb) < max(rb) then corr(ra, rb) end, 6) rho from k group by 1",
        "fit_and_decay": x + ", f as (select recording_id, avg(r2_exp) a, max(r2_exp) m from x where recording_id is not null group by 1), c as (select recording_id, count(*) n, corr(exp_lambda, peak_sharpness) r from x where exp_lambda is not null and peak_sharpness is not null group by 1 having count(*) >= 10) select recording_id, n, round(a, 6) mean_r2, round(m, 6) max_r2, round(r, 5) r from f join c using (recording_id)",
        "effect_correlations": eff + ", p as (select a.feature || '|' || b.feature pair, abs(a.d) a, abs(b.d) b from d a join d b on a.recording_id = b.recording_id and a.feature < b.feature), r as (select pair, rank() over (partition by pair order by a) + (count(*) over (partition by pair, a) - 1) / 2.0::double ra, rank() over (partition by pair order by b) + (count(*) over (partition by pair, b) - 1) / 2.0::double rb from p) select pair, count(*) n, round(corr(ra, rb), 6) rho from r group by 1 having count(*) >= 5",
        "significant_combos": eff + "select feature, arg_max(recording_id, (abs(d), recording_id)) recording_id, arg_max(d, (abs(d), recording_id)) d, case when max(abs(d)) >= 0.8 then 'large' when max(abs(d)) >= 0.5 then 'medium' else 'small' end size, count(*) n, round(avg(case when abs(d) >= 0.5 then 1.0::double else 0 end), 6) share from d group by 1",
        "population_scatter": x + ", y as (select recording_id, inflection_time t, peak_sharpness q from x where inflection_time is not null and peak_sharpness is not null and recording_id is not null), g as (select recording_id, regr_slope(t, q) b, regr_intercept(t, q) a from y group by 1 having count(*) >= 20 and regr_r2(t, q) >= 0.01) select count(distinct recording_id) recordings, count(*) n, round(corr(t, a + b * q) ^ 2, 5) r2 from y join g using (recording_id)",
        "window_expansion": x + ", w as (select log_isi y, lag(log_isi, 8) over o i, lead(log_isi, 16) over o far" + "".join(f", avg(log_isi) over (partition by recording_id order by spk_id rows between {k} preceding and 1 preceding) m{k}" for k in (1, 2, 4, 8)) + " from x where log_isi is not null and recording_id is not null window o as (partition by recording_id order by spk_id)) " + " union all ".join(f'select {k} "window", count(*) n, round(corr(y, m{k}) ^ 2, 6) r2, round(corr(far, m{k}) ^ 2, 6) control from w where i is not null and far is not null' for k in (1, 2, 4, 8)),
        "tukey_hsd": "with g as (select c_mktsegment k, count(*) n, avg(c_acctbal) m, var_pop(c_acctbal) v from customer group by 1), t as (select sum(n) nn, count(*) kk, sum(n * v) / (sum(n) - count(*)) ms from g) select a.k a, b.k b, round(abs(a.m - b.m) / sqrt(ms / 2 * (1.0::double / a.n + 1.0::double / b.n)), 6) q, kk k, cast(nn - kk as bigint) df from g a join g b on a.k < b.k cross join t",
        "recording_status": "select recording_id, count(distinct chunk_id) chunks, case when max(fs) is null or not max(fs) > 0 then 'error' when not bool_or(coalesce(len(samples) > 0, false)) then 'skipped' else 'ok' end status from recordings where recording_id is not null group by 1",
        "flatten_nested": f"with o as (select * from burst_lists where recording_id is not null qualify row_number() over (partition by recording_id, chunk_id) = 1), u as ({lists}) select recording_id, burst_list, count(*) n, round(sum((p.t_end - p.t_start) * case when time_unit = 's' then 1000.0::double else 1 end), 3) total_ms from u where p.t_start is not null and p.t_end is not null and not isnan(p.t_start) and not isnan(p.t_end) and p.t_end > p.t_start group by 1, 2",
        "trough_segments": "with w as (select vec_id, list_transform(embedding, lambda v: v::double) wf from embeddings), p as (select *, list_position(wf, list_min(wf)) p from w), g as (select vec_id, unnest(range(0, 9)) k, unnest(list_transform(range(-4, 5), lambda k: case when p + k between 1 and len(wf) then wf[p + k] end)) v from p) select vec_id, k, round(v - avg(v) over (partition by vec_id), 6) v from g",
    }
