"""Queries over waveforms (arrays of samples) and their groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import waveform as wf
from .base import S, samples, table, waveforms


def r6(c):
    return F.round(c, 6)


def half_width_array(s, d):
    return waveforms(s, d).select("vec_id", wf.half_width(F.col("wf")).alias("half_width"))


def argmax_abs_position(s, d):
    return waveforms(s, d).select("vec_id", wf.argmax(wf.absolute(F.col("wf"))).alias("pos"))


def peak_align_mean(s, d):
    """Mean waveform per label after each waveform's largest magnitude is moved to 0."""
    w = waveforms(s, d).select("label", wf.argmax(wf.absolute(F.col("wf"))).alias("p"), "wf")
    x = w.select("label", "p", F.posexplode("wf").alias("pos", "x"))
    return x.groupBy("label", (F.col("pos") - F.col("p")).cast("long").alias("rel")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("mean"))


def peak_align_trim(s, d):
    """Mean of the eight samples on either side of the peak, where all are there."""
    w = waveforms(s, d).withColumn("p", wf.argmax(wf.absolute(F.col("wf"))))
    t = w.select("vec_id", wf.window(F.col("wf"), F.col("p"), 8, 8).alias("cut")).filter("cut is not null")
    return t.select("vec_id", r6(wf.mean(F.col("cut"))).alias("mean"))


def group_mean_waveform(s, d):
    return samples(s, d).groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("mean"), r6(F.stddev_pop("x")).alias("sd"))


def _mean_arrays(s, d):
    """Mean waveform per label as an array; one row per label."""
    m = samples(s, d).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda v: v["m"]).alias("m"))


def waveform_rmse_to_mean(s, d):
    """Distance of every waveform to its label's mean."""
    j = waveforms(s, d).join(_mean_arrays(s, d), "label")
    return j.select("vec_id", r6(wf.rmse(F.col("wf"), F.col("m"))).alias("rmse"), r6(wf.mae(F.col("wf"), F.col("m"))).alias("mae"))


def nrmse_cosine_pairs(s, d):
    """Distances of the mean waveforms of all pairs of labels (a set whose size the labels bound)."""
    m = _mean_arrays(s, d)
    a, b = m.select(F.col("label").alias("l1"), F.col("m").alias("a")), m.select(F.col("label").alias("l2"), F.col("m").alias("b"))
    j = a.join(b, F.col("l1") < F.col("l2"))
    return j.select("l1", "l2", r6(wf.nrmse(F.col("a"), F.col("b"))).alias("nrmse"), r6(wf.cosine(F.col("a"), F.col("b"))).alias("cosine"))


def _distances(s, d):
    m = _mean_arrays(s, d).select(F.col("label").alias("other"), "m")
    means = m.agg(F.collect_list(F.struct("other", "m")).alias("ms"))
    # one row with one mean per label: a set that the labels bound, not the waveforms
    j = waveforms(s, d).join(F.broadcast(means))
    j = j.select("vec_id", "label", "wf", F.inline("ms"))
    return j.select("vec_id", "label", "other", wf.rmse(F.col("wf"), F.col("m")).alias("r"))


def within_between_distance(s, d):
    """Median distance to the own mean and to the other labels' means, per label."""
    x = _distances(s, d)
    own = F.col("label") == F.col("other")
    return x.groupBy("label").agg(r6(F.percentile(F.when(own, F.col("r")), 0.5)).alias("own"), r6(F.percentile(F.when(~own, F.col("r")), 0.5)).alias("others"))


def pct_within_exceeds_between(s, d):
    """Share of a label's waveforms further from their own mean than the label's median distance to others."""
    x = _distances(s, d)
    own = F.col("label") == F.col("other")
    b = x.filter(~own).groupBy("label").agg(F.percentile("r", 0.5).alias("med"))
    return x.filter(own).join(b, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("r") > F.col("med")).cast("double"))).alias("share"))


def control_point_midcross(s, d):
    """First samples at or below half the peak on either side of it."""
    w = waveforms(s, d).withColumn("p", wf.argmax(F.col("wf"))).withColumn("mid", F.array_max("wf") / 2)
    left = F.reverse(F.slice("wf", F.lit(1), F.col("p").cast("int")))
    right = F.slice("wf", (F.col("p") + 1).cast("int"), F.size("wf"))
    rise, decay = wf.first_at_most(left, F.col("mid")), wf.first_at_most(right, F.col("mid"))
    w = w.withColumn("k1", F.when(F.col("p") > 0, rise)).withColumn("k2", decay)
    return w.select("vec_id", F.col("p").alias("peak"), (F.col("p") - 1 - F.col("k1")).alias("rise"), (F.col("p") + F.col("k2")).alias("decay"))


def zscore_normalize(s, d):
    """Standardised waveforms: their largest and smallest sample."""
    z = waveforms(s, d).select("vec_id", F.col("wf"), wf.mean(F.col("wf")).alias("m"), wf.std_pop(F.col("wf")).alias("sd"))
    sd = F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return z.select("vec_id", r6((F.array_max("wf") - F.col("m")) / sd).alias("top"), r6((F.array_min("wf") - F.col("m")) / sd).alias("low"))


def alt_udf(s, d):
    """User function over every waveform: here mean and spread of its second half."""
    half = F.slice("wf", 33, 32)
    return waveforms(s, d).select("vec_id", r6(wf.mean(half)).alias("alt_mean"), r6(wf.std_pop(half)).alias("alt_std"))


def window_min_alt(s, d):
    return waveforms(s, d).select("vec_id", r6(F.array_min("wf")).alias("low"), wf.argmax(F.transform("wf", lambda x: -x)).alias("low_pos"))


def decimated_trapezoid(s, d):
    """Area under every fourth sample, and the smoothed maximum."""
    w = waveforms(s, d).select("vec_id", "wf", wf.decimate(F.col("wf"), 4).alias("q"))
    return w.select("vec_id", F.size("q").cast("long").alias("n"), r6(wf.trapezoid(F.col("q"), F.lit(4.0))).alias("area"))


def voltage_lookup(s, d):
    """Samples at fixed control points."""
    return waveforms(s, d).select("vec_id", *[r6(F.element_at("wf", p + 1)).alias(f"v{p}") for p in (0, 16, 32, 48, 63)])


def peak_to_next_trough(s, d):
    """Place and value of the lowest sample within ten behind the peak; null if none is lower than the peak's neighbour."""
    w = waveforms(s, d).withColumn("p", wf.argmax(F.col("wf")))
    t = w.withColumn("tail", F.slice("wf", (F.col("p") + 2).cast("int"), 10)).filter("size(tail) > 0")
    return t.select("vec_id", r6(F.array_min("tail")).alias("trough"), (F.col("p") + 1 + wf.argmax(F.transform("tail", lambda x: -x))).alias("pos"))


def iqr_outlier_filter(s, d):
    """Lines whose price lies inside Q1 - 1.5 IQR .. Q3 + 1.5 IQR of their flag."""
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    q = l.groupBy("l_returnflag").agg(F.percentile("l_extendedprice", 0.25).alias("a"), F.percentile("l_extendedprice", 0.75).alias("b"))
    k = 1.5 * (F.col("b") - F.col("a"))
    return l.join(q, "l_returnflag").filter((F.col("l_extendedprice") >= F.col("a") - k) & (F.col("l_extendedprice") <= F.col("b") + k)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


def validity_bounds(s, d):
    """Values outside a column's bounds become null."""
    b = {"p_size": (5, 45), "p_retailprice": (920.0, 1500.0)}
    p = table(s, d, "part")
    return p.select("p_partkey", *[F.when(F.col(c).between(lo, hi), F.col(c)).alias(c) for c, (lo, hi) in b.items()])


def threshold_labels(s, d):
    v = F.col("value")
    return table(s, d, "events").select("event_id", F.when(v <= 33, "low").when(v <= 66, "mid").when(v > 66, "high").alias("label"))


def _histogram(s, d):
    e = table(s, d, "events").filter("value is not null").select("event_type", "value")
    q = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), (F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("iqr"))
    fd = F.when(F.col("iqr") > 0, F.ceil((F.col("hi") - F.col("lo")) / (2 * F.col("iqr") * F.pow(F.col("n"), F.lit(-1.0 / 3))))).otherwise(F.floor(F.sqrt("n")))
    q = q.withColumn("k", F.greatest(F.lit(10), F.least(F.lit(80), fd)).cast("long")).withColumn("w", (F.col("hi") - F.col("lo")) / F.col("k"))
    x = e.join(q, "event_type").select("event_type", "k", "n", "w", F.least(F.floor((F.col("value") - F.col("lo")) / F.col("w")), F.col("k") - 1).cast("long").alias("bin"))
    return x.groupBy("event_type", "k", "n", "w", "bin").agg(F.count(F.lit(1)).alias("c"))


def histogram_fd(s, d):
    """Histogram with Freedman-Diaconis bins (10 to 80), counts and densities."""
    return _histogram(s, d).select("event_type", F.col("k").alias("bins"), "bin", "c", r6(F.col("c") / (F.col("n") * F.col("w"))).alias("density"))


def histogram_peaks(s, d):
    """Strict maxima of the histogram after 5-tap smoothing, empty bins counted as 0."""
    h = _histogram(s, d)
    grid = h.select("event_type", "k").distinct().select("event_type", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("bin"))
    f = grid.join(h.select("event_type", "bin", "c"), ["event_type", "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    w = Window.partitionBy("event_type").orderBy("bin")
    at = lambda k: F.coalesce(F.lag("c", k).over(w), F.lit(0))
    f = f.withColumn("sm", reduce(lambda a, b: a + b, [at(k) * wt for k, wt in ((-2, 1), (-1, 2), (0, 3), (1, 2), (2, 1))]))
    f = f.withColumn("a", F.lag("sm").over(w)).withColumn("b", F.lead("sm").over(w))
    return f.filter("sm > a and sm > b").select("event_type", "bin", F.col("sm").cast("long").alias("sm"))


NAMES = "half_width_array argmax_abs_position peak_align_mean peak_align_trim group_mean_waveform waveform_rmse_to_mean nrmse_cosine_pairs within_between_distance pct_within_exceeds_between control_point_midcross zscore_normalize alt_udf window_min_alt decimated_trapezoid voltage_lookup peak_to_next_trough iqr_outlier_filter validity_bounds threshold_labels histogram_fd histogram_peaks"


def queries():
    return {n: globals()[n] for n in NAMES.split()}


def oracle_sql():
    pk = S + ", t as (select vec_id, max(abs(x)) t, max(x) tx, min(x) tn from s group by 1), p as (select s.vec_id, min(pos) p from s join t using (vec_id) where abs(x) = t group by 1), px as (select s.vec_id, min(pos) p, any_value(tx) tx from s join t using (vec_id) where x = tx group by 1), m as (select label, pos, avg(x) m from s group by all)"
    dist = pk + ", r as (select s.vec_id, s.label, m.label as other, sqrt(avg((x - m) ^ 2)) r from s join m using (pos) group by all)"
    hist = (
        "with e as (select event_type, value from events where value is not null), q as (select event_type, count(*) n, min(value) lo, max(value) hi, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) iqr from e group by 1),"
        " k as (select *, (hi - lo) / k w from (select *, cast(greatest(10, least(80, case when iqr > 0 then ceil((hi - lo) / (2 * iqr * pow(n, -1.0::double / 3))) else floor(sqrt(n)) end)) as bigint) k from q)),"
        " h as (select event_type, k, n, w, cast(least(floor((value - lo) / w), k - 1) as bigint) bin, count(*) c from e join k using (event_type) group by all)"
    )
    return {
        "half_width_array": pk + " select vec_id, count(*) half_width from s join t using (vec_id) where abs(x) >= 0.5::double * t group by 1",
        "argmax_abs_position": pk + " select vec_id, p pos from p",
        "peak_align_mean": pk + " select label, pos - p rel, count(*) n, round(avg(x), 6) mean from s join p using (vec_id) group by all",
        "peak_align_trim": pk + " select vec_id, round(avg(x), 6) mean from s join p using (vec_id) where p >= 8 and p + 8 < 64 and pos between p - 8 and p + 8 group by 1",
        "group_mean_waveform": S + "select label, pos, count(*) n, round(avg(x), 6) mean, round(stddev_pop(x), 6) sd from s group by all",
        "waveform_rmse_to_mean": pk + " select vec_id, round(sqrt(avg((x - m) ^ 2)), 6) rmse, round(avg(abs(x - m)), 6) mae from s join m using (label, pos) group by 1",
        "nrmse_cosine_pairs": pk + " select a.label l1, b.label l2, round(sqrt(avg((a.m - b.m) ^ 2)) / greatest(max(abs(a.m)), max(abs(b.m))), 6) nrmse, round(sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 6) cosine from m a join m b using (pos) where a.label < b.label group by 1, 2",
        "within_between_distance": dist + " select label, round(quantile_cont(r, 0.5) filter (where label = other), 6) own, round(quantile_cont(r, 0.5) filter (where label != other), 6) others from r group by 1",
        "pct_within_exceeds_between": dist + ", b as (select label, quantile_cont(r, 0.5) med from r where label != other group by 1) select label, count(*) n, round(avg(case when r > med then 1.0 else 0.0 end), 6) share from r join b using (label) where label = other group by 1",
        "control_point_midcross": pk + " select px.vec_id, p peak, max(pos) filter (where pos < p and x <= tx / 2) rise, min(pos) filter (where pos >= p and x <= tx / 2) decay from px join s using (vec_id) group by 1, 2",
        "zscore_normalize": S + "select vec_id, round((max(x) - avg(x)) / case when stddev_pop(x) = 0 then 1 else stddev_pop(x) end, 6) top, round((min(x) - avg(x)) / case when stddev_pop(x) = 0 then 1 else stddev_pop(x) end, 6) low from s group by 1",
        "alt_udf": S + "select vec_id, round(avg(x), 6) alt_mean, round(stddev_pop(x), 6) alt_std from s where pos >= 32 group by 1",
        "window_min_alt": pk + " select s.vec_id, round(any_value(tn), 6) low, min(pos) low_pos from s join t using (vec_id) where x = tn group by 1",
        "decimated_trapezoid": S + "select vec_id, count(*) n, round(4 * (sum(x) - (sum(x) filter (where pos = 0) + sum(x) filter (where pos = 60)) / 2), 6) area from s where pos % 4 = 0 group by 1",
        "voltage_lookup": S + "select vec_id, " + ", ".join(f"round(sum(x) filter (where pos = {p}), 6) v{p}" for p in (0, 16, 32, 48, 63)) + " from s group by 1",
        "peak_to_next_trough": pk + ", l as (select s.vec_id, min(x) t from s join px using (vec_id) where pos between p + 1 and p + 10 group by 1) select s.vec_id, round(any_value(t), 6) trough, min(pos) pos from s join px using (vec_id) join l using (vec_id) where pos between p + 1 and p + 10 and x = t group by 1",
        "iqr_outlier_filter": "with q as (select l_returnflag, quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.75) b from lineitem group by 1) select l_returnflag, count(*) n, round(avg(l_extendedprice), 4) mean from lineitem join q using (l_returnflag) where l_extendedprice between a - 1.5 * (b - a) and b + 1.5 * (b - a) group by 1",
        "validity_bounds": "select p_partkey, case when p_size between 5 and 45 then p_size end p_size, case when p_retailprice between 920 and 1500 then p_retailprice end p_retailprice from part",
        "threshold_labels": "select event_id, case when value <= 33 then 'low' when value <= 66 then 'mid' when value > 66 then 'high' end label from events",
        "histogram_fd": hist + " select event_type, k bins, bin, c, round(c / (n * w), 6) density from h",
        "histogram_peaks": hist + ", g as (select event_type, unnest(range(0, k)) bin from k), f as (select g.*, coalesce(c, 0) c from g left join h using (event_type, bin)), m as (select *, coalesce(lag(c, 2) over w, 0) + 2 * coalesce(lag(c) over w, 0) + 3 * c + 2 * coalesce(lead(c) over w, 0) + coalesce(lead(c, 2) over w, 0) sm from f window w as (partition by event_type order by bin)), n as (select *, lag(sm) over w a, lead(sm) over w b from m window w as (partition by event_type order by bin)) select event_type, bin, sm from n where sm > a and sm > b",
    }
