"""Queries between events: intervals, counts, transitions, rates and rolling statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import inter_event as ie
from ..operators.hot import row_windows
from .base import E, events, table

HOUR, DAY = 3_600_000_000, 86_400_000_000


def W():
    return ie.ordered("user_id", "us", "event_id")


_ISI = "round((lead(us) over w - us) / 1000.0, 6)"
_PREV = "round((us - lag(us) over w) / 1000.0, 6)"
_W = " window w as (partition by user_id order by us, event_id)"


def near(s, d, before, after, columns):
    """Events with windows over their users' neighbouring events; a user may hold any share of them."""
    return row_windows(events(s, d), "user_id", ["us", "event_id"], before, after, columns)


def r6(c):
    return F.round(c, 6)


def isi_next(s, d):
    return near(s, d, 0, 1, {"isi": lambda w: ie.isi_next("us", w)}).select("event_id", r6("isi").alias("isi"))


def isi_prev(s, d):
    return near(s, d, 1, 0, {"isi_prev": lambda w: ie.isi_prev("us", w)}).select("event_id", r6("isi_prev").alias("isi_prev"))


def event_count_preceding(s, d):
    return events(s, d).select("event_id", ie.count_preceding("us", "user_id", HOUR).alias("n_1h"), ie.count_preceding("us", "user_id", DAY).alias("n_24h"))


def log_isi_features(s, d):
    e = near(s, d, 1, 1, {"a": lambda w: ie.isi_next("us", w), "b": lambda w: ie.isi_prev("us", w)})
    return e.select("event_id", r6(ie.log10_positive(F.col("a"))).alias("log_isi"), r6(ie.log10_positive(F.col("b"))).alias("log_isi_prev"))


def quality_filter(s, d):
    """Four range predicates over features of an event; nulls fail."""
    e = events(s, d).select("event_id", "user_id", "value", ie.isi_next("us", W()).alias("isi"), ie.isi_prev("us", W()).alias("isi_prev"), ie.count_preceding("us", "user_id", DAY).alias("n"))
    return e.filter((F.col("isi") > 60_000) & (F.col("isi_prev") > 60_000) & (F.col("n") >= 1) & F.col("value").between(10, 90)).select("event_id", r6("value").alias("value"), "n")


def local_maxima(s, d):
    """Strict local maxima of the value series of a user, at least 50 high."""
    e = near(s, d, 1, 1, {"a": lambda w: F.lag("value").over(w), "b": lambda w: F.lead("value").over(w)})
    return e.filter("value > a and value > b and value >= 50").select("event_id", "user_id", r6("value").alias("value"))


def peaks_with_plateau(s, d):
    """Local maxima where equal neighbours form a plateau whose middle (rounded down) is the peak."""
    e = events(s, d).select("user_id", F.row_number().over(W()).alias("i"), F.round("value", -1).alias("v"))
    w = ie.ordered("user_id", "i")
    runs = e.withColumn("new", F.when(F.lag("v").over(w).isNull() | (F.lag("v").over(w) != F.col("v")), 1).otherwise(0)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = runs.groupBy("user_id", "run").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.first("v").alias("v"))
    wr = ie.ordered("user_id", "run")
    p = g.select("user_id", "a", "b", "v", F.lag("v").over(wr).alias("pv"), F.lead("v").over(wr).alias("nv"))
    return p.filter("v > pv and v > nv").select("user_id", F.floor((F.col("a") + F.col("b")) / 2).cast("long").alias("i"), "v")


def refine_peak_argmax(s, d):
    """Every event re-centred on the largest value within three events on either side (first of ties)."""
    e = events(s, d).select("event_id", "user_id", "value", F.row_number().over(W()).cast("long").alias("i"))
    best = F.min(F.struct((-F.col("value")).alias("v"), "i")).over(ie.ordered("user_id", "i").rowsBetween(-3, 3))
    return e.select("event_id", best["i"].alias("peak_i"))


def dedup_keep_first(s, d):
    """Re-centred peaks, each once: the first event that leads to it."""
    e = events(s, d).select("event_id", "user_id", "value", F.row_number().over(W()).cast("long").alias("i"))
    best = F.min(F.struct((-F.col("value")).alias("v"), "i")).over(ie.ordered("user_id", "i").rowsBetween(-3, 3))
    p = e.select("event_id", "user_id", "i", best["i"].alias("peak_i"))
    first = F.row_number().over(Window.partitionBy("user_id", "peak_i").orderBy("i"))
    return p.withColumn("r", first).filter("r = 1").select("user_id", "peak_i", "event_id")


def decay_duplicates(s, d):
    """Events kept: none of the five before is higher."""
    e = near(s, d, 5, 0, {"top": lambda w: F.max("value").over(w.rowsBetween(-5, -1))})
    return e.filter("top is null or top <= value").select("event_id", r6("value").alias("value"))


def window_slice_stats(s, d):
    """Mean, extremes and spread of the eleven events around each one; events near an end are dropped."""
    frame = lambda f: lambda w: f("value").over(w.rowsBetween(-5, 5))
    rows = lambda w: F.count(F.lit(1)).over(w.rowsBetween(-5, 5))
    e = near(s, d, 5, 5, {"n": rows, "m": frame(F.avg), "lo": frame(F.min), "hi": frame(F.max)})
    return e.filter("n = 11").select("event_id", r6("m").alias("mean"), r6("lo").alias("lo"), r6("hi").alias("hi"))


def window_drop_edges(s, d):
    """Events whose window of three before and seven after lies inside the series."""
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    e = events(s, d).withColumn("i", F.row_number().over(W())).withColumn("n", n)
    return e.filter("i > 3 and i + 7 <= n").select("event_id", F.col("i").cast("long").alias("i"))


def sharpness(s, d):
    """Mean drop from an event to its second neighbours."""
    v = F.col("value")
    e = near(s, d, 2, 2, {"a": lambda w: F.lag("value", 2).over(w), "b": lambda w: F.lead("value", 2).over(w)})
    return e.select("event_id", r6(((v - F.col("a")) + (v - F.col("b"))) / 2).alias("sharpness"))


def shape_symmetry(s, d):
    """Around local minima: durations to the neighbouring extremes and their fractions of the whole."""
    at = lambda f, c: lambda w: f(c).over(w)
    e = near(s, d, 1, 1, {"a": at(F.lag, "value"), "b": at(F.lead, "value"), "ua": at(F.lag, "us"), "ub": at(F.lead, "us")})
    t = e.filter("value < a and value < b and ub > ua")
    return t.select("event_id", ((F.col("us") - F.col("ua")) / 1000.0).alias("decay_ms"), ((F.col("ub") - F.col("us")) / 1000.0).alias("rise_ms"), r6((F.col("us") - F.col("ua")) / (F.col("ub") - F.col("ua"))).alias("decay_sym"))


def trough_threshold(s, d):
    """Local minima below the mean less one standard deviation of their series."""
    u = Window.partitionBy("user_id")
    e = events(s, d).select("event_id", "value", F.lag("value").over(W()).alias("a"), F.lead("value").over(W()).alias("b"), (F.avg("value").over(u) - F.stddev_pop("value").over(u)).alias("t"))
    return e.filter("value < a and value < b and value < t").select("event_id", r6("value").alias("value"))


def transition_matrix(s, d):
    e = near(s, d, 0, 1, {"to_label": lambda w: F.lead("event_type").over(w)})
    t = ie.transition_counts(e.select(F.col("event_type").alias("from_label"), "to_label"))
    return t.select("from_label", "to_label", "n", r6("p").alias("p"))


def transition_pivot(s, d):
    """The transition counts with one column per following label, by name: n_a to n_z, then n_27 and so on."""
    e = events(s, d).select("event_type", F.lead("event_type").over(W()).alias("nxt")).filter("nxt is not null")
    known = [r[0] for r in table(s, d, "events").select("event_type").filter("event_type is not null").distinct().orderBy("event_type").collect()]
    kinds = ["n_" + (chr(ord("a") + i) if i < 26 else str(i + 1)) for i in range(len(known))]
    p = e.groupBy("event_type").pivot("nxt", known).agg(F.count(F.lit(1)))
    return p.select("event_type", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(n) for k, n in zip(known, kinds)])


def label_rate_bins(s, d):
    """Events of a type per day and per hour of that day."""
    day = F.floor(F.col("us") / DAY).cast("long").alias("day")
    return events(s, d).groupBy("event_type", day).agg(F.count(F.lit(1)).alias("n"), r6(F.count(F.lit(1)) / 24.0).alias("per_hour"))


def rolling_mean_centered(s, d):
    """Centred rolling mean over 50 events (25 before, 24 after) where all are there."""
    e = near(s, d, 25, 24, {"n": lambda w: F.count("value").over(w.rowsBetween(-25, 24)), "m": lambda w: F.avg("value").over(w.rowsBetween(-25, 24))})
    return e.filter("n = 50").select("event_id", r6("m").alias("rolling_mean"))


def _bins(s, d, n):
    u = Window.partitionBy("user_id")
    return events(s, d).withColumn("bin", ie.equal_bins(F.col("us"), F.min("us").over(u), F.max("us").over(u), n)).filter("bin is not null")


def _bins_sql(n):
    return E + f", x as (select *, min(us) over (partition by user_id) lo, max(us) over (partition by user_id) hi from e), b as (select *, cast(least(floor((us - lo) / ((hi - lo) / {n}.0)), {n - 1}) as bigint) bin from x where hi > lo) "


def time_norm_percentiles(s, d):
    """Five percentiles of the value in 20 equal bins of a user's own time span."""
    p = F.percentile("value", F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    b = _bins(s, d, 20).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), p.alias("p"))
    return b.select("bin", "n", *[r6(F.col("p")[i]).alias(c) for i, c in enumerate(("p10", "p25", "p50", "p75", "p90"))])


def rolling_iqr(s, d):
    """Interquartile range per tenth of a user's span over the user's mean one."""
    b = _bins(s, d, 10).groupBy("user_id", "bin").agg((F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("iqr"), F.count(F.lit(1)).alias("n"))
    m = F.avg("iqr").over(Window.partitionBy("user_id"))
    return b.withColumn("m", m).select("user_id", "bin", "n", F.when(F.col("m") > 0, r6(F.col("iqr") / F.col("m"))).alias("iqr_norm"))


def temporal_slope(s, d):
    """Slope and fit of the absolute deviation from a user's median over normalised time."""
    med = events(s, d).groupBy("user_id").agg(F.percentile("value", 0.5).alias("med"), F.min("us").alias("lo"), F.max("us").alias("hi"))
    x = events(s, d).join(med, "user_id").filter("hi > lo").select("user_id", F.abs(F.col("value") - F.col("med")).alias("y"), ((F.col("us") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("t"))
    return x.groupBy("user_id").agg(r6(F.regr_slope("y", "t")).alias("slope"), r6(F.regr_r2("y", "t")).alias("r2"))


def rate_stability(s, d):
    """Events per tenth of a user's span over the mean of the tenths that have any."""
    b = _bins(s, d, 10).groupBy("user_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    return b.withColumn("rate", r6(F.col("n") / F.avg("n").over(Window.partitionBy("user_id"))))


def isi_regularity(s, d):
    """Coefficient of variation of the intervals of users with three events or more."""
    i = near(s, d, 0, 1, {"isi": lambda w: ie.isi_next("us", w)})
    g = i.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("isi").alias("m"), F.stddev_pop("isi").alias("sd"))
    return g.filter("n >= 3 and m > 0").select("user_id", "n", r6(F.col("sd") / F.col("m")).alias("cv"))


def baseline_median_bins(s, d):
    """Median value per user and day."""
    day = F.floor(F.col("us") / DAY).cast("long").alias("day")
    return events(s, d).groupBy("user_id", day).agg(r6(F.percentile("value", 0.5)).alias("baseline"))


def sta(s, d):
    """Event-triggered average: value by offset around purchases, from four events before to four after."""
    e = events(s, d).select("user_id", "event_type", "value", F.row_number().over(W()).alias("i"))
    p = e.filter("event_type = 'purchase'").select("user_id", F.col("i").alias("c"), F.explode(F.sequence(F.lit(-4), F.lit(4))).alias("k"))
    j = p.join(e, (p["user_id"] == e["user_id"]) & (e["i"] == p["c"] + p["k"]))
    return j.groupBy(F.col("k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("sd"))


def bin_ordinal(s, d):
    """Mean label code per day of a user, gaps between days filled linearly."""
    code = F.when(F.col("value") <= 33, 0.0).when(F.col("value") <= 66, 1.0).otherwise(2.0)
    b = events(s, d).filter("value is not null").groupBy("user_id", F.floor(F.col("us") / DAY).cast("long").alias("day")).agg(F.avg(code).alias("m"))
    w = ie.ordered("user_id", "day")
    n = b.withColumn("nd", F.lead("day").over(w)).withColumn("nm", F.lead("m").over(w))
    g = n.select("user_id", "day", "m", "nd", "nm", F.explode(F.sequence(F.col("day"), F.coalesce(F.col("nd") - 1, F.col("day")))).alias("at"))
    return g.select("user_id", F.col("at").alias("day"), r6(F.when(F.col("at") == F.col("day"), F.col("m")).otherwise(F.col("m") + (F.col("nm") - F.col("m")) * (F.col("at") - F.col("day")) / (F.col("nd") - F.col("day")))).alias("level"))


def cluster_mix_after(s, d):
    """Label fractions after the middle of a user's span; users with fewer than ten events there are left out."""
    u = Window.partitionBy("user_id")
    e = events(s, d).withColumn("cp", (F.min("us").over(u) + F.max("us").over(u)) / 2).filter("us > cp")
    g = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("k")).withColumn("n", F.sum("k").over(u))
    return g.filter("n >= 10").select("user_id", "event_type", r6(F.col("k") / F.col("n")).alias("fraction"))


def queries():
    names = "isi_next isi_prev event_count_preceding log_isi_features quality_filter local_maxima peaks_with_plateau refine_peak_argmax dedup_keep_first decay_duplicates window_slice_stats window_drop_edges sharpness shape_symmetry trough_threshold transition_matrix transition_pivot label_rate_bins rolling_mean_centered time_norm_percentiles rolling_iqr temporal_slope rate_stability isi_regularity baseline_median_bins sta bin_ordinal cluster_mix_after"
    return {n: globals()[n] for n in names.split()}


def oracle_sql():
    num = E + ", n as (select *, row_number() over (partition by user_id order by us, event_id) i from e) "
    cnt = "count(*) over (partition by user_id order by us range between {} preceding and current row) - 1"
    peak = "(select b.i from n b where b.user_id = a.user_id and b.i between a.i - 3 and a.i + 3 order by b.value desc, b.i limit 1)"
    return {
        "isi_next": E + f"select event_id, {_ISI} isi from e" + _W,
        "isi_prev": E + f"select event_id, {_PREV} isi_prev from e" + _W,
        "event_count_preceding": E + f"select event_id, {cnt.format(HOUR - 1)} n_1h, {cnt.format(DAY - 1)} n_24h from e",
        "log_isi_features": E + ", x as (select event_id, (lead(us) over w - us) / 1000.0 a, (us - lag(us) over w) / 1000.0 b from e" + _W + ") select event_id, round(case when a > 0 then log10(a) end, 6) log_isi, round(case when b > 0 then log10(b) end, 6) log_isi_prev from x",
        "quality_filter": E + f", x as (select *, (lead(us) over w - us) / 1000.0 a, (us - lag(us) over w) / 1000.0 b, {cnt.format(DAY - 1)} n from e{_W}) select event_id, round(value, 6) as value, n from x where a > 60000 and b > 60000 and n >= 1 and value between 10 and 90",
        "local_maxima": E + ", x as (select *, lag(value) over w a, lead(value) over w b from e" + _W + ") select event_id, user_id, round(value, 6) as value from x where value > a and value > b and value >= 50",
        "peaks_with_plateau": num + ", v as (select user_id, i, round(value, -1) v from n), r as (select *, sum(f) over (partition by user_id order by i rows unbounded preceding) run from (select *, case when lag(v) over (partition by user_id order by i) is distinct from v or i = 1 then 1 else 0 end f from v)), g as (select user_id, run, min(i) a, max(i) b, any_value(v) v from r group by all), p as (select *, lag(v) over (partition by user_id order by run) pv, lead(v) over (partition by user_id order by run) nv from g) select user_id, cast(floor((a + b) / 2.0) as bigint) i, v from p where v > pv and v > nv",
        "refine_peak_argmax": num + f"select event_id, {peak} peak_i from n a",
        "dedup_keep_first": num + f", p as (select event_id, user_id, i, {peak} peak_i from n a) select user_id, peak_i, arg_min(event_id, i) event_id from p group by all",
        "decay_duplicates": E + ", x as (select *, max(value) over (partition by user_id order by us, event_id rows between 5 preceding and 1 preceding) top from e) select event_id, round(value, 6) as value from x where top is null or top <= value",
        "window_slice_stats": E + ", x as (select event_id, count(*) over w n, avg(value) over w m, min(value) over w lo, max(value) over w hi from e window w as (partition by user_id order by us, event_id rows between 5 preceding and 5 following)) select event_id, round(m, 6) mean, round(lo, 6) lo, round(hi, 6) hi from x where n = 11",
        "window_drop_edges": num + ", c as (select *, count(*) over (partition by user_id) c from n) select event_id, i from c where i > 3 and i + 7 <= c",
        "sharpness": E + "select event_id, round(((value - lag(value, 2) over w) + (value - lead(value, 2) over w)) / 2, 6) sharpness from e" + _W,
        "shape_symmetry": E + ", x as (select *, lag(value) over w a, lead(value) over w b, lag(us) over w ua, lead(us) over w ub from e" + _W + ") select event_id, (us - ua) / 1000.0 decay_ms, (ub - us) / 1000.0 rise_ms, round((us - ua) / (ub - ua), 6) decay_sym from x where value < a and value < b and ub > ua",
        "trough_threshold": E + ", x as (select *, lag(value) over w a, lead(value) over w b, avg(value) over u - stddev_pop(value) over u t from e window w as (partition by user_id order by us, event_id), u as (partition by user_id)) select event_id, round(value, 6) as value from x where value < a and value < b and value < t",
        "transition_matrix": E + ", x as (select event_type f, lead(event_type) over w t from e" + _W + "), g as (select f, t, count(*) n from x where t is not null group by all) select f from_label, t to_label, n, round(n / sum(n) over (partition by f), 6) p from g",
        "transition_pivot": E + ", k as (select event_type, row_number() over (order by event_type) r from (select distinct event_type from e)), x as (select event_type, lead(event_type) over w t from e" + _W + ") select x.event_type, " + ", ".join(f"count(*) filter (where r = {i + 1}) n_{c}" for i, c in enumerate("abcde")) + " from x join k on x.t = k.event_type group by 1",
        "label_rate_bins": E + f"select event_type, us // {DAY} as day, count(*) n, round(count(*) / 24.0, 6) per_hour from e group by 1, 2",
        "rolling_mean_centered": E + ", x as (select event_id, count(value) over w n, avg(value) over w m from e window w as (partition by user_id order by us, event_id rows between 25 preceding and 24 following)) select event_id, round(m, 6) rolling_mean from x where n = 50",
        "time_norm_percentiles": _bins_sql(20) + "select bin, count(*) n, " + ", ".join(f"round(quantile_cont(value, {q}), 6) {c}" for q, c in ((0.1, "p10"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"))) + " from b group by bin",
        "rolling_iqr": _bins_sql(10) + ", g as (select user_id, bin, count(*) n, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) iqr from b group by all), m as (select *, avg(iqr) over (partition by user_id) m from g) select user_id, bin, n, case when m > 0 then round(iqr / m, 6) end iqr_norm from m",
        "temporal_slope": E + ", m as (select user_id, quantile_cont(value, 0.5) med, min(us) lo, max(us) hi from e group by 1), x as (select user_id, abs(value - med) y, (us - lo) / (hi - lo) t from e join m using (user_id) where hi > lo) select user_id, round(regr_slope(y, t), 6) slope, round(regr_r2(y, t), 6) r2 from x group by 1",
        "rate_stability": _bins_sql(10) + ", g as (select user_id, bin, count(*) n from b group by all) select *, round(n / avg(n) over (partition by user_id), 6) rate from g",
        "isi_regularity": E + ", x as (select user_id, (lead(us) over w - us) / 1000.0 isi from e" + _W + ") select user_id, count(*) n, round(stddev_pop(isi) / avg(isi), 6) cv from x group by 1 having count(*) >= 3 and avg(isi) > 0",
        "baseline_median_bins": E + f"select user_id, us // {DAY} as day, round(quantile_cont(value, 0.5), 6) baseline from e group by 1, 2",
        "sta": num + "select k, count(*) n, round(avg(b.value), 6) mean, round(stddev_pop(b.value), 6) sd from n a, range(-4, 5) r(k), n b where a.event_type = 'purchase' and b.user_id = a.user_id and b.i = a.i + k group by k",
        "bin_ordinal": E + f", b as (select user_id, us // {DAY} as day, avg(case when value <= 33 then 0.0 when value <= 66 then 1.0 else 2.0 end) m from e where value is not null group by 1, 2), n as (select *, lead(day) over (partition by user_id order by day) nd, lead(m) over (partition by user_id order by day) nm from b), g as (select *, unnest(range(day, coalesce(nd, day + 1))) t from n) select user_id, t as day, round(case when t = day then m else m + (nm - m) * (t - day) / (nd - day) end, 6) as level from g",
        "cluster_mix_after": E + ", x as (select *, (min(us) over (partition by user_id) + max(us) over (partition by user_id)) / 2 cp from e), g as (select user_id, event_type, count(*) k from x where us > cp group by all), n as (select *, sum(k) over (partition by user_id) n from g) select user_id, event_type, round(k / n, 6) fraction from n where n >= 10",
    }
