"""Queries over intervals, joins, sets and pivots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranges
from .base import E, events, table

HOUR, DAY = 3_600_000_000, 86_400_000_000


def r6(c):
    return F.round(c, 6)


def _spans(s, d, kind=None, length=2 * HOUR):
    e = events(s, d)
    e = e.filter(F.col("event_type") == kind) if kind else e
    return e.select("user_id", F.col("us").alias("start"), (F.col("us") + length).alias("end"))


def gap_merge_blocks(s, d):
    """Activity blocks: events merged while less than six hours apart, blocks of an hour at least."""
    p = events(s, d).select("user_id", F.col("us").alias("s"), F.col("us").alias("e"))
    b = ranges.islands(p, "user_id", "s", "e", 6 * HOUR, HOUR)
    return b.select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n")


def burst_runs(s, d):
    """Runs of at least two successive events above the 80th percentile of the user's values."""
    q = events(s, d).groupBy("user_id").agg(F.percentile("value", 0.8).alias("p80"))
    r = ranges.runs(events(s, d).join(q, "user_id"), "user_id", F.col("value") >= F.col("p80"), "us", "event_id")
    g = r.filter("mask").groupBy("user_id", "run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"))
    return g.filter("n >= 2").select("user_id", "start_us", "end_us", "n")


def classify_windows(s, d):
    """Days of a user as high (P80 and up), low (P25 and down) or rest by their mean value."""
    m = events(s, d).groupBy("user_id", F.floor(F.col("us") / DAY).cast("long").alias("day")).agg(F.avg("value").alias("m"))
    q = m.groupBy("user_id").agg(F.percentile("m", 0.8).alias("hi"), F.percentile("m", 0.25).alias("lo"))
    return m.join(q, "user_id").select("user_id", "day", F.when(F.col("m") >= F.col("hi"), "high").when(F.col("m") <= F.col("lo"), "low").otherwise("rest").alias("kind"))


def block_label_join(s, d):
    """Every event labelled by the spans that hold it: after a purchase first, after a signup next, else rest."""
    e = events(s, d).select("user_id", "event_id", "us")
    a = ranges.islands(_spans(s, d, "purchase", DAY), "user_id", "start", "end", 0).select("user_id", F.col("start").alias("bs"), F.col("end").alias("be"))
    b = ranges.islands(_spans(s, d, "signup", DAY), "user_id", "start", "end", 0).select("user_id", F.col("start").alias("bs"), F.col("end").alias("be"))
    tag = lambda blocks, name: ranges.range_join(e, blocks, "user_id", "us", "bs", "be", DAY).select("event_id").distinct().withColumn(name, F.lit(True))
    j = e.join(tag(a, "in_a"), "event_id", "left").join(tag(b, "in_b"), "event_id", "left")
    return j.select("event_id", F.when(F.col("in_a"), "purchase").when(F.col("in_b"), "signup").otherwise("rest").alias("label"))


def blocks_to_mask(s, d):
    """Events inside any purchase span, as a semi-join."""
    e = events(s, d).select("user_id", "event_id", "us")
    b = ranges.islands(_spans(s, d, "purchase"), "user_id", "start", "end", 0).select("user_id", F.col("start").alias("bs"), F.col("end").alias("be"))
    return ranges.range_join(e, b, "user_id", "us", "bs", "be", 2 * HOUR).select("event_id").distinct()


def block_intersection(s, d):
    a = ranges.islands(_spans(s, d, "purchase", DAY), "user_id", "start", "end", 0)
    b = ranges.islands(_spans(s, d, "signup", DAY), "user_id", "start", "end", 0)
    i = ranges.intersections(a, b, "user_id", DAY)
    return i.select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


def range_join_windows(s, d):
    """Events per overlapping window: windows of two days that start every day."""
    e = events(s, d).select("user_id", "event_id", "us", "value")
    day = F.floor(F.col("us") / DAY).cast("long")
    w = e.select("user_id", F.explode(F.array(day - 1, day)).alias("win"), "value")
    return w.groupBy("user_id", "win").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


def asof_join(s, d):
    """Every other event with the value of the user's last purchase at or before it."""
    e = events(s, d)
    left = e.filter("event_type != 'purchase'").select("user_id", "event_id", "us")
    right = e.filter("event_type = 'purchase'").select("user_id", "event_id", "us", "value")
    return ranges.asof_last(left, right, "user_id", "us", "event_id", F.col("value"), "purchase").select("event_id", r6("purchase").alias("purchase"))


def nearest_bin(s, d):
    """For each user and noon the event nearest in time (the earlier of ties, then the smaller id)."""
    e = events(s, d).withColumn("noon", F.floor(F.col("us") / DAY) * DAY + DAY // 2)
    best = F.min(F.struct(F.abs(F.col("us") - F.col("noon")).alias("dist"), "us", "event_id"))
    return e.groupBy("user_id", F.col("noon").cast("long").alias("noon")).agg(best.alias("b")).select("user_id", "noon", F.col("b.event_id").alias("event_id"), F.col("b.dist").alias("dist_us"))


def _peri(s, d):
    """Views around purchases of the same user within a day, by 4-hour offset bin."""
    p = events(s, d).filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("pid"), (F.col("us") - DAY).alias("ws"), (F.col("us") + DAY).alias("we"), F.col("us").alias("pus"))
    v = events(s, d).filter("event_type = 'view'").select("user_id", "event_id", "us", "value")
    j = ranges.range_join(v, p, "user_id", "us", "ws", "we", 2 * DAY)
    return j.select("user_id", "pid", "event_id", "value", F.floor((F.col("us") - F.col("pus")) / (4 * HOUR)).cast("long").alias("off"))


def peri_event_average(s, d):
    return _peri(s, d).groupBy("off").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("sd"))


def pre_post_delta(s, d):
    """Mean before, after, and their difference around each purchase."""
    g = _peri(s, d).groupBy("pid").agg(F.avg(F.when(F.col("off") < 0, F.col("value"))).alias("pre"), F.avg(F.when(F.col("off") >= 0, F.col("value"))).alias("post"))
    return g.select("pid", r6("pre").alias("pre"), r6("post").alias("post"), r6(F.col("post") - F.col("pre")).alias("delta"))


def baseline_corrected_trace(s, d):
    """Peri-event means by offset after each purchase's baseline (its first third) is subtracted."""
    p = _peri(s, d)
    b = F.avg(F.when(F.col("off") <= -3, F.col("value"))).over(Window.partitionBy("pid"))
    return p.withColumn("b", b).filter("b is not null").groupBy("off").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("value") - F.col("b"))).alias("mean"))


def master_table_outer(s, d):
    """All customers with their orders' summary; those without keep a row of nulls."""
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), r6(F.avg("o_totalprice")).alias("mean_price"))
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "c_mktsegment", "n_orders", "mean_price")


def star_join_summary(s, d):
    """Lines joined with order, customer, nation and region; revenue per region and segment."""
    l = table(s, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    c = table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(s, d, "nation").select("n_nationkey", "n_regionkey")
    r = table(s, d, "region").select("r_regionkey", "r_name")
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"]).join(r, F.col("n_regionkey") == r["r_regionkey"])
    return j.groupBy("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("rev"), 2).alias("revenue"))


def leave_one_out_groups(s, d):
    """Customers grouped by all but one of segment, nation and region."""
    c = table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    n = table(s, d, "nation").select("n_nationkey", "n_regionkey")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", "c_mktsegment", "n_regionkey", (F.col("c_custkey") % 3).alias("grp"), "c_acctbal")
    g = j.groupingSets([["c_mktsegment", "n_regionkey"], ["c_mktsegment", "grp"], ["n_regionkey", "grp"]], "c_mktsegment", "n_regionkey", "grp")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


def prevalence_pivot(s, d):
    """Share of each brand within a size class, brands as rows."""
    p = table(s, d, "part").select("p_brand", F.when(F.col("p_size") <= 15, "small").when(F.col("p_size") <= 35, "middle").otherwise("large").alias("cls"))
    g = p.groupBy("p_brand").pivot("cls", ["small", "middle", "large"]).agg(F.count(F.lit(1))).na.fill(0)
    tot = {c: F.sum(c).over(Window.partitionBy()) for c in ("small", "middle", "large")}
    return g.select("p_brand", *[r6(100.0 * F.col(c) / t).alias(c) for c, t in tot.items()])


def wide_pivot_join(s, d):
    """One row per user with the counts of two event types and the last value."""
    e = events(s, d)
    wide = e.groupBy("user_id").pivot("event_type", ["purchase", "view"]).agg(F.count(F.lit(1))).na.fill(0)
    last = e.groupBy("user_id").agg(F.max(F.struct("us", "event_id", "value")).alias("l"))
    return wide.join(last, "user_id").select("user_id", F.col("purchase").alias("n_purchase"), F.col("view").alias("n_view"), r6("l.value").alias("last_value"))


def first_transition_delta(s, d):
    """First change of event type per user: value step, signed by the labels' order, over the user's spread."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(s, d).select("user_id", "us", "event_id", "value", "event_type", F.lag("event_type").over(w).alias("pt"), F.lag("value").over(w).alias("pv"), F.stddev_pop("value").over(Window.partitionBy("user_id")).alias("sd"))
    t = e.filter("pt is not null and pt != event_type").withColumn("r", F.row_number().over(w)).filter("r = 1")
    sign = F.when(F.col("event_type") >= F.col("pt"), 1.0).otherwise(-1.0)
    return t.select("user_id", "event_id", r6(sign * (F.col("value") - F.col("pv")) / (F.col("sd") + 1e-12)).alias("delta"))


def coalesce_versions(s, d):
    """Two versions of a measure joined on their key; the newer value where there is one."""
    o = table(s, d, "orders")
    a = o.select("o_orderkey", F.col("o_totalprice").alias("raw"))
    b = o.filter("o_orderstatus != 'O'").select("o_orderkey", F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice") * 0.9).alias("hpf"))
    return a.join(b, "o_orderkey").select("o_orderkey", F.round(F.coalesce("hpf", "raw"), 4).alias("price"))


def yield_prevalence(s, d):
    """Customers with an order of a priority, and their share of all customers that ordered."""
    o = table(s, d, "orders")
    total = o.agg(F.countDistinct("o_custkey").alias("total"))
    g = o.groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("k"), r6(F.avg("o_totalprice")).alias("mean_price"))
    return g.join(F.broadcast(total)).select("o_orderpriority", "k", "mean_price", r6(100.0 * F.col("k") / F.col("total")).alias("pct"))


def jaccard_sets(s, d):
    """Jaccard similarity of the user sets of all pairs of event types, from counts of pairs."""
    u = table(s, d, "events").select("user_id", "event_type").distinct()
    per = u.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("ts"))
    a = per.select(F.explode("ts").alias("a"), "ts").select("a", F.explode("ts").alias("b")).filter("a < b")
    both = a.groupBy("a", "b").agg(F.count(F.lit(1)).alias("inter"))
    n = u.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    na, nb = n.select(F.col("event_type").alias("a"), F.col("n").alias("na")), n.select(F.col("event_type").alias("b"), F.col("n").alias("nb"))
    return both.join(na, "a").join(nb, "b").select("a", "b", "inter", r6(F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("jaccard"))


def minority_fraction(s, d):
    """Share of the rarer value half per user."""
    g = table(s, d, "events").groupBy("user_id", (F.col("value") > 50).alias("up")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("k"), r6(F.min("n") / F.sum("n")).alias("minority")).filter("k = 2").select("user_id", "minority")


def top_k_entities(s, d):
    """The ten customers with the highest mean order price that have a large order."""
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"), F.bool_or(F.col("o_totalprice") > 300000).alias("big"))
    return o.filter("big and n >= 3").orderBy(F.desc("m"), "o_custkey").limit(10).select("o_custkey", "n", F.round("m", 4).alias("mean_price"))


def topn_intersection(s, d):
    """Parts among the 200 dearest and the 200 largest (ties by key)."""
    p = table(s, d, "part")
    a = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(200).select("p_partkey")
    b = p.orderBy(F.desc("p_size"), "p_partkey").limit(200).select("p_partkey")
    return a.intersect(b)


def top_n_per_group(s, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    c = table(s, d, "customer").withColumn("rk", F.row_number().over(w)).filter("rk <= 3")
    return c.select("c_nationkey", "c_custkey", F.col("rk").cast("long").alias("rk"), F.round("c_acctbal", 4).alias("acctbal"))


def cell_subsets(s, d):
    """Customers by set algebra: with orders of one priority but none of another."""
    o = table(s, d, "orders")
    a = o.filter("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    b = o.filter("o_orderpriority = '5-LOW'").select("o_custkey").distinct()
    return a.exceptAll(b)


def orders_anti_semi(s, d):
    """Customers without orders (anti) in segments that have some (semi)."""
    c, o = table(s, d, "customer"), table(s, d, "orders").select("o_custkey")
    some = c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_mktsegment").distinct()
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").join(some, "c_mktsegment", "left_semi").select("c_custkey", "c_mktsegment")


def lfp_feature_means(s, d):
    """Per user and day the mean of the day's values and of the day before, null-safe; users' first day has none."""
    m = events(s, d).groupBy("user_id", F.floor(F.col("us") / DAY).cast("long").alias("day")).agg(F.collect_list("value").alias("vs"))
    w = Window.partitionBy("user_id").orderBy("day")
    mean = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c))
    x = m.withColumn("pv", F.lag("vs").over(w))
    return x.select("user_id", "day", r6(mean(F.col("vs"))).alias("cur"), r6(mean(F.col("pv"))).alias("prev"))


def config_grid(s, d):
    """Cartesian grid of parameters with a stable id per configuration."""
    a = s.createDataFrame([(0.5,), (1.0,)], "win double")
    b = s.createDataFrame([("fixed",), ("knee",)], "mode string")
    g = a.join(b, how="cross")
    return g.select("win", "mode", F.substring(F.md5(F.concat_ws("|", F.col("mode"), F.col("win").cast("string"))), 1, 8).alias("config_id"))


def wide_to_long(s, d):
    """Columns of a table as (key, measure, value) rows."""
    p = table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "measure", "v").groupBy("measure").agg(F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"))


NAMES = "gap_merge_blocks burst_runs classify_windows block_label_join blocks_to_mask block_intersection range_join_windows asof_join nearest_bin peri_event_average pre_post_delta baseline_corrected_trace master_table_outer star_join_summary leave_one_out_groups prevalence_pivot wide_pivot_join first_transition_delta coalesce_versions yield_prevalence jaccard_sets minority_fraction top_k_entities topn_intersection top_n_per_group cell_subsets orders_anti_semi lfp_feature_means config_grid wide_to_long"


def queries():
    return {n: globals()[n] for n in NAMES.split()}


def _islands_sql(name, kind, length):
    return (
        f", {name}0 as (select user_id, us s, us + {length} e from e where event_type = '{kind}'), {name}1 as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) r from (select distinct * from {name}0)),"
        f" {name}2 as (select *, sum(case when r is null or s > r then 1 else 0 end) over (partition by user_id order by s, e rows unbounded preceding) k from {name}1), {name} as (select user_id, k, min(s) s, max(e) e from {name}2 group by all)"
    )


def oracle_sql():
    peri = E + f", p as (select v.user_id, p.event_id pid, v.event_id, v.value, cast(floor((v.us - p.us) / {4 * HOUR}.0) as bigint) off from e v join e p on v.user_id = p.user_id and v.event_type = 'view' and p.event_type = 'purchase' and v.us >= p.us - {DAY} and v.us < p.us + {DAY}) "
    a, b = _islands_sql("a", "purchase", DAY), _islands_sql("b", "signup", DAY)
    return {
        "gap_merge_blocks": E + f", x as (select user_id, us, case when us - lag(us) over w > {6 * HOUR} or lag(us) over w is null then 1 else 0 end f from e window w as (partition by user_id order by us, event_id)), y as (select *, sum(f) over (partition by user_id order by us, f desc rows unbounded preceding) k from x) select user_id, min(us) start_us, max(us) end_us, count(*) n from y group by user_id, k having max(us) - min(us) >= {HOUR}",
        "burst_runs": E + ", q as (select user_id, quantile_cont(value, 0.8) p from e group by 1), m as (select e.*, value >= p m from e join q using (user_id)), r as (select *, row_number() over (partition by user_id order by us, event_id) - row_number() over (partition by user_id, m order by us, event_id) g from m) select user_id, min(us) start_us, max(us) end_us, count(*) n from r where m group by user_id, g having count(*) >= 2",
        "classify_windows": E + f", m as (select user_id, us // {DAY} as day, avg(value) m from e group by 1, 2), q as (select user_id, quantile_cont(m, 0.8) hi, quantile_cont(m, 0.25) lo from m group by 1) select user_id, day, case when m >= hi then 'high' when m <= lo then 'low' else 'rest' end kind from m join q using (user_id)",
        "block_label_join": E + a + b + " select event_id, case when exists (select 1 from a where a.user_id = e.user_id and us >= s and us < a.e) then 'purchase' when exists (select 1 from b where b.user_id = e.user_id and us >= s and us < b.e) then 'signup' else 'rest' end as label from e",
        "blocks_to_mask": E + f" select event_id from e where exists (select 1 from e p where p.event_type = 'purchase' and p.user_id = e.user_id and e.us >= p.us and e.us < p.us + {2 * HOUR})",
        "block_intersection": E + a + b + " select user_id, greatest(a.s, b.s) start_us, least(a.e, b.e) end_us from a join b using (user_id) where greatest(a.s, b.s) < least(a.e, b.e)",
        "range_join_windows": E + f", w as (select user_id, unnest([us // {DAY} - 1, us // {DAY}]) win, value from e) select user_id, win, count(*) n, round(avg(value), 6) mean from w group by 1, 2",
        "asof_join": E + ", r as (select user_id, us, arg_max(value, event_id) as v from e where event_type = 'purchase' group by 1, 2) select l.event_id, round(r.v, 6) purchase from e l asof left join r on l.user_id = r.user_id and l.us >= r.us where l.event_type != 'purchase'",
        "nearest_bin": E + f", x as (select *, us // {DAY} * {DAY} + {DAY // 2} noon from e), r as (select *, abs(us - noon) dist, row_number() over (partition by user_id, noon order by abs(us - noon), us, event_id) k from x) select user_id, noon, event_id, dist dist_us from r where k = 1",
        "peri_event_average": peri + "select off, count(*) n, round(avg(value), 6) mean, round(stddev_pop(value), 6) sd from p group by 1",
        "pre_post_delta": peri + ", g as (select pid, avg(value) filter (where off < 0) pre, avg(value) filter (where off >= 0) post from p group by 1) select pid, round(pre, 6) pre, round(post, 6) post, round(post - pre, 6) delta from g",
        "baseline_corrected_trace": peri + ", b as (select *, avg(case when off <= -3 then value end) over (partition by pid) b from p) select off, count(*) n, round(avg(value - b), 6) mean from b where b is not null group by 1",
        "master_table_outer": "select c_custkey, c_mktsegment, n_orders, mean_price from customer left join (select o_custkey, count(*) n_orders, round(avg(o_totalprice), 6) mean_price from orders group by 1) on c_custkey = o_custkey",
        "star_join_summary": "select r_name, c_mktsegment, count(*) n, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2",
        "leave_one_out_groups": "select c_mktsegment, n_regionkey, grp, count(*) n, round(avg(c_acctbal), 4) mean from (select *, c_custkey % 3 grp from customer join nation on c_nationkey = n_nationkey) group by grouping sets ((c_mktsegment, n_regionkey), (c_mktsegment, grp), (n_regionkey, grp))",
        "prevalence_pivot": "with g as (select p_brand, count(*) filter (where p_size <= 15) s, count(*) filter (where p_size > 15 and p_size <= 35) m, count(*) filter (where p_size > 35) l from part group by 1) select p_brand, round(100.0::double * s / sum(s) over (), 6) small, round(100.0::double * m / sum(m) over (), 6) middle, round(100.0::double * l / sum(l) over (), 6) as large from g",
        "wide_pivot_join": E + " select user_id, count(*) filter (where event_type = 'purchase') n_purchase, count(*) filter (where event_type = 'view') n_view, round(arg_max(value, (us, event_id)), 6) last_value from e group by 1",
        "first_transition_delta": E + ", x as (select *, lag(event_type) over w pt, lag(value) over w pv, stddev_pop(value) over (partition by user_id) sd from e window w as (partition by user_id order by us, event_id)), r as (select *, row_number() over (partition by user_id order by us, event_id) k from x where pt is not null and pt != event_type) select user_id, event_id, round(case when event_type >= pt then 1.0 else -1.0 end * (value - pv) / (sd + 1e-12), 6) delta from r where k = 1",
        "coalesce_versions": "select o_orderkey, round(case when o_totalprice > 1000 then o_totalprice * 0.9::double else o_totalprice end, 4) price from orders where o_orderstatus != 'O'",
        "yield_prevalence": "select o_orderpriority, count(distinct o_custkey) k, round(avg(o_totalprice), 6) mean_price, round(100.0::double * count(distinct o_custkey) / (select count(distinct o_custkey) from orders), 6) pct from orders group by 1",
        "jaccard_sets": "with u as (select distinct user_id, event_type t from events), n as (select t, count(*) n from u group by 1), b as (select x.t a, y.t b, count(*) inter from u x join u y using (user_id) where x.t < y.t group by 1, 2) select a, b, inter, round(inter / (p.n + q.n - inter), 6) jaccard from b join n p on p.t = a join n q on q.t = b",
        "minority_fraction": "with g as (select user_id, value > 50 up, count(*) n from events group by 1, 2) select user_id, round(min(n) / sum(n), 6) minority from g group by 1 having count(*) = 2",
        "top_k_entities": "select o_custkey, count(*) n, round(avg(o_totalprice), 4) mean_price from orders group by 1 having bool_or(o_totalprice > 300000) and count(*) >= 3 order by avg(o_totalprice) desc, o_custkey limit 10",
        "topn_intersection": "select p_partkey from (select p_partkey from part order by p_retailprice desc, p_partkey limit 200) intersect select p_partkey from (select p_partkey from part order by p_size desc, p_partkey limit 200)",
        "top_n_per_group": "select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) rk, round(c_acctbal, 4) acctbal from customer qualify rk <= 3",
        "cell_subsets": "select distinct o_custkey from orders where o_orderpriority = '1-URGENT' and o_custkey not in (select o_custkey from orders where o_orderpriority = '5-LOW')",
        "orders_anti_semi": "select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders) and c_mktsegment in (select c_mktsegment from customer where c_custkey in (select o_custkey from orders))",
        "lfp_feature_means": E + f", m as (select user_id, us // {DAY} as day, avg(value) m from e group by 1, 2) select user_id, day, round(m, 6) cur, round(lag(m) over (partition by user_id order by day), 6) prev from m",
        "config_grid": "select win, mode, substr(md5(mode || '|' || cast(win as varchar)), 1, 8) config_id from (values (0.5::double), (1.0::double)) a(win), (values ('fixed'), ('knee')) b(mode)",
        "wide_to_long": "select 'size' measure, count(p_size) n, round(avg(p_size), 4) mean from part union all select 'price', count(p_retailprice), round(avg(p_retailprice), 4) from part",
    }
