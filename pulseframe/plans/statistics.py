"""Queries of statistics over groups: tests, effect sizes, correlations, regressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranks
from .base import E, events, table

HOUR, DAY = 3_600_000_000, 86_400_000_000


def r6(c):
    return F.round(c, 6)


def cohens_d_pairs(s, d):
    """Signed and unsigned effect sizes of the order price between all pairs of priorities."""
    g = ranks.moments(table(s, d, "orders"), "o_totalprice", "o_orderpriority")
    a = g.select(F.col("o_orderpriority").alias("a"), F.col("n").alias("n1"), F.col("m").alias("m1"), F.col("v").alias("v1"))
    b = g.select(F.col("o_orderpriority").alias("b"), F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("v").alias("v2"))
    j = a.join(b, F.col("a") < F.col("b"))
    df = F.col("n1") + F.col("n2") - 2
    sp = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / df)
    dd = (F.col("m1") - F.col("m2")) / (sp + 1e-10)
    return j.select("a", "b", r6(dd).alias("d"), r6(F.abs(F.col("m1") - F.col("m2")) / (sp + 1e-8)).alias("d_abs"), r6(dd * (1 - 3 / (4.0 * df - 1))).alias("g"))


def mann_whitney_u(s, d):
    return ranks.mann_whitney(table(s, d, "customer"), "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY").select("n1", "n2", F.round("u", 2).alias("u"), r6("z").alias("z"))


def rank_biserial(s, d):
    return ranks.mann_whitney(table(s, d, "orders"), "o_totalprice", "o_orderstatus", "F", "O").select("n1", "n2", r6("r").alias("r"))


def kruskal_wallis_eta2(s, d):
    k = ranks.kruskal(table(s, d, "customer"), "c_acctbal", "c_mktsegment")
    return k.select("k", "n", r6("h").alias("h"), r6("eta2_h").alias("eta2_h"), r6("eta2_adj").alias("eta2_adj"))


def spearman(s, d):
    l = table(s, d, "lineitem").select("l_returnflag", "l_quantity", F.round("l_extendedprice", 0).alias("price"))
    return ranks.spearman(l, "l_quantity", "price", ["l_returnflag"]).select("l_returnflag", "n", r6("rho").alias("rho"))


def pearson_matrix(s, d):
    """Correlations of all pairs of four numeric columns in one pass."""
    l = table(s, d, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = l.agg(*[ranks.corr(a, b).alias(f"{a}|{b}") for a, b in pairs], F.count(F.lit(1)).alias("n"))
    return one.select("n", F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]))).select("a", "b", "n", r6("r").alias("r"))


def wilcoxon_signed(s, d):
    """Signed-rank sums of users' mean value change from the first to the second half of the month."""
    m = events(s, d).withColumn("half", F.floor(F.col("us") / (15 * DAY)) % 2).groupBy("user_id").agg(r6(F.avg(F.when(F.col("half") == 0, F.col("value")))).alias("a"), r6(F.avg(F.when(F.col("half") == 1, F.col("value")))).alias("b"))
    x = m.select(F.round(F.col("b") - F.col("a"), 5).alias("dv")).filter("dv is not null and dv != 0").withColumn("ad", F.abs("dv"))
    r = x.join(ranks.average_ranks(x, "ad").select("ad", "rank"), "ad")
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(F.col("dv") > 0, F.col("rank")).otherwise(0.0)), 2).alias("w_plus"), F.round(F.sum(F.when(F.col("dv") < 0, F.col("rank")).otherwise(0.0)), 2).alias("w_minus"))


def anova_oneway(s, d):
    return ranks.anova(table(s, d, "orders"), "o_totalprice", "o_orderpriority").select("df1", "df2", r6("f").alias("f"), F.round("eta2", 8).alias("eta2"))


def chi2_cramers_v(s, d):
    c = table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("o"))
    rows, cols = c.groupBy("l_returnflag").agg(F.sum("o").alias("r")), c.groupBy("l_linestatus").agg(F.sum("o").alias("k"))
    n = c.agg(F.sum("o").alias("n"))
    # a cell per pair of categories, those without rows included
    g = rows.join(cols, how="cross").join(F.broadcast(n)).join(c, ["l_returnflag", "l_linestatus"], "left")
    e = F.col("r") * F.col("k") / F.col("n")
    x = g.agg(F.sum((F.coalesce("o", F.lit(0)) - e) * (F.coalesce("o", F.lit(0)) - e) / e).alias("chi2"), F.first("n").alias("n"), F.least(F.countDistinct("l_returnflag"), F.countDistinct("l_linestatus")).alias("k"))
    return x.select(F.round("chi2", 4).alias("chi2"), "n", r6(F.sqrt(F.col("chi2") / (F.col("n") * (F.col("k") - 1)))).alias("v"))


def bh_fdr(s, d):
    """Adjusted values for a pseudo p per part brand, within a manufacturer digit."""
    p = table(s, d, "part").groupBy("p_brand").agg((F.sum("p_size") % 1000 / 1000.0).alias("p")).withColumn("fam", F.substring("p_brand", 7, 1))
    q = ranks.benjamini_hochberg(p, "p", "fam")
    return q.select("p_brand", r6("p").alias("p"), r6("q").alias("q"), ranks.stars(F.col("q")).alias("stars"))


def binomial_yield(s, d):
    """Customers with an urgent order of those with any: count, total, percentage."""
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    return o.agg(F.sum(F.col("u").cast("long")).alias("k"), F.count(F.lit(1)).alias("n")).select("k", "n", r6(100.0 * F.col("k") / F.col("n")).alias("pct"))


def sliding_welch(s, d):
    """Welch t of the value between two event types in each day-wide bin of the month."""
    m = ranks.moments(events(s, d).withColumn("t", F.floor(F.col("us") / DAY).cast("long")), "value", "t", "event_type")
    w = lambda k: m.filter(F.col("event_type") == k)
    a, b = w("purchase").select("t", F.col("n").alias("n1"), F.col("m").alias("m1"), F.col("v").alias("v1")), w("view").select("t", F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("v").alias("v2"))
    t, df = ranks.welch(*[F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")])
    return a.join(b, "t").filter("n1 > 1 and n2 > 1").select("t", r6(t).alias("stat"), r6(df).alias("df"))


def sliding_anova(s, d):
    """One-way F over all event types per day."""
    g = events(s, d).groupBy(F.floor(F.col("us") / DAY).cast("long").alias("t"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    w = Window.partitionBy("t")
    x = g.withColumn("mm", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    y = x.groupBy("t").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("m") - F.col("mm")) * (F.col("m") - F.col("mm"))).alias("b"), F.sum(F.col("n") * F.col("v")).alias("wi"))
    return y.filter("k > 1 and n > k and wi > 0").select("t", r6((F.col("b") / (F.col("k") - 1)) / (F.col("wi") / (F.col("n") - F.col("k")))).alias("f"))


def merge_significant_windows(s, d):
    """Successive days whose |t| is at least 1 merged, with the strongest t."""
    t = sliding_welch(s, d).filter("abs(stat) >= 1")
    w = Window.orderBy("t")  # one row per day
    x = t.withColumn("new", F.when(F.col("t") - F.lag("t").over(w) <= 1, 0).otherwise(1)).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("g").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max(F.abs("stat")).alias("strongest")).drop("g")


def ols_multi(s, d):
    """Price on quantity and discount with intercept, by the normal equations of one aggregate."""
    l = table(s, d, "lineitem")
    x1, x2, y = F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice")
    m = l.agg(F.covar_pop(x1, x1).alias("a"), F.covar_pop(x1, x2).alias("b"), F.covar_pop(x2, x2).alias("c"), F.covar_pop(x1, y).alias("p"), F.covar_pop(x2, y).alias("q"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"))
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    b1, b2 = (F.col("p") * F.col("c") - F.col("q") * F.col("b")) / det, (F.col("q") * F.col("a") - F.col("p") * F.col("b")) / det
    return m.select(F.round(b1, 4).alias("b1"), F.round(b2, 3).alias("b2"), F.round(F.col("my") - b1 * F.col("m1") - b2 * F.col("m2"), 3).alias("b0"))


def ramp_linear_fit(s, d):
    """Line through the first ten values of each user: slope, intercept, fit."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(s, d).withColumn("i", F.row_number().over(w).cast("double")).filter("i <= 10")
    return e.groupBy("user_id").agg(r6(F.regr_slope("value", "i")).alias("slope"), r6(F.regr_intercept("value", "i")).alias("intercept"), r6(F.regr_r2("value", "i")).alias("r2"))


def poly2_fit(s, d):
    """Quadratic through each user's first thirty values, by centred moments."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(s, d).withColumn("x", F.row_number().over(w) / 10.0).filter("x <= 3").withColumn("z", F.col("x") * F.col("x"))
    cov = lambda a, b: F.covar_pop(a, b)
    m = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), cov("x", "x").alias("a"), cov("x", "z").alias("b"), cov("z", "z").alias("c"), cov("x", "value").alias("p"), cov("z", "value").alias("q"))
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    return m.filter("n >= 5").select("user_id", F.round((F.col("p") * F.col("c") - F.col("q") * F.col("b")) / det, 4).alias("c1"), F.round((F.col("q") * F.col("a") - F.col("p") * F.col("b")) / det, 4).alias("c2"))


def exp_decay_loglinear(s, d):
    """Decay rate of the gaps between a user's events: log count over 12-hour bins."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    g = events(s, d).select(F.floor((F.lead("us").over(w) - F.col("us")) / (12 * HOUR)).cast("long").alias("bin")).filter("bin is not null")
    h = g.groupBy("bin").agg(F.count(F.lit(1)).alias("c")).filter("c >= 5")
    return h.agg(F.count(F.lit(1)).alias("bins"), r6(F.regr_slope(F.log("c"), F.col("bin"))).alias("slope"), r6(F.regr_intercept(F.log("c"), F.col("bin"))).alias("intercept"))


def entity_correlations(s, d):
    """Pearson r of quantity and price per supplier with at least five rows."""
    l = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), ranks.corr("l_quantity", "l_extendedprice").alias("r"))
    return l.filter("n >= 5").select("l_suppkey", "n", r6("r").alias("r"))


def population_mean_sem(s, d):
    """Mean and standard error over customers of their mean order price, with a one-sample t against 150000."""
    c = table(s, d, "orders").join(table(s, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_custkey").agg(F.avg("o_totalprice").alias("m"))
    g = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))).alias("sem"))
    return g.select("c_mktsegment", "n", F.round("mean", 4).alias("mean"), F.round("sem", 4).alias("sem"), r6((F.col("mean") - 150000) / F.col("sem")).alias("t"))


def version_ratio(s, d):
    """Ratio of the medians of two versions of a measure per group."""
    l = table(s, d, "lineitem")
    g = l.groupBy("l_returnflag").agg(F.percentile("l_extendedprice", 0.5).alias("a"), F.percentile(F.col("l_extendedprice") * (1 - F.col("l_discount")), 0.5).alias("b"))
    return g.select("l_returnflag", r6(F.col("b") / F.col("a")).alias("ratio"))


NAMES = "cohens_d_pairs mann_whitney_u rank_biserial kruskal_wallis_eta2 spearman pearson_matrix wilcoxon_signed anova_oneway chi2_cramers_v bh_fdr binomial_yield sliding_welch sliding_anova merge_significant_windows ols_multi ramp_linear_fit poly2_fit exp_decay_loglinear entity_correlations population_mean_sem version_ratio"


def queries():
    return {n: globals()[n] for n in NAMES.split()}


def oracle_sql():
    def ranked(src, value, label):
        return f"with x as (select {label} g, {value} v from {src}), r as (select g, v, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0::double rk from x), s as (select g, count(*) n, sum(rk) rs from r group by 1), t as (select sum(n) total, sum(n::double * n * n - n) ties from (select v, count(*) n from x group by 1)) "

    mw = lambda src, v, l, a, b: (
        ranked(f"(select * from {src} where {l} in ('{a}', '{b}'))", v, l)
        + f", y as (select p.n n1, q.n n2, p.rs - p.n * (p.n + 1) / 2.0::double u, total, ties from s p, s q, t where p.g = '{a}' and q.g = '{b}'), z as (select *, sqrt(n1 * n2 / 12.0::double * ((total + 1) - ties / (total::double * (total - 1)))) sd, u - n1 * n2 / 2.0::double dd from y) "
    )
    welch = E + f", m as (select us // {DAY} t, event_type k, count(value) n, avg(value) m, var_samp(value) v from e group by 1, 2), j as (select a.t, a.n n1, a.m m1, a.v / a.n a, b.n n2, b.m m2, b.v / b.n b from m a join m b using (t) where a.k = 'purchase' and b.k = 'view' and a.n > 1 and b.n > 1), w as (select t, round((m1 - m2) / sqrt(a + b), 6) stat, round((a + b) ^ 2 / (a ^ 2 / (n1 - 1) + b ^ 2 / (n2 - 1)), 6) df from j) "
    return {
        "cohens_d_pairs": "with g as (select o_orderpriority k, count(*) n, avg(o_totalprice) m, var_samp(o_totalprice) v from orders group by 1), j as (select a.k a, b.k b, a.m - b.m dm, a.n + b.n - 2 df, sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) sp from g a join g b on a.k < b.k) select a, b, round(dm / (sp + 1e-10), 6) d, round(abs(dm) / (sp + 1e-8), 6) d_abs, round(dm / (sp + 1e-10) * (1 - 3 / (4.0 * df - 1)), 6) g from j",
        "mann_whitney_u": mw("customer", "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY") + "select n1, n2, round(u, 2) u, round(sign(dd) * greatest(abs(dd) - 0.5, 0) / sd, 6) z from z",
        "rank_biserial": mw("orders", "o_totalprice", "o_orderstatus", "F", "O") + "select n1, n2, round(1 - 2 * u / (n1 * n2), 6) r from z",
        "kruskal_wallis_eta2": ranked("customer", "c_acctbal", "c_mktsegment") + ", h as (select count(*) k, any_value(total) n, (12.0::double / (any_value(total) * (any_value(total) + 1)) * sum(rs * rs / n) - 3 * (any_value(total) + 1)) / (1 - any_value(ties) / (any_value(total)::double ^ 3 - any_value(total))) h from s, t) select k, n, round(h, 6) h, round(h / (n - 1), 6) eta2_h, round((h - k + 1) / (n - k), 6) eta2_adj from h",
        "spearman": "with x as (select l_returnflag g, l_quantity a, round(l_extendedprice, 0) b from lineitem), r as (select g, rank() over (partition by g order by a) + (count(*) over (partition by g, a) - 1) / 2.0::double ra, rank() over (partition by g order by b) + (count(*) over (partition by g, b) - 1) / 2.0::double rb from x) select g l_returnflag, count(*) n, round(corr(ra, rb), 6) rho from r group by 1",
        "pearson_matrix": " union all ".join(f"select '{a}' a, '{b}' b, count(*) n, round(corr({a}, {b}), 6) r from lineitem" for a, b in [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]),
        "wilcoxon_signed": E + f", m as (select user_id, round(avg(case when us // {15 * DAY} % 2 = 0 then value end), 6) a, round(avg(case when us // {15 * DAY} % 2 = 1 then value end), 6) b from e group by 1), x as (select round(b - a, 5) dv from m), r as (select dv, rank() over (order by abs(dv)) + (count(*) over (partition by abs(dv)) - 1) / 2.0::double rk from x where dv is not null and dv != 0) select count(*) n, round(sum(case when dv > 0 then rk else 0 end), 2) w_plus, round(sum(case when dv < 0 then rk else 0 end), 2) w_minus from r",
        "anova_oneway": "with x as (select o_orderpriority g, o_totalprice v from orders), g as (select g, count(*) n, avg(v) m, var_pop(v) s from x group by 1), t as (select avg(v) mm, count(*) nn from x), a as (select count(*) k, any_value(nn) n, sum(n * (m - mm) ^ 2) b, sum(n * s) w from g, t) select k - 1 df1, n - k df2, round(b / (k - 1) / (w / (n - k)), 6) f, round(b / (b + w), 8) eta2 from a",
        "chi2_cramers_v": "with c as (select l_returnflag a, l_linestatus b, count(*) o from lineitem group by 1, 2), r as (select a, sum(o) r from c group by 1), k as (select b, sum(o) k from c group by 1), n as (select sum(o) n from c), x as (select r.a, k.b, coalesce(o, 0) o, r * k / n::double e, n from r cross join k cross join n left join c on c.a = r.a and c.b = k.b), s as (select sum((o - e) ^ 2 / e) chi2, any_value(n) n, least(count(distinct a), count(distinct b)) m from x) select round(chi2, 4) chi2, cast(n as bigint) n, round(sqrt(chi2 / (n * (m - 1))), 6) v from s",
        "bh_fdr": "with p as (select p_brand, sum(p_size) % 1000 / 1000.0::double p, substr(p_brand, 7, 1) fam from part group by 1), i as (select *, count(*) over (partition by fam) m, count(*) over (partition by fam order by p range unbounded preceding) i from p), q as (select *, least(1.0::double, min(p * m / i) over (partition by fam order by p desc range unbounded preceding)) q from i) select p_brand, round(p, 6) p, round(q, 6) q, case when q < 0.001 then '***' when q < 0.01 then '**' when q < 0.05 then '*' else 'n.s.' end stars from q",
        "binomial_yield": "with c as (select o_custkey, bool_or(o_orderpriority = '1-URGENT') u from orders group by 1) select count(*) filter (where u) k, count(*) n, round(100.0::double * count(*) filter (where u) / count(*), 6) pct from c",
        "sliding_welch": welch + "select * from w",
        "sliding_anova": E + f", x as (select us // {DAY} t, event_type k, value v from e), g as (select t, k, count(*) n, avg(v) m, var_pop(v) s from x group by 1, 2), y as (select *, sum(n * m) over (partition by t) / sum(n) over (partition by t) mm from g), a as (select t, count(*) k, sum(n) n, sum(n * (m - mm) ^ 2) b, sum(n * s) w from y group by 1) select t, round(b / (k - 1) / (w / (n - k)), 6) f from a where k > 1 and n > k and w > 0",
        "merge_significant_windows": welch + ", s as (select t, stat, case when t - lag(t) over (order by t) <= 1 then 0 else 1 end f from w where abs(stat) >= 1), g as (select *, sum(f) over (order by t rows unbounded preceding) g from s) select min(t) first_t, max(t) last_t, max(abs(stat)) strongest from g group by g",
        "ols_multi": "with m as (select covar_pop(l_quantity, l_quantity) a, covar_pop(l_quantity, l_discount) b, covar_pop(l_discount, l_discount) c, covar_pop(l_quantity, l_extendedprice) p, covar_pop(l_discount, l_extendedprice) q, avg(l_quantity) m1, avg(l_discount) m2, avg(l_extendedprice) my from lineitem), b as (select (p * c - q * b) / (a * c - b * b) b1, (q * a - p * b) / (a * c - b * b) b2, m1, m2, my from m) select round(b1, 4) b1, round(b2, 3) b2, round(my - b1 * m1 - b2 * m2, 3) b0 from b",
        "ramp_linear_fit": E + ", n as (select *, row_number() over (partition by user_id order by us, event_id)::double i from e) select user_id, round(regr_slope(value, i), 6) slope, round(regr_intercept(value, i), 6) intercept, round(regr_r2(value, i), 6) r2 from n where i <= 10 group by 1",
        "poly2_fit": E + ", n as (select *, row_number() over (partition by user_id order by us, event_id) / 10.0::double x from e), m as (select user_id, count(*) n, covar_pop(x, x) a, covar_pop(x, x * x) b, covar_pop(x * x, x * x) c, covar_pop(x, value) p, covar_pop(x * x, value) q from n where x <= 3 group by 1) select user_id, round((p * c - q * b) / (a * c - b * b), 4) c1, round((q * a - p * b) / (a * c - b * b), 4) c2 from m where n >= 5",
        "exp_decay_loglinear": E + f", g as (select (lead(us) over (partition by user_id order by us, event_id) - us) // {12 * HOUR} bin from e), h as (select bin, count(*) c from g where bin is not null group by 1 having count(*) >= 5) select count(*) bins, round(regr_slope(ln(c), bin), 6) slope, round(regr_intercept(ln(c), bin), 6) intercept from h",
        "entity_correlations": "select l_suppkey, count(*) n, round(corr(l_quantity, l_extendedprice), 6) r from lineitem group by 1 having count(*) >= 5",
        "population_mean_sem": "with c as (select c_mktsegment, o_custkey, avg(o_totalprice) m from orders join customer on o_custkey = c_custkey group by 1, 2), g as (select c_mktsegment, count(*) n, avg(m) mean, stddev_samp(m) / sqrt(count(*)) sem from c group by 1) select c_mktsegment, n, round(mean, 4) mean, round(sem, 4) sem, round((mean - 150000) / sem, 6) t from g",
        "version_ratio": "select l_returnflag, round(quantile_cont(l_extendedprice * (1 - l_discount), 0.5) / quantile_cont(l_extendedprice, 0.5), 6) ratio from lineitem group by 1",
    }
