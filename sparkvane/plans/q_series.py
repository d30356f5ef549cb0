"""Queries: series, metadata detectors, drift, heavy hitters, segments, graphs, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import compare as C
from ..operators import detect as D
from ..operators import series as S
from ..session import table as T
from ..sources import tables as R
from .q_basic import _EDGES, edges
from .registry import query


def months(spark, d):
    return T(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("o_totalprice"), 2).alias("lo"), F.round(F.max("o_totalprice"), 2).alias("hi"))


_M = "(select strftime(o_orderdate, '%Y-%m') as month, count(*) n, round(min(o_totalprice),2) lo, round(max(o_totalprice),2) hi from orders group by 1)"


def days(spark, d):
    return T(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


_D = "(select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) n from events group by 1, 2)"
_SPINE = f"(select s.day, k.event_type, coalesce(h.n, 0) n from (select distinct day from {_D}) s cross join (select distinct event_type from {_D}) k left join {_D} h on h.day = s.day and h.event_type = k.event_type)"
_TRAIL = f"(select day, event_type, n n1, coalesce(sum(n) over (partition by event_type order by day rows between 7 preceding and 1 preceding), 0) n0 from {_SPINE})"
_TOT = f"(select *, sum(n1) over (partition by day) t1, sum(n0) over (partition by day) t0, count(*) over (partition by day) b from {_TRAIL})"


@query(f"select month, n, round(ln(n / lag(n) over (order by month)), 6) as log_ratio from {_M}")
def log_ratio_deltas(spark, d):
    return S.log_ratio(months(spark, d), "n", "month").select("month", "n", F.round("log_ratio", 6).alias("log_ratio"))


_RZ = """with s as (select month, n::double n, row_number() over (order by month) i from {m}),
h as (select a.month, a.n, a.i, median(b.n) c, count(b.n) k from s a left join s b on b.i < a.i group by all),
v as (select h.month, h.n, h.k, h.c, median(abs(b.n - h.c)) mad, avg(abs(b.n - h.c)) mn from h left join s b on b.i < h.i group by all)
select month, n, round(case when k >= 3 and coalesce(nullif(mad,0), mn) > 0 then (n - c) / (1.4826 * coalesce(nullif(mad,0), mn)) end, 6) as z from v"""


@query(_RZ.format(m=_M))
def robust_z_rows(spark, d):
    return S.robust_z(months(spark, d), "n", "month").select("month", F.col("n").cast("double").alias("n"), F.round("z", 6).alias("z"))


@query(f"select month, n, (sum(n) over (order by month rows between 6 preceding and 1 preceding))::bigint as baseline from {_M}")
def trailing_baseline(spark, d):
    return S.trailing_baseline(months(spark, d).select("month", "n"), "n", "month", 6)


@query(f"select month, n, (select n from {_M} where month = '1996-01') as baseline from {_M}")
def fixed_baseline(spark, d):
    return S.fixed_baseline(months(spark, d).select("month", "n"), "n", "month", "1996-01")


@query(f"with s as (select month, n, row_number() over (order by month) i from {_M}) select a.month, a.n, round(avg(b.n), 6) as baseline, count(b.n) as cycles from s a left join s b on b.i in (a.i - 12, a.i - 24, a.i - 36) group by 1, 2")
def seasonal_baseline(spark, d):
    m = months(spark, d).withColumn("i", F.row_number().over(Window.orderBy("month")))
    return S.seasonal_baseline(m, "n", "i", 12, 3).select("month", "n", F.round("baseline", 6).alias("baseline"), "cycles")


@query(f"with h as (select strftime(ts,'%Y-%m-%d') as day, count(*) n from events where event_type = 'error' and value > 60 group by 1) select strftime(x, '%Y-%m-%d') as day, n from generate_series((select min(day)::date from h)::timestamp, (select max(day)::date from h)::timestamp, interval 1 day) g(x) left join h on h.day = strftime(x, '%Y-%m-%d')")
def gap_spine(spark, d):
    h = T(spark, d, "events").where("event_type = 'error' and value > 60").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return S.gap_spine(h, "day").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query(f"with c as (select month, sum(n) over (order by month) n from {_M}) select month, n::bigint as n, (n - lag(n) over (order by month))::bigint as increment, (lag(n,1) over (order by month) - lag(n,2) over (order by month))::bigint as previous_increment from c")
def increments(spark, d):
    c = months(spark, d).select("month", F.sum("n").over(Window.orderBy("month")).alias("n"))
    return S.increments(c, "n", "month")


@query("select x, n, round(-ln(sum(n) over (order by x) / sum(n) over ()), 6) + 0.0 as left_tail, round(-ln(sum(n) over (order by x desc) / sum(n) over ()), 6) + 0.0 as right_tail from (select l_quantity x, count(*) n from lineitem group by 1)")
def ecdf_tails(spark, d):
    e = S.ecdf_tails(T(spark, d, "lineitem").select(F.col("l_quantity").alias("x")), "x")
    return e.select("x", "n", F.round("left_tail", 6).alias("left_tail"), F.round("right_tail", 6).alias("right_tail"))


@query("select s_suppkey, rank() over (order by round(s_acctbal / 500)) + (count(*) over (partition by round(s_acctbal / 500)) - 1) / 2.0 as avg_rank from supplier")
def average_rank(spark, d):
    s = T(spark, d, "supplier").withColumn("b", F.round(F.col("s_acctbal") / 500))
    return S.average_rank(s, "b").select("s_suppkey", F.col("avg_rank").cast("double").alias("avg_rank"))


@query("select o_custkey, o_orderkey, lead(o_orderkey) over w as next_key, ntile(4) over w as quartile, round(percent_rank() over w, 6) as pr, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as second from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def analytic_functions(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return T(spark, d, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(w).alias("next_key"), F.ntile(4).over(w).alias("quartile"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.nth_value("o_orderkey", 2).over(full).alias("second"))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) r from orders) where r <= 2")
def latest_n_per_key(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return T(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 2").select("o_custkey", "o_orderkey")


@query("select o_orderkey, p from (select o_orderkey, nullif(o_orderpriority, '5-LOW') p from orders) order by p asc nulls last, o_orderkey limit 25")
def nulls_last_limit(spark, d):
    return T(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p")).orderBy(F.asc_nulls_last("p"), "o_orderkey").limit(25)


# -- metadata -----------------------------------------------------------------------------------------


@query("select strftime(ts,'%Y-%m-%d') as period, count(*) as rows, 'value' as column, (count(*) - count(value))::bigint as nulls, count(distinct value) as ndv, min(value) as lo, max(value) as hi from events group by 1 union all select strftime(ts,'%Y-%m-%d'), count(*), 'event_type', (count(*) - count(nullif(event_type,'error')))::bigint, count(distinct nullif(event_type,'error')), null, null from events group by 1")
def snapshot_profile(spark, d):
    e = T(spark, d, "events").withColumn("event_type", F.nullif("event_type", F.lit("error")))
    return R.profile_snapshots(e, F.date_format("ts", "yyyy-MM-dd"), ["value", "event_type"])


@query("select count(*) as rows from lineitem", "footer_row_count")
def footer_row_count(spark, d):
    p = R.footer_profile(spark, f"{d}/lineitem.parquet")
    return p.where(F.col("column") == "l_orderkey").select("rows")


@query(f"""with s as (select month, ln(n / lag(n) over (order by month)) x, row_number() over (order by month) i from {_M}),
t as (select * from s where x is not null), h as (select a.month, a.x, a.i, median(b.x) c, count(b.x) k, max(abs(b.x)) big from t a left join t b on b.i < a.i group by all),
v as (select h.month, h.x, h.k, h.c, h.big, median(abs(b.x - h.c)) mad, avg(abs(b.x - h.c)) mn from h left join t b on b.i < h.i group by all),
z as (select *, case when k >= 3 and coalesce(nullif(mad,0), mn) > 0 then (x - c) / (1.4826 * coalesce(nullif(mad,0), mn)) end z from v)
select month, round(x, 6) as log_ratio, round(z, 4) as z, case when k = 0 then false when z is not null then abs(z) >= 2.5758293035489004 else abs(x) >= 0.5 and abs(x) >= 2 * big end as fired from z""")
def row_volume_anomaly(spark, d):
    return D.row_volume(months(spark, d), "month").select("month", F.round("log_ratio", 6).alias("log_ratio"), F.round("z", 4).alias("z"), "fired")


@query(f"select month, round(ln((hi-lo)/l), 6) as delta from (select *, lag(hi-lo) over (order by month) l from {_M}) where hi > lo and l > 0")
def bounds_drift(spark, d):
    b = D.bounds_drift(months(spark, d), "month", "lo", "hi")
    return b.where("measure = 'range'").select("month", F.round("delta", 6).alias("delta"))


@query("""with c as (select strftime(ts,'%Y-%m-%d') as day, count(*) n, count(*) filter (event_type = 'error') k from events group by 1), l as (select *, lag(k) over (order by day) k0, lag(n) over (order by day) n0 from c)
select day, k, n, round((k/n - k0/n0) / sqrt(((k+k0)/(n+n0)) * (1-(k+k0)/(n+n0)) * (1/n + 1/n0)), 6) as z, round(2*asin(sqrt(k/n)) - 2*asin(sqrt(k0/n0)), 6) as h from l where n0 is not null""")
def null_rate_shift(spark, d):
    c = T(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("k"))
    return D.proportion_shift(c, "day", "k", "n").select("day", "k", "n", F.round("z", 6).alias("z"), F.round("h", 6).alias("h"))


@query("""with c as (select strftime(ts,'%Y-%m-%d') as day, count(*) n, count(distinct user_id) k from events group by 1), l as (select *, lag(k) over (order by day) k0, lag(n) over (order by day) n0 from c)
select day, round((k/n - k0/n0) / sqrt(((k+k0)/(n+n0)) * (1-(k+k0)/(n+n0)) * (1/n + 1/n0)), 6) as z from l where n0 is not null and k + k0 < n + n0""")
def ndv_ratio_shift(spark, d):
    c = T(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("k"))
    return D.proportion_shift(c, "day", "k", "n").where("z is not null").select("day", F.round("z", 6).alias("z"))


@query(f"select month, n, coalesce(abs(ln(n / lag(n) over (order by month))) > 0.5, false) as volume_flag from {_M}")
def naive_rule(spark, d):
    return D.naive_rule(months(spark, d), "month").select("month", "n", "volume_flag")


@query("select 1::bigint as files")
def file_layout(spark, d):
    return R.file_layout(T(spark, d, "events")).select("files")


# -- drift ------------------------------------------------------------------------------------------------

_TERMS = """sum(((n1+0.5)/(t1+0.5*b) - (n0+0.5)/(t0+0.5*b)) * ln(((n1+0.5)/(t1+0.5*b)) / ((n0+0.5)/(t0+0.5*b)))) as psi,
sum(case when n1 > 0 then n1/t1/2 * log2(n1/t1 / ((n1/t1 + n0/t0)/2)) else 0 end + case when n0 > 0 then n0/t0/2 * log2(n0/t0 / ((n1/t1 + n0/t0)/2)) else 0 end) as js,
2*sum(case when n1 > 0 then n1*ln(n1/t1 / ((n1+n0)/(t1+t0))) else 0 end + case when n0 > 0 then n0*ln(n0/t0 / ((n1+n0)/(t1+t0))) else 0 end) as g"""


@query(f"with c as (select day, max(t1) n1, max(t0) n0, max(b) b, {_TERMS} from {_TOT} where t0 > 0 group by 1) select day, n1::bigint as n1, n0::bigint as n0, round(psi, 6) as psi, round(psi / (1/n1 + 1/n0), 4) as psi_chi, (b - 1)::bigint as df, case when n1 < 100 then 'THIN_SKETCH' when n0 < 100 then 'THIN_BASELINE' else 'OK' end as status from c")
def psi_drift(spark, d):
    c = D.category_drift(days(spark, d), "day", "event_type").where("n0 > 0")
    return c.select("day", F.col("n1").cast("long").alias("n1"), F.col("n0").cast("long").alias("n0"), F.round("psi", 6).alias("psi"), F.round("psi_chi", 4).alias("psi_chi"), F.col("df").cast("long").alias("df"), "status")


@query(f"with c as (select day, {_TERMS} from {_TOT} where t0 > 0 group by 1) select day, round(js, 6) as js_bits, round(g, 4) as g from c")
def js_drift(spark, d):
    return D.category_drift(days(spark, d), "day", "event_type").where("n0 > 0").select("day", F.round("js_bits", 6).alias("js_bits"), F.round("g", 4).alias("g"))


@query()
def category_drift_findings(spark, d):
    """The flagship: every day's mix against the week before, with statistics, p and status."""
    e = T(spark, d, "events")
    h = e.groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return D.with_p(D.category_drift(h, "day", "event_type")).select("day", "n1", "n0", "psi", "js_bits", "g", "df", "psi_p", "g_p", "status")


@query(f"""with t as (select *, case when n1 > 0 then n1/t1/2 * log2(n1/t1 / ((n1/t1 + n0/t0)/2)) else 0 end + case when n0 > 0 then n0/t0/2 * log2(n0/t0 / ((n1/t1 + n0/t0)/2)) else 0 end x from {_TOT} where t0 > 0),
r as (select *, row_number() over (partition by day order by x desc, event_type) rank, sum(x) over (partition by day) s from t) select day, event_type, rank::int as rank, round(x / s, 5) as share from r where rank <= 3""")
def drift_attribution(spark, d):
    p = D.trailing_histograms(days(spark, d), "day", "event_type", 7).where("n0 is not null")
    return C.attribution(p, "event_type", ["day"]).select("day", "event_type", "rank", F.round("share", 5).alias("share"))


_E = [5.0, 10.0, 20.0, 35.0, 50.0, 80.0, 120.0, 200.0]
_EV = ",".join(f"({i},{x})" for i, x in enumerate(_E)) + f",({len(_E)},null)"
_BIN = "+".join(f"({x} < value)::int" for x in _E)


@query(f"""with h as (select strftime(ts,'%Y-%m-%d') as day, {_BIN} as bin, count(*) n from events group by 1,2), k as (select * from (values {_EV}) t(bin, edge)),
s as (select x.day, k.bin, k.edge, coalesce(h.n,0) n from (select distinct day from h) x cross join k left join h on h.day = x.day and h.bin = k.bin),
b as (select *, sum(n) over (partition by bin order by day rows between 7 preceding and 1 preceding) n0 from s),
t as (select *, sum(n) over (partition by day) t1, sum(n0) over (partition by day) t0 from b where n0 is not null),
c as (select *, sum(n0) over w / t0 - sum(n) over w / t1 gap, lead(edge) over w - edge wd from t window w as (partition by day order by bin))
select day, round(max(abs(gap)), 6) as ks, round(sum(abs(gap)*wd), 5) as w1, round(sum(gap*wd), 5) as signed_w1 from c where edge is not null group by 1""")
def wasserstein_drift(spark, d):
    e = T(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return D.numeric_drift(e, "value", "day", _E).select("day", F.round("ks", 6).alias("ks"), F.round("w1", 5).alias("w1"), F.round("signed_w1", 5).alias("signed_w1"))


@query(f"""select day, event_type, n1::bigint as n1, n0::bigint as n0 from {_TRAIL}""")
def histogram_alignment(spark, d):
    return D.trailing_histograms(days(spark, d), "day", "event_type", 7).na.fill(0, ["n0"])


_UD = "(select strftime(ts, '%Y-%m-%d') as day, user_id, count(*) n from events group by 1, 2)"


@query(f"""with s as (select x.day, k.user_id, coalesce(h.n,0) n from (select distinct day from {_UD}) x cross join (select distinct user_id from {_UD}) k left join {_UD} h on h.day=x.day and h.user_id=k.user_id),
b as (select day, user_id, n n1, sum(n) over (partition by user_id order by day rows between 7 preceding and 1 preceding) n0 from s),
t as (select *, sum(n1) over (partition by day) t1, sum(n0) over (partition by day) t0, row_number() over (partition by day order by n1 desc, user_id) r1, row_number() over (partition by day order by n0 desc, user_id) r0 from b where n0 is not null),
f as (select *, n1 > 0 and r1 <= 10 as now, n0 > 0 and r0 <= 10 as ref, (n1/t1 - n0/t0) / sqrt(((n1+n0)/(t1+t0))*(1-(n1+n0)/(t1+t0))*(1/t1+1/t0)) z from t)
select day, user_id, round(z, 5) as z, case when not ref and z > 0 then 'APPEARED' when not now and z < 0 then 'VANISHED' when z > 0 then 'UP' else 'DOWN' end as label from f where now or ref""")
def heavy_hitter_shift(spark, d):
    h = T(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return D.heavy_hitter_shift(h, "day", "user_id").select("day", "user_id", F.round("z", 5).alias("z"), "label")


@query(f"""with t as (select *, sum(n) over (partition by day) t, row_number() over (partition by day order by n) i, count(*) over (partition by day) k from {_UD}) select day, max(t)::bigint as total, round(sum((n/t)^2), 6) as hhi, round(4/max(t)*(sum((n/t)^3) - sum((n/t)^2)^2), 9) as hhi_variance, round(sum((2*i-k-1)*n)/(max(k)*max(t)), 6) as gini, round(max(n/t), 6) as top1_share from t group by 1""")
def hhi_gini(spark, d):
    h = T(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    s = C.shares_shape(h, ["day"])
    return s.select("day", F.col("total").cast("long").alias("total"), *(F.round(c, 9 if c == "hhi_variance" else 6).alias(c) for c in ("hhi", "hhi_variance", "gini", "top1_share")))


@query(f"""with r as (select *, row_number() over (partition by day order by n desc, user_id) r from {_UD}), t as (select day, list_sort(list(user_id::varchar)) top from r where r <= 10 group by 1), l as (select day, top, lag(top) over (order by day) b from t)
select day, round(1 - len(list_intersect(top, b)) / least(len(top), len(b)), 6) as churn, (len(top) - len(list_intersect(top, b)))::int as entrants, (len(b) - len(list_intersect(top, b)))::int as exits from l where b is not null""")
def rank_churn(spark, d):
    h = T(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return D.rank_churn(h, "day", "user_id").withColumn("churn", F.round("churn", 6))


# -- segments ---------------------------------------------------------------------------------------------

_PANEL = "(select c_mktsegment seg, count(*) n, sum(c_acctbal) s1, sum(c_acctbal*c_acctbal) s2 from customer group by 1 having count(*) >= 30)"


@query(f"""with p as (select *, sum(n) over () - n m, sum(s1) over () - s1 o1, sum(s2) over () - s2 o2 from {_PANEL}), v as (select seg, n, m, s1/n a, o1/m b, (s2 - s1*s1/n)/(n-1) va, (o2 - o1*o1/m)/(m-1) vb from p)
select seg as c_mktsegment, n, round((a-b)/sqrt(va/n + vb/m), 5) as z, round((a-b)/sqrt((va+vb)/2), 6) as d from v""")
def segment_divergence_mean(spark, d):
    return D.segment_divergence_mean(T(spark, d, "customer"), "c_acctbal", "c_mktsegment").select("c_mktsegment", "n", F.round("z", 5).alias("z"), F.round("d", 6).alias("d"))


@query("""with p as (select event_type seg, count(*) n, count(*) filter (value <= 20) k from events group by 1), o as (select *, sum(n) over () - n m, sum(k) over () - k j from p)
select seg as event_type, n, k as nulls, round((k/n - j/m) / sqrt(((k+j)/(n+m))*(1-(k+j)/(n+m))*(1/n+1/m)), 5) as z from o""")
def segment_divergence_null(spark, d):
    e = T(spark, d, "events").withColumn("v", F.when(F.col("value") > 20, F.col("value")))
    return D.segment_divergence_null(e, "v", "event_type").select("event_type", "n", "nulls", F.round("z", 5).alias("z"))


@query(f"""with h as (select l_returnflag seg, l_linestatus k, count(*) n from lineitem group by 1,2), s as (select a.seg, b.k, coalesce(h.n,0) n1 from (select distinct seg from h) a cross join (select distinct k from h) b left join h on h.seg=a.seg and h.k=b.k),
o as (select *, sum(n1) over (partition by k) - n1 n0 from s), t as (select *, sum(n1) over (partition by seg) t1, sum(n0) over (partition by seg) t0, count(*) over (partition by seg) b from o)
select seg as l_returnflag, round(g, 3) as g, round(js, 6) as js_bits from (select seg, {_TERMS} from t group by 1)""")
def segment_divergence_mix(spark, d):
    return D.segment_divergence_mix(T(spark, d, "lineitem"), "l_linestatus", "l_returnflag").select("l_returnflag", F.round("g", 3).alias("g"), F.round("js_bits", 6).alias("js_bits"))


def _panel_sql(cond):
    return f"(select seg, n, m, s1/n a, o1/m b, (s2 - s1*s1/n)/(n-1) va, (o2 - o1*o1/m)/(m-1) vb from (select *, sum(n) over () - n m, sum(s1) over () - s1 o1, sum(s2) over () - s2 o2 from (select o_orderpriority seg, count(*) n, sum(o_totalprice) s1, sum(o_totalprice*o_totalprice) s2 from orders where {cond} group by 1)))"


@query(f"select x.seg as o_orderpriority, round(((x.a-x.b)-(y.a-y.b)) / sqrt(x.va/x.n + x.vb/x.m + y.va/y.n + y.vb/y.m), 4) as z from {_panel_sql('year(o_orderdate) = 1997')} x join {_panel_sql('year(o_orderdate) = 1996')} y on x.seg = y.seg")
def emerging_did(spark, d):
    o = T(spark, d, "orders")
    p = lambda y: D.segment_divergence_mean(o.where(F.year("o_orderdate") == y), "o_totalprice", "o_orderpriority")
    return D.emerging(p(1997), p(1996), "o_orderpriority").select("o_orderpriority", F.round("z", 4).alias("z"))


@query(f"with g as (select strftime(d,'%Y-%m') as month, count(*) e, count(distinct s) s, count(distinct t) t, count(distinct (s,t)) p from {_EDGES} group by 1) select month, e as edges, round(e/s,6) as mean_out_degree, round(e/t,6) as mean_in_degree, round(e/p,6) as edge_multiplicity from g")
def graph_series(spark, d):
    e = edges(spark, d).withColumn("month", F.date_format("d", "yyyy-MM"))
    return D.graph_series(e, "s", "t", "month").select("month", "edges", *(F.round(c, 6).alias(c) for c in ("mean_out_degree", "mean_in_degree", "edge_multiplicity")))


@query(f"""with g as (select strftime(d,'%Y-%m') as month, count(*) e, count(distinct t) t from {_EDGES} group by 1), v as (select month, e, ln(e/t) x from g),
w as (select *, count(x) over f k, avg(x) over f m, stddev_samp(x) over f s from v window f as (order by month rows between 12 preceding and 1 preceding))
select month, 'mean_in_degree' as metric, k, case when k >= 5 and e >= 100 then round((x-m)/(greatest(s, 1e-9*abs(m), 1e-12)*sqrt(1+1/k)), 4) end as t, case when k < 5 then 'NO_BASELINE' when e < 100 then 'THIN_SKETCH' else 'OK' end as status from w""")
def graph_anomaly(spark, d):
    e = edges(spark, d).withColumn("month", F.date_format("d", "yyyy-MM"))
    return D.graph_anomaly(e, "s", "t", "month").where("metric = 'mean_in_degree'").select("month", "metric", "k", F.round("t", 4).alias("t"), "status")


@query("""with c as (select strftime(l_shipdate,'%Y-%m') as month, count(*) n, corr(l_quantity, l_extendedprice) r from lineitem group by 1), l as (select *, lag(n) over (order by month) n0, lag(r) over (order by month) r0 from c)
select month, n, round(r, 6) as r, case when n >= 50 and n0 >= 50 then round((atanh(greatest(least(r,0.999999),-0.999999)) - atanh(greatest(least(r0,0.999999),-0.999999)))/sqrt(1/(n-3)+1/(n0-3)), 4) end as z from l where n0 is not null""")
def correlation_shift(spark, d):
    li = T(spark, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return D.correlation_shift(li, "l_quantity", "l_extendedprice", "month").select("month", "n", F.round("r", 6).alias("r"), F.round("z", 4).alias("z"))


_TAILS = """with f as (select s_suppkey id, s_acctbal x, s_nationkey::double y from supplier), l as (select id, 'x' c, x v from f union all select id, 'y', y from f),
t as (select id, c, v, -ln(cume_dist() over (partition by c order by v)) lt, -ln(cume_dist() over (partition by c order by v desc)) rt, count(*) over (partition by c) m, avg(v) over (partition by c) a, sum(v*v) over (partition by c) s2, sum(v*v*v) over (partition by c) s3 from l),
k as (select *, case when (s3/m - 3*a*s2/m + 2*a^3) < 0 then lt else rt end b from t)"""


@query(_TAILS + " select id as s_suppkey, round(greatest(sum(lt), sum(rt), sum(b)), 6) as score from k group by 1")
def ecod(spark, d):
    s = T(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return D.tail_scores(s, "s_suppkey", ["x", "y"]).select("s_suppkey", F.round("score", 6).alias("score"))


@query(_TAILS + " select id as s_suppkey, round(sum(greatest(b, (lt+rt)/2)), 6) as score from k group by 1")
def copod(spark, d):
    s = T(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return D.tail_scores(s, "s_suppkey", ["x", "y"], "copod").select("s_suppkey", F.round("score", 6).alias("score"))


@query()
def matrix_profile(spark, d):
    m = months(spark, d).withColumn("series", F.lit("orders"))
    return D.matrix_profile_findings(m, "series", "month", "n")


@query("""with h as (select floor(o_totalprice / pow(10, floor(log10(o_totalprice))))::int dg, count(*) n from orders where o_totalprice > 0 group by 1), t as (select sum(n) t from h)
select max(t)::bigint as n, round(sum(pow(coalesce(n,0) - t*log10(1+1/k), 2) / (t*log10(1+1/k))), 3) as chi2 from range(1,10) r(k) left join h on dg = k cross join t""")
def benford(spark, d):
    return D.benford(T(spark, d, "orders"), "o_totalprice").select("n", F.round("chi2", 3).alias("chi2"))


@query()
def detector_candidates(spark, d):
    c = T(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("k"))
    p = D.proportion_shift(c, "day", "k", "n").withColumn("p", K.normal_p(F.col("z")))
    return D.to_candidates(p, "p", "null_rate_shift", "day")
