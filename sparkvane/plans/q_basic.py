"""Queries: predicates, projections, aggregates, sketches, grouping, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import series as S
from ..session import table as T
from .probe import Probe, join_cardinality, join_edges, plan
from .registry import query
from .segment import where

# -- predicates: the twelve operators, counted over lineitem or orders -------------------------

_PREDICATES = {
    "eq": (("l_returnflag", "eq", "R"), "l_returnflag = 'R'"),
    "ne": (("l_returnflag", "ne", "R"), "l_returnflag <> 'R'"),
    "lt": (("l_quantity", "lt", 10.0), "l_quantity < 10"),
    "le": (("l_quantity", "le", 10.0), "l_quantity <= 10"),
    "gt": (("l_quantity", "gt", 40.0), "l_quantity > 40"),
    "ge": (("l_quantity", "ge", 40.0), "l_quantity >= 40"),
    "in": (("l_returnflag", "in", "A", "N"), "l_returnflag in ('A', 'N')"),
    "not_in": (("l_returnflag", "not_in", "A", "N"), "l_returnflag not in ('A', 'N')"),
    "is_null": (("nullable_flag", "is_null"), "nullif(l_returnflag, 'R') is null"),
    "not_null": (("nullable_flag", "not_null"), "nullif(l_returnflag, 'R') is not null"),
    "between": (("l_quantity", "between", 10.0, 20.0), "l_quantity between 10 and 20"),
    "prefix": (("l_linestatus", "prefix", "O"), "starts_with(l_linestatus, 'O')"),
}


def _filtered(segment):
    def run(spark, d):
        df = T(spark, d, "lineitem").withColumn("nullable_flag", F.nullif("l_returnflag", F.lit("R")))
        return segment.apply(df).groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))

    return run


for _op, (_p, _sql) in _PREDICATES.items():
    query(f"select l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem where {_sql} group by 1", f"filter_{_op}")(_filtered(where(_p)))

query("select l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem where l_returnflag in ('A','R') and l_quantity between 5 and 30 and l_discount > 0.02 group by 1", "filter_conjunction")(
    _filtered(where(("l_returnflag", "in", "A", "R"), ("l_quantity", "between", 5.0, 30.0), ("l_discount", "gt", 0.02)))
)
query("select l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem where nullif(l_returnflag,'R') not in ('A') group by 1", "filter_not_in_nullable")(_filtered(where(("nullable_flag", "not_in", "A"))))


@query("select o_orderkey, o_orderstatus as status, round(o_totalprice, 2) as price from orders where o_totalprice > 200000")
def projection_aliased(spark, d):
    return T(spark, d, "orders").where("o_totalprice > 200000").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.round("o_totalprice", 2).alias("price"))


@query("select count(*) as rows from lineitem")
def row_count(spark, d):
    return plan(Probe("ROW_COUNT"), T(spark, d, "lineitem"))


@query("select c as column, n - k as nulls, n as total, round((n - k) / n, 6) as rate from (select count(*) n, count(nullif(event_type,'error')) a, count(case when value > 20 then value end) b from events) t, lateral (values ('event_type', a), ('value', b)) v(c, k)")
def null_rate(spark, d):
    e = T(spark, d, "events").select(F.nullif("event_type", F.lit("error")).alias("event_type"), F.when(F.col("value") > 20, F.col("value")).alias("value"))
    return plan(Probe("NULL_RATE", ("event_type", "value")), e).withColumn("rate", F.round("rate", 6))


@query("select count(distinct user_id) as distinct from events")
def distinct_count(spark, d):
    return plan(Probe("DISTINCT_COUNT", ("user_id",)), T(spark, d, "events"))


@query("select min(o_totalprice) as lo, max(o_totalprice) as hi, count(o_totalprice) as n from orders")
def column_bounds(spark, d):
    return plan(Probe("COLUMN_BOUNDS", ("o_totalprice",)), T(spark, d, "orders"))


@query("select strftime(max(ts), '%Y-%m-%d %H:%M:%S') as latest, count(ts) as n from events")
def freshness(spark, d):
    return plan(Probe("FRESHNESS", ("ts",)), T(spark, d, "events")).withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))


_FR = (0.01, 0.25, 0.5, 0.75, 0.99)


@query("select f as fraction, round(v, 6) as value from (" + " union all ".join(f"select {f}::double f, quantile_cont(value, {f}) v from events" for f in _FR) + ")")
def quantiles_cont(spark, d):
    return plan(Probe("QUANTILES", ("value",)), T(spark, d, "events")).select(F.col("fraction").cast("double").alias("fraction"), F.round("value", 6).alias("value"))


@query("select f as fraction, round(v, 6) as value from (" + " union all ".join(f"select {f}::double f, quantile_disc(value, {f}) v from events" for f in _FR) + ")")
def quantiles_disc(spark, d):
    return A.quantiles(T(spark, d, "events"), "value", list(_FR), discrete=True).select(F.col("fraction").cast("double").alias("fraction"), F.round("value", 6).alias("value"))


@query("select category, n from (select nullif(event_type, 'error') as category, count(*) as n from events group by 1)")
def category_histogram(spark, d):
    e = T(spark, d, "events").select(F.nullif("event_type", F.lit("error")).alias("event_type"))
    return A.category_histogram(e, "event_type").select("category", "n")


@query("with h as (select l_partkey::varchar c, count(*) n from lineitem group by 1), t as (select *, row_number() over (order by n desc, c) r, count(*) over () k from h) select case when k <= 100 or r <= 50 then c else 'OTHER' end as category, sum(n)::bigint as n, max(case when k <= 100 then 'exact' else 'top' end) as regime from t group by 1")
def category_histogram_degraded(spark, d):
    return A.category_histogram(T(spark, d, "lineitem"), "l_partkey", 100, 50)


@query("select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 20")
def heavy_hitters_top_k(spark, d):
    return plan(Probe("HEAVY_HITTERS", ("l_partkey",), params=(("k", 20),)), T(spark, d, "lineitem"))


_MOMENTS = """round(avg(x),6) as mean, round(var_samp(x),4) as variance, round(stddev_samp(x),6) as sd,
  round((sum(x*x*x)/count(x) - 3*avg(x)*sum(x*x)/count(x) + 2*avg(x)^3) / pow(var_pop(x),1.5), 4) as skewness, round(kurtosis_pop(x),4) as kurtosis,
  round(stddev_samp(x)/abs(avg(x)),6) as cv, round(min(x),6) as min, round(max(x),6) as max, round(sum(x),2) as sum, round(sum(x*x),1) as sum_sq, (count(v)-count(x))::bigint as nonfinite"""


def _round_moments(df, *keys):
    dp = {"mean": 6, "variance": 4, "sd": 6, "skewness": 4, "kurtosis": 4, "cv": 6, "min": 6, "max": 6, "sum": 2, "sum_sq": 1}
    return df.select(*keys, "n", *(F.round(c, k).alias(c) for c, k in dp.items()), "nonfinite")


@query(f"select event_type, count(x) as n, {_MOMENTS} from (select event_type, v, case when isfinite(v) then v end x from (select event_type, case when event_id % 97 = 0 then 'nan'::double when event_id % 89 = 0 then 'infinity'::double else value end v from events)) group by 1")
def moments(spark, d):
    v = F.when(F.col("event_id") % 97 == 0, float("nan")).when(F.col("event_id") % 89 == 0, float("inf")).otherwise(F.col("value"))
    return _round_moments(A.moments(T(spark, d, "events").withColumn("v", v), "v", ["event_type"]), "event_type")


@query("select event_type, count(value) as n, round(avg(value),6) as mean, round(var_samp(value),4) as variance, round((sum(value^3)/count(value) - 3*avg(value)*sum(value*value)/count(value) + 2*avg(value)^3)/pow(var_pop(value),1.5),4) as skewness, round(kurtosis_pop(value),4) as kurtosis from events group by 1")
def moments_merged(spark, d):
    """Daily states merged per type: equal to the moments of all rows."""
    e = T(spark, d, "events").withColumn("day", F.to_date("ts"))
    m = A.finish_moment_state(A.merge_moment_states(A.moment_state(e, "value", ["event_type", "day"], 50.0), ["event_type"]), 50.0)
    return m.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis"))


_GRID = (5.0, 10.0, 20.0, 50.0, 100.0, 200.0)


@query("select g::double as at, round(avg((value <= g)::int), 6) as cdf from events, (values (5),(10),(20),(50),(100),(200)) t(g) group by 1")
def cdf_grid(spark, d):
    return A.cdf(T(spark, d, "events"), "value", list(_GRID)).select("at", F.round("cdf", 6).alias("cdf"))


@query("select ((5<value)::int+(10<value)::int+(20<value)::int+(50<value)::int+(100<value)::int+(200<value)::int) as bin, count(*) as n from events group by 1")
def pmf_bins(spark, d):
    return A.pmf(T(spark, d, "events"), "value", list(_GRID))


@query("select l_returnflag, count(*) as n, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem group by 1")
def pair_sum_correlation(spark, d):
    return A.pair_correlation(T(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn("r", F.round("r", 6))


@query("select c_custkey, round(count(*) over (partition by c_mktsegment) / count(*) over (), 6) as share from customer")
def frequency_encoding(spark, d):
    return A.frequency_encoding(T(spark, d, "customer"), "c_mktsegment").select("c_custkey", F.round("c_mktsegment_share", 6).alias("share"))


# -- graph: customer -> supplier ------------------------------------------------------------------

_EDGES = "(select o_custkey s, l_suppkey t, o_orderdate d from orders join lineitem on o_orderkey = l_orderkey)"


def edges(spark, d):
    li, o = T(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), T(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("s"), F.col("l_suppkey").alias("t"), F.col("o_orderdate").alias("d"))


@query(f"select e as edges, s as sources, t as targets, p as distinct_edges, round(e/s,6) as mean_out_degree, round(e/t,6) as mean_in_degree, round(e/p,6) as edge_multiplicity, round(s/t,6) as fan_in_out_ratio from (select count(*) e, count(distinct s) s, count(distinct t) t, count(distinct (s,t)) p from {_EDGES})")
def graph_shape(spark, d):
    g = A.graph_shape(edges(spark, d), "s", "t")
    return g.select("edges", "sources", "targets", "distinct_edges", *(F.round(c, 6).alias(c) for c in ("mean_out_degree", "mean_in_degree", "edge_multiplicity", "fan_in_out_ratio")))


@query(f"select round(sum(case when r <= 10 then n end) / sum(n), 6) as share from (select *, row_number() over (order by n desc, t) r from (select t, count(*) n from {_EDGES} group by 1))")
def graph_concentration(spark, d):
    return A.concentration(edges(spark, d), "t").select(F.round("share", 6).alias("share"))


@query(f"select round(quantile_cont(n, 0.5), 6) as q50, round(quantile_cont(n, 0.99), 6) as q99 from (select s, count(*) n from {_EDGES} group by 1)")
def graph_degree_quantiles(spark, d):
    return A.degrees(edges(spark, d), "s").agg(F.percentile("degree", [0.5, 0.99]).alias("q")).select(F.round(F.element_at("q", 1), 6).alias("q50"), F.round(F.element_at("q", 2), 6).alias("q99"))


@query(f"select t, count(*) as degree from {_EDGES} group by 1 order by degree desc, t limit 10")
def fan_in_heavy_hitters(spark, d):
    return A.degrees(edges(spark, d), "t").orderBy(F.desc("degree"), "t").limit(10)


# -- grouping sets, cubes, roll-ups ---------------------------------------------------------------


@query("select n_name, c_mktsegment, count(*) as n, grouping(n_name)*2 + grouping(c_mktsegment) as gid from customer join nation on c_nationkey = n_nationkey group by grouping sets ((n_name),(c_mktsegment),(n_name,c_mktsegment),())")
def panel_grouping_sets(spark, d):
    j = T(spark, d, "customer").join(T(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = j.groupingSets([["n_name"], ["c_mktsegment"], ["n_name", "c_mktsegment"], []], "n_name", "c_mktsegment")
    return g.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by cube (l_returnflag, l_linestatus)")
def panel_cube(spark, d):
    return T(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("select year(o_orderdate) as y, o_orderpriority as p, count(*) as n from orders group by rollup (1, 2)")
def panel_rollup(spark, d):
    return T(spark, d, "orders").rollup(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query("select l::int as level, floor(epoch_us(ts)/3600000000.0/pow(2,l))::bigint as window, sum(value_c)::bigint as v, count(*) as parts from (select date_trunc('hour', ts) ts, count(*) value_c from events group by 1), range(4) r(l) group by 1,2")
def rollup_time_levels(spark, d):
    e = T(spark, d, "events").groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("idx")).agg(F.count(F.lit(1)).alias("v"))
    return S.rollup_levels(e, "idx", ["v"], levels=4)


@query("select c_mktsegment, c_nationkey, count(*) as n from customer group by 1,2 having count(*) >= 12")
def having_small_cells(spark, d):
    return T(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 12")


# -- joins ---------------------------------------------------------------------------------------------


@query("select n_name, count(*) as n, round(sum(c_acctbal), 2) as bal from customer join nation on c_nationkey = n_nationkey group by 1")
def join_inner(spark, d):
    j = T(spark, d, "customer").join(T(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))


@query("select c_custkey, count(o_orderkey) as orders from customer left join orders on c_custkey = o_custkey group by 1")
def join_left(spark, d):
    o = T(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))  # aggregate before the join
    return T(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("select k, coalesce(a,0)::bigint as a, coalesce(b,0)::bigint as b from (select l_partkey % 500 k, count(*) a from lineitem where l_returnflag='R' and l_quantity > 45 group by 1) full join (select l_partkey % 500 k, count(*) b from lineitem where l_returnflag='A' and l_quantity < 5 group by 1) using (k)")
def join_full(spark, d):
    li = T(spark, d, "lineitem").withColumn("k", F.col("l_partkey") % 500)
    a = li.where("l_returnflag='R' and l_quantity > 45").groupBy("k").agg(F.count(F.lit(1)).alias("a"))
    b = li.where("l_returnflag='A' and l_quantity < 5").groupBy("k").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "k", "full").na.fill(0, ["a", "b"])


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def join_semi(spark, d):
    return T(spark, d, "customer").select("c_custkey").join(T(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def join_anti(spark, d):
    return T(spark, d, "customer").select("c_custkey").join(T(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("select (select count(*) from customer join orders on c_custkey = o_custkey)::bigint as joined, (select count(*) from customer where c_custkey not in (select o_custkey from orders))::bigint as unmatched, (select max(n) from (select o_custkey, count(*) n from orders where o_custkey in (select c_custkey from customer) group by 1)) as max_fan_out")
def join_cardinality_probe(spark, d):
    return join_cardinality(T(spark, d, "customer"), T(spark, d, "orders"), "c_custkey", "o_custkey")


_CATALOG = [("customer", "c_custkey", "bigint"), ("customer", "c_nationkey", "int"), ("orders", "o_orderkey", "bigint"), ("orders", "o_custkey", "bigint"), ("lineitem", "l_orderkey", "bigint"), ("lineitem", "l_partkey", "bigint"), ("lineitem", "l_suppkey", "bigint"), ("part", "p_partkey", "bigint"), ("supplier", "s_suppkey", "bigint"), ("nation", "n_nationkey", "int"), ("nation", "n_regionkey", "int"), ("region", "r_regionkey", "int")]


def catalog_profile(spark, d):
    from functools import reduce

    by = {}
    for t, c, k in _CATALOG:
        by.setdefault(t, []).append((c, k))
    parts = []
    for t, cs in by.items():
        a = T(spark, d, t).agg(*(x for c, _ in cs for x in (F.count_distinct(c).alias(f"d_{c}"), F.min(c).cast("double").alias(f"a_{c}"), F.max(c).cast("double").alias(f"b_{c}"))))
        rows = F.array(*(F.struct(F.lit(t).alias("table"), F.lit(c).alias("column"), F.lit(k).alias("type"), F.col(f"d_{c}").alias("ndv"), F.col(f"a_{c}").alias("lo"), F.col(f"b_{c}").alias("hi")) for c, k in cs))
        parts.append(a.select(F.inline(rows)))
    return reduce(lambda x, y: x.unionAll(y), parts)


_CAT_SQL = " union all ".join(f"select '{t}' tb, '{c}' c, '{k}' k, count(distinct {c}) ndv, min({c})::double lo, max({c})::double hi from {t}" for t, c, k in _CATALOG)


@query(f"""with p as ({_CAT_SQL}), s as (select *, regexp_replace(regexp_replace(c, '^[a-z]+_', ''), '(_id|_?key)$', '') st from p)
select l.tb as l_table, l.c as l_column, r.tb as r_table, r.c as r_column, round(0.5*(l.lo>=r.lo and l.hi<=r.hi)::int + 0.3*least(1.0, r.ndv/l.ndv) + 0.2*(case when l.c=r.c then 1.0 when l.st=r.st then 0.9 when ends_with(l.c,r.c) or ends_with(r.c,l.c) then 0.6 else 0 end), 6) as confidence
from s l join s r on l.k=r.k and l.tb<>r.tb and l.ndv<=r.ndv and l.ndv>0 where 0.5*(l.lo>=r.lo and l.hi<=r.hi)::int + 0.3*least(1.0, r.ndv/l.ndv) + 0.2*(case when l.c=r.c then 1.0 when l.st=r.st then 0.9 when ends_with(l.c,r.c) or ends_with(r.c,l.c) then 0.6 else 0 end) >= 0.5""")
def join_graph_edges(spark, d):
    return join_edges(catalog_profile(spark, d))


# -- set operations -------------------------------------------------------------------------------------


@query("select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'")
def set_intersect(spark, d):
    o = T(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("select o_custkey from orders where o_orderstatus = 'F' except all select o_custkey from orders where o_orderstatus = 'O'")
def set_except_all(spark, d):
    o = T(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").exceptAll(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("select 'customer' as src, c_custkey as id, c_mktsegment as segment from customer union all select 'supplier', s_suppkey, null from supplier")
def set_union_promoted(spark, d):
    from ..sources.tables import union_files

    a = T(spark, d, "customer").select(F.lit("customer").alias("src"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return union_files([a, T(spark, d, "supplier").select(F.lit("supplier").alias("src"), F.col("s_suppkey").alias("id"))])


@query("select distinct l_returnflag, l_linestatus from lineitem")
def set_dedup(spark, d):
    return T(spark, d, "lineitem").select("l_returnflag", "l_linestatus").dropDuplicates()


@query("select * from (values ('l_comment','added',null,'string'),('l_tax','removed','double',null),('l_quantity','retyped','double','bigint')) t(\"column\", change, old, new)")
def schema_change(spark, d):
    from ..operators.detect import schema_diff

    old = [(f.name, f.dataType.simpleString()) for f in T(spark, d, "lineitem").schema]
    new = [(c, "bigint" if c == "l_quantity" else t) for c, t in old if c != "l_tax"] + [("l_comment", "string")]
    s = "column string, type string"
    return schema_diff(spark.createDataFrame(old, s), spark.createDataFrame(new, s))


# -- sketches: estimates within bounds (no oracle of their own bytes) ---------------------------------------


@query("select event_type, true as within from events group by 1")
def theta_distinct(spark, d):
    """Merged daily theta states against the exact count, exact below 4096."""
    e = T(spark, d, "events").withColumn("day", F.to_date("ts"))
    s = A.theta_merge(A.theta_state(e, "user_id", ["event_type", "day"]), ["event_type"])
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("x"))
    return s.select("event_type", *A.theta_bounds("state")).join(exact, "event_type").select("event_type", ((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))).alias("within"))


@query("select true as within")
def theta_set_operations(spark, d):
    o = T(spark, d, "orders")
    two = o.agg(F.theta_sketch_agg(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("a"), F.theta_sketch_agg(F.when(F.col("o_orderstatus") == "O", F.col("o_custkey"))).alias("b"))
    est = two.select(F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("i"), F.theta_sketch_estimate(F.theta_difference("a", "b")).alias("m"), F.theta_sketch_estimate("a").alias("n"))
    return est.select((F.abs(F.col("i") + F.col("m") - F.col("n")) <= 0.1 * F.col("n") + 2).alias("within"))


@query("select true as within")
def hll_distinct(spark, d):
    e = T(spark, d, "lineitem")
    s = A.hll_merge(A.hll_state(e, "l_partkey", ["l_returnflag"]))
    return s.select(F.hll_sketch_estimate("state").alias("est")).crossJoin(e.agg(F.count_distinct("l_partkey").alias("x"))).select((F.abs(F.col("est") - F.col("x")) <= 0.07 * F.col("x") + 2).alias("within"))


@query("select 0.5::double as fraction, true as within")
def kll_rank(spark, d):
    e = T(spark, d, "events")
    s = A.kll_state(e, "value").select(F.kll_sketch_get_quantile_double("state", F.lit(0.5)).alias("q"))
    r = e.crossJoin(F.broadcast(s)).agg(F.avg((F.col("value") <= F.col("q")).cast("double")).alias("r"))
    return r.select(F.lit(0.5).cast("double").alias("fraction"), (F.abs(F.col("r") - 0.5) < 0.03).alias("within"))


@query("select true as never_under, true as close")
def count_min_heavy(spark, d):
    li = T(spark, d, "lineitem")
    exact = A.degrees(li, "l_suppkey")
    est = A.count_min_estimate(A.count_min_matrix(li, "l_suppkey"), exact.select("l_suppkey"), "l_suppkey")
    j = est.join(exact, "l_suppkey")
    return j.agg(F.bool_and(F.col("estimate") >= F.col("degree")).alias("never_under"), (F.max(F.col("estimate") - F.col("degree")) <= 0.005 * F.sum("degree")).alias("close"))


@query("select true as no_misses, true as few_false")
def bloom_membership(spark, d):
    o = T(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    st = A.bloom_state(o.distinct(), "k")
    c = T(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    got = A.bloom_contains(c, "k", st).join(o.distinct().withColumn("real", F.lit(True)), "k", "left")
    return got.agg(F.bool_and(~F.coalesce("real", F.lit(False)) | F.col("maybe")).alias("no_misses"), (F.avg((F.col("maybe") & F.col("real").isNull()).cast("int")) < 0.2).alias("few_false"))


@query()
def sketch_feature_vector(spark, d):
    return A.feature_vector(T(spark, d, "events"), "value", [5, 10, 20, 30, 50, 75, 100, 150, 200], ["event_type"])


@query("select l_returnflag as item, count(*) as count from lineitem group by 1")
def approx_top_k(spark, d):
    return T(spark, d, "lineitem").agg(F.expr("approx_top_k(l_returnflag, 3)").alias("top")).select(F.inline("top"))


# -- JSON, arrays -------------------------------------------------------------------------------------------


@query("select event_type, count(*) as n, sum((props->>'$.k')::bigint)::bigint as k from events group by 1")
def json_path(spark, d):
    return T(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("select event_type, sum((props->>'$.k')::bigint)::bigint as k from events group by 1")
def json_typed(spark, d):
    return T(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("p")).groupBy("event_type").agg(F.sum("p.k").alias("k"))
