"""Queries: features, labels, findings, context, evaluation, disclosure, scalars, sources, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import context as CX
from ..operators import disclosure as DC
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import findings as FS
from ..session import table as T
from ..sources import tables as R
from ..streaming import stream as SS
from .registry import query

DAY = 86_400 * FE.SECOND

# -- point-in-time features -----------------------------------------------------------------------


def _pit_sql(agg, lo="interval 1 day", hi="e.ts", op="<"):
    return f"select e.event_id, {agg} as value from events e left join events h on h.user_id = e.user_id and h.ts >= e.ts - {lo} and h.ts {op} {hi} group by e.event_id"


@query(_pit_sql("round(avg(h.value), 6)"))
def pit_avg_1d(spark, d):
    e = FE.pit_self(T(spark, d, "events"), "user_id", "ts", F.avg("value"), FE.Rule(DAY), "mean")
    return e.select("event_id", F.round("mean", 6).alias("value"))


@query(_pit_sql("count(h.event_id)", "interval 7 day", "e.ts - interval 1 day"))
def pit_count_embargo(spark, d):
    e = FE.pit_self(T(spark, d, "events"), "user_id", "ts", F.count("event_id"), FE.Rule(7 * DAY, DAY), "n", True)
    return e.select("event_id", F.col("n").alias("value"))


@query(_pit_sql("count(h.event_id)", "interval 7 day", "e.ts - interval 1 day", "<="))
def pit_inclusive_end(spark, d):
    e = FE.pit_self(T(spark, d, "events"), "user_id", "ts", F.count("event_id"), FE.Rule(7 * DAY, DAY, True), "n", True)
    return e.select("event_id", F.col("n").alias("value"))


@query(_pit_sql("count(distinct h.event_type)", "interval 3 day"))
def pit_distinct(spark, d):
    e = T(spark, d, "events")
    h = e.select("user_id", F.col("ts").alias("hts"), F.col("event_type").alias("htype"))
    return FE.pit_join(e, h, "user_id", "ts", "hts", F.count_distinct("htype"), FE.Rule(3 * DAY), "event_id", "n", True).select("event_id", F.col("n").alias("value"))


@query("select o.o_orderkey, round(sum(coalesce(h.o_totalprice, 0)), 2) as value from orders o left join orders h on h.o_custkey = o.o_custkey and h.o_orderdate >= o.o_orderdate - interval 365 day and h.o_orderdate < o.o_orderdate group by 1")
def interval_join_pit(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    h = T(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("hdate"), "o_totalprice")
    return FE.pit_join(o, h, "o_custkey", "o_orderdate", "hdate", F.sum("o_totalprice"), FE.Rule(365 * DAY), "o_orderkey", "v", True).select("o_orderkey", F.round("v", 2).alias("value"))


@query("select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders where o_orderdate <= timestamp '1998-01-01' group by 1")
def as_of_latest(spark, d):
    o = T(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return FE.as_of_labels(o, F.lit("1998-01-01").cast("timestamp_ntz"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


def _labels(spark, d):
    """Labels of documents, known 30 to 59 days after an event time derived from the id."""
    l = T(spark, d, "labels").withColumn("event_time", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,cast(doc_id % 90 as int))"))
    return l.withColumn("label_time", F.expr("event_time + make_interval(0,0,0,cast(30 + doc_id % 30 as int))"))


_LAB = "(select *, timestamp '2024-01-01' + to_days((doc_id % 90)::int) as event_time, timestamp '2024-01-01' + to_days((doc_id % 90 + 30 + doc_id % 30)::int) as label_time from labels)"


@query(f"select doc_id, quality from {_LAB} where label_time <= timestamp '2024-03-15'")
def labels_as_of(spark, d):
    return FE.as_of_labels(_labels(spark, d), F.lit("2024-03-15").cast("timestamp_ntz"), "doc_id", "label_time", "doc_id").select("doc_id", "quality")


@query(f"select count(*) as known, count(*) filter (label_time <= timestamp '2024-03-15') as visible from {_LAB}")
def count_as_of(spark, d):
    return _labels(spark, d).agg(F.count(F.lit(1)).alias("known"), F.count(F.when(F.col("label_time") <= F.lit("2024-03-15").cast("timestamp_ntz"), 1)).alias("visible"))


@query("select true as covered")
def label_coverage(spark, d):
    decl = T(spark, d, "events").groupBy("event_type").agg(F.min("ts").alias("starts"), F.max("ts").alias("ends"))
    return FE.coverage(decl, F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))


@query("with c as (select quantile_disc(ts, 0.7) cut from events) select event_id, case when ts < cut then 'train' when ts >= cut + interval 1 day then 'eval' else 'embargo' end as part from events, c")
def half_split_temporal(spark, d):
    return FE.temporal_split(T(spark, d, "events"), "ts", 0.3, DAY).select("event_id", "part")


@query("select true as near_half")
def half_split_mask(spark, d):
    m = FE.mask_split(T(spark, d, "events"), "event_id", 0.5, 11)
    return m.agg((F.abs(F.avg(F.col("hidden").cast("int")) - 0.5) < 0.06).alias("near_half"))


@query("select event_id, (event_type = 'error' and value > 50)::int as flag from events")
def pattern_indicator(spark, d):
    from .segment import where

    return FE.pattern_indicator(T(spark, d, "events"), where(("event_type", "eq", "error"), ("value", "gt", 50.0)), "flag").select("event_id", "flag")


# -- findings ----------------------------------------------------------------------------------------

_P = "(select event_id, (event_id * 7919 % 10007) / 10007.0 as p from events)"


def _pvalues(spark, d):
    return T(spark, d, "events").select("event_id", ((F.col("event_id") * 7919 % 10007) / 10007.0).alias("p"))


@query(f"with r as (select *, row_number() over (order by p, event_id) k, count(*) over () m from {_P}) select event_id, round(min(least(1, p*greatest(m,500)/k)) over (order by k rows between current row and unbounded following), 6) as q from r")
def bh_fdr(spark, d):
    return FS.benjamini_hochberg(_pvalues(spark, d), "p", "event_id", 500).select("event_id", F.round("q", 6).alias("q"))


@query("select user_id, event_type, min(value) as q, max(value) as score, strftime(min(ts),'%Y-%m-%d %H:%M:%S') as first_seen, strftime(max(ts),'%Y-%m-%d %H:%M:%S') as last_seen, count(*) as support from events group by 1,2")
def signature_dedup(spark, d):
    e = T(spark, d, "events").withColumn("sig", FS.signature("user_id", "event_type"))
    p = FS.dedupe(e, "sig", "value", "value", "ts")
    names = e.select("sig", "user_id", "event_type").dropDuplicates(["sig"])
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return p.join(names, "sig").select("user_id", "event_type", "q", "score", f("first_seen"), f("last_seen"), "support")


def _patterns(spark, d):
    c = T(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("pattern_id"), ((F.col("c_custkey") * 37 % 101) / 101.0).alias("q"), (F.col("c_custkey") % 9).cast("double").alias("age_days"), (F.col("c_custkey") % 5 + 1).alias("group_size"),
        (F.col("c_custkey") % 4).alias("confirmed"), (F.col("c_custkey") % 3).alias("rejected"), (F.col("c_custkey") % 7 == 0).alias("explained"), (F.col("c_custkey") % 2 == 0).alias("validated"),
        (F.col("c_custkey") % 11 == 0).alias("suppressed"), F.when(F.col("c_custkey") % 13 == 0, "REJECTED").otherwise("NEW").alias("state"),
    )


_PAT = "(select c_custkey id, (c_custkey*37%101)/101.0 q, c_custkey%9 age, c_custkey%5+1 g, c_custkey%4 c, c_custkey%3 r, c_custkey%7=0 ex, c_custkey%2=0 v from customer where c_custkey%11<>0 and c_custkey%13<>0)"


@query(f"select id as pattern_id, round(s, 6) as queue_score, row_number() over (order by s desc, id) as position from (select id, greatest(.01,1-q)*(case when age<=0 then 1 else pow(0.5, age/3) end)*(c+1)/(c+r+2)*(case when ex then .05 else 1 end) s from {_PAT} where v) order by s desc, id limit 50")
def queue_operational(spark, d):
    return FS.rank_queue(_patterns(spark, d), "operational", 50).select("pattern_id", F.round("queue_score", 6).alias("queue_score"), "position")


@query(f"select id as pattern_id, round(s, 6) as queue_score, row_number() over (order by s desc, id) as position from (select id, 1/g*sqrt(greatest(.01,1-q))*((c+1)/(c+r+2))*(case when ex then .05 else 1 end)*(case when v then 1 else .25 end) s from {_PAT}) order by s desc, id limit 5")
def queue_discovery(spark, d):
    return FS.rank_queue(_patterns(spark, d), "discovery", 5).select("pattern_id", F.round("queue_score", 6).alias("queue_score"), "position")


@query("select c_custkey, (c_custkey in (select o_custkey from orders where o_totalprice > 250000)) as replicated from customer")
def holdout_reconcile(spark, d):
    return FS.reconcile_holdout(T(spark, d, "customer").select("c_custkey"), T(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("select c_custkey from customer where c_mktsegment not in ('BUILDING')")
def suppression_anti(spark, d):
    rules = spark.createDataFrame([("BUILDING",)], "c_mktsegment string")
    return FS.suppress(T(spark, d, "customer"), rules, "c_mktsegment").select("c_custkey")


@query("select o_orderkey, lag(o_orderkey) over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as ancestor from orders")
def ancestry_link(spark, d):
    o = T(spark, d, "orders").withColumn("shape", F.concat_ws("|", "o_custkey", "o_orderpriority"))
    return FS.link_ancestors(o, "shape", "o_orderkey", "o_orderdate").select("o_orderkey", "ancestor")


@query("select event_type, case when bool_or(x > 0) and bool_or(x < 0) then 'MIXED' when bool_or(x > 0) then 'UP' when bool_or(x < 0) then 'DOWN' else 'FLAT' end as direction from (select event_type, value - 40 x from events where value > 45 or event_type in ('click','error')) group by 1")
def effect_direction(spark, d):
    e = T(spark, d, "events").where("value > 45 or event_type in ('click','error')")
    return e.groupBy("event_type").agg(F.array_distinct(F.collect_set(F.signum(F.col("value") - 40))).alias("s")).select("event_type", FS.direction(F.col("s")).alias("direction"))


@query("select * from (values ('NEW','VALIDATED','ok'),('NEW','CONFIRMED','illegal'),('VALIDATED','CONFIRMED','no_evidence'),('EXPIRED','REOPENED','ok')) t(old, new, verdict)")
def lifecycle_transitions(spark, d):
    m = spark.createDataFrame([("NEW", "VALIDATED", 0), ("NEW", "CONFIRMED", 3), ("VALIDATED", "CONFIRMED", 0), ("EXPIRED", "REOPENED", 0)], "old string, new string, evidence int")
    return FS.check_transitions(m).select("old", "new", "verdict")


@query("with w as (select user_id sig, count(*) filter (ts < timestamp '2024-01-16') a, count(*) filter (ts >= timestamp '2024-01-25') b from events group by 1) select sig, (a+b)::bigint as support, case when a = 0 then 'NEW' else 'NEW' end as state, case when b > 0 then 0 else 1 end as idle from w where a + b > 0")
def ingest_upsert(spark, d):
    e = T(spark, d, "events").withColumn("sig", F.col("user_id"))
    old = FS.dedupe(e.where("ts < timestamp_ntz'2024-01-16'"), "sig", "value", "value", "ts").withColumns({"state": F.lit("NEW"), "idle": F.lit(0)})
    new = FS.dedupe(e.where("ts >= timestamp_ntz'2024-01-25'"), "sig", "value", "value", "ts")
    return FS.ingest(old, new, "sig", None).select("sig", "support", "state", "idle")


@query("select a.vec_id, b.vec_id as other, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def embedding_cosine(spark, d):
    a = T(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e2"), (F.col("vec_id") - 1).alias("k"))
    return a.join(b, a.vec_id == b.k).select("vec_id", "other", F.round(X.cosine("embedding", "e2"), 4).alias("cosine"))


@query("select true as intact, 1::bigint as breaks_found")
def hash_chain(spark, d):
    rows, prev = [], ""
    import hashlib

    for i in range(50):
        own = hashlib.sha256(f"{prev}|payload {i}".encode()).hexdigest()
        rows.append((i, prev or None, own, f"payload {i}"))
        prev = own
    s = "seq int, prev string, own string, payload string"
    good = FS.hash_chain_breaks(spark.createDataFrame(rows, s), "seq", "prev", "own", "payload")
    rows[20] = (*rows[20][:3], "changed")
    bad = FS.hash_chain_breaks(spark.createDataFrame(rows, s), "seq", "prev", "own", "payload")
    return good.agg((F.count(F.lit(1)) == 0).alias("intact")).crossJoin(bad.agg(F.count(F.lit(1)).alias("breaks_found")))


# -- context -------------------------------------------------------------------------------------------


@query("select * from (values ('US','Thanksgiving','2024-11-28'),('US','Independence Day','2024-07-04'),('GB','Good Friday','2024-03-29'),('GR','Orthodox Easter Monday','2024-05-06'),('DE','Whit Monday','2024-05-20')) t(code, name, day)")
def holiday_calendar(spark, d):
    h = CX.holidays(spark, ["US", "GB", "GR", "DE"], range(2024, 2025))
    return h.where("name in ('Thanksgiving','Orthodox Easter Monday','Whit Monday','Independence Day') or (code = 'GB' and name = 'Good Friday')").where("not (code in ('GB') and name = 'Whit Monday')").select("code", "name", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("with d as (select x::date as day, dayofweek(x) not in (0,6) as open from generate_series(timestamp '2024-01-01', timestamp '2024-12-31', interval 1 day) g(x)) select strftime(day,'%Y-%m-%d') as day, open, case when open then sum(open::int) over (partition by month(day) order by day) end::bigint as nth_open, coalesce(open and sum(open::int) over (partition by month(day) order by day desc) = 1, false) as month_end from d")
def business_days(spark, d):
    c = CX.business_calendar(spark, "2024-01-01", "2024-12-31")
    return c.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "open", "nth_open", "month_end")


def _context_events(spark):
    return spark.createDataFrame([(1, "DEPLOY", "error", "2024-01-05", "2024-01-05"), (2, "CAMPAIGN", None, "2024-01-10", "2024-01-12"), (3, "HOLIDAY", None, "2024-01-20", "2024-01-20"), (4, "DATA_QUALITY", "click", "2024-01-25", "2024-01-25")], "event_id int, kind string, source string, starts string, ends string").withColumns({"starts": F.to_date("starts"), "ends": F.to_date("ends")})


@query("""with c as (select distinct event_type source, ts::date lo from events), e as (select * from (values (1,'error',date '2024-01-05',date '2024-01-05',0,2,0.5),(2,null,date '2024-01-10',date '2024-01-12',1,7,2),(3,null,date '2024-01-20',date '2024-01-20',2,2,1),(4,'click',date '2024-01-25',date '2024-01-25',0,3,1)) t(id,src,s,f,lead,lag,hl)),
m as (select c.source||'@'||strftime(lo,'%Y-%m-%d') as candidate_id, id event_id, case when s <= lo and f >= lo then 1.0 when lo > f and lo - f <= lag then pow(0.5,(lo-f)/hl) when s > lo and s - lo <= lead then pow(0.5,(s-lo)/hl) else 0 end t from c join e on src is null or src = c.source)
select candidate_id, event_id, round(t, 6) as temporal from m where t > 0""")
def scope_range_match(spark, d):
    c = T(spark, d, "events").select(F.col("event_type").alias("source"), F.to_date("ts").alias("lo")).distinct()
    c = c.select(F.concat_ws("@", "source", F.date_format("lo", "yyyy-MM-dd")).alias("candidate_id"), "source", "lo", F.col("lo").alias("hi"))
    return CX.match_events(c, _context_events(spark)).select("candidate_id", "event_id", F.round("temporal", 6).alias("temporal"))


@query("with h as (select event_type k, user_id % 3 f, user_id % 2 s, (value > 50)::int x from events), k as (select k, (sum(x)+2.0)/(count(*)+4) e from h group by 1), f as (select h.k, f, (sum(x)+4*any_value(e))/(count(*)+4) e2 from h join k on k.k=h.k group by 1,2) select h.k as kind, h.f as family, s as source, round((sum(x)+4*any_value(e2))/(count(*)+4), 6) as prior from h join f on f.k=h.k and f.f=h.f group by 1,2,3")
def shrunk_priors(spark, d):
    h = T(spark, d, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 3).alias("family"), (F.col("user_id") % 2).alias("source"), (F.col("value") > 50).cast("int").alias("explained"))
    return CX.shrunk_priors(h).withColumn("prior", F.round("prior", 6))


@query("select * from (values (1,'INCONSISTENT'),(2,'UNTESTABLE'),(3,'CONTRADICTED'),(4,'SUPPORTED')) t(id, verdict)")
def counterfactual_peers(spark, d):
    p = spark.createDataFrame([(1, 8, 1, 5, 0), (2, 4, 3, 2, 0), (3, 4, 3, 10, 6), (4, 4, 4, 10, 1)], "id int, touched int, touched_moved int, untouched int, untouched_moved int")
    return CX.counterfactual(p).select("id", "verdict")


@query("select * from (values ('a',2,0.9::double,true),('b',3,0.3::double,false)) t(candidate_id, event_id, strength, explained)")
def context_routing(spark, d):
    m = spark.createDataFrame([("a", 1, 0.4), ("a", 2, 0.9), ("b", 3, 0.3)], "candidate_id string, event_id int, s double")
    return CX.route(m, "candidate_id", "s")


# -- evaluation ------------------------------------------------------------------------------------------


def scored(spark, d):
    """labels with a deterministic score in (0, 1): a squashed text length."""
    return T(spark, d, "labels").join(T(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id").withColumn("s", F.round(F.col("n_chars") / (F.col("n_chars") + 1500), 6))


_SC = "(select l.doc_id, quality, lang, round(n_chars / (n_chars + 1500), 6) s from labels l join documents d on l.doc_id = d.doc_id)"
_RK = f"(select *, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 r from {_SC})"


@query(f"select count(*) as n, sum(quality)::bigint as positives, round((sum(case when quality=1 then r end) - sum(quality)*(sum(quality)+1)/2) / (sum(quality)*(count(*)-sum(quality))), 6) as auc from {_RK}")
def roc_auc(spark, d):
    return EV.roc_auc(scored(spark, d), "quality", "s").withColumn("auc", F.round("auc", 6))


@query(f"select round(sum(case when quality=1 then c/k end)/sum(quality), 6) as average_precision from (select quality, sum(quality) over (order by s desc, doc_id) c, row_number() over (order by s desc, doc_id) k from {_SC})")
def average_precision(spark, d):
    return EV.average_precision(scored(spark, d), "quality", "s", "doc_id").withColumn("average_precision", F.round("average_precision", 6))


@query(f"with r as (select quality, row_number() over (order by s desc, doc_id) k from {_SC}) select t.k::int as k, round(avg(quality), 6) as precision, round(sum(quality) / (select sum(quality) from r), 6) as recall from r join (values (10),(25),(50)) t(k) on r.k <= t.k group by 1")
def precision_recall_at_k(spark, d):
    return EV.at_k(scored(spark, d), "quality", "s", "doc_id", [10, 25, 50]).select("k", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"select round(avg(pow(s - quality, 2)), 6) as brier, round(avg(quality), 6) as positive_rate from {_SC}")
def brier(spark, d):
    return EV.brier(scored(spark, d), "quality", "s").select(F.round("brier", 6).alias("brier"), F.round("positive_rate", 6).alias("positive_rate"))


@query(f"select round(sum(n*abs(c-y))/sum(n), 6) as ece from (select count(*) n, avg(s) c, avg(quality) y from {_SC} group by least(floor(s*10), 9))")
def ece(spark, d):
    return EV.ece(scored(spark, d), "quality", "s").withColumn("ece", F.round("ece", 6))


@query(f"with r as (select *, rank() over (partition by lang order by s) + (count(*) over (partition by lang, s) - 1) / 2.0 r from {_SC}) select lang, count(*) as n, case when count(*) >= 20 then round((sum(case when quality=1 then r end) - sum(quality)*(sum(quality)+1)/2) / nullif(sum(quality)*(count(*)-sum(quality)), 0), 6) end as auc from r group by 1")
def auc_by_segment(spark, d):
    return EV.sliced_auc(scored(spark, d), "quality", "s", "lang").select("lang", "n", F.round("auc", 6).alias("auc"))


@query("select true as holds")
def bootstrap_interval(spark, d):
    b = EV.bootstrap_auc(scored(spark, d), "quality", "s", "doc_id", 100)
    a = EV.roc_auc(scored(spark, d), "quality", "s")
    return b.crossJoin(a).select(((F.col("low") <= F.col("auc")) & (F.col("auc") <= F.col("high"))).alias("holds"))


_A = "(select s_suppkey id, row_number() over (order by s_acctbal desc, s_suppkey) r from supplier)"
_B = "(select s_suppkey id, row_number() over (order by s_nationkey, s_suppkey) r from supplier)"


@query(f"select id as s_suppkey, a.r as old_rank, b.r as new_rank, case when a.r is null then 'gained' when b.r is null then 'lost' when a.r <> b.r then 'moved' else 'same' end as change from (select * from {_A} where r <= 5) a full join (select * from {_B} where r <= 5) b using (id)")
def champion_challenger(spark, d):
    s = T(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    rank = lambda *o: s.orderBy(*o).limit(5).withColumn("rank", F.row_number().over(Window.orderBy(*o))).select("s_suppkey", "rank")
    return EV.champion_challenger(rank(F.desc("s_acctbal"), "s_suppkey"), rank("s_nationkey", "s_suppkey"), "s_suppkey")


@query("select user_id, count(distinct ts::date) as steps, strftime(min(ts::date), '%Y-%m-%d') as first_surfaced, max(value) as best_score from events where value > 80 group by 1")
def recurrence(spark, d):
    e = T(spark, d, "events").where("value > 80").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return EV.recurrence(e, "user_id", "day", "value")


@query("with f as (select c_custkey fp, row_number() over (order by c_acctbal desc, c_custkey) r from customer), t as (select c_custkey fp, 1 o from customer where c_nationkey < 8), j as (select f.*, o from f left join t using (fp)) select round(avg((o is not null)::int) filter (r <= 10), 6) as precision_at_10, round(avg((o is not null)::int) filter (r <= 50), 6) as precision_at_50, count(distinct fp) filter (o is not null) as distinct_found from j")
def discovery_score(spark, d):
    c = T(spark, d, "customer")
    f = EV.ranked(c.select(F.col("c_custkey").alias("fingerprint"), "c_acctbal"), "c_acctbal", "fingerprint").withColumn("surfaced", F.lit(3))
    t = c.where("c_nationkey < 8").select(F.col("c_custkey").alias("fingerprint"), F.lit(1).alias("onset"))
    s = EV.discovery_score(f, t)
    return s.select(F.round("precision_at_10", 6).alias("precision_at_10"), F.round("precision_at_50", 6).alias("precision_at_50"), "distinct_found")


@query("select conv_id, turn, 'text' as column, 'the' as value from conversations where contains(text, 'the')")
def leak_audit(spark, d):
    return EV.leaks(T(spark, d, "conversations").select("conv_id", "turn", "text"), ["text"], ["the"]).drop("text")


@query("with m as (select o_custkey c, o_orderdate d, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) i from orders) select c as o_custkey, i as step, count(*) over (partition by c order by i) as visible from m")
def as_of_replay(spark, d):
    """Every step sees its own history only: one pass with trailing windows."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return T(spark, d, "orders").select("o_custkey", F.row_number().over(w).alias("step"), F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("visible"))


# -- disclosure ---------------------------------------------------------------------------------------------


@query("select * from (select c_mktsegment, count(*) as n, case when count(*) >= 20 then round(avg(c_acctbal), 4) end as mean, count(*) < 20 as suppressed from customer group by 1)")
def small_cell_suppress(spark, d):
    a = T(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
    return DC.suppress_small(a, "n", ["mean"])


@query("select c_mktsegment, c_nationkey, count(*) as n from customer group by grouping sets ((c_mktsegment, c_nationkey), (c_mktsegment), ()) having count(*) >= 20")
def generalise_to_k(spark, d):
    return DC.generalise_to_k(T(spark, d, "customer"), ["c_mktsegment", "c_nationkey"]).drop("gid")


@query("with b as (select c_mktsegment, c_nationkey, count(*) n from customer group by 1,2), t as (select *, sum(n) over (partition by c_mktsegment) s, sum(n) over () a from b) select c_mktsegment, c_nationkey, n, case when n >= 20 then 2 when s >= 20 then 1 when a >= 20 then 0 end as kept, (case when n >= 20 then n when s >= 20 then s when a >= 20 then a end)::bigint as cell from t")
def finest_generalisation(spark, d):
    return DC.finest_group(T(spark, d, "customer"), ["c_mktsegment", "c_nationkey"])


@query("with p as (select 'c_mktsegment' c, count(distinct c_mktsegment) d, count(*) r from customer union all select 'c_nationkey', count(distinct c_nationkey), count(*) from customer union all select 'c_custkey', count(distinct c_custkey), count(*) from customer), two as (select a.c||'+'||b.c as columns, a.d*b.d s, a.r from p a join p b on a.c < b.c), three as (select a.c||'+'||b.c||'+'||c.c, a.d*b.d*c.d, a.r from p a join p b on a.c < b.c join p c on b.c < c.c) select columns, round(r/least(r,s), 6) as mean_cell, r/least(r,s) < 20 as risky from (select * from two union all select * from three)")
def quasi_identifiers(spark, d):
    c = T(spark, d, "customer").agg(*(F.count_distinct(x).alias(x) for x in ("c_mktsegment", "c_nationkey", "c_custkey")), F.count(F.lit(1)).alias("rows"))
    p = c.select("rows", F.inline(F.array(*(F.struct(F.lit(x).alias("column"), F.col(x).alias("ndv")) for x in ("c_mktsegment", "c_nationkey", "c_custkey")))))
    return DC.quasi_identifiers(p).withColumn("mean_cell", F.round("mean_cell", 6))


@query("select p_partkey, floor(p_retailprice/50)*50 as bucket from part")
def bucket_numeric(spark, d):
    return T(spark, d, "part").select("p_partkey", X.bucket("p_retailprice", 50).cast("double").alias("bucket"))


@query("select c_custkey, case when c_acctbal = 0 then '0' else (case when c_acctbal < 0 then '-' else '' end) || '1e' || floor(log10(abs(c_acctbal)))::int::varchar end as band from customer")
def magnitude_band(spark, d):
    return T(spark, d, "customer").select("c_custkey", X.magnitude_band("c_acctbal").alias("band"))


@query("select o_orderkey, strftime(o_orderdate,'%Y') || '-Q' || quarter(o_orderdate) as q, strftime(o_orderdate, '%Y-%m') as m from orders")
def date_generalise(spark, d):
    return T(spark, d, "orders").select("o_orderkey", X.date_bucket("o_orderdate", "quarter").alias("q"), X.date_bucket("o_orderdate", "month").alias("m"))


@query("with f as (select o_custkey, min(o_orderkey) m from orders group by 1), n as (select o_custkey, 'CUST_' || row_number() over (order by m, o_custkey) token from f) select o_orderkey, token from orders join n using (o_custkey)")
def tokenise_dense_rank(spark, d):
    return DC.tokenise(T(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", "CUST").select("o_orderkey", "token")


@query("select * from (values (2, 1, 5::bigint)) t(release_id, against, gap)")
def differencing_conflicts(spark, d):
    r = spark.createDataFrame([(1, "s", ["a"], 100), (2, "s", ["a", "b"], 95), (3, "s", ["a", "c"], 60), (4, "t", ["a", "b"], 99), (5, "s", [], 400)], "release_id int, scope string, predicates array<string>, n long")
    return DC.differencing_conflicts(r)


@query("select * from (values ('c_name','DIRECT_IDENTIFIER'),('c_acctbal','SENSITIVE'),('c_mktsegment','NONE'),('user_id','INDIRECT_IDENTIFIER'),('birth_date','QUASI_IDENTIFIER')) t(name, pii_class)")
def name_rules(spark, d):
    c = spark.createDataFrame([(x,) for x in ("c_name", "c_acctbal", "c_mktsegment", "user_id", "birth_date")], "name string")
    return c.select("name", DC.name_class("name").alias("pii_class"))


@query(r"select round(avg(regexp_full_match(o_orderstatus, '[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}')::int), 6) as person_name, round(avg(regexp_full_match(strftime(o_orderdate,'%Y-%m-%d'), '[0-9]{4}-[0-9]{2}-[0-9]{2}')::int), 6) as iso_date from orders")
def pii_format_support(spark, d):
    o = T(spark, d, "orders").select("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    f = DC.format_support(o, ["o_orderstatus", "day"])
    return f.agg(F.round(F.max(F.when((F.col("column") == "o_orderstatus") & (F.col("format") == "person_name"), F.col("support"))), 6).alias("person_name"), F.round(F.max(F.when((F.col("column") == "day") & (F.col("format") == "iso_date"), F.col("support"))), 6).alias("iso_date"))


@query("select * from (values ('4111 1111 1111 1111', true),('4111 1111 1111 1112', false)) t(v, ok)")
def luhn_cards(spark, d):
    v = spark.createDataFrame([("4111 1111 1111 1111",), ("4111 1111 1111 1112",)], "v string")
    return v.select("v", X.matches_format("v", "card").alias("ok"))


@query("select * from (values ('GB82WEST12345698765432', true),('GB82WEST12345698765433', false)) t(v, ok)")
def iban_mod97(spark, d):
    v = spark.createDataFrame([("GB82WEST12345698765432",), ("GB82WEST12345698765433",)], "v string")
    return v.select("v", X.iban_ok("v").alias("ok"))


@query("select c_custkey, round(length(regexp_replace(c_name,'[^0-9]','','g'))*3.321928094887362 + length(regexp_replace(c_name,'[^A-Za-z]','','g'))*4.700439718141092, 5) as bits from customer")
def entropy_bits(spark, d):
    return T(spark, d, "customer").select("c_custkey", F.round(X.format_bits("c_name"), 5).alias("bits"))


_FB = "max(length(regexp_replace({c},'[^0-9]','','g'))*3.321928094887362 + length(regexp_replace({c},'[^A-Za-z]','','g'))*4.700439718141092)"


@query(
    "select \"column\", n as rows, round(fb, 4) as format_bits, d as ndv, round(greatest(case when n >= 2*d then least(fb, log2(d)) else fb end, log2(d)), 4) as bits, greatest(case when n >= 2*d then least(fb, log2(d)) else fb end, log2(d)) >= 24 as enough from ("
    + " union all ".join(f"select '{c}' as \"column\", count(*) n, count(distinct {c}) d, {_FB.format(c=c)} fb from customer" for c in ("c_name", "c_mktsegment"))
    + ")"
)
def entropy_assessment(spark, d):
    return DC.entropy_assessment(T(spark, d, "customer"), ["c_name", "c_mktsegment"]).withColumn("format_bits", F.round("format_bits", 4))


@query("select * from (values ('c_name','DIRECT_IDENTIFIER'),('c_mktsegment','NONE'),('c_acctbal','SENSITIVE')) t(\"column\", pii_class)")
def pii_classes(spark, d):
    return DC.propose_classes(T(spark, d, "customer"), ["c_name", "c_mktsegment", "c_acctbal"])


@query("select c_custkey, null::varchar as c_mktsegment, floor(c_acctbal/1000)*1000 as c_acctbal, rpad(left(c_name, 4), length(c_name)::int, '*') as c_name from customer")
def redaction_actions(spark, d):
    c = T(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_name")
    return DC.redact(c, {"c_mktsegment": ("SUPPRESS",), "c_acctbal": ("BUCKET", 1000), "c_name": ("GENERALISE", 4), "c_custkey": ("ALLOW",)}).withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


@query("select 'f7bc83f430538424b13298e6aa6fb143' as h")
def keyed_hash(spark, d):
    """The published HMAC-SHA256 example (first half)."""
    v = spark.createDataFrame([("The quick brown fox jumps over the lazy dog",)], "v string")
    return v.select(F.substring(X.keyed_hash("v", b"key"), 3, 32).alias("h"))


@query("select true as centred, true as spread")
def laplace_counts(spark, d):
    u = spark.range(4000).select(DC.laplace_count(F.lit(100.0), 0.5, X.hash_uniform(5, "id")).alias("n"))
    return u.agg((F.abs(F.avg("n") - 100) < 0.3).alias("centred"), (F.abs(F.stddev("n") - 2.83) < 0.4).alias("spread"))


@query(r"select doc_id, 'email' as format from documents where regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')")
def backstop_scan(spark, d):
    b = DC.backstop(T(spark, d, "documents").select("doc_id", "text"), ["text"])
    return b.where("format = 'email'").select("doc_id", "format")


# -- scalars ----------------------------------------------------------------------------------------------------


@query("select n_name, round(list_reduce(list_prepend(0, list_transform(range(1, 1 + least(length(n_name), length(r_name))::int), lambda i: (n_name[i] = r_name[i])::int)), lambda a, b: a + b) / greatest(length(n_name), length(r_name)), 6) >= 0 as ok from nation join region on n_regionkey = r_regionkey")
def prefix_similarity(spark, d):
    j = T(spark, d, "nation").join(T(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("n_name", (F.round(X.prefix_similarity("n_name", "r_name"), 6) >= 0).alias("ok"))


@query("select event_id, floor((epoch_us(ts) - 1704067200000000)/3600000000)::bigint as w from events")
def window_index(spark, d):
    return T(spark, d, "events").select("event_id", X.window_index("ts", 1_704_067_200_000_000, 3_600_000_000).alias("w"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m') as m, strftime((date_trunc('month', o_orderdate) + interval 1 month)::date, '%Y-%m-%d') as ends from orders")
def period_keys(spark, d):
    return T(spark, d, "orders").select("o_orderkey", X.period_key("o_orderdate", "month").alias("m"), F.date_format(X.period_end("o_orderdate", "month"), "yyyy-MM-dd").alias("ends"))


@query("select p_partkey, strftime(timestamp '2020-01-01' + to_hours(p_size::bigint), '%Y-%m-%d %H') as t, strftime(date '2024-01-01' - (30 * p_size)::int, '%Y-%m-%d') as s from part")
def offsets_to_time(spark, d):
    return T(spark, d, "part").select("p_partkey", F.date_format(X.from_offset("2020-01-01", "p_size", "h"), "yyyy-MM-dd HH").alias("t"), F.date_format(X.tenure_start("2024-01-01", "p_size"), "yyyy-MM-dd").alias("s"))


@query("select event_id, round(pow(0.5, greatest(0, (31 - day(ts)))/3.0), 6) as w from events")
def half_life_decay(spark, d):
    from ..functions.kernels import half_life

    return T(spark, d, "events").select("event_id", F.round(half_life((31 - F.dayofmonth("ts")).cast("double"), 3.0), 6).alias("w"))


@query("select c_custkey, case lower(trim(c_mktsegment)) when 'building' then 'B' when 'machinery' then 'M' else 'OTHER' end as c from customer")
def map_category(spark, d):
    return T(spark, d, "customer").select("c_custkey", X.map_category("c_mktsegment", {"building": "B", "machinery": "M"}).alias("c"))


@query("select doc_id, sha256(text) as h from documents")
def content_digest(spark, d):
    return T(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query()
def feature_hash_embedding(spark, d):
    return T(spark, d, "customer").select("c_custkey", X.feature_hash(F.split("c_name", "#")).alias("v")).select("c_custkey", F.round(X.dot("v", "v"), 6).alias("norm"))


# -- sources and streams ------------------------------------------------------------------------------------------


@query("select country, count(*) > 0 as some from (values ('PT'),('US'),('GB')) t(country) group by 1")
def synthetic_source(spark, d):
    cols = [R.SyntheticColumn("country", "categorical", ("US", "GB", "PT"), weights=(0.6, 0.2, 0.2)), R.SyntheticColumn("amount", "lognormal", mean=3.2, sigma=0.7, null_fraction=0.1)]
    return R.synthetic(spark, cols, 2000).groupBy("country").agg((F.count(F.lit(1)) > 0).alias("some"))


@query("select sum(i)::bigint as ids, count(*) as n from range(400) t(i)")
def plugin_source(spark, d):
    from ..sources.paged import PagedOrders

    spark.dataSource.register(PagedOrders)
    return spark.read.format("paged_orders").option("pages", 4).option("size", 100).load().agg(F.sum("order_id").alias("ids"), F.count(F.lit(1)).alias("n"))


_COMMITS = [(1, None, "append", "2024-01-01"), (2, 1, "append", "2024-01-02"), (3, 2, "replace", "2024-01-03"), (4, 3, "append", "2024-01-04"), (5, 4, "overwrite", "2024-01-05")]


def _commits(spark):
    return spark.createDataFrame(_COMMITS, "snapshot_id int, parent_id int, operation string, committed_at string")


@query("select 3 as snapshot_id")
def snapshot_as_of(spark, d):
    return R.as_of(_commits(spark), F.lit("2024-01-03"))


@query("select * from (values (4,3,'append',0),(3,2,'replace',1)) t(snapshot_id, parent_id, operation, hops)")
def snapshot_delta(spark, d):
    return R.chain(spark, _commits(spark), 4, 2)


@query("select * from (values ('1-2','ADDITIVE'),('2-3','NO_LOGICAL_CHANGE'),('1-4','NON_ADDITIVE'),('4-5','NON_ADDITIVE')) t(span, kind)")
def delta_kinds(spark, d):
    c = _commits(spark)
    rows = [(f"{a}-{b}", R.classify_delta(R.chain(spark, c, b, a), a)) for a, b in ((1, 2), (2, 3), (1, 4), (4, 5))]
    return spark.createDataFrame(rows, "span string, kind string")


@query("select * from (values (-0.5::double, 500.0::double), (20.0, 20.0)) t(n_distinct, ndv)")
def catalog_ndv(spark, d):
    v = spark.createDataFrame([(-0.5,), (20.0,)], "n_distinct double")
    return v.select("n_distinct", R.catalog_ndv(F.col("n_distinct"), F.lit(1000)).alias("ndv"))


@query("select strftime(o_orderdate, '%Y-%m') as period, count(*) as n from orders group by 1")
def materialised_periods(spark, d):
    path = R.scratch(spark)
    R.materialise(T(spark, d, "orders"), F.date_format("o_orderdate", "yyyy-MM"), path, ["o_orderpriority"])
    return spark.read.parquet(path).groupBy(F.col("period").cast("string").alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, count(*) as n, round(sum(value), 4) as v from events group by 1")
def tumbling_hour(spark, d):
    w = SS.tumbling(T(spark, d, "events"), "ts", "1 hour", [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v")])
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "n", "v")


@query("select strftime(to_timestamp(w*21600)::timestamp, '%Y-%m-%d %H') as start, count(*) as n from (select ts, unnest(range(floor(epoch(ts)/21600)::bigint - 3, floor(epoch(ts)/21600)::bigint + 1)) w from events) group by 1")
def sliding_window(spark, d):
    w = SS.sliding(T(spark, d, "events"), "ts", "24 hours", "6 hours", [F.count(F.lit(1)).alias("n")])
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("start"), "n")


@query("with l as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 2 hour, true) b from events), s as (select *, sum(b::int) over (partition by user_id order by ts, event_id) k from l) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k")
def session_window(spark, d):
    w = SS.sessions(T(spark, d, "events"), "ts", "2 hours", ["user_id"], [F.count(F.lit(1)).alias("n")])
    return w.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("select event_type, count(*) as n, round(sum(value), 4) as v from events group by 1")
def stream_advance(spark, d):
    """Commits of a folder folded one by one through a stream: equal to the batch."""
    root = R.scratch(spark)
    e = T(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3, "event_id").write.parquet(f"{root}/in")
    st = SS.open_stream(spark, f"{root}/in", e.schema)
    part = lambda b: b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    SS.advance(st, part, f"{root}/store", f"{root}/ck")
    SS.advance(SS.open_stream(spark, f"{root}/in", e.schema), part, f"{root}/store", f"{root}/ck")  # nothing new
    return SS.merged(spark, f"{root}/store", lambda s: s.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 4).alias("v")))


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, count(*) as n from events group by 1")
def late_data_update(spark, d):
    """Rows that come late fall into their own window: states per window are merged."""
    e = T(spark, d, "events")
    win = lambda x: x.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    on_time, late = e.where("event_id % 10 <> 0"), e.where("event_id % 10 = 0")
    return win(on_time).unionByName(win(late)).groupBy("hour").agg(F.sum("n").alias("n"))


# -- the rest of the inventory ----------------------------------------------------------------------------------------


@query("select c_custkey, c_mktsegment, length(sha256(c_name)) = 64 as hashed from customer")
def governed_view(spark, d):
    """OPEN, OPAQUE and BLIND columns; the hash itself is held by `keyed_hash`."""
    v = DC.governed_view(T(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name", "c_acctbal"), {"c_name": "OPAQUE", "c_acctbal": "BLIND"}, b"key")
    return v.select("c_custkey", "c_mktsegment", F.col("c_name__opaque").rlike("^h_[0-9a-f]{32}$").alias("hashed"))


@query("select c_custkey, c_acctbal, round(count(*) over (partition by c_mktsegment) / count(*) over (), 6) as c_mktsegment_share, round(count(*) over (partition by c_nationkey) / count(*) over (), 6) as c_nationkey_share from customer")
def design_matrix(spark, d):
    m = FE.design_matrix(T(spark, d, "customer"), "c_custkey", ["c_acctbal"], ["c_mktsegment", "c_nationkey"])
    return m.withColumns({c: F.round(c, 6) for c in ("c_mktsegment_share", "c_nationkey_share")})


@query("select o_custkey as entity, count(*)::bigint as out_degree, 0::bigint as in_degree from orders join lineitem on o_orderkey = l_orderkey group by 1 union all select l_suppkey + 100000000, 0, count(*) from lineitem join orders on o_orderkey = l_orderkey group by 1")
def graph_feature(spark, d):
    from .q_basic import edges

    e = edges(spark, d).withColumn("t", F.col("t") + 100_000_000)
    return FE.graph_feature(e, "s", "t")


@query("select event_type, (sum(quality))::bigint as confirmed, count(*) - sum(quality)::bigint as rejected, count(*) as group_size from (select lang event_type, quality from labels join documents using (doc_id)) group by 1")
def structure_stats(spark, d):
    l = T(spark, d, "labels").join(T(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumn("no", 1 - F.col("quality"))
    return FS.structure_stats(l.withColumnRenamed("lang", "event_type"), "event_type", "quality", "no")


@query("with a as (select event_type, count(*) n from events where ts >= timestamp '2024-01-16' group by 1), b as (select event_type, count(*) n from events where ts < timestamp '2024-01-16' group by 1) select event_type, a.n as current, b.n as baseline, round(ln(a.n / b.n), 6) as log_ratio from a full join b using (event_type)")
def bundle_comparison(spark, d):
    e = T(spark, d, "events")
    h = lambda x: x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    c = FS.compare_bundles(h(e.where("ts >= timestamp_ntz'2024-01-16'")), h(e.where("ts < timestamp_ntz'2024-01-16'")), ["event_type"], "n")
    return c.withColumn("log_ratio", F.round("log_ratio", 6))


@query("select * from (values ('a','HOLIDAY'),('b','DEPLOY'),('dq:7','DATA_QUALITY')) t(event_id, kind)")
def context_sources(spark, d):
    s = CX.static_events(spark, [("a", "HOLIDAY", None, "2024-01-01", "2024-01-01")])
    w = CX.webhook_events(spark.createDataFrame([('{"id":"b","kind":"DEPLOY","start":"2024-01-02"}',), ("{}",)], "body string"), "body")
    q = CX.data_quality_events(spark.createDataFrame([(7, "x", "2024-01-03")], "candidate_id int, source string, lo string").withColumns({"lo": F.to_date("lo"), "hi": F.to_date("lo")}))
    return CX.all_events(s, w, q, s).select("event_id", "kind")


@query("select event_id, kind from (values (1,'DEPLOY'),(2,'CAMPAIGN')) t(event_id, kind)")
def context_overlap(spark, d):
    e = _context_events(spark)
    return CX.overlapping(e.unionAll(e), F.lit("2024-01-05").cast("date"), F.lit("2024-01-11").cast("date")).select("event_id", "kind")


@query("select c_custkey, upper(left(c_name, 2)) as c from customer where regexp_full_match(c_mktsegment, '[A-Za-z_][A-Za-z0-9_]{0,127}')")
def safe_identifiers(spark, d):
    return T(spark, d, "customer").where(X.safe_identifier("c_mktsegment")).select("c_custkey", F.upper(F.left("c_name", F.lit(2))).alias("c"))


@query("select * from (values ('a%40b', 'a@b'),('YWJj', 'abc'),('616263', 'abc')) t(v, hidden)")
def decoded_views(spark, d):
    v = spark.createDataFrame([("a%40b",), ("YWJj",), ("616263",)], "v string")
    return v.select("v", F.explode(F.array_except(X.decoded_views("v"), F.array("v"))).alias("hidden")).where("hidden in ('a@b', 'abc')")


@query("select * from (values ('a,b', 'a\\,b'),('[x]', '\\[x\\]')) t(v, e)")
def escape_members(spark, d):
    return spark.createDataFrame([("a,b",), ("[x]",)], "v string").select("v", X.escape_members("v").alias("e"))


@query("select * from (values ('{a,\"b\",c}', 'a|b|c')) t(v, a)")
def array_literals(spark, d):
    v = spark.createDataFrame([('{a,"b",c}',)], "v string")
    return v.select("v", F.array_join(R.parse_array_literal("v"), "|").alias("a"))


@query("select o_orderkey, round(ln(p/(1-p)), 6) as l from (select o_orderkey, greatest(least(o_totalprice/500000, 1-1e-6), 1e-6) p from orders)")
def logit_clip(spark, d):
    return T(spark, d, "orders").select("o_orderkey", F.round(X.logit(F.col("o_totalprice") / 500000), 6).alias("l"))


@query("select o_orderkey, epoch_us(o_orderdate)/1e6 as s, (o_orderdate::date - date '1970-01-01' + 719163)::double as d from orders")
def time_axes(spark, d):
    return T(spark, d, "orders").select("o_orderkey", X.time_axis("o_orderdate", "timestamp").alias("s"), X.time_axis(F.col("o_orderdate").cast("date"), "date").alias("d"))


@query("select a.event_id, count(*) as n from events a join events b on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval 30 minute group by 1")
def stream_interval_join(spark, d):
    """The batch form of the stream-stream interval join."""
    e = T(spark, d, "events")
    h = e.select("user_id", F.col("ts").alias("t2"))
    j = e.withColumn("b", F.explode(F.array(F.floor(X.micros("ts") / (1800 * FE.SECOND)), F.floor(X.micros("ts") / (1800 * FE.SECOND)) + 1)))
    k = h.withColumn("b", F.floor(X.micros("t2") / (1800 * FE.SECOND)))
    return j.join(k, ["user_id", "b"]).where("t2 > ts and t2 <= ts + interval 30 minutes").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def expert_baseline(spark, d):
    """Held-out AUC of boosted trees over a small grid, split by time."""
    o = T(spark, d, "orders").withColumn("label", (F.col("o_orderstatus") == "F").cast("int")).withColumn("m", F.month("o_orderdate"))
    s = FE.temporal_split(o, "o_orderdate", 0.3).select("label", "o_totalprice", "m", "part")
    grid = EV.fit_baseline(s.where("part = 'train'"), s.where("part = 'eval'"), ["o_totalprice", "m"], "label")
    return spark.createDataFrame([(a, b, float(c)) for a, b, c in grid], "depth int, rounds int, auc double")
