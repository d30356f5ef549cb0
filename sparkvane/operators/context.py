"""Explained-away context: calendars, matching, counterfactual peers, priors, routing."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: lead and lag days, half-life days by event type
REACH = {
    "DEPLOY": (0, 2, 0.5), "CAMPAIGN": (1, 7, 2), "HOLIDAY": (2, 2, 1), "BUSINESS": (1, 3, 1), "DATA_QUALITY": (0, 3, 1), "MARKET": (0, 3, 1), "ANNOTATION": (0, 0, 1 / 24),
}
SCOPE = {"SEGMENT": 1.0, "COLUMN": 0.9, "SOURCE": 0.8, "COARSER": 0.7, "GLOBAL": 0.6}


# -- calendars: small tables made on the driver ------------------------------------------------


def easter(year: int, orthodox: bool = False) -> date:
    if orthodox:
        a, b, c = year % 4, year % 7, year % 19
        d = (19 * c + 15) % 30
        e = (2 * a + 4 * b - d + 34) % 7
        m, day = divmod(d + e + 114, 31)
        return date(year, m, day + 1) + timedelta(days=13)
    g, century = year % 19, year // 100
    h = (century - century // 4 - (8 * century + 13) // 25 + 19 * g + 15) % 30
    i = h - h // 28 * (1 - 29 // (h + 1) * ((21 - g) // 11))
    j = (year + year // 4 + i + 2 - century + century // 4) % 7
    m = 3 + (i - j + 40) // 44
    return date(year, m, i - j + 28 - 31 * (m // 4))


def nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    """n-th (negative: from the end) weekday (Monday 0) of a month."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = (date(year + month // 12, month % 12 + 1, 1)) - timedelta(days=1)
    return last - timedelta(days=(last.weekday() - weekday) % 7 + 7 * (-n - 1))


def _fixed(m, d):
    return lambda y: date(y, m, d)


def _nth(m, w, n):
    return lambda y: nth_weekday(y, m, w, n)


def _easter(k, orthodox=False):
    return lambda y: easter(y, orthodox) + timedelta(days=k)


NEW_YEAR, CHRISTMAS = ("New Year", _fixed(1, 1)), ("Christmas", _fixed(12, 25))
GOOD_FRIDAY, EASTER_MONDAY = ("Good Friday", _easter(-2)), ("Easter Monday", _easter(1))
MAY_DAY, ASCENSION, WHIT_MONDAY = ("Labour Day", _fixed(5, 1)), ("Ascension", _easter(39)), ("Whit Monday", _easter(50))
RULES = {
    "US": [NEW_YEAR, ("MLK Day", _nth(1, 0, 3)), ("Presidents Day", _nth(2, 0, 3)), ("Memorial Day", _nth(5, 0, -1)), ("Independence Day", _fixed(7, 4)), ("Labor Day", _nth(9, 0, 1)), ("Thanksgiving", _nth(11, 3, 4)), CHRISTMAS],
    "GB": [NEW_YEAR, GOOD_FRIDAY, EASTER_MONDAY, ("Early May", _nth(5, 0, 1)), ("Spring", _nth(5, 0, -1)), ("Summer", _nth(8, 0, -1)), CHRISTMAS, ("Boxing Day", _fixed(12, 26))],
    "DE": [NEW_YEAR, GOOD_FRIDAY, EASTER_MONDAY, MAY_DAY, ASCENSION, WHIT_MONDAY, ("Unity", _fixed(10, 3)), CHRISTMAS, ("Second Christmas Day", _fixed(12, 26))],
    "FR": [NEW_YEAR, EASTER_MONDAY, MAY_DAY, ("Victory", _fixed(5, 8)), ASCENSION, WHIT_MONDAY, ("Bastille", _fixed(7, 14)), ("Assumption", _fixed(8, 15)), ("All Saints", _fixed(11, 1)), ("Armistice", _fixed(11, 11)), CHRISTMAS],
    "ES": [NEW_YEAR, ("Epiphany", _fixed(1, 6)), GOOD_FRIDAY, MAY_DAY, ("Assumption", _fixed(8, 15)), ("National Day", _fixed(10, 12)), ("All Saints", _fixed(11, 1)), ("Constitution", _fixed(12, 6)), CHRISTMAS],
    "PT": [NEW_YEAR, GOOD_FRIDAY, ("Liberty", _fixed(4, 25)), MAY_DAY, ("Portugal Day", _fixed(6, 10)), ("Assumption", _fixed(8, 15)), ("Republic", _fixed(10, 5)), ("All Saints", _fixed(11, 1)), CHRISTMAS],
    "IT": [NEW_YEAR, ("Epiphany", _fixed(1, 6)), EASTER_MONDAY, ("Liberation", _fixed(4, 25)), MAY_DAY, ("Republic", _fixed(6, 2)), ("Assumption", _fixed(8, 15)), CHRISTMAS],
    "NL": [NEW_YEAR, EASTER_MONDAY, ("Kings Day", _fixed(4, 27)), ASCENSION, WHIT_MONDAY, CHRISTMAS, ("Second Christmas Day", _fixed(12, 26))],
    "GR": [NEW_YEAR, ("Clean Monday", _easter(-48, True)), ("Orthodox Easter Monday", _easter(1, True)), MAY_DAY, ("Ohi Day", _fixed(10, 28)), CHRISTMAS],
    "CA": [NEW_YEAR, GOOD_FRIDAY, ("Canada Day", _fixed(7, 1)), ("Labour Day", _nth(9, 0, 1)), ("Thanksgiving", _nth(10, 0, 2)), CHRISTMAS],
    "AU": [NEW_YEAR, ("Australia Day", _fixed(1, 26)), GOOD_FRIDAY, EASTER_MONDAY, ("Anzac Day", _fixed(4, 25)), CHRISTMAS, ("Boxing Day", _fixed(12, 26))],
    "IN": [("Republic Day", _fixed(1, 26)), ("Independence Day", _fixed(8, 15)), ("Gandhi Jayanti", _fixed(10, 2)), CHRISTMAS],
}
_SHIFTED = {"US": (-1, 1), "GB": (2, 1), "CA": (2, 1), "AU": (2, 1)}  # Saturday, Sunday


def observed(day: date, code: str) -> date:
    sat, sun = _SHIFTED.get(code, (0, 0))
    return day + timedelta(days=sat if day.weekday() == 5 else sun if day.weekday() == 6 else 0)


def holidays(spark: SparkSession, codes: list[str], years: range) -> DataFrame:
    rows = [(c, name, rule(y), observed(rule(y), c)) for c in codes for y in years for name, rule in RULES[c]]
    return spark.createDataFrame(rows, "code string, name string, day date, observed date")


def business_calendar(spark: SparkSession, start: str, end: str, holiday_days: DataFrame | None = None, fiscal_start_month: int = 4) -> DataFrame:
    """day, open, next/previous open day, open day of the month from both ends, and markers."""
    d = spark.sql(f"select explode(sequence(date'{start}', date'{end}')) as day")
    off = F.weekday("day") >= 5
    if holiday_days is not None:
        h = holiday_days.select(F.col("observed").alias("day"), F.lit(True).alias("h")).distinct()
        d = d.join(F.broadcast(h), "day", "left").withColumn("off", off | F.coalesce("h", F.lit(False))).drop("h")
    else:
        d = d.withColumn("off", off)
    d = d.withColumn("open", ~F.col("off")).drop("off")
    here = F.when(F.col("open"), F.col("day"))
    w = Window.partitionBy().orderBy("day")  # a calendar has some thousand rows
    month = Window.partitionBy(F.trunc("day", "month")).orderBy("day")
    back = Window.partitionBy(F.trunc("day", "month")).orderBy(F.desc("day"))
    d = d.withColumns({
        "next_open": F.first(here, True).over(w.rowsBetween(1, Window.unboundedFollowing)), "previous_open": F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "nth_open": F.when(F.col("open"), F.sum(F.col("open").cast("int")).over(month)), "nth_last_open": F.when(F.col("open"), F.sum(F.col("open").cast("int")).over(back)),
    })
    last = F.col("nth_last_open") == 1
    return d.withColumns({"month_end": F.coalesce(last, F.lit(False)), "quarter_end": F.coalesce(last & (F.month("day") % 3 == 0), F.lit(False)), "fiscal_end": F.coalesce(last & (F.month("day") % 12 == (fiscal_start_month - 1) % 12), F.lit(False))})


# -- event sources: event_id, kind, source, starts, ends ------------------------------------------

EVENT = ["event_id", "kind", "source", "starts", "ends"]


def static_events(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (event_id, kind, source or None, starts, ends), dates as ISO text."""
    d = spark.createDataFrame(rows, "event_id string, kind string, source string, starts string, ends string")
    return d.withColumns({"starts": F.to_date("starts"), "ends": F.to_date("ends")})


def imported_events(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with the event columns; rows of unknown kind or without a start are left out."""
    d = spark.read.schema("event_id string, kind string, source string, starts date, ends date").csv(path, header=True)
    return d.where(F.col("kind").isin(*REACH) & F.col("starts").isNotNull()).withColumn("ends", F.coalesce("ends", "starts"))


def webhook_events(payloads: DataFrame, body: str) -> DataFrame:
    """JSON bodies of {id, kind, source, start, end}."""
    j = payloads.select(F.from_json(body, "id string, kind string, source string, start date, end date").alias("j"))
    return j.select(F.col("j.id").alias("event_id"), F.col("j.kind").alias("kind"), F.col("j.source").alias("source"), F.col("j.start").alias("starts"), F.coalesce("j.end", "j.start").alias("ends")).where("event_id is not null and starts is not null")


def holiday_events(holiday_table: DataFrame) -> DataFrame:
    return holiday_table.select(F.concat_ws(":", "code", "name", F.col("day").cast("string")).alias("event_id"), F.lit("HOLIDAY").alias("kind"), F.lit(None).cast("string").alias("source"), F.col("observed").alias("starts"), F.col("observed").alias("ends"))


def business_events(calendar: DataFrame) -> DataFrame:
    """Month, quarter and fiscal ends of a business calendar."""
    kinds = F.explode(F.array_compact(F.array(*(F.when(F.col(c), F.lit(c)) for c in ("month_end", "quarter_end", "fiscal_end"))))).alias("k")
    return calendar.select("day", kinds).select(F.concat_ws(":", "k", F.col("day").cast("string")).alias("event_id"), F.lit("BUSINESS").alias("kind"), F.lit(None).cast("string").alias("source"), F.col("day").alias("starts"), F.col("day").alias("ends"))


def data_quality_events(candidates: DataFrame) -> DataFrame:
    """Data-quality findings (candidate_id, source, lo, hi) as events of their own."""
    return candidates.select(F.concat(F.lit("dq:"), F.col("candidate_id").cast("string")).alias("event_id"), F.lit("DATA_QUALITY").alias("kind"), "source", F.col("lo").alias("starts"), F.col("hi").alias("ends"))


def all_events(*sources: DataFrame) -> DataFrame:
    out = sources[0].select(*EVENT)
    for s in sources[1:]:
        out = out.unionByName(s.select(*EVENT))
    return out.dropDuplicates(["event_id"])


# -- matching -------------------------------------------------------------------------------------


def overlapping(events: DataFrame, start, end) -> DataFrame:
    return events.where((F.col("starts") <= end) & (F.col("ends") >= start)).dropDuplicates(["event_id"])


def _reach(kind: Column, i: int) -> Column:
    return F.element_at(F.create_map(*(x for k, v in REACH.items() for x in (F.lit(k), F.lit(float(v[i]))))), kind)


def temporal(kind: Column, starts: Column, ends: Column, lo: Column, hi: Column) -> Column:
    """1 where the windows meet, else decay by the gap in days inside lead and lag, else 0."""
    after, before = F.datediff(lo, ends), F.datediff(starts, hi)
    decay = lambda gap: F.pow(F.lit(0.5), gap / _reach(kind, 2))
    return F.when((starts <= hi) & (ends >= lo), 1.0).when((after > 0) & (after <= _reach(kind, 1)), decay(after)).when((before > 0) & (before <= _reach(kind, 0)), decay(before)).otherwise(0.0)


def specificity(scope: Column, sources: Column, days: Column) -> Column:
    breadth = F.when(scope == "SEGMENT", 1.0).when(scope == "COLUMN", 0.85).when(scope == "SOURCE", 0.7).otherwise(0.3)
    return breadth / (1 + 0.5 * F.ln(sources)) / (1 + days / 30)


def match_events(candidates: DataFrame, events: DataFrame, max_reach_days: int = 7) -> DataFrame:
    """Candidate (candidate_id, source, lo, hi: dates) x event (event_id, kind, source or NULL for
    all, starts, ends) with temporal and scope scores.

    An equi-join on days: each side is spread over the (few) weeks that it may meet, so
    the range match never becomes a cross join."""
    week = lambda a, b, pad: F.explode(F.sequence(F.floor(F.unix_date(F.date_sub(a, pad)) / 7), F.floor(F.unix_date(F.date_add(b, pad)) / 7)))
    c = candidates.withColumn("__w", week(F.col("lo"), F.col("hi"), 0)).withColumnRenamed("source", "c_source")
    e = events.withColumn("__w", week(F.col("starts"), F.col("ends"), max_reach_days)).withColumnRenamed("source", "e_source")
    j = c.join(e, "__w").where(F.col("e_source").isNull() | (F.col("e_source") == F.col("c_source"))).drop("__w").dropDuplicates(["candidate_id", "event_id"])
    t = temporal(F.col("kind"), F.col("starts"), F.col("ends"), F.col("lo"), F.col("hi"))
    scope = F.when(F.col("e_source").isNull(), "GLOBAL").otherwise("SOURCE")
    tier = F.when(scope == "GLOBAL", SCOPE["GLOBAL"]).otherwise(SCOPE["SOURCE"])
    days = F.datediff("ends", "starts") + 1
    return j.withColumns({"temporal": t, "scope": scope, "tier": tier, "specificity": specificity(scope, F.lit(1), days)}).where("temporal > 0")


def counterfactual(peers: DataFrame) -> DataFrame:
    """Verdict per (candidate, event) from peer counts: touched, touched_moved, untouched, untouched_moved."""
    tr = (F.col("touched_moved") + 1) / (F.col("touched") + 1)
    ur = F.try_divide(F.col("untouched_moved"), F.col("untouched"))
    v = F.when((F.col("touched") >= 2) & (F.col("touched_moved") / F.col("touched") < 0.25), "INCONSISTENT").when(F.col("untouched") < 3, "UNTESTABLE").when(ur >= 0.5 * tr, "CONTRADICTED").otherwise("SUPPORTED")
    return peers.withColumn("verdict", v)


def explanation_strength(temporal_: Column, overlap: Column, prior: Column, spec: Column, credit: Column, contradicted: Column) -> Column:
    return temporal_ * overlap * (0.3 * prior + 0.3 * spec + 0.4 * credit) * F.when(contradicted, 0.25).otherwise(1.0)


def shrunk_priors(history: DataFrame, a: float = 4.0) -> DataFrame:
    """history: kind, family, source, explained (0/1). Rates shrunk kind -> family -> source."""
    k = history.groupBy("kind").agg(F.sum("explained").alias("k1"), F.count(F.lit(1)).alias("n1"))
    f = history.groupBy("kind", "family").agg(F.sum("explained").alias("k2"), F.count(F.lit(1)).alias("n2"))
    s = history.groupBy("kind", "family", "source").agg(F.sum("explained").alias("k3"), F.count(F.lit(1)).alias("n3"))
    j = s.join(f, ["kind", "family"]).join(k, "kind")
    e1 = (F.col("k1") + a * 0.5) / (F.col("n1") + a)
    e2 = (F.col("k2") + a * e1) / (F.col("n2") + a)
    return j.select("kind", "family", "source", ((F.col("k3") + a * e2) / (F.col("n3") + a)).alias("prior"))


def route(matches: DataFrame, ident: str, strength: str, threshold: float = 0.5) -> DataFrame:
    """Best explanation per candidate; explained from the threshold on."""
    best = F.max_by(F.struct("event_id", strength), F.struct(strength, "event_id")).alias("b")
    return matches.groupBy(ident).agg(best).select(ident, F.col("b.event_id").alias("event_id"), F.col(f"b.{strength}").alias("strength"), (F.col(f"b.{strength}") >= threshold).alias("explained"))
