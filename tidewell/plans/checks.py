"""Tables of conditions against measures, working days, fields of nested JSON, and rows for an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.base import Book
from tidewell.plans.trials import trial_moments
from tidewell.plans.trials import book as trials_book
from tidewell.session import table

book = Book()
#: measure, operator, limit, and whether a measure that breaks it rules the configuration out.
CONDITIONS = (("sharpe", ">=", 0.5, True), ("skew", ">=", -1.0, False), ("kurtosis", "<=", 30.0, True), ("n", ">=", 60.0, True))
_CONDITIONS_SQL = ", ".join(f"('{m}', '{o}', {v}::double, {str(h).lower()})" for m, o, v, h in CONDITIONS)


def meets(value: Column, operator: Column, limit: Column) -> Column:
    """Whether value stands to limit as the operator says; a value that isn't known doesn't."""
    return F.coalesce(F.when(operator == ">=", value >= limit).when(operator == "<=", value <= limit), F.lit(False))


@book.query(f"""with t as ({trials_book.oracles['trial_moments']}), l as (select config, unnest(['sharpe', 'skew', 'kurtosis', 'n']) as measure, unnest([sharpe, skew, kurtosis, n::double]) as value from t),
    c(measure, op, most, hard) as (values {_CONDITIONS_SQL}),
    r as (select config, hard, coalesce(case when op = '>=' then value >= most else value <= most end, false) as met from l join c using (measure))
    select config, count(*) as checked, count(*) filter (not met) as broken, bool_and(met or not hard) as passed from r group by config""")
def condition_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each configuration's measures against a table of conditions: one join, whatever the number of either; soft ones are counted and rule nothing out."""
    names = ("sharpe", "skew", "kurtosis", "n")
    laid = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names]))
    rows = trial_moments(spark, sf_dir).select("config", laid.alias("l")).select("config", "l.measure", "l.value")
    conditions = spark.createDataFrame(list(CONDITIONS), "measure string, op string, most double, hard boolean")
    met = rows.join(conditions, "measure").withColumn("met", meets(F.col("value"), F.col("op"), F.col("most")))
    return met.groupBy("config").agg(F.count("*").alias("checked"), F.count_if(~F.col("met")).alias("broken"), F.bool_and(F.col("met") | ~F.col("hard")).alias("passed"))


def weekdays_before(day: Column) -> Column:
    """How many Mondays to Fridays lie between Monday 1969-12-29 and day, which isn't counted."""
    days = F.datediff(day, F.lit("1969-12-29").cast("date"))
    return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(5))


@book.query("""with d as (select l_shipmode as mode, l_days as n from (select l_returnflag as l_shipmode, (select count(*) from range(0, greatest(date_diff('day', o_orderdate::date, l_shipdate::date), 0)) r(i)
    where isodow(o_orderdate::date + r.i::int) <= 5) as l_days from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate))
    select mode, count(*) as lines, sum(n)::bigint as weekdays, max(n)::bigint as most from d group by mode""")
def shipping_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays from order to shipping, the first day counted and the last one not: by arithmetic, without a calendar."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey).where("l_shipdate >= o_orderdate")
    n = weekdays_before(F.to_date("l_shipdate")) - weekdays_before(F.to_date("o_orderdate"))
    return j.select(F.col("l_returnflag").alias("mode"), n.alias("n")).groupBy("mode").agg(F.count("*").alias("lines"), F.sum("n").alias("weekdays"), F.max("n").alias("most"))


@book.query("""with e as (select event_id, event_type, '{"run": {"spec": {"k": ' || (props::json ->> 'k') || '}, "by": "' || event_type || '"}}' as doc from events)
    select doc::json -> '$.run' ->> '$.by' as by, count(*) as n, sum((doc::json ->> '$.run.spec.k')::bigint)::bigint as total, count(doc::json ->> '$.run.spec.none') as none from e group by all""")
def nested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of nested JSON by path; a path that isn't there is null."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    doc = F.concat(F.lit('{"run": {"spec": {"k": '), k, F.lit('}, "by": "'), F.col("event_type"), F.lit('"}}'))
    at = lambda p: F.get_json_object("doc", p)
    made = e.withColumn("doc", doc)
    return made.groupBy(at("$.run.by").alias("by")).agg(F.count("*").alias("n"), F.sum(at("$.run.spec.k").cast("long")).alias("total"), F.count(at("$.run.spec.none")).alias("none"))


AUDITED = 8_192


@book.query(f"""select o_orderkey, left('{{"order":' || o_orderkey || ',"customer":' || o_custkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}}', {AUDITED}) as payload,
    length('{{"order":' || o_orderkey || ',"customer":' || o_custkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}}') > {AUDITED} as is_cut from orders""")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was done as JSON of a bounded length, and whether it had to be cut."""
    doc = F.to_json(F.struct(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.substring(doc, 1, AUDITED).alias("payload"), (F.length(doc) > AUDITED).alias("is_cut"))
