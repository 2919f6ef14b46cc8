"""Queries of the best record per statement and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import fiscal_period, number, symbol
from tidewell.llm.skyline import candidates, representatives, winners
from tidewell.session import table

STATEMENT_FIELDS = (
    "revenue", "cost_of_revenue", "gross_profit", "operating_expense", "operating_income", "interest_expense", "ebit", "net_income",
    "net_income_common_stock", "eps", "eps_diluted", "weighted_average_shares", "weighted_average_shares_diluted", "dividends_per_share",
)
ABOVE_ZERO = ("revenue", "weighted_average_shares", "weighted_average_shares_diluted")
CASE_FIELDS = ("revenue", "net_income", "eps_diluted", "weighted_average_shares", "dividends_per_share")


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_fd_fundamentals").withColumn("symbol", symbol("symbol"))


def statement_fields(names: tuple[str, ...]) -> dict[str, Column]:
    """Usable values: not null, not nan, and above zero where nothing else makes sense."""
    return {n: F.when(number(n) > 0, number(n)) if n in ABOVE_ZERO else number(n) for n in names}


def _statement_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statements(spark, sf_dir).withColumn("fiscal_period", F.coalesce(fiscal_period("fiscal_period"), F.upper(F.trim("fiscal_period")))).withColumn("period", F.lower(F.trim("period")))


def _skyline_args(names: tuple[str, ...]) -> dict:
    trusted = F.col("ingested_at").isNull() | (F.col("report_date") <= F.col("ingested_at"))
    return {
        "group": ["symbol", "fiscal_period", "period"],
        "row_id": "fund_id",
        "recency": [F.col("report_date"), F.col("ingested_at")],
        "trust": F.coalesce(trusted, F.lit(False)).cast("int"),
        "fields": statement_fields(names),
    }


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each statement told by several rows and each case field, the row that serves the field best."""
    args = _skyline_args(CASE_FIELDS)
    best = winners(candidates(_statement_groups(spark, sf_dir), **args).where("n > 1"), list(CASE_FIELDS), least_trust=1)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(f"win_{n}.row").alias("fund_id")) for n in CASE_FIELDS]))
    return best.select(each.alias("c")).select("c.field_name", "c.fund_id").where("fund_id is not null")


def p2_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per statement, each of its fields from the row that serves it best."""
    return representatives(_statement_groups(spark, sf_dir), **_skyline_args(STATEMENT_FIELDS), least_trust=1).drop("skyline_size")


QUERIES = {f.__name__: f for f in (p2_found, p2_statements)}

_SYMBOL = "upper(trim(symbol))"
_YEAR = "case when regexp_matches(fp, '(19|20)[0-9][0-9]') then regexp_extract(fp, '((19|20)[0-9][0-9])', 1) when regexp_matches(fp, '^[1-4]Q[0-9][0-9]$') then '20' || right(fp, 2) when regexp_matches(fp, '^FY[0-9][0-9]') then '20' || substr(fp, 3, 2) end"
_QUARTER = "case when regexp_matches(fp, '^[1-4]Q') then 'Q' || left(fp, 1) when regexp_matches(fp, 'Q[1-4]') then 'Q' || regexp_extract(fp, 'Q([1-4])', 1) else 'FY' end"
_FIELD_CASES = " union all ".join(
    f"""select '{n}' as field_name, fund_id from (select *, row_number() over (partition by symbol, fiscal, period order by report_date desc, ingested_at desc nulls last, fund_id desc) as k
    from g where n > 1 and trusted and {n} is not null and not isnan({n}){f' and {n} > 0' if n in ABOVE_ZERO else ''}) where k = 1"""
    for n in CASE_FIELDS
)

_GROUPS_SQL = f"""
    with n as (select *, upper(regexp_replace(fiscal_period, '[\\s _./''-]+', '', 'g')) as fp from raw_fd_fundamentals),
    g as (select * replace ({_SYMBOL} as symbol, lower(trim(period)) as period), ({_YEAR}) || '-' || ({_QUARTER}) as fiscal, coalesce(report_date <= ingested_at, ingested_at is null) as trusted,
        count(*) over (partition by {_SYMBOL}, ({_YEAR}) || '-' || ({_QUARTER}), lower(trim(period))) as n from n)"""
_BEST = ", ".join(
    f"arg_max({f}, (report_date, coalesce(ingested_at, '0001-01-01'::timestamp), fund_id)) filter (trusted and {f} is not null and not isnan({f}) and not isinf({f}){f' and {f} > 0' if f in ABOVE_ZERO else ''}) as {f}" for f in STATEMENT_FIELDS
)

ORACLES = {
    "p2_found": f"{_GROUPS_SQL} {_FIELD_CASES}",
    "p2_statements": f"""{_GROUPS_SQL} select symbol, fiscal as fiscal_period, period, count(*) as n, arg_max(fund_id, (report_date, coalesce(ingested_at, '0001-01-01'::timestamp), fund_id)) filter (trusted) as fund_id, {_BEST} from g group by symbol, fiscal, period""",
}
