"""Queries over documents: packing, mixing and residue; and those of the best record per statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import statements
from tidewell.llm.mixing import mix, rates, shares
from tidewell.llm.packing import make_plans, pack
from tidewell.llm.residue import flag_residue
from tidewell.llm.tokens import with_tokens
from tidewell.session import cut, table, widen


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's source and tokens, counted once and kept: two short columns and the id."""
    return cut(with_tokens(widen(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), "doc_id", "text", ["source"]))


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r["pack_name"]: int(r["capacity_tokens"]) for r in table(spark, sf_dir, "pack_capacities").collect()}


def p6_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in packs of each capacity."""
    return pack(_sizes(spark, sf_dir), _capacities(spark, sf_dir), row_id="doc_id")


def p6_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity the packs, their tokens, the share of their room that is used, the program's bound and the gap to it."""
    capacities, sizes = _capacities(spark, sf_dir), _sizes(spark, sf_dir)
    planned = make_plans(sizes, capacities, row_id="doc_id")
    per = pack(sizes, capacities, row_id="doc_id", planned=planned).groupBy("pack_name").agg(F.countDistinct("pack_no").alias("packs"), F.sum("tokens_used").alias("tokens"))
    rows = [(n, capacities[n], float(p.bound), int(p.packs), float(p.gap)) for n, p in planned[0].items()]
    told = spark.createDataFrame(rows, "pack_name string, capacity_tokens int, bound double, packs_from_program long, gap double")
    used = F.round(F.col("tokens") / (F.col("packs") * F.col("capacity_tokens")), 6)
    return per.join(told, "pack_name").select("pack_name", "capacity_tokens", "packs", "packs_from_program", "tokens", F.ceil(F.col("bound") - 1e-6).alias("least_packs"), F.round("gap", 6).alias("gap"), used.alias("used_share"))


def _mixed(spark: SparkSession, sf_dir: str, balanced: bool, report: bool) -> DataFrame:
    tokens = _sizes(spark, sf_dir)
    found = rates(tokens, table(spark, sf_dir, "mix_targets"))
    mixed = mix(tokens, found, row_id="doc_id", balanced=balanced)
    return shares(mixed, found) if report else mixed


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mix."""
    return _mixed(spark, sf_dir, balanced=False, report=False)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mixed(spark, sf_dir, balanced=False, report=True)


def p7_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mix, the one more copy drawn evenly over the lengths."""
    return _mixed(spark, sf_dir, balanced=True, report=False)


def p7_balanced_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source under the balanced draw."""
    return _mixed(spark, sf_dir, balanced=True, report=True)


def p8_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its marks."""
    return flag_residue(widen(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), row_id="doc_id", text="text", host="source")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are template residue, filler or error pages."""
    return p8_verdicts(spark, sf_dir).where("flagged").select("doc_id")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without these."""
    documents = table(spark, sf_dir, "documents")
    return documents.join(p8_found(spark, sf_dir), "doc_id", "left_anti")


QUERIES = {f.__name__: f for f in (p6_packs, p6_use, p7_mix, p7_shares, p7_balanced, p7_balanced_shares, p8_found, p8_verdicts, p8_clean)} | statements.QUERIES
ORACLES: dict[str, str] = dict(statements.ORACLES)
