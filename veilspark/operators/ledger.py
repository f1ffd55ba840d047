"""Pseudonym ledger: one alias for each kind and value, the same across documents and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.text import code, ordinal_of, squash
from veilspark.sources.tables import written

# How an alias of each kind reads; {} is its letter code. Kinds that aren't listed are the kind and the code.
ALIASES = {"PERSON": "{}", "ORG": "{}사", "CASE": "사건{}", "RRN": "주민번호{}", "PHONE": "전화{}", "ACCOUNT": "계좌{}", "CARD": "카드{}", "EMAIL": "이메일{}", "ADDRESS": "주소{}", "ADDR_DETAIL": "주소{}", "PASSPORT": "여권{}", "BIZNO": "사업자번호{}", "CORPNO": "법인번호{}", "DRIVER": "면허번호{}", "CAR": "차량{}"}
LEDGER = "kind string, norm string, value string, ordinal long, alias string"


def kind_of(label: Column) -> Column:
    return F.when(label == "NAME", "PERSON").otherwise(label)


def alias(kind: Column, ordinal: Column) -> Column:
    form = F.concat(kind, F.lit("{}"))
    for k, own in ALIASES.items():
        form = F.when(kind == k, own).otherwise(form)
    return F.replace(form, F.lit("{}"), code(ordinal))


def entries_of(findings: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """What findings (doc_id of any type, pos, label, value) add to a ledger: values that differ in white space alone share an alias.

    New entries follow the largest ordinal of their kind, in order of first appearance. Numbering runs in two steps: entries are
    ranked within range-partitioned pieces of their order, and pieces are offset by counts, so that no task holds a whole kind.
    """
    known = ledger if ledger is not None else findings.sparkSession.createDataFrame([], LEDGER)
    own = findings.select(kind_of(F.col("label")).alias("kind"), squash(F.col("value")).alias("norm"), "value", "doc_id", "pos")
    first = own.groupBy("kind", "norm").agg(F.min(F.struct("doc_id", "pos", "value")).alias("f"))
    fresh = first.join(known.select("kind", "norm").distinct(), ["kind", "norm"], "left_anti").select("kind", "norm", F.col("f.value").alias("value"), F.col("f.doc_id").alias("doc_id"), F.col("f.pos").alias("pos"))
    # Written, so a piece holds the same entries however often it is read.
    pieces = written(fresh.repartitionByRange("kind", "doc_id", "pos", "norm").withColumn("piece", F.spark_partition_id()), "ledger-pieces")
    inner = Window.partitionBy("kind", "piece").orderBy("doc_id", "pos", "norm")
    before = Window.partitionBy("kind").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("kind", "piece").count().select("kind", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    base = known.groupBy("kind").agg((F.max("ordinal") + 1).alias("base"))
    numbered = pieces.withColumn("own", F.row_number().over(inner) - 1).join(starts, ["kind", "piece"]).join(base, "kind", "left")
    ordinal = (F.coalesce("base", F.lit(0)) + F.col("start") + F.col("own")).cast("long")
    return numbered.select("kind", "norm", "value", ordinal.alias("ordinal"), alias(F.col("kind"), ordinal).alias("alias"))


def extend(findings: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger with entries for all findings."""
    made = entries_of(findings, ledger)
    return made if ledger is None else ledger.select("kind", "norm", "value", "ordinal", "alias").unionByName(made)


def ordinal_in(kind: Column, alias_: Column) -> Column:
    """The number behind an alias, with or without a suffix that kept it apart from a text; null if it isn't of its kind's form."""
    form = F.concat(kind, F.lit("{}"))
    for k, own in ALIASES.items():
        form = F.when(kind == k, own).otherwise(form)
    bare = F.regexp_replace(alias_, r"(?<=[A-Z])[0-9]{1,2}\z", "")
    ends = F.split(form, r"\{\}")
    fits = bare.startswith(F.get(ends, F.lit(0))) & bare.endswith(F.get(ends, F.lit(1)))
    return F.when(fits, ordinal_of(F.substr(bare, F.length(F.get(ends, F.lit(0))) + 1, F.length(bare) - F.length(form) + 2)))


def aliased(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Findings with their aliases."""
    own = findings.withColumn("kind", kind_of(F.col("label"))).withColumn("norm", squash(F.col("value")))
    return own.join(ledger.select("kind", "norm", "ordinal", "alias"), ["kind", "norm"], "left")
