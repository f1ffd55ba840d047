"""Sources and sinks of documents, ledgers, restore keys and user dictionaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.text import first_of, squash
from veilspark.operators.ledger import LEDGER, ordinal_in


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole UTF-8 files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def page_texts(pages: DataFrame, separator: str = "\n") -> DataFrame:
    """doc_id and text of pages (doc_id, page_no, text) that were extracted before; the outbound form joins them by nothing. readable() refuses documents without any text."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"]), separator)
    return pages.groupBy("doc_id").agg(joined.alias("text"))


def readable(docs: DataFrame) -> DataFrame:
    """docs; a blank text raises."""
    return docs.withColumn("text", F.when(F.trim("text") == "", F.raise_error(F.lit("a document has no text")).cast("string")).otherwise(F.col("text")))


def with_hidden(docs: DataFrame, hidden: DataFrame) -> DataFrame:
    """docs with what annotations and bookmarks (doc_id, origin, text) say after their text."""
    more = hidden.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("origin", "text"))), lambda h: h["text"]), "\n").alias("_hidden"))
    return docs.join(more, "doc_id", "left").withColumn("text", F.concat_ws("\n", "text", "_hidden")).drop("_hidden")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of a file, one on each line; blank lines and those that begin with # are left out."""
    return words(spark.read.text(path))


def words(lines: DataFrame) -> DataFrame:
    own = lines.select(F.regexp_replace("value", r"^[\s﻿]+|\s+\z", "").alias("word"))
    return own.filter((F.col("word") != "") & ~F.col("word").startswith("#")).distinct()


def ledger_json(spark: SparkSession, path: str) -> DataFrame:
    """A ledger from JSON: kind -> value -> alias, or the older value -> alias, whose kind is PERSON. Ordinals are those behind the aliases (null for aliases of another form), so no alias is issued twice."""
    return parsed_ledger(spark.read.text(path, wholetext=True))


def parsed_ledger(files: DataFrame) -> DataFrame:
    nested = F.from_json("value", "map<string,map<string,string>>")
    flat = F.from_json("value", "map<string,string>")
    is_new = F.col("value").rlike(r"(?s)^\s*\{\s*\"[^\"]*\"\s*:\s*\{")
    new = files.select("value").filter(is_new).select(F.explode(nested).alias("kind", "m")).select("kind", F.explode("m").alias("v", "alias"))
    old = files.select("value").filter(~is_new).select(F.lit("PERSON").alias("kind"), F.explode(flat).alias("v", "alias"))
    rows = new.unionByName(old)
    return rows.select("kind", squash(F.col("v")).alias("norm"), F.col("v").alias("value"), ordinal_in(F.col("kind"), F.col("alias")).alias("ordinal"), "alias")


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []


def write_ledger(ledger: DataFrame, path: str | None, name: str | None = None) -> None:
    """Adds the entries that a ledger folder lacks, as a part of their own; no earlier part is touched. Without a path, nothing is written (the ledger is of this run alone).

    name: the part's name, for a writer that may run twice and then replaces its own part.
    """
    if path is None:
        return
    spark = ledger.sparkSession
    name = name or f"part-{uuid.uuid4().hex}"
    made, held = ledger.select("kind", "norm", "value", "ordinal", "alias"), read_ledger(spark, path, but=name)
    made.join(held.select("kind", "norm"), ["kind", "norm"], "left_anti").select(made.columns).write.mode("overwrite").parquet(f"{path}/{name}")


def read_ledger(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    """All entries of a ledger folder, but for those of one part; none if the folder isn't there."""
    parts = [f"{path}/{n}" for n in _listed(spark, path) if n != but]
    return spark.read.schema(LEDGER).parquet(*parts) if parts else spark.createDataFrame([], LEDGER)


def write_masked(masked: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Masked texts alone; marks and originals stay out."""
    masked.select(id_col, "masked").write.parquet(path)


def write_key(masked: DataFrame, path: str, masked_path: str, id_col: str = "doc_id") -> None:
    """The restore key as id_col and JSON (mark -> original, type), for its owner's eyes alone; never into the folder of masked texts, nor around it."""
    a, b = (f"{p.rstrip('/')}/" for p in (path, masked_path))
    if a.startswith(b) or b.startswith(a):
        raise ValueError("the restore key needs a folder of its own")
    jvm, conf = masked.sparkSession._jvm.org.apache.hadoop.fs, masked.sparkSession._jsc.hadoopConfiguration()
    folder = jvm.Path(path)
    files = folder.getFileSystem(conf)
    if files.exists(folder) and len(_listed(masked.sparkSession, path)):
        raise ValueError("the restore key's folder isn't empty")
    # The folder is closed to others before anything is in it.
    files.mkdirs(folder)
    files.setPermission(folder, jvm.permission.FsPermission("700"))
    entries = F.map_from_entries(F.transform(first_of(F.col("marks"), "mark"), lambda m: F.struct(m["mark"], F.struct(m["original"].alias("original"), m["type"].alias("type")))))
    masked.select(id_col, F.to_json(entries).alias("key")).write.mode("append").parquet(path)
    for f in files.listStatus(folder):
        files.setPermission(f.getPath(), jvm.permission.FsPermission("600"))


def read_key(keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col and marks, from keys as written."""
    parsed = F.from_json("key", "map<string,struct<original:string,type:string>>")
    marks = F.transform(F.map_entries(parsed), lambda e: F.struct(e["key"].alias("mark"), e["value"]["original"].alias("original"), e["value"]["type"].alias("type")))
    return keys.select(id_col, marks.alias("marks"))
