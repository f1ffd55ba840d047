"""Masking a stream, a ledger that grows by batch, and sinks."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from veilspark.operators import mask
from veilspark.sources import documents
from veilspark.streaming.masking import ledger_stream, masked_stream

SKIP = ["NAME", "ORG", "ADDRESS", "ADDR_DETAIL", "CASE", "CAR"]


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "메일 a@b.co"), (2, "없음")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    q = masked_stream(stream, skip=SKIP).select("doc_id", "masked", F.to_json("marks").alias("marks")).writeStream.format("memory").queryName("masked").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r.doc_id: r.masked for r in spark.table("masked").collect()} == {1: "메일 [[EMAIL_01]]", 2: "없음"}


def test_ledger_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "메일 a@b.co")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    q = ledger_stream(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/ledger", f"{tmp_path}/checkpoint")
    assert q.awaitTermination(150)
    assert [(r.kind, r.alias) for r in documents.read_ledger(spark, f"{tmp_path}/ledger").collect()] == [("EMAIL", "이메일A")]
    # Another stream over the same folder, with a checkpoint of its own, goes on after what is there.
    more = spark.createDataFrame([(2, "메일 c@d.co 와 a@b.co")], docs.schema)
    more.write.parquet(f"{tmp_path}/in2")
    q = ledger_stream(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in2"), f"{tmp_path}/ledger", f"{tmp_path}/checkpoint2")
    assert q.awaitTermination(150)
    assert {(r.value, r.alias) for r in documents.read_ledger(spark, f"{tmp_path}/ledger").collect()} == {("a@b.co", "이메일A"), ("c@d.co", "이메일B")}


def test_ledger_folder(spark, tmp_path):
    rows = spark.createDataFrame([("PERSON", "김철수", "김철수", 0, "A")], "kind string, norm string, value string, ordinal long, alias string")
    documents.write_ledger(rows, None)
    assert documents.read_ledger(spark, f"{tmp_path}/ledger").count() == 0
    for _ in range(2):  # what is there already isn't written again
        documents.write_ledger(rows, f"{tmp_path}/ledger")
    assert [r.alias for r in documents.read_ledger(spark, f"{tmp_path}/ledger").collect()] == ["A"]


def test_keys_are_kept_apart(spark, tmp_path):
    made = spark.createDataFrame([(1, "[[EMAIL_01]]", [("[[EMAIL_01]]", "a@b.co", "EMAIL")])], f"doc_id long, masked string, marks {mask.MARKS}")
    with pytest.raises(ValueError):
        documents.write_key(made, f"{tmp_path}/out/key", f"{tmp_path}/out")
    documents.write_masked(made, f"{tmp_path}/out")
    documents.write_key(made, f"{tmp_path}/key", f"{tmp_path}/out")
    assert os.stat(f"{tmp_path}/key").st_mode & 0o77 == 0 and all(os.stat(f).st_mode & 0o177 == 0 for f in glob.glob(f"{tmp_path}/key/*"))
    with pytest.raises(ValueError):
        documents.write_key(made, f"{tmp_path}/key", f"{tmp_path}/out")
    keys = documents.read_key(spark.read.parquet(f"{tmp_path}/key"))
    back = mask.restore(spark.read.parquet(f"{tmp_path}/out").join(keys, "doc_id"))
    assert back.first().restored == "a@b.co"
