"""Which hits of another recogniser are taken. Without one, detection simply has no such column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.lexicon import COMPOUND_SURNAMES, any_of

LEAST_CONFIDENCE, PERSON_CONFIDENCE, MOST_REPEATS = 0.6, 0.75, 6


def usable(hits: DataFrame) -> DataFrame:
    """Persons and addresses of at least two characters on one line, with enough confidence."""
    return hits.filter(F.col("label").isin("PERSON", "ADDRESS") & (F.length("value") >= 2) & (F.col("confidence") >= LEAST_CONFIDENCE) & ~F.col("value").rlike(r"[\x00-\x1f\x7f]"))


def accept_hits(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `ner`: accepted (label, value) structs. hits: id_col, label, start, end, confidence, evidence (array of strings).

    A person needs a hit with evidence of surname and last syllable, three characters (four only with a compound surname) and confidence; one
    that occurs often without any title, field or neighbouring number isn't taken.
    """
    texts = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text"))
    own = hits.join(texts, id_col).withColumn("value", F.regexp_replace(F.expr("substr(_text, start + 1, end - start)"), r"^\s+|\s+\z", ""))
    own = usable(own)
    starts = lambda p: F.exists("evidence", lambda e: e.startswith(p))
    sure = starts("pos:surname") & starts("pos:name_final_syllable") & (F.length("value") >= 3) & (F.col("confidence") >= PERSON_CONFIDENCE) & ((F.length("value") < 4) | F.col("value").rlike(f"^{any_of(COMPOUND_SURNAMES)}"))
    context = starts("pos:title") | starts("pos:field_label") | starts("pos:deterministic_pii_nearby")
    votes = own.groupBy(id_col, "label", "value").agg(F.bool_or(sure).alias("sure"), F.bool_or(context).alias("context"), F.min("start").alias("start"), F.first("_text").alias("_text"))
    repeats = F.expr("(length(_text) - length(replace(_text, value, ''))) / length(value)")
    taken = votes.filter((F.col("label") == "ADDRESS") | (F.col("sure") & (F.col("context") | (repeats < MOST_REPEATS))))
    lists = taken.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "label", "value"))), lambda h: F.struct(h["label"].alias("label"), h["value"].alias("value"))).alias("ner"))
    return docs.join(lists, id_col, "left")
