"""Independent verification of outputs: number-like shapes that are still there, and a report with an exit code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import fold_digits, peek

_S = r"[ \t]*"
# Shapes by name, as patterns.
SHAPES = {
    "rrn": rf"(?<![0-9])[0-9]{{6}}{_S}[-–—]{_S}[1-8](?:{_S}[0-9]){{6}}(?![0-9])",
    "case": r"(?<![0-9])[0-9]{4}[ \t]*[가-힣]{1,3}[ \t]*[0-9]{2,6}(?![0-9])",
    "phone": r"(?<![0-9])0[0-9]{1,2}[- ][0-9]{3,4}[- ][0-9]{4}(?![0-9])",
    "number": r"(?<![0-9A-Za-z-])[0-9]{2,7}(?:[- ][0-9]{2,7}){2,3}(?![0-9A-Za-z-])",
}


def hits(text: Column, shape: str) -> Column:
    return F.regexp_extract_all(fold_digits(F.coalesce(text, F.lit(""))), F.lit(SHAPES[shape]), F.lit(0))


def scan_shapes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, shape, hits and a sample of the first three, peeked; rows with hits only."""
    listed = F.array(*(F.struct(F.lit(s).alias("shape"), hits(F.col(text_col), s).alias("found")) for s in SHAPES))
    rows = docs.select(id_col, F.inline(listed)).filter(F.size("found") > 0)
    sample = F.array_join(F.transform(F.slice("found", 1, 3), lambda v: peek(v)), ", ")
    return rows.select(id_col, "shape", F.size("found").cast("long").alias("hits"), sample.alias("sample"))


def exit_code(unmapped: Column, residual: Column, warnings: Column) -> Column:
    """1 if anything is left or wasn't mapped, 2 for warnings alone, else 0; nulls count as empty."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return F.when(F.greatest(n(unmapped), F.lit(0)) + F.greatest(n(residual), F.lit(0)) > 0, 1).when(n(warnings) > 0, 2).otherwise(0)


def report(masked: DataFrame, id_col: str = "doc_id", masked_col: str = "masked", findings_col: str = "findings", unmapped_col: str | None = None, recogniser: bool = False) -> DataFrame:
    """One row a document: targets, labels, persons, orgs, unmapped, residual, warnings, engine (whether another recogniser's hits were used) and exit code.

    unmapped_col: values that no place was found for, as box and package masking give them. Warnings: shapes that are left, with a sample, and
    that detection ran on rules alone.
    """
    from veilspark.operators.detect import labels_of, values_of

    left = [(s, hits(F.col(masked_col), s)) for s in SHAPES]
    sample = lambda found: F.array_join(F.transform(F.slice(found, 1, 3), lambda v: peek(v)), ", ")
    warn = [F.when(F.size(h) > 0, F.concat(F.lit(f"{s}: "), F.size(h).cast("string"), F.lit(": "), sample(h))) for s, h in left]
    if not recogniser:
        warn.append(F.lit("rules alone: names without any context aren't looked for"))
    f = F.col(findings_col)
    unmapped = F.coalesce(F.col(unmapped_col), F.array().cast("array<string>")) if unmapped_col else F.array().cast("array<string>")
    base = masked.select(id_col, F.size(f).alias("targets"), labels_of(f).alias("by_label"), values_of(f, "NAME", "PERSON").alias("persons"), values_of(f, "ORG").alias("orgs"), unmapped.alias("unmapped"), F.col("residual"), F.array_compact(F.array(*warn)).alias("warnings"), F.struct(F.lit(recogniser).alias("recogniser")).alias("engine"))
    return base.withColumn("exit_code", exit_code(F.col("unmapped"), F.col("residual"), F.col("warnings")))
