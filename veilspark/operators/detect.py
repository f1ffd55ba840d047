"""Detection: rules, names and accepted hits of another recogniser, merged for each document without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.vocabulary import COMMON_WORDS
from veilspark.functions import text
from veilspark.functions.text import cuts, first_of, let, strip
from veilspark.operators.names import NAME_RULES, NER_RULE, USER_RULE, NameRule, rule_names, stands_alone
from veilspark.operators.rules import FINDINGS, RULES, Rule, checked_labels, rule_findings


def _none() -> Column:
    return F.array().cast(FINDINGS)


def contained(findings: Column) -> Column:
    """Without values that hold a digit and are a proper part of another value. Values are distinct, so such a one occurs twice in all of them."""

    def among(x: Column) -> Column:
        twice = lambda v: F.instr(F.substr(x["all"], F.instr(x["all"], v) + 1), v) > 0
        return F.filter(x["f"], lambda f: ~(f["value"].rlike("[0-9０-９]") & twice(f["value"])))

    joined = F.array_join(F.transform(findings, lambda f: f["value"]), "\x00")
    return let(F.struct(findings.alias("f"), joined.alias("all")), among)


def without_artifacts(findings: Column) -> Column:
    """Without organisations that are another one with one or two characters before it."""
    orgs = F.transform(F.filter(findings, lambda f: f["label"] == "ORG"), lambda f: f["value"])
    tail = lambda f, k: F.array_contains(orgs, F.substr(f["value"], F.lit(k + 1)))
    return F.filter(findings, lambda f: ~((f["label"] == "ORG") & (tail(f, 1) | tail(f, 2))))


#: Columns of detect()'s own begin like this; documents may not have such ones.
OWN = "__veil_"


# Expressions over the scanned text don't depend on the documents, so each is built once for a Spark application.
@lru_cache(maxsize=500)
def _cut(key: str, pattern: str, group: int, needs: str, hangul: bool) -> Column:
    return cuts(F.col(f"{OWN}scan"), pattern, group, needs, F.col(f"{OWN}{'hangul' if hangul else 'number'}"))


@lru_cache(maxsize=200)
def _ruled(key: str, rule: Rule) -> Column:
    return rule_findings(rule, F.col(f"{OWN}c{rule.no}"), F.col(f"{OWN}scan"), F.col(f"{OWN}source"))


@lru_cache(maxsize=200)
def _named(key: str, rule: NameRule, stop_words: tuple[str, ...]) -> Column:
    return rule_names(rule, F.col(f"{OWN}n{rule.no}"), F.col(f"{OWN}scan"), COMMON_WORDS + list(stop_words))


def detect(docs: DataFrame, text_col: str = "text", skip: Sequence[str] = (), extra_names: Sequence[str] = (), excluded_names: Sequence[str] = (), stop_words: Sequence[str] = (), ner_col: str | None = None, strict_containment: bool = True, out_col: str = "findings") -> DataFrame:
    """docs with an array of findings (rule_no, pos, label, value): the first label of a value wins.

    skip: labels that aren't looked for; NAME also switches off the other recogniser. extra_names are looked for as they are, excluded_names are
    never reported, stop_words are further words that aren't names. ner_col: an array of (label, value) structs from accept_hits(). strict_containment
    drops a number that is part of another. Null texts have no findings.
    """
    skip = checked_labels(skip)
    if own := [c for c in docs.columns if c.startswith(OWN)]:
        raise ValueError(f"columns that begin with {OWN} are kept for detect(): {own}")
    source, columns = F.coalesce(F.col(text_col), F.lit("")), [F.col(f"`{c}`") for c in docs.columns if c != out_col]
    docs = docs.withColumn(f"{OWN}source", source).withColumn(f"{OWN}scan", text.scan(F.col(f"{OWN}source")))
    scan, key = F.col(f"{OWN}scan"), docs.sparkSession.sparkContext.applicationId
    rules = [r for r in RULES if r.label not in skip]
    named = [] if "NAME" in skip else NAME_RULES
    # One look tells which rules a text can't fit at all.
    docs = docs.withColumns({f"{OWN}hangul": F.regexp_like(scan, F.lit("[가-힣㈜]")), f"{OWN}number": F.regexp_like(scan, F.lit("[0-9@]"))})
    # Cuts are columns of a step of their own: each pattern runs over a text once.
    docs = docs.withColumns({f"{OWN}c{r.no}": _cut(key, r.pattern, r.group, r.needs, r.hangul) for r in rules} | {f"{OWN}n{r.no}": _cut(key, r.pattern, 1, r.needs, True) for r in named})
    names = F.concat(_none(), *(_named(key, r, tuple(stop_words)) for r in named))
    if named and extra_names:
        # As they are, or with blanks between their characters.
        at = lambda n: F.regexp_instr(scan, F.lit(r"[ \t]*".join(f"\\x{{{ord(c):x}}}" for c in n if not c.isspace()))) - 1
        extra = F.array(*(F.struct(F.lit(USER_RULE).alias("rule_no"), at(n).cast("int").alias("pos"), F.lit("NAME").alias("label"), F.lit(n).alias("value")) for n in dict.fromkeys(extra_names) if n.strip()))
        names = F.concat(names, F.filter(extra, lambda f: f["pos"] >= 0))
    if excluded_names:
        names = F.filter(names, lambda f: ~f["value"].isin(*excluded_names))
    found = docs.withColumns({f"{OWN}rules": F.concat(_none(), *(_ruled(key, r) for r in rules)), f"{OWN}names": names})
    hits = _none()
    if ner_col and "NAME" not in skip:
        hits = F.transform(F.coalesce(F.col(ner_col), F.array().cast("array<struct<label:string,value:string>>")), lambda h: F.struct(F.lit(NER_RULE).alias("rule_no"), (F.instr(scan, h["value"]) - 1).cast("int").alias("pos"), h["label"].alias("label"), strip(h["value"]).alias("value")))
        hits = F.filter(hits, lambda f: ~f["label"].isin(*skip)) if skip else hits
        if excluded_names:
            hits = F.filter(hits, lambda f: ~((f["label"] == "PERSON") & f["value"].isin(*excluded_names)))
    all_ = F.col(f"{OWN}found")
    found = found.withColumn(f"{OWN}found", first_of(F.concat(f"{OWN}rules", f"{OWN}names", hits)))
    people = lambda f: f["label"].isin("NAME", "PERSON")
    found = found.withColumn(f"{OWN}found", F.filter(all_, lambda f: ~people(f) | stands_alone(scan, f["value"])))
    found = found.withColumn(f"{OWN}found", without_artifacts(all_))
    return found.select(*columns, (contained(all_) if strict_containment else all_).alias(out_col))


def exploded(found: DataFrame, id_col: str = "doc_id", findings_col: str = "findings") -> DataFrame:
    """A row for each finding: id_col, rule_no, pos, label, value. Who needs the rows more than once writes them first.

    The outer form keeps the optimizer from putting a test of the findings below, which would compute the rules twice.
    """
    return found.select(id_col, F.inline_outer(findings_col)).filter(F.col("rule_no").isNotNull())


def labels_of(findings: Column) -> Column:
    """Distinct labels, sorted."""
    return F.array_sort(F.array_distinct(F.transform(findings, lambda f: f["label"])))


def values_of(findings: Column, *labels: str) -> Column:
    """Values of some labels, sorted."""
    return F.array_sort(F.transform(F.filter(findings, lambda f: f["label"].isin(*labels)), lambda f: f["value"]))
