"""Masking and restoring, row by row: marks, anonymous forms, one pass over all values of a document, and its inverse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.lexicon import REGIONS
from veilspark.functions.text import first_of, flexible, let, quoted, squash
from veilspark.operators.detect import exploded
from veilspark.operators.ledger import alias as alias_of
from veilspark.operators.ledger import aliased, kind_of

BOX, HIDDEN_DETAIL = "■■■■", "(OOO)"
TOKEN = r"\[\[([A-Z_]+_[0-9]{2,})\]\]"


# --- anonymous forms -------------------------------------------------------


def anonymous_name(v: Column) -> Column:
    return F.concat(F.left(v, F.lit(1)), F.repeat(F.lit("O"), F.length(v) - 1))


def anonymous_address(v: Column) -> Column:
    """The first part stays if it is a province and more follows; all else becomes circles."""
    parts = F.filter(F.split(v, r"[\t-\r\x1c-\x20\x85\p{Z}]+"), lambda p: p != "")
    hidden = F.transform(parts, lambda p, i: F.when((i == 0) & (F.size(parts) > 1) & p.isin(*REGIONS), p).otherwise(F.repeat(F.lit("O"), F.length(p))))
    return F.array_join(hidden, " ")


def replacement(label: Column, value: Column, alias: Column, mode: str) -> Column:
    """What stands for a value in output: null is total removal. mode: anon or pseudo."""
    if mode not in ("anon", "pseudo"):
        raise ValueError("mode is anon or pseudo")
    person = anonymous_name(value) if mode == "anon" else alias
    return (
        F.when(label.isin("NAME", "PERSON"), person).when(label.isin("ORG", "CASE"), alias)
        .when(label == "ADDRESS", anonymous_address(value)).when(label == "ADDR_DETAIL", HIDDEN_DETAIL)
    )


def document_replacement(repl: Column) -> Column:
    """In word-processor files, a fixed block for total removal."""
    return F.coalesce(repl, F.lit(BOX))


def bookmark_text(title: Column, targets: Column) -> Column:
    """A bookmark with all values replaced one after another; circles for total removal. targets: array of (value, repl)."""
    return F.aggregate(targets, title, lambda t, x: F.replace(t, x["value"], F.coalesce(x["repl"], F.repeat(F.lit("○"), F.length(x["value"])))))


# --- marks -----------------------------------------------------------------

MARKS = "array<struct<mark:string,original:string,type:string>>"


def token_marks(findings: Column) -> Column:
    """[[KIND_nn]] for each value, counted by kind, longest value first."""

    def numbered(own: Column) -> Column:
        kinds = F.transform(own, lambda x: x["kind"])
        return let(F.struct(own.alias("own"), F.transform(F.array_distinct(kinds), lambda k: F.struct(k.alias("kind"), F.array_position(kinds, k).alias("first"))).alias("firsts")), marked)

    def marked(x: Column) -> Column:
        # Sorted by kind, a value's number is its place after the first of its kind; there are few kinds.
        def one(f: Column, i: Column) -> Column:
            n = (i + 2 - F.get(F.filter(x["firsts"], lambda k: k["kind"] == f["kind"]), F.lit(0))["first"]).cast("string")
            number = F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)
            mark = F.struct(F.concat(F.lit("[["), f["kind"], F.lit("_"), number, F.lit("]]")).alias("mark"), f["value"].alias("original"), f["kind"].alias("type"))
            return F.struct(f["n"].alias("n"), f["pos"].alias("pos"), f["value"].alias("value"), mark.alias("m"))

        return F.transform(F.array_sort(F.transform(x["own"], one)), lambda f: f["m"])

    keyed = F.transform(findings, lambda f: F.struct(kind_of(f["label"]).alias("kind"), (-F.length(f["value"])).alias("n"), f["pos"].alias("pos"), f["value"].alias("value")))
    return let(F.array_sort(keyed), numbered)


def standalone(text: Column, mark: Column) -> Column:
    """Whether a mark stands alone: nothing alphanumeric or Hangul before it, nothing alphanumeric after it."""
    return F.regexp_like(text, _alone(mark))


def _alone(mark: Column) -> Column:
    return F.concat(F.lit("(?<![0-9A-Za-z가-힣])"), quoted(mark), F.lit("(?![0-9A-Za-z])"))


def alias_mark(text: Column, alias: Column) -> Column:
    """The alias, or with the first suffix from 2 to 99 that doesn't occur in the text; raises if there is none."""
    # One look at the text finds all suffixes that are taken; as it takes no characters, occurrences may overlap.
    taken = F.regexp_extract_all(text, F.concat(F.lit("(?<![0-9A-Za-z가-힣])(?="), quoted(alias), F.lit("([2-9]|[1-9][0-9])(?![0-9A-Za-z]))")), F.lit(1))
    free = F.array_except(F.array(*(F.lit(str(k)) for k in range(2, 100))), taken)
    mark = F.when(F.contains(text, alias) & standalone(text, alias), F.concat(alias, F.get(free, F.lit(0)))).otherwise(alias)
    return F.coalesce(mark, F.raise_error(F.concat(F.lit("no mark is free for "), alias)).cast("string"))


def collisions(text: Column, marks: Column) -> Column:
    """Marks that the source already holds."""
    return F.filter(F.transform(marks, lambda m: m["mark"]), lambda m: standalone(text, m))


# Columns of these functions' own.
_PATTERN, _EXACT, _SPACED, _DONE, _MARKS = "__veil_pattern", "__veil_exact", "__veil_spaced", "__veil_done", "__veil_marks"

# --- one pass --------------------------------------------------------------


def _replaced(text: Column, pattern: Column, stand: Callable[[Column], Column]) -> Column:
    """struct(text, n): all matches of a row's own pattern replaced in one pass, by what `stand` makes of each."""
    parts = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("w"))

    def join(x: Column) -> Column:
        out = F.array_join(F.zip_with(x["g"], x["w"], lambda g, w: F.concat(g, F.when(w.isNull(), "").otherwise(stand(w)))), "")
        return F.struct(out.alias("text"), F.size(x["w"]).alias("n"))

    return F.when(F.regexp_like(text, pattern), let(parts, join)).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))


def mask(found: DataFrame, text_col: str = "text", findings_col: str = "findings", marks_col: str | None = None) -> DataFrame:
    """found with masked, n_replaced, marks (mark, original, type), collisions and residual (originals that are still found).

    Values may be spaced in the text; a value with white space matches any white space there. Exact values are looked up before spaced
    ones, so each spelling that is a finding of its own gets its own mark. marks_col: marks to use instead of tokens.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = found.withColumn("marks", F.col(marks_col) if marks_col else token_marks(F.col(findings_col)))
    names = [c for c in out.columns if c not in ("masked", "n_replaced", "collisions", "residual")]
    out = out.withColumn(_PATTERN, F.array_join(F.transform("marks", lambda m: flexible(m["original"])), "|"))
    exact = F.map_from_entries(let(F.col("marks"), lambda ms: F.transform(ms, lambda m: F.struct(m["original"], m["mark"]))))
    spaced = F.transform("marks", lambda m: F.struct(squash(m["original"]).alias("k"), m["mark"].alias("m")))
    out = out.withColumn(_EXACT, exact).withColumn(_SPACED, spaced)
    stand = lambda w: F.coalesce(F.try_element_at(F.col(_EXACT), w), F.get(F.filter(F.col(_SPACED), lambda s: s["k"] == squash(w)), F.lit(0))["m"], w)
    none = F.struct(text.alias("text"), F.lit(0).alias("n"))
    out = out.withColumn(_DONE, F.when(F.size("marks") > 0, _replaced(text, F.col(_PATTERN), stand)).otherwise(none))
    done = F.col(_DONE)
    left = F.filter(F.transform("marks", lambda m: m["original"]), lambda v: F.regexp_like(done["text"], flexible(v)))
    return out.select(*(F.col(f"`{c}`") for c in names), F.when(F.col(text_col).isNotNull(), done["text"]).alias("masked"), done["n"].alias("n_replaced"), collisions(text, F.col("marks")).alias("collisions"), left.alias("residual"))


def restore(masked: DataFrame, masked_col: str = "masked", marks_col: str = "marks") -> DataFrame:
    """masked with restored, n_restored and unresolved (token names that no mark explains). Tokens are literal, aliases must stand alone."""
    text = F.coalesce(F.col(masked_col), F.lit(""))
    ordered = F.array_sort(F.transform(marks_col, lambda m: F.struct((-F.length(m["mark"])).alias("n"), m["mark"].alias("mark"))))
    pattern = F.array_join(F.transform(ordered, lambda m: F.when(m["mark"].startswith("[["), quoted(m["mark"])).otherwise(_alone(m["mark"]))), "|")
    names = [c for c in masked.columns if c not in ("restored", "n_restored", "unresolved")]
    # Spellings of one value may share an alias; the first of them comes back.
    out = masked.withColumn(_PATTERN, pattern).withColumn(_EXACT, F.map_from_entries(F.transform(first_of(F.col(marks_col), "mark"), lambda m: F.struct(m["mark"], m["original"]))))
    done = F.when(F.size(marks_col) > 0, _replaced(text, F.col(_PATTERN), lambda w: F.coalesce(F.try_element_at(F.col(_EXACT), w), w))).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))
    out, done = out.withColumn(_DONE, done), F.col(_DONE)
    unresolved = F.array_sort(F.array_distinct(F.regexp_extract_all(done["text"], F.lit(TOKEN), F.lit(1))))
    return out.select(*(F.col(f"`{c}`") for c in names), F.when(F.col(masked_col).isNotNull(), done["text"]).alias("restored"), done["n"].alias("n_restored"), unresolved.alias("unresolved"))


_OWN = "__veil_own"
_ALIASED = "array<struct<label:string,value:string,pos:int,alias:string>>"


def _with_aliases(found: DataFrame, aliases: DataFrame | None, id_col: str, findings_col: str) -> DataFrame:
    """found with an array of (label, value, pos, alias): from a ledger, which is joined to findings and not to texts, or of the document alone."""
    if aliases is None:
        local = lambda fs: F.transform(fs, lambda f: F.struct(f["label"].alias("label"), f["value"].alias("value"), f["pos"].alias("pos"), alias_of(kind_of(f["label"]), _ordinal(fs, f)).alias("alias")))
        return found.withColumn(_OWN, let(F.col(findings_col), local))
    listed = aliased(exploded(found, id_col, findings_col), aliases)
    lists = listed.groupBy(id_col).agg(F.collect_list(F.struct("label", "value", "pos", "alias")).alias(_OWN))
    return found.join(lists, id_col, "left").withColumn(_OWN, F.coalesce(_OWN, F.array().cast(_ALIASED)))


def alias_marks(found: DataFrame, aliases: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", findings_col: str = "findings", marks_col: str = "alias_marks") -> DataFrame:
    """found with marks in the readable, restorable style: each value's alias, with a suffix where the text already holds it. For mask(..., marks_col=...).

    aliases: a ledger that has an entry for each value; without one, aliases are of the document alone.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = _with_aliases(found, aliases, id_col, findings_col)
    longest = F.array_sort(F.transform(_OWN, lambda f: F.struct((-F.length(f["value"])).alias("n"), f["pos"].alias("pos"), f["value"].alias("value"), f["label"].alias("label"), f["alias"].alias("alias"))))
    marks = F.transform(longest, lambda f: F.struct(alias_mark(text, f["alias"]).alias("mark"), f["value"].alias("original"), kind_of(f["label"]).alias("type")))
    return out.withColumn(marks_col, marks).drop(_OWN)


def anonymise(found: DataFrame, mode: str = "anon", aliases: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", findings_col: str = "findings") -> DataFrame:
    """found with masked text in irreversible (anon) or consistent (pseudo) form; null replacements become a block. aliases: a ledger; without one, aliases are of the document alone."""
    out = _with_aliases(found, aliases, id_col, findings_col)
    longest = F.array_sort(F.transform(_OWN, lambda f: F.struct((-F.length(f["value"])).alias("n"), document_replacement(replacement(f["label"], f["value"], f["alias"], mode)).alias("mark"), f["value"].alias("original"), kind_of(f["label"]).alias("type"))))
    marks = F.transform(longest, lambda m: F.struct(m["mark"].alias("mark"), m["original"].alias("original"), m["type"].alias("type")))
    columns = [F.col(f"`{c}`") for c in found.columns if c not in ("masked", "n_replaced", "residual")]
    done = mask(out.withColumn(_MARKS, marks).drop(_OWN), text_col, findings_col, _MARKS)
    return done.select(*columns, "masked", "n_replaced", "residual")


def _ordinal(all_: Column, f: Column) -> Column:
    """The place of a value's squashed form among those of its kind."""
    same = F.array_distinct(F.transform(F.filter(all_, lambda g: kind_of(g["label"]) == kind_of(f["label"])), lambda g: squash(g["value"])))
    return F.array_position(same, squash(f["value"])) - 1


def token_map(masked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The restore key: id_col, mark, original, type. To be kept apart from masked texts."""
    return masked.select(id_col, F.inline("marks"))
