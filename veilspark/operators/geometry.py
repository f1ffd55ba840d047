"""Page geometry: where values lie on a page of words, and which boxes take them away.

Words are rows (doc_id, page_no, word_no, x0, y0, x1, y1, word). Search and expansion are joins on (doc_id, page_no) with range conditions; the
two greedy folds, stitching and merging, run over the sorted array of a page's boxes (a page bounds the group).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.text import let, squash
from veilspark.operators.mask import bookmark_text
from veilspark.operators.names import stands_alone

PAGE = ["doc_id", "page_no"]
MARGIN, COVERED, LINE, GAP, OVERLAP = 1.0, 0.5, 0.6, 12.0, 0.5


def fragments(value: Column) -> Column:
    """What to search for: the value's lines that are long enough (two characters, four if only digits), each also without white space; else the whole."""
    parts = F.filter(F.transform(F.split(value, r"\n"), lambda p: F.trim(p)), lambda p: (F.length(p) >= 2) & ~(p.rlike(r"^[0-9]+\z") & (F.length(p) < 4)))
    both = F.array_distinct(F.flatten(F.transform(parts, lambda p: F.array(p, squash(p)))))
    return F.when(F.size(both) > 0, both).otherwise(F.array(value))


def word_index(words: DataFrame) -> DataFrame:
    """Words with the interval [c0, c1) that each takes in its page's squashed text."""
    own = words.withColumn("_w", squash(F.col("word")))
    order = Window.partitionBy(*PAGE).orderBy("word_no")
    end = F.sum(F.length("_w")).over(order).cast("int")
    return own.withColumn("c1", end).withColumn("c0", F.col("c1") - F.length("_w")).drop("_w")


def page_text(words: DataFrame) -> DataFrame:
    """doc_id, page_no and the page's squashed text."""
    return words.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "word"))), lambda w: squash(w["word"])), "").alias("page_text"))


def compact_search(words: DataFrame, targets: DataFrame) -> DataFrame:
    """A box for each word that an occurrence of a target touches: doc_id, page_no, value, repl, hit, word_no, box. targets: doc_id, value, repl. Occurrences may overlap; values below 3 characters (4 without Hangul) aren't searched."""
    own = targets.withColumn("_v", squash(F.col("value")))
    own = own.filter(F.length("_v") >= F.when(F.col("_v").rlike("[가-힣]"), 3).otherwise(4))
    pages = page_text(words).join(own, "doc_id").filter(F.col("page_text").contains(F.col("_v")))
    places = F.filter(F.sequence(F.lit(0), F.length("page_text") - F.length("_v")), lambda i: F.substr(F.col("page_text"), i + 1, F.length("_v")) == F.col("_v"))
    found = pages.select(*PAGE, "value", "repl", F.explode(places).alias("hit"), F.length("_v").alias("_n"))
    index = word_index(words)
    touched = (index["c0"] < F.col("hit") + F.col("_n")) & (index["c1"] > F.col("hit"))
    return found.join(index, PAGE).filter(touched).select(*PAGE, "value", "repl", "hit", "word_no", "x0", "y0", "x1", "y1", "word")


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def expand(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """Each box (doc_id, page_no, box_no, x0, y0, x1, y1) joined with the words that lie in it by more than half, and a margin."""
    b, w = boxes.alias("b"), words.alias("w")
    inside = area(F.greatest("b.x0", "w.x0"), F.greatest("b.y0", "w.y0"), F.least("b.x1", "w.x1"), F.least("b.y1", "w.y1"))
    hit = (F.col("b.doc_id") == F.col("w.doc_id")) & (F.col("b.page_no") == F.col("w.page_no")) & (inside > COVERED * area(F.col("w.x0"), F.col("w.y0"), F.col("w.x1"), F.col("w.y1")))
    joined = b.join(w, hit, "left")
    side = lambda f, c: f(F.col(f"w.{c}"))
    grouped = joined.groupBy("b.doc_id", "b.page_no", "b.box_no").agg(*(F.first(f"b.{c}").alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")), side(F.min, "x0").alias("w_x0"), side(F.min, "y0").alias("w_y0"), side(F.max, "x1").alias("w_x1"), side(F.max, "y1").alias("w_y1"))
    low = lambda c: F.least(f"b_{c}", f"w_{c}") - MARGIN
    high = lambda c: F.greatest(f"b_{c}", f"w_{c}") + MARGIN
    return grouped.select("doc_id", "page_no", "box_no", low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1"))


def swallowed(covered: Column, value: Column) -> Column:
    """One to three Hangul characters that follow a value in the words that its box covers."""
    return F.regexp_extract(F.substr(covered, F.instr(covered, value) + F.length(value)), r"^([가-힣]{1,3})(?![가-힣])", 1)


_BOX = ["x0", "y0", "x1", "y1"]


def _folded(jobs: DataFrame, order: Column, fits: Callable[[Column, Column], Column], joined: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """A page's boxes in order, each joined to the first kept box that it fits, else kept itself. joined: the fields that change."""
    fields = [c for c in jobs.columns if c not in PAGE]
    keyed = F.struct(order.alias("order"), F.struct(*fields).alias("job"))
    pages = jobs.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["job"]).alias("jobs"))

    def step(kept: Column, job: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda o: F.coalesce(fits(o, job), F.lit(False))), True)

        def put(place: Column) -> Column:
            one = lambda o: F.struct(*((c := joined(o, job)).get(f, o[f]).alias(f) for f in fields))
            return F.when(place == 0, F.concat(kept, F.array(job))).otherwise(F.transform(kept, lambda o, i: F.when(i == place - 1, one(o)).otherwise(o)))

        return let(at, put)

    none = F.slice(F.col("jobs"), 1, 0)
    return pages.select(*PAGE, F.inline(F.aggregate("jobs", none, step))).select(jobs.columns)


def _hull(o: Column, j: Column) -> dict[str, Column]:
    return {c: (F.least if c in ("x0", "y0") else F.greatest)(o[c], j[c]) for c in _BOX}


def stitch(jobs: DataFrame) -> DataFrame:
    """Joins boxes (doc_id, page_no, x0, y0, x1, y1, repl, vlen) of one replacement that go on along a line, first fit in order."""

    def fits(o: Column, j: Column) -> Column:
        high = F.least(o["y1"], j["y1"]) - F.greatest(o["y0"], j["y0"])
        least = F.least(o["y1"] - o["y0"], j["y1"] - j["y0"])
        gap = F.greatest(o["x0"], j["x0"]) - F.least(o["x1"], j["x1"])
        return (o["repl"] == j["repl"]) & (high > LINE * least) & (gap < GAP)

    return _folded(jobs, F.struct("y0", "x0"), fits, lambda o, j: _hull(o, j) | {"vlen": F.greatest(o["vlen"], j["vlen"])})


def merge(jobs: DataFrame) -> DataFrame:
    """Joins boxes that overlap by more than half of the smaller one, longest values first; total removal wins."""

    def fits(o: Column, j: Column) -> Column:
        width, height = F.least(o["x1"], j["x1"]) - F.greatest(o["x0"], j["x0"]), F.least(o["y1"], j["y1"]) - F.greatest(o["y0"], j["y0"])
        smaller = F.least(*((x["x1"] - x["x0"]) * (x["y1"] - x["y0"]) for x in (o, j)))
        return (width > 0) & (height > 0) & (width * height > OVERLAP * smaller)

    return _folded(jobs, F.struct(-F.col("vlen"), "y0", "x0"), fits, lambda o, j: _hull(o, j) | {"repl": F.when(j["repl"].isNotNull(), o["repl"])})


def unmapped(targets: DataFrame, boxes: DataFrame, saved: DataFrame) -> DataFrame:
    """Targets without a box whose value is still in the saved text (doc_id, text)."""
    left = targets.join(boxes.select("doc_id", "value").distinct(), ["doc_id", "value"], "left_anti")
    return left.join(saved, "doc_id").filter(F.instr(squash(F.col("text")), squash(F.col("value"))) > 0).select("doc_id", "value")


def residual(targets: DataFrame, saved: DataFrame) -> DataFrame:
    """Targets (doc_id, value, repl, and label if there is one) that the saved text still holds, once inserted replacements are taken out. Names count where one stands alone."""
    joined = targets.join(saved, "doc_id")
    rest = F.when(F.col("repl").isNotNull() & (F.col("repl") != ""), F.replace(F.col("text"), F.col("repl"), F.lit(""))).otherwise(F.col("text"))
    found = F.exists(fragments(F.col("value")), lambda p: F.instr(rest, p) > 0) | (F.instr(squash(rest), squash(F.col("value"))) > 0)
    if "label" in targets.columns:
        alone = (F.instr("text", F.col("value")) > 0) & stands_alone(F.col("text"), F.col("value"))
        found = F.when(F.col("label").isin("NAME", "PERSON"), alone).otherwise(found)
    return joined.filter(found).select("doc_id", "value")


def leftover_metadata(metadata: DataFrame) -> DataFrame:
    """Metadata (doc_id, key, value) that is still there after saving, as residual values; a file's format and encryption say nothing."""
    left = metadata.filter((F.coalesce("value", F.lit("")) != "") & ~F.col("key").isin("format", "encryption"))
    return left.select("doc_id", F.concat(F.lit("META:"), "key", F.lit("="), "value").alias("value"))


def layout(jobs: DataFrame) -> DataFrame:
    """Font size (0.72 of the height, from 6 to 12) and baseline (28 % above the lower edge) of inserted text."""
    height = F.col("y1") - F.col("y0")
    return jobs.withColumn("size", F.least(F.greatest(height * 0.72, F.lit(6.0)), F.lit(12.0))).withColumn("baseline", F.col("y1") - height * 0.28)


def hidden_scrubbed(hidden: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Annotations and attachments go; bookmarks stay, with their targets (doc_id, value, repl) masked, longest first. hidden: doc_id, origin, text."""
    kept = hidden.filter(F.col("origin") == "bookmark")
    if targets is None:
        return kept
    longest = F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("n"), "value", "repl")))
    lists = targets.groupBy("doc_id").agg(longest.alias("__veil_targets"))
    text = F.when(F.col("__veil_targets").isNull(), F.col("text")).otherwise(bookmark_text(F.col("text"), F.col("__veil_targets")))
    return kept.join(lists, "doc_id", "left").withColumn("text", text).drop("__veil_targets")


def thin_layer(pages: DataFrame, least_chars: float = 300.0, image_share: float = 0.5) -> DataFrame:
    """doc_id, chars and image_pages per page, and whether text recognition is needed. pages: doc_id, page_no, text, img_area, page_area."""
    size = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+\z", ""))
    covered = F.when(F.col("page_area") > 0, F.col("img_area") / F.col("page_area") > 0.5).otherwise(False)
    own = pages.groupBy("doc_id").agg(F.sum(size).alias("n"), F.count("*").alias("pages"), F.avg(covered.cast("double")).alias("image_pages"))
    chars = F.col("n") / F.col("pages")
    thin = (F.col("n") == 0) | ((chars < least_chars) & (F.col("image_pages") >= image_share))
    return own.select("doc_id", chars.alias("chars"), "image_pages", thin.alias("thin"), (thin & F.col("image_pages").isNotNull() & (F.col("n") > 0)).alias("has_layer"))


def poor_recognition(chars: Column) -> Column:
    """A warning where recognition gave less than 400 characters a page."""
    return F.when(chars < 400, F.lit("recognised text is thin"))
