"""Benchmark decontamination: which windows of benchmark items occur in documents. DataFrame operations only.

A window is `size` consecutive words of an item (an item with fewer words is one window). Texts are read once for their shingles: a
place of a document whose shingle (three words) is one of a window's is a hit, and only hits are kept, once for equal texts. For a
window to be contained, all of its shingles must be, so the prefix that has to be joined is its rarest shingle alone, by counts over all
documents; windows with a shingle that no document holds are out. A hit of the rarest shingle puts the window at one place
(positional bound), which is exact if each of the window's shingles is a hit at its own place (so the window lies within the text, too).

The shingles of windows are broadcast up to a number; beyond, places and shingles meet by shuffle. Hits are shuffled by shingle and by
text and place, so neither a frequent passage nor a long text gathers in one task; marks of texts are dealt over SALTS copies before
they meet documents, so a text with very many copies doesn't either.

Null and empty texts have no words, are hit nowhere and have no items. Items without words have no window. Rows with the same item id are
one item; a null item id isn't listed, but its hits count. Columns of documents are free to have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import free_name, materialise

#: Words of a shingle, at most.
SHINGLE = 3
#: Distinct shingles of windows (about 150 bytes each) and contaminated texts (a digest each) that are broadcast, at most.
BROADCAST_SHINGLES, BROADCAST_TEXTS = 200_000, 500_000
#: Copies of a text's marks, over which its documents are dealt.
SALTS = 16

# What words consist of, after A-Z became a-z, and before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    text = F.coalesce(text, F.lit(""))
    # lower() takes all letters, but in a text of ASCII those are A-Z; it is many times as fast as translate().
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def windows_of(items: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(window, words, width) of distinct windows, and (window, item) of those that hold them."""
    own = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    parts = own.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {size} + 1, 1)), i -> slice(w, i, {size}))")).alias("words"))
    parts = parts.withColumn("window", F.sha2(F.array_join("words", " "), 256))
    distinct = parts.select("window", "words").dropDuplicates(["window"]).withColumn("width", F.size("words"))
    return distinct, parts.select("window", "item").distinct()


def _hits(docs: DataFrame, shingles: DataFrame, text_col: str, width: int, few: bool) -> DataFrame:
    """digest, pos, sid and n of each place of a text with one of the shingles (sid, key, said) of `width` words; n: copies of the text."""
    own = docs.select(digest_of(F.col(text_col)).alias("digest"), words(F.col(text_col)).alias("w"))
    # Rows of `width` words: the array, and itself moved by one and two.
    moved = F.arrays_zip(*((F.col("w") if k == 0 else F.slice("w", k + 1, F.greatest(F.size("w"), F.lit(1)))).alias(f"w{k}") for k in range(width)))
    places = own.select("digest", F.posexplode(moved).alias("pos", "x")).filter(F.col(f"x.w{width - 1}").isNotNull())
    parts = [F.col(f"x.w{k}") for k in range(width)]
    keyed = places.select("digest", "pos", F.xxhash64(*parts).alias("key"), *(p.alias(f"w{k}") for k, p in enumerate(parts)))
    same = F.concat_ws(" ", *(f"w{k}" for k in range(width))) == F.col("said")
    found = keyed.join(F.broadcast(shingles) if few else shingles, "key").filter(same)
    return found.groupBy("digest", "pos", "sid").agg(F.count("*").alias("n"))


def occurrences(docs: DataFrame, windows: DataFrame, text_col: str = "text") -> DataFrame:
    """digest, start, width and window of each occurrence of a window in a text, once for equal texts. windows: window, words, width."""
    own = windows.withColumn("k", F.least(F.col("width"), F.lit(SHINGLE)))
    at = own.select("window", "width", "k", F.posexplode(F.expr("transform(sequence(1, width - k + 1), i -> array_join(slice(words, i, k), ' '))")).alias("offset", "said"))
    # Written, so a shingle's number is the same in every later step.
    shingles = materialise(at.select("k", "said").distinct().withColumn("sid", F.monotonically_increasing_id()), "shingles")
    sizes = {r["k"]: r["count"] for r in shingles.groupBy("k").count().collect()}
    at = materialise(at.join(shingles, ["k", "said"]).select("window", "width", "offset", "sid"), "places")
    hits = None
    for k in sorted(sizes):
        said = F.split("said", " ")
        keys = shingles.filter(F.col("k") == k).select(F.xxhash64(*(F.get(said, F.lit(j)) for j in range(k))).alias("key"), "said", "sid")
        part = _hits(docs, keys, text_col, k, sizes[k] <= BROADCAST_SHINGLES)
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return windows.select(F.lit(b"").alias("digest"), F.lit(0).alias("start"), "width", "window").limit(0)
    hits = materialise(hits, "hits")
    counts = hits.groupBy("sid").agg(F.sum("n").alias("n"))
    rarest = at.join(counts, "sid", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "sid")).alias("r"), F.count("*").alias("parts"), F.first("width").alias("width"))
    keyed = rarest.filter("r.n > 0").select("window", "width", "parts", F.col("r.offset").alias("first"), F.col("r.sid").alias("sid"))
    placed = hits.join(keyed, "sid").select("digest", (F.col("pos") - F.col("first")).alias("start"), "width", "window", "parts").filter("start >= 0")
    wanted = placed.join(at.select("window", "offset", "sid"), "window").withColumn("pos", F.col("start") + F.col("offset"))
    exact = wanted.join(hits.select("digest", "pos", "sid"), ["digest", "pos", "sid"]).groupBy("digest", "start", "width", "window", "parts").agg(F.count("*").alias("met"))
    return materialise(exact.filter("met = parts").select("digest", "start", "width", "window"), "occurrences")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256, contaminated and spans (start and end word of each run of hit words) of every row."""
    windows, holders = windows_of(items, item_col, item_text, size)
    windows, holders = materialise(windows, "windows"), materialise(holders, "holders")
    found = occurrences(docs, windows, text_col)
    runs = found.select("digest", "start", (F.col("start") + F.col("width")).alias("end")).distinct()
    ordered = Window.partitionBy("digest").orderBy("start", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    # A run that begins beyond all before it begins a span.
    numbered = runs.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int")).withColumn("span", F.sum("new").over(ordered))
    spans = numbered.groupBy("digest", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    listed = found.select("digest", "window").distinct().join(holders, "window").select("digest", F.col("item").cast("string").alias("item")).distinct()
    held = listed.groupBy("digest").agg(F.count("item").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_set("item")), ","), 256).alias("items_sha256"))
    marks = materialise(spans.join(held, "digest", "left"), "marks").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    n_words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(ANY_WORD)).cast("long")
    own = docs.select(F.col(id_col).alias("id"), digest_of(F.col(text_col)).alias("digest"), n_words.alias("n_words"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("salt"))
    # Texts without words meet nothing; a key of their id's spreads them (16 bytes, while a digest has 32).
    own = own.withColumn("digest", F.when(F.col("n_words") > 0, F.col("digest")).otherwise(F.unhex(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))))
    none = F.sha2(F.lit(""), 256)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return own.join(marks, ["digest", "salt"], "left").select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """The rows of docs, all columns as they are, whose text holds no window of an item."""
    windows, _ = windows_of(items, item_col, item_text, size)
    key = free_name(docs, "digest")
    marked = materialise(occurrences(docs, materialise(windows, "windows"), text_col).select(F.col("digest").alias(key)).distinct(), "marked")
    few = marked.count() <= BROADCAST_TEXTS
    own = docs.withColumn(key, digest_of(F.col(f"`{text_col}`")))
    return own.join(F.broadcast(marked) if few else marked, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
