"""Near-duplicate groups by an exact Jaccard self-join over word shingles, with vertical partitioning.

The space of shingle hashes is the global order's raw form; it is cut into fragments, and what documents share is counted fragment by
fragment and summed, twice:

1. *Which documents can link at all.* A pair of different sets with the least similarity t shares at least t of either set, so a set links
   only if that part of it occurs in other sets. Each task sends a fragment the shingles of its documents, packed, a shingle at most once
   for each task step (one that several documents of the step hold is counted on the spot). Fragments grow in number with the
   corpus and each is bounded. What they count is summed for each set; most documents end here.
2. *Pairs.* Sets that are left are ordered by rarity; a pair must share a shingle among the first n - ceil(t n) + 1 of both. Lengths must fit,
   and so must parity sketches: each shingle flips a bit, so sketches of a linking pair differ in no more bits than the sets may in
   shingles. In a few rounds, groups of a common shingle first link to leaders; after that, only pairs that aren't known to be connected are
   looked at. So a large group of copies costs about its size, and no link between different components is lost. Overlaps of the pairs are
   counted for each fragment of the order separately and summed, and t is tested on the exact sums.

Sets that are equal are one class from the start. Texts without words (and null texts) have an empty set and link with nothing. Set elements
are 64-bit hashes, classes 128-bit ones. Rows with a null id get the component of their class's smallest id (null if none has one).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veilspark.llm.common import Generations, bounded_batches, free_name, kept, materialise, trim
from veilspark.llm.components import components

#: Postings of a step of a task, and of a fragment, about.
STEP_POSTINGS, FRAGMENT_POSTINGS = 1_000_000, 4_000_000
#: Least number of fragments, and the fragments in which overlaps of pairs are counted.
LEAST_FRAGMENTS, PAIR_FRAGMENTS = 32, 4
#: Ranges of keys in which a fragment is counted, a power of two.
PASSES = 4
#: Sets of a shingle that meet its leader in one part.
HOT = 500
#: Rounds in which sets meet leaders, before those that are still apart meet each other.
STARS = 3
#: 64-bit words of a parity sketch.
SKETCH = 8
#: Sets that are left are told by a broadcast up to so many (about 100 bytes each in a hash table), else by a shuffle.
BROADCAST_SETS = 300_000
#: Bytes of distinct words whose hashes a worker keeps, about; bytes of text that are split at once.
KEPT_BYTES, SLICE = 64 << 20, 4 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def _word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased, split at white space of ASCII."""
    data, parts, at = text.encode("utf-8", "surrogatepass").lower(), [], 0
    while at < len(data) or not parts:
        end = len(data)
        if end - at > SLICE:
            gap = _GAP.search(data, at + SLICE)
            end = gap.start() if gap else end
        words = (data[at:end] if at or end < len(data) else data).split()
        known = kept("ngramjoin", lambda: Generations(KEPT_BYTES))
        for w in known.absent(dict.fromkeys(words)):
            known.put(w, xxhash.xxh3_64_intdigest(w))
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = max(end, at + 1)
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingle_set(text: str | None, size: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than `size` are one shingle, no words none."""
    words = _word_hashes(text or "")
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    mixed = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _M1 + words[k : n - width + 1 + k]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _M2
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _M3
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def class_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """Parities of the set's hashes over SKETCH x 64 bits."""
    counts = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _light(docs: DataFrame, size: int) -> DataFrame:
    """_id, _n and _tag of every document."""
    kind = docs.schema["_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.binary())], ["_id", "_n", "_tag"])

    return docs.mapInArrow(run, T.StructType([T.StructField("_id", kind), T.StructField("_n", T.LongType()), T.StructField("_tag", T.BinaryType())]))


def _packed(tags: list[int], sets: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """What the documents of one step send to each fragment: for each document its tag, the number of shingles that only it holds here and of those that others hold too; the former's keys; and once the latter's."""
    docs = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    hashes, docs = hashes[order], docs[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    shared = ~(new & np.concatenate([new[1:], [True]]))
    fragments = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    keys = ((hashes >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    tag, rows = np.array(tags, np.uint64), []
    cuts = np.searchsorted(fragments, np.arange((1 << bits) + 1))
    for f in range(1 << bits):
        part = slice(cuts[f], cuts[f + 1])
        if part.start == part.stop:
            continue
        d, s, k = docs[part], shared[part], keys[part]
        single = np.bincount(d[~s], minlength=len(sets))
        several = np.bincount(d[s], minlength=len(sets))
        held = np.flatnonzero(single + several)
        by_doc = np.argsort(d[~s], kind="stable")
        rows.append((f, tag[held].tobytes(), single[held].astype(np.uint32).tobytes(), several[held].astype(np.uint32).tobytes(), k[~s][by_doc].tobytes(), np.unique(k[s]).tobytes()))
    names = ["fragment", "tags", "single", "several", "keys", "known"]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in range(1, 6))], names)


def _postings(docs: DataFrame, size: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        n = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = shingle_set(text, size)
                if len(own) and (tag := class_of(own)) not in held:
                    held[tag] = own
                    n += len(own)
                    if n >= STEP_POSTINGS:
                        yield _packed([int.from_bytes(t[:8], "big") for t in held], list(held.values()), bits)
                        held, n = {}, 0
        if held:
            yield _packed([int.from_bytes(t[:8], "big") for t in held], list(held.values()), bits)
        held.clear()
        trim()

    return docs.select("_text").mapInArrow(run, "fragment int, tags binary, single binary, several binary, keys binary, known binary")


def _shared_in_fragment(table: pa.Table) -> pa.Table:
    """How many shingles of each set occur in other sets too, in one fragment (for copies in several steps never too few). Keys are looked at in PASSES ranges, one after another."""
    read = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    tags, single, several = read("tags", np.uint64), read("single", np.uint32), read("several", np.uint32)
    all_keys, all_known = read("keys", np.uint32), np.unique(read("known", np.uint32))
    distinct, at = np.unique(tags, return_inverse=True)
    most = np.zeros(len(distinct), np.int64)
    np.maximum.at(most, at, several.astype(np.int64))
    all_owners = np.repeat(at.astype(np.uint32), single)
    for turn in range(PASSES):
        own = np.flatnonzero((all_keys >> np.uint32(32 - PASSES.bit_length() + 1)) == turn)
        # Key and owner in one number: sorted and distinct.
        pairs = np.unique(all_keys[own].astype(np.uint64) << np.uint64(32) | all_owners[own])
        keys, owners = (pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        many = ~(new & np.append(new[1:], True))
        many |= np.isin(keys, all_known)
        most += np.bincount(owners[many], minlength=len(distinct))
    del all_keys, all_owners, pairs
    trim()
    keep = most > 0
    return pa.table({"tag": pa.array(distinct[keep].view(np.int64), pa.int64()), "shared": pa.array(most[keep], pa.int64())})


def _sets(docs: DataFrame, size: int) -> DataFrame:
    kind = docs.schema["_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
            for k in range(0, len(sets), 200):
                part = sets[k : k + 200]
                lists = pa.array([s.view(np.int64) for s in part], pa.list_(pa.int64()))
                sketches = pa.array([sketch_of(s) for s in part], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(part)), pa.array([class_of(s) for s in part], pa.binary()), pa.array([len(s) for s in part], pa.int64()), lists, sketches], ["_id", "_tag", "n", "hashes", "sketch"])

    longs = T.ArrayType(T.LongType())
    return docs.mapInArrow(run, T.StructType([T.StructField("_id", kind), T.StructField("_tag", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("hashes", longs), T.StructField("sketch", longs)]))


def _least_shared(n: Column, share: int) -> Column:
    """ceil(share % of n), as a long."""
    return ((n * share + 99) / 100).cast("long")


def _fits(n: Column, m: Column, s: Column, r: Column, share: int) -> Column:
    """What a linking pair fulfils for sure: lengths, and sketches that differ in no more bits than the sets may in shingles."""
    bits = sum((F.bit_count(s[k].bitwiseXOR(r[k])) for k in range(1, SKETCH)), F.bit_count(s[0].bitwiseXOR(r[0])))
    # |A xor B| <= (n + m) (1 - t) / (1 + t)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * share) & (bits * (100 + share) <= (n + m) * (100 - share))


def _prefixes(sets: DataFrame, share: int) -> DataFrame:
    """h, tag, n, sketch, lone (its share of shingles that no other set has), salts (parts into which a frequent shingle's sets are dealt): for each set, those of its n - ceil(t n) + 1 rarest shingles that occur in other sets."""
    exploded = sets.select("tag", F.explode("hashes").alias("h"))
    counts = exploded.groupBy("h").count().filter("count > 1")
    both = exploded.join(counts, "h")
    own = Window.partitionBy("tag")
    ranked = both.select("tag", "h", "count", F.row_number().over(own.orderBy("count", "h")).alias("at"), F.count("*").over(own).alias("shared"))
    found = ranked.join(sets.select("tag", "n", "sketch"), "tag")
    # Shingles of this set alone come first in its order.
    return found.filter(F.col("n") - F.col("shared") + F.col("at") <= F.col("n") - _least_shared(F.col("n"), share) + 1).select("h", "tag", "n", "sketch", (1 - F.col("shared") / F.col("n")).alias("lone"), F.ceil(F.col("count") / HOT).cast("int").alias("salts"))


def _verified(pairs: DataFrame, segments: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b, na, nb) that link: overlaps by fragment, summed."""
    left = segments.select(F.col("tag").alias("a"), "fragment", F.col("part").alias("pa"))
    right = segments.select(F.col("tag").alias("b"), "fragment", F.col("part").alias("pb"))
    parts = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).cast("long").alias("o"))
    summed = parts.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return summed.filter(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * share).select("a", "b")


def link_classes(sets: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between classes whose Jaccard similarity is at least share %, enough of them to connect all that link. sets: tag, n, hashes, sketch."""
    lists = [F.expr(f"filter(hashes, h -> pmod(h, {PAIR_FRAGMENTS}) = {f})") for f in range(PAIR_FRAGMENTS)]
    prefixes = materialise(_prefixes(sets, share), "prefixes")
    active = prefixes.select("tag").distinct()
    segments = materialise(sets.join(active, "tag", "left_semi").select("tag", F.posexplode(F.array(*lists)).alias("fragment", "part")).filter(F.size("part") > 0), "segments")
    dealt = prefixes.withColumn("salt", F.pmod(F.xxhash64("tag", F.lit(-1)), F.col("salts")).cast("int"))
    own, links = dealt.withColumn("label", F.col("tag")), None
    for turn in range(STARS):
        # Each set of a shingle meets two leaders. What copies were made from has the fewest shingles of its own, so it leads first; after
        # that, one of the least and one of the largest label of the shingle's sets lead, and only sets of other labels meet them.
        member = F.struct(F.round("lone", 3).alias("lone") if turn % 2 == 0 else F.xxhash64("tag", F.lit(turn)).alias("lone"), F.xxhash64("tag").alias("x"), "tag", "n", "sketch", "label")
        ends = own.groupBy("h").agg(F.min(member).alias("lead"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.first("salts").alias("salts")).filter("l0 != l1")
        if turn:
            by_label = F.struct("label", F.struct(member["lone"], member["x"], member["tag"], member["n"], member["sketch"], member["label"]).alias("lead"))
            least = own.groupBy("h").agg(F.min(by_label).alias("a"), F.max(by_label).alias("b"), F.first("salts").alias("salts")).filter("a.label != b.label")
            ends = least.select("h", F.explode(F.array("a.lead", "b.lead")).alias("lead"), "salts")
        # The sets of a frequent shingle meet its leader in parts, each with a copy of it.
        leaders = materialise(ends.select("h", "lead", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), "leaders")
        met = own.join(leaders, ["h", "salt"]).filter((F.col("label") != F.col("lead.label")) & _fits(F.col("n"), F.col("lead.n"), F.col("sketch"), F.col("lead.sketch"), share))
        first = F.col("tag") < F.col("lead.tag")
        pairs = met.select(F.least("tag", "lead.tag").alias("a"), F.greatest("tag", "lead.tag").alias("b"), F.when(first, F.col("n")).otherwise(F.col("lead.n")).alias("na"), F.when(first, F.col("lead.n")).otherwise(F.col("n")).alias("nb")).distinct()
        found = _verified(pairs, segments, share)
        links = materialise(found if links is None else links.unionByName(found), "links")
        labels = components(links).select(F.col("node").alias("tag"), F.col("root").alias("label"))
        own = materialise(dealt.join(labels, "tag", "left").withColumn("label", F.coalesce("label", "tag")), "labelled")
    # The rest: pairs of different labels. A band holds lengths within a factor of 1/t, so a pair's bands are equal or next to each other.
    own = own.withColumn("band", F.floor(F.log("n") / F.lit(float(np.log(100 / share)))).cast("int"))
    mixed = own.groupBy("h").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.first("salts").alias("salts")).filter("l0 != l1")
    mixed = materialise(mixed.select("h", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), "mixed")
    own = materialise(own.join(mixed, ["h", "salt"], "left_semi"), "open")
    shorter = own.select("h", F.col("tag").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("label").alias("la"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    longer = own.select("h", F.col("tag").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("label").alias("lb"), "band")
    ahead = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    rest = shorter.join(longer, ["h", "band"]).filter((F.col("la") != F.col("lb")) & ahead & _fits(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"), share))
    return links.unionByName(_verified(rest.select("a", "b", "na", "nb").distinct(), segments, share))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: int = 80) -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id reachable by links of a Jaccard similarity of at least share %) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    light = materialise(_light(docs, size), "light")
    classes = materialise(light.filter("_n > 0").groupBy("_tag").agg(F.min("_id").alias("_first"), F.first("_n").alias("_n"), F.sum("_n").alias("_all")), "classes")
    total = classes.agg(F.sum("_all")).first()[0] or 0
    bits = max(LEAST_FRAGMENTS.bit_length() - 1, int(total // FRAGMENT_POSTINGS).bit_length())
    counted = _postings(docs, size, bits).groupBy("fragment").applyInArrow(_shared_in_fragment, "tag long, shared long").groupBy("tag").agg(F.sum("shared").alias("shared"))
    short = F.conv(F.substring(F.hex("_tag"), 1, 16), 16, -10).cast("long")
    left = classes.select("_tag", "_first", "_n", short.alias("tag")).join(counted, "tag").filter(F.col("shared") >= _least_shared(F.col("_n"), share)).select("_tag", "_first")
    left = materialise(left, "left")
    told = F.broadcast(left) if left.count() <= BROADCAST_SETS else left
    sets = _sets(docs, size).filter("n > 0").join(told, "_tag").filter(F.col("_id").eqNullSafe(F.col("_first"))).dropDuplicates(["_tag"]).select(F.col("_tag").alias("tag"), "n", "hashes", "sketch")
    links = link_classes(materialise(sets, "sets"), share)
    roots = components(links)
    named = classes.select(F.col("_tag").alias("node"), F.col("_first")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Only classes with links meet at a root; the others keep their own id.
    linked = materialise(named.join(roots.select("root").distinct(), "root", "left_semi"), "linked")
    least = linked.groupBy("root").agg(F.min("_first").alias("_least"))
    moved = linked.join(least, "root").select(F.col("node").alias("_tag"), "_least")
    whole = materialise(classes.select("_tag", "_first").join(moved, "_tag", "left").select("_tag", F.coalesce("_least", "_first").alias("_component")), "components")
    out = light.join(whole, "_tag", "left")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.when(F.col("_n") == 0, F.col("_id")).otherwise(F.col("_component")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: int = 80) -> DataFrame:
    """The rows of docs, all columns as they are, that have the smallest id of their component; of rows repeated with their id, one stays. Different rows with a null id all stay if no row of their component has an id."""
    kept_name, times = free_name(docs, "kept"), free_name(docs, "times")
    found = near_duplicates(docs, id_col, text_col, size, share).select(F.col(id_col).alias(kept_name), "component_id")
    once = materialise(found.filter(F.col(kept_name).eqNullSafe(F.col("component_id"))).groupBy(kept_name).agg(F.count("*").alias(times)), "kept")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.join(once, F.col(f"`{id_col}`").eqNullSafe(F.col(kept_name)))
    single = joined.filter(F.col(times) == 1).select(*columns)
    return single.unionByName(joined.filter(F.col(times) > 1).select(*columns).dropDuplicates())
