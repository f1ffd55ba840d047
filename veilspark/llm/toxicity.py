"""Toxic spans and document scores by a linear-chain conditional random field.

Only documents carry labels, so token labels come from them: within the sample, a word or a beginning of a word
that marks toxic documents beyond chance labels its tokens in toxic documents as offending. The field has two
states (fine, offending); emissions sum weights of the word and its beginnings and ends, transitions tie
neighbours. Weights follow the exact gradient of the log-likelihood: forward-backward gives the marginals of tokens for the
emissions and those of pairs of neighbours for all transitions. At scoring time, it gives the marginal of each token; a document's score is a logistic function of their evidence,
and tokens of marginal 0.5 or more give the offending offsets.

Whole texts are scored; chains run in blocks with a warm-up on both sides, over which what lies beyond fades far
below float precision. Null and empty texts have no tokens and get the score of an all-fine document. Without
any usable label, all scores are 0; with labels of one class, all scores are that class.
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import bounded_batches, crc_class, kept, map_arrow, trim
from veilspark.llm.words import WORD, WordTable, slices, words_of

#: The fit uses about so many labelled rows of each class at most, one of an id, taken by a hash of the id ...
FIT_ROWS = 1500
#: ... among texts of at most so many characters.
FIT_CHARS = 40_000
#: Size of the hashed weight table.
WEIGHTS = 1 << 18
#: Tokens of a block and of the warm-up on each side.
BLOCK, WARM = 224, 48
#: A word or beginning marks toxic documents if its log-likelihood ratio is beyond what chance would give one of all candidates with this probability.
MARK_CHANCE = 0.01
#: Least share of toxic texts among those with the word, with the sample's classes weighted back; how sure it is then, the field learns.
MARK_SHARE = 0.7
_PREFIXES = (3, 4, 5, 6)


def _features(word: str) -> list[int]:
    """Hashed features of a word: itself, its beginnings and its end."""
    w = word.lower()
    parts = [f"w {w}", f"s {w[-3:]}", *(f"p {w[:k]}" for k in _PREFIXES if len(w) >= k)]
    found = [zlib.crc32(p.encode("utf-8", "surrogatepass")) & (WEIGHTS - 1) for p in parts]
    return found + [WEIGHTS] * (2 + len(_PREFIXES) - len(found))


@dataclass
class Field:
    """A fitted field: weights (the last is of no feature), transition and start scores, and the document's logistic function."""

    weights: np.ndarray
    transitions: np.ndarray
    bias: float
    document: np.ndarray
    constant: float | None = None

    def emissions(self, words: list[str]) -> np.ndarray:
        """The score of `offending` against `fine` for each word."""
        return (self.weights[np.array([_features(w) for w in words], np.int64)].sum(axis=1) + self.bias).reshape(-1, 1)


def forward_backward(scores: np.ndarray, transitions: np.ndarray, both: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of `offending` by token, for rows of equal length, and with `both` the marginals of neighbouring pairs, summed over rows and places where it is true.

    scores: [rows, length]; both: [rows, length - 1]; pairs: [state, next state].
    """
    n, length = scores.shape
    t = np.exp(transitions)
    offend = np.exp(np.clip(scores, -30, 30))
    forward = np.empty((2, length, n))
    a, b = np.ones(n), offend[:, 0].astype(float)
    for i in range(length):
        if i:
            a, b = a * t[0, 0] + b * t[1, 0], (a * t[0, 1] + b * t[1, 1]) * offend[:, i]
        z = a + b
        a, b = a / z, b / z
        forward[0, i], forward[1, i] = a, b
    out, pairs = np.empty((length, n)), np.zeros((2, 2))
    a, b = np.ones(n), np.ones(n)
    for i in range(length - 1, -1, -1):
        if i < length - 1:
            o = offend[:, i + 1] * b
            if both is not None:
                joint = np.array([[forward[0, i] * t[0, 0] * a, forward[0, i] * t[0, 1] * o], [forward[1, i] * t[1, 0] * a, forward[1, i] * t[1, 1] * o]])
                pairs += (joint / joint.sum(axis=(0, 1)) * both[:, i]).sum(axis=2)
            a, b = t[0, 0] * a + t[0, 1] * o, t[1, 0] * a + t[1, 1] * o
            z = a + b
            a, b = a / z, b / z
        fine, off = forward[0, i] * a, forward[1, i] * b
        out[i] = off / (fine + off)
    return out.T, pairs


def marginals(chains: list[np.ndarray], transitions: np.ndarray) -> list[np.ndarray]:
    """Marginals of each chain. All are laid end to end, parted by a token that is surely fine, and run block by block."""
    parted = np.concatenate([x for c in chains for x in (c, [-30.0])]) if chains else np.zeros(0)
    n = len(parted)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK + 2 * WARM, -30.0)
    padded[WARM : WARM + n] = parted
    rows = np.lib.stride_tricks.as_strided(padded, (blocks, BLOCK + 2 * WARM), (padded.strides[0] * BLOCK, padded.strides[0]))
    flat = np.concatenate([np.zeros((0, BLOCK)), *(forward_backward(rows[k : k + 2048], transitions)[0][:, WARM : WARM + BLOCK] for k in range(0, blocks, 2048))]).reshape(-1)
    ends = np.cumsum([len(c) + 1 for c in chains])
    return [flat[e - 1 - len(c) : e - 1] for c, e in zip(chains, ends, strict=True)]


def _marking(texts: list[list[str]], toxic: np.ndarray, weight: float) -> set[str]:
    """Words (`w `) and beginnings (`p `) that mark toxic documents beyond chance."""
    of = (Counter(), Counter())
    for words, y in zip(texts, toxic, strict=True):
        keys = set()
        for w in words:
            keys.add(f"w {w}")
            keys.update(f"p {w[:k]}" for k in _PREFIXES if len(w) >= k)
        of[int(y)].update(keys)
    share = toxic.mean()
    # Wilks: the ratio of a key that marks nothing is like a squared normal number; Bonferroni over all keys of the sample.
    least = NormalDist().inv_cdf(1 - MARK_CHANCE / 2 / max(1, len(of[0].keys() | of[1].keys()))) ** 2
    found = set()
    for key, a in of[1].items():
        b = of[0].get(key, 0)
        p = a / (a + b)
        if p <= share or a * weight <= MARK_SHARE * (a * weight + b):
            continue
        ratio = 2 * (a * math.log(p / share) + (b * math.log((1 - p) / (1 - share)) if b else 0))
        if ratio >= least:
            found.add(key)
    return found


def fit(texts: list[str], toxic: list[int], seed: int = 7, toxic_weight: float = 1.0) -> Field:
    """Fits the field and the document's logistic function on labelled texts. toxic_weight: how many toxic texts one of the sample stands for, against one that isn't."""
    y = np.array(toxic, int)
    empty = Field(np.zeros(WEIGHTS + 1, np.float32), np.zeros((2, 2)), 0.0, np.zeros(2), 0.0)
    if not len(y) or y.min() == y.max():
        empty.constant = float(y[0]) if len(y) else 0.0
        return empty
    lower = [[w.lower() for part in words_of(t) for w in part] for t in texts]
    # The document's function is fitted on rows that its field hasn't seen; the field itself then on all.
    aside = np.arange(len(y)) % 4 == 3
    if len({*y[aside]}) < 2 or len({*y[~aside]}) < 2:
        aside[:] = True
        first = whole = _fitted_field(lower, y, toxic_weight, seed)
    else:
        first = _fitted_field([w for w, a in zip(lower, aside, strict=True) if not a], y[~aside], toxic_weight, seed)
        whole = _fitted_field(lower, y, toxic_weight, seed)
    emissions = WordTable(first.emissions, 1)
    found = marginals([emissions.of(words)[:, 0] for words, a in zip(lower, aside, strict=True) if a], first.transitions)
    whole.document = _logistic(np.array([_summary(p) for p in found]), y[aside], np.where(y[aside] == 1, toxic_weight, 1.0))
    return whole


def _fitted_field(lower: list[list[str]], y: np.ndarray, weight: float, seed: int) -> Field:
    """The field alone, on the lower-cased words of labelled texts."""
    marks = _marking(lower, y, weight)
    offends = {}
    for w in {w for words in lower for w in words}:
        offends[w] = f"w {w}" in marks or any(f"p {w[:k]}" in marks for k in _PREFIXES if len(w) >= k)
    rng = np.random.default_rng(seed)
    size, windows, targets = 24, [], []
    for words, own in zip(lower, y, strict=True):
        hits = [i for i, w in enumerate(words) if own and offends[w]]
        # One window for each run of offending words, and some beside.
        starts = {max(0, min(i - int(rng.integers(size)), len(words) - size)) for k, i in enumerate(hits) if k == 0 or i - hits[k - 1] >= size}
        starts |= {int(s) for s in rng.integers(0, max(1, len(words) - size + 1), 2 if not own else 1)}
        for s in starts:
            part = words[s : s + size]
            windows.append(part + [""] * (size - len(part)))
            targets.append([bool(own and w and offends[w]) for w in windows[-1]])
    known = list(dict.fromkeys(w for part in windows for w in part))
    row = {w: i for i, w in enumerate(known)}
    table = np.array([_features(w) if w else [WEIGHTS] * (2 + len(_PREFIXES)) for w in known], np.int64)
    index = np.array([[row[w] for w in part] for part in windows])
    real = index != row.get("", -1)
    target = np.array(targets, float)
    weights, squares = np.zeros(WEIGHTS + 1), np.full(WEIGHTS + 1, 1e-6)
    transitions, bias, slopes = np.zeros((2, 2)), -2.0, np.full((2, 2), 1e-6)
    for _ in range(12):
        order = rng.permutation(len(index))
        for k in range(0, len(order), 512):
            pick = order[k : k + 512]
            feats, mask, goal = table[index[pick]], real[pick], target[pick]
            both = mask[:, 1:] & mask[:, :-1]
            scores = np.where(mask, weights[feats].sum(axis=2) + bias, -30.0)
            p, expected = forward_backward(scores, transitions, both)
            off = (goal - p) * mask
            step = np.bincount(feats.reshape(-1), np.repeat(off.reshape(-1), feats.shape[2]), WEIGHTS + 1) / len(pick) - 1e-5 * weights
            step[WEIGHTS] = 0
            squares += step * step
            weights += 0.25 * step / np.sqrt(squares)
            bias += 0.5 * off.sum() / mask.sum()
            first, second = np.stack([1 - goal, goal])[:, :, :-1], np.stack([1 - goal, goal])[:, :, 1:]
            seen = np.einsum("sij,tij,ij->st", first, second, both)
            slope = (seen - expected) / len(pick) - 1e-2 * transitions
            slope[0, 0] = 0  # one of the four goes with the rest
            slopes += slope * slope
            transitions += 0.1 * slope / np.sqrt(slopes)
    return Field(weights.astype(np.float32), transitions, bias, np.zeros(2))


def _summary(p: np.ndarray) -> list[float]:
    """What a document's score depends on: a constant, and the evidence of its tokens (minus the logarithm of their marginals of `fine`, but for the noise of fine tokens)."""
    seen = p[p >= 0.05]
    return [1.0, math.log1p(float(-np.log1p(-np.minimum(seen, 1 - 1e-6)).sum()))]


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logistic regression of weighted rows by Newton steps, with a weak prior."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weights * (y - p)) - 0.3 * w)
    return w


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> tuple[DataFrame, float]:
    """The rows of labelled_sample() (_text, _label, and _at for their order), and the weight."""
    own = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_class(id_col, 5) != 0)).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_label"))
    counts = {r["_label"]: r["count"] for r in own.groupBy("_label").count().collect()}
    share = lambda c: min(1.0, rows / max(1, counts.get(c, 0)))
    place = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1_000_000))
    own = own.filter(place < F.when(F.col("_label") == 1, round(share(1) * 1_000_000)).otherwise(round(share(0) * 1_000_000)))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull() & (F.length("_text") <= FIT_CHARS))
    # The sample is of about 2 x FIT_ROWS ids at most, so it may be broadcast; of rows that repeat an id, the least text stays.
    found = texts.join(F.broadcast(own), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    return found.select("_text", "_label", F.xxhash64("_id", F.lit(5)).alias("_at")), share(0) / share(1)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = FIT_ROWS) -> tuple[list[str], list[int], float]:
    """At most about `rows` labelled texts of each class, of ids outside the held-out class and one of each id, in the order of a hash of the id; and the weight of toxic ones that makes up for unequal shares.

    An id that is labelled more than once counts as toxic if any of its labels says so.
    """
    found, weight = _sample(docs, labels, id_col, text_col, label_col, rows)
    return *_in_order(found.toArrow()), weight


def _in_order(found: pa.Table) -> tuple[list[str], list[int]]:
    found = found.sort_by("_at")
    return found["_text"].to_pylist(), found["_label"].to_pylist()


def score_documents(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Scores every text: id_col, score, spans (start, end, marginal) of offending tokens; keep: all columns of docs besides.

    Null text: no tokens. A clashing column `score` or `spans` of docs isn't kept.
    """
    held, key = docs.sparkSession.sparkContext.broadcast(field), f"field {uuid.uuid4().hex}"
    names = [c for c in docs.columns if c not in ("score", "spans", text_col)] if keep else [id_col]
    if keep:
        docs = docs.select(*(F.col(f"`{c}`") for c in names), text_col)
    else:
        docs = docs.select(id_col, text_col)
    fields = [docs.schema[c] for c in (docs.columns if keep else names)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, spans array<struct<start: int, end: int, marginal: double>>"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        field = held.value
        table = kept(key, lambda: WordTable(field.emissions, 1))
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
        if field.constant is not None:
            scores, spans = [field.constant] * len(texts), [[] for _ in texts]
        else:
            scores, spans = [], []
            chains = [np.concatenate([table.of(words)[:, 0] for words in words_of(t)]) for t in texts]
            for text, p in zip(texts, marginals(chains, field.transitions), strict=True):
                z = float(np.dot(_summary(p), field.document))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                spans.append(_spans(text, p))
        columns = [batch.column(k) for k in range(len(fields))]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        return pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array(spans, kind)], [*(f.name for f in fields), "score", "spans"])

    return map_arrow(docs, run, schema)


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Code-point offsets of the tokens whose marginal is 0.5 or more."""
    hit = set(np.flatnonzero(p >= 0.5).tolist())
    if not hit:
        return []
    out, k = [], 0
    for offset, part in slices(text):
        for m in WORD.finditer(part):
            if k in hit:
                out.append({"start": offset + m.start(), "end": offset + m.end(), "marginal": float(p[k])})
            k += 1
    return out


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """The field that the labelled rows outside the held-out class give. A task fits it, so the driver's memory holds the field alone and not the texts."""
    found, weight = _sample(docs, labels, id_col, text_col, label_col, FIT_ROWS)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := list(batches):
            texts, toxic = _in_order(pa.Table.from_batches(got))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, toxic, toxic_weight=weight))], pa.binary())], ["field"])
        trim()

    made = found.repartition(1).mapInArrow(run, "field binary").collect()
    return pickle.loads(made[0]["field"]) if made else fit([], [])
