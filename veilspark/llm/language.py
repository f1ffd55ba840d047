"""Language identification in two steps: a family first, then the languages within it, by linear support vector machines.

A text is the mean of its words' hashed character n-grams, so each linear machine's value of a text is a mean over
its words; a worker keeps the values of distinct words. Families are told apart one-versus-one, and so are the languages
of each family; votes decide, sums of margins break ties. The machines are trained by dual coordinate descent.

The score is the product of the two steps' confidences (a logistic function, fitted on rows kept aside, of the winner's least margin).
Null texts and texts without letters get `und` and score 0. Without any labelled row, every text gets `und`.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import crc_class, kept, map_arrow
from veilspark.llm.words import WordTable, words_of

#: The fit learns every language; of each, it uses about so many labelled rows at most, by a hash of the id, and so many in all (but LEAST_ROWS of each).
FIT_ROWS, FIT_ALL, LEAST_ROWS = 400, 25_600, 40
#: Words that are drawn from a whole text, words of the run that stands for a short one, and most characters of either.
FIT_WORDS, FIT_RUN, FIT_CHARS = 200, 6, 20_000
#: Whether a text has letters, for Spark.
LETTER = r"\p{L}"
#: Size of the hashed n-gram space.
GRAMS = 1 << 13

# Language families by ISO 639-1 code; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "iranian": "fa ku ps tg",
    "sinitic": "yue zh",
    "austronesian": "id jv ms tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(language: str) -> str:
    return _FAMILY.get(language.lower().split("-")[0].split("_")[0], f"own {language}")


def grams(word: str) -> list[int]:
    """Hashed n-grams of one to four characters of a word with its ends marked, and the word itself."""
    w = f" {word.lower()} "
    parts = [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)] + [w + "$"]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & (GRAMS - 1) for p in parts]


Sparse = tuple[np.ndarray, np.ndarray]


def vector(words: list[str]) -> Sparse:
    """The mean n-gram vector of words, each word counting alike: n-grams that occur, and their values."""
    found = [grams(w) for w in words]
    shares = np.repeat([1 / (len(g) * max(1, len(words))) for g in found], [len(g) for g in found])
    places, at = np.unique(np.fromiter(itertools.chain.from_iterable(found), np.int32, len(shares)), return_inverse=True)
    return places, np.bincount(at, shares, len(places)).astype(np.float32)


def excerpts(text: str, seed: int = 11) -> tuple[list[str], list[str]]:
    """Words drawn from a whole text, in order, and a run of a few; both empty if it has no words."""
    n = sum(len(part) for part in words_of(text))
    if n == 0:
        return [], []
    rng = np.random.default_rng([seed, zlib.crc32(text.encode("utf-8", "surrogatepass"))])
    at = int(rng.integers(0, max(1, n - FIT_RUN + 1)))
    drawn = np.arange(n) if n <= FIT_WORDS else np.sort(rng.choice(n, FIT_WORDS, replace=False, shuffle=False))
    sample, run, first = [], [], 0
    for part in words_of(text):
        own = drawn[np.searchsorted(drawn, first) : np.searchsorted(drawn, first + len(part))]
        sample += [part[i - first] for i in own]
        run += part[max(0, at - first) : max(0, at + FIT_RUN - first)]
        first += len(part)
    return _bounded(sample), _bounded(run)


def _bounded(words: list[str]) -> list[str]:
    """Words up to FIT_CHARS characters in all; the one that goes beyond is cut."""
    out, left = [], FIT_CHARS
    for w in words:
        if left <= 0:
            break
        out.append(w[:left])
        left -= len(w)
    return out


def train_machine(x: list[Sparse], y: np.ndarray, cost: float = 40.0, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """A linear support vector machine (hinge loss) by dual coordinate descent; the last weight is of a constant 1. y: -1 or 1."""
    rng = np.random.default_rng(seed)
    w, constant, alpha = np.zeros(GRAMS, np.float32), 0.0, np.zeros(len(x))
    norms = np.array([float(v @ v) + 1 for _, v in x])
    most = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            places, values = x[i]
            slope = y[i] * (float(values @ w[places]) + constant) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[places] += np.float32(step) * values
                constant += step
                alpha[i] = new
    return np.append(w, np.float32(constant))


@dataclass
class Contest:
    """One-versus-one machines between classes; the columns of the machines' values, and the logistic function of the margin."""

    classes: list
    pairs: list[tuple[int, int]]
    columns: list[int]
    slope: tuple[float, float] = (4.0, 0.0)

    def decide(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner and its least margin for each row of values."""
        n, k = len(values), len(self.classes)
        if k == 1:
            return np.zeros(n, int), np.full(n, np.inf)
        votes, sums, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for (a, b), c in zip(self.pairs, self.columns, strict=True):
            m = values[:, c]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            sums[:, a] += m
            sums[:, b] -= m
            least[:, a] = np.minimum(least[:, a], m)
            least[:, b] = np.minimum(least[:, b], -m)
        won = (votes + np.tanh(sums) / (2 * k)).argmax(axis=1)
        return won, least[np.arange(n), won]

    def confidence(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope[0] * margins + self.slope[1], -30, 30)))


@dataclass
class Languages:
    """Fitted machines: weights by n-gram (the last row is constant), and the contests of families and within each."""

    weights: np.ndarray
    families: Contest
    within: list[Contest]

    def values(self, words: list[str]) -> np.ndarray:
        """Each machine's part of a word, and whether it holds a letter."""
        found = [grams(w) for w in words]
        sizes = [len(g) for g in found]
        flat = self.weights[np.fromiter(itertools.chain.from_iterable(found), np.int64, sum(sizes))]
        sums = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        letters = np.array([any(map(str.isalpha, w)) for w in words], np.float32)
        return np.hstack([sums / np.array(sizes, np.float32)[:, None] + self.weights[-1], letters[:, None]])

    def decide(self, values: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of mean values."""
        first, margin = self.families.decide(values)
        languages, scores = [""] * len(values), self.families.confidence(margin)
        for f, contest in enumerate(self.within):
            own = np.flatnonzero(first == f)
            second, margin = contest.decide(values[own])
            scores[own] *= contest.confidence(margin)
            for i, k in zip(own, second, strict=True):
                languages[i] = contest.classes[k]
        return languages, scores


def fit(texts: list[str], languages: list[str], seed: int = 11) -> Languages | None:
    """Fits machines on labelled texts; besides each whole text, a few of its words count as a text, as many texts are short."""
    return fit_excerpts([excerpts(t, seed) for t in texts], languages)


def fit_excerpts(drawn: list[tuple[list[str], list[str]]], languages: list[str]) -> Languages | None:
    """fit() from what excerpts() draws of each text. Rows are kept sparse, so memory goes by the words of the sample."""
    x, labels, aside = [], [], []
    for k, (parts, language) in enumerate(zip(drawn, languages, strict=True)):
        for part in parts:
            if part:
                x.append(vector(part))
                labels.append(language)
                aside.append(k % 5 == 4)
    if not x:
        return None
    scale = np.zeros(GRAMS)
    for places, values in x:
        scale[places] += values
    scale = (1 / np.sqrt(scale / len(x) + 1e-5)).astype(np.float32)
    x = [(places, values * scale[places]) for places, values in x]
    labels, aside = np.array(labels), np.array(aside)
    known = sorted(set(labels))
    by_family = defaultdict(list)
    for language in known:
        by_family[family_of(language)].append(language)
    names = sorted(by_family)
    weights: list[np.ndarray] = []

    def contest(classes: list, of: np.ndarray) -> Contest:
        pairs, columns = list(itertools.combinations(range(len(classes)), 2)), []
        own = [of == c for c in classes]
        for a, b in pairs:
            pick = (own[a] | own[b]) & ~aside
            if not (own[a] & pick).any() or not (own[b] & pick).any():
                pick = own[a] | own[b]
            columns.append(len(weights))
            weights.append(train_machine([x[i] for i in np.flatnonzero(pick)], np.where(own[a][pick], 1, -1)))
        made = Contest(list(classes), pairs, columns)
        test = np.logical_or.reduce(own) & aside
        if pairs and test.any():
            stacked = np.stack(weights[columns[0] :]).T
            values = np.stack([v @ stacked[p] + stacked[-1] for p, v in (x[i] for i in np.flatnonzero(test))])
            won, margin = Contest(made.classes, pairs, list(range(len(pairs)))).decide(values)
            right = np.array(classes)[won] == of[test]
            made.slope = _calibrated(margin, right)
        return made

    families = contest(names, np.array([family_of(v) for v in labels]))
    within = [contest(by_family[f], labels) for f in names]
    stacked = np.stack(weights).T if weights else np.zeros((GRAMS + 1, 1), np.float32)
    stacked[:-1] *= scale[:, None]
    return Languages(stacked.astype(np.float32), families, within)


def _calibrated(margin: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic function of the margin, with a prior of slope 3 (separable data give no bound)."""
    w = np.array([3.0, 1.0])
    x, y = np.stack([margin, np.ones(len(margin))], axis=1), right.astype(float)
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
        w += np.linalg.solve(h, x.T @ (y - p) - (w - [3.0, 1.0]))
    return max(0.5, float(w[0])), float(w[1])


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = FIT_ROWS) -> tuple[list[tuple[list[str], list[str]]], list[str]]:
    """Excerpts of at most about `rows` texts of every language (one at least), outside the held-out class."""
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    # Texts without letters teach nothing, so they don't count.
    own = own.filter(F.col("_lang").isNotNull() & F.col("_text").rlike(LETTER) & (crc_class("_id", 4) != 2)).withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(1_000_000)))
    counts = own.groupBy("_lang").agg(F.count("*").alias("n"), F.min("_part").alias("least")).collect()
    if not counts:
        return [], []
    rows = min(rows, max(LEAST_ROWS, FIT_ALL // len(counts)))
    shares = [(r["_lang"], max(int(np.ceil(min(1.0, rows / r["n"]) * 1_000_000)), r["least"] + 1)) for r in counts]
    shares = docs.sparkSession.createDataFrame(shares, "_lang string, _share long")
    picked = own.join(F.broadcast(shares), "_lang").filter("_part < _share").select("_text", "_lang")

    def draw(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).to_pylist()
        drawn = [excerpts(t) for t in texts]
        order = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts]
        words = pa.list_(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in drawn], words), pa.array([d[1] for d in drawn], words), pa.array(order, pa.int64()), batch.column(1)], ["sample", "run", "at", "lang"])

    found = map_arrow(picked, draw, "sample array<string>, run array<string>, at long, lang string").toArrow().sort_by([("at", "ascending"), ("lang", "ascending")])
    return list(zip(found["sample"].to_pylist(), found["run"].to_pylist(), strict=True)), found["lang"].to_pylist()


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages | None:
    return fit_excerpts(*labelled_sample(docs, id_col, text_col, lang_col))


def identify(docs: DataFrame, machines: Languages | None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Predicts every text's language: id_col, lang_pred, score; keep: all columns of docs besides (a clashing one isn't kept)."""
    held, key = docs.sparkSession.sparkContext.broadcast(machines), f"languages {uuid.uuid4().hex}"
    names = [c for c in docs.columns if c not in ("lang_pred", "score", text_col)] + [text_col] if keep else [id_col, text_col]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    out = names if keep else [id_col]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out) + ", lang_pred string, score double"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machines = held.value
        texts = batch.column(len(names) - 1).to_pylist()
        languages, scores = ["und"] * len(texts), np.zeros(len(texts))
        if machines is not None:
            table = kept(key, lambda: WordTable(machines.values, machines.weights.shape[1] + 1))
            means = np.zeros((len(texts), machines.weights.shape[1] + 1))
            for i, text in enumerate(texts):
                n = 0
                for words in words_of(text or ""):
                    if words:
                        for k in range(0, len(words), table.step):
                            means[i] += table.of(words[k : k + table.step]).sum(axis=0, dtype=np.float64)
                        n += len(words)
                means[i] /= max(1, n)
            lettered = np.flatnonzero(means[:, -1] > 0)
            if len(lettered):
                found, scores[lettered] = machines.decide(means[lettered])
                for i, language in zip(lettered, found, strict=True):
                    languages[i] = language
        columns = [batch.column(k) for k in range(len(out))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [*out, "lang_pred", "score"])

    return map_arrow(docs, run, schema)
