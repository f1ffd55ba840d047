"""BPE encoding and decoding by a trie of words whose prefixes are encoded once.

For a byte-pair encoding, the encoding of a prefix of a word is fixed by its *last token* alone: take the
last token off, and what is left is the encoding of the shorter prefix. A token may stand last exactly if it is a
suffix of the prefix, and the boundary between it and the last token of what is left survives all merges of
both. So the operator inserts the distinct words of a step into a trie and walks it depth first; every node gets
its last token from the nodes above it, and words that share a prefix share that work. Encodings are read off by
following last tokens upwards.

Null texts count as empty; an empty text has no ids. Texts of any length are encoded whole. The input needs no
shuffle; a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import STEP_CHARS, Generations, kept, map_arrow

#: Bytes of white-space-free pieces with their encodings that a worker keeps, about.
KEPT_BYTES = 64 << 20
#: Most token pairs whose boundary test a worker keeps (about 100 bytes each).
KEPT_PAIRS = 250_000
#: Most distinct words in a trie at once.
TRIE_WORDS = 20_000

# What the normalizer calls white space (Unicode White_Space); str.split() also takes U+001C to U+001F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_END = "</w>"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(moved)) for b in range(256)]


class WordBpe:
    """An encoder and decoder for a BPE vocabulary with word ends, given as the JSON of the tokenizers library."""

    def __init__(self, source: bytes | str):
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != _END or model.get("byte_fallback") or spec.get("decoder"):
            raise ValueError("only byte-level BPE with word ends and without a decoder is supported")
        alphabet = byte_alphabet()
        back = {c: chr(b) for b, c in enumerate(alphabet)}
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"])
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Tokens by their bytes (one character a byte), those that end a word apart.
        self._inner: dict[str, int] = {}
        self._final: dict[str, int] = {}
        rank: dict[int, int] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self._merge: dict[int, int] = {}
        reachable = {vocab[c] for c in alphabet if c in vocab} | {vocab[c + _END] for c in alphabet if c + _END in vocab}
        if len(reachable) != 512:
            raise ValueError("the vocabulary must hold all bytes, each with and without a word end")
        for r, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self._merge[left << 32 | right] = r
            if made not in rank:
                rank[made] = r
                self._halves[made] = (left, right)
                reachable.add(made)
        self._rank = rank
        for token in reachable:
            text = self.text_of[token]
            ends = text.endswith(_END)
            (self._final if ends else self._inner)["".join(back[c] for c in (text[: -len(_END)] if ends else text))] = token
        self._starts = {s[:k] for tokens in (self._inner, self._final) for s in tokens for k in range(1, len(s) + 1)}
        self._size = {t: len(s) for tokens in (self._inner, self._final) for s, t in tokens.items()}
        self._holds: dict[int, bool] = {}
        self._pieces = Generations(KEPT_BYTES, 320, 8)

    def _boundary_holds(self, left: int, right: int, until: int = 1 << 40) -> bool:
        """Whether no merge before `until` crosses the boundary between two adjacent tokens, when their merges are undone latest first."""
        key = left << 32 | right
        if until == 1 << 40 and (known := self._holds.get(key)) is not None:
            return known
        rank, halves, merge = self._rank, self._halves, self._merge
        a, b, limit, holds = left, right, until, True
        while True:
            if merge.get(a << 32 | b, limit) < limit:
                holds = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                limit, a = ra, halves[a][1]
            else:  # of equal merges, the left one comes first
                limit, b = rb + 1, halves[b][0]
        if until == 1 << 40:
            if len(self._holds) >= KEPT_PAIRS:
                self._holds.clear()
            self._holds[key] = holds
        return holds

    def _whole(self, token: int) -> bool:
        """Whether a token's own text is encoded as this token: no earlier merge crosses the boundary of its halves."""
        if (halves := self._halves.get(token)) is None:
            return True
        key = -1 << 32 | token
        if (known := self._holds.get(key)) is None:
            known = self._whole(halves[0]) and self._whole(halves[1]) and self._boundary_holds(*halves, self._rank[token])
            self._holds[key] = known
        return known

    def _stands(self, left: int, token: int) -> bool:
        """Whether a token may follow the last token of a shorter prefix (-1: the empty one)."""
        return self._whole(token) if left < 0 else self._boundary_holds(left, token)

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The ids of distinct words (one character a byte), by a depth-first walk of their trie.

        The trie is laid out depth first: sorted words, of which each begins at the node where it leaves the one
        before. states holds the last tokens on the path from the root, so that of a shared prefix is found once;
        spans holds the length of the longest suffix of each prefix with which a token begins.
        """
        out: dict[str, list[int]] = {}
        states, spans, before, known = [-1], [0], "", 0
        inner, final, size, starts, holds = self._inner, self._final, self._size, self._starts, self._holds
        for word in sorted(words):
            n = len(word)
            depth, most = 0, min(known, n - 1)
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del states[depth + 1 :], spans[depth + 1 :]
            tokens = inner
            while True:
                depth += 1
                if depth == n:
                    tokens = final
                span = spans[-1] + 1
                while word[depth - span : depth] not in starts:
                    span -= 1
                for start in range(depth - span, depth):
                    if (token := tokens.get(word[start:depth])) is not None:
                        left = states[start]
                        if (fits := holds.get(left << 32 | token)) is None:
                            fits = self._stands(left, token)
                        if fits:
                            break
                else:
                    raise ValueError("no token fits")
                if depth == n:
                    break
                states.append(token)
                spans.append(span)
            before, known = word, n - 1
            ids, at = [token], n - size[token]
            while at:
                ids.append(token := states[at])
                at -= size[token]
            ids.reverse()
            out[word] = ids
        return out

    def _normal_words(self, piece: str) -> list[str]:
        """The words of a piece without white space, one character a byte."""
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        piece = piece.lower()
        if piece.isalpha():
            words = [piece]
        else:
            words = [w for part in _SPACE.split(piece) for w in self._words.findall(part)]
        return words if piece.isascii() else [w.encode("utf-8", "surrogatepass").decode("latin-1") for w in words]

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes and decodes distinct pieces that aren't kept yet, a bounded trie at a time."""
        waiting: dict[str, list[str]] = {}
        words: set[str] = set()
        for piece in self._pieces.absent(pieces):
            waiting[piece] = own = self._normal_words(piece)
            words.update(own)
            if len(words) >= TRIE_WORDS:
                self._settle(waiting, words)
                waiting, words = {}, set()
        self._settle(waiting, words)

    def _settle(self, waiting: dict[str, list[str]], words: set[str]) -> None:
        found = self.encode_words(words)
        for piece, own in waiting.items():
            ids = [i for w in own for i in found[w]]
            self._pieces.put(piece, (pack(ids), self.decode(ids)))

    def pieces(self, text: str) -> list[str | int]:
        """A text's white-space-free pieces in order; special tokens as their ids."""
        if self._specials is None or "<" not in text:
            return self._split(text)
        out: list[str | int] = []
        for k, part in enumerate(self._specials.split(text)):
            if k % 2:
                out.append(self.special[part])
            else:
                out.extend(self._split(part))
        return out

    @staticmethod
    def _split(text: str) -> list[str]:
        return [p for p in _SPACE.split(text) if p] if _ODD_SPACE.search(text) else text.split()

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text."""
        return unpack(b"".join(ids for ids, _ in self.packed(text or "")))

    def packed(self, text: str) -> list[tuple[bytes, str]]:
        """Packed ids and decoded text of each piece."""
        return next(self.packed_all([text]))

    def packed_all(self, texts: list[str]) -> Iterator[list[tuple[bytes, str]]]:
        """Packed ids and decoded text of each piece of each text; what is new in some texts is learnt in one go."""
        at = 0
        while at < len(texts):
            step, size = [], 0
            while at < len(texts) and (not step or size + len(texts[at]) <= STEP_CHARS):
                step.append(self.pieces(texts[at]))
                size += len(texts[at])
                at += 1
            self.learn({p for own in step for p in own if type(p) is str})
            kept = self._pieces
            for own in step:
                yield [kept[p] if type(p) is str else (pack([p]), self.text_of[p]) for p in own]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a space, as the library does where the file names no decoder; special tokens stay."""
        text_of = self.text_of
        return " ".join(text_of[i] for i in ids if i in text_of)


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    data = array("I", ids)
    if sys.byteorder == "big":
        data.byteswap()
    return data.tobytes()


def unpack(data: bytes) -> list[int]:
    """The ids that pack() was given."""
    ids = array("I", data)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tolist()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encodes and decodes every text: id_col, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids (array of int), with_text adds decoded.

    vocabulary: path of a tokenizers JSON that the driver can read; its bytes (a few MB, bound to 64 MB) are broadcast.
    Null text: empty, 0 tokens. Repeated rows and null ids are kept as they are. Other columns are not read.
    """
    with open(vocabulary, "rb") as f:
        source = f.read()
    if len(source) > 64 << 20:
        raise ValueError("a vocabulary of more than 64 MB isn't broadcast")
    WordBpe(source)
    held, key = docs.sparkSession.sparkContext.broadcast(source), f"bpe {hashlib.sha256(source).hexdigest()}"
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = kept(key, lambda: WordBpe(held.value))
        n, ids_hash, text_hash, all_ids, decoded = [], [], [], [], []
        for parts in bpe.packed_all([t or "" for t in batch.column(1).to_pylist()]):
            data = b"".join([p[0] for p in parts])
            back = " ".join([p[1] for p in parts])
            n.append(len(data) // 4)
            ids_hash.append(hashlib.sha256(data).hexdigest())
            text_hash.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
            if with_ids:
                all_ids.append(data)
            if with_text:
                decoded.append(back)
        columns = {id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
        if with_ids:
            values = pa.array(np.frombuffer(b"".join(all_ids), "<i4"), pa.int32())
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), values)
        if with_text:
            columns["decoded"] = pa.array(decoded, pa.string())
        return pa.RecordBatch.from_pydict(columns)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, schema)
