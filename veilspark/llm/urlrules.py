"""Host and path rules over URLs by a bit-parallel wildcard automaton.

Each rule becomes two glob patterns over `host + "/" + path` (no host holds a slash): its host as it is, and its host below any subdomain; what
follows its path is free. A rule may hold wildcards itself. All patterns are
packed into one Shift-And automaton of as many 64-bit words as they need: a bit for each pattern position, a mask for each byte
value, and a mask of the positions that a wildcard lets stay. A batch of URLs steps through it together, so
every URL costs the same for one rule or thousands, up to the width of the masks.

`*` stands for bytes other than `/`, `**` for any bytes. Of the rules that fit, the one with the longest host and path wins
(longest host of equal ones; then the first). Null URLs and those without `://` have an empty host and path.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import kept, map_arrow

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block; text: host and path, as in `example.com/en/`, either with wildcards or not; without a path, any path fits."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].translate(str.maketrans(_UPPER, _LOWER))

    @property
    def path(self) -> str:
        return self.text[len(self.text.partition("/")[0]) :]


def canonical(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    # A ? or # right after the host leaves no path.
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


class Globs:
    """Many glob patterns as one Shift-And automaton."""

    def __init__(self, patterns: Sequence[str]):
        positions, stays, self.ends, firsts = [], [], [], []
        for pattern in patterns:
            data, k = pattern.encode(), 0
            firsts.append(len(positions))
            positions.append(None)  # the start: nothing read yet
            stays.append("")
            while k < len(data):
                if data[k : k + 2] == b"**":
                    stays[-1] = "all"
                    k += 2
                elif data[k : k + 1] == b"*":
                    stays[-1] = stays[-1] or "segment"
                    k += 1
                else:
                    positions.append(data[k])
                    stays.append("")
                    k += 1
            self.ends.append(len(positions) - 1)
        self.words = -(-max(1, len(positions)) // 64)
        self.first = self._mask(firsts)
        self.byte = np.zeros((256, self.words), np.uint64)
        for k, b in enumerate(positions):
            if b is not None:
                self.byte[b, k // 64] |= np.uint64(1 << k % 64)
        self.stay = np.tile(self._mask([k for k, s in enumerate(stays) if s]), (256, 1))
        self.stay[ord("/")] = self._mask([k for k, s in enumerate(stays) if s == "all"])

    def _mask(self, bits: Sequence[int]) -> np.ndarray:
        mask = np.zeros(self.words, np.uint64)
        for k in bits:
            mask[k // 64] |= np.uint64(1 << k % 64)
        return mask

    def match(self, urls: list[bytes]) -> np.ndarray:
        """[urls, patterns]: which patterns match each whole URL."""
        n = len(urls)
        lengths = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order] if n else np.zeros(0, np.int64)
        data, lengths = np.frombuffer(b"".join(urls), np.uint8), lengths[order]
        state = np.tile(self.first, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for at in range(int(lengths[0]) if n else 0):
            while lengths[live - 1] <= at:
                live -= 1
            c = data[starts[:live] + at]
            s = state[:live]
            moved = s << one
            if self.words > 1:
                moved[:, 1:] |= s[:, :-1] >> top
            state[:live] = (moved & self.byte[c]) | (s & self.stay[c])
        out = np.empty((n, len(self.ends)), bool)
        for p, k in enumerate(self.ends):
            out[order, p] = (state[:, k // 64] >> np.uint64(k % 64)) & one
        return out


def judge(df: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id_col, host, path, rule and verdict of every URL; a URL that no rule fits gets the default."""
    ranked = sorted(rules, key=lambda r: (-len(r.host) - len(r.path), -len(r.host)))
    patterns = [p for r in ranked for p in (f"{r.host}/{r.path}**", f"*.{r.host}/{r.path}**")]
    key = f"globs {patterns}"
    host, path = canonical(F.col(url_col))
    rows = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        # A `*` within a host or path of the URL is an ordinary byte of it.
        urls = [f"{h}/{p}".encode("utf-8", "surrogatepass") for h, p in zip(hosts, paths, strict=True)]
        globs = kept(key, lambda: Globs(patterns))
        fits = globs.match(urls).reshape(len(urls), len(ranked), 2).any(axis=2) if ranked else np.zeros((len(urls), 0), bool)
        first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if ranked else np.full(len(urls), -1)
        rule = [ranked[k].text if k >= 0 else None for k in first]
        verdict = [ranked[k].verdict if k >= 0 else default for k in first]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [id_col, "host", "path", "rule", "verdict"])

    return map_arrow(rows, run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
