"""Pairs of titles that may be similar, found by comparing bits of all titles of one first letter.

Of two titles with la + lb characters and a ratio of at least t, at most u = (1-t)(la+lb) characters are outside the
longest common subsequence. So their letters' counts differ by at most u in all, and their sets of letter pairs by at most
3u. Both are kept as 256 bits a title, where titles differ in no more bits than that, whatever shares a bit; what is left is measured
by the length of the longest common subsequence itself, 64 letters at a time. No step loses a pair.

Inverted lists don't help here: titles made by one pattern share even their rarest parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Titles of one letter are divided by hash above ONE characters in all, into FEW parts for parallelism, or more where a part would have over PART of them.
ONE, FEW, PART = 400_000, 2, 2_500_000
WORDS = 4  # of 64 bits, for letters and for letter pairs each
ROWS, PAIRS = 1024, 32768  # titles coded, and pairs measured, at once

# letters, digits, underscore and blank have a code each, others share; 0 is beyond the end
_CODES = np.array([39 + i % 25 for i in range(128)], dtype=np.uint8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789_ ", 1):
    _CODES[ord(_c)] = _i


def _coded(titles: list[str]) -> np.ndarray:
    """A row of codes a title, padded by 0."""
    width = max(map(len, titles))
    u = np.array(titles, dtype=f"U{width}").view(np.uint32).reshape(len(titles), width)
    c = np.where(u < 128, _CODES[np.minimum(u, 127)], 39 + u % 25).astype(np.uint8)
    c[np.arange(width)[None, :] >= np.array([len(t) for t in titles])[:, None]] = 0
    return c


class _Titles:
    """Titles by length, with their codes and bits."""

    def __init__(self, keys: np.ndarray, titles: np.ndarray):
        n = np.array([len(t) for t in titles], dtype=np.int64)
        order = np.argsort(n, kind="stable")
        self.n, self.keys, self.titles = n[order], keys[order], titles[order]
        self.bits: list[np.ndarray] = []

    def codes(self, rows: np.ndarray) -> np.ndarray:
        return _coded([self.titles[i] for i in rows])

    def chunks(self) -> Iterator[tuple[slice, np.ndarray]]:
        for i in range(0, len(self.n), ROWS):
            at = slice(i, min(i + ROWS, len(self.n)))
            yield at, _coded(list(self.titles[at]))

    def counts(self) -> np.ndarray:
        out = np.zeros((64, len(self.n)), dtype=np.int32)
        for at, c in self.chunks():
            for x in np.unique(c):
                if x:
                    out[x, at] = (c == x).sum(axis=1)
        return out

    def pair_bits(self) -> list[np.ndarray]:
        out = np.zeros((len(self.n), WORDS), dtype=np.uint64)
        for at, c in self.chunks():
            here, rows = out[at], np.arange(c.shape[0])
            for p in range(c.shape[1] - 1):
                h = (c[:, p].astype(np.int64) * 64 + c[:, p + 1]) * 40503 % 65521 % (64 * WORDS)
                bit = np.where(c[:, p + 1] > 0, np.uint64(1) << (h % 64).astype(np.uint64), np.uint64(0))
                here[rows, h // 64] |= bit
        return [np.ascontiguousarray(out[:, w]) for w in range(WORDS)]


def _give_bits(sides: list[_Titles]) -> None:
    """One bit for each letter and number such that some titles have the letter so often and some don't, those that tell most first."""
    counts = [s.counts() for s in sides]
    total = sum(len(s.n) for s in sides)
    told = []
    for x in range(64):
        most = max(int(c[x].max(initial=0)) for c in counts)
        at_least = sum(np.cumsum(np.bincount(c[x], minlength=most + 1)[::-1])[::-1] for c in counts)
        told += [(-int(at_least[j]) * (total - int(at_least[j])), x, j) for j in range(1, most + 1) if at_least[j] < total]
    for s, c in zip(sides, counts):
        out = [np.zeros(len(s.n), dtype=np.uint64) for _ in range(WORDS)]
        for k, (_, x, j) in enumerate(sorted(told)):
            out[k // 64 % WORDS] |= (c[x] >= j).astype(np.uint64) << np.uint64(k % 64)
        s.bits = out + s.pair_bits()


def common(x: _Titles, y: _Titles, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of titles i of x and j of y (bits of x's titles, one addition a letter of y's)."""
    ui, at = np.unique(i, return_inverse=True)
    uj, to = np.unique(j, return_inverse=True)
    cx, cy = x.codes(ui), np.ascontiguousarray(y.codes(uj).T)
    words = -(-cx.shape[1] // 64)
    masks = np.zeros((words, len(ui) * 64), dtype=np.uint64)
    base = np.arange(len(ui)) * 64
    for p in range(cx.shape[1]):
        masks[p // 64, base + cx[:, p]] |= np.uint64(1 << p % 64)
    masks[:, base] = 0
    left = [np.full(len(i), 2**64 - 1, dtype=np.uint64) for _ in range(words)]
    base = at * 64
    for p in range(cy.shape[0]):
        here = base + cy[p][to]
        carry = None
        for w in range(words):
            v, m = left[w], masks[w][here]
            s = v + (v & m)
            over = s < v if w + 1 < words else None
            if carry is not None:
                s = s + carry
                over = over | (s < carry) if over is not None else None
            carry = over.astype(np.uint64) if over is not None else None
            left[w] = s | (v & ~m)
    return sum(64 - np.bitwise_count(v).astype(np.int64) for v in left)


def _differ(x: _Titles, y: _Titles, i: np.ndarray, j: np.ndarray, words: range) -> np.ndarray:
    return sum(np.bitwise_count(y.bits[w][j] ^ x.bits[w][i]).astype(np.int64) for w in words)


def _near(x: _Titles, y: _Titles, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and of y that differ in few enough bits, in batches; each pair once where both are the same titles."""
    firsts = np.arange(1, len(x.n) + 1) if same else np.searchsorted(y.n, x.n * threshold / (2 - threshold) - 1e-6)
    lasts = np.searchsorted(y.n, x.n * (2 - threshold) / threshold + 1e-6, side="right")
    y0, y1 = y.bits[:2]
    n, waiting, held = -1, [], 0

    def batch() -> tuple[np.ndarray, np.ndarray]:
        i, j = np.repeat([i for i, _ in waiting], [len(j) for _, j in waiting]), np.concatenate([j for _, j in waiting])
        limit = np.floor((1 - threshold) * (x.n[i] + y.n[j]) + 1e-6)
        ok = _differ(x, y, i, j, range(WORDS)) <= limit
        i, j, limit = i[ok], j[ok], limit[ok]
        ok = _differ(x, y, i, j, range(WORDS, 2 * WORDS)) <= 3 * limit
        return i[ok], j[ok]

    for i, (first, last) in enumerate(zip(firsts.tolist(), lasts.tolist())):
        if first >= last:
            continue
        if n != x.n[i]:
            n = int(x.n[i])
            # two words have 128 bits, so a limit of 255 is none
            limit = np.minimum(255, np.floor((1 - threshold) * (n + y.n) + 1e-6)).astype(np.uint8)
        # two words first, those of the bits that tell most
        d = np.bitwise_count(y0[first:last] ^ x.bits[0][i])
        d += np.bitwise_count(y1[first:last] ^ x.bits[1][i])
        j = np.flatnonzero(d <= limit[first:last])
        if len(j):
            waiting.append((i, j + first))
            held += len(j)
            if held >= 8 * PAIRS:
                yield batch()
                waiting, held = [], 0
    if waiting:
        yield batch()


def block_pairs(block: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """a, b: keys (a < b) of block(key, t, part, lo, hi) whose titles' longest common subsequence allows the threshold; titles of part lo with those of part hi."""
    lo, hi = block["lo"].iat[0], block["hi"].iat[0]
    sides = [_Titles(s["key"].to_numpy(dtype=object), s["t"].to_numpy(dtype=object)) for s in ([block] if lo == hi else [block[block["part"] == p] for p in (lo, hi)])]
    a, b = [], []
    if all(len(s.n) for s in sides):
        _give_bits(sides)
        x, y = sides[0], sides[-1]
        for near in _near(x, y, lo == hi, threshold):
            # long titles, fewer at once
            step = max(1, PAIRS // max(1, -(-int(max(x.n[-1], y.n[-1])) // 64)))
            for k in range(0, len(near[0]), step):
                i, j = (z[k : k + step] for z in near)
                # the ratio's own arithmetic
                ok = 2.0 * common(x, y, i, j) / (x.n[i] + y.n[j]) >= threshold
                for p, q in zip(x.keys[i[ok]], y.keys[j[ok]]):
                    if p != q:
                        a.append(min(p, q))
                        b.append(max(p, q))
    return pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})


def candidates(items: DataFrame, key: str, threshold: float) -> DataFrame:
    """a, b (a < b): keys of items(key, t) of one first letter whose titles have a common subsequence as long as ``threshold`` asks for; every pair as similar is among them."""
    rows = items.where(F.col(key).isNotNull() & (F.length("t") > 0)).select(F.col(key).cast("string").alias("key"), "t", F.substring("t", 1, 1).alias("first"))
    most = rows.groupBy("first").agg(F.sum(F.length("t")).alias("n")).agg(F.max("n").alias("n")).select(F.when(F.col("n") <= ONE, 1).otherwise(F.greatest(F.lit(FEW), F.ceil(F.col("n") / PART))).cast("long").alias("n")).scalar()
    parted = rows.withColumn("parts", most).withColumn("part", F.pmod(F.xxhash64("t", "key"), F.col("parts")))
    copies = parted.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("first", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"), "part", "key", "t")
    # by number: few bytes here are much work, so the engine must not put them into fewer tasks
    tasks = max(64, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = copies.repartition(tasks, "first", "lo", "hi").groupBy("first", "lo", "hi").applyInPandas(lambda block: block_pairs(block, threshold), "a string, b string")
    return pairs.distinct()
