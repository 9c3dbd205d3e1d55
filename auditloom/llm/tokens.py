"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

The distinct words of a batch are inserted into a trie, and a depth-first walk hands each node the last
token of its prefix's encoding: the one token that ends there and that the merges would leave beside the last
token of the prefix before it. A prefix shared by many words is encoded once; a word's
tokens are read back from its end. Words in sorted order visit the trie depth first, so the walk
keeps only the current path.

Defined results: a null or empty text has no tokens (an empty list); strings of special tokens are
ordinary text; every text is encoded whole. No shuffle: each batch of texts is encoded where it is read.
The vocabulary file is read by the driver and broadcast (1.5 MB).
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("AUDITLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Words of up to so many bytes are kept for the next batches, up to so many words; a speed matter only.
KEEP_BYTES, KEEP_WORDS = 48, 300_000
# fixed value: the public pattern that splits text before the merges
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def _byte_letters() -> dict[str, int]:
    """The letters by which the vocabulary file writes bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Last-token states over byte prefixes."""

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)["model"]
        letters = _byte_letters()
        ids: dict[str, int] = model["vocab"]
        token_bytes = {t: bytes(letters[c] for c in t) for t in ids}
        top = max(ids.values()) + 1
        self.size = [0] * top
        self.parts: list[tuple[int, int] | None] = [None] * top
        self.rank: dict[tuple[int, int], int] = {}
        self.order = [0] * top  # a token's place among the merges; single bytes come before all
        for n, m in enumerate(model["merges"], 1):
            a, b = m if isinstance(m, list) else m.split(" ")
            made = ids[a + b]
            self.rank.setdefault((ids[a], ids[b]), n)
            if self.parts[made] is None:
                self.parts[made] = (ids[a], ids[b])
                self.order[made] = n
        for t, i in ids.items():
            self.size[i] = len(token_bytes[t])
        self._automaton({token_bytes[t]: i for t, i in ids.items() if len(t) == 1 or self.parts[i]})
        self.beside: dict[int, bool] = {}
        self.kept: dict[str, list[int]] = {}

    def _automaton(self, tokens: dict[bytes, int]) -> None:
        """goto and fail links; the longest token at a state, and the next shorter token that ends it."""
        goto: dict[int, int] = {}
        fail, longest = [0], [-1]
        level: list[tuple[int, bytes]] = []
        for word, i in tokens.items():
            s = 0
            for b in word:
                nxt = goto.get(s << 8 | b)
                if nxt is None:
                    nxt = goto[s << 8 | b] = len(fail)
                    fail.append(0)
                    longest.append(-1)
                s = nxt
            longest[s] = i
        children: dict[int, list[tuple[int, int]]] = {}
        for key, to in goto.items():
            children.setdefault(key >> 8, []).append((key & 255, to))
        shorter = [-1] * len(self.size)
        level = [(0, 0)]  # type: ignore[list-item]
        while level:
            below = []
            for s, _ in level:
                for b, to in children.get(s, ()):
                    if s:
                        f = fail[s]
                        while f and f << 8 | b not in goto:
                            f = fail[f]
                        fail[to] = goto.get(f << 8 | b, 0)
                    if longest[to] < 0:
                        longest[to] = longest[fail[to]]
                    else:
                        shorter[longest[to]] = longest[fail[to]]
                    below.append((to, b))
            level = below
        self.goto, self.fail, self.longest, self.shorter = goto, fail, longest, shorter

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side.

        The merges are undone from the latest one back; while the two sides' inner ends stand beside each
        other, no merge of them may come before the merge that hides one of them.
        """
        limit = 1 << 60
        while True:
            n = self.rank.get((left, right))
            if n is not None and n < limit:
                return False
            a, b = self.order[left], self.order[right]
            if a == 0 and b == 0:
                return True
            # of the two tokens the one made later is taken apart; while it was in parts, a merge
            # across the border wins if it ranks before it (the left one of equal ranks comes first)
            if a > b:
                limit, left = a, self.parts[left][1]
            else:
                limit, right = b + (1 if b else 0), self.parts[right][0]

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words."""
        goto, fail, longest, shorter, size, beside = self.goto, self.fail, self.longest, self.shorter, self.size, self.beside
        out: dict[str, list[int]] = {}
        states, last, before = [0], [-1], b""
        for word in sorted(words):
            w = word.encode("utf-8", "surrogatepass")
            n, shared = min(len(w), len(before)), 0
            if w[:n] == before[:n]:
                shared = n
            else:
                while w[shared] == before[shared]:
                    shared += 1
            del states[shared + 1 :], last[shared + 1 :]
            s = states[shared]
            for i in range(shared, len(w)):
                b = w[i]
                key = s << 8 | b
                while key not in goto and s:
                    s = fail[s]
                    key = s << 8 | b
                s = goto.get(key, 0)
                t = longest[s]
                while (j := i + 1 - size[t]) > 0:
                    pair = last[j] << 20 | t
                    ok = beside.get(pair)
                    if ok is None:
                        ok = beside[pair] = self.stay_apart(last[j], t)
                    if ok:
                        break
                    t = shorter[t]
                states.append(s)
                last.append(t)
            i, ids = len(w), []
            while i:
                t = last[i]
                ids.append(t)
                i -= size[t]
            ids.reverse()
            out[word] = ids
            before = w
        if len(beside) > 4_000_000:
            beside.clear()
        return out

    def texts(self, texts: list[str | None]) -> Iterator[list[list[int]]]:
        """For each text the ids of its words."""
        split = [WORDS.findall(t) if t else [] for t in texts]
        kept = self.kept
        if len(kept) > KEEP_WORDS:
            kept.clear()
        new = {w for ws in split for w in ws if w not in kept}
        made = self.encode(list(new))
        for w, ids in made.items():
            if len(w) <= KEEP_BYTES:
                kept[w] = ids
        for ws in split:
            yield [kept[w] if w in kept else made[w] for w in ws]


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> TrieEncoder:
    return TrieEncoder(vocabulary)


def _blocks(texts: list[str | None], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters, so that a batch of long texts takes no more memory."""
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars > most and i > start:
            yield start, i
            start, chars = i, len(t or "")
    if start < len(texts):
        yield start, len(texts)


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """key, ids: the token ids of each text."""
    with open(vocabulary_path, encoding="utf-8") as f:
        held = documents.sparkSession.sparkContext.broadcast(f.read())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(held.value)
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for i, j in _blocks(texts):
                flat, ends = array("q"), array("i", [0])
                for words in enc.texts(texts[i:j]):
                    for ids in words:
                        flat.extend(ids)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), ids], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(each, f"`{key}` {kind}, ids array<bigint>")


def count_tokens(documents: DataFrame, keep: list[str], text: str = "text", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """``keep`` and tokens: the size of each text in tokens of the same tokenizer."""
    with open(vocabulary_path, encoding="utf-8") as f:
        held = documents.sparkSession.sparkContext.broadcast(f.read())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(held.value)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            sizes: list[int] = []
            for i, j in _blocks(texts):
                sizes += [sum(map(len, words)) for words in enc.texts(texts[i:j])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    kinds = ", ".join(f"`{k}` {documents.select(k).schema[0].dataType.simpleString()}" for k in keep)
    return documents.select(*keep, F.col(text)).mapInArrow(each, f"{kinds}, tokens bigint")
