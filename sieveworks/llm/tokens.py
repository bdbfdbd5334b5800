"""Encoding with a public byte-level BPE tokenizer by monoid tree reduction.

A text is halved until its pieces are short, the pieces are encoded, and
neighbours are joined up the tree. A join keeps both sides' tokens but for a
window around the seam, which is encoded anew and grows until it reaches a
place on each side where the tokens beyond provably stay: where blank space
follows something else. The tokenizer's pattern starts a new piece there
whatever comes before or after, as no piece holds blanks behind other
characters, and it is matched from left to right without memory. Without such a
place the window takes in the whole side.

Strings of special tokens are ordinary text. Null and empty texts have no
tokens. Ids are those of the vocabulary file, whose path is a parameter.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of the pieces that are encoded without halving, and of the first window.
LEAF, WINDOW = 4096, 64
#: Characters encoded at once.
SHIPPED = 1 << 21

_SEAM = re.compile(r"(?<=\S)\s")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def _load(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        width[rank] = len(token)
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), width


class Tree:
    """Encodes texts; ``path`` names the vocabulary file."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.encoding, self.width = _load(path)
        self.leaf = max(2, leaf)

    def _flat(self, texts: list[str]) -> list[list[int]]:
        return self.encoding.encode_ordinary_batch(texts, num_threads=1)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        leaves, spans = [], []
        for t in texts:
            n = 1
            while len(t) > n * self.leaf:
                n *= 2
            cuts = [len(t) * i // n for i in range(n + 1)]
            spans.append((len(leaves), cuts))
            leaves += [t[a:b] for a, b in zip(cuts, cuts[1:])]
        ids = [np.array(x, np.int32) for x in self._flat(leaves)]
        out = []
        for t, (at, cuts) in zip(texts, spans):
            parts = [(cuts[i], cuts[i + 1], ids[at + i]) for i in range(len(cuts) - 1)]
            while len(parts) > 1:
                parts = [self._join(t, parts[i], parts[i + 1]) for i in range(0, len(parts), 2)]
            out.append(parts[0][2])
        return out

    def _join(self, text: str, left: tuple, right: tuple) -> tuple:
        (lo, mid, a), (_, hi, b) = left, right
        x = self._seam(text, lo, mid, -1)
        y = self._seam(text, mid, hi, 1)
        window = np.array(self._flat([text[x:y]])[0], np.int32) if y > x else np.zeros(0, np.int32)
        kept = self._before(a, len(text[x:mid].encode()), behind=True)
        left_on = self._before(b, len(text[mid:y].encode()), behind=False)
        return lo, hi, np.concatenate([a[:kept], window, b[left_on:]])

    def _before(self, ids: np.ndarray, n_bytes: int, behind: bool) -> int:
        """Number of tokens before the place n_bytes from the end (behind) or from the start."""
        if not n_bytes:
            return len(ids) if behind else 0
        look = min(len(ids), n_bytes)
        part = self.width[ids[len(ids) - look :][::-1] if behind else ids[:look]]
        k = int(np.searchsorted(np.cumsum(part), n_bytes)) + 1
        return len(ids) - k if behind else k

    @staticmethod
    def _seam(text: str, lo: int, hi: int, side: int) -> int:
        """The seam nearest to the joint: the last in (lo, hi) for the left side, the first for the right."""
        size = WINDOW
        while True:
            a, b = (max(lo, hi - size), hi) if side < 0 else (lo, min(hi, lo + size))
            # the characters at both ends of a side aren't seams, as their other neighbour isn't known to it
            found = [m.start() for m in _SEAM.finditer(text, max(a, lo + 1) - 1 if a > lo else a, b) if lo < m.start() < hi]
            if found:
                return found[-1] if side < 0 else found[0]
            if (side < 0 and a == lo) or (side > 0 and b == hi):
                return lo if side < 0 else hi
            size *= 2


def decode(ids: list[int], path: str) -> str:
    """The text of token ids: their bytes on end."""
    return _load(path)[0].decode_bytes(ids).decode("utf-8", "replace")


def _groups(texts: list[str | None]) -> Iterator[range]:
    """Runs of texts of a bounded size together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SHIPPED:
            yield range(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def encoded(docs: DataFrame, record_id: str, column: str, path: str | None = None) -> DataFrame:
    """(record_id, ids) of each text, in ids of the vocabulary."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in _groups(texts):
                ids = tree.encode([texts[i] or "" for i in at])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at.start, len(at)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["record_id", "ids"])

    kind = docs.schema[record_id].dataType.simpleString()
    return docs.select(docs[record_id].alias("record_id"), docs[column].cast("string")).mapInArrow(run, f"record_id {kind}, ids array<int>")


def sizes(docs: DataFrame, record_id: str, column: str, keep: list[str], path: str | None = None, back: bool = False) -> DataFrame:
    """(record_id, keep.., n_tokens, same): token counts, and if asked whether decoding gives the text back, else null."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n, same = [], []
            for at in _groups(texts):
                part = [texts[i] or "" for i in at]
                for t, ids in zip(part, tree.encode(part)):
                    n.append(len(ids))
                    same.append(tree.encoding.decode_bytes(ids.tolist()) == t.encode() if back else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(n, pa.int64()), pa.array(same, pa.bool_())], ["record_id", *b.schema.names[2:], "n_tokens", "same"])

    cols = [docs[record_id].alias("record_id"), docs[column].cast("string").alias("_text"), *[docs[k] for k in keep]]
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(cols).mapInArrow(run, f"record_id {docs.schema[record_id].dataType.simpleString()}, {kinds + ', ' if keep else ''}n_tokens long, same boolean")
