"""Garbled text from a wrong character encoding, found by a hidden Markov model.

The model has one clean state and one state per encoding pair (the encoding the
bytes were in, the one they were read in). It emits characters given the block
of the character before. The clean state is fitted on all texts that don't look
garbled, the others on the same texts put through their pair's error. Viterbi
labels each character; each labelled span is put through the inverse of its
state's error. A span that lost bytes stays unrestored.

Plain ASCII texts, null, empty and blank ones are never garbled. Fits use every
row; the fitted table is bounded by states x blocks x characters in use.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoding pairs (true, read as); the third member is how often the error was made.
PAIRS = [
    ("utf-8", "cp1252", 1),
    ("utf-8", "latin-1", 1),
    ("utf-8", "cp437", 1),
    ("utf-8", "cp850", 1),
    ("utf-8", "mac_roman", 1),
    ("utf-8", "cp949", 1),
    ("utf-8", "cp1251", 1),
    ("utf-8", "cp1252", 2),
    ("utf-8", "latin-1", 2),
    ("cp1252", "utf-8", 1),
    ("cp1252", "cp1251", 1),
    ("cp1251", "cp1252", 1),
    ("cp949", "utf-8", 1),
    ("cp949", "cp1252", 1),
]
#: Log chance to enter a garbled state, to stay, to leave.
ENTER, STAY, LEAVE = np.log(1e-4), np.log(0.95), np.log(0.05)
SMOOTH = 0.5
LOST = "�"

#: Character blocks by their first code point.
_EDGES = np.array([0, 0x20, 0x21, 0x30, 0x3A, 0x41, 0x5B, 0x61, 0x7B, 0x80, 0xA0, 0xC0, 0x100, 0x370, 0x400, 0x530, 0x1100, 0x1200, 0x2000, 0x2200, 0x3000, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFFFD, 0xFFFE])
#: Blocks of those ranges: space 1, digit 2, ASCII mark 3, letter 4, C1 5, Latin-1 mark 6, letter 7, ...
_BLOCK = np.array([3, 1, 3, 2, 3, 4, 3, 4, 3, 5, 6, 7, 8, 9, 10, 17, 15, 17, 11, 12, 13, 14, 17, 15, 17, 14, 17, 16, 17])
N_BLOCKS = 18
_SIZE = np.array([1, 40, 10, 40, 52, 32, 32, 64, 600, 150, 300, 500, 3500, 1000, 25000, 11500, 1, 60000], float)


def blocks(points: np.ndarray) -> np.ndarray:
    return _BLOCK[np.searchsorted(_EDGES, points, side="right") - 1]


def _decode(data: bytes, encoding: str, errors: str) -> str:
    if encoding == "cp1252" and errors != "replace":
        return data.decode("cp1252", "surrogateescape").translate(_C1)
    return data.decode(encoding, errors)


def _encode(text: str, encoding: str) -> bytes:
    if encoding == "cp1252":
        return b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" else c.encode("cp1252") for c in text)
    return text.encode(encoding)


#: The five bytes that code page 1252 leaves open are read as control characters.
_C1 = {0xDC00 + b: chr(b) for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def garble(text: str, pair: tuple[str, str, int], errors: str = "strict") -> str | None:
    """text after the pair's error, or None if it can't happen to it."""
    true, read, times = pair
    try:
        for _ in range(times):
            text = _decode(text.encode(true), read, errors)
    except ValueError:
        return None
    return text


def restore(span: str, pair: tuple[str, str, int]) -> str | None:
    """The text a garbled span was, or None if bytes were lost."""
    true, read, times = pair
    if LOST in span:
        return None
    try:
        for _ in range(times):
            span = _encode(span, read).decode(true)
    except ValueError:
        return None
    return span


_ODD = re.compile("[\x80-\x9f]|[\x80-\xff]{3}|[A-Za-z][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z]")


def looks_garbled(text: str) -> bool:
    """Signs that keep a text out of the clean state's fit.

    Lost bytes, control characters, three Latin-1 characters in a row, Latin
    and Cyrillic letters in one word, a run that reads as UTF-8 under a one-byte
    encoding, or most runs reading so under a two-byte one, where single words
    may do so by chance.
    """
    if LOST in text or _ODD.search(text):
        return True
    runs = [r for r in "".join(c if c > "\x7f" else " " for c in text).split() if len(r) > 1]
    for p in PAIRS:
        if p[0] == "utf-8" and p[2] == 1:
            hits = sum(len(r) for r in runs if restore(r, p) not in (None, r))
            if hits and (p[1] != "cp949" or 2 * hits > sum(map(len, runs))):
                return True
    return False


def _points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return flat, np.array([len(t) for t in texts])


def _counts(texts: Sequence[str], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes block-before << 21 | character, and their weighted counts."""
    flat, size = _points(texts)
    b = blocks(flat)
    before = np.concatenate([[0], b[:-1]]) if len(b) else b
    starts = np.cumsum(size) - size
    before[starts[(size > 0)]] = 0
    codes, inverse = np.unique((before << 21) | flat, return_inverse=True)
    return codes, np.bincount(inverse.reshape(-1), np.repeat(weight, size), len(codes))


def _masked(values: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct texts with all digits alike, and which of them each value is."""
    import pyarrow.compute as pc

    same = pc.replace_substring_regex(values.cast(pa.string()).fill_null(""), "[0-9]", "0").dictionary_encode()
    return same.dictionary.to_pylist(), same.indices.to_numpy()


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], float] = {}
    for b in batches:
        texts, which = _masked(b.column(0))
        weight = np.bincount(which, minlength=len(texts)).astype(float)
        keep = [i for i, t in enumerate(texts) if not looks_garbled(t)]
        clean, weight = [texts[i] for i in keep], weight[keep]
        for state in range(len(PAIRS) + 1):
            if state == 0:
                made = [(clean, weight)]
            else:
                made = []
                for errors in ("strict", "replace"):
                    got = [garble(t, PAIRS[state - 1], errors) for t in clean]
                    at = [i for i, g in enumerate(got) if g is not None and g != clean[i]]
                    made.append(([got[i] for i in at], weight[at] * (1.0 if errors == "strict" else 0.5)))
            for some, w in made:
                if some:
                    codes, n = _counts(some, w)
                    for c, x in zip(codes.tolist(), n.tolist()):
                        total[state, c] = total.get((state, c), 0.0) + x
    if total:
        keys = np.array(list(total), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].astype(np.int32)), pa.array(keys[:, 1]), pa.array(np.array(list(total.values())))], ["state", "code", "n"])


def _with_odd(text: str, states: np.ndarray) -> np.ndarray:
    if not states.any():
        return states
    odd = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) > 127
    span = np.concatenate([[0], np.cumsum(states[1:] != states[:-1])])
    return np.where(np.bincount(span, odd)[span] > 0, states, 0).astype(np.int8)


class Model:
    """Log emission tables: [state, block before, character], with one extra column per block for other characters."""

    def __init__(self, state: np.ndarray, code: np.ndarray, n: np.ndarray):
        before, point = code >> 21, code & ((1 << 21) - 1)
        self.chars = np.unique(point)
        v = len(self.chars)
        count = np.zeros((len(PAIRS) + 1, N_BLOCKS, v))
        np.add.at(count, (state, before, np.searchsorted(self.chars, point)), n)
        block_of = blocks(self.chars) if v else np.zeros(0, np.int64)
        total = count.sum(2, keepdims=True)
        # chance of a block after a block, then of a character within its block
        in_block = np.stack([count[:, :, block_of == b].sum(2) for b in range(N_BLOCKS)], 2)
        p_block = (in_block + SMOOTH / N_BLOCKS) / (total + SMOOTH)
        known = (count + SMOOTH * p_block[:, :, block_of] / _SIZE[block_of]) / (total + SMOOTH)
        other = SMOOTH * p_block / _SIZE / (total + SMOOTH)
        # ASCII characters are the same in all states: after ASCII they tell nothing, after others only that the span goes on
        plain, ascii_block = self.chars < 128, np.arange(N_BLOCKS) <= 4
        within = known[0] / np.maximum(known[0][:, plain].sum(1, keepdims=True), 1e-300)
        share = p_block[:, :, ascii_block].sum(2)
        share[:, ascii_block] = share[0, ascii_block]
        known[:, :, plain] = share[:, :, None] * within[None, :, plain]
        self.log = np.log(np.concatenate([known, other], 2)).astype(np.float32)

    def label(self, texts: Sequence[str]) -> list[np.ndarray]:
        """States of the characters of each text; a span of ASCII alone is clean."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            longest = max(1, len(texts[order[at]]))
            group = []
            while at < len(order) and len(texts[order[at]]) <= 2 * longest + 16 and (len(group) + 1) * len(texts[order[at]]) <= 1_000_000 or not group and at < len(order):
                group.append(order[at])
                at += 1
            for i, s in zip(group, self._viterbi([texts[i] for i in group])):
                out[i] = _with_odd(texts[i], s)
        return out

    def _viterbi(self, texts: list[str]) -> list[np.ndarray]:
        n, s = len(texts), len(PAIRS) + 1
        flat, size = _points(texts)
        width = int(size.max()) if n else 0
        if not width:
            return [np.zeros(0, np.int8)] * n
        b = blocks(flat)
        place = np.minimum(np.searchsorted(self.chars, flat), max(0, len(self.chars) - 1))
        token = np.where(self.chars[place] == flat, place, len(self.chars) + b) if len(self.chars) else b
        row, col = np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        tok, blk = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
        tok[row, col], blk[row, col] = token, b
        score = np.full((n, s), ENTER, np.float32)
        score[:, 0] = 0
        back = np.zeros((width, n, s), np.int8)
        final = np.zeros((n, s), np.float32)
        ids = np.arange(s, dtype=np.int8)
        for t in range(width):
            emit = self.log[:, blk[:, t - 1] if t else np.zeros(n, np.int64), tok[:, t]].T
            if t:
                enter = score[:, :1] + ENTER
                stay = score + STAY
                stay[:, 0] = score[:, 0]
                come = stay.copy()
                from_clean = enter > stay
                come = np.where(from_clean, enter, stay)
                back[t] = np.where(from_clean, 0, ids)
                leave = score[:, 1:] + LEAVE
                best = leave.argmax(1)
                top = leave[np.arange(n), best]
                out = top > stay[:, 0]
                come[:, 0] = np.where(out, top, stay[:, 0])
                back[t, :, 0] = np.where(out, best + 1, 0)
                score = come
            score = score + emit
            ended = size == t + 1
            final[ended] = score[ended]
        state = final.argmax(1)
        path = np.zeros((width, n), np.int8)
        for t in range(width - 1, -1, -1):
            live = size > t
            path[t, live] = state[live]
            if t:
                state = np.where(live, back[t, np.arange(n), state], state)
        return [path[: size[i], i] for i in range(n)]


def fit(texts: DataFrame, column: str) -> Model:
    """The model of one text column; only texts with characters beyond ASCII teach it anything."""
    counts = texts.select(column).filter(F.col(column).rlike(r"[^\x00-\x7f]")).mapInArrow(_fit_batches, "state int, code long, n double")
    pdf = counts.groupBy("state", "code").agg(F.sum("n").alias("n")).toPandas()
    return Model(pdf["state"].to_numpy(np.int64), pdf["code"].to_numpy(np.int64), pdf["n"].to_numpy(float))


def mend(text: str, states: np.ndarray) -> tuple[str | None, str]:
    """(restored text or None, the encoding pairs of its garbled spans)."""
    out, names, whole, i = [], [], True, 0
    while i < len(text):
        j = i
        while j < len(text) and states[j] == states[i]:
            j += 1
        span = text[i:j]
        if states[i]:
            pair = PAIRS[states[i] - 1]
            names.append(f"{pair[0]}>{pair[1]}" + "x2" * (pair[2] == 2))
            got = restore(span, pair)
            whole &= got is not None
            out.append(span if got is None else got)
        else:
            out.append(span)
        i = j
    return ("".join(out) if whole else None), ",".join(dict.fromkeys(names))


def garbled(rows: DataFrame, model: Model) -> DataFrame:
    """(table_name, record_id, field_name, restored, pairs) of the garbled texts among rows (table_name, record_id, field_name, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masked, which = _masked(b.column(3))
            labels = model.label(masked)
            bad = np.array([bool(s.any()) for s in labels], bool)
            at = np.flatnonzero(bad[which]) if len(which) else np.zeros(0, np.int64)
            texts = b.column(3).take(pa.array(at)).to_pylist()
            fixed = [mend(t, labels[w]) for t, w in zip(texts, which[at].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(pa.array(at)) for i in range(3)), pa.array([f[0] for f in fixed], pa.string()), pa.array([f[1] for f in fixed], pa.string())],
                ["table_name", "record_id", "field_name", "restored", "pairs"],
            )

    beyond = rows.filter(F.col("text").rlike(r"[^\x00-\x7f]")).select("table_name", "record_id", "field_name", "text")
    return beyond.mapInArrow(run, "table_name string, record_id string, field_name string, restored string, pairs string").dropDuplicates(["table_name", "record_id", "field_name"])
