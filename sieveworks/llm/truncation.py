"""Texts cut off before their end, by a backward character n-gram model.

For the characters before each position, read backwards, the model counts how
often a text of the corpus ends there and how often it goes on, over all
languages and for each. A text's final context is scored with the counts of
ever longer contexts, each smoothed by the shorter one, its own end left out;
the last of these estimates is the prior of the one from the text's own
language. The log-odds of ending against going on are compared with a limit of
the language and column: the emptiest place between the scores of whole and of
cut texts, whose numbers don't move it.

Before counting, texts are brought to composed form, runs of digits and of
blanks become one, and what may be put after a cut (dots, a lost character, a
closed bracket) is taken off, so that what is before it is judged. Null, empty
and blank texts are no cases and teach nothing. Long texts are read whole.
Languages are compared without case; texts without one are judged by the counts
and the limit of all. Ids delivered twice count once in the result.

The table of contexts is bounded: the shortest are few and all kept, longer ones
count only if at least two texts and LONG_SHARE of all end in them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Longest context, and up to which length every context is kept.
ORDER, SHORT = 10, 4
#: Least share of all texts that end in a longer context.
LONG_SHARE = 1e-5
#: Weight of the shorter context's estimate: as many places as this many texts end at by it.
PRIOR = 1.0
#: A longer context is used only if at most this part of the shorter one's occurrences have it.
NEWS = 0.5
#: Where a limit is looked for, above the log-odds of an end at any place: first place, last place, and the one that is taken where scores leave room.
LOWEST, HIGHEST, USUAL = 0.5, 3.1, 2.3
#: Width of a place among the scores; the scores a language must have for a limit of its own; among FEW texts, many a whole one ends as no other does, and the usual place is lower by ln 2.
BIN, OWN, FEW = 0.1, 200, 300
#: Characters counted at once.
SLICE = 1 << 18

#: Single characters that may stand after a cut, and those that aren't seen.
_AFTER, _UNSEEN = "\u200b\ufeff\ufffd\u2026", "\u200b\ufeff"
_DIGITS, _BLANKS = re.compile(r"\d+"), re.compile(r"\s+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_START = "\x02"


def bare(text: str | None) -> str:
    """The text in composed form, without what may stand after a cut."""
    if not text:
        return ""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    while True:
        text = text.rstrip()
        last = text[-1:]
        if last and last in _AFTER:
            text = text[:-1]
        elif text.endswith("...") and not text.endswith("....."):
            text = text[:-3]
        elif last in ("]", ")") and (at := text.rfind("[" if last == "]" else "(")) > 0 and text[at - 1].isspace():
            text = text[:at]
        else:
            return text


@lru_cache(1)
def _classes() -> np.ndarray:
    """1 for digits, 2 for blanks, 3 for line ends, 4 for what isn't seen, by code point."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        out[i] = 1 if c.isdecimal() else 3 if c == "\n" else 2 if c.isspace() else 0
    out[[ord(c) for c in _UNSEEN]] = 4
    return out


def _flat(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts on end as the model reads them, each after ORDER start signs; positions of the texts' last characters."""
    pad = _START * ORDER
    data = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + ORDER for t in texts]) - 1
    kind = _classes()[data]
    seen = kind != 4
    if not seen.all():
        ends = np.cumsum(seen)[ends] - 1
        data, kind = data[seen], kind[seen]
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
    blank, was = kind >= 2, before >= 2
    keep = ~((kind == 1) & (before == 1)) & ~(blank & was)
    data = np.where(kind == 1, np.uint32(48), data)
    if blank.any():
        first = np.flatnonzero(blank & ~was)  # one line end among a run of blanks makes it one
        line = np.maximum.reduceat(np.where(blank, kind, 0), first)
        data[first] = np.where(line == 3, np.uint32(10), np.uint32(32))
    ends = np.cumsum(keep)[ends] - 1
    return data[keep].astype(np.uint64), ends


def _final(text: str) -> str:
    """The end of a bare text as the model reads it, of more than ORDER characters where it has them."""
    size = 64
    while True:
        part = text[-size:]
        for c in _UNSEEN:
            part = part.replace(c, "")
        part = _BLANKS.sub(lambda m: "\n" if "\n" in m.group() else " ", _DIGITS.sub("0", part))
        if len(part) > ORDER or size >= len(text):
            return part
        size *= 4


def _longer(h: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Hashes of contexts of k characters from those of k-1 and the character before."""
    with np.errstate(over="ignore"):
        h = (h ^ (c + np.uint64(k << 32))) * _STEP
        return h ^ (h >> np.uint64(29))


def _final_hashes(texts: Sequence[str]) -> np.ndarray:
    """Hashes of each text's final contexts, one row per order."""
    flat, ends = _flat([_final(t) for t in texts])
    h, out = np.zeros(len(ends), np.uint64), []
    for k in range(1, ORDER + 1):
        h = _longer(h, flat[ends - k + 1], k)
        out.append(h)
    return np.array(out)


def _cases(b: pa.RecordBatch, first: int) -> tuple[list[str], list[int], list[str]]:
    """Bare texts that aren't empty, their rows and groups, in the order of groups; from column ``first`` on: group, text."""
    group, texts = b.column(first).to_pylist(), [bare(t) for t in b.column(first + 1).to_pylist()]
    at = sorted((i for i, t in enumerate(texts) if t), key=lambda i: group[i])
    return [texts[i] for i in at], at, [group[i] for i in at]


def _end_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, _, group = _cases(b, 0)
        if not texts:
            continue
        hashes = _final_hashes(texts).view(np.int64)
        n = pd.DataFrame({"grp": group * ORDER, "k": np.repeat(np.arange(1, ORDER + 1, dtype=np.int32), len(texts)), "key": hashes.reshape(-1)}).value_counts().reset_index(name="n")
        yield pa.RecordBatch.from_pandas(n[["grp", "k", "key", "n"]], preserve_index=False)


class Contexts:
    """Hashes of the kept contexts by order; for each group the numbers of ends and of continuations, pooled under None."""

    def __init__(self, ends: pd.DataFrame):
        """ends: (grp, k, key, n)."""
        groups = sorted(ends["grp"].unique())
        self.keys, self.starts, self.shifts = [], [], []
        self.ends: dict[str | None, list[np.ndarray]] = {g: [] for g in [None, *groups]}
        for k in range(1, ORDER + 1):
            mine = ends[ends["k"] == k]
            u = mine["key"].to_numpy(np.int64).view(np.uint64)
            keys = np.unique(u)
            bits = max(4, int(4 * len(keys) + 1).bit_length())
            self.keys.append(keys)
            self.shifts.append(np.uint64(64 - bits))
            self.starts.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int64))
            place, n = np.searchsorted(keys, u), mine["n"].to_numpy(np.int64)
            self.ends[None].append(np.bincount(place, n, len(keys)).astype(np.int64))
            for g in groups:
                at = (mine["grp"] == g).to_numpy()
                self.ends[g].append(np.bincount(place[at], n[at], len(keys)).astype(np.int64))
        self.conts = {g: self.zeros() for g in self.ends}

    def zeros(self) -> list[np.ndarray]:
        """Counts of places by order, those of all places last."""
        return [*(np.zeros(len(x), np.int64) for x in self.keys), np.zeros(1, np.int64)]

    def find(self, k: int, h: np.ndarray) -> np.ndarray:
        """Places of the hashes among those of order k, -1 where unknown."""
        keys, out = self.keys[k - 1], np.full(len(h), -1)
        if not len(keys):
            return out
        at = self.starts[k - 1][h >> self.shifts[k - 1]]
        live = np.arange(len(h))
        while len(live):
            got = keys[np.minimum(at, len(keys) - 1)]
            hit = got == h[live]
            out[live[hit]] = at[hit]
            on = (got < h[live]) & (at + 1 < len(keys))
            live, at = live[on], at[on] + 1
        return out

    def count(self, texts: Sequence[str], total: list[np.ndarray]) -> None:
        """Adds the continuations of each known context in the texts; longer contexts are looked up only where the shorter is known."""
        flat, ends = _flat(texts)
        inside = flat != 2
        inside[ends] = False
        every = np.flatnonzero(inside)
        total[-1] += len(every)
        for a in range(0, len(every), SLICE):
            at = every[a : a + SLICE]
            h = np.zeros(len(at), np.uint64)
            for k in range(1, ORDER + 1):
                h = _longer(h, flat[at - k + 1], k)
                place = self.find(k, h)
                known = np.flatnonzero(place >= 0)
                if not len(known):
                    break
                total[k - 1] += np.bincount(place[known], minlength=len(self.keys[k - 1]))
                at, h = at[known], h[known]

    def base(self, group: str | None = None) -> float:
        """Share of places that are ends."""
        n_end, n_cont = self.ends[group][0].sum(), self.conts[group][-1].sum()
        return float((n_end + 1) / (n_end + n_cont + 2))

    def odds(self, texts: Sequence[str], group: Sequence[str]) -> np.ndarray:
        """Log-odds that a text ends after its final context, its own end left out."""
        n = len(texts)
        p, own_e, own_c = np.full(n, self.base()), np.zeros(n), np.zeros(n)
        live, seen = np.ones(n, bool), np.full(n, np.inf)
        names = np.array(group, object)
        for k, h in enumerate(_final_hashes(texts), 1):
            place = self.find(k, h)
            live &= place >= 0
            if not live.any():
                break
            e, c = self.ends[None][k - 1][place] - 1, self.conts[None][k - 1][place]
            # a context hardly rarer than the last one brings the same evidence again
            fresh = live & (e + c <= NEWS * seen)
            p = np.where(fresh, (e + PRIOR) / (np.maximum(e + c, 0) + PRIOR / p), p)
            seen = np.where(fresh, e + c, seen)
            for g in set(group):
                if named(g):
                    at = np.flatnonzero(fresh & (names == g))
                    own_e[at], own_c[at] = self.ends[g][k - 1][place[at]] - 1, self.conts[g][k - 1][place[at]]
        p = (own_e + PRIOR) / (own_e + own_c + PRIOR / p)
        return np.log(p) - np.log1p(-np.minimum(p, 1 - 1e-9))


def named(group: str) -> bool:
    """Whether a group has a language of its own."""
    return not group.endswith("\x1f")


def long_rows(docs: DataFrame, record_id: str, columns: Sequence[str], lang: str) -> DataFrame:
    """(record_id, column, lang, grp, text) of each column's texts; grp is column and language."""
    low = F.lower(F.trim(F.coalesce(docs[lang].cast("string"), F.lit(""))))
    parts = F.array(*[F.struct(F.lit(c).alias("column"), docs[c].cast("string").alias("text")) for c in columns])
    rows = docs.select(docs[record_id].alias("record_id"), low.alias("lang"), F.explode(parts).alias("_p")).select("record_id", "_p.column", "lang", "_p.text")
    return rows.filter(F.col("text").isNotNull()).select("record_id", "column", "lang", F.concat_ws("\x1f", "column", "lang").alias("grp"), "text")


def bounded(ends: DataFrame, n_texts: int) -> DataFrame:
    """(grp, k, key, n) of all contexts up to SHORT, and the longer ones that at least two texts and LONG_SHARE of all end in."""
    least = max(2.0, LONG_SHARE * n_texts)
    kept = ends.groupBy("k", "key").agg(F.sum("n").alias("_n")).filter((F.col("k") <= SHORT) | (F.col("_n") >= least)).drop("_n")
    return ends.join(kept, ["k", "key"], "left_semi")


def fit(rows: DataFrame) -> Contexts:
    """The counts of all texts of ``long_rows``."""
    spark, texts = rows.sparkSession, rows.select("grp", "text")
    ends = texts.mapInArrow(_end_contexts, "grp string, k int, key long, n long").groupBy("grp", "k", "key").agg(F.sum("n").alias("n"))
    kept = bounded(ends, texts.count()).select("grp", "k", "key", "n").toPandas()
    model = Contexts(kept)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list[np.ndarray]] = {}
        for b in batches:
            mine, _, group = _cases(b, 0)
            size, held = 0, []
            for i, (t, g) in enumerate(zip(mine, group)):
                held.append(t)
                size += len(t)
                if size >= SLICE or i + 1 == len(mine) or group[i + 1] != g:
                    total = totals.setdefault(g, shared.value.zeros())
                    shared.value.count(held, total)
                    size, held = 0, []
        for g, total in totals.items():
            for k, t in enumerate(total, 1):
                at = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(t[at])], ["grp", "k", "place", "n"])

    went_on = texts.mapInArrow(run, "grp string, k int, place long, n long").groupBy("grp", "k", "place").agg(F.sum("n").alias("n")).toPandas()
    for (g, k), part in went_on.groupby(["grp", "k"]):
        if g in model.conts:
            model.conts[g][k - 1][part["place"].to_numpy()] = part["n"].to_numpy()
        model.conts[None][k - 1] += np.bincount(part["place"].to_numpy(), part["n"].to_numpy(), len(model.conts[None][k - 1])).astype(np.int64)
    return model


def scored(rows: DataFrame, model: Contexts) -> DataFrame:
    """(record_id, column, lang, grp, log_odds) of each text that isn't blank."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at, group = _cases(b, 3)
            odds = shared.value.odds(texts, group) if at else np.zeros(0)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(4)), pa.array(odds)], ["record_id", "column", "lang", "grp", "log_odds"])

    kind = rows.schema["record_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"record_id {kind}, column string, lang string, grp string, log_odds double")


def valley(bins: np.ndarray, n: np.ndarray, usual: float = USUAL) -> float:
    """The emptiest place of a histogram of scores between LOWEST and HIGHEST.

    bins: score / BIN, rounded down. A place is looked at with its neighbours;
    of equally empty ones, which hold less than a thousandth of the scores, the
    one nearest to ``usual`` counts.
    """
    places = np.arange(round(LOWEST / BIN), round(HIGHEST / BIN))
    full = (np.exp(-0.5 * ((places[:, None] - bins[None, :]) / 2.5) ** 2) * n[None, :]).sum(1)
    full = np.maximum(full, 1e-3 * n.sum())
    best = places[full <= full.min() * (1 + 1e-9)]
    return float((best[np.argmin(np.abs((best + 0.5) * BIN - usual))] + 0.5) * BIN)


def limits(marks: DataFrame, model: Contexts) -> dict[str, float]:
    """The log-odds below which a text is cut, by group.

    Scores are taken above the base of their language. Small groups and those
    without a language have the limit of all texts of their column.
    """
    groups = [g for g in model.ends if g is not None]
    at = {g: float(np.log(p) - np.log1p(-p)) for g in [None, *groups] for p in [model.base(g if g is None or named(g) else None)]}
    spark = marks.sparkSession
    bases = F.broadcast(spark.createDataFrame([(g, at[g]) for g in groups] or [("", 0.0)], "grp string, _base double"))  # one row per column and language
    hist = marks.join(bases, "grp").groupBy("column", "grp", F.floor((F.col("log_odds") - F.col("_base")) / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    out = {}
    for _, col in hist.groupby("column"):
        pooled = col.groupby("bin")["n"].sum()
        usual = USUAL - float(np.log1p(FEW / pooled.sum()))
        if pooled.sum() >= OWN:
            usual = valley(pooled.index.to_numpy(float), pooled.to_numpy(float), usual)
        for g, mine in col.groupby("grp"):
            own = named(g) and mine["n"].sum() >= OWN
            out[g] = at[g] + (valley(mine["bin"].to_numpy(float), mine["n"].to_numpy(float), usual) if own else usual)
    return out


def truncated(docs: DataFrame, record_id: str, columns: str | Sequence[str], lang: str) -> DataFrame:
    """(record_id, column, lang, log_odds, cut) of each text that isn't blank."""
    rows = long_rows(docs, record_id, [columns] if isinstance(columns, str) else list(columns), lang)
    model = fit(rows)
    marks = cut(scored(rows, model))  # scored once, for the limits and the result
    found = limits(marks, model)
    by = docs.sparkSession.createDataFrame(list(found.items()) or [("", 0.0)], "grp string, _limit double")
    return marks.join(F.broadcast(by), "grp").select("record_id", "column", "lang", "log_odds", (F.col("log_odds") < F.col("_limit")).alias("cut"))  # one row per column and language
