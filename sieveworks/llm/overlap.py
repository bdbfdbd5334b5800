"""The same or nearly the same records in a training and an evaluation split.

Records are substances: a name and a registry number. The distinct numbers and
names of the evaluation split are indexed in bounded shards (``fmindex``), and
the distinct ones of the training split are streamed through backward search,
which finds maximal matches and merges two of them over one slip of a letter.
A pair is an overlap if both numbers are valid and equal, or if a number is
missing or invalid on either side and the names are equal but for at most one
slip.

Word order doesn't count, and a slip touches one word. So a name is taken in as
many forms as it has words, each with one word in front of the sorted others:
the others agree. Shards are routed by the others; where many names share them
(a common word, or none), also by the first or the last half of the word and
its digits, of which one slip can't touch both halves. So a name visits about
as many shards as it has words, whatever their number. Others that are long
stand for themselves by their hash, so the forms of a name grow as its words
do. A word of one letter may be all that is lost: such a name is also taken
without it, with its slip used up.

Routes are counted on both sides. A shard that many evaluation names share is
cut into parts, which its patterns all visit; one that many training names
visit is searched in several slices, each with an index of its own.

Null and blank names match nothing by name; null, blank and invalid numbers
count as missing. Repeated deliveries count once; empty splits give an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import spread_join
from ..session import cut, shuffle_width
from . import names
from .fmindex import Index

#: Texts of one shard; its index takes about three bytes a character, and some 40 while it is built.
SHARD_TEXTS = 12_000
#: Patterns of one shard that one task searches, and patterns searched at once.
SLICE_PATTERNS, SEARCHED = 60_000, 50_000
#: Evaluation names that may share the words beside one without being told apart by that word's halves.
SHARED = 64
#: Characters of the other words that are kept as they stand.
OTHERS = 64

def substances(df: DataFrame, record_id: str, name: str, number: str) -> DataFrame:
    """(record_id, number, name): valid registry number or null, sorted words or null; written once, repeated deliveries as they are."""
    one = df.filter(F.col(record_id).isNotNull()).select(F.col(record_id).cast("string").alias("record_id"), F.col(name).cast("string").alias("name"), F.col(number).cast("string").alias("number"))
    one = names.with_valid_number(names.with_substance(one, "name", "number"), "number").withColumn("name", names.name_words(F.col("name")))
    return cut(one.select("record_id", "number", F.when(F.col("name") != "", F.col("name")).alias("name")))


def _half(length: Column) -> Column:
    """The length of a word's end that a slip in its other half can't touch, by the length of the training side's word.

    In steps of two, so that words whose lengths differ by one mostly agree.
    """
    return (F.floor(F.greatest(length - 1, F.lit(0)) / 4) * 2).cast("int")


def _forms(split: DataFrame) -> DataFrame:
    """(key, seen, used, word, others): each word of a distinct name in front of the rest.

    seen: bit 1 if the name stands without a valid number, bit 2 with one;
    used: whether a word of one letter was left out.
    """
    named = split.filter(F.col("name").isNotNull()).groupBy("name").agg(F.bit_or(F.when(F.col("number").isNull(), 1).otherwise(2)).cast("byte").alias("seen"))
    words = F.split("name", " ")
    without = lambda ws, i: F.concat(F.slice(ws, F.lit(1), i), F.slice(ws, i + 2, F.size(ws)))
    shorter = F.filter(F.transform(words, lambda w, i: F.when((F.length(w) == 1) & w.rlike(r"\p{L}") & (F.size(words) > 1), without(words, i))), lambda x: x.isNotNull())
    ways = named.select(F.xxhash64(F.lit("w"), "name").alias("key"), "seen", F.posexplode(F.concat(F.array(words), shorter)).alias("_k", "_ws"))
    one = ways.select("key", "seen", F.least("_k", F.lit(1)).cast("byte").alias("used"), "_ws", F.posexplode("_ws").alias("_i", "word"))
    one = one.select("key", "seen", "used", "word", F.array_join(without(F.col("_ws"), F.col("_i")), " ").alias("others"))
    return one.withColumn("others", F.when(F.length("others") > OTHERS, F.hex(F.xxhash64("others"))).otherwise(F.col("others")))


def _entries(split: DataFrame, forms: DataFrame, shared: DataFrame, indexed: bool) -> DataFrame:
    """(route, kind, text, tail, key, seen, used): one row per form of a distinct text and shard it belongs to or visits.

    kind 0: numbers, exact; 1: slips anywhere in a word; 2: slips on its left;
    3: the word reversed, slips on its right. shared: the others that many
    names have.
    """
    byte = lambda n: F.lit(n).cast("byte")
    number = split.filter(F.col("number").isNotNull()).select("number").distinct().select(
        F.xxhash64(F.lit("n"), "number").alias("route"), byte(0).alias("kind"), F.col("number").alias("text"), F.length("number").alias("tail"), F.xxhash64(F.lit("n"), "number").alias("key"), byte(3).alias("seen"), byte(0).alias("used")
    )
    form = forms.join(F.broadcast(shared.withColumn("_hot", F.lit(True))), "others", "left")
    size = F.length("word")
    tails = [size, size - 1, size + 1] if indexed else [size]  # a slip changes the length by one at most
    halves = F.array_distinct(F.array(*[F.least(_half(t), size) for t in tails]))
    way = lambda k: lambda h: F.struct(byte(k).alias("kind"), h.alias("half"))
    ways = F.concat(*[F.transform(halves, way(k)) for k in (2, 3)])
    form = form.withColumn("_w", F.explode(F.when(F.col("_hot"), ways).otherwise(F.array(F.struct(byte(1).alias("kind"), F.lit(0).alias("half"))))))
    form = form.select("key", "seen", "used", "others", "_w.kind", "_w.half", F.when(F.col("_w.kind") == 3, F.reverse("word")).otherwise(F.col("word")).alias("word"))
    hot = F.when(F.col("kind") > 1, F.xxhash64("half", F.right("word", F.col("half")), names.digits(F.col("word"))))
    route = F.xxhash64("kind", "others", F.coalesce(hot, F.lit(0)))
    return number.unionByName(form.select(route.alias("route"), "kind", F.concat_ws(" ", "word", "others").alias("text"), (F.col("half") + F.length("others") + 1).alias("tail"), "key", "seen", "used"))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, texts to index before patterns: index each shard, stream its patterns."""
    shard, held, index, waiting = None, [], {}, []

    def flush() -> Iterator[pa.RecordBatch]:
        if not waiting:
            return
        pats = pd.concat(waiting) if len(waiting) > 1 else waiting[0]
        waiting.clear()
        for kind, part in pats.groupby("kind"):
            if kind not in index:
                mine = [h[h["kind"] == kind] for h in held]
                mine = pd.concat(mine) if mine else None
                if mine is None or not len(mine):
                    index[kind] = None
                else:
                    # one text may stand for several keys and routes
                    which, text = pd.factorize(mine["text"].to_numpy(object))
                    index[kind] = (Index(text.tolist()), pd.DataFrame({"t": which, "e_used": mine["used"].to_numpy(), "entry": mine["key"].to_numpy(), "route": mine["route"].to_numpy(), "e_seen": mine["seen"].to_numpy()}))
            if index[kind] is None:
                continue
            idx, keys = index[kind]
            # several names may have the same form
            which, text = pd.factorize(part["text"].to_numpy(object))
            forms = pd.DataFrame({"p": which, "tail": part["tail"].to_numpy()}).drop_duplicates()
            p, t, e, span = idx.search(text[forms["p"].to_numpy()].tolist(), forms["tail"].to_numpy(), kind != 0)
            if not len(p):
                continue
            hit = pd.DataFrame({"p": forms["p"].to_numpy()[p], "tail": forms["tail"].to_numpy()[p], "t": t, "slips": e, "span": span})
            asked = pd.DataFrame({"p": which, "q_used": part["used"].to_numpy(), "tail": part["tail"].to_numpy(), "route": part["route"].to_numpy(), "query": part["key"].to_numpy(), "q_seen": part["seen"].to_numpy()})
            hit = hit.merge(asked, on=["p", "tail"]).merge(keys, on=["t", "route"])
            # names that both stand with valid numbers only don't meet
            hit["slips"] += hit["q_used"] + hit["e_used"]
            hit = hit[(hit["slips"] < 2) & ((hit["q_seen"] != 2) | (hit["e_seen"] != 2))].sort_values(["slips", "span"], ascending=[True, False]).drop_duplicates(["query", "entry"])
            if len(hit):
                cols = [("query", np.int64), ("q_seen", np.int8), ("entry", np.int64), ("e_seen", np.int8), ("slips", np.int32), ("kind", np.int8)]
                yield pa.RecordBatch.from_arrays([pa.array((hit[c] if c in hit else np.full(len(hit), kind)).astype(k)) for c, k in cols], [c for c, _ in cols])

    for b in batches:
        df = b.to_pandas()
        at = df["cell"].to_numpy()
        change = np.flatnonzero(np.diff(at)) + 1
        for part in np.split(np.arange(len(df)), change) if len(df) else []:
            here, part = at[part[0]], df.iloc[part[0] : part[-1] + 1]
            if here != shard:
                yield from flush()
                shard, held, index = here, [], {}
            texts, pats = part[part["side"] == 0], part[part["side"] == 1]
            if len(texts):
                held.append(texts)
            if len(pats) and held:
                waiting.append(pats)
                if sum(map(len, waiting)) >= SEARCHED:
                    yield from flush()
    yield from flush()


def matched_keys(train: DataFrame, evaluation: DataFrame, shard_texts: int = SHARD_TEXTS, slice_patterns: int = SLICE_PATTERNS) -> DataFrame:
    """(query, q_seen, entry, e_seen, slips, kind): keys of training and evaluation texts that match."""
    forms = cut(_forms(evaluation))
    shared = cut(forms.groupBy("others").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SHARED).select("others"))  # at most forms / SHARED rows
    texts, patterns = cut(_entries(evaluation, forms, shared, True)), _entries(train, _forms(train), shared, False)
    n_shards = max(1, -(-texts.count() // shard_texts))
    shard = lambda df: df.withColumn("shard", F.pmod("route", F.lit(n_shards)).cast("int"))
    count = lambda df, name, most: shard(df).groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias(name)).filter(F.col(name) > 1)
    # shards that outgrew their bound on either side; at most texts / (2 shard_texts) and patterns / slice_patterns rows
    grown = F.broadcast(cut(count(texts, "parts", 2 * shard_texts).join(count(patterns, "slices", slice_patterns), "shard", "full").select("shard", F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("slices", F.lit(1)).alias("slices"))))

    def side(df: DataFrame, k: int, mine: str, other: str) -> DataFrame:
        """Rows in the cells of their shard: one of their own side's, all of the other's."""
        df = shard(df).join(grown, "shard", "left")
        at = F.pmod(F.xxhash64("text", F.lit(k)), F.coalesce(mine, F.lit(1))).cast("int")
        df = df.withColumn("_mine", at).withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        part, piece = ("_mine", "_other") if k == 0 else ("_other", "_mine")
        cell = F.xxhash64("shard", part, piece)
        return df.select(cell.alias("cell"), F.lit(k).cast("byte").alias("side"), "kind", "route", "text", "tail", "key", "seen", "used")

    both = side(texts, 0, "parts", "slices").unionByName(side(patterns, 1, "slices", "parts"))
    # a task has about three cells at most, however many there are
    n_cells = n_shards + (grown.agg(F.sum(F.col("parts") * F.col("slices") - 1)).first()[0] or 0)
    both = both.repartition(max(shuffle_width(train.sparkSession), n_cells // 3), "cell").sortWithinPartitions("cell", "side")
    return both.mapInArrow(_stream, "query long, q_seen byte, entry long, e_seen byte, slips int, kind byte")


def _keyed(split: DataFrame) -> DataFrame:
    """(record_id, key): rows by number, and by name and whether the number is valid."""
    by_number = split.filter(F.col("number").isNotNull()).select("record_id", F.xxhash64(F.lit("n"), "number").alias("key"))
    by_name = split.filter(F.col("name").isNotNull()).select("record_id", F.xxhash64(F.xxhash64(F.lit("w"), "name"), F.col("number").isNotNull()).alias("key"))
    return by_number.unionByName(by_name)


def _met(pairs: DataFrame) -> DataFrame:
    """(query, entry, slips, kind) in the keys of ``_keyed``: each pair of names without or with valid numbers, but not both with."""
    has = lambda c, bit: F.col(c).bitwiseAND(F.lit(bit).cast("byte")) > 0
    flags = F.array(*[F.when(has("q_seen", 1 + q) & has("e_seen", 1 + e), F.struct(F.lit(bool(q)).alias("q"), F.lit(bool(e)).alias("e"))) for q, e in ((0, 0), (0, 1), (1, 0))])
    named = pairs.filter("kind <> 0").withColumn("_f", F.explode(F.array_compact(flags)))
    named = named.select(F.xxhash64("query", F.col("_f.q")).alias("query"), F.xxhash64("entry", F.col("_f.e")).alias("entry"), "slips", F.lit("w").alias("kind"))
    return pairs.filter("kind = 0").select("query", "entry", "slips", F.lit("n").alias("kind")).unionByName(named)


def overlaps(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(train_id, eval_id, slips, kind): all overlapping pairs of ``substances``; kind n by number, w by name."""
    found = matched_keys(train, evaluation).groupBy("query", "entry").agg(F.min("slips").alias("slips"), F.max("q_seen").alias("q_seen"), F.max("e_seen").alias("e_seen"), F.min("kind").alias("kind"))
    pairs = _met(cut(found))
    left = _keyed(train)
    sizes = left.groupBy(F.col("key").alias("query")).agg(F.count(F.lit(1)).alias("n"))
    sized = cut(pairs.join(sizes, "query"))
    met = spread_join(left, sized.withColumnRenamed("query", "key"), ["key"], "record_id").select(F.col("record_id").alias("train_id"), "entry", "slips", "kind")
    # rows that come to an evaluation text, as many as its training rows
    due = sized.groupBy("entry").agg(F.sum("n").alias("n"))
    right = _keyed(evaluation).select(F.col("key").alias("entry"), F.col("record_id").alias("eval_id")).join(due, "entry")
    both = spread_join(met, right, ["entry"], "train_id")
    return both.groupBy("train_id", "eval_id").agg(F.min("slips").alias("slips"), F.min("kind").alias("kind"))
