import random

import pytest
from sieveworks.llm import truncation as T

ENDS = ["The limit was {} %.", "Notice {}-3 adds entries.", "Was it left open?", "이 항목은 더 이상 따르지 않는다.", "Storage at {} °C changed neither colour nor content."]


def corpus(seed=4, n=600):
    rng = random.Random(seed)
    docs, cut = [], set()
    for i in range(n):
        t = " ".join(rng.choice(ENDS).format(rng.randint(1, 99)) for _ in range(rng.randint(2, 8)))
        if i % 4 == 0:
            t += f"\n\nWith regards\nRegistry desk, unit {rng.randint(1, 30)}"
        if i % 15 == 7:
            at = rng.randint(len(t) // 2, len(t) - 2)
            while t[at - 1] in ".?다 \n" or t[at - 2 : at - 1] in (".",) or t[at - 1].isdigit():
                at -= 1
            t = t[:at] + rng.choice(["", "...", "…", " [more]", "�"])
            cut.add(i)
        docs.append((i, t, rng.choice(["en", "EN", None])))
    return docs, cut


def test_cut_texts_of_a_corpus(spark):
    docs, cut = corpus()
    docs += [(-1, None, "en"), (-2, "", "en"), (-3, " \t ", None)]
    got = T.truncated(spark.createDataFrame(docs, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()
    found = {r["record_id"] for r in got if r["cut"]}
    assert found <= cut and len(found) >= 0.9 * len(cut)
    assert not {-1, -2, -3} & {r["record_id"] for r in got}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert T.truncated(df, "doc_id", "text", "lang").count() == 0


def test_what_stands_after_a_cut_is_taken_off():
    assert T.bare("it was...") == T.bare("it was…") == T.bare("it was [more]") == T.bare("it was � (tbc) ") == "it was"
    assert T.bare("it was. [Checked twice.]") == "it was." and T.bare("it was....") == "it was." and T.bare("f(x)") == "f(x)"
    assert T.bare(None) == T.bare(" \u200b") == "" and T.bare("e\u0301 x") == "é x"


def read(text):
    flat, ends = T._flat([text])
    return "".join(map(chr, flat.tolist()))[T.ORDER :], int(ends[0]) - T.ORDER


def test_texts_as_the_model_reads_them():
    for text, want in {"12 a": "0 a", "a \t\n b": "a\nb", "a \xa0b ٣٤": "a b 0", "1\u200b2": "0", "x": "x"}.items():
        assert read(text) == (want, len(want) - 1)
        assert T._final(text).strip() == want
    long = "7" * 500 + " end"
    assert T._final(long)[-5:] == "0 end" and read(long)[0] == "0 end"


def contexts(texts, group="text\x1fen"):
    import pyarrow as pa

    b = next(T._end_contexts(iter([pa.RecordBatch.from_arrays([pa.array([group] * len(texts)), pa.array(texts)], ["grp", "text"])])))
    m = T.Contexts(b.to_pandas())
    total = m.zeros()
    m.count([T.bare(t) for t in texts], total)
    return m, total


def test_counts_of_contexts():
    m, total = contexts(["ab.", "ab. ab.", "xab"])
    hashes = T._final_hashes(["b.", "zz"])
    for k, (n_end, n_on) in {1: (2, 1), 2: (2, 1)}.items():
        (at,) = m.find(k, hashes[k - 1, :1])
        assert m.ends[None][k - 1][at] == m.ends["text\x1fen"][k - 1][at] == n_end and total[k - 1][at] == n_on
    assert m.find(1, hashes[0, 1:]).tolist() == [-1] and total[-1] == 2 + 6 + 2


def test_lookup_of_many_keys():
    rng = T.np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63, 5000)
    m = T.Contexts(T.pd.DataFrame({"grp": "c\x1f", "k": 1, "key": keys, "n": 1}))
    u = keys.view(T.np.uint64)
    assert (m.keys[0][m.find(1, u)] == u).all() and (m.find(1, u + T.np.uint64(1)) == -1).mean() > 0.99


def found_of(spark, docs):
    got = T.truncated(spark.createDataFrame(docs, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()
    return {r["record_id"] for r in got if r["cut"]}


@pytest.mark.parametrize("share", [0.1, 0.3, 0.6])
def test_language_with_many_cut_texts(spark, share):
    docs, cut = corpus(n=3000)
    whole = [i for i, _, _ in docs if i not in cut]
    mine = {*sorted(cut), *whole[: int(len(cut) * (1 - share) / share)]}
    found = found_of(spark, [(i, t, "de" if i in mine else k) for i, t, k in docs])
    assert len(found & cut) >= 0.95 * len(cut) and len(found & cut) >= 0.95 * len(found)


def test_corpus_without_cut_texts(spark):
    docs, cut = corpus(n=900)
    assert not found_of(spark, [x for x in docs if x[0] not in cut])


def test_languages_of_one_text_and_several_columns(spark):
    docs, cut = corpus()
    alone = sorted(cut)[:2]
    moved = [(i, t, {alone[0]: "fr", alone[1]: "it"}.get(i, k)) for i, t, k in docs]
    assert found_of(spark, moved) >= set(alone)
    df = spark.createDataFrame(moved, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "case when doc_id % 2 = 0 then text end as other")
    got = T.truncated(df, "doc_id", ["text", "other"], "lang").collect()
    assert {r["column"] for r in got} == {"text", "other"}
    assert sum(r["column"] == "other" for r in got) == sum(i % 2 == 0 for i, _, _ in docs)


def test_emptiest_place():
    n = T.np.array([50.0, 40, 1, 900])
    assert 1.2 < T.valley(T.np.array([-30.0, -10, 20, 33]), n) < 2.8
    assert T.valley(T.np.array([40.0]), T.np.array([100.0])) == pytest.approx(T.USUAL, abs=0.06)


def test_short_contexts_are_kept_among_many_texts(spark):
    ends = spark.createDataFrame([("g", 1, 1, 1), ("g", 4, 2, 2), ("g", 5, 3, 4), ("g", 5, 4, 50), ("g", 10, 5, 9), ("h", 10, 5, 1), ("g", 6, 6, 1)], "grp string, k int, key long, n long")
    kept = lambda n: {r["key"] for r in T.bounded(ends, n).collect()}
    assert kept(4_900_000) == {1, 2, 4} and kept(1_000_000) == {1, 2, 4, 5} and kept(10) == {1, 2, 3, 4, 5}
