"""Every query of the text problems runs on the smallest tables and gives what its problem asks for."""

import os
from pathlib import Path

import pytest

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
if not DATA.exists():
    pytest.skip("no test tables", allow_module_level=True)

from sieveworks.llm import queries  # noqa: E402

COLUMNS = {
    "p1_found": ["case_id_a", "case_id_b"], "p2_found": ["table_name", "record_id", "field_name"], "p6_found": ["table_name", "first_id", "copy_id"],
    "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    assert rows and (name not in COLUMNS or df.columns == COLUMNS[name])
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)


def test_reports_agree_with_what_was_found(spark):
    q = {k: f(spark, str(DATA)) for k, f in queries.QUERIES.items() if k in ("p1_found", "p1_report", "p6_found", "p6_records", "p10_found", "p10_report", "p2_found", "p2_restored")}
    total = lambda df, c: sum(r[c] for r in df.collect())
    assert total(q["p1_report"], "n_pairs") == q["p1_found"].count()
    assert total(q["p10_report"], "n_cut") == q["p10_found"].count()
    assert q["p2_restored"].count() == q["p2_found"].count()
    records = q["p6_records"].collect()
    assert sum(r["n_copies"] - 1 for r in records) == q["p6_found"].count()


def test_ids_are_those_of_the_other_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in queries.p8_ids(spark, str(DATA)).collect()}
    assert got == {k: e.ids for k, e in zip(docs, t.encode_batch(list(docs.values()), add_special_tokens=False))}
