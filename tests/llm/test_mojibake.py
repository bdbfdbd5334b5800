import pytest
from sieveworks.llm import mojibake as M

CLEAN = [
    "Prüfung {} für Übergangsstück; Stoff enthält höchstens 4 % Gegenion.",
    "Vérifié le {} : élément déjà retiré de la liste.",
    "NÃO aplicável à fração {}; avaliação concluída.",
    "Ângulo {}°; SÃO amostras; ¿válido?",
    "모물질과 그 염류에 해당함. 검토번호 {}, 확인.",
    "毒物 該當 여부 {}: 해당 없음, 화학안전과 ??",
    "Проверка {}: соль исходного вещества.",
    "Supplier’s sheet ‘{}’ says “salt, hydrated”… accepted.",
    "Particle size {} µm; α/β ratio ≥ 2.",
    "Purity 98 % ± {} %, stored at 4 °C – see “batch”.",
    "plain text {}",
]


@pytest.mark.parametrize("pair", M.PAIRS)
def test_restore_undoes_garble(pair):
    for t in CLEAN:
        g = M.garble(t, pair)
        if g is not None and g != t:
            assert M.restore(g, pair) == t


def test_found_and_restored_spans(spark):
    made = {}
    rows = [("t", f"c{i}", "f", t.format(i)) for i in range(20_000) for t in [CLEAN[i % len(CLEAN)]]]
    for n, pair in enumerate(M.PAIRS):
        for k, t in enumerate(CLEAN):
            t = t.format(n)
            for errors in ("strict", "replace"):
                g = M.garble(t, pair, errors)
                if g is not None and g != t and not g.isascii():
                    made[f"g{n}-{k}-{errors}"] = t
                    rows.append(("t", f"g{n}-{k}-{errors}", "f", g))
    half = M.garble("concluída höchstens", ("utf-8", "cp1252", 1))
    rows += [("t", "part", "f", "NÃO aplicável; " + half), ("t", "null", "f", None), ("t", "empty", "f", ""), ("t", "long", "f", "Größe " * 20000), ("t", "c0", "f", rows[0][3])]
    made["part"] = "NÃO aplicável; concluída höchstens"
    df = spark.createDataFrame(rows, "table_name string, record_id string, field_name string, text string")
    got = {r["record_id"]: r["restored"] for r in M.garbled(df, M.fit(df, "text")).collect()}
    assert not [r for r in got if r not in made]
    assert len(made) - len(got) <= 0.02 * len(made)
    right = sum(got[r] == made[r] for r in got if got[r] is not None)
    assert right >= 0.9 * sum(v is not None for v in got.values())
    none = df.limit(0)
    assert M.garbled(none, M.fit(none, "text")).count() == 0
