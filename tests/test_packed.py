import json
import random

import pyarrow as pa

from sieveworks.operators import packed


BLANK = " \t\r\n\x85\xa0\u202f\u3000" + "".join(map(chr, range(0x2000, 0x200E)))


def clean(member):
    member = member.strip(packed.BLANKS)
    if len(member) >= 2 and member[0] == '"' and member[-1] == '"':
        member = member[1:-1].replace('""', '"').strip(packed.BLANKS)
    return member


def plain(field):
    """The rules of the split, character by character."""
    s = field.strip(packed.BLANKS)
    if s.startswith("[") and s.endswith("]") and s[1:].lstrip(packed.BLANKS).startswith('"'):
        return [x for x in (y.strip(packed.BLANKS) for y in json.loads(s)) if x]
    out, cur, quoted = [], "", False
    for i, c in enumerate(field):
        quoted ^= c == '"'
        before = i == 0 or field[i - 1] in BLANK
        after = i + 1 == len(field) or field[i + 1] in BLANK
        near = (i > 0 and field[i - 1] == '"') or (i + 1 < len(field) and field[i + 1] == '"')
        if not quoted and (c in ";|\n\t；、" or (c in "+&/" and before and after) or (c == "," and (before or after or near))):
            out.append(cur)
            cur = ""
        else:
            cur += c
    out.append(cur)
    return [x for x in map(clean, out) if x]


CASES = {
    "a;b": ["a", "b"],
    '"a;b";c': ["a;b", "c"],
    '"2,4-x ""A"" grade" | 1,3-y': ['2,4-x "A" grade', "1,3-y"],
    "Bis(2,4-x) ether, 2-(y)ethanol": ["Bis(2,4-x) ether", "2-(y)ethanol"],
    '["a","b; c"]': ["a", "b; c"],
    r'["a \"q\"; b", "\u00e9", ""] ': ['a "q"; b', "é"],
    '[ "a" , "b|c" ]': ["a", "b|c"],
    "[a;b]": ["[a", "b]"],
    '"a","b"': ["a", "b"],
    "a；b、c": ["a", "b", "c"],
    ";; a ||b;": ["a", "b"],
    "a + b & c / d": ["a", "b", "c", "d"],
    "a+b/c": ["a+b/c"],
    "": [],
    " \t": [],
    ";;": [],
}


def test_cases():
    got = packed.split_array(pa.array(list(CASES))).to_pylist()
    assert got == list(CASES.values())


def test_random_fields_against_plain_splitting():
    rng = random.Random(5)
    bits = ["a", "1,2-b", ";", "|", ", ", ",", " + ", "/", "\n", "\t", "；", "、", '"c;d"', '"e ""f"""', " ", "한", "é", "\xa0", "\u3000", "\u200b"]
    fields = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    assert packed.split_array(pa.array(fields)).to_pylist() == [plain(f) for f in fields]


def test_slices_nulls_and_chunks():
    whole = pa.array(["x;y", None, "é；z", ""])
    assert packed.split_array(whole.slice(1, 2)).to_pylist() == [[], ["é", "z"]]
    assert packed.split_array(pa.array([], pa.string())).to_pylist() == []


def test_rows_with_position_and_odd_columns(spark):
    df = spark.createDataFrame([("1", "a;b", "q"), ("2", None, "q"), ("3", "x", "q"), (None, "c|d", "q")], "id string, f string, record_id string")
    rows = {(r["record_id"], r["pos"], r["value"]) for r in packed.unpack(df, "id", ["f"], least=2).collect()}
    assert rows == {("1", 1, "a"), ("1", 2, "b"), (None, 1, "c"), (None, 2, "d")}
    assert packed.unpack(df.limit(0), "id", ["f"]).count() == 0
    long = "v;" * 200_000
    assert packed.unpack(spark.createDataFrame([("1", long)], "id string, f string"), "id", ["f"]).count() == 200_000
