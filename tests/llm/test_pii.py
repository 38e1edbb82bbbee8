import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.llm.workspace import Workspace

CASES = {
    1: "Write to Ann.Lee+7@Mail2.Example.com or ann.lee+7@mail2.example.com now",
    2: "Call +1 (663) 555-6869, that is +1 663-555-6869 or 663-555-6869.",
    3: "Card 4465758382889437 is 4465 7583 8288 9437###",
    4: 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###',
    5: "from 233.233.171.252 and 10.0.0.7!! not 1.2.3 nor 999.1.1.1",
    6: "Mrs. Karen Miller met Mr Smith; KAREN MILLER and Karen Miller. Иван Петров ушёл",
    7: "nothing here, 12345 and a@b",
    8: "078-05-1120",
}


def rewritten(spark, cases, **more):
    df = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    return {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.replace_entities(df, **more).collect()}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10


@pytest.fixture(scope="module")
def out(spark):
    return rewritten(spark, CASES)


def test_formats_and_coreference(out):
    a, b = re.findall(r"[\w.+]+@[\w.]+", out[1][0])
    assert a.lower() == b and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\+\d@[A-Z][a-z]{3}\d\.[A-Z][a-z]{6}\.com", a) and b != "ann.lee+7@mail2.example.com"
    x, y = re.findall(r"\+1 ?\(?\d{3}\)?[ -]\d{3}-\d{4}", out[2][0])
    assert re.sub(r"\D", "", x) == re.sub(r"\D", "", y) != "16635556869" and out[2][1] == 3
    m = re.fullmatch(r"Card (\d{16}) is (\d{4} \d{4} \d{4} \d{4})###", out[3][0])
    assert m[1] == m[2].replace(" ", "") != "4465758382889437" and m[1][0] == "4" and luhn(m[1]) == luhn("4465758382889437")
    assert re.fullmatch(r'token = "[0-9a-f]{40}"###', out[4][0]) and "24be" not in out[4][0]
    m = re.fullmatch(r"from (\d{3}\.\d{3}\.\d{3}\.\d{3}) and (\d{2}\.\d\.\d\.\d)!! not 1.2.3 nor 999.1.1.1", out[5][0])
    assert m and all(int(o) <= 255 for g in m.groups() for o in g.split("."))
    assert out[7] == (CASES[7], 0)
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", out[8][0]) and out[8][0] != CASES[8]


def test_names_keep_gender_script_and_case(out):
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr (\w+); KAREN MILLER and (\w+) (\w+)\. (\w+) (\w+) ушёл", out[6][0])
    assert m and m[1] in pii.NAMES["latin", "f"] and (m[1], m[2]) == (m[4], m[5]) and m[2] != "Miller"
    assert m[6] in pii.NAMES["cyrillic", "m"] and re.fullmatch("[А-я]+", m[7])


def test_key_decides(spark, out):
    again, other = rewritten(spark, CASES), rewritten(spark, CASES, key="other")
    assert again == out
    assert all(other[d][0] != out[d][0] for d in CASES if d != 7)


def test_collisions_are_resolved(spark):
    # only 81 * 81 surrogates of this width exist: thousands of entities must collide
    ips = [(i, f"{a}.{b}.{c}.{d}") for i, (a, b, c, d) in enumerate((a, b, c, d) for a in range(1, 6) for b in range(1, 10) for c in range(1, 10) for d in range(1, 6))]
    df = spark.createDataFrame(ips, "doc_id long, text string")
    rows = pii.replace_entities(df).collect()
    new = [r["text"] for r in rows]
    assert len(set(new)) == len(ips) and not {t for _, t in ips} & set(new)


def test_odd_rows(spark, odd_docs, no_docs):
    df = odd_docs.withColumn("n_entities", F.lit("clash"))
    out = pii.replace_entities(df)
    assert sorted(out.columns) == sorted(df.columns)
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect()) == sorted((r["doc_id"] or -1, r["text"] or "") for r in odd_docs.collect())
    assert pii.replace_entities(no_docs).collect() == []
    long = spark.createDataFrame([(1, "x" * 300_000 + " a@b.co " + "1" * 300_000 + " " + "a.b" * 100_000), (1, "a@b.co"), (1, "a@b.co")], "doc_id long, text string")
    assert [r["n_entities"] for r in pii.replace_entities(long).collect()] == [1, 1, 1]


def test_query_rewrites_and_leaves_clean_texts(spark):
    sf = "/root/testdata/sf0.01"
    old = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op6_surrogates(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(old) and len(rows) == len(old)
    private = re.compile(r"[\w.%+\-]+@[\w.\-]+\.[A-Za-z]{2,}|(?<!\d)\d{16}(?!\d)|\+1 \(\d{3}\) \d{3}-\d{4}|\b[0-9a-f]{40}\b|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d)")
    pairs = defaultdict(set)
    for r in rows:
        a, b = private.findall(old[r["doc_id"]]), private.findall(r["text"])
        assert len(a) == len(b) and private.sub("", old[r["doc_id"]]) == private.sub("", r["text"])
        assert not set(a) & set(b)
        assert r["n_entities"] >= len(a)
        for x, y in zip(a, b):
            pairs[x].add(y)
    assert len(pairs) > 50 and all(len(v) == 1 for v in pairs.values()) and len({*map(frozenset, pairs.values())}) == len(pairs)


def test_entities_after_letters_of_any_script(spark):
    before = ["联系", "почта", "é", "密钥", "mañana é", "ß", "Ж", "x", "x é", "🙂", "7", "", "日本_"]
    what = ["john@example.com", "john.b@example.com", "f0ddae3b" * 5, "F0DDAE3B" * 4, "10.0.0.7", "Karen Miller", "Иван Петров", "663-555-6869"]
    rows = [(i, b + w + a) for i, (b, w, a) in enumerate((b, w, a) for b in before for w in what for a in ("", " да", "。"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    assert all(r["a"] == r["b"] for r in df.select(found(pii.ENTITY).alias("a"), found(pii._ANY).alias("b")).collect())
    got = rewritten(spark, {i: b + w for i, (b, w) in enumerate((b, w) for b in before[:4] for w in what[:3])})
    assert all(n == 1 and "john" not in t and "f0ddae3b" not in t for t, n in got.values())


def test_parts_of_names_and_phones_agree(spark):
    text = "Karen Miller, Mrs Miller, Ms. Karen Miller, Mr Paul Miller, Linda Miller; +1 663-555-6869, (663) 555-6869, +44 663 555 6869, Karen Smith. Anna Петрова, г-жа Петрова"
    out, n = rewritten(spark, {1: text})[1]
    m = re.fullmatch(r"(\w+) (\w+), Mrs (\w+), Ms\. (\w+) (\w+), Mr (\w+) (\w+), (\w+) (\w+); \+1 ([\d-]+), ([()\d -]+), \+44 ([\d ]+), (\w+) (\w+)\. (\w+) (\w+), г-жа (\w+)", out)
    assert m and n == 11
    g = (None, *m.groups())
    assert {g[i] for i in (2, 3, 5, 7, 9)} == {g[2]} != {"Miller"} and g[14] != g[2]
    assert g[1] == g[4] == g[13] and len({g[1], g[6], g[8]}) == 3 and {g[1], g[8], g[15]} <= {*pii.NAMES["latin", "f"]} and g[6] in pii.NAMES["latin", "m"]
    assert g[16] == g[17] != "Петрова" and re.fullmatch("[А-я]+", g[16])
    assert len({re.sub(r"\D", "", g[i]) for i in (10, 11, 12)}) == 1 and re.sub(r"\D", "", g[10]) != "6635556869"


PEOPLE = [
    "Mr Zoltan Kovacs",
    "Dr Priya Raman",
    "Mary Jane Watson",
    "Prof. Ludwig van der Berg",
    "John Q. Public",
    "Frau Anna-Lena Müller",
    "Señor José O'Brien",
    "г-н Сергей Иванович Петров",
    "Mrs Smith-Jones",
    "Hans von Trapp",
]


def test_whole_names_go(spark):
    cases = {i: f"we met {p} and {p}'s friend." for i, p in enumerate(PEOPLE)}
    out = rewritten(spark, cases)
    titles = {t for ts in pii.TITLES.values() for t in ts}
    for i, p in enumerate(PEOPLE):
        text, n = out[i]
        m = re.fullmatch(r"we met (.+) and (.+)'s friend\.", text)
        assert m and m[1] == m[2] and n == 2
        old, new = p.split(" "), m[1].split(" ")
        assert len(old) == len(new)
        for a, b in zip(old, new):
            assert (a == b) == (a.rstrip(".") in titles or a in pii._PARTICLES), (p, m[1])
    both = rewritten(spark, {1: "Mr Zoltan Kovacs, Mr Bela Kovacs, Mr Zoltan Nagy, Z. Kovacs"})[1][0]
    m = re.fullmatch(r"Mr (\w+) (\w+), Mr (\w+) (\w+), Mr (\w+) (\w+), Z\. (\w+)", both)
    assert m and m[1] == m[5] != m[3] and m[2] == m[4] == m[7] != m[6]


def test_a_surname_alone_follows_its_person(spark):
    text = "Mr John Smith and Smith's dog; Smith, Smithson, Blacksmith, Smith-Jones, SMITH. (Smith) Dr Wei Zhang: Zhang"
    out, n = rewritten(spark, {1: text, 2: "Smith alone is nobody here"})[1]
    m = re.fullmatch(r"Mr (\w+) (\w+) and (\w+)'s dog; (\w+), Smithson, Blacksmith, Smith-Jones, SMITH\. \((\w+)\) Dr (\w+) (\w+): (\w+)", out)
    assert m and n == 6 and m[2] == m[3] == m[4] == m[5] != "Smith" and m[7] == m[8] != "Zhang"


def test_addresses_of_any_script(spark):
    cases = {
        1: "a josé.garcía@example.com b",
        2: "владимир@пример.рф",
        3: "联系john@example.com联系",
        4: "Zoë@müller.example",
        5: "x" * 200 + "@example.com",
    }
    out = rewritten(spark, cases)
    assert all(n == 1 for _, n in out.values())
    m = re.fullmatch(r"a ([a-z]{4}\.[a-z]{6}@[a-z]{7}\.com) b", out[1][0])
    assert m and m[1] != cases[1][2:-2]
    assert re.fullmatch(r"[а-я]{8}@[а-я]{6}\.рф", out[2][0]) and out[2][0] != cases[2]
    assert re.fullmatch(r"联系[a-z]{4}@[a-z]{7}\.com联系", out[3][0]) and "john" not in out[3][0]
    assert re.fullmatch(r"[A-Z][a-z]{2}@[a-z]{6}\.example", out[4][0])


def test_names_that_clash_with_helpers(spark):
    names = ["file", "line", "row", "found", "new", "gaps", "at", "kind", "canon", "surface", "surnames", "mentions", "_file", "_row", "_found", "a.b"]
    df = spark.createDataFrame([(1, "a@b.co"), (2, "none"), (None, None)], "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    out = pii.replace_entities(df)
    assert out.columns == [*df.columns, "n_entities"]
    assert {tuple(r[2:-1]) for r in out.collect()} == {tuple(names)}
