"""The pipeline's stages on planted cases, and the whole of it on the small table."""

import random
import string

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choices("bcdfgaeiou", k=6))
    text = lambda n: [word() for _ in range(n)]
    base, passage = text(400), text(60)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"].split()
    near = list(base)
    near[100], near[300] = "changed", "altered"
    docs = [
        (1, base), (2, base), (3, near), (4, text(200)), (5, text(50) + passage + text(50)), (6, text(50) + passage + text(50)),
        (7, text(80) + item + text(80)), (8, text(100) + ["idiot", "scum", "moron", "worthless", "trash", "idiot"] + text(20)), (9, text(30)),
    ]
    return spark.createDataFrame([(i, " ".join(t), "en", "s", len(" ".join(t))) for i, t in docs] + [(10, None, None, None, None), (11, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")


def stage(name):
    return dict(pipeline.STAGES)[name]


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_stages(spark, planted):
    every = set(range(1, 12))
    assert set(ids(stage("toxicity")(spark, planted, SF))) == every - {8}
    assert set(ids(stage("simhash")(spark, planted, SF))) == every - {2, 3, 11}
    cut = stage("substrings")(spark, planted, SF)
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in cut.collect()}
    assert cut.columns == planted.columns and words[5] == 160 and words[6] == 100 and words[2] == 0 and words[4] == 200
    assert set(ids(stage("decontamination")(spark, planted, SF))) == every - {7}
    packed = stage("packing")(spark, planted, SF)
    assert set(ids(packed)) == every


def test_clashing_columns(spark, planted):
    extra = ["_bad", "_removed", "row", "rest", "windows", "_id", "_h", "_t", "key", "node", "component", "t", "h", "ranges", "n_removed"]
    wide = planted.selectExpr("*", *[f"doc_id as {c}" for c in extra])
    for name, f in pipeline.STAGES[:-1]:
        out = f(spark, wide, SF)
        assert out.columns == wide.columns and all(r[c] == r["doc_id"] for r in out.collect() for c in extra), name


def test_empty(spark, planted):
    for name, f in pipeline.STAGES:
        assert f(spark, planted.limit(0), SF).count() == 0, name


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.count() > 1000 and out.select("sequence_id").distinct().count() == out.count()


def test_simhash_finds_what_brute_force_finds(spark):
    """The same documents stay as by exact similarities of all pairs: no link is lost, and none is below 0.8."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    plain = str.maketrans({c: " " for c in string.punctuation})
    sets, up = {}, {}
    for i, t in sorted(rows):
        w = (t or "").translate(plain).encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        up[i] = i

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    every = sorted(sets)
    for k, i in enumerate(every):
        for j in every[:k]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (a == b or 1.8 * len(a & b) >= 0.8 * (len(a) + len(b))):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert ids(stage("simhash")(spark, docs, SF)) == sorted({find(i) for i in every})


def test_simhash_similarity(spark):
    """Groups hang together over pairs of five-word shingle sets from 0.8 on: all such pairs, short texts too, and no others."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("bcdfgaeiou", k=7))
    docs, groups, at = [], [], 0

    def plant(n, a, b, linked):  # n shared shingles, and a and b own ones at the end
        nonlocal at
        base = [word() for _ in range(n + 4)]
        docs.extend([(at, " ".join(base + [word() for _ in range(a)])), (at + 1, " ".join(base + [word() for _ in range(b)]))])
        groups.append((at, at + 1, linked))
        at += 2

    for _ in range(25):
        for n, a, b in ((4, 0, 1), (12, 0, 3), (12, 1, 2), (5, 0, 1), (32, 4, 4), (36, 4, 5), (40, 0, 10), (400, 50, 50), (80, 10, 10)):
            plant(n, a, b, True)
        for n, a, b in ((3, 0, 1), (11, 0, 3), (300, 50, 50), (75, 12, 13), (30, 4, 4)):
            plant(n, a, b, False)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {x["doc_id"] for x in (dict(pipeline.STAGES)["simhash"](spark, df, SF).collect())}
    assert {a for a, _, _ in groups} <= kept
    assert not [(a, b) for a, b, linked in groups if not linked and b not in kept]
    missed = [(a, b) for a, b, linked in groups if linked and b in kept]
    assert not [a for a, b in missed if len(docs[a][1].split()) <= 48] and len(missed) <= 2


def test_simhash_texts_under_one_id(spark):
    r = random.Random(3)
    text = lambda: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(90))
    a, b = text(), text()
    df = spark.createDataFrame([(1, a), (1, b), (1, a), (2, a + " more"), (3, b + " more")], "doc_id long, text string")
    kept = (dict(pipeline.STAGES)["simhash"](spark, df, SF).collect())
    assert sorted((x["doc_id"], x["text"]) for x in kept) == sorted([(1, a), (1, b)])
