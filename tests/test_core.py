import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import bits
from tessera.operators import bitmaps, division, encode, paths, sets, topk
from tessera.plans import core
from tessera.sources import containers, generators, histograms, layout
from tessera.sources.relations import DA_SCHEMA, DT_SCHEMA, canonical_dt
from tests.oracle import assert_same

SF = "/root/testdata/sf0.01"
DOCS = {1: [1, 5, 7, 10, 1005], 2: [2, 7, 8, 10, 2000], 3: [2, 5, 7, 9, 3000], 4: [2, 7, 9, 1000, 5000], 5: [3, 4, 7, 2000]}


@pytest.fixture(scope="module")
def dt(spark):
    return spark.createDataFrame([(d, t, 1 + (d + t) % 4) for d, ts in DOCS.items() for t in ts], DT_SCHEMA).cache()


@pytest.fixture(scope="module")
def da(spark):
    return spark.createDataFrame([(1, 100), (2, 100), (2, 200), (3, 200), (4, 300), (5, 300), (5, 100)], DA_SCHEMA).cache()


def docs(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "doc long")


def pairs(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_oracle(spark, name, sf):
    d = f"/root/testdata/{sf}"
    assert_same(core.QUERIES[name](spark, d), core.oracles(d)[name], d)


def test_self_test_context(spark, dt):
    assert sorted(r[0] for r in division.docs_in_context(dt, [9, 7, 2]).collect()) == [3, 4]
    assert sorted(r[0] for r in division.docs_in_context(dt, [9, 7, 2, 2]).collect()) == [3, 4]
    ctx = spark.createDataFrame([(9,), (7,), (2,)], "term long")
    assert sorted(r[0] for r in division.docs_in_context(dt, ctx).collect()) == [3, 4]
    assert division.count_docs_in_context(dt, [9, 7, 2]).first()[0] == 2
    assert division.count_docs_in_context_bitmap(division.posting_bitmaps(dt), [9, 7, 2]).first()[0] == 2
    assert division.docs_in_context(dt, [424242]).count() == 0
    with pytest.raises(ValueError):
        division.docs_in_context(dt, [])


def test_topk(spark, dt):
    every = docs(spark, [1, 2, 3, 4, 5])
    assert pairs(topk.topk_terms(dt, every, 5)) == [(7, 5), (2, 3), (5, 2), (9, 2), (10, 2)]
    assert pairs(topk.topk_terms_in_context(dt, [9, 7, 2], 5)) == [(2, 2), (7, 2), (9, 2), (5, 1), (1000, 1)]
    assert pairs(topk.topk_tf_in_context(dt, [9, 7, 2], 5)) == [(7, 7), (2, 5), (3000, 4), (9, 3), (5, 1)]
    assert len(pairs(topk.topk_with_ties(topk.term_counts(dt, every), "term", "score", 3))) == 6
    assert topk.topk_terms(dt, every, 0).count() == 0
    assert topk.topk_terms(dt, every, 99).count() == 14
    with pytest.raises(ValueError):
        topk.topk_terms(dt, every, -1)


def test_bag_and_set(spark, dt):
    twice = docs(spark, [3, 3, 4])
    bag, as_set = dict(pairs(topk.topk_tf(dt, twice, 99))), dict(pairs(topk.topk_tf_set(dt, twice, 99)))
    assert bag[3000] == 2 * as_set[3000] and bag[5000] == as_set[5000]
    assert dict(pairs(topk.topk_tf_dual_list(topk.dual_lists(dt), twice, 99))) == bag


def test_paths(spark, dt, da):
    assert dict(pairs(paths.cooccurrence_count(dt, 3))) == {1: 2, 2: 2, 3: 5, 4: 3, 5: 1}
    assert dict(pairs(paths.cooccurrence_tf(dt, 3))) == {1: 4, 2: 3, 3: 11, 4: 9, 5: 1}
    assert dict(pairs(paths.authors_in_docs(da, docs(spark, [3, 4])))) == {200: 1, 300: 1}
    want = {100: {100: 24, 200: 14, 300: 11}, 200: {100: 14, 200: 14, 300: 8}, 300: {100: 11, 200: 8, 300: 11}}
    for a, reach in want.items():
        assert dict(pairs(paths.author_reach(dt, da, a))) == reach == dict(pairs(paths.author_reach_paths(dt, da, a)))


def test_duplicates_and_zero(spark):
    raw = spark.createDataFrame([(1, 5, 2), (1, 5, 3), (2, 5, 0), (None, 5, 1)], DT_SCHEMA)
    clean = canonical_dt(raw)
    assert sorted(pairs(clean)) == [(1, 5, 5), (2, 5, 0)]
    assert pairs(topk.topk_tf(clean, docs(spark, [2]), 5)) == [(5, 0)]


def test_dense(spark, dt):
    dim = spark.createDataFrame([(7,), (6,)], "term long")
    counts = topk.term_counts(dt, docs(spark, [1])).where("term = 7")
    assert dict(pairs(topk.dense_counts(counts, dim, "term"))) == {7: 1, 6: 0}
    with pytest.raises(Exception, match="out of range"):
        topk.dense_counts(topk.term_counts(dt, docs(spark, [1])), dim, "term").collect()


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "doc long") for v in ([1, 2, 3, 3], [3, 4]))
    got = lambda df: sorted(r[0] for r in df.collect())
    assert got(sets.intersect(a, b)) == [3] == got(sets.intersect_all([a, b]))
    assert got(sets.union(a, b)) == [1, 2, 3, 4]
    assert got(sets.difference(a, b)) == [1, 2]
    assert got(sets.symmetric_difference(a, b)) == [1, 2, 4]
    assert got(sets.keep_members(a, b)) == [3, 3]
    assert sets.contains(a, 2) and not sets.contains(a, 9)
    assert got(sets.add(a, [9])) == [1, 2, 3, 9] and got(sets.elements(a)) == [1, 2, 3]
    assert sets.equal(a, a.distinct()) and not sets.equal(a, b)


def test_rle(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([4, 4, 4, 1, 1, 4])], "g string, i long, v long")
    runs = encode.rle_encode(df, "g", "i", "v")
    assert sorted(pairs(runs)) == [("g", 1, 4, 3), ("g", 2, 1, 2), ("g", 3, 4, 1)]
    assert encode.sum_over_rle(encode.rle_sorted(df, "v")).first() == encode.sum_plain(df, "v").first() == encode.sum_over_rle(runs).first()
    assert encode.rle_encode(df.limit(0), "g", "i", "v").count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_directory_ranges(spark, kind):
    """Clustered keys, nulls and any type: row ids are where runs start in the sorted table."""
    keys = [None] * 3 + [1] * 5 + [2] + [10**12 + i // 2 for i in range(40)] + [10**15]
    df = spark.createDataFrame([(None if k is None else str(k) if kind == "string" else k,) for k in keys], f"k {kind}")
    got = {r["k"]: (r["length"], r["row_id"]) for r in encode.rle_directory(df, "k", keys_in_part=4).collect()}
    order = sorted((r["k"] for r in df.collect()), key=lambda k: (k is not None, k or ""if kind == "string" else k or 0))
    assert got == {k: (order.count(k), order.index(k)) for k in set(order)}
    assert encode.rle_directory(df.limit(0), "k").count() == 0


def test_huffman(spark):
    for values in ([3] * 5, [1, 1, 2, 3, 3, 3, 3, 9], [i % 97 * i % 13 for i in range(20_000)], [2**40, -5, 0, 0]):
        df = spark.createDataFrame([(i % 2 if len(values) < 100 else 0, i, v) for i, v in enumerate(values)], "g long, i long, v long")
        codes = encode.huffman_codes(df, "v")
        packed = encode.huffman_encode(df, codes, "g", "i", "v", block=64)
        back = encode.huffman_decode(packed, codes, "g")
        for g in (0, 1):
            assert [r["value"] for r in back.where(f"g = {g}").orderBy("pos").collect()] == [r["v"] for r in df.where(f"g = {g}").orderBy("i").collect()]
        assert encode.sum_over_huffman(packed, codes).first()[0] == sum(values)
        r = encode.huffman_size_estimate(codes).first()
        n = len(values)
        entropy = -sum(values.count(x) / n * math.log2(values.count(x) / n) for x in set(values))
        assert entropy - 1e-9 <= r["bits"] / n < entropy + 1.0001 and r["bits_rounded"] % 4 == 0 and r["uncompressed_bits"] == 16 * n
        assert sum(r["n_bits"] for r in packed.collect()) == r["bits"] and all(len(x["bits"]) == (x["n_bits"] + 7) // 8 for x in packed.collect())
    assert packed.rdd.getNumPartitions() >= 1 and encode.huffman_codes(df.limit(0), "v").count() == 0
    empty = encode.huffman_codes(df.limit(0), "v")
    assert encode.huffman_decode(encode.huffman_encode(df.limit(0), empty, "g", "i", "v"), empty, "g").count() == 0


def test_huffman_large_group_is_several_tasks(spark):
    df = spark.range(50_000).selectExpr("0L as g", "id as i", "id % 7 as v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    packed = encode.huffman_encode(df, encode.huffman_codes(df, "v"), "g", "i", "v")
    assert packed.select(F.spark_partition_id()).distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with pytest.raises(ValueError):
        encode._Table([{"symbol": i, "length": 57 + i, "code": "0"} for i in range(2)])


def test_huffman_lengths_merge_in_order():
    """The lengths of a heap of nodes that are merged one by one, for all sorts of ties."""
    r = random.Random(2)
    cases = [[r.choice(c) for _ in range(n)] for n in (2, 3, 4, 7, 50, 333) for c in ([1], [1, 2], [1, 2, 3, 5, 8, 13], range(1, 60), [1] * 9 + [500])]
    for freqs in [*cases, [1, 1, 2, 3, 5, 8, 13, 21, 34], [7]]:
        symbols = r.sample(range(-1000, 1000), len(freqs))
        heap, depth = sorted((n, s, [s]) for s, n in zip(symbols, freqs)), dict.fromkeys(symbols, 0)
        while len(heap) > 1:
            (n1, s1, a), (n2, s2, b) = heapq.heappop(heap), heapq.heappop(heap)
            for s in a + b:
                depth[s] += 1
            heapq.heappush(heap, (n1 + n2, min(s1, s2), a + b))
        got = encode.huffman_lengths(np.array(symbols), np.array(freqs))
        assert got.tolist() == [max(depth[s], 1) for s in symbols]


@pytest.fixture(scope="module")
def many_symbols(spark):
    return spark.range(200_000).selectExpr("id % 100000 - 7 as v", "id div 64 as g", "id as i")


def test_huffman_histogram_of_many_symbols(many_symbols):
    """100,000 symbols twice each: 2**17 - 100,000 codes of 16 bits, the others of 17."""
    want = {16: 31_072, 17: 68_928}
    assert dict(pairs(encode.huffman_length_histogram(encode.huffman_code_lengths(many_symbols, "v")))) == want
    codes = encode.huffman_codes(many_symbols, "v")
    assert dict(pairs(encode.huffman_length_histogram(codes))) == want
    packed = encode.huffman_encode(many_symbols, codes, "g", "i", "v")
    assert encode.sum_over_huffman(packed, codes).first()[0] == 2 * sum(range(-7, 99_993))


def test_huffman_estimate_of_many_symbols(many_symbols):
    r = encode.huffman_size_estimate(encode.huffman_code_lengths(many_symbols, "v")).first()
    assert tuple(r) == (16 * 200_000, 2 * (16 * 31_072 + 17 * 68_928), 2 * (16 * 31_072 + 20 * 68_928), 200_000, 100_000, 17)


def test_bitmaps(spark, tmp_path):
    a = {1: {1, 5, 32_768, 32_769, 100_000}, 2: {0, 7}, 3: {9}}
    b = {1: {5, 32_769, 70_000}, 3: {9}, 4: {-3, 40_000}}
    make = lambda x: bitmaps.from_rows(spark.createDataFrame([(k, p) for k, ps in x.items() for p in ps], "k long, p long"), "k", "p")
    x, y = make(a), make(b)
    back = lambda m: {(r["key"], r["position"]) for r in bitmaps.positions(m).collect()}
    flat = lambda m: {(k, p) for k, ps in m.items() for p in ps}
    assert back(x) == flat(a) and back(y) == flat(b)
    want = {"and": flat(a) & flat(b), "or": flat(a) | flat(b), "xor": flat(a) ^ flat(b), "andnot": flat(a) - flat(b)}
    for name, pairs_ in want.items():
        assert back(bitmaps.combine(x, y, name)) == pairs_, name
    every = make({0: {1, 5, 7, 9, 32_768, 32_769, 100_000, 200_000}})
    assert back(bitmaps.complement(x, every)) == {(k, p) for k in a for p in {1, 5, 7, 9, 32_768, 32_769, 100_000, 200_000} - a[k]}
    assert {(r["key"], r["total"]) for r in bitmaps.position_sums(y).collect()} == {(k, sum(ps)) for k, ps in b.items()}
    assert {(r["key"], r["n"]) for r in bitmaps.cardinality(x).collect()} == {(k, len(ps)) for k, ps in a.items()}
    bitmaps.save(x, str(tmp_path / "b"))
    assert back(bitmaps.load(spark, str(tmp_path / "b"), [1, 3])) == flat({k: a[k] for k in (1, 3)})
    assert back(bitmaps.any_of(x, [1, 2, 2])) == {(0, p) for p in a[1] | a[2]} and back(bitmaps.all_of(x, [1, 3])) == set()
    with pytest.raises(ValueError):
        bitmaps.combine(x, y, "nand")


def test_bitmap_differences(spark):
    """Lists and bitmaps are compared bucket by bucket; where they differ, and there alone, members are named."""
    make = lambda x: spark.createDataFrame([(k, p) for k, ps in x.items() for p in ps], "k long, p long")
    a = {1: {1, 8, 9, 16, 32_768, 32_769, 100_000}, 2: {0, -7, -40_000, 7}, 3: {9}, 5: set(range(1, 33_000)), None: {4, 5}}
    b = {1: {1, 8, 9, 15, 32_768, 32_769}, 2: {0, -7, -40_001, 7}, 4: {50_000}, 5: set(range(1, 33_000)), None: {5, 6}}
    lists = generators.fragments(make(a).union(make({3: {9}})), "k", "p")
    for sparse in (True, False):
        assert bitmaps.differences(lists, "k", bitmaps.from_rows(make(a), "k", "p", sparse)).count() == 0
        held = bitmaps.from_rows(make(b), "k", "p", sparse)
        got = pairs(bitmaps.differences(lists, "k", held))
        flat = lambda m: {(k, p) for k, ps in m.items() for p in ps}
        want = {(k, p, "bitmap") for k, p in flat(a) - flat(b)} | {(k, p, "list") for k, p in flat(b) - flat(a)}
        assert set(got) == want and len(got) == len(want)
        named = generators.fragment_differences(lists.where("k is not null"), "k", bitmaps.positions(held.where("key is not null")))
        assert set(pairs(named)) == {x for x in want if x[0] is not None}
    assert bitmaps.differences(lists.limit(0), "k", held.limit(0)).count() == 0


def test_fragment_check_compares_buckets(spark):
    """Bitmaps are not turned to rows, but for the buckets that differ, and no exchange of all rows tells them apart."""
    plan = core.QUERIES["fragment_check"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Except" not in plan and "replicaterows" not in plan.lower()


def test_bucketed_copies_need_no_exchange(spark, dt, da):
    kept = layout.bucketed(dt, da, 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan(dt.join(da, "doc")) and "Exchange" not in plan(kept.dt_doc.join(kept.da_doc, "doc"))
        assert "Exchange" not in plan(kept.dt_term.groupBy("term").count())
        assert dict(pairs(paths.author_reach(kept.dt_doc, kept.da_doc, 100, kept.dt_term))) == {100: 24, 200: 14, 300: 11}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        kept.drop()


def test_column_store_reads_runs_alone(spark, dt):
    by_term, by_doc = layout.ColumnStore.write(dt, "term"), layout.ColumnStore.write(dt, "doc")
    assert sorted(r[0] for r in layout.docs_in_context(by_term, [9, 7, 2, 2]).collect()) == [3, 4]
    assert layout.docs_in_context(by_term, [424242]).count() == 0
    with pytest.raises(ValueError):
        layout.docs_in_context(by_term, [])
    got = {r["doc"]: (r["score"], r["tf"]) for r in layout.cooccurrence(by_doc, by_term, 3).collect()}
    assert got == {1: (2, 4), 2: (2, 3), 3: (5, 11), 4: (3, 9), 5: (1, 1)}
    scan = by_term.lookup([7])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in scan and "EqualTo(part," in scan and "GreaterThanOrEqual(row," in scan
    by_term.drop(), by_doc.drop()


def test_saved_containers_prune_row_groups(spark, tmp_path):
    """A load by id reads the files whose statistics hold it, not the others."""
    path = str(tmp_path / "c")
    containers.save(spark.range(40_000).selectExpr("id div 100 as id", "id % 100 as pos", "id as element", "cast(null as long) as attribute"), path, files=8)
    import glob

    import pyarrow.parquet as pq

    ranges = [(s.min, s.max) for f in glob.glob(f"{path}/*.parquet") for g in [pq.ParquetFile(f).metadata] for i in range(g.num_row_groups) for s in [g.row_group(i).column(0).statistics]]
    assert len(ranges) >= 4 and sum(lo <= 250 <= hi for lo, hi in ranges) == 1
    assert "EqualTo(id,250)" in containers.load(spark, path, 250)._jdf.queryExecution().executedPlan().toString()


def test_containers(spark, tmp_path):
    path = str(tmp_path / "c")
    containers.save(containers.from_values(spark, 1, containers.parse_values("3 5 0x10 010")), path)
    containers.save(containers.from_values(spark, 2, [9]), path)
    assert [r[0] for r in containers.elements(containers.load(spark, path, 1)).collect()] == [5, 8, 16]
    assert containers.load(spark, path, 77).count() == 0
    containers.save(containers.from_values(spark, 3, [4, 6], [40, 60]), path)
    assert [(r["element"], r["attribute"]) for r in containers.load(spark, path, 3).orderBy("pos").collect()] == [(4, 40), (6, 60)]
    to = str(tmp_path / "d")
    containers.replace(spark, path, containers.from_values(spark, 3, [8]), to)
    assert sorted((r["id"], r["element"]) for r in spark.read.parquet(to).where("id >= 2").collect()) == [(2, 9), (3, 8)]
    containers.save(containers.from_values(spark, 3, []), path)
    newer = containers.upsert(spark.read.parquet(path), containers.from_values(spark, 1, [4]))
    assert sorted((r["id"], r["element"]) for r in newer.where("id < 3").collect()) == [(1, 4), (2, 9)]
    with pytest.raises(ValueError):
        containers.parse_values("3 1")


def test_histogram_text(spark, tmp_path):
    (tmp_path / "h").write_text("3 7\n0x10 2\n")
    assert sorted(pairs(histograms.read_histogram(spark, str(tmp_path / "h")))) == [(0, 7), (1, 16), (2, 2)]
    assert histograms.read_histogram(spark, str(tmp_path / "none")) is None


def test_generators_and_bits(spark):
    assert generators.random_list(spark, 100, 10).count() == 100
    s = generators.random_set(spark, 100, 10)
    assert s.count() == s.distinct().count() <= 10
    assert generators.parameter_lists([2, 3], 50, 123) == generators.parameter_lists([2, 3], 50, 123)
    r = spark.range(1).select(bits.popcount(F.lit(7)), bits.trailing_zeros(F.lit(8).cast("long")), bits.round_up(F.lit(5), 4)).first()
    assert tuple(r) == (3, 3, 8)


def test_more_generators(spark):
    n = 20_000
    share = lambda e, cond: spark.range(n).select(e.alias("x")).where(cond).count() / n
    assert abs(share(generators.skewed_frequency(1), "x = 1") - 0.2558) < 0.02 and share(generators.skewed_frequency(1), "x < 0 or x > 39") == 0
    assert abs(share(generators.byte_frequency(1), "x >= 15") - 0.188) < 0.02 and share(generators.byte_frequency(1), "x < 0 or x > 255") == 0
    m = generators.random_map(spark, 1000, 300)
    assert m.count() == m.select("element").distinct().count() and m.where("attribute < 0 or attribute > 255").count() == 0
    hist = spark.createDataFrame([(1, 3), (2, 1), (3, 0)], "term long, n long").where("n > 0")
    tuples = generators.tuples_from_histogram(hist, "term", 50)
    assert sorted(pairs(tuples.groupBy("term").count())) == [(1, 3), (2, 1)] and tuples.where("value < 0 or value > 49").count() == 0
    order = [r[0] for r in generators.shuffled(spark.range(50)).collect()]
    assert order != sorted(order) and sorted(order) == list(range(50)) and order == [r[0] for r in generators.shuffled(spark.range(50)).collect()]
    assert pairs(histograms.group_size(hist, "term", 1)) == [(3,)] and histograms.group_size(hist, "term", 9).count() == 0
    assert pairs(histograms.random_group(hist, "term")) == pairs(histograms.random_group(hist, "term")) and histograms.random_group(hist.limit(0), "term").count() == 0
    lists = generators.fragments(tuples, "term", "value")
    held = bitmaps.from_rows(tuples, "term", "value")
    assert generators.fragment_differences(lists, "term", bitmaps.positions(held)).count() == 0
    assert generators.fragment_differences(lists.where("term = 1"), "term", bitmaps.positions(held)).where("missing_in = 'list' and key = 2").count() == 1


def test_rank_terms(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 1), ("b", 1, 2)], "g string, term long, score long")
    assert sorted((r["g"], r["term"], r["rank"]) for r in topk.rank_terms(df, "g").collect()) == [("a", 1, 1), ("a", 2, 1), ("a", 3, 3), ("b", 1, 1)]


def test_plan_shapes(spark):
    plan = core.QUERIES["topk_tf_in_context"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "In(l_partkey, [260,625])" in plan
    # words of a document are one row: only words and their counts move
    plan = core.QUERIES["topk_tf_in_context_tokens"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "Join" not in plan
