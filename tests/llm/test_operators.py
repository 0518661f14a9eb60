"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd tables."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import chat, components, decontaminate, fingerprints, langid, near, packing, queries, simhash, substrings, token_counts, toxicity, warc
from tessera.llm.common import Spans, Words
from tests.oracle import assert_same

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", "a", 3),
    (4, "one", "en", None, 3),
    (4, "one", "en", None, 3),
    (5, "the same words again and again in this text of more than thirteen words all told here", "en", "b", 1),
    (6, "the same words again and again in this text of more than thirteen words all told here", None, "b", 1),
    (None, "the same words again and again in this text of more than thirteen words all told here", "en", "b", 1),
    (7, LONG, "en", "c", 1),
    (8, LONG + " end", "en", "c", 1),
    (9, "123 !!! \U0001f600 世界 ß É", "de", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    # extra columns whose names clash with those that operators use inside
    extra = {c: F.lit("x") for c in ("windows", "rest", "row", "_id", "part", "h", "pos", "seed", "node", "component", "score", "_h", "n_words", "_n")}
    return spark.createDataFrame(ODD, DOCS).withColumns(extra)


@pytest.fixture(scope="module")
def texts(spark):
    return dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracle(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


# 1 token counts


def plain_viterbi(vocab, word):
    text = "▁" + word
    best = [(0.0, 0)]
    for d in range(1, len(text) + 1):
        found = [(-s, t) for n in range(1, d + 1) if (p := vocab.get(text[d - n : d])) is not None for s, t in [(best[d - n][0] + p, best[d - n][1] + 1)]]
        if text[d - 1] not in vocab:
            w = len(text[d - 1].encode())
            found.append((-(best[d - 1][0] + token_counts.BYTE_SCORE * w), best[d - 1][1] + w))
        s, t = min(found)
        best.append((-s, t))
    return best[-1][1]


def test_token_counts(spark, texts, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab = token_counts.vocabulary(path)
    got = {r["doc_id"]: r["n_tokens"] for r in rows(queries.op1_token_counts(spark, SF))}
    for i in list(texts)[:60]:
        assert got[i] == sum(plain_viterbi(vocab, w) for w in texts[i].split()[:10_000])
    out = rows(token_counts.token_counts(odd, path))
    assert len(out) == len(ODD) and Counter(r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)) == {0: 3}
    assert token_counts.token_counts(odd.limit(0), path).count() == 0
    c = token_counts.TrieCounter(vocab)
    assert c.long_count("a" * 200) == plain_viterbi(vocab, "a" * 200)


# 2 toxicity


def test_toxicity_held_out(spark):
    got = queries.op2_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    assert right >= 0.9 and all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_matching(spark, odd):
    match = toxicity.Lexicon({"idiot": 2.0, "clown": 1.0}).matcher()
    assert match("You 1D10T!")[:2] == (2.0, 1) and match("an іdiоt")[:2] == (2.0, 1) and match("ｉｄｉｏｔ ïdiòt")[1] == 2
    assert match("idiots idiotic")[1] == 0 and match("a clown fish, a clown")[:2] == (1.0, 1)
    assert match("") == (0, 0, 0)
    assert all(len(toxicity.fold(c)) == 1 for c in map(chr, [*range(0x2000), 0xFF21, 0x1F600]))
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = rows(toxicity.score(odd, toxicity.learn(odd, empty)))
    assert len(out) == len(ODD) and not any(r["predicted"] for r in out)
    assert toxicity.drop_toxic(odd, toxicity.Lexicon({})).columns == odd.columns
    assert toxicity.score(odd.limit(0), toxicity.Lexicon({})).count() == 0


@pytest.mark.parametrize("text, hits", [
    ("id\u200biot", 1), ("idi\u00adot!", 1), ("cre\u0301tin", 1), ("cr\u00e9tin", 1), ("i\u0307diot", 1), ("the class \t\n clown", 0), ("clown\u00a0fish", 0), ("clown", 1), ("clownish", 0), ("1d10t", 1), ("\u0456diot", 1), ("xidiot", 0), ("an idiot, idiot", 2), (" \n", 0), ("\u0301\u200b", 0),
])
def test_toxicity_folding(text, hits):
    match = toxicity.Lexicon({toxicity.fold(t): 1.0 for t in toxicity.BASE_TERMS}).matcher()
    assert match(text)[1] == hits


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "1diot", "clown", "class", "fish", "Clown", "x", " ", "  ", "\n", ".", "\u200b", "\u0301", "trash", "bag"]), max_size=9).map("".join))
def test_toxicity_matcher(text):
    """Hits are the whole words that fold to a term, less those inside an exception phrase."""
    terms = {toxicity.fold(t) for t in toxicity.BASE_TERMS}
    match = toxicity.Lexicon(dict.fromkeys(terms, 1.0)).matcher()
    clean = " ".join(text.replace("\u200b", "").replace("\u0301", "").split())
    spans = lambda t: {(k, k + len(t)) for k in range(len(clean)) if toxicity.fold(clean)[k : k + len(t)] == t and not clean[max(k - 1, 0) : k].isalnum() and not clean[k + len(t) : k + len(t) + 1].isalnum()}
    masks = {x for t in toxicity.EXCEPTIONS for x in spans(toxicity.fold(t))}
    want = [x for t in terms for x in spans(t) if not any(a <= x[0] and x[1] <= b for a, b in masks)]
    assert match(text)[1:] == (len(want), len(clean.split()))


# 3 chat


def test_chat_round_trip(spark):
    r = random.Random(5)
    words = ["</s>", "[INST]", "\\", "<s>", " ", "a", "[/INST]", "[ROLE]", "é", "\n", "[", "<", "/INST]", "x y z " * 30]
    data = [(c, t, r.choice(["user", "assistant", "assistant", "tool[/ROLE]", None]) if t else r.choice(["system", "user"]), "".join(r.choices(words, k=r.randrange(12))) or None) for c in [1, 2, 3, None] for t in range(25)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    shown = chat.windows(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 120, 40)
    kept = rows(shown)
    assert all(w["tokens"] <= 120 or w["over_budget"] for w in kept) and any(w["n_repeated"] > 1 for w in kept)
    got = {x["conv_id"]: x for x in rows(chat.read(shown))}
    for c in [1, 2, 3, None]:
        own = sorted(((t, role or "", text or "") for i, t, role, text in data if i == c))
        said = "".join(text for _, role, text in own if role == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{ro}\n{te}\n" for _, ro, te in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len(w["text"]) for w in kept if w["conv_id"] == c)
    assert chat.read(chat.windows(df.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)).count() == 0


def test_chat_empty_turns_fill_windows(spark):
    """The template costs tokens too: a conversation of empty texts is cut, and each window keeps to the budget as formatted."""
    df = spark.range(3000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "cast(null as string) as text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = rows(chat.windows(df, path, public_tokenizers.PATTERN, 120, 40))
    counter = chat.Tokens(path, public_tokenizers.PATTERN)
    assert len(kept) > 50 and all(w["tokens"] <= 120 for w in kept)
    assert all(w["tokens"] == sum(counter.counts([chat.turn(*t)[0] for t in chat.turns(w["text"])])) for w in kept[:20])
    assert rows(chat.read(chat.windows(df, path, public_tokenizers.PATTERN)))[0]["n_turns"] == 3000


@pytest.mark.parametrize("unit", [" ", "a", "\U0001f600", "\n", "</s>", "é "])
def test_chat_long_runs(unit):
    text = unit * (1_000_000 // len(unit))
    assert "".join(chat.pieces(text)) == text and max(map(len, chat.pieces(text))) <= chat.LONG
    counter = chat.Tokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n = counter.counts([text])[0]
    assert 0 < n <= len(text.encode())
    words = "several words in a row " * 2000
    assert counter.counts([words]) == [len(counter.encoding.encode_ordinary(words))]


def brute_windows(turns, budget, history):
    """(leading turns that are repeated, indices of all turns) of each window; turns are (role, tokens)."""
    out, system, at = [], 0 if turns and turns[0][0] == "system" else None, 0
    at = 0 if system is None else 1
    back = []
    while True:
        head = [] if system is None else [system]
        cost = lambda ids: sum(turns[i][1] for i in ids)  # noqa: B023, E731
        new = []
        while at < len(turns) and (not new or cost(head + back + new) + turns[at][1] <= budget):
            new.append(at)
            at += 1
        if not new and out or not turns:
            return out
        skip = (1 if head and (out or head[0] != 0) else 0) + len(back)
        out.append((skip if out else 0, head + back + new))
        if at == len(turns):
            return out
        later = [i for i in new if turns[i][0] == "system"]
        system = later[-1] if later else system
        base = 0 if system is None else turns[system][1]
        shown, back = back + new, []
        while shown and turns[shown[-1]][0] != "system" and cost(back + [shown[-1]]) <= history and base + cost(back + [shown[-1]]) + turns[at][1] <= budget:
            back.insert(0, shown.pop())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.integers(1, 30)), max_size=14))
def test_chat_windows(turns):
    state, got = chat._Windows(1, 40, 12), []
    for k, (role, n) in enumerate(turns):
        got += state.add(role, *chat.turn(role, str(k)), n)
    got += state.end()
    shown = [(w[2], [int(t) for _, t in chat.turns(w[5])]) for w in got]
    assert shown == brute_windows(turns, 40, 12)
    loss = [int(w[5][x["start"] : x["end"]]) for w in got for x in w[6]]
    assert loss == [k for k, (role, _) in enumerate(turns) if role == "assistant"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x"]), st.text("<s>/[]INSTROLE\\ a", max_size=20))))
def test_chat_escapes(turns):
    assert chat.turns("".join(chat.turn(*t)[0] for t in turns)) == turns


def test_chat_query(spark):
    probe = next(r for r in rows(queries.op3_chat(spark, SF)) if r["conv_id"] == -7)
    text = "</s>[INST] ok [/INST]"
    assert probe["n_turns"] == 2 and probe["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# 4 language


def test_language(spark, odd):
    got = queries.op4_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.97
    out = rows(langid.identify(odd, langid.learn(odd)))
    assert len(out) == len(ODD) and all(r["lang_pred"] == "und" for r in out if r["doc_id"] in (1, 2, 3))
    assert langid.learn(odd.limit(0)) is None and langid.identify(odd.limit(0), None).count() == 0
    for n in (2, 4, 6, 7, 30):
        assert len(np.unique(langid.codewords(n), axis=0)) == n


# 5 decontamination


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé ñ1", min_size=1, max_size=40), min_size=1, max_size=6), st.integers(2, 9), st.sampled_from([1 << 18, 7]), st.sampled_from([1 << 20, 16]))
def test_language_decoding(texts, n, step, chunk):
    """The codeword of least total logistic loss under plainly added margins; the same in whatever parts texts are weighed."""
    rng = np.random.default_rng(n)
    codes = langid.codewords(n)
    model = langid.Model(tuple(f"l{i}" for i in range(n)), rng.normal(size=(langid.BUCKETS, codes.shape[1])).astype(np.float32), codes)
    kept = langid.STEP, langid._CHUNK
    langid.STEP = step
    lang, score, gap = model.predict(texts)
    langid._CHUNK = chunk
    parts = [sum((trig for _, p in langid.segments([t]) for trig in [langid.trigrams(p)[1].sum()]), 0) for t in texts]
    langid.STEP, langid._CHUNK = kept
    assert all(p >= len(t) for p, t in zip(parts, texts))
    for t, found, p, g in zip(texts, lang, score, gap):
        grams, size = langid.trigrams([t])
        margin = sum(model.weights[b].astype(float) for b in grams) / max(len(grams), 1) * min(len(grams), langid.GAIN)
        losses = [sum(np.log1p(np.exp(-m * c)) for m, c in zip(margin, code)) for code in codes]
        best = sorted(losses)
        assert abs(losses[int(found[1:])] - best[0]) < 1e-6 and abs(g - (best[1] - best[0])) < 1e-4 and abs(p - np.exp(-best[0]) / sum(np.exp(-x) for x in losses)) < 1e-4


def test_decontamination(spark, odd):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    items = [[word() for _ in range(n)] for n in (40, 25, 18, 9, 6, 3)]
    filler = lambda: [word() for _ in range(60)]
    changed = [w if k % 9 else "zzzzz" for k, w in enumerate(items[0])]
    docs = [(1, filler() + items[0] + filler()), (2, filler() + changed + filler()), (3, filler()), (4, items[2]), (5, filler() + items[3]), (6, items[4] + filler()), (7, filler() + items[5]), (8, items[1][5:] + filler())]
    df = spark.createDataFrame([(i, " ".join(w).upper() + ".") for i, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, "; ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    want = {(1, 0), (2, 0), (4, 2), (5, 3), (6, 4), (8, 1)}
    for limit in (10**6, 0):  # broadcast, and shuffled seeds
        found = rows(decontaminate.overlaps(df, bench, limit))
        assert {(x["doc_id"], x["item_id"]) for x in found} == want
        whole = next(x for x in found if x["doc_id"] == 1)
        assert (whole["start"], whole["length"], whole["matched"]) == (60, 40, 40)
    assert sorted(x["doc_id"] for x in rows(decontaminate.clean(df, bench))) == [3, 7]
    assert decontaminate.clean(odd, bench).count() == len(ODD) and decontaminate.overlaps(df.limit(0), bench).count() == 0
    assert decontaminate.overlaps(df, bench.limit(0)).count() == 0


def test_decontamination_quotations(spark):
    """A quotation of 13 tokens or more counts wherever in the item it lies, also with a word replaced after a seed; a shorter one within does not."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    item = [word() for _ in range(45)]
    filler = lambda: [word() for _ in range(60)]
    docs, want = [], set()
    for n in (13, 15, 17, 19, 20):
        for at in range(45 - n + 1):
            want.add(len(docs))
            docs.append(filler() + item[at : at + n] + filler())
    for at in range(33):
        want.add(len(docs))
        docs.append(filler() + item[at : at + 9] + [word()] + item[at + 10 : at + 13] + filler())
    docs += [filler() + item[at : at + 9] + filler() for at in range(12, 24)] + [filler()]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    for limit in (10**6, 0):
        assert {x["doc_id"] for x in rows(decontaminate.overlaps(df, bench, limit))} == want


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_SEEDS, 0])
def test_decontamination_paths(spark, most, monkeypatch):
    """Rows that share an id, or have none, are judged by their own texts, whichever way the seeds meet."""
    r = random.Random(2)
    item = [f"q{i}" for i in range(30)]
    fill = lambda n: [f"f{r.random()}".replace(".", "") for _ in range(n)]
    half = " ".join(fill(20) + item[:15] + fill(40))
    docs = [(1, half), (1, " ".join(fill(60))), (1, half), (2, " ".join(item)), (None, " ".join(fill(3) + item)), (None, " ".join(fill(9))), (3, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as _bad", "'y' as t", "1 as row", "2 as _h")
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    got = {x["doc_id"]: (x["start"], x["length"], x["matched"]) for x in rows(decontaminate.overlaps(df, bench, most))}
    assert got == {1: (20, 30, 15), 2: (0, 30, 30), None: (3, 30, 30)}
    monkeypatch.setattr(decontaminate.alignments, "__defaults__", (most,))
    kept = decontaminate.clean(df, bench, most)
    assert kept.columns == df.columns and sorted((str(x["doc_id"]), x["text"]) for x in rows(kept) if x["text"]) == sorted([("1", docs[1][1]), ("None", docs[5][1])]) and kept.count() == 3


def test_decontamination_plan(spark):
    assert not re.search("Python|Pandas|Arrow", queries.op5_decontamination(spark, SF)._jdf.queryExecution().executedPlan().toString())


# 6 simhash


def brute_print(text):
    w = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, budget=4):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark, texts, odd):
    got = {r["doc_id"]: r for r in rows(queries.op6_simhash(spark, SF))}
    prints = {i: int(r["fingerprint"], 16) for i, r in got.items()}
    assert all(prints[i] == brute_print(texts[i]) for i in list(texts)[:120])
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(prints)
    out = rows(simhash.near_duplicates(odd))
    assert len(out) == len(ODD) and {r["component_id"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["component_id"] for r in out if r["doc_id"] in (5, 6, None)} == {5} and {r["component_id"] for r in out if r["doc_id"] in (7, 8)} == {7}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = near.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in rows(kept)) == ["1", "4", "5", "7", "9"]
    assert near.keep_one(odd.limit(0)).count() == 0


def test_simhash_clashing_ids(spark):
    """Documents of their own under one id or none: near copies of either text group with that text alone."""
    r = random.Random(3)
    text = lambda: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(90))
    a, b, c = text(), text(), text()
    df = spark.createDataFrame([(1, a), (1, b), (1, a), (2, a + " more"), (3, b + " more"), (None, c), (None, c), (None, c + " more"), (None, a)], "doc_id long, text string")
    kept = sorted((str(x["doc_id"]), x["text"]) for x in rows(near.keep_one(df)))
    assert [x for x in kept if x[0] == "1"] == sorted([("1", a), ("1", b)]) and len(kept) == 3 and kept[-1][0] == "None" and kept[-1][1] in (c, c + " more")
    out = rows(simhash.near_duplicates(df))
    assert len(out) == 9 and {x["component_id"] for x in out if x["doc_id"] is not None} == {1}


def test_sets_take_distinct_shingles(spark):
    words = [f"w{i}" for i in range(60)]
    line = " one line that is repeated"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words) + line * 300), (3, " ".join(w + "x" for w in words) + line * 300), (4, " ".join(words) + line * 2)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(near.shingle_sets(df, 5))}
    assert got[2]["node"] == got[4]["node"] and got[2]["set"] == got[4]["set"] and len(got[1]["set"]) == 8 * 56 == 8 * got[1]["n"]
    assert sorted(r["doc_id"] for r in rows(near.keep_one(df))) == [1, 3]  # 56 of 65 shingles in common


def test_hot_keys_are_dealt(spark, monkeypatch):
    """Crowds of near copies and texts that merely share a line: the same groups, in blocks."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    base, line = [word() for _ in range(200)], [word() for _ in range(40)]
    docs = []
    for i in range(200):
        t = list(base)
        for k in r.sample(range(200), 2):
            t[k] = word()
        docs.append((i, " ".join(t)))
    docs += [(1000 + i, " ".join([word() for _ in range(40)] + line)) for i in range(120)]
    docs += [(2000 + i, docs[200 + i][1] + " and") for i in range(20)]
    docs += [(3000 + i, " ".join([*line[:20], word()])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(x["doc_id"] for x in rows(near.keep_one(df)))
    assert want == [0, *range(1000, 1120), 3000]
    for name, value in (("HOT", 12), ("WHOLE", 40), ("ANCHORS", 6)):
        monkeypatch.setattr(near, name, value)
    assert sorted(x["doc_id"] for x in rows(near.keep_one(df))) == want


@pytest.mark.parametrize("lines,most", [(4, 10), (12, 10), (12, 40)])
def test_hot_keys_lose_no_link(spark, monkeypatch, lines, most):
    """Texts of lines that all share, few of them near to each other, short or long, with every key hot: the groups of all pairs."""
    r = random.Random(lines)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    pool = [[word() for _ in range(9)] for _ in range(lines + 4)]
    sets, docs = [], []
    for i in range(300):
        t = [w for k in sorted(r.sample(range(lines + 4), lines)) for w in pool[k]] + [word() for _ in range(i % 3)]
        docs.append((i, " ".join(t)))
        sets.append({tuple(t[k : k + 5]) for k in range(len(t) - 4)})
    up = list(range(300))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(300):
        for j in range(i):
            if 1.8 * len(sets[i] & sets[j]) >= 0.8 * (len(sets[i]) + len(sets[j])):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    want = sorted({find(i) for i in range(300)})
    assert 5 < len(want) < 290
    for name, value in (("HOT", most), ("WHOLE", most), ("ANCHORS", 1), ("DEALINGS", 1), ("TABLES", 1)):
        monkeypatch.setattr(near, name, value)
    assert sorted(x["doc_id"] for x in rows(near.keep_one(spark.createDataFrame(docs, "doc_id long, text string")))) == want


def test_hot_keys_make_few_links(spark, monkeypatch):
    """Crowds of near copies under all their minima: few links a node and hot key, and from the full comparison only those between groups."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, near.BITS)
    prints = np.where(rng.random((900, near.BITS)) < 0.08, 1 - base, base)
    prints[600:] = rng.integers(0, 2, (300, near.BITS))  # texts that merely share a line
    prints[890:] = prints[880:890]
    prints[890:, 0] ^= 1
    packed = np.packbits(prints, axis=1)
    nodes = spark.createDataFrame([(i, bytearray(packed[i].tobytes()), [1, 2, 3, 4, 5, 6]) for i in range(900)], "node long, fingerprint binary, mins array<long>")
    made, real = [], simhash.map_arrow

    def counted(df, run, schema):
        n = spark.sparkContext.accumulator(0)
        made.append(n)

        def each(batches):
            for b in run(batches):
                n.add(len(b))
                yield b

        each.__module__ = run.__module__
        return real(df, each, schema)

    monkeypatch.setattr(simhash, "map_arrow", counted)
    monkeypatch.setattr(near, "HOT", 60)
    links = {(r["a"], r["b"]) for r in near.proposals(nodes).collect()}
    found = {frozenset(x) for x in (brute_groups(links, 900).values())}
    assert found == {frozenset(range(600)), *(frozenset((i, i + 10)) for i in range(880, 890)), *(frozenset((i,)) for i in range(600, 880))}
    first, apart = (n.value for n in made)
    assert first <= near.MINS * near.DEALINGS * 1200 and apart <= near.MINS * 100


def brute_groups(links, n):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[find(a)] = find(b)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    return groups


@pytest.mark.parametrize("n, known", [(40, 5), (400, 8), (400, 400), (400, 1)])
def test_known_groups(n, known):
    """What is known to hang together is not linked again, and all else is, by fingerprints and by sets."""
    rng = np.random.default_rng(n + known)
    base = rng.integers(0, 2**63, (n // 8, 1), dtype=np.uint64)
    prints = base[np.arange(n) % len(base)] ^ (np.uint64(1) << rng.integers(0, 64, (n, 1)).astype(np.uint64))
    prints ^= np.arange(n, dtype=np.uint64)[:, None] << np.uint64(50)
    key, ids, group = np.arange(n) % 2, rng.permutation(n), rng.integers(0, known, n)
    held = [(i, j) for k in (0, 1) for g in range(known) for m in [np.flatnonzero((key == k) & (group == g)).tolist()] for i, j in zip(m, m[1:])]
    place = np.argsort(ids)
    budget = 6
    a, b = simhash._subtries(key, prints, ids, budget, group)
    plain = simhash._subtries(key, prints, ids, budget)
    pairs = lambda x: list(zip(place[x[0]].tolist(), place[x[1]].tolist()))
    together = brute_groups([*held, *pairs(plain)], n)
    assert sorted(map(sorted, brute_groups([*held, *pairs((a, b))], n).values())) == sorted(map(sorted, together.values()))
    assert len(a) == len(brute_groups(held, n)) - len(together)
    sets = [np.unique(np.append(rng.choice(30, 12, replace=False), 100 + i % 9)) for i in range(n)]
    sizes, flat, head = np.array([len(x) for x in sets]), np.concatenate(sets).astype(np.uint64), simhash.firsts(np.zeros(n, np.int64), group)
    root = near.alike(flat, sizes, 0.6, head)
    free = near.alike(flat, sizes, 0.6)
    want = brute_groups([*enumerate(head.tolist()), *enumerate(free.tolist())], n)
    assert sorted(map(sorted, brute_groups(enumerate(root.tolist()), n).values())) == sorted(map(sorted, want.values()))


def test_caches_hold_no_long_words():
    long = "x" * 5000
    counter = token_counts.TrieCounter(token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    assert counter.documents([long + " a", long])[1] == [2, 1] and set(counter.seen) == {"a"}
    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    first = encoder.encode([long, "a"])
    assert set(encoder.pretokens) == {"a"} and encoder.characters == 5001 and encoder.encode([long, "a"]) == first
    encoder.characters = packing.CHUNK_CHARACTERS + 1
    assert encoder.encode([long, "a"]) == first and encoder.characters == 5001


@pytest.mark.parametrize("n, words", [(300, 1), (2000, 1), (400, 4)])
def test_trie_join(n, words):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, (max(2, n // 100), words), dtype=np.uint64)
    prints = base[rng.integers(0, len(base), n)]
    for _ in range(5):
        prints[np.arange(n), rng.integers(0, words, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    prints = np.unique(prints, axis=0)
    as_int = {i: int.from_bytes(p.astype(">u8").tobytes(), "big") for i, p in enumerate(prints)}
    a, b = simhash._subtries(np.zeros(len(prints), np.int64), prints, np.arange(len(prints)), 4)
    up = brute_components(as_int)
    assert len(a) == len(prints) - len(set(up.values())) and all(up[int(y)] == int(x) for x, y in zip(a, b))


def test_exact_tables():
    for budget in (2, 4):
        tables = simhash.exact_tables(64, budget, 1000)
        for _ in range(300):
            wrong = set(random.sample(range(64), budget))
            assert any(not wrong & set(t.tolist()) for t in tables)


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}
    for a, b in links:
        up.setdefault(a, a), up.setdefault(b, b)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = dict(components.connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    single = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: find(i) for i in up if i not in single}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7 fingerprints


def brute_likeness(a, b):
    """The mean of both containments of the sets of 16-byte shingles."""
    x, y = ({t[k : k + 16] for k in range(max(1, len(t) - 15))} if t else set() for t in (a.encode(), b.encode()))
    return (len(x & y) / len(x) + len(x & y) / len(y)) / 2 if x and y else float(x == y)


def test_fingerprints(spark, texts, odd, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 200_000)  # several ranges on the small table
    order = sorted(texts)
    for sample in (fingerprints.SAMPLE, 100):  # bounds from the whole table, and from a sample
        monkeypatch.setattr(fingerprints, "SAMPLE", sample)
        got = {r["doc_id"]: r for r in rows(queries.op7_fingerprints(spark, SF))}
        assert len(got) == len(order)
        off = []
        for k, i in enumerate(order):
            t, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
            q = len(t) // 4
            edited = t[: len(t) - q] + after[:q]
            assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            off += [abs(got[i]["near_edited"] - brute_likeness(t, edited)), abs(got[i]["near_next"] - brute_likeness(t, after))]
        assert max(off) < 0.3 and sum(off) / len(off) < 0.03
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 1)
    out = rows(fingerprints.with_edits(odd))
    assert len(out) == len(ODD) and fingerprints.with_edits(odd.limit(0)).count() == 0
    assert next(r for r in out if r["doc_id"] == 1)["near_next"] == 1
    assert fingerprints.with_edits(odd.where("doc_id = 9")).first()["near_next"] == 1


def test_fingerprints_one_id(spark, monkeypatch):
    """Rows that share an id, or have none, are dealt by their text; each is followed by the next in that order."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 1)
    df = spark.createDataFrame([(i, f"text {k} " * 9) for i in (7, None) for k in range(40)], "doc_id long, text string")
    assert len(fingerprints._bounds(df.selectExpr("doc_id", "xxhash64(text) h", "text"))) > 30
    out = rows(fingerprints.with_edits(df))
    h = {r["fingerprint"]: r for r in rows(fingerprints.fingerprints(df))}
    assert len(out) == 80 and len(h) == 40
    order = df.selectExpr("doc_id", "xxhash64(text) h", "text").orderBy("doc_id", "h").collect()
    want = sorted(hashlib.sha256((r["text"][: len(r["text"]) - len(r["text"]) // 4] + order[(k + 1) % 80]["text"][: len(r["text"]) // 4]).encode()).hexdigest() for k, r in enumerate(order))
    assert sorted(r["edited_sha256"] for r in out) == want


def test_sketches_merge():
    a, b = LONG[:90_000].encode(), LONG[60_000:150_000].encode()
    whole = np.union1d(fingerprints._byte_hashes(a), fingerprints._byte_hashes(b))
    want = whole[: max(fingerprints.FEWEST, int(np.searchsorted(whole, fingerprints.LIMIT)))]
    assert (fingerprints.merge(fingerprints.sketch(a), fingerprints.sketch(b)) == want).all()
    small = fingerprints.sketch(b"a short text of some words")
    assert (fingerprints.decode(fingerprints.encode(small)) == small).all() and len(base64.b64decode(fingerprints.encode(small))) % 4 == 0


# 8 archives


def test_warc(spark):
    big, other = "é" * 80, "x" * 300
    pages = [(1, "http://a/b c\n", big), (2, None, big), (3, "http://c", other), (-5, "http://d", other), (6, "http://e", "tiny"), (7, "http://e", "tiny"), (8, "http://f", None), (None, "http://g", other), (9, "http://h", "a\r\n\r\nWARC/1.1\r\n" * 20), (3, "http://c", other)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(warc.read(spark, warc.write(df))))
    first = {big: 1, other: -5, pages[8][2]: 9}
    want = []
    for p, _, html in pages:
        data = (html or "").encode()
        ref = first.get(html) if len(data) >= 100 and first[html] != p else None
        want.append((str(p), len(data), hashlib.sha256(data).hexdigest(), "response" if ref is None else "revisit", ref))
    assert got == sorted(want)
    assert warc.read(spark, warc.write(df.limit(0))).count() == 0


def test_arc_parsing():
    sample = [(5, "http://x y", b"abc\n\nfiledesc"), (None, "http://z", b"")]
    for version in (1, 2):
        data = warc.write_arc(sample, version)
        got = list(warc.parse_arc(data))
        assert [b.partition(b"\r\n\r\n")[2] for _, b in got] == [s[2] for s in sample] and got[0][0]["URL"] == "http://x%20y"
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-5]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"nonsense 1\nx"))
    for p in (None, 0, 1, -1, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_id(p)) == p


def test_warc_parsing():
    payload = b"a\r\n\r\nWARC/1.1\r\n"
    arc = warc.write_arc([(5, "http://x", payload), (6, "http://y", b"")], 1)
    data = b"".join(warc.to_warc(f, b, None if i == 0 else 5) + b"\r\n\r\n" for i, (f, b) in enumerate(warc.parse_arc(arc)))
    (h, block), (h2, _) = warc.parse_warc(io.BytesIO(data))
    assert block.partition(b"\r\n\r\n")[2] == payload and h["WARC-Type"] == "response" and h2["WARC-Type"] == "revisit"
    assert warc.page_of(h2["WARC-Refers-To"]) == warc.page_of(h["WARC-Record-ID"]) == 5
    assert list(warc.parse_warc(io.BytesIO(b""))) == []
    for broken in (data[:-2], data[:-30], b"nonsense\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_warc(io.BytesIO(broken)))


# 9 substrings


def brute_substrings(docs, size=13):
    first = {}
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        w = split(t)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = []
    for i, t in docs:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((str(i), len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(df))


def test_substrings(spark, texts, odd):
    assert found(queries.op9_substrings(spark, SF)) == brute_substrings(list(texts.items()))
    done = substrings.remove_repeats(odd)
    assert found(done.select("row.doc_id", "n_words", "n_removed", "kept_sha256")) == brute_substrings([r[:2] for r in ODD])
    assert done.select("row.*").columns == odd.columns and substrings.remove_repeats(odd.limit(0)).count() == 0


def test_substring_shards(spark, monkeypatch):
    r = random.Random(4)
    docs = [(i, " ".join(r.choices("abc", k=r.randrange(80)))) for i in range(60)]
    docs += [(7, docs[3][1]), (7, docs[3][1]), (None, docs[5][1]), (-9, docs[8][1] + " x"), (60, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = lambda: found(substrings.remove_repeats(df, 5).select("row.doc_id", "n_words", "n_removed", "kept_sha256"))
    want = brute_substrings(docs, 5)
    assert got() == want
    monkeypatch.setattr(substrings, "MAX_BITS", 1 << 15)
    monkeypatch.setattr(substrings, "HOT", 10)  # hot anchors: a shard for each window
    assert got() == want


def test_substring_words_decide(monkeypatch):
    """Texts of one hash and different words share nothing; those of equal words do."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a  # Thue-Morse words collide under every polynomial hash modulo 2**64
    tail = " ".join(f"w{i}" for i in range(12))
    texts = [f"{a} {tail}", f"{b} {tail}", f"{b} {tail}", f"{a} {tail}"]
    w = Words(pa.array(texts))
    first, last = w.grams(13)
    assert len(set(Spans(w.data).hash(w.start[first], w.end[last]).tolist())) == 2
    monkeypatch.setattr(Spans, "LONG", 1 << 40)  # without the other hash for long ranges
    assert len(set(Spans(w.data).hash(w.start[first], w.end[last]).tolist())) == 1
    unit, at = substrings.occurrences(np.arange(4), pa.array([t.encode() for t in texts]), 13)
    assert sorted(zip(unit.tolist(), at.tolist())) == [(2, 0), (3, 0)]
    unit, _ = substrings.occurrences(np.arange(2), pa.array([t.encode() for t in texts[:2]]), 13)
    assert not len(unit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.text("ab ", max_size=40)), max_size=8), st.sampled_from([1, 30_000]))
def test_substring_automata(docs, phrases):
    """What the automata report is what brute force finds."""
    docs = [(i, " ".join(t.split())) for i, t in docs]
    want = set()
    for k, (i, t) in enumerate(docs):
        w = t.split()
        want |= {(k, p) for p in range(len(w) - 2) if any(tuple(w[p : p + 3]) in zip(x.split(), x.split()[1:], x.split()[2:]) for j, x in docs if j < i)}
    kept, substrings.SHARD_PHRASES = substrings.SHARD_PHRASES, phrases
    unit, at = substrings.occurrences(np.array([i for i, _ in docs], np.int64), pa.array([t.encode() for _, t in docs], pa.binary()), 3)
    substrings.SHARD_PHRASES = kept
    assert set(zip(unit.tolist(), at.tolist())) == want


# 10 packing


def test_packing(spark, texts, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = defaultdict(list)
    for r in rows(queries.op10_packing(spark, SF)):
        got[r["doc_id"]].append(r)
    assert set(got) == set(texts)
    assert len({r["sequence_id"] for rs in got.values() for r in rs}) == sum(map(len, got.values()))
    for i in list(texts)[:150]:
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(got[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    out = rows(packing.pack(odd, path))
    assert sum(r["length"] for r in out if r["doc_id"] in (1, 2, 3)) == 3 and packing.pack(odd.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, path, longest=1000)


def test_packing_buckets(spark, tmp_path):
    """Sequences of one length lie in one folder, with their ids."""
    import os

    df = spark.createDataFrame([(i, "word " * i) for i in range(70)], "doc_id long, text string")
    packed = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), longest=32)
    packing.write_buckets(packed, str(tmp_path / "b"))
    assert sorted(x for x in os.listdir(tmp_path / "b") if x.startswith("bucket")) == [f"bucket={k}" for k in range(6)]
    got = spark.read.parquet(str(tmp_path / "b"))
    assert got.where("length <> 1 << bucket or length(ids) <> 4 * length or crc32(ids) <> ids_crc32").count() == 0 and got.count() == packed.count()


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from(list("aAbß ÉÿÁ'st\t\n.,!0१世̈́ΣİſK<|>…")), max_size=40))
def test_encoder_is_the_tokenizer(text):
    e = packing.Encoder.get(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"aB é\x1c\x1d\x1e\x1f\x85\xa0\u2028\u200b\u0301\n'1.<|", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "word"]), max_size=20).map("".join))
def test_encoder_is_a_fresh_tokenizer(text):
    """Separators that str.split drops and spelled-out added tokens have the ids that the unaltered tokenizer gives them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    fresh = FRESH.setdefault(path, Tokenizer.from_file(path))
    for t in (text, "a\x1cb", "a\x1f b", "x<|endoftext|>y <|endoftext|>"):
        assert np.frombuffer(packing.Encoder.get(path).encode([t])[0], "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids


FRESH = {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["'", "''", "'s", "'ll", "'re", "'r", "'VE ", "s", "e", "é" * 12, "x" * 23, "x" * 24, "x" * 25, " ", "\n", "\x0b", "1", ".", "%%%", "Ünd "]), max_size=14).map("".join), max_size=5), st.booleans())
def test_encoder_by_arrays(texts, collide):
    """Clitics, words around the length of a key, texts without words, blocks within a text; with all hashes equal too."""
    path = public_tokenizers.path("word_bpe_49k.json")
    fresh = FRESH.setdefault(path, Tokenizer.from_file(path))
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = packing.Encoder.get(path)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "BLOCK", 16)
        if collide:
            patch.setattr(packing, "mix", lambda x, salt: np.zeros_like(x))
        encoder.table = packing.Table()
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    encoder.table = packing.Table()


# shared


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \té\n", max_size=20)), max_size=6))
def test_words(texts):
    w = Words(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert [bytes(w.data[w.start[k] : w.end[k]]).decode() for k in range(w.doc[i], w.doc[i + 1])] == split(t)
    first, last = w.shingles(3)
    runs = [bytes(w.data[w.start[a] : w.end[b]]) for a, b in zip(first, last)]
    h = Spans(w.data).hash(w.start[first], w.end[last])
    assert len(set(runs)) == len(set(h.tolist()))
