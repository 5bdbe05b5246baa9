"""The pipeline operators against brute force, round trips and held-out accuracy, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.llm import chat, decontamination, html, neardup, packing, quality, sharding, substrings, topk, toxicity, trees
from voxmill.llm.queries import ORACLE_SQL, QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "word", "en", "s", 4), (5, "word", "en", "t", 4), (6, "two words", "en", "s", 9),
    (7, "é ü ñ 日本 🙂 " * 40, "xx", "s", 1), (8, "lorem ipsum dolor " * 3000, "en", "s", 1), (8, "lorem ipsum dolor " * 3000, "en", "s", 1), (None, "no id at all here", "en", "s", 1), (9, "<|endoftext|> [INST] </s>", "en", "s", 1),
]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}


def odd(spark):
    """Odd rows, with a column whose name could clash with those the operators make."""
    return spark.createDataFrame(ODD, DOC).withColumn("score", F.lit(1)).withColumn("size", F.lit("x"))


def empty(spark):
    return spark.createDataFrame([], DOC)


# ---- near duplicates -------------------------------------------------------


def plain_sets(texts, words):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        out[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    return out


def plain_components(sets, percent=80):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i in sorted(sets) if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(documents, texts, words):
    sets = plain_sets(texts, words)
    expected = plain_components(sets)
    got = neardup.near_duplicates(documents, words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), expected[i], expected[i] == i) for i in texts}


def test_near_duplicates_chain(spark):
    """Links over a chain of edits, a large group of near copies, and pairs just inside and outside the limit."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(60)]
    rows, text = [], list(base)
    for k in range(30):
        rows.append((k, " ".join(text)))
        text[k * 2 % 60] = word()
    for k in range(120):
        changed = list(base)
        changed[rng.randrange(60)] = word()
        rows.append((100 + k, " ".join(changed)))
    rows += [(1000, "a b c d e f g h i j"), (1001, "a b c d e f g h i j k"), (1002, "a b c d"), (1003, "a b c d e"), (1004, "A  B\tC D"), (1005, "x"), (1006, "X")]
    sets = plain_sets(dict(rows), 2)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert {r.doc_id: r.component_id for r in got.collect()} == plain_components(sets)


def edited_copies(rng, n, length, edits):
    """Texts of one base, each with some words replaced: groups of every similarity between the fewest and the most edits."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    for _ in range(n):
        text = list(base)
        for at in rng.sample(range(length), rng.choice(edits)):
            text[at] = f"x{rng.randrange(10**6)}"
        yield " ".join(text)


def matrix_components(sets, percent):
    """`plain_components` by products of a dense incidence matrix, for groups of thousands."""
    ids = [i for i in sorted(sets) if sets[i]]
    names = {s: k for k, s in enumerate(sorted(set().union(*sets.values())))}
    once = {k for k, n in Counter(names[s] for i in ids for s in sets[i]).items() if n > 1}
    shared = {k: c for c, k in enumerate(sorted(once))}
    held = np.zeros((len(ids), len(shared)), np.float32)
    for r, i in enumerate(ids):
        held[r, [shared[names[s]] for s in sets[i] if names[s] in once]] = 1
    size = np.array([len(sets[i]) for i in ids])
    label = np.arange(len(ids))
    edges = []
    for a in range(0, len(ids), 500):
        both = (held[a : a + 500] @ held.T).round().astype(np.int64)
        x, y = np.nonzero(100 * both >= percent * (size[a : a + 500, None] + size[None] - both))
        edges.append((x + a, y))
    x, y = (np.concatenate(e) for e in zip(*edges, strict=True))
    while True:
        least = label.copy()
        np.minimum.at(least, x, label[y])
        if (least == label).all():
            return {i: ids[label[r]] for r, i in enumerate(ids)} | {i: i for i in sets if not sets[i]}
        label = least[least]


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_near_duplicates_large_groups(spark, monkeypatch, similarity):
    """Thousands of edited copies at similarities from 0.5 to 0.95, most of them not linked, over many blocks of every kind."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 400)
    monkeypatch.setattr(neardup, "SET_BYTES", 200_000)
    monkeypatch.setattr(neardup, "ASK_BYTES", 400_000)
    rng = random.Random(5)
    texts = [*edited_copies(rng, 5200, 90, range(3, 20)), *edited_copies(rng, 600, 60, range(1, 6)), *edited_copies(rng, 300, 400, range(20, 60))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    sets = plain_sets(dict(rows), 2)
    expected = matrix_components(sets, round(100 * similarity))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2, similarity)
    assert {r.doc_id: r.component_id for r in got.collect()} == expected
    assert 1 < len(set(expected.values())) < len(rows)


def test_forest():
    forest = neardup.Forest()
    assert [forest.join(*p) for p in ((5, 3), (3, 5), (7, 8), (8, 3), (7, 5))] == [True, False, True, True, False]
    assert {forest.root(x) for x in (3, 5, 7, 8)} == {3} and forest.root(9) == 9


def test_sketches_agree_where_signatures_do():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    y = np.concatenate([x[:3600], rng.integers(0, 1 << 63, 400, dtype=np.uint64)])
    (a, p), (b, q) = neardup.signature(x), neardup.signature(y)
    assert neardup.signature(x) == (a, p)
    both = neardup._agreeing(neardup._table([p]), neardup._table([q]))[0]
    assert abs(both / neardup.SKETCHED - (9 / 11 + 2 / 11 / 16)) < 0.1
    posted, sketched = neardup.thresholds(0.8)
    assert posted < 0.8 * neardup.COORDINATES and both >= sketched
    assert (np.frombuffer(a, np.uint32) == np.frombuffer(b, np.uint32)).sum() >= posted


@pytest.mark.parametrize("similarity", [0, -1, 1.5, 80])
def test_near_duplicates_refuses_what_is_no_similarity(spark, similarity):
    with pytest.raises(ValueError, match="similarity"):
        neardup.near_duplicates(odd(spark), similarity=similarity)


def test_near_duplicates_odd(spark):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd(spark), 2).collect()]
    assert len(got) == len(ODD) and (5, 1, 4, False) in got and (1, 0, 1, True) in got and (3, 0, 3, True) in got and (None, 4, None, True) in got
    assert neardup.near_duplicates(empty(spark), 2).count() == 0


# ---- top k -----------------------------------------------------------------


def test_threshold_search():
    rng = np.random.default_rng(4)
    for n, dims, k in ((1, 3, 5), (50, 4, 3), (3000, 2, 5), (400, 16, 20)):
        rows = rng.integers(-3, 4, (n, dims)).astype(np.int32)
        ids = rng.permutation(n).astype(np.int64)
        queries = np.vstack([rows[:5], np.zeros((1, dims), np.int32)])
        own = np.append(ids[:5], -1)
        at, found, score = topk.threshold_search(ids, rows, topk.sorted_lists(rows), own, queries, k, np.full((len(queries), k), -np.inf))
        for q in range(len(queries)):
            all_scores = rows.astype(np.int64) @ queries[q]
            best = sorted((-s, i) for s, i in zip(all_scores, ids, strict=True) if i != own[q])[:k]
            assert sorted(zip(-score[at == q], found[at == q], strict=True)) == best


def test_top_k_carries_scores_between_blocks(spark):
    """Many blocks on both sides, with ties and copies, long vectors and short: as brute force."""
    rng = np.random.default_rng(11)
    rows = rng.integers(-2, 3, (900, 3)) * rng.choice((1, 1, 1, 9), (900, 1))
    rows[100:160] = rows[100]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows.tolist())], "vec_id long, v array<long>")
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=7, block_rows=25, query_rows=9).collect()
    expected = set()
    for q in range(0, 900, 20):
        best = sorted((-s, i) for i, s in enumerate((rows @ rows[q]).tolist()) if i != q)[:7]
        expected |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == expected and len(got) == 45 * 7


def test_threshold_search_stops_on_an_earlier_bound():
    """Scores of earlier blocks leave nothing to find in a block that cannot reach them, and all that ties with them."""
    rows, ids = np.array([[1, 1], [2, 0], [0, 2], [-3, 1]]), np.arange(4)
    search = lambda best: topk.threshold_search(ids, rows, topk.sorted_lists(rows), np.array([9]), np.array([[1, 1]]), 2, best)
    assert search(np.array([[5.0, 4.0]]))[1].tolist() == []
    best = np.array([[2.0, 2.0]])
    assert search(best)[1].tolist() == [0, 1] and sorted(best[0]) == [2.0, 2.0]
    best = np.array([[1.0, -np.inf]])
    assert search(best)[1].tolist() == [0, 1] and sorted(best[0]) == [2.0, 2.0]


def test_top_k_odd(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [-1.0, 0.5]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.quantised(df)
    got = topk.top_k(v, v.where("vec_id % 20 = 0")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 20, 20480), (0, 2, 6, 0), (20, 1, 0, 20480), (20, 2, 6, 0)]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_large_parts(spark):
    """Finite vectors of any size take part, with exact scores, as queries and as candidates."""
    rng = random.Random(8)
    vectors = {i: [rng.uniform(-1, 1) * (10 ** rng.choice((0, 0, 0, 6, 7))) for _ in range(2)] + [rng.uniform(-1, 1)] for i in range(100)}
    vectors |= {100: [2.0**25, -(2.0**25) + 1, 1.0], 101: [0.015625, 0.015625, 2.0**40]}
    v = topk.quantised(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"))
    got = topk.top_k(v, v.where("vec_id % 20 = 0 and vec_id < 100"), k=8).collect()
    whole = {i: [int(np.floor(64 * x)) for x in e] for i, e in vectors.items()}
    expected = set()
    for q in range(0, 100, 20):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in whole.items() if i != q)[:8]
        expected |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == expected and len(expected) == 40


# ---- packing ---------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def check_packed(rows, ids_of, capacity=1024):
    for doc, ids in ids_of:
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == capacity for r in own[1:])
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_packing(documents, texts):
    own = tokenizer()
    rows = packing.pack_documents(documents, packing.default_tokenizer(), keep_ids=True).collect()
    ids = [(i, own.encode(t, add_special_tokens=False).ids + [2]) for i, t in texts.items()]
    packed, least = check_packed(rows, ids)
    assert packed <= least * 1.02 + 1
    assert all(np.frombuffer(r.ids, "<u4")[-1] == 2 for r in rows if r.start + r.length == len(dict(ids)[r.doc_id]))


def test_packing_odd(spark):
    rows = packing.pack_documents(odd(spark), packing.default_tokenizer(), keep_ids=False).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r[0] for r in ODD)
    assert [(r.length, r.start) for r in rows if r.doc_id == 1] == [(1, 0)]
    assert packing.pack_documents(empty(spark), packing.default_tokenizer()).count() == 0


def test_encoder_matches_the_tokenizer():
    own, encode, rng = tokenizer(), packing.Encoder(packing.default_tokenizer()), random.Random(2)
    cases = ["", " ", "a", " a", "a  b", "a \n b", "x\n\n y", "don't we'll", "tab\tx y", "a ", "\n", "½ ² x²", "<|endoftext|> a b", "🙂 🙂🙂 a"]
    cases += ["a\n\nb", "a\n\n\n b", "x.\nY", "it's'tis '", "9a1é×÷ñ", "a\u00a0\u00a0 b", "\x1cb\x1f a", "naïve—word", " lead", "x" * 23, " " + "y" * 23, "z" * 24 + " " + "z" * 70]
    for letters in ("ab 'é1\n\t,.🙂 ", "ab 'st.é÷\n\r日—", "a.\n'\u3000\x85 s"):
        cases += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    whole = [own.encode(c, add_special_tokens=False).ids for c in cases]
    for _ in range(2):  # new units, then known ones
        assert [ids.tolist() for ids in encode(cases)] == whole


def test_encoder_gives_places_up(monkeypatch):
    """A table of sixteen places, slices of a few texts: every unit is learned again and again."""
    monkeypatch.setattr(packing, "SLOTS", 4)
    monkeypatch.setattr(packing, "SLICE_BYTES", 50)
    own, encode, rng = tokenizer(), packing.Encoder(packing.default_tokenizer()), random.Random(3)
    cases = [" ".join(rng.choice(["the", "of,", "Antidisestablishmentarianism", "x1", "señor", "日本"]) for _ in range(rng.randint(0, 20))) for _ in range(300)]
    assert [ids.tolist() for ids in encode(cases)] == [own.encode(c, add_special_tokens=False).ids for c in cases]


@pytest.mark.parametrize("kind", ["uniform", "random", "small", "skewed", "halves", "exact", "few"])
def test_plan(kind):
    """Every piece is placed once without overlap, in no more sequences than best fit alone takes."""
    rng = np.random.default_rng(8)
    lengths = {
        "uniform": lambda: np.repeat(np.arange(1, 1025), 200), "random": lambda: rng.integers(1, 1025, 200_000), "small": lambda: rng.integers(1, 60, 3000), "halves": lambda: np.full(700, 513),
        "skewed": lambda: np.minimum(1024, rng.lognormal(5, 1.2, 100_000).astype(int) + 1), "exact": lambda: np.repeat([1024, 700, 324, 300, 24], 50), "few": lambda: np.array([1, 1023, 512]),
    }[kind]()
    histogram = np.bincount(lengths, minlength=1025)
    plan = packing.make_plan(histogram)
    used = np.zeros(1025, np.int64)
    np.add.at(used, plan.length, plan.count)
    assert (used == histogram).all()
    first = np.repeat(plan.sequence - np.cumsum(plan.count) + plan.count, plan.count) + np.arange(plan.count.sum())
    filled = np.bincount(first, np.repeat(plan.length, plan.count))
    assert len(filled) == plan.sequences and filled.max() <= 1024 and filled.min() > 0
    alone = packing._Filling(histogram, 1024)
    alone.best_fit()
    floor = max(-(-int(lengths.sum()) // 1024), int(histogram[513:].sum()))
    assert floor <= plan.sequences <= min(alone.sequences, floor * 1.01 + 2)


# ---- sharding --------------------------------------------------------------


def test_sharding(documents, texts):
    rows = sharding.kd_shards(documents, 8).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    shards: dict = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    assert sorted(shards) == list(range(8))
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    bytes_ = [sum(r["size"] for r in s) for s in shards.values()]
    assert max(bytes_) - min(bytes_) <= 3 * max(r["size"] for r in rows)


def test_sharding_odd(spark):
    rows = sharding.kd_shards(odd(spark), 3).collect()
    assert len(rows) == len(ODD) and {r.shard for r in rows} <= {0, 1, 2}
    assert sharding.kd_shards(empty(spark)).count() == 0
    copies = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    assert Counter(r.shard for r in sharding.kd_shards(copies, 4).collect()) == dict.fromkeys(range(4), 100)


# ---- classifiers -----------------------------------------------------------


@pytest.mark.parametrize("name,label,least", [("op5_toxicity", "toxic", 0.8), ("op9_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in QUERIES[name](spark, d).collect() if r.held_out and r.doc_id in truth]
    modulus, held = (4, 2) if label == "toxic" else (5, 0)
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % modulus == held for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    pos, neg = ([r.score for r in rows if truth[r.doc_id] == k] for k in (1, 0))
    above = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert above >= least


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifiers_odd(spark, sf_dir, score):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert score(odd(spark), labels).count() == len(ODD)
    assert score(odd(spark), labels.limit(0)).count() == len(ODD)
    assert score(empty(spark), labels).count() == 0


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = trees.fit_boosted(x[:2000], y[:2000], trees=40, depth=3)
    assert ((forest.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    iso = trees.fit_isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.9]), np.array([0, 1, 0, 0, 1]))
    assert (np.diff(iso(np.linspace(0, 1, 50))) >= 0).all() and iso(np.array([0.95]))[0] == 1
    assert trees.fit_boosted(np.zeros((5, 2)), np.ones(5)).probability(np.zeros((1, 2)))[0] > 0.5


# ---- decontamination -------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(3, 8)))
    common = ["the", "of", "and", "to", "in", "a"]
    speak = lambda n: [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n)]
    items = [(k, speak(rng.randint(15, 60))) for k in range(20)]
    rows = [(i, " ".join(speak(rng.randint(5, 400)))) for i in range(200)]
    planted = {}
    for k, words in items:
        for way in range(2):
            inner = list(words)
            if way:  # some words changed, none of the last
                for _ in range(len(inner) // 8):
                    inner[rng.randrange(len(inner) - max(3, len(inner) // 5))] = word()
            at = 1000 + 2 * k + way
            rows.append((at, " ".join(speak(rng.randint(0, 150)) + [w.upper() if way else w for w in inner] + speak(rng.randint(0, 150)))))
            planted[at] = k
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w) + ".") for k, w in items] + [(99, None), (98, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.benchmark_leaks(docs, bench).collect()}
    assert got == set(planted.items())


def test_decontamination_odd(spark):
    bench = spark.createDataFrame([(1, "lorem ipsum dolor lorem ipsum dolor lorem")], "item_id long, text string")
    assert {r.doc_id for r in decontamination.benchmark_leaks(odd(spark), bench).collect()} == {8}
    assert decontamination.benchmark_leaks(empty(spark), bench).count() == 0
    assert decontamination.benchmark_leaks(odd(spark), bench.limit(0)).count() == 0


def test_decontamination_among_benchmark_words(spark):
    """Copies, exact and with inner words replaced, at any offset of texts that use the benchmark's own words."""
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(4, 8))) for _ in range(400)]
    items = {k: rng.sample(pool, rng.randint(5, 12 if k < 60 else 40)) for k in range(100)}
    rows, planted = [], set()
    for k, words in items.items():
        for way in range(4):
            end = max(3, len(words) // 5) if len(words) < 15 else 5
            copy = [rng.choice(pool) if way % 2 and j < len(words) - end and rng.random() < 0.2 else w for j, w in enumerate(words)]
            copied = decontamination.common_subsequence(np.array([pool.index(w) for w in words]), np.array([pool.index(w) for w in copy])) / len(words)
            host = rng.choices(pool, k=rng.randint(40, 120))
            at = rng.randint(0, len(host))
            rows.append((10 * k + way, " ".join(host[:at] + copy + host[at:])))
            if copied >= decontamination.SURE:
                planted.add((10 * k + way, k))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.benchmark_leaks(docs, bench).collect()}
    assert len(planted) > 250 and planted <= got and len(got - planted) < 40


def brute_leaks(docs, items):
    """Pairs whose item has a common subsequence of SURE of its words in some region of half its length more."""
    found = set()
    for i, text in docs.items():
        words = text.split()
        for k, item in items.items():
            reach = len(item.split()) * 3 // 2
            number = {w: n for n, w in enumerate(dict.fromkeys(words + item.split()))}
            at, own = np.array([number[w] for w in words]), np.array([number[w] for w in item.split()])
            regions = [at[a : a + reach] for a in range(0, max(1, len(at) - reach // 3), 2)]
            if any(decontamination.common_subsequence(own, r) >= decontamination.SURE * len(own) for r in regions if len(np.intersect1d(own, r)) * 2 > len(own)):
                found.add((i, k))
    return found


def test_decontamination_against_brute_force(spark):
    """Recall of the latent candidates over edits of every strength, in texts of the benchmark's own words."""
    rng = random.Random(21)
    pool = ["".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(4, 8))) for _ in range(600)]
    weights = [1 / (k + 3) for k in range(len(pool))]
    items = {k: " ".join(rng.choices(pool, weights, k=rng.randint(8, 70))) for k in range(25)}
    docs = {}
    for k, item in items.items():
        for way in range(8):
            copy = [w for w in (rng.choice(pool) if rng.random() < way * 0.04 else w for w in item.split()) if rng.random() > way * 0.01]
            at = len(docs)
            docs[at] = " ".join(rng.choices(pool, weights, k=rng.randint(0, 90)) + copy + rng.choices(pool, weights, k=rng.randint(0, 90)))
    expected = brute_leaks(docs, items)
    found = decontamination.benchmark_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    sure = {(r.doc_id, r.item_id) for r in found if r.similarity >= decontamination.SURE}
    assert len(expected) > 100 and len(expected & sure) >= 0.97 * len(expected)


def test_decontamination_at_any_size(spark, monkeypatch):
    """The same rows whether items are searched at once or in turns, and texts whole or in overlapping sections."""
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcdefghijklmn") for _ in range(6)) for _ in range(300)]
    items = {k: " ".join(rng.choices(pool, k=rng.randint(5, 50))) for k in range(30)}
    docs = {k: " ".join(rng.choices(pool, k=300)) + " " + items[k] + " " + " ".join(rng.choices(pool, k=300)) for k in range(30)}
    d, b = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    pairs = lambda: {(r.doc_id, r.item_id) for r in decontamination.benchmark_leaks(d, b).collect() if r.similarity == 1}
    whole = pairs()
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 7)
    assert pairs() == whole >= {(k, k) for k in range(30)}
    monkeypatch.setattr(decontamination, "SLICE_BYTES", 500)
    assert pairs() == whole


def test_decontamination_short_and_unspaced_items(spark):
    """Items under five words are found by their exact words, a single word only as the whole text; unspaced scripts by character."""
    items = [(1, "three little words"), (2, "Word"), (3, "今天天气很好我们去公园散步吧"), (4, "two words."), (5, "你好吗")]
    docs = [(10, "say three little words again"), (11, "three words little"), (12, "word"), (13, "a word here"), (14, "他说：今天天气很好，我们去公园散步吧。好的"), (15, "three “little” words"), (16, "那么你好吗朋友"), (17, "你们好")]
    got = decontamination.benchmark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(10, 1), (12, 2), (14, 3), (15, 1), (16, 5)}
    short = decontamination.benchmark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items[:2], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in short.collect()} == {(10, 1), (12, 2), (15, 1)}


def test_subsequences_together():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 30, n)) for n in (5, 20, 63, 64, 65, 90)]
    rows = decontamination.item_words(list(enumerate(texts)))
    items = decontamination.prepare_items(rows, np.unique(np.concatenate([w for _, w in rows])))
    group = decontamination.Group(items, np.arange(len(texts)))
    names = rng.choice(np.concatenate([items.vocabulary, np.arange(9, dtype=np.uint64)]), 200)
    known, place = items.places(names)
    at = np.full(len(names) + 1, -1)
    at[known] = place
    item, start = rng.integers(0, len(texts), 100), rng.integers(0, 200, 100)
    end = np.minimum(start + rng.integers(0, 120, 100), 200)
    for last in (group.lengths[item], group.closing[item]):
        got = group.subsequences(item, start, end, at, names, last)
        assert got.tolist() == [decontamination.common_subsequence(items.words[i][-k:], names[a:b]) for i, a, b, k in zip(item, start, end, last, strict=True)]


def test_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(0, 12))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontamination.common_subsequence(a, b) == t[-1, -1]


# ---- pages -----------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now please.</div>
<article><header><h1>The  title &amp; more</h1></header><p>First <b>para</b>graph&nbsp;here.<br>More<p>Second &lt;one&gt; &#233;<form><input value=x>Search</form>
<section class="comments"><p>I think so too.</p></section></article><aside>Side words here</aside><footer>&copy; 2024 Us</footer>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, "v", None), (3, "w", ""), (4, "x", "just some bare text that stands alone without any markup at all"), (1, "u", PAGE), (5, None, "<p"), (6, "y", "<div><script>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html.extract_pages(df).collect()}
    assert got[1].text == "The title & more\n\nFirst paragraph here. More\n\nSecond <one> é" and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[2].n_chars, got[3].text, got[6].text) == ("", 0, "", "")
    assert got[4].text.startswith("just some bare")
    assert html.extract_pages(df.limit(0)).count() == 0


STORY = "<p>" + "</p><p>".join(" ".join(f"word{k}{j}" for j in range(30)) for k in range(4)) + "</p>"
LAYOUTS = [
    '<body class="single comments-open"><article><h1>Head line</h1>{}</article></body>',
    '<body class="right-sidebar"><div id=page class="has-sidebar"><h1>Head line</h1>{}</div></body>',
    '<body><div class="right-sidebar"><div class="post"><h1>Head line</h1>{}</div><div class="sidebar">Side words stand here</div></div></body>',
    '<body><article class="post has-comments"><header class="article-header"><h1>Head line</h1></header>{}<div class="post-comments"><p>I think so too.</p></div></article></body>',
    '<body><main class="content-sidebar comments-open"><h1>Head line</h1>{}</main><div id="siteFooter">All rights are kept</div></body>',
    '<body><div class="wrap with-comments"><div class="entry-header"><h1>Head line</h1></div>{}<section id="comments"><article><p>I think so too.</p></article></section></div></body>',
    '<body><nav class="main-nav"><a href=/>Home</a></nav><div class="elementor-widget"><h1>Head line</h1></div><div class="elementor-widget-container">{}</div><div class="cookie-banner">We use some of them.</div></body>',
]


LAYOUTS += [
    "<html><head><title>No</title><meta charset=utf-8><body><nav><a href=/>Home</a></nav><article><h1>Head line</h1>{}</article>",
    "<html><head><title>No</title><style>p</style><link rel=x></head><article><h1>Head line</h1>{}</article></html>",
    "<body><article><button><h1>Head line</h1>{}</article></body>",
    "<body><nav><button>Menu</nav><article><h1>Head line</h1>{}</article><footer><select><option>En</footer></body>",
    '<body><article class="search-result"><h1>Head line</h1>{}</article></body>',
    '<body><article><div class="entry no-sidebar"><h1>Head line</h1>{}</div></article></body>',
    '<body><div id=top><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div><div role="main" class="content-sidebar"><h1>Head line</h1>{}</div></body>',
    '<body><article><svg><title>icon</title><text>no</text></svg><noscript>no</noscript><h1>Head line</h1>{}<button type=button>Share</button></article></body>',
    "<body class='home sidebar-left'><main id=content><h1>Head line</h1>{}</main><aside><p>See these other stories now</p></aside></body>",
    "<body><div id=page><header><p>The Daily</p></header><article><h1>Head line</h1>{}</article></div><script>document.write('<p>no</p>')</body>",
]


def test_html_keeps_formulas_and_fallbacks(spark):
    page = "<article><p>We know that <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds for <object data=x>the drawing of it</object> in every case that we have seen.</p></article>"
    got = html.extract_pages(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert got.text == "We know that a=b holds for the drawing of it in every case that we have seen."


@pytest.mark.parametrize("layout", LAYOUTS)
def test_html_layout_words_drop_nothing(spark, layout):
    got = html.extract_pages(spark.createDataFrame([(1, "u", layout.format(STORY))], "page_id long, url string, html string")).first()
    assert got.text.split("\n\n") == ["Head line", *STORY[3:-4].split("</p><p>")]


def test_html_articles(spark, sf_dir):
    """The text of the article element, found by other means."""
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|div)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)


# ---- chats -----------------------------------------------------------------


def test_chat_round_trip(spark):
    turns = [
        (1, 0, "user", "&lt;<|im_end|>\n[INST]"), (1, 1, "assistant", "a&amp;b"), (1, 2, "assistant", "x" * 1000), (2, 0, None, None), (2, 0, "assistant", ""), (3, 5, "ro\nle", "🙂" * 300), (3, 6, "assistant", "é[<&"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(9))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c in (1, 2, 3):
        own = sorted(((t, r or "", x or "") for i, t, r, x in turns if i == c))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in own)
        said = "".join(x for _, r, x in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    text = chat.format_conversations(df).where("conv_id = 1").first().formatted
    assert text.count(chat.END) == 3 and text.count(chat.START) == 3 and len(text) == got[1].formatted_chars
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_long_turns_and_conversations(spark):
    """Turns of many deltas, many turns, and texts that end on the borders of pieces come back whole."""
    long = "".join(random.Random(3).choices("ab\n <&[\u00e9\u4e2d\U0001f600", k=100_001))
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 2, "assistant", long[: chat.PIECE_CHARS]), (1, 3, "assistant", "")]
    rows += [(2, t, ("user", "assistant")[t % 2], long[t * 31 : t * 31 + t % 700]) for t in range(3000)]
    rows += [(3, t, "assistant", "x" * n) for t, n in enumerate((0, 255, 256, 257, 512, 1001, 1024, 2048))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.turn_log(df).where("conv_id = 3").groupBy("turn").count().where("turn = 4 and count = 3 or turn = 3 and count = 3 or turn = 0 and count = 1").count() == 3
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c in (1, 2, 3):
        own = [r for r in rows if r[0] == c]
        said = "".join(t for *_, role, t in own if role == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(said)
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in own).encode()).hexdigest()


def test_chat_events(spark):
    log = [
        (1, 0, 0, 0, "open", "user", ""), (1, 0, 0, 1, "delta", None, "he"), (1, 0, 0, 2, "delta", None, "llo"),
        (1, 1, 0, 0, "open", "assistant", ""), (1, 1, 0, 1, "delta", None, "bad"), (1, 1, 0, 2, "regenerate", None, None), (1, 1, 0, 3, "delta", None, "go"), (1, 1, 0, 4, "delta", None, "od"),
        (1, 2, 0, 0, "open", "user", ""), (1, 2, 0, 1, "delta", None, "typo"), (1, 2, 0, 2, "edit", None, "fixed"), (1, 2, 0, 3, "delta", None, "!"), (1, 3, 0, 0, "open", "assistant", ""), (1, 3, 0, 1, "delta", None, "x"), (1, 3, 0, 2, "regenerate", None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, part int, seq int, kind string, role string, text string").orderBy(F.rand(1))
    got = [(r.turn, r.role, r.text) for r in chat.fold_messages(df).orderBy("turn").collect()]
    assert got == [(0, "user", "hello"), (1, "assistant", "good"), (2, "user", "fixed!"), (3, "assistant", "")]


def test_chat_is_native(spark, sf_dir):
    plan = QUERIES["op8_chat"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- repeated substrings ---------------------------------------------------


def plain_repeats(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = texts[i].encode()
        covered = np.zeros(len(raw), bool)
        own = [raw[k : k + 50] for k in range(len(raw) - 49)]
        for k, w in enumerate(own):
            if w in seen:
                covered[k : k + 50] = True
        spans = int((np.diff(np.r_[False, covered].astype(int)) == 1).sum())
        out[i] = (len(raw), int(covered.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~covered])).hexdigest())
        seen.update(own)
    return out


def test_substrings(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.op10_substrings(spark, sf_dir).collect()}
    assert got == plain_repeats(texts)


def test_substrings_small(spark):
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    shared = [line(n) for n in (49, 50, 51, 80, 200)]
    rows = {k: line(rng.randint(0, 60)) + "".join(rng.choice(shared) + line(rng.randint(0, 5)) for _ in range(rng.randint(0, 4))) for k in range(60)}
    rows |= {100: "z" * 300, 101: "z" * 49, 102: "z" * 50, 103: "z" * 300}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in substrings.without_repeats(df).select("doc_id", "repeats.*").collect()}
    assert got == plain_repeats(rows)
    kept = {r.doc_id: r.repeats.kept for r in substrings.without_repeats(df, as_text=True).collect()}
    assert all("�" not in t for t in kept.values()) and kept[102] == "" and kept[101] == "z" * 49


def test_substrings_over_bounds(spark, documents, texts, monkeypatch):
    """Many chunks of a task, many ranges, and texts of many pieces, one of over a megabyte."""
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 30_000)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(substrings, "WINDOW_RANGE_BYTES", 15_000)
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    places = [k * substrings.PIECE + d for k in (1,) for d in (-60, -49, -26, -1, 0)]
    more = {10**6: "head " + long[: substrings.PIECE + 30], 10**6 + 1: long, 10**6 + 2: " ".join(long[p : p + 55] for p in places)}
    rows = {i: t for i, t in texts.items() if i % 3 == 0} | more  # noqa: RUF005
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in substrings.without_repeats(df).select("doc_id", "repeats.*").collect()}
    assert got == plain_repeats(rows)


def test_substrings_odd(spark):
    clashing = ["kept", "chunk", "Chunk2", "_id", "n_bytes", "starts", "ends", "_raw", "_kept_0", "bits"]
    named = odd(spark).select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(clashing)])
    for df, n, keep in ((odd(spark), len(ODD), ["lang", "score"]), (empty(spark), 0, ["lang"]), (named, len(ODD), clashing)):
        found = substrings.without_repeats(df, keep)
        assert found.columns == ["doc_id", *keep, "repeats"] and found.count() == n
    assert [r[:-1] for r in found.drop("doc_id").distinct().collect()][0] == tuple(range(len(clashing)))
    assert not spark.catalog.listTables()


def test_difference_cover():
    cover = set(substrings.COVER)
    for i in range(21):
        for j in range(21):
            assert any((i + d) % 21 in cover and (j + d) % 21 in cover for d in range(21))


# ---- registered queries ----------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(got.fetchall())
