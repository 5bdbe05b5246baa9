"""URL rules, spelling variants and tokenizer alignment against brute force, and on odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from voxmill.llm import alignment, spelling, urlrules
from voxmill.llm.queries import ORACLE_SQL, QUERIES

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_urls", "op12_spelling"])
def test_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, got))


# ---- URL rules -------------------------------------------------------------


def test_fixed_rules(spark):
    urls = [
        (1, "https://A.Example.NET/en/x?q#f"), (2, "http://net"), (3, "http://net/"), (4, "http://xnet/"), (5, "http://example.com/de"), (6, "http://example.com/de/?a"), (7, "x://a.org/fr/"),
        (8, None), (9, "no scheme net/"), (10, ""), (11, "http://example.net?x/en/"), (12, "http://example.net/EN/"), (13, "a://b://c.net/"), (None, "http://a.org/fr/é\n/x"), (1, "https://A.Example.NET/en/x?q#f"), (14, "http://u@h.net:8/"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("other"))
    got = urlrules.judged(pages, urlrules.RuleIndex.of([])).drop("confidence").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(
        map(
            repr,
            [
                (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "net", "", None, "allow"), (3, "net", "/", "net/", "block"), (4, "xnet", "/", None, "allow"),
                (5, "example.com", "/de", None, "allow"), (6, "example.com", "/de/", "example.com/de/", "block"), (7, "a.org", "/fr/", "org/fr/", "allow"), (8, "", "", None, "allow"), (9, "", "", None, "allow"), (10, "", "", None, "allow"),
                (11, "example.net", "", None, "allow"), (12, "example.net", "/EN/", "net/", "block"), (13, "b:", "//c.net/", None, "allow"), (None, "a.org", "/fr/é\n/x", "org/fr/", "allow"), (14, "u@h.net:8", "/", None, "allow"),
            ],
        )
    )
    assert urlrules.judged(pages.limit(0), urlrules.RuleIndex.of([])).isEmpty()


def test_mined_rules_equal_counting_every_set(spark):
    """Two planted combinations, each of tokens that are harmless alone."""
    rng = random.Random(5)
    pages, labels = [], []
    for i in range(1200):
        host, lang, key = rng.choice(["a", "b", "c"]), rng.choice(["en", "de", "fr"]), rng.choice(["id", "ref", "s"])
        bad = ((host, lang) == ("a", "de") or (lang, key) == ("fr", "ref")) if rng.random() < 0.95 else rng.random() < 0.3
        pages.append((i, f"http://{host}.site.test/{lang}/{rng.randrange(50)}?{key}=1"))
        if i % 3:
            labels.append((i, int(not bad), 0))
    table, marks = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample = urlrules.labelled_urls(table, marks)
    index = urlrules.mine_rules(sample)
    sets, bad_sets = Counter(), Counter()
    for r in sample.collect():
        for k in range(1, len(r.tokens) + 1):
            for s in combinations(sorted(r.tokens), k):
                sets[s] += 1
                bad_sets[s] += r.bad
    strong = {s: bad_sets[s] / n for s, n in sets.items() if bad_sets[s] >= urlrules.MIN_ROWS and bad_sets[s] / n >= urlrules.MIN_CONFIDENCE}
    tokens = {r._id: r.tokens for r in table.select(F.col("page_id").alias("_id"), urlrules.url_tokens(F.col("url")).alias("tokens")).collect()}
    want = {i: max((c for s, c in strong.items() if set(s) <= set(t)), default=None) for i, t in tokens.items()}
    got = {r.page_id: r.confidence for r in urlrules.judged(table, index, ()).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) if want[i] else got[i] is None for i in want)
    assert 0 < sum(x is not None for x in want.values()) < len(want) and len(index.sizes) < len(strong)


def test_no_labels_give_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urlrules.mine_rules(urlrules.labelled_urls(pages, none)).sizes == ()
    one = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (1, None, 0), (2, 5, 0)], "doc_id long, quality int, toxic int")
    assert urlrules.mine_rules(urlrules.labelled_urls(pages, one)).sizes == ()


# ---- spelling variants -----------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {w: min(v, key=lambda x: (-words[x], x)) if v else None for w, v in near.items()}
    form = {w: f if f and words[f] >= 2 * words[w] else None for w, f in form.items()}
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_spelling_equals_comparing_all_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FIRST_DEPTH", 6)
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(120)] + ["aaaaa", "aaaaaa", "aaaaaaa", "x" * 12, "x" * 13, "x" * 12 + "y", "y" + "x" * 12, "x" * 11 + "yx", "ÿ" * 5, "ÿÿàÿÿ"]
    words = {w: rng.choice([1, 2, 3, 5, 8, 20, 50, 200]) for w in base}
    got = spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert len(got) == len(words) and set(map(tuple, got)) == plain_variants(words)


def test_word_counts(spark):
    docs = spark.createDataFrame([(7, "Hello hello WORLDS über-große ÀÀÀÀÀ x " * 60, None, None, None), (None, "hello é", None, None, None), (3, None, None, None, None), (3, "", None, None, None), (7, "Hello", None, None, None)], DOC)
    want = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{low}".encode())
            want[low if h % 97 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    assert dict(map(tuple, spelling.word_counts(docs).collect())) == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}


def test_spelling_of_nothing(spark):
    none = spark.createDataFrame([], DOC)
    assert spelling.spelling_variants(spelling.word_counts(none)).isEmpty()
    assert spelling.spelling_variants(spark.createDataFrame([("alone", 4)], "word string, n long")).collect() == [("alone", None, "alone", 4, 0, None)]


# ---- tokenizer alignment ---------------------------------------------------


def plain_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, pair by pair."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    entry = {i: t for t, i in json.load(open(PATHS[0], encoding="utf-8"))["model"]["vocab"].items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    found = []
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw_a = [bytes(byte[c] for c in entry[i]) for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) and b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not t or b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            found.append(None)
            continue
        spans = [[(sum(map(len, raw[:k])), sum(map(len, raw[: k + 1]))) for k in range(len(raw))] for raw in (raw_a, raw_b)] if len(t) < 3000 else [list(zip(np.cumsum([0, *map(len, r)])[:-1].tolist(), np.cumsum(list(map(len, r))).tolist(), strict=True)) for r in (raw_a, raw_b)]
        links, j = [], 0
        for i, (x, y) in enumerate(spans[0]):
            while spans[1][j][1] <= x:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < y:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        ends = sorted({y for _, y in spans[0]} & {y for _, y in spans[1]})
        parts, since = [], 0
        for e in ends:
            parts.append("|".join(",".join(str(i) for i, (x, y) in zip(ids, s, strict=True) if since <= x and y <= e) for ids, s in zip((ids_a, ids_b), spans, strict=True)))
            since = e
        found.append((len(ids_a), len(ids_b), len(ends), links, ";".join(parts)))
    counts = Counter(p for f in found if f for p in set(f[3]))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [(f[0], f[1], f[2], len(f[3]), sum(counts[p] == top[p[0]] for p in f[3]), sum(counts[p] for p in f[3]), sha256(f[4].encode()).hexdigest()) if f else (0, 0, 0, 0, 0, 0, "") for f in found]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD_TEXTS = [None, "", " ", "  two  spaces ", "a\n\n b\tc \u3000d", "日本語のテキスト 🙂", "<|endoftext|> </s> <s> <0x0A> x", "under▁line", "ｆｕｌｌ é e\u0301", "don't 12345 1,000.50", "word", "word", "x" * 1500, "ab " * 700, "\u00a0nbsp", "tab\t"]


def test_alignment_equals_brute_force(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 2500").orderBy("doc_id").limit(40).collect()] + ODD_TEXTS
    docs = spark.createDataFrame([(k if k % 9 else 9, t, "en", None, None) for k, t in enumerate(texts)], DOC).withColumn("chunk", F.lit(1)).repartition(3)
    got = alignment.cross_tokenizer_links(docs, *PATHS)
    want = [(k if k % 9 else 9, *row) for k, row in enumerate(plain_alignment(texts))]
    assert sorted(map(tuple, got.select("doc_id", *COLUMNS).collect())) == sorted(want)
    assert not spark.catalog.listTables()


def test_small_chunks_make_no_difference(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 4000").limit(50)
    want = sorted(map(tuple, alignment.cross_tokenizer_links(docs, *PATHS).collect()))
    monkeypatch.setattr(alignment, "SUMMED", 2)
    assert sorted(map(tuple, alignment.cross_tokenizer_links(docs.repartition(7), *PATHS).collect())) == want


def test_no_documents(spark):
    assert alignment.cross_tokenizer_links(spark.createDataFrame([], DOC), *PATHS).isEmpty()


def test_products_are_matrix_products():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(1, 6, 12), rng.integers(1, 6, 40)
        b = b[: np.searchsorted(np.cumsum(b), a.sum()) + 1]
        b[-1] -= b.sum() - a.sum()
        b = b[b > 0]
        dense = lambda x: np.repeat(np.eye(len(x), dtype=int), x, axis=1)
        want = dense(a) @ dense(b).T
        got = np.zeros_like(want)
        for i, j, n in alignment.overlap_links(a, b):
            got[i, j] = n
        assert (got == want).all()
        of_a, of_b = alignment.groups(a, b)
        linked = np.zeros_like(want)
        for i, j in alignment.group_links(a, b):
            linked[i, j] = 1
        assert (linked == (of_a[:, None] == of_b[None, :])).all() and (linked >= (want > 0)).all()
