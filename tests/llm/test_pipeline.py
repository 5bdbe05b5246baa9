"""The stages one after another: columns, effects and odd inputs."""

import re
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from voxmill.llm import decontamination, neardup, substrings, toxicity


def staged(spark, docs, sf_dir, folder):
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], sf_dir).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw, clean, single, cut, safe, packed = staged(spark, docs, sf_dir, tmp_path)
    for df in (clean, single, cut, safe):
        assert df.dtypes == docs.dtypes
    assert raw.count() > clean.count() > single.count() == cut.count() >= safe.count() > 0
    assert neardup.near_duplicates(single).where("not kept").isEmpty()
    assert decontamination.benchmark_leaks(safe, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).isEmpty()
    before, after = ({r.doc_id: r for r in df.collect()} for df in (single, cut))
    assert all(after[i].n_chars == len(after[i].text) <= len(before[i].text) and after[i].source == before[i].source for i in before)
    removed = {r.doc_id: sum(r.ends) - sum(r.starts) for r in substrings.without_repeats(single).select("doc_id", "repeats.*").collect()}
    assert all(len(before[i].text.encode()) - len(after[i].text.encode()) <= removed[i] for i in before)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in safe.select("doc_id").collect()}
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024


def test_stages_keep_columns_of_any_name(spark, sf_dir, tmp_path):
    names = ["kept", "chunk", "_id", "n_bytes", "starts", "ends", "repeats", "class_id", "token", "sequence_id", "size", "score"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    for df in staged(spark, docs, sf_dir, tmp_path)[1:-1]:
        assert df.columns == docs.columns and df.select(*names).distinct().collect() == [tuple(range(len(names)))]


def test_runs_leave_nothing(spark, sf_dir):
    """Two runs in one session, the first still read when the second begins."""
    first, second = corpus_pipeline.run(spark, sf_dir), corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, first.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, second.select("doc_id", "piece", "ids_crc32").collect()))
    assert not spark.catalog.listTables()
    left = {p.name.split("-")[0].split("_")[0] for p in Path(spark.conf.get("spark.checkpoint.dir")).iterdir()}
    assert not left & {"pipeline", "repeats", "links", "trie"}


def test_empty(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert [df.count() for df in staged(spark, docs, sf_dir, tmp_path)] == [0] * 6


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_toxic_documents_go_one_by_one(spark, sf_dir):
    """The stage keeps just the documents that the model, applied to one text at a time, scores under the threshold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = sorted(r.doc_id for r in docs.collect() if model.score([r.text or ""])[0] < toxicity.THRESHOLD)
    assert sorted(r.doc_id for r in corpus_pipeline.reject_toxic(spark, docs, sf_dir).collect()) == want and 0 < len(want) < docs.count()


def test_of_near_duplicates_the_least_id_stays(spark, sf_dir):
    """Every pair of shingle sets compared."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = sorted(i for i in sets if top(i) == i)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()) == want and len(want) < len(sets)
