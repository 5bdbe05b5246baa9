"""Spelling variants by a relational trie frontier.

Words and their reversals stand in one trie, kept as a table of edges (parent, label, ...) whose
nodes are prefixes. States are (word, position, node, edits). Those without an edit are the prefixes of
a word from its middle on: a word that differs in its second half is met by the word as it is, one
that differs in its first half by the reversal, so states are deep in the trie, where nodes have few
children. Joined with the edges they take their one edit, and one-edit states then go on level by
level, each level a join with the edges. Deletions and substitutions by a greater character are
followed; nearness is symmetric, so the other directions need no states. A state ends where its node
holds one word (the rest is compared by its hash) and cannot go on where the child lacks the next
character. Edges of nodes with very many words stand in several shares, to which their states are dealt.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, configured, remove, settled, shared_folder, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOSES_ONE_IN = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 400_000
#: Prefixes of up to so many characters are counted at first; longer ones only of words that still share one.
FIRST_DEPTH = 32
#: Words of a node for each share of its states.
NODE_WORDS = 50_000
_LOWER = {c: c + 32 for c in range(65, 91)}


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the runs of letters, A-Z lower-cased, one in 97 (by crc32 of `<doc_id>:<run>`) without a character.

    A null text has no words, a null id reads as an empty one; repeated rows count again. Texts
    are read whole, and each task counts before anything is shuffled.
    """
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def flushed() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})
            held.clear()
            return out

        for b in batches:
            for key, text in zip(b["key"], b["text"], strict=True):
                for run, n in Counter(RUN.findall(text)).items() if isinstance(text, str) else ():
                    word = run.lower() if run.isascii() else run.translate(_LOWER)
                    h = zlib.crc32(f"{key}:{word}".encode())
                    if h % LOSES_ONE_IN == 0:
                        word = word[: (at := h % len(word))] + word[at + 1 :]
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield flushed()
        if held:
            yield flushed()

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    counted = keyed.mapInPandas(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _place(char: str) -> str:
    """SQL of a letter's place in its mask: a to z in the first, the letters from U+00C0 on in the second."""
    return f"CASE WHEN ascii({char}) < 128 THEN ascii({char}) - 97 ELSE ascii({char}) - 192 END"


def _trie(sides: DataFrame) -> DataFrame:
    """(node, n, rest, last, low, high): words below, hash of what follows the node (of one word), whether a word ends here, next letters."""
    size, done = F.length("side"), None
    alive, since, to = sides, 3, FIRST_DEPTH
    while True:
        at = alive.select("side", F.explode(F.sequence(F.lit(since), F.least(size, F.lit(to)))).alias("depth"))
        rows = at.select(F.expr("left(side, depth)").alias("node"), F.expr("substring(side, depth + 1, 1)").alias("next"), F.xxhash64(F.expr("substring(side, depth + 1)")).alias("rest"))
        ended, ascii_, bit = F.col("next") == "", F.ascii("next") < 128, F.expr(f"shiftleft(1L, {_place('next')})")
        rows = rows.select("node", "rest", ended.alias("last"), F.when(~ended & ascii_, bit).otherwise(F.lit(0)).alias("low"), F.when(~ended & ~ascii_, bit).otherwise(F.lit(0)).alias("high"))
        nodes = settled(rows.groupBy("node").agg(F.count("*").alias("n"), F.max("rest").alias("rest"), F.max("last").alias("last"), F.bit_or("low").alias("low"), F.bit_or("high").alias("high")))
        done = nodes if done is None else done.unionByName(nodes)
        same = nodes.where((F.length("node") == to) & (F.col("n") > 1)).select(F.col("node").alias("_node"))
        if same.isEmpty():
            return done
        alive = alive.where(size > to).join(same, F.expr(f"left(side, {to})") == F.col("_node"), "left_semi")
        since, to = to + 1, 2 * to


def _moved(met: DataFrame, moves: Column) -> DataFrame:
    """(side, pos, node, n, hit): the one-edit states after the `moves` (new positions) along the edge each row holds, and the neighbours (`hit`) they end in."""
    size, through = F.length("side"), F.col("pos") == F.length("side")
    after = met.select("side", F.concat("node", "label").alias("node"), "label", "n", "rest", "last", "low", "high", F.explode(F.array_compact(moves)).alias("pos"))
    left_over, ended = F.expr("substring(side, pos + 1)"), F.col("label") == ""
    after = after.withColumn("coming", F.expr("substring(side, pos + 1, 1)"))
    hit = F.when(ended, F.col("node")).when((F.col("n") == 1) & (F.col("rest") == F.xxhash64(left_over)), F.concat("node", left_over)).when((F.col("n") > 1) & through & F.col("last"), F.col("node"))
    held = F.expr(f"shiftrightunsigned(if(ascii(coming) < 128, low, high), {_place('coming')}) & 1") == 1
    goes_on = ~ended & (F.col("n") > 1) & (F.col("pos") < size) & held
    return after.withColumn("hit", hit).where(F.col("hit").isNotNull() | goes_on).select("side", "pos", "node", "n", "hit")


def _salted(n: str) -> str:
    """SQL of how many shares the states of a node with n words are dealt to."""
    return f"CAST(1 + {n} DIV {NODE_WORDS} AS INT)"


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near), both ways, of distinct `word`s of the letters a-z and U+00C0 to U+00FF that differ by one character.

    Words are taken to have five characters or more. The rounds are as many as the longest way that a one-edit state
    goes through nodes that several words share; nothing is left out at any length.
    """
    spark = words.sparkSession
    sides = settled(words.select(F.explode(F.array(F.concat(F.lit("f"), "word"), F.concat(F.lit("r"), F.reverse("word")))).alias("side")))
    nodes = _trie(sides)
    name, folder = f"trie_{uuid.uuid4().hex}", f"{shared_folder(spark)}/trie-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        # An edge is its child with the parent's name; a word ends in an edge without a letter.
        facts = ("n", "rest", "last", "low", "high")
        inner = nodes.where(F.length("node") > 3).select(F.expr("left(node, length(node) - 1)").alias("parent"), F.right("node", F.lit(1)).alias("label"), *facts)
        ends = nodes.where("last").select(F.col("node").alias("parent"), F.lit("").alias("label"), F.lit(1).cast("long").alias("n"), F.xxhash64(F.lit("")).alias("rest"), "last", *[F.lit(0).cast("long").alias(c) for c in ("low", "high")])
        edges = inner.unionByName(ends).withColumn("total", F.sum("n").over(Window.partitionBy("parent"))).where("total > 1")
        edges = edges.select("parent", "label", *facts, F.explode(F.sequence(F.lit(0), F.expr(_salted("total")) - 1)).alias("salt"))
        edges.repartition(parts, "parent", "salt").write.bucketBy(parts, "parent", "salt").sortBy("parent", "salt").option("path", folder).saveAsTable(name)
        edges = spark.table(name).withColumnRenamed("parent", "node")

        half = (F.length("side") - 1) / 2
        middle = F.when(F.col("side").startswith("f"), F.floor(half)).otherwise(F.ceil(half)).cast("int") + 1
        starts = sides.select("side", F.explode(F.sequence(middle, F.length("side") - 1)).alias("pos")).withColumn("node", F.expr("left(side, pos)"))
        here, after = F.expr("substring(side, pos + 1, 1)"), F.expr("substring(side, pos + 2, 1)")
        replaced = F.when(F.col("label") > here, F.col("pos") + 1)
        # Of equal characters in a row the last one is deleted; past the end a word's end follows.
        deleted = F.when((F.col("label") == after) & (after != here), F.least(F.col("pos") + 2, F.length("side")))
        level = settled(_moved(starts.join(edges.where("salt = 0"), "node"), F.array(replaced, deleted)))
        hits = level.where("hit IS NOT NULL").select("side", "hit")
        while not (states := level.where("hit IS NULL")).isEmpty():
            dealt = states.select("side", "pos", "node", F.expr(f"CAST(pmod(xxhash64(side), {_salted('n')}) AS INT)").alias("salt"))
            level = settled(_moved(dealt.join(edges, ["node", "salt"]), F.array(F.when(F.col("label") == here, F.col("pos") + 1))))
            hits = hits.unionByName(level.where("hit IS NOT NULL").select("side", "hit"))
        plain = lambda c: F.when(F.col(c).startswith("f"), F.substring(c, 2, 1 << 30)).otherwise(F.reverse(F.substring(c, 2, 1 << 30)))
        pairs = hits.select(plain("side").alias("a"), plain("hit").alias("b")).distinct()
        both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p"))
        return settled(both.select("p.word", "p.near"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, folder)


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each by its form, in rounds that double the way."""
    own = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        further = own.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = settled(own.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        own = longer.drop("_moved")
        if longer.where("_moved").isEmpty():
            return own


def spelling_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the (word, n) given.

    A word's form is its near word of largest n (ties: the smallest) if that is at least twice the word's own;
    its root ends the chain of forms. An empty table gives no rows. Words must be distinct.
    """
    words = settled(words.select("word", "n"))
    # Settled frames have no known size, and each join would first gather a filter of their keys on the driver.
    with configured(words.sparkSession, spark__sql__optimizer__runtime__bloomFilter__enabled="false"):
        return _variants(words)


def _variants(words: DataFrame) -> DataFrame:
    near = near_pairs(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    most = -F.col("best.less")
    usual = F.coalesce(most >= 2 * F.col("n"), F.lit(False))
    out = settled(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best.near")).alias("form"), F.when(usual, most).alias("form_n")))
    roots = follow(out.where("form is not null"))
    return settled(out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))


OP12_SQL = rf"""WITH RECURSIVE step AS (SELECT range AS i, range AS c, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
once AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT w, n, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM once, crc),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT word, rest FROM holes WHERE rest IN (SELECT word FROM words) UNION SELECT rest, word FROM holes WHERE rest IN (SELECT word FROM words)),
best AS (SELECT p.word, count(*) AS n_near, min({{'less': -v.n, 'near': p.near}}) AS b FROM pairs p JOIN words v ON v.word = p.near GROUP BY p.word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 2 * w.n THEN b.near END AS form, CASE WHEN -b.less >= 2 * w.n THEN -b.less END AS form_n FROM words w LEFT JOIN best USING (word)),
ways AS (SELECT word, word AS root, 0 AS steps FROM formed UNION ALL SELECT ways.word, f.form, steps + 1 FROM ways JOIN formed f ON f.word = ways.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, max_by(root, steps) AS root FROM ways GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)"""
