"""Near-duplicate groups by a signature-coordinate inverted join on MinHash.

Documents with equal shingle sets are one class, so copies are joined once. Each class posts
its signature under (coordinate, value) tokens. Classes that agree in at least `matches` of the
COORDINATES share one of any COORDINATES - matches + 1 tokens, so only the rarest tokens are
posted, and lists of one class are skipped. Each class is first held against the first class of
its lists that it collides with most; pairs whose sketches agree make families, and those
that the full sets confirm make components, which hold most of a large group. Lists that touch
several families are then compared in bounded cells, which merge families that agree. What can
be linked is by then in one family: the classes outside a family's main component are held
against all of it, in cells bounded by the bytes of their sets. A cell gives no pairs but a
spanning forest, so what is passed on never outgrows the rows that a task has read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, settled, table
from .hashing import distinct, mixed, word_names

COORDINATES = 64  # of the posted signature, 32 bits each
SKETCHED, NIBBLE = 256, 16  # coordinates of the sketch, and values of each
#: A pair at the least similarity has fewer agreeing coordinates than asked for about once in so many.
ONE_MISS_IN = 10_000_000
COUNT_BITS = 16
BLOCK_ROWS = 4096  # classes of one list that a task compares at once
SET_BYTES = 8 << 20  # full sets of one family that a task indexes at once
ASK_BYTES = 64 << 20  # full sets that are held against them in one task
#: Collisions that make a first pair; pairs with fewer wait for the second round.
FIRST_HITS = 3
#: So many ids (8 bytes each) are sent to the readers of the texts; beyond it the join is shuffled.
BROADCAST_IDS = 500_000
WORDS, SIMILARITY = 5, 0.8

_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, *range(9, 14)]] = False


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit names of the text's runs of `words` words; A-Z count as a-z.

    Words are runs of anything but ASCII white space. A shorter text is one run; a text
    without words has none.
    """
    name, _ = word_names(np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8), _IN_WORD)
    if not len(name):
        return np.zeros(0, np.uint64)
    width = min(words, len(name))
    out = np.full(len(name) - width + 1, np.uint64(width))
    for k in range(width):
        out = mixed(out + name[k : len(name) - width + 1 + k])
    return distinct(out)


def least_matches(coordinates: int, agreeing: float) -> int:
    """The most matches to ask for so that a pair whose coordinates agree with this chance is missed once in ONE_MISS_IN."""
    missed = 0.0
    for k in range(coordinates + 1):
        missed += math.comb(coordinates, k) * agreeing**k * (1 - agreeing) ** (coordinates - k)
        if missed > 1 / ONE_MISS_IN:
            return k
    return coordinates


def thresholds(similarity: float) -> tuple[int, int]:
    """Coordinates that must agree in the posted signature and in the sketch."""
    return least_matches(COORDINATES, similarity), least_matches(SKETCHED, similarity + (1 - similarity) / NIBBLE)


_RANDOM = np.random.default_rng(20240229)
_FACTOR = _RANDOM.integers(0, 1 << 63, SKETCHED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 1 << 63, SKETCHED, dtype=np.uint64)


def signature(names: np.ndarray) -> tuple[bytes, bytes]:
    """The posted coordinates, and a sketch: four bits of each of more coordinates."""
    least = np.full(SKETCHED, np.iinfo(np.uint64).max, np.uint64)
    hashed = np.empty((SKETCHED, min(len(names), 512)), np.uint64)
    for at in range(0, len(names), 512):
        part = names[at : at + 512]
        out = hashed[:, : len(part)]
        np.multiply(part, _FACTOR[:, None], out=out)
        np.add(out, _SHIFT[:, None], out=out)
        np.minimum(least, out.min(1), out=least)
    high = (least >> np.uint64(32)).astype(np.uint32)
    low = (high & 15).astype(np.uint8)
    return high[:COORDINATES].tobytes(), (low[::2] | low[1::2] << 4).tobytes()


def set_key(names: bytes) -> bytes:
    return hashlib.blake2b(names, digest_size=16).digest()


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature, sketch) of every row, from its whole text."""
    bound_batches(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                names = shingle_set(text, words) if isinstance(text, str) else np.zeros(0, np.uint64)
                out.append((doc_id, len(names), set_key(names.tobytes()), *signature(names)))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_key", "signature", "sketch"])

    return docs.select("doc_id", "text").mapInPandas(rows, "doc_id long, n_shingles long, set_key binary, signature binary, sketch binary")


def _tokens(signatures: pd.Series) -> np.ndarray:
    values = np.frombuffer(b"".join(signatures), np.uint32).reshape(-1, COORDINATES).astype(np.uint64)
    return mixed(values + (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)))


def _token_counts(classes: DataFrame) -> np.ndarray:
    """How often tokens occur, by hash bucket: a fixed number of counts, whatever the input."""
    size = 1 << COUNT_BITS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount((_tokens(b["signature"]) & np.uint64(size - 1)).ravel().astype(np.int64), minlength=size)
        yield pd.DataFrame({"bucket": np.flatnonzero(total), "n": total[total > 0]})

    out = np.zeros(size, np.int64)
    for r in classes.select("signature").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def postings(classes: DataFrame, matches: int) -> DataFrame:
    """(token, class_id, first): each class under its rarest tokens, in lists of two classes or more.

    Two classes that agree in `matches` coordinates meet in a list.
    """
    counts = _token_counts(classes)
    posted = COORDINATES - matches + 1

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tokens = _tokens(b["signature"])
            common = counts[(tokens & np.uint64(len(counts) - 1)).astype(np.int64)].astype(np.uint64)
            rank = (common << np.uint64(24)) | (tokens >> np.uint64(40))
            rare = np.take_along_axis(tokens, np.argsort(rank, axis=1, kind="stable")[:, :posted], axis=1)
            yield pd.DataFrame({"token": rare.ravel().view(np.int64), "class_id": np.repeat(b["class_id"].to_numpy(), posted)})

    posts = classes.select("class_id", "signature").mapInPandas(post, "token long, class_id long")
    lists = posts.groupBy("token").agg(F.count("*").alias("n"), F.min("class_id").alias("first")).where("n > 1")
    return posts.join(lists, "token").select("token", "class_id", "first")


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many coordinates sketches agree."""
    apart = x ^ y
    return ((apart & 15) == 0).sum(-1, dtype=np.int32) + ((apart & 240) == 0).sum(-1, dtype=np.int32)


def _table(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCHED // 2)


def retained(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose sketches agree in `matches` coordinates."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[_agreeing(_table(b["x"]), _table(b["y"])) >= matches, ["a", "b"]]

    side = lambda i, c: classes.select(F.col("class_id").alias(i), F.col("sketch").alias(c))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInPandas(count, "a long, b long")


def full_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, names) of the classes in `ids` (id, distinct), from the texts that stand for them."""
    asked = settled(classes.join(ids.withColumnRenamed("id", "class_id"), "class_id", "left_semi").select(F.col("class_id").alias("doc_id"), "set_key"))
    found = docs.select("doc_id", "text").join(F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked, "doc_id")

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t or "", words).tobytes() for t in b["text"]]
            # Another text under the same id is not the one that stands for the class.
            own = [set_key(x) == key for x, key in zip(sets, b["set_key"], strict=True)]
            yield pd.DataFrame({"id": b["doc_id"], "names": sets})[own]

    return found.mapInPandas(names, "id long, names binary")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids whose full sets meet the similarity."""

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fit = []
            for x, y in zip(b["x"], b["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                fit.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.loc[fit, ["a", "b"]]

    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), classes, docs, words)
    full = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return full.select("a", "b", "x", "y").mapInPandas(hold, "a long, b long").distinct()


def rooted(pairs: DataFrame) -> DataFrame:
    """(id, component) over `pairs` (a, b) in which each b occurs once and a < b: the end of each chain, by pointer jumps."""
    labels = pairs.select(F.col("b").alias("id"), F.col("a").alias("component"))
    while True:
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        moved = settled(labels.join(jump, "component", "left").select("id", F.coalesce("far", "component").alias("component"), F.col("far").isNotNull().alias("moved")))
        labels = moved.select("id", "component")
        if moved.where("moved").isEmpty():
            ends = labels.select("component").distinct()
            return labels.union(ends.select("component", F.col("component").alias("same")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over `edges` (a, b), by label passing with pointer jumps."""
    both = settled(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = settled(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        passed = labels.join(near, labels.id == near.a).select("id", F.least("component", "near").alias("next"), "component")
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        moved = settled(passed.join(jump, "next").select("id", F.least("next", "far").alias("component"), F.col("component").alias("was")))
        labels = moved.select("id", "component")
        if moved.where("component < was").isEmpty():
            return labels


def united(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """`labels` (id, component) after `edges` (a, b) between components, or ids of none as their own."""
    top = components(edges)
    known = labels.join(top.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left")
    alone = top.join(labels, "id", "left_anti")
    return settled(known.select("id", F.coalesce("top", "component").alias("component")).union(alone))


class Forest:
    """Sets of ids that are joined one by one."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart until now."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def first_pairs(posts: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class with the head of a list, the one it meets in most lists."""
    hits = posts.where("class_id <> first").groupBy(F.col("first").alias("a"), F.col("class_id").alias("b")).agg(F.count("*").alias("hits"))
    near = hits.where(F.col("hits") >= FIRST_HITS).join(sizes.toDF("a", "n"), "a").join(sizes.toDF("b", "m"), "b")
    near = near.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    return near.groupBy("b").agg(F.max_by("a", F.struct("hits", -F.col("a"))).alias("a")).select("a", "b")


def _crossed(n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists with n outer and m inner rows, laid end to end: the places of every (outer, inner) of a list."""
    pairs = n * m
    own = np.repeat(np.arange(len(n)), pairs)
    inside = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    return (np.cumsum(n) - n)[own] + inside // m[own], (np.cumsum(m) - m)[own] + inside % m[own]


def family_merges(posts: DataFrame, classes: DataFrame, families: DataFrame, percent: int, matches: int) -> DataFrame:
    """(a, b): families (`families`, or a class of none as its own) of which two classes share a list and agree.

    Lists within one family are done. In the others the classes outside the list's main family
    meet all of its classes; of any two families one is outside the main one. Long lists are cut
    into cells of bounded blocks of either side. A task joins families as it goes, passes over
    classes that are already together, and gives each join once.
    """
    small = classes.select("class_id", F.col("n_shingles").cast("int").alias("n"), "sketch")
    placed = posts.join(families.withColumnRenamed("id", "class_id"), "class_id", "left").select(
        "token", "class_id", F.coalesce("component", "class_id").alias("component")
    )
    parts = placed.groupBy("token", "component").agg(F.count("*").alias("n"))
    lists = parts.groupBy("token").agg(F.max_by("component", "n").alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    lists = lists.select("token", "main", blocks(F.col("all")).alias("in_blocks"), blocks(F.col("all") - F.col("most")).alias("out_blocks"))
    rows = placed.join(lists, "token").join(small, "class_id").withColumn("outside", F.col("component") != F.col("main"))
    one = (F.col("in_blocks") == 1) & (F.col("out_blocks") == 1)
    at = lambda n: F.pmod(F.xxhash64("class_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = F.struct("component", "n", "sketch")
    whole = rows.where(one).select("token", F.lit(0).alias("i"), F.lit(0).alias("j"), row.alias("row"), F.col("outside").alias("outer"), F.lit(True).alias("inner"))
    inner = rows.where(~one).select("token", each("out_blocks").alias("i"), at("in_blocks").alias("j"), row.alias("row"), F.lit(False).alias("outer"), F.lit(True).alias("inner"))
    outer = rows.where(~one & F.col("outside")).select("token", at("out_blocks").alias("i"), each("in_blocks").alias("j"), row.alias("row"), F.lit(True).alias("outer"), F.lit(False).alias("inner"))
    cells = whole.union(inner).union(outer).groupBy("token", "i", "j").agg(
        F.collect_list(F.when(F.col("outer"), F.col("row"))).alias("x"), F.collect_list(F.when(F.col("inner"), F.col("row"))).alias("y")
    )
    fields = [F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in "xy" for f in ("component", "n", "sketch")]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()

        def joined(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
            return [(x, y) for x, y in set(zip(a.tolist(), b.tolist(), strict=True)) if forest.join(x, y)]

        def short(b: pd.DataFrame, n: np.ndarray, m: np.ndarray) -> list[tuple[int, int]]:
            flat = lambda c: np.concatenate(b[c].to_numpy())
            x, y = _crossed(n, m)
            xp, yp, xn, yn = flat("x_component")[x], flat("y_component")[y], flat("x_n")[x], flat("y_n")[y]
            fit = np.flatnonzero((xp != yp) & (100 * np.minimum(xn, yn).astype(np.int64) >= percent * np.maximum(xn, yn).astype(np.int64)))
            fit = fit[_agreeing(_table(flat("x_sketch"))[x[fit]], _table(flat("y_sketch"))[y[fit]]) >= matches]
            return joined(xp[fit], yp[fit])

        def long(r: pd.Series) -> list[tuple[int, int]]:
            families, place = np.unique(r["y_component"], return_inverse=True)
            root = np.array([forest.root(f) for f in families.tolist()])
            size, sketch, found = r["y_n"].astype(np.int64), _table(r["y_sketch"]), []
            for family, n, own in zip(r["x_component"].tolist(), r["x_n"].tolist(), r["x_sketch"], strict=True):
                mine = forest.root(family)
                near = np.flatnonzero((root[place] != mine) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n)))
                near = near[_agreeing(sketch[near], np.frombuffer(own, np.uint8)) >= matches]
                for other in families[np.unique(place[near])].tolist():
                    if forest.join(family, other):
                        found.append((family, other))
                if len(near):
                    root = np.array([forest.root(f) for f in families.tolist()]) if len(found) else root
            return found

        for b in batches:
            n, m = b["x_n"].map(len).to_numpy(np.int64), b["y_n"].map(len).to_numpy(np.int64)
            found = []
            for k in np.flatnonzero(n * m > 1 << 12):
                found += long(b.iloc[k])
            few = np.flatnonzero(n * m <= 1 << 12)
            group = np.cumsum((n * m)[few]) >> 14  # so many pairs at once
            for g in np.unique(group):
                own = few[group == g]
                found += short(b.iloc[own], n[own], m[own])
            yield pd.DataFrame(found, columns=["a", "b"])

    return cells.where(F.size("x") > 0).select(*fields).mapInPandas(compare, "a long, b long").distinct()


def group_links(asking: DataFrame, members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): components (`labels`, or a class of none as its own) that links on full sets join,
    of the classes in `asking` (id, group) with the members (id, group) of the group.

    Both sides of a group are cut into blocks by the bytes of their sets, and each pair of blocks is a
    cell: its members come first in the task, then the askers, one by one. Classes of one component
    are passed over, and so are those that links of the cell have joined: it gives a forest.
    """
    sized = lambda rows: rows.join(classes.select(F.col("class_id").alias("id"), "n_shingles"), "id").groupBy("group").agg(F.sum("n_shingles").alias("n"))
    parts = lambda n, most: F.ceil(F.col(n) * 8 / most).cast("int")
    members = members.join(asking.select("group").distinct(), "group", "left_semi")
    sizes = sized(members).select("group", parts("n", SET_BYTES).alias("blocks")).join(sized(asking).select("group", parts("n", ASK_BYTES).alias("turns")), "group")
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = members.join(sizes, "group").select("id", "group", at("blocks").alias("block"), each("turns").alias("turn"), F.lit(0).alias("side"))
    ask = asking.join(sizes, "group").select("id", "group", each("blocks").alias("block"), at("turns").alias("turn"), F.lit(1).alias("side"))
    rows = held.unionByName(ask).join(labels, "id", "left").select("id", "group", "block", "turn", "side", F.coalesce("component", "id").alias("part"))
    rows = settled(rows)
    sets = full_sets(rows.select("id").distinct(), classes, docs, words)
    cell = ["group", "block", "turn"]
    dealt = rows.join(sets, "id").repartition(*cell).sortWithinPartitions(*cell, "side", "id")

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        for b in batches:
            found = []
            for *own, side, part, names in zip(*(b[c] for c in [*cell, "side", "part", "names"]), strict=True):
                if own != key:
                    key, parts, held, index, forest = own, [], [], None, Forest()
                names = np.frombuffer(names, np.uint64)
                if side == 0:
                    parts.append(part)
                    held.append(names)
                    continue
                if not held:
                    continue
                if index is None:
                    known, inverse = np.unique(np.concatenate(held), return_inverse=True)
                    sizes = np.array([len(h) for h in held])
                    index, held = (known, inverse, sizes, np.cumsum(sizes) - sizes), [True]
                    root = np.array(parts)
                mine = forest.root(part)
                if (root == mine).all():
                    continue
                known, inverse, sizes, starts = index
                place = np.minimum(np.searchsorted(known, names), len(known) - 1)
                shared = np.zeros(len(known), np.int32)
                shared[place[known[place] == names]] = 1
                both = np.add.reduceat(shared[inverse], starts)
                fit = np.flatnonzero((100 * both >= percent * (sizes + len(names) - both)) & (root != mine))
                for k in fit[np.unique(root[fit], return_index=True)[1]]:
                    if forest.join(part, parts[k]):
                        found.append((part, parts[k]))
                        root[(root == mine) | (root == root[k])] = mine = forest.root(part)
            yield pd.DataFrame(found, columns=["a", "b"])

    return dealt.select(*cell, "side", "part", "names").mapInPandas(hold, "a long, b long").distinct()


def outside_main(families: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, group): the classes of each family (id, group) that its largest component does not hold."""
    placed = families.join(labels.withColumnRenamed("component", "part"), "id", "left").select("id", "group", F.coalesce("part", "id").alias("part"))
    main = placed.groupBy("group", "part").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("part", "n").alias("main"))
    return placed.join(main, "group").where("part <> main").select("id", "group")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Links: shingle sets with similarity at least `similarity`. Texts without words link with
    nothing, equal sets always do. component_id is the least doc_id reachable; kept is
    doc_id = component_id, so rows that repeat a kept id are kept too. Null ids stay alone.
    Other columns of `docs` are not read. What must agree in a signature follows from `similarity`.
    """
    if not 0 < similarity <= 1:
        raise ValueError(f"similarity {similarity} is not above 0 and at most 1")
    percent = round(100 * similarity)
    posted, sketched = thresholds(similarity)
    rows = settled(document_sets(docs, words))
    whole = rows.where("n_shingles > 0 and doc_id is not null").groupBy("set_key", "n_shingles")
    classes = settled(whole.agg(F.min("doc_id").alias("class_id"), F.min("signature").alias("signature"), F.min("sketch").alias("sketch")))
    # Sets that can differ and still be similar: one name more or less must be within the limit.
    open_classes = classes.where((F.col("n_shingles") + 1) * percent <= F.col("n_shingles") * 100)
    posts = settled(postings(open_classes, posted))
    pairs = settled(retained(first_pairs(posts, open_classes.select("class_id", "n_shingles"), percent), open_classes, sketched))
    families = rooted(pairs)
    labels = rooted(settled(confirmed(pairs, open_classes, docs, words, percent)))
    families = united(families, family_merges(posts, open_classes, families, percent, sketched)).withColumnRenamed("component", "group")
    labels = united(labels, group_links(settled(outside_main(families, labels)), families, labels, open_classes, docs, words, percent))
    grouped = classes.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").select(
        "set_key", "n_shingles", F.coalesce("component", "class_id").alias("_component")
    )
    own = rows.select("doc_id", "n_shingles", "set_key").join(grouped, ["set_key", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("_component", "doc_id")).otherwise(F.col("doc_id"))
    out = own.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
