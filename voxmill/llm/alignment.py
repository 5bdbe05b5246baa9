"""Alignment of two tokenizers over the same bytes, by sparse products of token-byte incidence matrices.

Row i of the matrix of a tokenization holds the bytes of token i. The product of one matrix with the
other's transpose has an entry for each pair of tokens that share bytes: the overlap links, weighted
by shared bytes. Places where tokens of both end cut the tokens into groups, and the product of the
token-group matrices links all tokens of a group.

Documents are tokenized once. Each chunk of them passes the distinct id pairs it links, with document
counts, to ranges of first ids; chunks are summed in two steps, and each gets the counts of its own
pairs back. So what is shuffled are packed arrays, at most one for each chunk and range.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, remove, shared_folder, settled, table
from .packing import Encoder
from .substrings import _packed, _steps, _unpacked

#: Bytes of text in a chunk, ranges of first ids, chunks that are summed together at first, rows of a product made at once.
CHUNK_BYTES, RANGES, SUMMED, BLOCK_ROWS = 8 << 20, 64, 256, 1 << 17
_SECOND = 16  # bits of a second id in a pair's name
_GOOD_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Rows:
    """A 0-1 matrix by compressed rows: the columns of row i are columns[starts[i]:starts[i + 1]], ascending."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, width: int):
        self.starts, self.columns, self.width = starts, columns, width

    @staticmethod
    def of_runs(lengths: np.ndarray) -> Rows:
        """Token i holds the `lengths[i]` columns after those of the tokens before it."""
        starts = np.concatenate([[0], np.cumsum(lengths)])
        return Rows(starts, np.arange(starts[-1]), int(starts[-1]))

    @staticmethod
    def of_owners(owner: np.ndarray, width: int) -> Rows:
        """Row i holds the one column `owner[i]`."""
        return Rows(np.arange(len(owner) + 1), owner, width)

    def transposed(self) -> Rows:
        if len(self.columns) == self.width and (self.columns[1:] > self.columns[:-1]).all():  # each column once, in order
            return Rows(np.arange(self.width + 1), np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), len(self.starts) - 1)
        order = np.argsort(self.columns, kind="stable")
        row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        return Rows(np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))]), row[order], len(self.starts) - 1)


def product(a: Rows, b: Rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column and value of the entries of a·b that aren't zero, block by block of rows, each row's columns ascending.

    Gustavson's order: row i of the product is the sum of the rows of b that row i of a names.
    """
    n, sizes = len(a.starts) - 1, np.diff(b.starts)
    single = bool((sizes == 1).all())
    work = a.starts if single else np.concatenate([[0], np.cumsum(sizes[a.columns])])[a.starts]  # entries of b named before each row
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(work, work[first] + BLOCK_ROWS, "right")) - 1)
        own = a.columns[a.starts[first] : a.starts[last]]
        row = np.repeat(np.arange(first, last), np.diff(a.starts[first : last + 1]))
        if single:
            column = b.columns[own]
        else:
            size = sizes[own]
            row = np.repeat(row, size)
            column = b.columns[np.arange(size.sum()) + np.repeat(b.starts[own] - np.cumsum(size) + size, size)]
        key = row * max(b.width, 1) + column
        if (np.diff(key) < 0).any():
            key = np.sort(key)
        at = np.flatnonzero(np.diff(key, prepend=-1))
        row, column = np.divmod(key[at], max(b.width, 1))
        yield row, column, np.diff(at, append=len(key))
        first = last


def overlap_links(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (token of a, token of b, shared bytes) from the tokens' lengths in bytes over the same text."""
    return product(Rows.of_runs(a), Rows.of_runs(b).transposed())


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token: groups end where tokens of both end."""
    ends = np.cumsum(a), np.cumsum(b)
    total = int(ends[0][-1]) if len(a) else 0
    out = []
    for own, other in (ends, ends[::-1]):
        closes = np.zeros(total + 1, bool)
        closes[other] = True
        closes = closes[own]
        out.append(np.cumsum(closes) - closes)
    return out[0], out[1]


def group_links(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (token of a, token of b) in the same group."""
    of_a, of_b = groups(a, b)
    width = int(of_a[-1]) + 1 if len(of_a) else 0
    for i, j, _ in product(Rows.of_owners(of_a, width), Rows.of_owners(of_b, width).transposed()):
        yield i, j


#: Decimal digits of ids below 65,536, to the right, before a place for the mark after them; and which places show.
_IDS = np.arange(1 << 16)[:, None]
_POWERS = 10 ** np.arange(4, -1, -1)
_TEXT = np.concatenate([_IDS // _POWERS % 10 + ord("0"), np.zeros_like(_IDS)], axis=1).astype(np.uint8)
_SHOWN = np.concatenate([_IDS >= np.append(_POWERS[:-1], 0), np.ones_like(_IDS, bool)], axis=1)
_SHOWN[:, 4] = True
del _IDS


def written_groups(ids_a: np.ndarray, ids_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group in order; ids are below 65,536."""
    n = len(ids_a) + len(ids_b)
    if not n:
        return b""
    before_a = np.concatenate([[0], np.cumsum(np.bincount(of_a))])
    before_b = np.concatenate([[0], np.cumsum(np.bincount(of_b))])
    place = np.concatenate([np.arange(len(ids_a)) + before_b[of_a], np.arange(len(ids_b)) + before_a[of_b + 1]])
    mark = np.full(n, ord(","), np.uint8)
    mark[before_a[1:] - 1] = ord("|")
    mark[len(ids_a) + before_b[1:] - 1] = ord(";")
    ids, after = np.empty(n, np.int64), np.empty(n, np.uint8)
    ids[place], after[place] = np.concatenate([ids_a, ids_b]), mark
    text = _TEXT[ids]
    text[:, 5] = after
    return text[_SHOWN[ids]].tobytes()[:-1]


class ByteLevel:
    """Ids of texts by a byte-level tokenizer file, and the bytes of its ids. Special tokens' strings are plain text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.encoder.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # Visible bytes stand for themselves, the others for the characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.pieces = [b""] * (self.encoder.tokenizer.get_vocab_size() + 1)
        for token, i in vocab.items():
            self.pieces[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        for ids in self.encoder(texts):
            yield ids.astype(np.int64)


class Pieces:
    """Ids of texts by a sentence-piece model that puts a space before a text, and the bytes of its ids.

    Where no piece holds a space after another character and texts pass unchanged, words and the spaces
    before them are encoded apart, each once.
    """

    #: Words that are held in a worker, and bytes of text whose words are looked up together.
    HELD, SLICE = 600_000, 1 << 20

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(m[1], 16)]) if self.model.is_byte(i) and (m := _GOOD_BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        probe = "  ａ é  b"
        self.apart = not any(re.search("[^▁]▁", p) for p in names) and self._bytes(self.model.encode(probe)) == (" " + probe).encode()
        self._clear()

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.exact = np.zeros(0, np.uint16), np.zeros(1, np.int64), np.zeros(0, bool)

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """The ids of each text, and whether their bytes are those of a space and the text."""
        at, held = 0, 0
        for k, text in enumerate(texts):
            held += len(text)
            if held >= self.SLICE or k == len(texts) - 1:
                yield from self._slice(texts[at : k + 1])
                at, held = k + 1, 0

    def _slice(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        # Words with the one space before them; texts with other spaces are encoded whole.
        split = [t.split(" ") if self.apart and "  " not in t and "▁" not in t and t[-1:] != " " and t[:1] != " " else None for t in texts]
        if len(self.place) > self.HELD:
            self._clear()
        new = list(dict.fromkeys(w for words in split if words for w in words if w not in self.place))
        if new:
            got = self.model.encode(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(g) for g in got])])
            self.ids = np.concatenate([self.ids, np.array([i for g in got for i in g], np.uint16)])
            self.exact = np.concatenate([self.exact, np.array([self._bytes(g) == (" " + w).encode("utf-8", "surrogatepass") for g, w in zip(got, new, strict=True)])])
        for text, words in zip(texts, split, strict=True):
            if words is None:
                ids = self.model.encode(text)
                yield np.array(ids, np.int64), self._bytes(ids) == b" " + text.encode("utf-8", "surrogatepass")
                continue
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            size = self.starts[at + 1] - self.starts[at]
            yield self.ids[np.arange(size.sum()) + np.repeat(self.starts[at] - np.cumsum(size) + size, size)].astype(np.int64), bool(self.exact[at].all())


@functools.lru_cache(2)
def _sides(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces, np.ndarray, np.ndarray]:
    a, b = ByteLevel(path_a), Pieces(path_b)
    return a, b, np.array([len(p) for p in a.pieces]), np.array([len(p) for p in b.pieces])


def aligned(texts: Sequence[str | None], path_a: str, path_b: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of both tokenizations of each text, after a space, and the tokens' lengths in bytes; none where the bytes differ from the text's."""
    a, b, size_a, size_b = _sides(path_a, path_b)
    none = np.zeros(0, np.int64)
    own = [t for t in texts if t]
    pairs = zip(own, a([" " + t for t in own]), b(own), strict=True)
    for t in texts:
        if not t:
            yield none, none, none, none
            continue
        text, ids_a, (ids_b, same) = next(pairs)
        same = same and b"".join(map(a.pieces.__getitem__, ids_a.tolist())) == b" " + text.encode("utf-8", "surrogatepass")
        yield (ids_a, ids_b, size_a[ids_a], size_b[ids_b]) if same else (none, none, none, none)


_DOC = "doc_id long, chunk long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, pairs binary, times binary"
_PART = "chunk long, range int, pairs binary, counts binary"


def _token_rows(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document, with its distinct linked id pairs and how often each is linked, and (doc_id null, n_a the range) one for each chunk and range with document counts."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number, held, seen = TaskContext.get().partitionId(), 0, 0, []

        def part(chunk: int) -> list[tuple]:
            names, counts = np.unique(np.concatenate(seen), return_counts=True)
            where = (names >> _SECOND) % RANGES
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(RANGES + 1))
            seen.clear()
            return [(True, None, chunk, k, 0, 0, 0, 0, "", _packed(_steps(names[order[x:y]])), _packed(counts[order[x:y]].astype(np.int64))) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y]

        columns = ["part", *[c.split()[0] for c in _DOC.split(", ")]]
        for b in batches:
            out = []
            for doc_id, text, (ids_a, ids_b, size_a, size_b) in zip(b["doc_id"], b["text"], aligned(b["text"].where(b["text"].notna(), None).tolist(), path_a, path_b), strict=True):
                n = len(text.encode("utf-8", "surrogatepass")) if isinstance(text, str) else 0
                if held and held + n > CHUNK_BYTES:
                    out += part(task << 32 | number) if seen else []
                    number, held = number + 1, 0
                held += n
                of_a, of_b = groups(size_a, size_b)
                linked = [(ids_a[i] << _SECOND) | ids_b[j] for i, j, _ in overlap_links(size_a, size_b)]
                names, times = np.unique(np.concatenate(linked), return_counts=True) if linked else (np.zeros(0, np.int64),) * 2
                if len(names):
                    seen.append(names)
                n_groups = int(of_a[-1]) + 1 if len(of_a) else 0
                within = int((np.bincount(of_a, minlength=n_groups) * np.bincount(of_b, minlength=n_groups)).sum()) if n_groups else 0
                digest = sha256(written_groups(ids_a, ids_b, of_a, of_b)).hexdigest() if n_groups else ""
                out.append((False, doc_id, task << 32 | number, len(ids_a), len(ids_b), n_groups, int(times.sum()), within, digest, _packed(_steps(names)), _packed(times)))
            yield pd.DataFrame(out, columns=columns)
        if seen:
            yield pd.DataFrame(part(task << 32 | number), columns=columns)

    return docs.select("doc_id", "text").mapInPandas(rows, "part boolean, " + _DOC)


def _summed(pairs: Sequence[bytes], counts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    names = np.concatenate([np.cumsum(_unpacked(p, np.int64)) for p in pairs])
    order = np.argsort(names, kind="stable")
    at = np.flatnonzero(np.diff(names[order], prepend=-1))
    return names[order][at], np.add.reduceat(np.concatenate([_unpacked(c, np.int64) for c in counts])[order], at)


def _with_best(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each pair's count, negative where it is the highest of its first id."""
    first = names >> _SECOND
    at = np.flatnonzero(np.diff(first, prepend=-1))
    top = np.repeat(np.maximum.reduceat(counts, at), np.diff(at, append=len(names)))
    return np.where(counts == top, -counts, counts)


def cross_tokenizer_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links) of every row of `docs`.

    Links are pairs of token occurrences that share bytes; a pair of ids counts the documents that hold it linked;
    n_best are the links whose count is the highest of their first id, count_sum is the sum of counts over links,
    n_group_links the pairs of tokens in the same group. A text that is null, empty, or not given back by both
    tokenizers has no tokens. Rows that repeat an id are documents of their own; ids may be null. A text is
    tokenized in one task. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark, 4 << 20)
    folder, name = f"{shared_folder(spark)}/links-{uuid.uuid4().hex}", f"links_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        _token_rows(docs, path_a, path_b).write.bucketBy(buckets, "chunk").option("compression", "zstd").option("path", folder).saveAsTable(name)
        stored = spark.table(name)
        parts = stored.where("part").select("chunk", F.col("n_a").cast("int").alias("range"), "pairs", F.col("times").alias("counts"))
        chunks = parts.agg(F.approx_count_distinct("chunk")).first()[0]
        salted = parts.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(-(-max(chunks, 1) // SUMMED))).cast("int"))

        def add(kind: str):
            def summed(pdf: pd.DataFrame) -> pd.DataFrame:
                names, counts = _summed(pdf["pairs"], pdf["counts"])
                counts = _with_best(names, counts) if kind == "total" else counts
                return pd.DataFrame({"range": [pdf["range"].iloc[0]], "salt": [pdf["salt"].iloc[0]], "pairs": [_packed(_steps(names))], "counts": [_packed(counts)]})

            return summed

        schema = "range int, salt int, pairs binary, counts binary"
        partial = settled(salted.groupBy("range", "salt").applyInPandas(add("part"), schema))
        totals = partial.groupBy("range").applyInPandas(add("total"), schema).select("range", F.col("pairs").alias("all_pairs"), F.col("counts").alias("all_counts"))
        wanted = partial.select("range", "salt").join(totals, "range")

        def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame(columns=["chunk", "range", "pairs", "counts"])
            names, counts = np.cumsum(_unpacked(right["all_pairs"].iloc[0], np.int64)), _unpacked(right["all_counts"].iloc[0], np.int64)
            found = [_packed(counts[np.searchsorted(names, np.cumsum(_unpacked(p, np.int64)))]) for p in left["pairs"]]
            return left[["chunk", "range", "pairs"]].assign(counts=found)

        answers = settled(salted.groupBy("range", "salt").cogroup(wanted.groupBy("range", "salt")).applyInPandas(answer, _PART))
        keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_group_links"]

        def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame(columns=[*keep, "n_best", "count_sum"])
            names = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(_unpacked(p, np.int64)) for p in right["pairs"]]])
            counts = np.concatenate([np.zeros(0, np.int64), *[_unpacked(c, np.int64) for c in right["counts"]]])
            order = np.argsort(names)
            names, counts = names[order], counts[order]
            best, total = [], []
            for p, t in zip(left["pairs"], left["times"], strict=True):
                got, times = counts[np.searchsorted(names, np.cumsum(_unpacked(p, np.int64)))], _unpacked(t, np.int64)
                best.append(int(times[got < 0].sum()))
                total.append(int((times * np.abs(got)).sum()))
            return left[keep].assign(n_best=best, count_sum=total)

        own = stored.where("NOT part").select("chunk", *keep, "pairs", "times")
        schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in [*keep, "n_best", "count_sum"])
        return settled(own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(scored, schema))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, folder)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return cross_tokenizer_links(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
