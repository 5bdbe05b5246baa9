"""Repeated substrings across documents by a distributed difference cover.

Every WINDOW-byte string that also starts in a document with a smaller id is found, and the
bytes such strings cover are removed. As in difference-cover suffix sorting, only positions
whose residue modulo 21 lies in the cover are named at first: of any two positions, some equal
shift of at most 20 brings both into the cover, so two equal windows always hold a sampled pair
with equal 27-byte names. Names are built by recursion on triples: names of 3 bytes make names
of 9, those of 27, and two of those the name of the whole window.

1. Sampled names go, sorted, to ranges of names; neighbours are compared, and each chunk of
   documents learns which of its names also stand in other chunks.
2. Only windows over such a name are named in full and sorted the same way, with the least
   document id of each name; each chunk learns which of its windows start in a smaller document.
3. Each chunk covers, counts and cuts its documents.

A full suffix order is not needed, since only prefixes of one length are compared. Names travel
as sorted, compressed arrays for each (chunk, range); answers come back as bits in the same
order. Texts are written once, bucketed by chunk, and are not shuffled. Exact copies of a text
are settled by its digest and take no part in step 2.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, remove, settled, shared_folder, table
from .hashing import distinct

WINDOW = 50
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
NAMED = 27
CHUNK_BYTES = 2 << 20
#: Bytes of text for each range of sampled names (a quarter of the positions) and of whole windows.
RANGE_BYTES, WINDOW_RANGE_BYTES = 16 << 20, 6 << 20
PIECE = PERIOD * 50_000
_LAST = (1 << 63) - 1
COPY, SAMPLED, WHOLE = 0, 1, 2

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _name(*parts: np.ndarray) -> np.ndarray:
    h = parts[0] * _A
    for p in parts[1:]:
        h ^= h >> np.uint64(29)
        h += p
        h *= _B
    h ^= h >> np.uint64(32)
    h *= _A
    h ^= h >> np.uint64(29)
    return h


def _names27(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.uint64)
    three = x[:-2] | (x[1:-1] << np.uint64(8)) | (x[2:] << np.uint64(16))
    nine = _name(three[:-6], three[3:-3], three[6:])
    return _name(nine[:-18], nine[9:-9], nine[18:])


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


_residues = np.arange(PIECE)
_SAMPLED = np.flatnonzero(np.isin(_residues % PERIOD, COVER))
del _residues


class Chunk:
    """The documents of one chunk and the sampled names of their texts."""

    def __init__(self, ids: Sequence[int], texts: Sequence[bytes], rows: Sequence[int] = ()):
        self.ids, self.texts, self.rows = np.asarray(ids, np.int64), texts, np.asarray(rows, np.int64)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        names, owner, at = [], [], []
        for d in range(len(texts)):
            for start in range(0, max(self.sizes[d] - NAMED + 1, 0), PIECE):
                n27 = self._named(d, start, PIECE)
                pick = _SAMPLED[: np.searchsorted(_SAMPLED, len(n27))]
                names.append(n27[pick])
                owner.append(np.full(len(pick), d, np.int32))
                at.append(pick + start)
        self.names, self.owner, self.at = _joined(names, np.uint64), _joined(owner, np.int32), _joined(at, np.int64)

    def _named(self, d: int, start: int, n: int) -> np.ndarray:
        """Names of 27 bytes at `n` positions of a text from `start` on, or as many as there are."""
        return _names27(np.frombuffer(self.texts[d], np.uint8)[start : start + n + NAMED - 1])

    def sampled_keys(self, ranges: int) -> np.ndarray:
        """(range, 32 bits within the range) of each sampled name; enough to filter, not to decide."""
        high = (self.names >> np.uint64(32)) * np.uint64(ranges)
        low = (self.names & np.uint64(0xFFFFFFFF)) * np.uint64(ranges) >> np.uint64(32)
        return high + low

    def copied(self, side: pd.DataFrame) -> np.ndarray:
        """Which rows hold the whole text of a document with a smaller id."""
        return np.isin(self.rows, side.loc[side["kind"] == COPY, "at"].to_numpy(np.int64))

    def candidates(self, ranges: int, side: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, position, name) of the windows over a name that stands in another document."""
        keys = self.sampled_keys(ranges)
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        if not len(keys):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        by = self.owner[order]
        several = np.minimum.reduceat(by, starts) != np.maximum.reduceat(by, starts)
        shared = several | _flags(side, SAMPLED, keys[starts] >> np.uint64(32))
        hot = np.zeros(len(keys), bool)
        hot[order] = np.repeat(shared, np.diff(starts, append=len(keys)))
        skip = self.copied(side)
        owner, at = self.owner[hot], self.at[hot]
        cuts = np.searchsorted(owner, np.arange(len(self.ids) + 1))
        docs, places, names = [], [], []
        for d in np.flatnonzero(np.diff(cuts)):
            n = self.sizes[d] - WINDOW + 1
            if skip[d] or n <= 0:
                continue
            s = at[cuts[d] : cuts[d + 1]]
            edge = np.bincount(np.clip(s - PERIOD + 1, 0, n), minlength=n + 1) - np.bincount(np.minimum(s + 1, n), minlength=n + 1)
            i = np.flatnonzero(np.cumsum(edge[:n]) > 0)
            for a in range(0, n, PIECE):  # names are made again, but for parts of texts that need them
                own = i[slice(*np.searchsorted(i, (a, a + PIECE)))]
                if not len(own):
                    continue
                n27 = self._named(d, a, PIECE + WINDOW - NAMED)
                docs.append(np.full(len(own), d, np.int32))
                places.append(own)
                names.append(_name(n27[own - a], n27[own - a + WINDOW - NAMED]))
        return _joined(docs, np.int32), _joined(places, np.int64), _joined(names, np.uint64)


def _packed(a: np.ndarray) -> bytes:
    """Byte planes, compressed: the planes of sorted differences and of ids are mostly alike."""
    import zstandard

    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def _least(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct names, the least id of each, and each name's place among them."""
    if not len(names):
        return names, ids, np.zeros(0, np.int64)
    order = np.argsort(names)
    ordered = names[order]
    new = np.diff(ordered, prepend=~ordered[:1]) != 0
    starts = np.flatnonzero(new)
    place = np.empty(len(names), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[starts], np.minimum.reduceat(ids[order], starts), place


def _range_of(names: np.ndarray, ranges: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


_BLOB = "range long, chunk long, names binary, ids binary"
_BITS = "chunk long, kind int, at long, bits binary"


def _blobs(chunk: int, where: np.ndarray, values: np.ndarray, ids: np.ndarray | None) -> pd.DataFrame:
    cuts = np.flatnonzero(np.diff(where, prepend=np.uint64(1 << 63)))
    ends = np.append(cuts[1:], len(where))[: len(cuts)]
    rows = [(int(where[a]), chunk, _packed(_steps(values[a:b])), _packed(ids[a:b]) if ids is not None else None) for a, b in zip(cuts, ends, strict=True)]
    return pd.DataFrame(rows, columns=["range", "chunk", "names", "ids"])


def _answers(kind: int):
    """For one range: which names of each chunk stand in another chunk (or there in a smaller document)."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        dtype = np.uint32 if kind == SAMPLED else np.uint64
        parts = [np.cumsum(_unpacked(b, dtype), dtype=dtype) for b in pdf["names"]]
        names = np.concatenate(parts)
        if kind == SAMPLED:
            order = np.argsort(names)
            equal = names[order][1:] == names[order][:-1]
            found = np.zeros(len(names), bool)
            found[order] = np.append(equal, False) | np.insert(equal, 0, False)
        else:
            ids = np.concatenate([_unpacked(b, np.int64) for b in pdf["ids"]])
            _, least, inverse = _least(names, ids)
            found = least[inverse] < ids
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        bits = [np.packbits(f).tobytes() for f in np.split(found, cuts)]
        return pd.DataFrame({"chunk": pdf["chunk"], "kind": kind, "at": pdf["range"], "bits": bits})

    return compare


def _flags(side: pd.DataFrame, kind: int, where: np.ndarray) -> np.ndarray:
    """The bits of all ranges, in the order of the sorted names; `where` is each name's range."""
    out = np.zeros(len(where), bool)
    rows = side[side["kind"] == kind]
    for at, bits in zip(rows["at"], rows["bits"], strict=True):
        a, b = np.searchsorted(where, np.uint64(at)), np.searchsorted(where, np.uint64(at), "right")
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    return out


def _windows(left: pd.DataFrame, side: pd.DataFrame, ranges: int) -> tuple[Chunk, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    chunk = Chunk(left["_id"].tolist(), left["_raw"].tolist(), left["_row"].tolist())
    return chunk, chunk.candidates(ranges, side)


def spans_of(covered: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs that windows starting at `covered` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, covered, 1)
    np.add.at(edge, covered + WINDOW, -1)
    inside = np.diff(np.cumsum(edge[:-1]) > 0, prepend=False, append=False)
    at = np.flatnonzero(inside)
    return at[::2], at[1::2]


def _whole_characters(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without the characters that they hold in part."""
    inner = (np.frombuffer(raw + b"\0", np.uint8) & 0xC0) == 0x80
    for at, step in ((starts, 1), (ends, -1)):
        while (move := inner[at]).any():
            at[move] += step
    fit = starts < ends
    return starts[fit], ends[fit]


def without_repeats(docs: DataFrame, keep: Sequence[str] = (), as_text: bool = False, result: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, *keep, repeats) of every row, or what `result` makes of it, settled.

    `repeats` holds n_bytes, starts, ends and kept: the bytes of the text, its repeated spans in bytes and what
    lies outside them. With `as_text` spans shrink to whole characters and `kept` is a string. Texts stand in a
    table in the shared checkpoint folder meanwhile, which goes in any case.

    A null text is empty. Texts shorter than the window have no spans. Rows that repeat an id are documents of
    their own that don't take from each other; null ids are one id that comes after all others. An empty table gives no rows.
    Columns to keep may have any names but `doc_id` and `repeats`. A text is read in one task, with some
    40 bytes for each byte of it that a repeated name covers.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    name = f"repeats_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    renamed = [f"_kept_{k}" for k in range(len(keep))]
    own_names = [F.col(c).alias(r) for c, r in zip(keep, renamed, strict=True)]
    rows = docs.select(F.col("doc_id").alias("_doc"), *own_names, F.coalesce("doc_id", F.lit(_LAST)).alias("_id"), raw.alias("_raw"))
    try:
        _write_chunks(rows, name, folder)
        found = _repeats(spark.table(name), as_text)
        struct = F.struct("n_bytes", "starts", "ends", "kept").alias("repeats")
        found = found.select(F.col("_doc").alias("doc_id"), *[F.col(r).alias(c) for c, r in zip(keep, renamed, strict=True)], struct)
        return settled(result(found) if result else found)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, folder)


def _write_chunks(rows: DataFrame, name: str, folder: str) -> None:
    """Save the rows, with the number of the chunk of each and its own in the task, as a table bucketed by chunk."""

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number, held, first = TaskContext.get().partitionId(), 0, 0, 0
        for b in batches:
            chunk = []
            for n in map(len, b["_raw"]):
                if held and held + n > CHUNK_BYTES:
                    number, held = number + 1, 0
                held += n
                chunk.append(task << 32 | number)
            yield b.assign(chunk=np.array(chunk, np.int64), _row=np.arange(first, first + len(b), dtype=np.int64))
            first += len(b)

    chunks = rows.mapInPandas(chunked, f"{_schema(rows)}, chunk long, _row long")
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks.write.bucketBy(buckets, "chunk").option("compression", "zstd").option("path", folder).saveAsTable(name)


def _schema(df: DataFrame, without: Sequence[str] = ()) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in without)


def _repeats(texts: DataFrame, as_text: bool) -> DataFrame:
    """The rows of the chunk table without _id, _raw and chunk, and n_bytes, starts, ends and kept."""
    own = texts.select("chunk", "_row", "_id", "_raw")
    total = texts.agg(F.sum(F.octet_length("_raw"))).first()[0] or 0
    ranges, window_ranges = (max(1, -(-total // size)) for size in (RANGE_BYTES, WINDOW_RANGE_BYTES))

    digests = own.where(F.octet_length("_raw") >= WINDOW).select("chunk", "_row", "_id", F.sha2("_raw", 256).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = digests.join(first, "digest").where("_id > first")
    copies = later.select("chunk", F.lit(COPY).alias("kind"), F.col("_row").alias("at"), F.lit(None).cast("binary").alias("bits"))

    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = distinct(Chunk(pdf["_id"].tolist(), pdf["_raw"].tolist()).sampled_keys(ranges))
        return _blobs(int(pdf["chunk"].iloc[0]), keys >> np.uint64(32), keys.astype(np.uint32), None)

    names = own.groupBy("chunk").applyInPandas(sample, _BLOB)
    side = settled(names.groupBy("range").applyInPandas(_answers(SAMPLED), _BITS).union(copies))

    def whole(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["range", "chunk", "names", "ids"])
        chunk, (owner, _, found) = _windows(left, right, ranges)
        names, least, _ = _least(found, chunk.ids[owner])
        return _blobs(int(left["chunk"].iloc[0]), _range_of(names, window_ranges), names, least)

    windows = own.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInPandas(whole, _BLOB)
    side = settled(side.union(windows.groupBy("range").applyInPandas(_answers(WHOLE), _BITS)))
    passed = [c for c in texts.columns if c not in ("_id", "_raw", "_row", "chunk")]
    columns = [*passed, "n_bytes", "starts", "ends", "kept"]

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=columns)
        chunk, (owner, at, found) = _windows(left, right, ranges)
        copied = chunk.copied(right)
        names, least, inverse = _least(found, chunk.ids[owner])
        smaller = _flags(right, WHOLE, _range_of(names, window_ranges))
        repeated = smaller[inverse] | (chunk.ids[owner] > least[inverse])
        owner, at = owner[repeated], at[repeated]
        cuts = np.searchsorted(owner, np.arange(len(chunk.ids) + 1))
        starts, ends, kept = [], [], []
        for d, text in enumerate(left["_raw"]):
            if copied[d]:
                a, b = np.array([0]), np.array([len(text)])
            else:
                a, b = spans_of(at[cuts[d] : cuts[d + 1]], len(text))
            if as_text:
                a, b = _whole_characters(text, a, b)
            left_over = b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True)) if len(a) else text
            starts.append(a)
            ends.append(b)
            kept.append(left_over.decode("utf-8", "replace") if as_text else left_over)
        return left.assign(n_bytes=chunk.sizes, starts=starts, ends=ends, kept=kept)[columns]

    schema = f"{_schema(texts, ('_id', '_raw', '_row', 'chunk'))}, n_bytes long, starts array<long>, ends array<long>, kept {'string' if as_text else 'binary'}"
    return texts.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInPandas(cut, schema)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(found: DataFrame) -> DataFrame:
        r = found.select("doc_id", "repeats.*")
        removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed")
        return r.select("doc_id", "n_bytes", removed, F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

    return without_repeats(table(spark, sf_dir, "documents"), result=digest)
