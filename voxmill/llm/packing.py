"""Packing documents into sequences: length patterns by non-negative least squares, then best fit.

Only the histogram of piece lengths (at most `capacity` numbers) reaches the driver. It fits
repeat counts of few-piece patterns to the histogram, and packs what rounding leaves over by
best fit. Pieces of one length are interchangeable, so the plan is a bounded table of
(length, first rank) -> (sequence, offset), and every piece finds its place by its rank.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, running_totals, settled, table
from .hashing import mixed

CAPACITY = 1024
END_ID = 2
SLICE_BYTES = 1 << 20
KEY, ROW, SLOTS = 24, 12, 19  # bytes of a key, ids of a cached unit, bits of the cache's size: 26 MB in a worker
#: A space before a visible character always starts a new pre-token of byte-level BPE; other
#: shapes of white space next to a space do not, so texts with those are encoded whole.
_ODD_SPACES = re.compile(r" \s| $|<\|")
_GAP, _LETTER, _DIGIT, _MARK, _WHITE, _HIGH = range(6)
_KIND = np.full(256, _HIGH, np.uint8)
_KIND[33:127] = _MARK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[9:14] = _WHITE
_KIND[[32, 255]] = _GAP


def units(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of parts of texts that can be encoded apart, and whether a part is one pre-token; texts stand between bytes of 255.

    Byte-level BPE never merges over a space, nor from letters to digits, marks or a white character and
    back. What isn't ASCII or a Latin-1 letter stays with its neighbours, and so does a letter after an
    apostrophe and what follows several white characters.
    """
    kind = _KIND[raw]
    lead = np.flatnonzero(raw == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    left, right = kind[:-1], kind[1:]
    cut = (left != right) & (left != _HIGH) & (right != _HIGH) & ~((raw[:-1] == 39) & (right == _LETTER))
    cut[1:] &= ~((left[:-1] == _WHITE) & (left[1:] == _WHITE))
    cut |= (left == _GAP) != (right == _GAP)
    edge = np.flatnonzero(cut) + 1
    own = kind[edge[:-1]] != _GAP
    start, end = edge[:-1][own], edge[1:][own]
    most = np.maximum.reduceat(kind, start) if len(start) else kind[start]
    return start, end, (most == kind[start]) & (most == kind[end - 1]) & (most != _HIGH)


def _pair_merges(path: str):
    """The same byte-pair merges as an encoder of single pre-tokens, or None where its rule (the least id first) isn't the file's."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in pairs]
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and spec["normalizer"] is None
    plain = plain and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if not plain or any(x >= y for x, y in itertools.pairwise(made)):
        return None
    # Visible bytes stand for themselves, the others for the characters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("pairs", pat_str=r"[^\x00]+|\x00", mergeable_ranks=ranks, special_tokens={})


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


class Encoder:
    """Token ids of texts. Units seen before come from a table with one place for each slot of their bytes' hash."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pairs = _pair_merges(path)
        self.keys = np.zeros((1 << SLOTS, KEY // 8), np.uint64)
        self.ids = np.zeros((1 << SLOTS, ROW), np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.size = np.zeros(1 << SLOTS, np.uint8)

    def _encoded(self, texts: list[str], single: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids laid end to end and where those of each text begin and end; `single`: each is one pre-token."""
        if single and self.pairs and texts:
            ids = np.array(self.pairs.encode_ordinary("\0".join(texts)), np.uint32)
            gaps = np.flatnonzero(ids == self.pairs.encode_single_token("\0"))
            return np.delete(ids, gaps), np.concatenate([[0], gaps - np.arange(len(gaps)), [len(ids) - len(gaps)]])
        got = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, np.uint32), np.searchsorted(got.word_ids, np.arange(len(texts) + 1))

    def _learned(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, spaced: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of new units, laid end to end, and where those of each begin and how many they are."""
        texts = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip((starts - spaced).tolist(), ends.tolist(), strict=True)]
        place = dict.fromkeys(itertools.compress(texts, single.tolist()))
        others = dict.fromkeys(itertools.compress(texts, (~single).tolist()))
        (ids, cuts), (more, ends) = self._encoded(list(place), True), self._encoded(list(others), False)
        at = dict(zip(itertools.chain(place, others), itertools.count()))  # noqa: B905
        at = np.array([at[t] for t in texts])
        first = np.concatenate([cuts[:-1], ends[:-1] + len(ids)])
        return np.concatenate([ids, more]), first[at], np.concatenate([np.diff(cuts), np.diff(ends)])[at]

    def _slice(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b"\xff" + b"\xff".join(texts) + b"\xff"
        raw = np.frombuffer(joined, np.uint8)
        start, end, single = units(raw)
        spaced, n = raw[start - 1] == 32, end - start
        held = raw[np.minimum(start[:, None] + np.arange(KEY), len(raw) - 1)]
        held[np.arange(KEY) >= n[:, None]] = 0
        fits = n < KEY
        held[:, -1] = np.where(fits, n, 0) | spaced.astype(np.uint8) << 7
        key = held.view(np.uint64)
        slot = (mixed(key[:, 0] + mixed(key[:, 1] + mixed(key[:, 2]))) >> np.uint64(64 - SLOTS)).astype(np.int64)
        hit = fits & (self.keys[slot] == key).all(1)
        new = np.flatnonzero(~hit)
        size = self.size[slot].astype(np.int64)
        if len(new):
            learned, first, size[new] = self._learned(joined, start[new], end[new], spaced[new], single[new])
        out = np.empty(size.sum(), "<u4")
        known = np.repeat(hit, size)
        rows, have = self.ids[slot[hit]], size[hit]
        out[known] = rows[np.arange(ROW) < have[:, None]]
        if len(new):
            out[~known] = learned[_ragged(first, size[new])]
            keep = np.flatnonzero(fits[new] & (size[new] <= ROW))
            to, which = np.unique(slot[new[keep]], return_index=True)
            which = keep[which]
            self.keys[to], self.size[to] = key[new[which]], size[new[which]]
            self.ids[to] = np.where(np.arange(ROW) < size[new[which]][:, None], learned[np.minimum(first[which][:, None] + np.arange(ROW), len(learned) - 1)], 0)
        bounds = np.cumsum([1, *[len(t) + 1 for t in texts]])
        cuts = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, bounds)]
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        held, nbytes = [], 0
        for text in texts:
            if _ODD_SPACES.search(text):
                if held:
                    yield from self._slice(held)
                    held, nbytes = [], 0
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
                continue
            held.append(text.encode("utf-8", "surrogatepass"))
            nbytes += len(held[-1])
            if nbytes > SLICE_BYTES:
                yield from self._slice(held)
                held, nbytes = [], 0
        if held:
            yield from self._slice(held)


@functools.lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and `end_id`, cut.

    Only longer documents are cut; every piece but the first is full. A null or empty text is
    the end id alone. Repeated rows give repeated pieces; `ids` are little-endian 32-bit bytes.
    """
    bound_batches(docs.sparkSession, 4 << 20)
    step, end = 4 * capacity, np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer_path)
        for b in batches:
            rows = []
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for doc_id, ids in zip(b["doc_id"], encode(texts), strict=True):
                ids = ids.tobytes() + end
                first = len(ids) % step or step
                for piece, to in enumerate(range(first, len(ids) + 1, step)):
                    own = ids[max(0, to - step) if piece else 0 : to]
                    rows.append((doc_id, piece, (to - len(own)) // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else b""))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            yield out if keep_ids else out.drop(columns="ids")

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInPandas(cut, schema)


@dataclass(frozen=True)
class Plan:
    """Row i: pieces of `length` with ranks first .. first+count-1 go to sequence, sequence+1, ..., at `offset`."""

    length: np.ndarray
    first: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def _patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one to three of the present lengths that fill the capacity; 0 pads."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    a = present[:, None]
    b = present[None, :]
    c = capacity - a - b
    three = (a <= b) & (b <= c) & have[np.clip(c, 0, capacity)] & (c > 0)
    i, j = np.nonzero(three)
    triples = np.column_stack([present[i], present[j], capacity - present[i] - present[j]])
    low = present[(present <= capacity - present) & have[np.clip(capacity - present, 0, capacity)] & (present < capacity)]
    pairs = np.column_stack([low, capacity - low, np.zeros_like(low)])
    single = np.array([[capacity, 0, 0]] if have[capacity] else np.zeros((0, 3)), np.int64).reshape(-1, 3)
    return np.concatenate([single, pairs, triples])


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares |A x - h|^2 by accelerated projected gradient; A stays a list of lengths.

    It ends when fifty rounds lower the residual by less than a thousandth of it.
    """
    m, n = len(patterns), len(histogram)
    if not m:
        return np.zeros(0)
    flat = patterns.ravel()

    def down(x):  # A x
        h = np.bincount(flat, np.repeat(x, 3), n)
        h[0] = 0
        return h

    def up(r):  # A' r
        r = r.copy()
        r[0] = 0
        return r[flat].reshape(m, 3).sum(1)

    v = np.ones(m)
    for _ in range(20):
        v = up(down(v))
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(m)
    t, last = 1.0, np.inf
    for k in range(rounds):
        nxt = np.maximum(y - up(down(y) - histogram) / (1.05 * size), 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
        if k % 50 == 49:
            residual = np.linalg.norm(down(x) - histogram)
            if residual > 0.999 * last:
                break
            last = residual
    return x


class _Filling:
    """A plan in the making: what is left of each length, and the rows placed."""

    def __init__(self, histogram: np.ndarray, capacity: int):
        self.left = histogram.astype(np.int64).copy()
        self.left[0] = 0
        self.used = np.zeros_like(self.left)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences, self.capacity = 0, capacity

    def place(self, lengths: list[int], n: int) -> None:
        offset = 0
        for size in lengths:
            self.rows.append((size, int(self.used[size]), n, self.sequences, offset))
            self.used[size] += n
            self.left[size] -= n
            offset += size
        self.sequences += n

    def fit(self, patterns: np.ndarray) -> None:
        """Place the rounded repeats of `patterns` that fit what is left."""
        patterns = patterns[((patterns == 0) | (self.left[patterns] > 0)).all(1)]
        repeats = np.floor(fit_repeats(patterns, self.left.astype(float)) + 1e-6).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            if repeats[k] < 1:
                break
            lengths = [int(size) for size in patterns[k] if size]
            need = {size: lengths.count(size) for size in lengths}
            if n := min(int(repeats[k]), *(int(self.left[size]) // c for size, c in need.items())):
                self.place(lengths, n)

    def best_fit(self) -> None:
        """Place all that is left, longest first, over groups of equal bins: room -> [(bins, lengths)]."""
        todos = self.left.copy()
        room: dict[int, list[tuple[int, list[int]]]] = {self.capacity: []}
        for size in range(self.capacity, 0, -1):
            todo = int(todos[size])
            while todo:
                fits = [r for r, groups in room.items() if r >= size and groups]
                if fits:
                    r = min(fits)
                    bins, held = room[r].pop()
                else:
                    r, bins, held = self.capacity, todo, []
                each = min(r // size, todo)
                full = min(bins, todo // each)
                if bins > full and held:
                    room[r].append((bins - full, held))
                room.setdefault(r - each * size, []).append((full, held + [size] * each))
                todo -= full * each
        for groups in room.values():
            for bins, held in groups:
                if held:
                    self.place(held, bins)


def make_plan(histogram: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """histogram[l]: pieces of length l. Its size is all that matters, not the number of pieces.

    Of three roundings of the fit the one with the fewest sequences stays: patterns around a piece of more
    than half the capacity (each needs a sequence anyway), then all others too, or no repeats but best fit.
    """
    patterns = _patterns(np.flatnonzero(histogram * (np.arange(len(histogram)) > 0)), capacity)
    large = 2 * patterns.max(1, initial=0) >= capacity
    best = None
    for stages in ((patterns[large], patterns[~large]), (patterns[large],), ()):
        filling = _Filling(histogram, capacity)
        for chosen in stages:
            filling.fit(chosen)
        filling.best_fit()
        if best is None or filling.sequences < best.sequences:
            best = filling
    return Plan(*(np.array(c, np.int64) for c in (zip(*best.rows, strict=True) if best.rows else [[]] * 5)), best.sequences)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece `sequence_id` and `offset`; offsets of a sequence are gapless from 0.

    `pieces` needs doc_id, piece and length (1 to capacity); other columns pass through. It is
    read twice, so settle it before. An empty table gives no rows.
    """
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[r["length"]] = r["count"]
    plan = make_plan(histogram, capacity)
    order = np.lexsort((plan.first, plan.length))
    length, first, sequence, offset = (a[order] for a in (plan.length, plan.first, plan.sequence, plan.offset))
    starts = np.searchsorted(length, np.arange(capacity + 2))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.zeros(len(b), np.int64)
            for size, rows in b.groupby("length", sort=False).indices.items():
                low, high = starts[size], starts[size + 1]
                at[rows] = low + np.searchsorted(first[low:high], b["_n_before"].to_numpy()[rows], "right") - 1
            yield b.drop(columns=["_n", "_n_before"]).assign(sequence_id=sequence[at] + b["_n_before"] - first[at], offset=offset[at])

    ranked = running_totals(pieces.withColumn("_n", F.lit(1)), ["length"], ["doc_id", "piece"], ["_n"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInPandas(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack `docs`; with `keep_ids` each row carries its ids."""
    return pack_pieces(settled(token_pieces(docs, tokenizer_path, capacity, end_id, keep_ids)), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer(), keep_ids=False)
