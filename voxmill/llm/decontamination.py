"""Benchmark passages in documents: latent semantic retrieval, then subsequence and answer checks.

Passages of PASSAGE words are rows of a TF-IDF matrix whose columns are the benchmark's words
(no other word can add to a product with a benchmark item). Its leading right singular vectors
come from a randomised single-pass decomposition: executors add up A'(A W) for a fixed random
W over all passages, and the driver factors that bounded matrix. Windows of three lengths and
the items are projected and held against each other by cosine;
what is close enough is decided on the words: the longest common subsequence of item and
region, and for middling ones whether the item's answer, its closing words, is there too.
The cosine is a loose gate; a bound on the subsequence from counts of words keeps the checks few.
Items of a few words have no say in a cosine; they are sought by their exact sequence of words. Long
items are cut into pieces: stretches of a text that hold windows close to enough of an item's pieces are checked.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table
from .hashing import distinct, word_names

PASSAGE = 32
RANK, EXTRA = 64, 8
MAX_COLUMNS = 1 << 16
BLOCK = 8  # words; windows are whole blocks
WINDOWS = (16, 32, 64)  # words; an item is sought in windows of about its length
COSINE = 0.3
SURE, LIKELY, ANSWER = 0.8, 0.6, 0.75
MIN_WORDS = 5
LONG = 128  # words; items beyond are sought by pieces of the longest window
PIECES = 0.25  # share of an item's pieces that a stretch must hold something close to
#: Words in more than this share of the passages have no column, unless they are among the rarest of an item.
COMMON_SHARE, RAREST = 0.1, 5
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20  # items held by a task at once, and their text; more are searched in turns
GROUP = 128  # items held against a slice at once
CHECKED = 1 << 16  # candidates checked at once
SLICE_BYTES = 1 << 20
#: Sections of a longer text overlap by so many bytes for each byte of the longest item, and by as many more.
OVERLAP, OVERLAP_BYTES = 3, 4096

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and places of the words of lower-cased UTF-8: runs of 0-9, a-z and what isn't ASCII.

    General and ideographic punctuation parts words. Scripts without spaces (U+3000 to U+9FFF, Thai, Lao) have a word for each character.
    """
    lead = np.flatnonzero((raw >= 0xE0) & (raw <= 0xEF))
    if not len(lead):
        return word_names(raw, _IN_WORD)
    first, second = raw[lead], raw[np.minimum(lead + 1, len(raw) - 1)]
    mark = ((first == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((first == 0xE3) & (second == 0x80)) | ((first == 0xEF) & (second >= 0xBC))
    alone = ((first >= 0xE3) & (first <= 0xE9)) | ((first == 0xE0) & (second >= 0xB8) & (second <= 0xBB))
    return word_names(raw, _IN_WORD, lead[mark], lead[alone & ~mark])


@dataclass
class Slice:
    """The words of some whole documents or sections: names, document of each word, and word bounds of each document."""

    ids: list
    names: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray
    whole: np.ndarray  # whether a document stands here as a whole

    def blocks(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Block number of each word and first block of each document (and the total)."""
        sizes = -(-np.diff(self.bounds) // words)
        first = np.concatenate([[0], np.cumsum(sizes)])
        return first[self.doc] + (np.arange(len(self.names)) - self.bounds[self.doc]) // words, first


def sections(text: bytes, overlap: int) -> Iterator[bytes]:
    """A text in parts that begin and end at white space where there is some, each with the last `overlap` bytes of the one before.

    A part has at most SLICE_BYTES, or four overlaps where those are more.
    """
    at, most = 0, max(SLICE_BYTES, 4 * overlap)
    while len(text) - at > most:
        end = text.rfind(b" ", at + most // 2, at + most)
        end = end if end > 0 else at + most
        yield text[at:end]
        back = text.find(b" ", max(at + 1, end - overlap), end)
        at = back if overlap and back > 0 else end
    yield text[at:]


def sliced(batches: Iterator[pd.DataFrame], overlap: int = 0) -> Iterator[Slice]:
    def made(ids, texts, whole):
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
        names, at = words_of(np.frombuffer(b"\n".join(texts), np.uint8))
        doc = np.searchsorted(starts, at, "right") - 1
        return Slice(ids, names, doc, np.searchsorted(doc, np.arange(len(texts) + 1)), np.array(whole))

    ids, texts, whole, held = [], [], [], 0
    for b in batches:
        for i, t in zip(b["doc_id"], b["text"], strict=True):
            if isinstance(t, str) and t:
                raw = t.lower().encode("utf-8", "surrogatepass")
                for part in sections(raw, overlap):
                    ids.append(i)
                    texts.append(part)
                    whole.append(len(part) == len(raw))
                    held += len(part)
                    if held > SLICE_BYTES:
                        yield made(ids, texts, whole)
                        ids, texts, whole, held = [], [], [], 0
    if texts:
        yield made(ids, texts, whole)


@dataclass
class Items:
    """A bounded block of benchmark items and the columns of all items' words."""

    ids: list
    words: list[np.ndarray]
    vocabulary: np.ndarray  # sorted names
    table: np.ndarray  # low bits of a name -> place in the vocabulary
    active: np.ndarray  # columns that take part
    short: dict[int, dict[bytes, list]]  # number of words, below MIN_WORDS -> their names -> items

    def places(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are in the vocabulary, and their places in it."""
        at = self.table[(names & np.uint64(len(self.table) - 1)).astype(np.int64)]
        clash = np.flatnonzero(at < 0)
        at[clash] = np.minimum(np.searchsorted(self.vocabulary, names[clash]), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == names)
        return known, at[known]

    def columns(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words have a column that takes part, and their columns."""
        known, at = self.places(names)
        column = (at % MAX_COLUMNS).astype(np.uint16)
        fit = self.active[column]
        return known[fit], column[fit]

    def rarest(self, held: np.ndarray) -> np.ndarray:
        """The columns of the rarest words of each item."""
        out = np.zeros(len(self.active), bool)
        for w in self.words:
            own = distinct(self.columns(w)[1])
            out[own[np.argsort(held[own], kind="stable")[:RAREST]]] = True
        return out

    @property
    def width(self) -> int:
        return min(len(self.vocabulary), MAX_COLUMNS)


def item_words(rows: list[tuple[int, str]]) -> list[tuple[int, np.ndarray]]:
    """The words of the items that have an id and any."""
    found = [(i, words_of(np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8))[0]) for i, text in rows if i is not None]
    return [(i, w) for i, w in found if len(w)]


def prepare_items(rows: list[tuple[int, np.ndarray]], vocabulary: np.ndarray) -> Items:
    """Where low bits of the vocabulary's names clash, the table says -1 and a search decides."""
    short: dict[int, dict[bytes, list]] = {}
    for i, w in rows:
        if len(w) < MIN_WORDS:
            short.setdefault(len(w), {}).setdefault(w.tobytes(), []).append(i)
    rows = [(i, w) for i, w in rows if len(w) >= MIN_WORDS]
    size = 1 << max(16, int(len(vocabulary) * 16).bit_length())
    slot = (vocabulary & np.uint64(size - 1)).astype(np.int64)
    lookup = np.zeros(size, np.int64)
    lookup[slot] = np.arange(len(vocabulary))
    lookup[np.flatnonzero(np.bincount(slot, minlength=size) > 1)] = -1
    return Items([i for i, _ in rows], [w for _, w in rows], vocabulary, lookup, np.ones(max(1, min(len(vocabulary), MAX_COLUMNS)), bool), short)


def passage_counts(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Passages that hold each column, and all passages; over every document."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(items.width + 1, np.int64), 0
        for s in sliced(batches):
            passage, first = s.blocks(PASSAGE)
            known, column = items.columns(s.names)
            once = distinct(passage[known] * items.width + column)
            total[:-1] += np.bincount(once % items.width, minlength=items.width)
            total[-1] += first[-1]
        at = np.flatnonzero(total)
        yield pd.DataFrame({"column": at, "n": total[at]})

    out = np.zeros(items.width + 1, np.int64)
    for r in docs.mapInPandas(count, "column long, n long").groupBy("column").agg(F.sum("n").alias("n")).collect():
        out[r.column] = r.n
    return out[:-1], int(out[-1])


def _sums(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending keys and the sums of their (adjacent) rows."""
    cuts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[cuts], np.add.reduceat(rows, cuts, axis=0)


def _products(column: np.ndarray, passage: np.ndarray, weight: np.ndarray, start: np.ndarray, into: np.ndarray) -> None:
    """into += A'(A start) for the passages of these words."""
    if not len(column):
        return
    lifted = start * weight[:, None]
    rows, y = _sums(lifted[column], passage)
    own = np.searchsorted(rows, passage)
    order = np.argsort(column, kind="stable")
    names, g = _sums(y[own[order]], column[order].astype(np.int64))
    into[names] += g * weight[names, None]


def decompose(docs: DataFrame, items: Items, weight: np.ndarray, blocks: Callable[[], Iterator[Items]]) -> np.ndarray:
    """(columns, RANK): the leading right singular vectors, by a single-pass Nystrom sketch.

    They are not scaled by the singular values: that gives weak directions a say in which an
    edited passage and its item differ. The benchmark's own passages take part with as much weight as the whole corpus.
    """
    width = RANK + EXTRA
    start = np.random.default_rng(7).standard_normal((items.width, width)).astype(np.float32)
    weight = weight.astype(np.float32)
    step = 256

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((items.width, width), np.float32)
        for s in sliced(batches):
            passage, _ = s.blocks(PASSAGE)
            known, column = items.columns(s.names)
            _products(column, passage[known], weight, start, total)
        yield pd.DataFrame({"part": range(0, items.width, step), "data": [total[a : a + step].tobytes() for a in range(0, items.width, step)]})

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.sum([np.frombuffer(d, np.float32).astype(np.float64) for d in pdf["data"]], axis=0)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "data": [data.tobytes()]})

    parts = docs.mapInPandas(add, "part long, data binary").groupBy("part").applyInPandas(together, "part long, data binary").collect()
    g = np.zeros((items.width, width))
    for r in parts:
        g[r.part : r.part + step] = np.frombuffer(r.data, np.float64).reshape(-1, width)
    own = np.zeros((items.width, width), np.float32)
    for block in blocks():
        for i, w in enumerate(block.words):
            column = items.columns(w)[1]
            _products(column, np.full(len(column), i), weight, start, own)
    start = start.astype(np.float64)
    g += own * (np.abs(np.sum(start * g)) / max(np.abs(np.sum(start * own)), 1e-9) if g.any() else 1.0)
    shift = 1e-9 * max(np.linalg.norm(g), 1e-9)
    g += shift * start
    core = start.T @ g
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-10
    u, s, _ = np.linalg.svd(g @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    keep = s > s.max(initial=0) * 1e-6
    return u[:, keep][:, :RANK]


def common_subsequence(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence of two word sequences, by bits of an integer."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    rows = full = (1 << len(item)) - 1
    for w in region.tolist():
        m = masks.get(w)
        if m:
            u = rows & m
            rows = ((rows + u) | (rows - u)) & full
    return len(item) - rows.bit_count()


class LongItem:
    """An item of more than LONG words: its pieces in the latent space, and its words.

    A text is laid out in strides of half an item, and a stretch is four of them. A copy that takes no more
    than one and a half times the item's words lies in one stretch, whatever the item's length.
    """

    def __init__(self, items: Items, q: int, projection: np.ndarray):
        self.id, self.words = items.ids[q], items.words[q]
        size = WINDOWS[-1]
        starts = [*range(0, len(self.words) - size, size), len(self.words) - size]
        pieces = np.array([projection[items.columns(self.words[a : a + size])[1]].sum(0) for a in starts], np.float32)
        self.pieces = pieces / np.maximum(np.linalg.norm(pieces, axis=1, keepdims=True), 1e-12)
        self.needed = max(2, math.ceil(PIECES * len(starts)))
        self.stride = -(-len(self.words) // (2 * BLOCK))  # blocks
        self.vocabulary, self.counts = np.unique(self.words, return_counts=True)
        self.closing = len(self.words) // 5

    def stretches(self, s: Slice, z: np.ndarray, first: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, first word, word after the last) of stretches with windows close to enough pieces, in documents long enough."""
        fit = np.diff(s.bounds) >= LIKELY * len(self.words)
        chosen = np.flatnonzero(fit[owner])
        if not len(chosen):
            return
        local = (chosen - first[owner[chosen]]) // self.stride
        begin = np.flatnonzero((np.diff(owner[chosen], prepend=-1) != 0) | (np.diff(local, prepend=-1) != 0))
        d, local = owner[chosen[begin]], local[begin]
        held = np.zeros(len(begin), np.int64)
        for a in range(0, len(self.pieces), GROUP):
            close = z[chosen] @ self.pieces[a : a + GROUP].T >= COSINE
            in_stride = np.logical_or.reduceat(close, begin, axis=0)
            near = in_stride.copy()
            for k in range(1, 4):
                same = d[k:] == d[:-k]
                near[:-k][same] |= in_stride[k:][same]
            held += near.sum(1)
        width = self.stride * BLOCK
        for g in np.flatnonzero(held >= self.needed):
            start = s.bounds[d[g]] + local[g] * width
            yield d[g], start, min(s.bounds[d[g] + 1], start + 4 * width)

    def check(self, region: np.ndarray) -> tuple[float, bool] | None:
        """Share of the item's words that the region has in order, and whether the closing ones are among them; None if it is no match."""
        at = np.minimum(np.searchsorted(self.vocabulary, region), len(self.vocabulary) - 1)
        at = at[self.vocabulary[at] == region]
        if np.minimum(np.bincount(at, minlength=len(self.vocabulary)), self.counts).sum() < LIKELY * len(self.words):
            return None
        share = common_subsequence(self.words, region) / len(self.words)
        if share < LIKELY:
            return None
        answer = common_subsequence(self.words[-self.closing :], region) >= ANSWER * self.closing
        return (share, answer) if share >= SURE or answer else None


_KINDS = np.array([(x & 15) + (x >> 4 << 16) for x in range(256)], np.uint32)


class Group:
    """Some items of a block, held against a slice together.

    Their words are of two kinds, with a column that takes part (rare) and without (common). A common
    subsequence is no longer than the sum over the kinds of the smaller of the item's and the region's count.
    """

    def __init__(self, items: Items, chosen: np.ndarray):
        self.chosen = chosen
        self.words = [items.words[q] for q in chosen]
        self.lengths = np.array([len(w) for w in self.words])
        placed = [items.places(w)[1] for w in self.words]
        self.vocabulary = np.unique(np.concatenate(placed))
        self.rare = items.active[self.vocabulary % MAX_COLUMNS]
        self.held = np.zeros((len(self.vocabulary) + 1, len(chosen)), np.uint8)  # 1: common, 16: rare
        self.masks = np.zeros((len(chosen), len(self.vocabulary) + 1), np.uint64)  # the last: words of no item
        self.own = np.zeros((2, len(chosen)), np.int64)
        for i, at in enumerate(placed):
            at = np.searchsorted(self.vocabulary, at)
            self.held[at, i] = np.where(self.rare[at], 16, 1)
            self.own[:, i] = np.sum(~self.rare[at]), np.sum(self.rare[at])
            if len(at) <= 64:
                np.bitwise_or.at(self.masks[i], at, np.uint64(1) << np.arange(len(at), dtype=np.uint64))
        self.closing = np.maximum(3, self.lengths // 5)

    def counts(self, words: np.ndarray) -> np.ndarray:
        """Words of each item before each block, common and (times 65,536) rare, of the BLOCK words of each block by place here or -1."""
        total = np.zeros((len(words), len(self.chosen)), np.uint8)
        for column in words.T:
            total += self.held[column]
        out = np.zeros((len(words) + 1, len(self.chosen)), np.uint32)
        np.cumsum(_KINDS[total], axis=0, out=out[1:])
        return out

    def subsequences(self, item: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, names: np.ndarray, last: np.ndarray) -> np.ndarray:
        """`common_subsequence` of the `last` words of each item and its region, together; of items over 64 words one by one."""
        skipped = np.where(self.lengths[item] > 64, 0, self.lengths[item] - last).astype(np.uint64)
        rows = np.full(len(item), ~np.uint64(0))
        for step in range(int((end - start).max(initial=0))):
            where = start + step
            m = self.masks[item, np.where(where < end, at[np.minimum(where, len(names))], -1)] >> skipped
            u = rows & m
            rows = (rows + u) | (rows - u)
        out = np.bitwise_count(~rows).astype(np.int64)
        for k in np.flatnonzero(self.lengths[item] > 64):
            out[k] = common_subsequence(self.words[item[k]][-last[k] :], names[start[k] : end[k]])
        return out


def _search(items: Items, projection: np.ndarray, overlap: int):
    projection = projection.astype(np.float32)
    latent = np.array([projection[items.columns(w)[1]].sum(0) for w in items.words]).reshape(len(items.words), projection.shape[1])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    lengths = np.array([len(w) for w in items.words])
    kind = np.abs(np.log(lengths[:, None] / np.array(WINDOWS))).argmin(1)

    def candidates(s: Slice, group: Group, asked: np.ndarray, z: np.ndarray, window: int, owner: np.ndarray, first: np.ndarray, counts: np.ndarray):
        """Items (by place in the group) and regions that may hold a common subsequence of LIKELY of the item."""
        at, i = np.nonzero(z @ latent[group.chosen[asked]].T >= COSINE)
        i = asked[i]
        size, reach, d = window // BLOCK, group.lengths[i], owner[at]
        beyond = -(-(reach // 2) // BLOCK)
        low, high = np.maximum(at - beyond, first[d]), np.minimum(at + size + beyond, first[d + 1])
        n = counts[high, i] - counts[low, i]
        bound = np.minimum(group.own[0, i], n & 0xFFFF) + np.minimum(group.own[1, i], n >> 16)
        fit = np.flatnonzero((bound >= LIKELY * reach) | (reach > 1 << 15))  # counts of longer regions may wrap
        at, i, d, reach = at[fit], i[fit], d[fit], reach[fit]
        a = s.bounds[d] + (at - first[d]) * BLOCK
        return i, d, np.maximum(s.bounds[d], a - reach // 2), np.minimum(s.bounds[d + 1], a + window + reach // 2)

    def exact(s: Slice) -> Iterator[tuple[int, int]]:
        """(document, item) of the short items whose words stand in a document one after the other, a single one as all of it."""
        for n, known in items.short.items():
            firsts = np.array([np.frombuffer(w, np.uint64)[0] for w in known])
            at = np.flatnonzero(np.isin(s.names, firsts))
            at = at[at + n <= s.bounds[s.doc[at] + 1]]
            if n == 1:
                at = at[s.whole[s.doc[at]] & (np.diff(s.bounds)[s.doc[at]] == 1)]
            for k in at.tolist():
                for i in known.get(s.names[k : k + n].tobytes(), ()):
                    yield s.doc[k], i

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        padded = np.vstack([projection, np.zeros((1, projection.shape[1]), np.float32)])
        usual = np.flatnonzero(lengths <= LONG)
        groups = [Group(items, usual[a : a + GROUP]) for a in range(0, len(usual), GROUP)]
        long = [LongItem(items, q, projection) for q in np.flatnonzero(lengths > LONG)]
        for s in sliced(batches, overlap):
            found = [(s.ids[d], i, 1.0, True) for d, i in exact(s)]
            _, first = s.blocks(BLOCK)
            owner = np.repeat(np.arange(len(s.ids)), np.diff(first))
            inner = s.bounds[owner] + (np.arange(first[-1]) - first[owner]) * BLOCK
            inner = inner[:, None] + np.arange(BLOCK)
            inner[inner >= s.bounds[owner + 1][:, None]] = len(s.names)
            known, column = items.columns(s.names)
            word = np.full(len(s.names) + 1, -1)
            word[known] = column
            sums = np.zeros((len(inner), projection.shape[1]), np.float32)
            for w in word[inner].T:
                sums += padded[w]
            cuts = np.zeros((len(inner) + 1, projection.shape[1]))
            np.cumsum(sums, axis=0, dtype=float, out=cuts[1:])
            latents = []
            for window in WINDOWS:
                at = np.arange(first[-1])
                z = (cuts[np.minimum(at + window // BLOCK, first[owner + 1])] - cuts[at]).astype(np.float32)
                latents.append(z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12))
            known, place = items.places(s.names)
            for group in groups:
                near = np.minimum(np.searchsorted(group.vocabulary, place), len(group.vocabulary) - 1)
                fit = np.flatnonzero(group.vocabulary[near] == place)
                word = np.full(len(s.names) + 1, -1)
                word[known[fit]] = near[fit]
                counts = group.counts(word[inner])
                for k, window in enumerate(WINDOWS):
                    asked = np.flatnonzero(kind[group.chosen] == k)
                    if not len(asked):
                        continue
                    i, d, start, end = candidates(s, group, asked, latents[k], window, owner, first, counts)
                    for a in range(0, len(i), CHECKED):
                        part = slice(a, a + CHECKED)
                        near, x, y = i[part], start[part], end[part]
                        share = group.subsequences(near, x, y, word, s.names, group.lengths[near]) / group.lengths[near]
                        fit = np.flatnonzero(share >= LIKELY)
                        near, x, y, share, at = near[fit], x[fit], y[fit], share[fit], d[part][fit]
                        closing = group.closing[near]
                        answer = group.subsequences(near, x, y, word, s.names, closing) >= ANSWER * closing
                        for c in np.flatnonzero((share >= SURE) | answer):
                            found.append((s.ids[at[c]], items.ids[group.chosen[near[c]]], share[c], answer[c]))
            for item in long:
                for d, start, end in item.stretches(s, latents[-1], first, owner):
                    match = item.check(s.names[start:end])
                    if match:
                        found.append((s.ids[d], item.id, *match))
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "similarity", "answer"])

    return find


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, answer): documents that hold a benchmark item, with the share of
    its words found in order and whether its closing words are among them.

    One row for each pair of ids. Null and empty texts hold nothing; items without an id or words are not
    sought, and those under MIN_WORDS words only by their exact sequence (a single word: as the whole text).
    An empty side gives no rows. Other columns are not read. The latent space is made once, from all items
    and all documents; only the search goes over blocks of items, each with a pass over the documents.
    Beyond MAX_COLUMNS distinct words of the benchmark, some share a column of that space: a coarser
    cosine, while checks stay on words. The driver holds a block of items and 8 bytes for each distinct word.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select("doc_id", "text")
    size = benchmark.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.max(F.octet_length("text")).alias("longest")).first()
    turns = max(1, -(-size.n // BLOCK_ITEMS), -(-(size.bytes or 0) // BLOCK_BYTES))
    overlap = OVERLAP * (size.longest or 0) + OVERLAP_BYTES

    def collected() -> Iterator[list[tuple[int, np.ndarray]]]:
        for turn in range(turns):
            mine = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn)
            yield item_words([(r.item_id, r.text) for r in mine.select("item_id", "text").collect()])

    if turns == 1:
        only = list(collected())
        collected = lambda: iter(only)
    vocabulary = np.zeros(0, np.uint64)
    for rows in collected():
        vocabulary = np.unique(np.concatenate([vocabulary, *[w for _, w in rows]]))
    schema = "doc_id long, item_id long, similarity double, answer boolean"
    if not len(vocabulary):
        return spark.createDataFrame([], schema)
    blocks = lambda: (prepare_items(rows, vocabulary) for rows in collected())
    every = prepare_items([], vocabulary)
    held, passages = passage_counts(texts, every)
    weight = np.log((passages + 1) / (held + 1)) + 1e-3
    active = held <= COMMON_SHARE * passages
    for block in blocks():
        active |= block.rarest(held)
    projection = decompose(texts, replace(every, active=active), weight, blocks) * weight[:, None]
    parts = [texts.mapInPandas(_search(replace(block, active=active), projection, overlap), schema) for block in blocks()]
    return functools.reduce(DataFrame.union, parts).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max("answer").alias("answer"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
