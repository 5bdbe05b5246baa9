"""Benchmark items of any length in long texts: all copies are found, nothing else is."""

import numpy as np
import pytest

from voxmill.llm import decontamination

SIZES = (20, 60, 128, 129, 200, 1000, 6000)


@pytest.fixture(scope="module")
def planted(spark):
    """Items, and texts of up to 0.5 MB with a copy each: verbatim, with words replaced, with words left out and put in."""
    rng = np.random.default_rng(11)
    names = np.array([f"w{k}" for k in range(20_000)])
    weights = 1 / np.arange(1, len(names) + 1) ** 0.9
    words = lambda n: rng.choice(names, n, p=weights / weights.sum())
    items = [words(n) for n in SIZES]

    def edited(item, kind):
        hit = rng.random(len(item)) < 0.1
        if kind == "replaced":
            return np.where(hit, words(len(item)), item)
        if kind == "moved":
            return np.insert(item[~hit], np.flatnonzero(rng.random(np.sum(~hit)) < 0.1), "between")
        return item

    docs, truth = [], set()
    for k, item in enumerate(items):
        for size, kind in ((80_000, "same"), (3000, "replaced"), (9000, "moved")):
            around = words(size)
            at = int(rng.integers(0, size))
            truth.add((len(docs), k))
            docs.append((len(docs), " ".join([*around[:at], *edited(item, kind), *around[at:]])))
    for n in (500, 20_000, 80_000):
        docs.append((len(docs), " ".join(words(n))))
    halves = items[-1]  # half an item is no copy of it
    docs.append((len(docs), " ".join([*words(500), *halves[: len(halves) // 2], *words(4000)])))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string"), truth


def test_long_items(planted):
    docs, bench, truth = planted
    rows = decontamination.benchmark_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == truth
    assert all(r.similarity == 1 and r.answer for r in rows if r.doc_id % 3 == 0)


def test_stretches_hold_every_copy():
    """A copy of up to one and a half times the item's words lies in a stretch, wherever it begins and however texts are cut."""
    rng = np.random.default_rng(2)
    item = rng.integers(1, 1 << 60, 300).astype(np.uint64)
    rows = [(0, item)]
    items = decontamination.prepare_items(rows, np.unique(item))
    projection = rng.standard_normal((items.width, 16)).astype(np.float32)
    held = decontamination.LongItem(items, 0, projection)
    for begin in (0, 1, 149, 150, 777, 1100):
        spaced = np.insert(item, np.arange(0, 300, 2), rng.integers(1, 1 << 60, 150).astype(np.uint64))
        own = np.concatenate([rng.integers(1, 1 << 60, begin).astype(np.uint64), spaced, rng.integers(1, 1 << 60, 40).astype(np.uint64)])
        before = rng.integers(1, 1 << 60, 450).astype(np.uint64)
        s = decontamination.Slice([1, 2], np.concatenate([before, own]), np.repeat([0, 1], [450, len(own)]), np.array([0, 450, 450 + len(own)]), np.ones(2, bool))
        _, first = s.blocks(decontamination.BLOCK)
        owner = np.repeat([0, 1], np.diff(first))
        z = np.tile(held.pieces.mean(0), (first[-1], 1))  # close to every piece
        held.needed = 0
        found = list(held.stretches(s, z, first, owner))
        assert {d for d, _, _ in found} == {0, 1} and all(s.bounds[d] <= a < b <= s.bounds[d + 1] for d, a, b in found)
        assert any(a <= 450 + begin and 450 + begin + len(spaced) <= b for d, a, b in found if d == 1)
        assert any(held.check(s.names[a:b]) == (1.0, True) for d, a, b in found if d == 1)
        assert all(held.check(s.names[a:b]) is None for d, a, b in found if d == 0)
