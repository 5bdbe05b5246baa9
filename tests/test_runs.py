"""Committed runs and WAV blocks."""

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.sources import clips, runs

SCHEMA = "id long, v string"


def numbers(spark, n=100):
    return spark.range(n).select("id", F.concat(F.lit("v"), "id").alias("v"))


def test_a_run_counts_once(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert runs.read_runs(spark, folder, SCHEMA).isEmpty() and runs.committed(spark, folder) == {}
    assert runs.write_run(numbers(spark), folder, "r1") and not runs.write_run(numbers(spark), folder, "r1")
    assert runs.write_run(numbers(spark, 5), folder, "r2.x")
    assert {r.run_id: r["count"] for r in runs.read_runs(spark, folder, SCHEMA).groupBy("run_id").count().collect()} == {"r1": 100, "r2.x": 5}
    assert runs.read_runs(spark, folder, SCHEMA, ["r2.x"]).count() == 5
    assert runs.write_run(numbers(spark, 7), folder, "r1", replace=True) and runs.read_runs(spark, folder, SCHEMA, ["r1"]).count() == 7
    with pytest.raises(ValueError):
        runs.write_run(numbers(spark), folder, "a/b")


def test_of_two_attempts_one_counts(spark, tmp_path):
    folder = str(tmp_path)
    first, second = (runs.stage(numbers(spark, n), folder, "r") for n in (3, 4))
    assert runs.read_runs(spark, folder, SCHEMA).isEmpty()
    assert runs.commit(spark, folder, second) and not runs.commit(spark, folder, first)
    assert runs.read_runs(spark, folder, SCHEMA).count() == 4


def test_a_write_that_dies_midway_leaves_nothing_to_read(spark, tmp_path):
    """Some tasks have written when another fails; then a driver that ends between its files and its commit."""
    folder = str(tmp_path)

    def fails(batches):
        for b in batches:
            if (b["id"] == 99).any():
                raise RuntimeError("killed")
            yield b

    with pytest.raises(Exception, match="killed"):
        runs.write_run(numbers(spark).repartitionByRange(5, "id").mapInPandas(fails, SCHEMA), folder, "r")
    left = runs.stage(numbers(spark, 50), folder, "r")
    assert runs.read_runs(spark, folder, SCHEMA).isEmpty()
    assert runs.write_run(numbers(spark), folder, "r") and runs.read_runs(spark, folder, SCHEMA).count() == 100
    assert runs.sweep(spark, folder) == [] and left in runs.sweep(spark, folder, 0)
    assert runs.read_runs(spark, folder, SCHEMA).count() == 100


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("channels", [1, 2])
def test_wave_blocks(spark, tmp_path, width, channels):
    """Any cut of the bytes gives each sample time once."""
    rng = np.random.default_rng(width)
    want = {}
    for name, n in (("a", 1000), ("b", 1), ("c", 0), ("d", 333)):
        raw = rng.integers(0, 256, n * width * channels, np.uint8).tobytes()
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(width)
            w.setframerate(8000)
            w.writeframes(raw)
        want[name] = clips.scaled(raw, width).astype(np.float64).reshape(n, channels).mean(1) if n else np.zeros(0)
    (tmp_path / "notes.txt").write_text("no clip")
    for split, block in ((1 << 20, 1 << 10), (997, 64), (50, 7)):
        blocks = clips.load_blocks(spark, str(tmp_path), split, block)
        got = {}
        for r in clips.samples_of(blocks).collect():
            got.setdefault(r.clip_id, []).append((r.at, r.value))
        assert {c: [v for _, v in sorted(x)] for c, x in got.items()} == {c: v.tolist() for c, v in want.items() if len(v)}
        assert all([at for at, _ in sorted(x)] == list(range(len(x))) for x in got.values())
    assert clips.load_blocks(spark, str(tmp_path), 50, 7).rdd.getNumPartitions() > 20


def test_other_chunks_before_the_samples():
    import io
    import struct

    body = b"junkyy" + struct.pack("<4sI", b"fmt ", 16) + struct.pack("<HHIIHH", 1, 1, 8000, 16000, 2, 16) + struct.pack("<4sI", b"LIST", 3) + b"abc\0" + struct.pack("<4sI", b"data", 10**6) + b"\1\0\2\0\3"
    data = b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + struct.pack("<4sI", b"junk", 6) + body[4:]
    data = b"RIFF" + struct.pack("<I", len(data)) + b"WAVE" + struct.pack("<4sI", b"junk", 2) + b"yy" + body[6:]
    h = clips.read_header(lambda at, n: io.BytesIO(data[at : at + n]).read(), len(data))
    assert (h.sr, h.channels, h.width, h.nbytes) == (8000, 1, 2, 4) and data[h.data : h.data + 2] == b"\1\0"
    with pytest.raises(ValueError):
        clips.read_header(lambda at, n: b"x" * n, 100)
