"""PCM WAV files as blocks of samples, read by byte ranges, and written by executors.

The source `wave_blocks` cuts long files into several partitions and puts short ones together, so a
task holds one block of samples and never a clip. Each block carries the samples after it that its
frames still need. Paths are local ones, or URIs of the stores that pyarrow reads.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.frames import CLIP, frame_rms

BLOCKS = "clip_id string, sr int, channels int, start long, n int, samples array<float>"
HEAD_BYTES = 1 << 16
PCM, EXTENSIBLE = 1, 0xFFFE


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = path[5:].replace("///", "/", 1) if path.startswith("file:///") else path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Header:
    sr: int
    channels: int
    width: int  # bytes of a sample
    data: int  # where the samples begin
    nbytes: int  # of samples

    @property
    def step(self) -> int:
        return self.channels * self.width


def read_header(read, size: int) -> Header:
    """The chunks of a WAV up to its samples; `read(at, n)` gives bytes. A data size beyond the file's end is cut to it."""
    head = read(0, min(12, size))
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= size:
        name, n = struct.unpack("<4sI", read(at, 8))
        if name == b"fmt ":
            kind, channels, sr, _, _, bits = struct.unpack("<HHIIHH", read(at + 8, 16))
            if kind not in (PCM, EXTENSIBLE) or bits % 8 or not channels:
                raise ValueError(f"WAV format {kind} of {bits} bits is not PCM")
            form = sr, channels, bits // 8
        elif name == b"data":
            if form is None:
                raise ValueError("WAV without format")
            return Header(*form, at + 8, min(n, size - at - 8) // (form[1] * form[2]) * form[1] * form[2])
        at += 8 + n + n % 2
    raise ValueError("WAV without samples")


def scaled(raw: bytes, width: int) -> np.ndarray:
    """Samples in [-1, 1) from little-endian PCM of one to four bytes; one byte is unsigned."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    return (np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))).astype(np.float32)


class WaveRange(InputPartition):
    """Byte ranges of files: (path, size, first, last)."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        super().__init__(ranges)
        self.ranges = ranges


class WaveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 32 << 20))
        self.block = int(options.get("blocksamples", 1 << 16))
        self.overlap = int(options.get("overlapsamples", 0))

    def partitions(self) -> list[InputPartition]:
        fs, path = _store(self.path)
        info = fs.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        out, held, room = [], [], self.split
        for f in sorted((f for f in files if f.type == pafs.FileType.File and f.base_name.lower().endswith(".wav")), key=lambda f: f.path):
            first = 0
            while first < f.size:
                last = min(f.size, first + room)
                held.append((f.path, f.size, first, last))
                room -= last - first
                first = last
                if not room:
                    out.append(WaveRange(held))
                    held, room = [], self.split
        return [*out, WaveRange(held)] if held or not out else out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(self.path)
        for path, size, first, last in partition.ranges:
            with fs.open_input_file(path) as f:
                head = f.read_at(min(HEAD_BYTES, size), 0)
                read = lambda at, n: head[at : at + n] if at + n <= len(head) else f.read_at(n, at)  # noqa: B023, E731
                h = read_header(read, size)
                # Blocks that begin in this byte range are its own; a block's number, not the range, decides where it begins.
                own = self.block * h.step
                k, total = max(0, -(-(first - h.data) // own)), h.nbytes // h.step
                while k * own < h.nbytes and (h.data + k * own < last):
                    start = k * self.block
                    n = min(self.block, total - start)
                    raw = f.read_at(min(n + self.overlap, total - start) * h.step, h.data + k * own)
                    name = path.rpartition("/")[2]
                    row = [name.rpartition(".")[0], h.sr, h.channels, start, n, scaled(raw, h.width)]
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]]), *[pa.array([x], t) for x, t in zip(row[1:5], (pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)], pa.array([row[5]], pa.list_(pa.float32()))], names=["clip_id", "sr", "channels", "start", "n", "samples"])
                    k += 1


class WaveBlocks(DataSource):
    """(clip_id, sr, channels, start, n, samples): blocks of n sample times from `start` on, interleaved, and the overlap after them.

    Options: splitBytes of a partition, blockSamples and overlapSamples in sample times. Files that end in .wav count.
    """

    @classmethod
    def name(cls) -> str:
        return "wave_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> WaveReader:
        return WaveReader(dict(self.options))


def load_blocks(spark: SparkSession, path: str, split_bytes: int = 32 << 20, block: int = 1 << 16, overlap: int = 0) -> DataFrame:
    """Blocks of the WAV files under `path`; an empty or missing folder gives none."""
    spark.dataSource.register(WaveBlocks)
    return spark.read.format("wave_blocks").options(splitBytes=split_bytes, blockSamples=block, overlapSamples=overlap).load(path)


def samples_of(blocks: DataFrame) -> DataFrame:
    """(clip_id, at, value): the mean over channels at each sample time."""

    def mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for clip, channels, start, n, x in b[["clip_id", "channels", "start", "n", "samples"]].itertuples(index=False):
                y = np.asarray(x, np.float64).reshape(-1, channels)[:n].mean(1)
                yield pd.DataFrame({"clip_id": clip, "at": np.arange(start, start + n), "value": y})

    return blocks.mapInPandas(mean, "clip_id string, at long, value double")


def block_frames(blocks: DataFrame, frame: int, hop: int) -> DataFrame:
    """(clip_id, frame_idx, rms) like `frames`, for frames of `frame` sample times every `hop`; no clip is put together.

    The blocks need at least `frame` sample times of overlap. Several channels are averaged.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for clip, channels, start, n, x in b[["clip_id", "channels", "start", "n", "samples"]].itertuples(index=False):
                y = np.asarray(x, np.float64).reshape(-1, channels).mean(1)
                first = -(-start // hop)  # the first frame that starts in this block
                at = first * hop - start
                if at >= n:
                    continue
                # As many frames as a clip that ended here would have, but for those of the next block.
                last = len(y) if len(y) < n + frame else at + (-(-(n - at) // hop) - 1) * hop + frame + 1
                if start and len(y) - at <= frame:
                    continue  # only a clip's first frame may be short
                rms = frame_rms(y[at:last], frame, hop)
                rms = rms[: -(-(n - at) // hop)]
                yield pd.DataFrame({"clip_id": clip, "frame_idx": np.arange(first, first + len(rms), dtype=np.int64), "rms": rms})

    return blocks.mapInPandas(cut, "clip_id string, frame_idx long, rms double")


def write_waves(samples: DataFrame, folder: str, sr: int) -> None:
    """Write (clip_id, at, value), values in [-1, 1], as a 16-bit mono file for each clip, named by it.

    Rows go to their clip's task in order and are written as they come, so a task holds a batch; a file gets its name
    when it is whole, so an attempt that is lost or made twice does no harm.
    """
    fs, root = _store(folder)
    fs.create_dir(root)

    def header(n: int) -> bytes:
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * n, b"WAVE", b"fmt ", 16, PCM, 1, sr, 2 * sr, 2, 16, b"data", 2 * n)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(folder)
        attempt = TaskContext.get().taskAttemptId()
        name, out, begun = None, None, ""

        def finish():
            out.close()
            store.move(begun, f"{path}/{name}.wav")

        for b in batches:
            for clip, own in b.groupby("clip_id", sort=False):
                if clip != name:
                    if out:
                        finish()
                    name, begun = clip, f"{path}/{clip}.wav.{attempt}"
                    out = store.open_output_stream(begun)
                    out.write(header(int(own["n"].iloc[0])))
                out.write(np.clip(np.rint(own["value"].to_numpy() * 32768), -32768, 32767).astype("<i2").tobytes())
        if out:
            finish()
        yield pd.DataFrame({"n": [0]})

    sizes = samples.groupBy(CLIP).agg(F.count("*").alias("n"))
    rows = samples.join(sizes, CLIP).select(F.col(CLIP).cast("string").alias(CLIP), "at", "value", "n")
    rows.repartition(CLIP).sortWithinPartitions(CLIP, "at").mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()
