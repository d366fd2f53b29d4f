"""Other files of the field tools: tetrahedral meshes, block files, sphere patch tables, entropy logs, geometry dumps."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import filesystem

# ---------------------------------------------------------------- tetrahedral meshes


#: Bytes of a mesh's text that a task reads, and rows of a batch.
CHUNK, ROWS = 1 << 23, 50_000


class Lines(InputPartition):
    """Bytes of a chunk, its first line and their number, and the wanted lines of the whole text."""

    def __init__(self, start: int, end: int, first: int, n: int, wanted: tuple[int, int]):
        self.start, self.end, self.first, self.n, self.wanted = start, end, first, n, wanted


def lines_begun(f, start: int, end: int) -> int:
    """Number of lines of an open file that begin at bytes start to end - 1."""
    n, at = int(start == 0 < end), max(start - 1, 0)
    while at < end - 1:
        piece = f.read_at(min(1 << 22, end - 1 - at), at)
        n, at = n + piece.count(b"\n"), at + len(piece)
    return n


class MeshReader(DataSourceReader):
    """Text: `vertices cells`, then a line `x y z f` per vertex and a line of four vertex numbers per cell. A task reads the lines that begin in its chunk of the text; option `lines` has their
    numbers, chunk by chunk. Without it they are counted where the read is planned, in one pass over the text.
    """

    def __init__(self, options: dict):
        self.path, self.part, self.lines = options["path"], options.get("part", "vertices"), options.get("lines")

    def partitions(self) -> list[Lines]:
        fs, path = filesystem(self.path)
        with fs.open_input_stream(path) as f:
            head = b""
            while b"\n" not in head and (piece := f.read(1 << 10)):
                head += piece
        n_v, n_c = map(int, head.split(b"\n")[0].split())
        with fs.open_input_file(path) as f:
            size = f.size()
            spans = [(a, min(size, a + CHUNK)) for a in range(0, size, CHUNK)]
            counts = list(map(int, self.lines.split(","))) if self.lines else [lines_begun(f, *span) for span in spans]
        if len(counts) != len(spans) or sum(counts) < 1 + n_v + n_c:
            raise ValueError(f"{sum(counts)} lines for {n_v} vertices and {n_c} cells")
        lo, hi = (1, 1 + n_v) if self.part == "vertices" else (1 + n_v, 1 + n_v + n_c)
        firsts = itertools.accumulate(counts, initial=0)
        return [Lines(*span, k, n, (lo, hi)) for span, k, n in zip(spans, firsts, counts) if k < hi and k + n > lo] or [Lines(0, 0, 0, 0, (lo, hi))]

    def read(self, part: Lines) -> Iterator[pa.RecordBatch]:
        if not part.n:
            return
        fs, path = filesystem(self.path)
        with fs.open_input_file(path) as f:
            at = max(part.start - 1, 0)
            text, size = f.read_at(part.end - at, at), f.size()
            end = part.end
            while not text.endswith(b"\n") and end < size:  # the rest of the last line
                more = f.read_at(min(1 << 12, size - end), end)
                cut = more.find(b"\n") + 1 or len(more)
                text, end = text + more[:cut], end + cut
        if part.start:
            text = text[text.index(b"\n") + 1 :]
        begins = np.r_[0, np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1, len(text)]
        lo, hi = part.wanted
        for k in range(max(lo, part.first), min(hi, part.first + part.n), ROWS):
            last = min(hi, part.first + part.n, k + ROWS)
            some = text[begins[k - part.first] : begins[last - part.first]]
            v = np.array(some.split(), np.float64) if self.part == "vertices" else np.fromstring(some, np.int64, sep=" ")
            if len(v) != 4 * (last - k):
                raise ValueError(f"lines {k} to {last - 1} haven't four numbers each")
            ids = pa.array(np.arange(k - lo, last - lo))
            if self.part == "vertices":
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(v[i::4].copy()) for i in range(4)]], names=["vid", "x", "y", "z", "f"])
            else:
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, 4, np.int32)), pa.array(v))], names=["cid", "v"])


class TetMesh(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tetmesh"

    def schema(self) -> str:
        return "vid long, x double, y double, z double, f double" if self.options.get("part", "vertices") == "vertices" else "cid long, v array<long>"

    def reader(self, schema) -> DataSourceReader:
        return MeshReader(dict(self.options))


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and cells. Executors count the lines of each chunk first, so that every chunk can be read by itself."""
    spark.dataSource.register(TetMesh)
    fs, p = filesystem(path)
    size, chunk = fs.get_file_info(p).size, CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, p = filesystem(path)
        with fs.open_input_file(p) as f:
            for batch in batches:
                k = batch["id"].to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([lines_begun(f, i * chunk, min(size, (i + 1) * chunk)) for i in k], pa.int64())], names=["k", "n"])

    options, n = {"path": path}, -(-size // chunk)
    if n > 1:
        rows = spark.range(0, n, 1, min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(count, "k long, n long").collect()
        options["lines"] = ",".join(str(r["n"]) for r in sorted(rows))
    return tuple(spark.read.format("tetmesh").options(part=part, **options).load() for part in ("vertices", "cells"))


def write_mesh(vertices: DataFrame, cells: DataFrame, path: str) -> None:
    """The text that MeshReader reads; vid must count the vertices from 0. Lines are written by the executors as sorted parts, which the driver appends to one file a piece at a time."""
    lines = [vertices.select(F.col("vid").alias("k"), F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyzf"]).alias("value")), cells.select(F.col("cid").alias("k"), F.array_join(F.col("v").cast("array<string>"), " ").alias("value"))]
    parts = [f"{path}.{n}" for n in ("vertices", "cells")]
    for df, part in zip(lines, parts):
        df.orderBy("k").select("value").write.text(part)
    fs, to = filesystem(path)
    with fs.open_output_stream(to) as out:
        out.write(f"{vertices.count()} {cells.count()}\n".encode())
        for part in parts:
            _, folder = filesystem(part)
            for f in sorted((f for f in fs.get_file_info(pafs.FileSelector(folder)) if f.base_name.startswith("part-")), key=lambda f: f.base_name):
                with fs.open_input_stream(f.path) as read:
                    while piece := read.read(1 << 24):
                        out.write(piece)
            fs.delete_dir(folder)


# ---------------------------------------------------------------- block files


class Span(InputPartition):
    def __init__(self, first: int, offsets: list[int], end: int):
        self.first, self.offsets, self.end = first, offsets, end


class BlockReader(DataSourceReader):
    """Blocks of six 32-bit float limits and values (`field`), or one value per block (`scalar`); at the end the offsets of the blocks and their number, as 64- or 32-bit integers."""

    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "field")
        self.word = np.dtype("<u8" if self.payload == "field" else "<u4")

    def partitions(self) -> list[Span]:
        fs, path = filesystem(self.path)
        with fs.open_input_file(path) as f:
            size, w = f.size(), self.word.itemsize
            n = int(np.frombuffer(f.read_at(w, size - w), self.word)[0])
            offsets = np.frombuffer(f.read_at(w * n, size - w * (n + 1)), self.word).tolist()
        end, step = size - w * (n + 1), 256
        return [Span(i, offsets[i : i + step], offsets[i + step] if i + step < n else end) for i in range(0, n, step)]

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(self.path)
        with fs.open_input_file(path) as f:
            for k, (a, b) in enumerate(zip(part.offsets, [*part.offsets[1:], part.end])):
                v = np.frombuffer(f.read_at(b - a, a), "<f4")
                if self.payload == "scalar":
                    yield pa.RecordBatch.from_arrays([pa.array([part.first + k], pa.int32()), pa.array(v[:1].astype(np.float64))], names=["block_id", "value"])
                    continue
                lo, hi = v[:3].astype(int), v[3:6].astype(int)
                z, y, x = [c.ravel().astype(np.int32) for c in np.meshgrid(*[np.arange(l, h + 1) for l, h in zip(lo[::-1], hi[::-1])], indexing="ij")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), part.first + k, np.int32)), pa.array(x), pa.array(y), pa.array(z), pa.array(v[6 : 6 + len(x)].astype(np.float64))], names=["block_id", "x", "y", "z", "value"])


class BlockFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blockfile"

    def schema(self) -> str:
        return "block_id int, x int, y int, z int, value double" if self.options.get("payload", "field") == "field" else "block_id int, value double"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(dict(self.options))


def read_blocks(spark: SparkSession, path: str, payload: str = "field") -> DataFrame:
    spark.dataSource.register(BlockFile)
    return spark.read.format("blockfile").options(path=path, payload=payload).load()


# ---------------------------------------------------------------- text tables


def parse_patches(text: str) -> list[tuple[int, float, float, float, float]]:
    """Pairs of lines `theta_lo,theta_hi` and `phi_lo,phi_hi`; quotes and blank lines don't matter."""
    lines = [line.strip().strip('"').replace("\\n", "") for line in text.splitlines()]
    pairs = [tuple(float(v) for v in line.split(",")[:2]) for line in lines if line]
    return [(i, *a, *b) for i, (a, b) in enumerate(zip(pairs[::2], pairs[1::2]))]


def read_patches(spark: SparkSession, path: str, n: int = 360) -> DataFrame:
    """patch_id, theta_lo, theta_hi, phi_lo, phi_hi from a file, or of the generated partition for the path `!`."""
    if path == "!":
        from ..operators.sphere import patches

        return patches(spark, n).drop("cx", "cy", "cz")
    fs, p = filesystem(path)
    with fs.open_input_stream(p) as f:
        return spark.createDataFrame(parse_patches(f.read().decode()), "patch_id int, theta_lo double, theta_hi double, phi_lo double, phi_hi double")


LOG = r"Block\s+(\d+)\s+RV\s+(\d+)\s+Entropy\s+([-+.\deE]+)"


def parse_entropy_log(lines: DataFrame) -> DataFrame:
    """block_id, rv, entropy of the lines `Block b RV r Entropy e`."""
    parts = [F.regexp_extract("value", LOG, i) for i in (1, 2, 3)]
    return lines.where(F.col("value").rlike(LOG)).select(parts[0].cast("int").alias("block_id"), parts[1].cast("int").alias("rv"), parts[2].cast("double").alias("entropy"))


def format_entropy_log(df: DataFrame) -> DataFrame:
    return df.select(F.format_string("Block %d RV %d Entropy %e", F.col("block_id"), F.col("rv"), F.col("entropy")).alias("value"))


def read_entropy_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_entropy_log(spark.read.text(path))


def geometry_text(geometry: DataFrame) -> DataFrame:
    """Lines `coord delta` of a geometry table, with the keys to partition and order them by."""
    return geometry.select("time_step", "block_id", "dim", "i", F.format_string("%f %f", F.col("coord"), F.coalesce("delta", F.lit(0.0))).alias("value"))
