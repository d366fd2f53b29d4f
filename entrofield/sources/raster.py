"""Raster files: an optional header of 32-bit dimensions, then values with x fastest; one float per cell, or three.

Reading (format `rasterfield`) plans tasks of about SPAN cells, whole layers of one block of the grid each, and reads only that block's rows of cells, with ghost layers if wanted. Options: path; header (true), or dims = nx,ny,nz without one; ndim of the
header (3); components (1 or 3); dtype (f4, f8, i4, i8); endian (little, big); blocks = bx,by,bz; split (ceil, floor); ghost = gx,gy,gz.
Writing deals cells by range and writes sorted slabs on the executors. For one file the driver joins them as streams; with slabs=True they stay: the path is then a folder of slabs with
an index, written last, which reading takes like a file, and no byte of a cell passes the driver.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import filesystem


INDEX = "index.json"
#: Cells of a task and of a batch, but a layer of a block at least.
SPAN, BATCH = 1 << 18, 1 << 15


def triple(text: str) -> tuple[int, int, int]:
    parts = [int(x) for x in str(text).split(",")]
    return tuple((parts + [parts[0]] * 3)[:3] if len(parts) == 1 else (parts + [1] * 3)[:3])


def block_bounds(n: int, parts: int, split: str, ghost: int) -> list[tuple[int, int, int, int]]:
    """(low, high, padded low, padded high) of each block along an axis, inclusive; empty blocks are left out."""
    size = max(1, n // parts if split == "floor" else math.ceil(n / parts))
    out = []
    for i in range(parts):
        lo, hi = i * size, n - 1 if split == "floor" and i == parts - 1 else min(n, (i + 1) * size) - 1
        if lo <= hi:
            out.append((lo, hi, max(0, lo - ghost), min(n - 1, hi + ghost)))
    return out


class Block(InputPartition):
    def __init__(self, block_id: int, bounds: tuple, layers: tuple[int, int]):
        self.block_id, self.bounds, self.layers = block_id, bounds, layers


class Slabs:
    """The values of a folder of slabs, read like one file without a header. The index has the dimensions and, in order, each slab's first byte and name."""

    def __init__(self, fs, path: str):
        self.fs, self.path = fs, path
        with fs.open_input_stream(f"{path}/{INDEX}") as f:
            index = json.loads(f.read())
        self.dims, self.starts, self.names, self.opened = tuple(index["dims"]), index["starts"], index["names"], (-1, None)

    def __enter__(self) -> Slabs:
        return self

    def __exit__(self, *_) -> None:
        if self.opened[1]:
            self.opened[1].close()

    def read_at(self, n: int, offset: int) -> bytes:
        parts = []
        while n > 0:
            k = bisect_right(self.starts, offset) - 1
            if self.opened[0] != k:
                self.__exit__()
                self.opened = k, self.fs.open_input_file(f"{self.path}/{self.names[k]}")
            parts.append(self.opened[1].read_at(n, offset - self.starts[k]))
            if not parts[-1]:
                raise ValueError(f"slab {self.names[k]} is too short")
            n, offset = n - len(parts[-1]), offset + len(parts[-1])
        return b"".join(parts)


def opened(fs, path: str):
    """A raster file or folder of slabs, open for read_at()."""
    return Slabs(fs, path) if fs.get_file_info(path).type == pafs.FileType.Directory else fs.open_input_file(path)


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.order = ">" if options.get("endian", "little") == "big" else "<"
        self.dtype = np.dtype(self.order + options.get("dtype", "f4"))
        self.components = int(options.get("components", 1))
        self.header = str(options.get("header", "true")).lower() == "true"
        self.ndim = int(options.get("ndim", 3))
        self.dims = triple(options["dims"]) if "dims" in options else None
        self.blocks, self.split, self.ghost = triple(options.get("blocks", "1,1,1")), options.get("split", "ceil"), triple(options.get("ghost", "0"))

    def start(self) -> int:
        return 4 * self.ndim if self.header else 0

    def shape(self) -> tuple[int, int, int]:
        fs, path = filesystem(self.path)
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            self.header = False
            return Slabs(fs, path).dims
        if not self.header:
            if self.dims is None:
                raise ValueError("a raster without a header needs dims")
            return self.dims
        with fs.open_input_file(path) as f:
            dims = np.frombuffer(f.read_at(4 * self.ndim, 0), self.order + "i4").tolist()
        return tuple((dims + [1, 1])[:3])

    def partitions(self) -> list[Block]:
        self.dims = self.shape()
        axes = [block_bounds(n, p, self.split, g) for n, p, g in zip(self.dims, self.blocks, self.ghost)]
        out = []
        for i, (z, y, x) in enumerate(itertools.product(axes[2], axes[1], axes[0])):
            step = max(1, SPAN // ((x[3] - x[2] + 1) * (y[3] - y[2] + 1)))
            out += [Block(i, (x, y, z), (k, min(z[3], k + step - 1))) for k in range(z[2], z[3] + 1, step)]
        return out

    def read(self, part: Block) -> Iterator[pa.RecordBatch]:
        nx, ny, _ = self.dims or self.shape()
        (x0, x1, px0, px1), (y0, y1, py0, py1), (z0, z1, _, _) = part.bounds
        fs, path = filesystem(self.path)
        item, width = self.dtype.itemsize * self.components, px1 - px0 + 1
        with opened(fs, path) as f:
            low, high = part.layers
            step = max(1, BATCH // (width * (py1 - py0 + 1)))
            for k in range(low, high + 1, step):  # some layers at a time
                zs = np.arange(k, min(high + 1, k + step))
                if width == nx and py1 - py0 + 1 == ny:  # whole layers lie side by side
                    rows = [f.read_at(len(zs) * ny * nx * item, self.start() + k * ny * nx * item)]
                elif width == nx:  # whole rows
                    rows = [f.read_at((py1 - py0 + 1) * nx * item, self.start() + (int(z) * ny + py0) * nx * item) for z in zs]
                else:
                    rows = [f.read_at(width * item, self.start() + ((int(z) * ny + y) * nx + px0) * item) for z in zs for y in range(py0, py1 + 1)]
                v = np.frombuffer(b"".join(rows), self.dtype).astype(self.dtype.newbyteorder("=")).reshape(-1, self.components)
                z, y, x = [a.ravel() for a in np.meshgrid(zs, np.arange(py0, py1 + 1), np.arange(px0, px1 + 1), indexing="ij")]
                cell = (z.astype(np.int64) * ny + y) * nx + x
                ghost = (x < x0) | (x > x1) | (y < y0) | (y > y1) | (z < z0) | (z > z1)
                value = pa.array(v[:, 0]) if self.components == 1 else pa.StructArray.from_arrays([pa.array(v[:, i].copy()) for i in range(self.components)], names=list("xyzw")[: self.components])
                yield pa.RecordBatch.from_arrays([pa.array(cell), *[pa.array(a.astype(np.int32)) for a in (x, y, z)], value, pa.array(np.full(len(x), part.block_id, np.int32)), pa.array(ghost)], names=["cell_id", "x", "y", "z", "value", "block_id", "is_ghost"])


#: Column types of the supported number formats.
TYPES = {"f4": "float", "f8": "double", "i4": "int", "i8": "long"}


class RasterField(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rasterfield"

    def schema(self) -> str:
        kind, n = TYPES[self.options.get("dtype", "f4")], int(self.options.get("components", 1))
        value = kind if n == 1 else "struct<" + ",".join(f"{c}:{kind}" for c in "xyzw"[:n]) + ">"
        return f"cell_id long, x int, y int, z int, value {value}, block_id int, is_ghost boolean"

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(dict(self.options))


def read_raster(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(RasterField)
    return spark.read.format("rasterfield").options(path=path, **options).load()


def _slab(batches: Iterator[pd.DataFrame], root: str, dtype: str, components: int) -> Iterator[pd.DataFrame]:
    fs, path = filesystem(root)
    fs.create_dir(path, recursive=True)
    name, first, n = f"slab-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}", None, 0
    with fs.open_output_stream(f"{path}/{name}") as out:
        for pdf in batches:
            if len(pdf):
                first = int(pdf["cell_id"].iloc[0]) if first is None else first
                n += len(pdf)
                values = pdf["value"].to_numpy() if components == 1 else np.stack([np.asarray([v[c] for v in pdf["value"]]) for c in "xyzw"[:components]], 1)
                out.write(np.ascontiguousarray(values, dtype).tobytes())
    yield pd.DataFrame({"first": [first], "n": [n], "name": [name]}).astype({"first": "Int64"})


def write_raster(df: DataFrame, path: str, dims: tuple[int, int, int], components: int = 1, dtype: str = "f4", header: bool = True, endian: str = "little", cells_per_slab: int = 1 << 19, slabs: bool = False) -> None:
    """Writes cell_id, value of a dense grid as one file, or as a folder of slabs; `value` is a number, or a struct x, y, z. A grid with missing or repeated cells is refused."""
    order, size = (">" if endian == "big" else "<"), math.prod(dims)
    work = path if slabs else f"{path}.slabs-{uuid.uuid4().hex[:8]}"
    # dealt by the cell's number: a range partitioning would evaluate df once more to find its bounds
    runs = df.select("cell_id", "value").repartitionById(max(1, -(-size // cells_per_slab)), F.floor(F.col("cell_id") / cells_per_slab).cast("int")).sortWithinPartitions("cell_id")
    kind = order + dtype
    rows = runs.mapInPandas(lambda it: _slab(it, work, kind, components), "first long, n long, name string").where("n > 0").collect()
    fs, out_path = filesystem(path)
    _, work_path = filesystem(work)
    try:
        at = 0
        for r in sorted(rows, key=lambda r: r["first"]):
            if r["first"] != at:
                raise ValueError(f"cell {at} is missing or repeated")
            at += r["n"]
        if at != size:
            raise ValueError(f"{at} cells for a grid of {size}")
        if slabs:
            width, ordered = np.dtype(kind).itemsize * components, sorted(rows, key=lambda r: r["first"])
            with fs.open_output_stream(f"{out_path}/{INDEX}") as out:
                out.write(json.dumps({"dims": list(dims), "starts": [r["first"] * width for r in ordered], "names": [r["name"] for r in ordered]}).encode())
            return
        with fs.open_output_stream(out_path) as out:
            if header:
                out.write(np.array(dims, order + "i4").tobytes())
            for r in sorted(rows, key=lambda r: r["first"]):
                with fs.open_input_stream(f"{work_path}/{r['name']}") as f:
                    while data := f.read(1 << 24):
                        out.write(data)
    finally:
        if not slabs:
            fs.delete_dir(work_path)


def strip_header(source: str, target: str, ndim: int = 3) -> None:
    """Copies a raster without its header."""
    fs, a = filesystem(source)
    _, b = filesystem(target)
    with fs.open_input_stream(a) as f, fs.open_output_stream(b) as out:
        f.read(4 * ndim)
        while data := f.read(1 << 24):
            out.write(data)
