import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from entrofield.sources import raster, tables
from entrofield.sources.args import parse_args
from entrofield.streaming import entropy as streaming


@pytest.fixture(scope="module")
def field(tmp_path_factory):
    a = np.random.default_rng(1).random((5, 6, 7)).astype("<f4")
    path = tmp_path_factory.mktemp("r") / "a.vol"
    path.write_bytes(np.array([7, 6, 5], "<i4").tobytes() + a.tobytes())
    return str(path), a


@pytest.mark.parametrize("split", ["ceil", "floor"])
@pytest.mark.parametrize("ghost", ["0", "1,0,2"])
def test_read_blocks(spark, field, split, ghost):
    path, a = field
    df = raster.read_raster(spark, path, blocks="2,3,2", split=split, ghost=ghost).toPandas()
    own = df[~df.is_ghost]
    assert len(own) == a.size and (own.set_index("cell_id").value.sort_index().to_numpy() == a.ravel()).all()
    assert (df.value.to_numpy() == a[df.z, df.y, df.x]).all()
    assert df.is_ghost.any() == (ghost != "0")


def test_write_round_trip(spark, field, tmp_path):
    path, a = field
    df = raster.read_raster(spark, path)
    raster.write_raster(df.repartition(4), str(tmp_path / "b.vol"), (7, 6, 5), cells_per_slab=50)
    assert (tmp_path / "b.vol").read_bytes() == open(path, "rb").read()
    raster.strip_header(path, str(tmp_path / "c.raw"))
    assert (tmp_path / "c.raw").read_bytes() == a.tobytes()
    back = raster.read_raster(spark, str(tmp_path / "c.raw"), header="false", dims="7,6,5")
    assert back.agg(F.sum("value")).first()[0] == pytest.approx(a.astype(float).sum(), rel=1e-5)
    with pytest.raises(ValueError):
        raster.write_raster(df.where("cell_id <> 3"), str(tmp_path / "d.vol"), (7, 6, 5))


def test_vector_raster(spark, tmp_path):
    v = spark.range(24).select(F.col("id").alias("cell_id"), F.struct(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"), F.lit(1.0).alias("z")).alias("value"))
    raster.write_raster(v, str(tmp_path / "v.vec"), (2, 3, 4), components=3, endian="big")
    got = raster.read_raster(spark, str(tmp_path / "v.vec"), components=3, endian="big", blocks="1,1,2").orderBy("cell_id").collect()
    assert [(r.value.x, r.value.y, r.value.z) for r in got] == [(float(i), 2.0 * i, 1.0) for i in range(24)]


def test_mesh_text(spark, tmp_path):
    (tmp_path / "m.txt").write_text("4 1\n0 0 0 1.5\n1 0 0 2\n0 1 0 3\n0 0 1 4\n0 1 2 3\n")
    v, c = tables.read_mesh(spark, str(tmp_path / "m.txt"))
    assert [r.f for r in v.orderBy("vid").collect()] == [1.5, 2, 3, 4] and c.first().v == [0, 1, 2, 3]


def test_mesh_text_in_chunks(spark, tmp_path, monkeypatch):
    """Lines that cross chunks, lines as long as several, chunks without a line's beginning, and no newline at the end: each vertex and cell once, by several tasks."""
    f = [1 / 3, float("inf"), -2.5e-300, 4.0, 5.0]
    text = "5 3\n" + "".join(f"{i} 0 {'0' * (40 * (i % 2))}1.25 {v!r}\n" for i, v in enumerate(f)) + "0 1 2 3\r\n1 2  3 4\n4 0 1 2"
    (tmp_path / "m.txt").write_bytes(text.encode())
    for chunk in (1, 2, 7, 16, 33, 64, len(text) - 1):
        monkeypatch.setattr(tables, "CHUNK", chunk)
        for counted in (True, False):
            for part in ("vertices", "cells"):
                lines = {"lines": ",".join(str(tables.lines_begun(tables.pa.BufferReader(text.encode()), k, min(len(text), k + chunk))) for k in range(0, len(text), chunk))} if counted else {}
                reader = tables.MeshReader({"path": str(tmp_path / "m.txt"), "part": part} | lines)
                spans = reader.partitions()
                rows = [r for p in spans for b in reader.read(p) for r in b.to_pylist()]
                assert len(spans) > 1 or chunk > 16
                if part == "vertices":
                    assert [(r["vid"], r["x"], r["z"], r["f"]) for r in rows] == [(i, float(i), 1.25, v) for i, v in enumerate(f)]
                else:
                    assert [(r["cid"], r["v"]) for r in rows] == [(0, [0, 1, 2, 3]), (1, [1, 2, 3, 4]), (2, [4, 0, 1, 2])]
    (tmp_path / "n.txt").write_text("5 4\n" + text.split("\n", 1)[1])
    with pytest.raises(ValueError):
        tables.MeshReader({"path": str(tmp_path / "n.txt")}).partitions()


def test_rasters_are_read_by_several_tasks(spark, tmp_path, monkeypatch):
    """A block of many layers is read by several tasks in batches of several layers, with its ghosts and under its own number."""
    import math

    dims = (3, 4, 50)
    df = spark.range(math.prod(dims)).select(F.col("id").alias("cell_id"), (F.col("id") * 2.0).alias("value"))
    raster.write_raster(df, str(tmp_path / "a.vol"), dims, cells_per_slab=100)
    monkeypatch.setattr(raster, "SPAN", 100)
    monkeypatch.setattr(raster, "BATCH", 30)
    for options in ({}, {"blocks": "2,1,2", "ghost": "0,0,1"}, {"blocks": "1,2,1", "ghost": "1,1,1"}):
        reader = raster.RasterReader({"path": str(tmp_path / "a.vol")} | options)
        spans = reader.partitions()
        rows = [r for p in spans for b in reader.read(p) for r in b.to_pylist()]
        assert len(spans) >= 5 and sorted(r["cell_id"] for r in rows if not r["is_ghost"]) == list(range(600))
        assert all(r["value"] == 2 * r["cell_id"] and r["cell_id"] == (r["z"] * 4 + r["y"]) * 3 + r["x"] for r in rows)
        assert len({(r["block_id"], r["cell_id"]) for r in rows}) == len(rows)
        assert len(rows) == {0: 600, 2: 600 + 2 * 12, 1: 600 + 2 * 3 * 50}[int(options.get("blocks", "0")[0])]


def test_block_files(spark, tmp_path):
    blocks = [((0, 0, 0), (1, 1, 0), [1, 2, 3, 4]), ((2, 0, 0), (2, 1, 0), [5, 6])]
    data, offsets = b"", []
    for lo, hi, v in blocks:
        offsets.append(len(data))
        data += struct.pack(f"<6f{len(v)}f", *lo, *hi, *v)
    (tmp_path / "b").write_bytes(data + struct.pack("<2QQ", *offsets, 2))
    got = {(r.block_id, r.x, r.y, r.z): r.value for r in tables.read_blocks(spark, str(tmp_path / "b")).collect()}
    assert got == {(0, 0, 0, 0): 1, (0, 1, 0, 0): 2, (0, 0, 1, 0): 3, (0, 1, 1, 0): 4, (1, 2, 0, 0): 5, (1, 2, 1, 0): 6}
    (tmp_path / "s").write_bytes(struct.pack("<3f", 7, 8, 9) + struct.pack("<3II", 0, 4, 8, 3))
    assert sorted(r.value for r in tables.read_blocks(spark, str(tmp_path / "s"), "scalar").collect()) == [7, 8, 9]


def test_text_tables(spark, tmp_path):
    a = parse_args("# run\nnBin  100\n\nfunctionType 1 # global\nouter\n")
    assert a["nBin"] == "100" and a["missing"] == "" and a.integers("nBin") == (100,) and a["outer"] == ""
    (tmp_path / "p.txt").write_text("0,6.28\n0,0.1\n0,3.14\n0.1,0.3\n")
    assert [tuple(r) for r in tables.read_patches(spark, str(tmp_path / "p.txt")).collect()] == [(0, 0.0, 6.28, 0.0, 0.1), (1, 0.0, 3.14, 0.1, 0.3)]
    assert tables.read_patches(spark, "!", 20).count() == 20
    log = spark.createDataFrame([(1, 2, 0.5), (3, 4, 1.25e-3)], "block_id int, rv int, entropy double")
    tables.format_entropy_log(log).coalesce(1).write.text(str(tmp_path / "log"))
    assert sorted(map(tuple, tables.read_entropy_log(spark, str(tmp_path / "log")).collect())) == [(1, 2, 0.5), (3, 4, 0.00125)]
    geo = spark.createDataFrame([(0, 0, 0, 1, 2.5, None)], "time_step int, block_id int, dim int, i int, coord double, delta double")
    assert tables.geometry_text(geo).first().value == "2.500000 0.000000"


def test_stream_equals_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", (F.col("user_id") % 3).alias("block_id"), "value")
    last = spark.createDataFrame([("2030-01-01 00:00:00", 0, 1.0)], "ts string, block_id long, value double").withColumn("ts", F.to_timestamp("ts"))
    src = str(tmp_path / "in")
    events.coalesce(1).write.parquet(src)
    last.coalesce(1).write.mode("append").parquet(src)
    q = streaming.write_windows(spark.readStream.schema(events.schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "cp"), n_bins=50, lo=0.0, hi=500.0)
    q.awaitTermination(120)
    got = {(r.window_start, r.block_id): round(r.entropy, 9) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.window_start, r.block_id): round(r.entropy, 9) for r in streaming.windowed_entropy(events, 50, 0.0, 500.0).collect()}
    assert got == want and len(want) > 30


def test_steps_by_batch(spark, tmp_path):
    df = spark.createDataFrame([(t, b, float(v)) for t in range(2) for b in range(2) for v in range(8)], "time_step int, block_id int, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streaming.update_steps(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), 8, 0.0, 8.0)
    q.awaitTermination(120)
    assert [round(r.entropy, 6) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [3.0] * 4


def test_step_over_several_batches(spark, tmp_path):
    """A step's rows in two batches give the entropy of all of them; a step of the first batch alone stays."""
    schema = "time_step int, block_id int, value double"
    start = lambda: streaming.update_steps(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), 8, 0.0, 8.0).awaitTermination(120)
    spark.createDataFrame([(0, 0, float(v)) for v in range(4)] + [(1, 0, 1.5), (1, 0, 2.5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start()
    assert {(r.time_step, r.block_id): round(r.entropy, 6) for r in streaming.latest_steps(spark, str(tmp_path / "out")).collect()} == {(0, 0): 2.0, (1, 0): 1.0}
    spark.createDataFrame([(0, 0, float(v)) for v in range(4, 8)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start()
    assert {(r.time_step, r.block_id): round(r.entropy, 6) for r in streaming.latest_steps(spark, str(tmp_path / "out")).collect()} == {(0, 0): 3.0, (1, 0): 1.0}


def test_shared_folders(spark, tmp_path):
    """Folders are released with what is in them; without spark.checkpoint.dir only local mode has a stand-in."""
    from types import SimpleNamespace

    from entrofield.sources import files

    app = SimpleNamespace(applicationId="other", master="spark://host:7077", _jsc=spark.sparkContext._jsc)
    with pytest.raises(RuntimeError):
        files.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=app), "x")
    app = SimpleNamespace(applicationId="third", master="local[2]", _jsc=spark.sparkContext._jsc)
    one = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: f"file://{tmp_path}"), sparkContext=app, _jvm=spark._jvm)
    spark.range(3).write.parquet(files.shared_dir(one, "x"))
    assert len(list(tmp_path.iterdir())) == 1 and files.release(one) == 1 and not list(tmp_path.iterdir()) and files.release(one) == 0
