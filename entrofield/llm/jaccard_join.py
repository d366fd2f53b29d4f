"""N-gram Jaccard join: a grouped prefix join over word shingles, with its connected components.

Two documents link when their shingle sets have Jaccard similarity of at least 3/4. The result is exact: every test on a pair uses its whole sets.

1. Scan. Each document's set is hashed; documents with equal sets are one class from here on. A count sketch of fixed size adds up how often shingles occur.
2. Prefixes. A set's shingles are ordered by sketch count (rare first); two sets of similarity 3/4 share one of their first n - ceil(3n/4) + 1. Sets with equal
   prefixes and size are one group: a group sends its prefix once per batch. Shingles go to buckets in packed blobs; a bucket drops those of one group only and
   keeps lists of the others. Very frequent shingles bypass the buckets, so that no task gathers their lists.
3. Stars. In each list the most central set of a size range (whose prefix has the highest counts) is the hub; the others are compared with it only. A pair must share
   so many prefix shingles that the overlap 3/7 (n + m) can still be reached (the shingles outside the shorter prefix are all that can come on top).
4. Verification on whole sets, then components by minimum labels with pointer jumping.
5. Rest. Only pairs in a list that are still in different components are left. In a list with at most FEW sets outside its largest component, these are compared with all others of the
   list, where the shingle is among the first n - ceil(6n/7) + 1 of the smaller set (which suffice against larger sets); they are filtered and verified the same way.
6. Differences. In the other lists nobody is compared with everybody, but all with one pivot p. The symmetric difference is a metric and a link means |x ^ y| <= (n + m) / 7, so if x isn't
   linked to p and has the difference a = |x ^ p|, y has b, then a link of x and y needs (a + b - (n + m) / 7) / 2 common elements of the two differences: more than 3b/7, and more than none.
   So a prefix join of the differences finds it: their first elements in the sketch's order name new lists, and a pair is formed where enough elements are left in both from there on.
   Entries that no partner in their list can meet go first. What many near copies have in common so drops out, only edits that some of them share are compared, and no link between
   components is lost.

A link is decided on sets of 64-bit hashes, classes are 64-bit digests: two different ones agree with probability 2**-64.

Null and empty texts, and texts of blanks, have an empty set and link with nothing. A text with fewer than five words is one shingle. Rows with a null id take
part; a component's id is the smallest non-null id in it (null if there is none). Repeated rows give repeated results. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, shared_dir, slices, stored
from .shingles import digest, mix, shingles

SKETCH = 1 << 20
CHUNKS = 256
#: A shingle counts as very frequent from this count, plus four times the sketch's mean.
FREQUENT = 10_000
#: Sets outside a list's largest component that are compared with the whole list; where there are more, a pivot takes their place.
FEW = 32
#: Prefix shingles of a bucket, on average.
BUCKET = 1 << 19
#: Classes whose texts are fetched by broadcasting their ids (16 bytes each); more are fetched by a shuffle join.
BROADCAST_IDS = 2_000_000
SCAN = "doc_id long, n int, class long, chunk int, counts binary"
BLOB = "bucket int, blob binary"
DIFFERENCE = "list long, class long, pivot long, n int, a int, rem int, far boolean"
ENTRY = "list long, grp long, n int, prio int, core boolean, class long"


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def core_length(n: int) -> int:
    """Length that suffices against sets of at least the same size: there the overlap is at least 6n/7."""
    return n - (6 * n + 6) // 7 + 1


# ---------------------------------------------------------------- scan


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, np.int64)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in SCAN.split(", ")]
    for b in slices(batches):
        sets = [shingles(t) for t in b.column(1).to_pylist()]
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        counts += np.bincount((every & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], kinds[1]), pa.array([digest(s.tobytes()) for s in sets], kinds[2]), *none], names=names)
    parts = [zlib.compress(x.tobytes(), 1) if x.any() else None for x in counts.reshape(CHUNKS, -1)]
    at = [i for i, x in enumerate(parts) if x]
    none = [pa.nulls(len(at), k) for k in kinds[:3]]
    yield pa.RecordBatch.from_arrays([*none, pa.array(at, pa.int32()), pa.array([parts[i] for i in at], pa.binary())], names=names)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(zlib.decompress(data), np.int64)
            total[chunk] = total[chunk] + x if chunk in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["chunk", "counts"])


def sketch_of(scan: DataFrame) -> np.ndarray:
    """The summed sketch on the driver: SKETCH counts, whatever the input."""
    rows = scan.where("chunk is not null").select("chunk", "counts").repartition(16, "chunk").mapInArrow(_add_up, "chunk int, counts binary").collect()
    out = np.zeros((CHUNKS, SKETCH // CHUNKS), np.int64)
    for r in rows:
        out[r["chunk"]] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out.ravel()


# ---------------------------------------------------------------- prefixes


def pack(direct: bool, groups: np.ndarray, sizes: np.ndarray, prios: np.ndarray, token: np.ndarray, owner: np.ndarray, core: np.ndarray, member_group: np.ndarray, member_class: np.ndarray) -> bytes:
    wide = len(groups) > 1 << 16
    head = struct.pack("<??xxIII", direct, wide, len(groups), len(token), len(member_group))
    return b"".join([head, groups.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), prios.astype("<u2").tobytes(), token.astype("<u4").tobytes(), owner.astype("<u4" if wide else "<u2").tobytes(), core.astype("?").tobytes(), member_group.astype("<i8").tobytes(), member_class.astype("<i8").tobytes()])


def unpack(blob: bytes) -> tuple:
    direct, wide, g, p, m = struct.unpack_from("<??xxIII", blob)
    at, out = 16, []
    for kind, n in (("<i8", g), ("<i4", g), ("<u2", g), ("<u4", p), ("<u4" if wide else "<u2", p), ("?", p), ("<i8", m), ("<i8", m)):
        x = np.frombuffer(blob, kind, n, at)
        at += x.nbytes
        out.append(x)
    return direct, *out


def _prefixes(batches: Iterator[pa.RecordBatch], sketch, n_buckets: int) -> Iterator[pa.RecordBatch]:
    counts = sketch.value
    level = FREQUENT + 4 * counts.mean()
    groups: dict[int, tuple[int, int, np.ndarray]] = {}
    members: set[tuple[int, int]] = set()
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not groups:
            return
        ids = np.array(list(groups), np.int64)
        size, prio = np.array([g[0] for g in groups.values()]), np.array([g[1] for g in groups.values()])
        token = np.concatenate([g[2] for g in groups.values()])
        owner = np.repeat(np.arange(len(ids)), [len(g[2]) for g in groups.values()])
        core = np.concatenate([np.arange(len(g[2])) < core_length(g[0]) for g in groups.values()])
        frequent = counts[(token & np.uint64(SKETCH - 1)).astype(np.int64)] > level
        bucket = ((token >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
        mg, mc = np.array([g for g, _ in members], np.int64), np.array([c for _, c in members], np.int64)
        mb = (mg.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
        rows = []
        for direct in (False, True):
            pick = np.flatnonzero(frequent == direct)
            at = bucket[pick] if not direct else (ids[owner[pick]].view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            pick, at = pick[order], at[order]
            m_order = np.argsort(mb, kind="stable") if not direct else np.zeros(0, np.int64)
            m_at = mb[m_order]
            used_buckets = np.union1d(at, m_at)
            edge, m_edge = (np.stack([np.searchsorted(v, used_buckets, side) for side in ("left", "right")], 1).tolist() for v in (at, m_at))
            for k, (lo, hi), (m_lo, m_hi) in zip(used_buckets.tolist(), edge, m_edge):
                part, m = pick[lo:hi], m_order[m_lo:m_hi]
                if len(part) or len(m):
                    used, own = np.unique(owner[part], return_inverse=True)
                    # a direct blob's lists are named by their own buckets
                    low = (token[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    if direct:
                        for b in np.unique(bucket[part]):
                            sub = bucket[part] == b
                            u2, o2 = np.unique(own[sub], return_inverse=True)
                            rows.append((k, struct.pack("<i", b) + pack(True, ids[used[u2]], size[used[u2]], prio[used[u2]], low[sub], o2, core[part][sub], mg[:0], mc[:0])))
                    else:
                        rows.append((k, struct.pack("<i", k) + pack(False, ids[used], size[used], prio[used], low, own, core[part], mg[m], mc[m])))
        groups.clear()
        members.clear()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

    for b in slices(batches):
        for t in b.column(0).to_pylist():
            s = shingles(t)
            n = len(s)
            if not n:
                continue
            rank = counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
            first = s[np.lexsort((s, rank))[: prefix_length(n)]]
            g, c = digest(np.sort(first).tobytes(), n.to_bytes(8, "little")), digest(s.tobytes())
            members.add((g, c))
            if g not in groups:
                central = np.log2(1.0 + counts[(first & np.uint64(SKETCH - 1)).astype(np.int64)]).mean()
                groups[g] = n, 65535 - min(65535, int(central * 1500)), first
                held += len(first)
        if held > 500_000 or len(members) > 100_000:
            yield from flush()
            held = 0
    yield from flush()


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of lists with more than one group, and (group, class) members, of one bucket after another."""
    names, kinds = [c.split()[0] for c in ENTRY.split(", ")], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]

    def entries(name: np.ndarray, g: np.ndarray, n: np.ndarray, prio: np.ndarray, core: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(g), pa.array(n), pa.array(prio.astype(np.int32)), pa.array(core), pa.nulls(len(g), pa.int64())], names=names)

    def close(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        name, g, n, prio, core = (np.concatenate([p[i] for p in parts]) for i in range(5))
        order = np.lexsort((g, name))
        name, g, n, prio, core = name[order], g[order], n[order], prio[order], core[order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (g[1:] != g[:-1])
        name, g, n, prio, core = name[new], g[new], n[new], prio[new], core[new]
        same = name[1:] == name[:-1]
        shared = np.zeros(len(name), bool)
        shared[1:] |= same
        shared[:-1] |= same
        if shared.any():
            yield entries(name[shared], g[shared], n[shared], prio[shared], core[shared])

    bucket, parts = None, []
    for b in batches:
        for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k != bucket:
                if parts:
                    yield from close(parts)
                bucket, parts = k, []
            (high,) = struct.unpack_from("<i", blob)
            direct, ids, size, prio, low, own, core, mg, mc = unpack(blob[4:])
            part = (np.int64(high) << np.int64(32)) | low.astype(np.int64), ids[own], size[own], prio[own], core
            if direct:
                yield entries(*part)
            elif len(low):
                parts.append(part)
            if len(mg):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(mg), kinds[0]), pa.array(mg), pa.nulls(len(mg), kinds[2]), pa.nulls(len(mg), kinds[3]), pa.nulls(len(mg), kinds[4]), pa.array(mc)], names=names)
    if parts:
        yield from close(parts)


# ---------------------------------------------------------------- verification


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class and its sorted shingles."""
    for b in slices(batches):
        sets = [shingles(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([digest(s.tobytes()) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["class", "shingles"])


def linked(n: int, m: int, common: int) -> bool:
    return 100 * common >= 75 * (n + m - common)


def merged(x: bytes, y: bytes) -> np.ndarray:
    """Elements of two sets in order; common ones occur twice."""
    both = np.concatenate([np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")])
    both.sort()
    return both


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        ok = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            both = merged(x, y)
            ok.append(linked(len(x) // 8, len(y) // 8, int((both[1:] == both[:-1]).sum())))
        yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def first_differences(n: int, m: int, common: int) -> tuple[bool, int]:
    """Whether a set of n elements is linked to its pivot of m, and how many first elements of their difference suffice for a join (see 6. above)."""
    a = n + m - 2 * common
    if linked(n, m, common):
        return True, a - 3 * a // 7
    return False, a - max(1, -(-(7 * a - n - m) // 14)) + 1


def _differences(batches: Iterator[pa.RecordBatch], sketch) -> Iterator[pa.RecordBatch]:
    """For pairs (class, pivot): a row without a list if they link; and a row for each of the first elements of their difference."""
    counts, kinds = sketch.value, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    names = [c.split()[0] for c in DIFFERENCE.split(", ")]
    for b in slices(batches):
        parts: list[list] = []
        for c, p, x, y in zip(*[b.column(i).to_pylist() for i in range(4)]):
            n, m, both = len(x) // 8, len(y) // 8, merged(x, y)
            twice = both[1:] == both[:-1]
            link, first = first_differences(n, m, int(twice.sum()))
            alone = np.ones(len(both), bool)
            alone[1:] &= ~twice
            alone[:-1] &= ~twice
            diff = both[alone]
            a = len(diff)
            diff = diff[np.lexsort((diff, counts[(diff & np.uint64(SKETCH - 1)).astype(np.int64)]))][:first]
            name = mix(diff ^ mix(np.array([p], np.int64).view(np.uint64))).view(np.int64)
            name, rem, none = (np.insert(name, 0, 0), np.insert(a - np.arange(len(name)), 0, 0), [True]) if link else (name, a - np.arange(len(name)), [])
            k = len(name)
            parts.append([name, np.full(k, c), np.full(k, p), np.full(k, n), np.full(k, a), rem, np.full(k, not link), np.array(none + [False] * (k - len(none)), bool)])
        if parts:
            *cols, none = [np.concatenate(v) for v in zip(*parts)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], kinds[0], mask=none), *[pa.array(v, t) for v, t in zip(cols[1:], kinds[1:])]], names=names)


def with_sets(pairs: DataFrame, docs: DataFrame, reps: DataFrame, path: str) -> DataFrame:
    """pairs (a, b, ...) of classes with their sets x and y. Texts are read again for the classes in question only, one document of each. The sets are written once, so that both joins read
    plain rows and Spark can split those of a frequent hub.
    """
    need = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(reps, "class").select(F.col("doc_id").alias("rep")).distinct()
    if need.count() <= BROADCAST_IDS:
        need = F.broadcast(need)
    texts = docs.join(need, docs["doc_id"].eqNullSafe(need["rep"]), "left_semi").select("text")
    sets = stored(texts.mapInArrow(_sets, "class long, shingles binary").dropDuplicates(["class"]), path)
    return pairs.join(sets.withColumnsRenamed({"class": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"class": "b", "shingles": "y"}), "b")


def verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, path: str) -> DataFrame:
    """Pairs (a, b) of classes that link."""
    return with_sets(pairs, docs, reps, path).select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")


def enough(n: str, m: str, core: bool = False) -> F.Column:
    """Fewest common shingles among the first ones of sets of sizes n and m that can link: the overlap needed less what can lie beyond."""

    def beyond(c: str, other: str) -> F.Column:
        short = F.lit(core) & (F.col(c) <= F.col(other))
        return F.when(short, F.expr(f"(6 * {c} + 6) div 7 - 1")).otherwise(F.expr(f"(3 * {c} + 3) div 4 - 1"))

    return F.expr(f"(3 * ({n} + {m}) + 6) div 7") - F.greatest(beyond(n, m), beyond(m, n))


def similar_size(n: str, m: str) -> F.Column:
    return F.least(n, m) * 4 >= F.greatest(n, m) * 3


# ---------------------------------------------------------------- components


def components(spark: SparkSession, edges: DataFrame, reps: DataFrame, root: str) -> DataFrame:
    """node and label of every node with an edge; the label is that of the component's first class: (no id, doc_id, class), smallest id first, null last.

    Each round takes the least label around, then jumps to that label's label. Only labels that have moved on themselves can be jumped from: so few that they are
    sent to all tasks, where they aren't, they are joined.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{root}/edges")
    own = both.select(F.col("a").alias("node")).distinct().join(reps.withColumnRenamed("class", "node"), "node").select("node", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("node").alias("class")).alias("label"))
    labels = stored(own, f"{root}/labels-0")
    for i in range(1, 200):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = stored(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), f"{root}/least-{i}")
        if not least.where("label <> was").limit(1).count():
            return least.select("node", "label")
        roots = least.select(F.col("label.class").alias("node")).distinct()
        moved = least.join(roots, "node").where("label.class <> node").select(F.col("node").alias("of"), F.col("label").alias("to"))
        if moved.count() <= BROADCAST_IDS:
            moved = F.broadcast(moved)
        labels = least.join(moved, F.col("label.class") == F.col("of"), "left").select("node", F.coalesce("to", "label").alias("label"))
    raise RuntimeError("components did not settle")


# ---------------------------------------------------------------- the join


def star_pairs(entries: DataFrame) -> DataFrame:
    """Each entry with its list's hub in its size range; a < b."""
    e = entries.withColumn("range", F.floor(F.log("n") / F.log(F.lit(4 / 3))))
    hub = e.groupBy("list", "range").agg(F.min(F.struct("prio", "class", "n", "grp")).alias("hub"))
    pairs = e.join(hub, ["list", "range"]).where((F.col("class") != F.col("hub.class")) & ((F.col("grp") != F.col("hub.grp")) | (F.col("weight") > 1)))
    first = F.col("class") < F.col("hub.class")
    return pairs.select(*[F.when(first, x).otherwise(y).alias(k) for k, x, y in (("a", F.col("class"), F.col("hub.class")), ("b", F.col("hub.class"), F.col("class")), ("n", F.col("n"), F.col("hub.n")), ("m", F.col("hub.n"), F.col("n")))], "weight")


def mixed_lists(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """Entries of lists of more than one component, with their component, the list's largest, how many are outside it and the list's pivot: its most central class (the smallest, if the
    entries don't tell).
    """
    central = F.struct("prio", "class") if "prio" in entries.columns else F.struct("class")
    e = entries.join(comps.select(F.col("node").alias("class"), F.col("label.class").alias("comp")), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    sizes = e.groupBy("list", "comp").agg(F.count("*").alias("k"), F.min(central).alias("centre"))
    mixed = sizes.groupBy("list").agg(F.max(F.struct("k", "comp"))["comp"].alias("big"), (F.sum("k") - F.max("k")).alias("outside"), F.min("centre")["class"].alias("pivot"), F.count("*").alias("kinds")).where("kinds > 1")
    return e.join(mixed.drop("kinds"), "list")


def crossed(e: DataFrame) -> DataFrame:
    """x and y of a list in different components: those outside its largest component with all others."""
    x, y = e.where("comp <> big").alias("x"), e.alias("y")
    pairs = x.join(y, F.col("x.list") == F.col("y.list")).where("x.comp <> y.comp and (y.comp = y.big or x.class < y.class)")
    return pairs.where(similar_size("x.n", "y.n"))


def cross_pairs(e: DataFrame) -> DataFrame:
    """Pairs of prefix lists; a < b."""
    # a pair shares a shingle of the smaller set's core and the larger one's prefix, of both cores if they are equal in size
    pairs = crossed(e).where(F.expr("(x.core or x.n > y.n) and (y.core or y.n > x.n) and (x.grp <> y.grp or x.weight > 1)"))
    first = F.col("x.class") < F.col("y.class")
    return pairs.select(*[F.when(first, F.col(p)).otherwise(F.col(q)).alias(k) for k, p, q in (("a", "x.class", "y.class"), ("b", "y.class", "x.class"), ("n", "x.n", "y.n"), ("m", "y.n", "x.n"))], F.col("x.weight").alias("weight"))


def alive(differ: DataFrame) -> DataFrame:
    """Entries from which on enough elements are left for a pair with the nearest, largest set that their list could have."""
    least = differ.groupBy("list").agg(F.min("a").alias("nearest"), F.max("n").alias("largest"))
    enough_left = F.expr("14 * rem >= 7 * (a + nearest) - n - least(largest, (4 * n) div 3)")
    return differ.join(least, "list").where(enough_left).select(differ.columns)


def difference_pairs(e: DataFrame) -> DataFrame:
    """Pairs of lists of differences, at the first common element of which enough can follow; a < b."""
    pairs = crossed(e).where(F.expr("(x.far or y.far) and 14 * least(x.rem, y.rem) >= 7 * (x.a + y.a) - x.n - y.n"))
    return pairs.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def likely(pairs: DataFrame, core: bool = False) -> DataFrame:
    """Pairs with enough common prefix shingles; with core, those were counted in the smaller set's core only."""
    return pairs.groupBy("a", "b", "n", "m").agg(F.sum("weight").alias("common")).where(similar_size("n", "m") & (F.col("common") >= enough("n", "m", core))).select("a", "b")


def resolve(docs: DataFrame) -> DataFrame:
    """doc_id, n (shingles), class (documents with equal sets) and label (of the component, see components()) of every row; class and label are null where n is 0."""
    spark = docs.sparkSession
    bounded_batches(spark)
    root = shared_dir(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scan = stored(docs.mapInArrow(_scan, SCAN), f"{root}/scan")
    sketch = spark.sparkContext.broadcast(sketch_of(scan))
    rows = scan.where("n is not null").select("doc_id", "n", "class")
    n_tokens = rows.agg(F.sum(F.expr("n - (3 * n + 3) div 4 + 1"))).first()[0] or 0
    n_buckets = max(12, n_tokens // BUCKET)
    parts = max(min(n_buckets, 50_000), spark.sparkContext.defaultParallelism)  # a task takes its buckets one after another
    blobs = docs.select("text").mapInArrow(lambda it: _prefixes(it, sketch, n_buckets), BLOB)
    found = stored(blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_lists, ENTRY), f"{root}/lists")
    members = found.where("class is not null").select("grp", "class").distinct()
    listed = found.where("class is null").select("list", "grp", "n", "prio", "core").distinct()
    shared = listed.join(members, "grp").withColumn("weight", F.lit(1))
    # groups of several classes are lists too; their members share the whole prefix
    crowds = members.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").select("grp")
    size = rows.where("n > 0").groupBy("class").agg(F.max("n").alias("n"))
    inner = members.join(crowds, "grp").join(size, "class").select(F.xxhash64("grp", F.lit("group")).alias("list"), "grp", "n", F.lit(0).alias("prio"), F.lit(True).alias("core"), "class", F.greatest(F.lit(2), F.expr("n - (3 * n + 3) div 4 + 1")).alias("weight"))
    entries = stored(shared.select(inner.columns).unionByName(inner), f"{root}/entries")
    reps = stored(rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id")), f"{root}/reps")

    def joined(edges: DataFrame, more: DataFrame, comps: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
        if not more.limit(1).count():
            return edges, comps
        edges = edges.unionByName(more)
        return edges, components(spark, edges, reps, path)

    tried = stored(likely(star_pairs(entries)), f"{root}/stars")
    edges = stored(verify(tried, docs, reps, f"{root}/star-sets"), f"{root}/star-links")
    comps = components(spark, edges, reps, f"{root}/first")

    lists = stored(mixed_lists(entries, comps), f"{root}/mixed")
    short, long = lists.where(F.col("outside") <= FEW), lists.where(F.col("outside") > FEW)
    rest = stored(likely(cross_pairs(short), core=True).join(tried, ["a", "b"], "left_anti"), f"{root}/rest")
    more = stored(verify(rest, docs, reps, f"{root}/rest-sets"), f"{root}/rest-links")
    tried = tried.unionByName(rest)
    against = stored(long.where("class <> pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct(), f"{root}/against")
    if not against.limit(1).count():
        edges, comps = joined(edges, more, comps, f"{root}/second")
    else:
        differ = with_sets(against, docs, reps, f"{root}/pivot-sets").select("a", "b", "x", "y").mapInArrow(lambda it: _differences(it, sketch), DIFFERENCE)
        differ = stored(differ, f"{root}/differences")
        more = more.unionByName(differ.where("list is null").select(F.col("class").alias("a"), F.col("pivot").alias("b")))
        edges, comps = joined(edges, more, comps, f"{root}/second")
        left = stored(difference_pairs(mixed_lists(alive(differ.where("list is not null")), comps)).join(tried, ["a", "b"], "left_anti"), f"{root}/left")
        last = stored(verify(left, docs, reps, f"{root}/left-sets"), f"{root}/left-links")
        edges, comps = joined(edges, last, comps, f"{root}/third")

    named = reps.join(comps.withColumnRenamed("node", "class"), "class", "left")
    named = named.select("class", F.coalesce("label", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "class")).alias("label"))
    full = rows.where("n > 0").join(named, "class").select("doc_id", "n", "class", "label")
    return full.unionByName(rows.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("class"), F.lit(None).cast(full.schema["label"].dataType).alias("label")))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (documents with equal sets), component_id of every row."""
    own = F.when(F.col("n") > 0, F.col("label.doc_id")).otherwise(F.col("doc_id"))
    return resolve(docs).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class", own.alias("component_id"))


def _with_class(batches: Iterator[pa.RecordBatch], at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = [shingles(t) for t in b.column(at).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([digest(s.tobytes()) if len(s) else None for s in sets], pa.int64())], names=names)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that with the smallest id (null last), of these that with the smallest class; one of rows that agree in both. Rows without words all stay.

    Where an id has one row, it is enough to know which ids go. Rows that share an id, and those without one, are told apart by their texts, which are read once more for them.
    """
    bounded_batches(docs.sparkSession)
    path, names = shared_dir(docs.sparkSession, "kept"), docs.columns
    found = stored(resolve(docs).select("doc_id", "class", "label"), path)
    ids = found.groupBy("doc_id").agg(F.count("*").alias("k"), F.first("class").alias("class"), F.first("label").alias("label"))
    single = F.col("k").eqNullSafe(1) & F.col("doc_id").isNotNull()
    gone = ids.where(single & (F.expr("class is not null and (class <> label.class or doc_id <> label.doc_id)"))).select(F.col("doc_id").alias("_id"))
    shared = ids.where(~single).select(F.col("doc_id").alias("_id"))
    if ids.where("k > 1 or doc_id is null or doc_id <> label.doc_id").count() <= BROADCAST_IDS:  # bounds both tables
        gone, shared = F.broadcast(gone), F.broadcast(shared)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = F.col(f"c{names.index('doc_id')}").cast("long")
    clear = plain.join(gone, key.eqNullSafe(F.col("_id")), "left_anti").join(shared, key.eqNullSafe(F.col("_id")), "left_anti")
    if not shared.limit(1).count():
        return clear.toDF(*names)
    at, classed = names.index("text"), [*plain.columns, "class"]
    schema = T.StructType([*plain.schema.fields, T.StructField("class", T.LongType())])
    rows = plain.join(shared, key.eqNullSafe(F.col("_id")), "left_semi").mapInArrow(lambda it: _with_class(it, at, classed), schema)
    least = found.where("class = label.class and doc_id <=> label.doc_id").select(F.col("doc_id").alias("_id"), F.col("class").alias("_class")).distinct()
    kept = rows.join(least, key.eqNullSafe(F.col("_id")) & (F.col("class") == F.col("_class")), "left_semi")
    order = F.xxhash64(*[f"c{i}" for i, f in enumerate(docs.schema.fields) if isinstance(f.dataType, T.AtomicType)])
    one = kept.groupBy(key.alias("_id"), "class").agg(F.min_by(F.struct(*plain.columns), order).alias("row")).select("row.*")
    return clear.unionByName(one).unionByName(rows.where("class is null").drop("class")).toDF(*names)
