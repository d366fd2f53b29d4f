"""Document fingerprints by consistent weighted sampling; DataFrame functions only.

Terms are lower-cased words, weighted by their number in the text. For each of SAMPLES samples and each term, keyed hashes give r, c ~ Gamma(2, 1) and b ~
Uniform(0, 1); with weight S the term's value is ln a = ln c + r (b - 1 - floor(ln S / r + b)). The smallest ln a of all terms is the sample. Term and level
floor(...) fix the value, so two documents agree in a sample with probability sum min(S, T) / sum max(S, T), the generalised Jaccard similarity of their weights; the
likeness of two fingerprints is the share of samples that agree.

Texts are shuffled once, by id (a second time where the table of neighbours is too large to send); terms are counted and sampled where the text lies, and only the samples move on. To edit a text only the wanted prefix of the next
document travels.

Null and empty texts, and texts of blanks, have no terms: all their samples are one mark, and two of them agree in all. Rows with a null id have no place in the
order of ids: their next document is empty. Rows that share an id have the same next document: the next id's first row. A single id is its own next.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

SAMPLES = 24
#: Ids that one task puts in order.
BLOCK = 200_000
BITS = 24
#: Pairs of neighbours that are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def next_ids(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, next_id: the next larger id, the least after the largest. ids: distinct, not null, of any distribution.

    Ids are dealt by range into blocks of about BLOCK, and written so, since the ranges come from a sample. Within a block the next id is found by a window; a block's last id is followed by the
    first of the next block, found over one row per block.
    """
    n = ids.count()
    blocks = stored(ids.repartitionByRange(n // BLOCK + 1, "doc_id").withColumn("block", F.spark_partition_id()), path)
    inner = blocks.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("block").orderBy("doc_id")))
    firsts, w = blocks.groupBy("block").agg(F.min("doc_id").alias("first")), Window.orderBy("block")
    after = firsts.select("block", F.coalesce(F.lead("first").over(w), F.min("first").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("first"))
    last = inner.where("next_id is null").join(after, "block").select("doc_id", F.col("first").alias("next_id"))
    return inner.where("next_id is not null").select("doc_id", "next_id").unionByName(last)


def half(text: Column) -> Column:
    return F.floor(F.length(text) / 2).cast("int")


def wanted_prefixes(keyed: DataFrame, root: str) -> tuple[DataFrame, bool]:
    """doc_id, before, half of every pair of neighbours: how many code points doc_id must hand to the document before it. Ids and lengths only; also whether it is small."""
    lengths = stored(keyed.groupBy("doc_id").agg(F.max(half(F.col("text"))).alias("half")), f"{root}/lengths")
    order = next_ids(lengths.select("doc_id"), f"{root}/blocks")
    pairs = stored(lengths.join(order, "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"), "half"), f"{root}/order")
    return pairs, pairs.count() <= BROADCAST_ROWS


def edited(keyed: DataFrame, root: str) -> DataFrame:
    """doc_id, uid, next_id, text, edited_text: the last half of the code points replaced by the first as many of the next document.

    keyed: doc_id (not null), uid (unique), text. The prefixes are cut where the texts are read, if the table of what is wanted is small enough to be sent there, else after the exchange of
    the texts that the second join uses too.
    """
    wanted, small = wanted_prefixes(keyed, root)
    parts = keyed.join(F.broadcast(wanted) if small else wanted, "doc_id").select(F.col("before").alias("doc_id"), F.col("doc_id").alias("next_id"), "uid", F.expr("substring(text, 1, half)").alias("part"))
    first = parts.groupBy("doc_id", "next_id").agg(F.min_by("part", "uid").alias("part"))
    return keyed.join(first, "doc_id", "left").select("doc_id", "uid", "next_id", "text", edit(F.col("text"), F.col("part")).alias("edited_text"))


def edit(text: Column, part: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half(text)), F.substring(F.coalesce(part, F.lit("")), F.lit(1), half(text)))


def uniform(h: Column) -> Column:
    """(0, 1) from the low BITS of a hash."""
    return (h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("double") + 0.5) / float(1 << BITS)


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """ln a of a term in sample k."""
    h, g = F.xxhash64(F.lit(2 * k), term), F.xxhash64(F.lit(2 * k + 1), term)
    r = -F.log(uniform(h) * uniform(F.shiftright(h, BITS)))
    c = -F.log(uniform(g) * uniform(F.shiftright(g, BITS)))
    b = uniform(F.shiftrightunsigned(h, 40))
    return F.log(c) + r * (b - 1 - F.floor(log_weight / r + b))


def signatures(rows: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, uid, own, other, note: 32-bit samples of text and edited_text (null where a text has no words), and the row's facts: next id, length, digest.

    rows must be dealt by doc_id or uid, so that nothing is shuffled here. The facts go through the same aggregations as a third kind of text, so that texts are read once.
    """
    none = F.lit(None).cast("string")
    note = F.concat_ws(" ", F.coalesce(F.col("next_id").cast("string"), F.lit("-")), F.length("text").cast("string"), F.sha2(F.col("edited_text").cast("binary"), 256))
    kinds = [F.struct(F.lit(k).alias("kind"), t.alias("text"), n.alias("note")) for k, (t, n) in enumerate(((F.col("text"), none), (F.col("edited_text"), none), (F.lit("-"), note)))]
    each = rows.select("doc_id", "uid", F.explode(F.array(*kinds)).alias("v"))
    words = each.select("doc_id", "uid", "v.kind", "v.note", F.explode(F.split(F.lower("v.text"), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    keys = ["doc_id", "uid", "kind", "note"]
    terms = words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(F.log(F.count("*").cast("double")).alias("w"))
    least = terms.groupBy(*keys).agg(*[F.min(sample(F.col("term"), F.col("w"), k)).alias(f"s{k}") for k in range(samples)])
    short = least.select(*keys, F.array(*[F.hash(f"s{k}") for k in range(samples)]).alias("samples"))
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("samples")))  # noqa: E731  one row of each kind
    return short.groupBy("doc_id", "uid").agg(of(0).alias("own"), of(1).alias("other"), F.max("note").alias("note"))


def likeness(x: Column, y: Column) -> Column:
    same = F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, v: s + v)
    return same.cast("double") / F.size(x)


def hexed(samples: Column) -> Column:
    return F.lower(F.array_join(F.transform(samples, lambda v: F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def fingerprint_report(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    root = shared_dir(docs.sparkSession, "fingerprints")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = edited(rows.where("doc_id is not null").withColumn("uid", F.monotonically_increasing_id()), root)
    loose = rows.where("doc_id is null").withColumn("uid", -1 - F.monotonically_increasing_id()).repartition("uid")
    loose = loose.select("doc_id", "uid", F.lit(None).cast("long").alias("next_id"), "text", edit(F.col("text"), F.lit("")).alias("edited_text"))
    found = stored(signatures(keyed, samples).unionByName(signatures(loose, samples)), f"{root}/samples")
    fact = F.split("note", " ")
    facts = found.select("doc_id", "own", "other", F.expr("try_cast(split(note, ' ')[0] as bigint)").alias("next_id"), fact[1].cast("long").alias("n_chars"), fact[2].alias("edited_sha256"))
    mark = F.array_repeat(F.hash(F.lit("no words")), samples)
    after = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("next_id")).agg(F.min_by("own", "uid").alias("next"))
    out = facts.join(after, "next_id", "left")
    out = out.select("doc_id", "n_chars", "edited_sha256", *[F.coalesce(c, mark).alias(c) for c in ("own", "other", "next")])
    return out.select("doc_id", "n_chars", "edited_sha256", hexed(F.col("own")).alias("fingerprint"), hexed(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
