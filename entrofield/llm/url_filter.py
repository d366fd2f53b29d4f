"""URL filter: host and path rules, and for the rest a character language-model ratio. DataFrame functions only.

Model: the URL in lower case, mapped to an alphabet of SYMBOLS characters, with start and end marks. Two variable-order Markov models, one for accepted and one for rejected
URLs, predict each character from its longest context (at most ORDER characters) that the labelled URLs have at least LEAST times:
p_k(c | h) = (n(hc) + BETA * p_{k-1}(c | h')) / (n(h) + BETA), where h' drops the oldest character and p_{-1} is uniform. A context with enough evidence has so in all its ends, so
the kept contexts are a tree. All of them are kept, however many they are.
Score: mean over characters of log p_accept - log p_reject (in whole millionths), so long URLs don't win by length. The threshold is calibrated on a fold of the labelled URLs that the
models of that step haven't seen: the score with the best balanced accuracy.

Counts are aggregated and the tree is built level by level on the executors; only a histogram of the contexts' counts and the threshold's steps reach the driver. A context keeps, for
each character, how much it changes the log ratio of the next shorter one, so that a URL's score is a sum over all its contexts that are in the tree: one join with the broadcast tree
and one aggregation, whose map side leaves one row per URL. Of a tree of more than CONTEXTS contexts only the most frequent ones are broadcast (as many as have the least power of two times
LEAST occurrences that leaves at most CONTEXTS); what the URLs have of other contexts is joined with the rest of the tree by a shuffle, and adds to the same sum.

URLs that a rule accepts or rejects are the labelled ones. A null URL, or one without "://", has an empty host and path and is scored as text (null as an empty
text). Without labelled URLs of both kinds all ratios are 0 and every URL is allowed. Repeated rows are judged alike and count in training as often as they occur.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Characters by number; 0 is the mark before and after a URL, the last stands for all others.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0123456789./-_?=&:#%\u0000"
SYMBOLS = len(ALPHABET)
ORDER = 5
BETA = 4.0
#: Least count of a context, and the most contexts that are broadcast.
LEAST, CONTEXTS = 8, 50_000
#: Contexts are numbered within their order; the order stands above.
LEVEL = 1 << 40
FOLDS = 5
#: Scores are counted in steps of 1/STEPS between -SPAN and SPAN for the threshold.
STEPS, SPAN = 50, 4


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def codes(url: Column) -> Column:
    """Symbol numbers of a URL between ORDER marks and one mark, as an array of ints."""
    low = F.lower(F.coalesce(url, F.lit("")))
    # strangers become one symbol, then each character its place in the alphabet
    known = F.regexp_replace(low, r"(?s)[^a-z0-9./\-_?=&:#%]", "\u0000")
    marked = F.concat(F.lit("^" * ORDER), known, F.lit("^"))
    return F.transform(F.split(marked, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def contexts(s: Column) -> Column:
    """(id, c) of every character and every order: the number of the context before it, in base SYMBOLS, and the character. s must be a column, not an expression: it is read per character."""

    def at(i: Column) -> Column:
        number, out = F.lit(0).cast("long"), []
        for k in range(ORDER + 1):
            if k:
                number = number + F.get(s, i - 1 - k).cast("long") * F.lit(SYMBOLS ** (k - 1))
            out.append(F.struct((number + F.lit(k * LEVEL)).alias("id"), F.get(s, i - 1).alias("c")))
        return F.array(*out)

    return F.flatten(F.transform(F.sequence(F.lit(ORDER + 1), F.size(s)), at))


def context_counts(labelled: DataFrame) -> DataFrame:
    """id, n, a, r of the contexts with enough evidence and the empty one: how often labelled URLs have it, and arrays of how often each character follows in accepted and rejected ones."""
    each = labelled.withColumn("codes", codes(F.col("url"))).select("allow", F.explode(contexts(F.col("codes"))).alias("x"))
    grams = each.groupBy("x.id", "x.c").agg(F.sum(F.col("allow").cast("long")).alias("a"), F.sum((~F.col("allow")).cast("long")).alias("r"))
    by = grams.groupBy("id").agg(F.sum(F.col("a") + F.col("r")).alias("n"), F.map_from_entries(F.collect_list(F.struct("c", F.struct("a", "r")))).alias("next"))
    by = by.where((F.col("n") >= LEAST) | (F.col("id") == 0))
    every = F.sequence(F.lit(0), F.lit(SYMBOLS - 1))
    count = lambda name: F.transform(every, lambda c: F.coalesce(F.element_at("next", c.cast("int"))[name], F.lit(0).cast("long")))
    return by.select("id", "n", count("a").alias("a"), count("r").alias("r"))


def evidence(counts: DataFrame) -> int:
    """Least count of a context that is broadcast; LEAST if all are."""
    level = F.floor(F.log2(F.col("n") / LEAST))
    rows = counts.where(F.col("n") >= LEAST).groupBy(level.alias("level")).count().collect()  # as many as a count has bits
    least, often = 0, sum(r["count"] for r in rows)
    while often > CONTEXTS:
        often -= sum(r["count"] for r in rows if r["level"] == least)
        least += 1
    return LEAST << least


def fit(labelled: DataFrame, path: str) -> tuple[DataFrame, DataFrame | None]:
    """id, change: the contexts with the change of the log ratio for each character, first those to broadcast, then the rest or None; no rows without URLs of both kinds."""
    counts = stored(context_counts(labelled), f"{path}/counts")
    both = F.col("id").eqNullSafe(0) & (F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x) > 0) & (F.aggregate("r", F.lit(0).cast("long"), lambda s, x: s + x) > 0)
    if not counts.where(both).limit(1).count():
        return counts.limit(0).select("id", F.col("a").alias("change")), None
    least = evidence(counts)
    flat = F.array_repeat(F.lit(1.0 / SYMBOLS), SYMBOLS)
    out, shorter = None, None
    for k in range(ORDER + 1):
        own = counts.where((F.col("id") >= k * LEVEL) & (F.col("id") < (k + 1) * LEVEL))
        if not k:
            level = own.withColumns({"pa": flat, "pr": flat, "was": F.array_repeat(F.lit(0).cast("long"), SYMBOLS)})
        else:
            own = own.withColumn("up", (F.col("id") - k * LEVEL) % F.lit(SYMBOLS ** (k - 1)) + (k - 1) * LEVEL)
            level = own.join(shorter if least > LEAST else F.broadcast(shorter), "up")  # at most CONTEXTS rows are broadcast

        def smooth(n: str, p: str) -> Column:
            total = F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s + x)
            return F.zip_with(n, p, lambda x, q: (x + BETA * q) / (total + BETA))

        level = level.select("id", "n", smooth("a", "pa").alias("pa"), smooth("r", "pr").alias("pr"), "was")
        level = level.withColumn("ratio", F.zip_with("pa", "pr", lambda x, y: F.round((F.log(x) - F.log(y)) * 1e6).cast("long")))
        level = stored(level.select("id", "n", "pa", "pr", "ratio", F.zip_with("ratio", "was", lambda x, y: x - y).alias("change")), f"{path}/level-{k}")
        shorter = level.select(F.col("id").alias("up"), "pa", "pr", F.col("ratio").alias("was"))
        out = level.select("id", "n", "change") if out is None else out.unionByName(level.select("id", "n", "change"))
    often = (F.col("n") >= least) | (F.col("id") == 0)
    return out.where(often).select("id", "change"), out.where(~often).select("id", "change") if least > LEAST else None


def scored(df: DataFrame, tree: tuple[DataFrame, DataFrame | None], path: str) -> DataFrame:
    """df (columns of any type that can be grouped by, with url) and its `score`."""
    often, rest = tree
    keys = [*df.columns, "row", "length"]
    df = df.withColumn("row", F.monotonically_increasing_id())
    if rest is not None:
        df = stored(df, path)  # both joins below must number the rows alike
    each = df.withColumn("codes", codes(F.col("url"))).withColumn("length", F.size("codes") - ORDER)
    each = each.select(*keys, F.explode(contexts(F.col("codes"))).alias("x")).select(*keys, "x.id", "x.c")
    change = F.sum(F.get("change", F.col("c")))
    total = each.join(F.broadcast(often), "id", "left").groupBy(*keys).agg(change.alias("total"))
    if rest is not None:
        others = each.select("row", "id", "c").join(F.broadcast(often.select("id")), "id", "left_anti").join(rest, "id").groupBy("row").agg(change.alias("more"))
        total = total.join(others, "row", "left").withColumn("total", F.coalesce("total", F.lit(0)) + F.coalesce("more", F.lit(0))).drop("more")
    return total.withColumn("score", F.floor(F.coalesce("total", F.lit(0)) / F.col("length")) / 1e6).drop("row", "length", "total")


def threshold(held: DataFrame, tree: tuple[DataFrame, DataFrame | None], path: str) -> float:
    """Score with the best balanced accuracy on held-out labelled URLs; scores are counted in a fixed number of steps."""
    step = F.greatest(F.lit(-SPAN * STEPS), F.least(F.lit(SPAN * STEPS), F.floor(F.col("score") * STEPS))).alias("step")
    rows = sorted((r["step"], r["a"], r["r"]) for r in scored(held, tree, path).groupBy(step).agg(F.sum(F.col("allow").cast("long")).alias("a"), F.sum((~F.col("allow")).cast("long")).alias("r")).collect())
    accept, reject = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not accept or not reject:
        return 0.0
    best, below_a, below_r = (-1.0, 0.0, 0.0), 0, 0
    for step_at in range(-SPAN * STEPS, SPAN * STEPS + 1):
        quality = (1 - below_a / accept) + below_r / reject
        if (quality, -abs(step_at)) > best[:2]:
            best = quality, -abs(step_at), step_at / STEPS
        for s, a, r in rows:
            if s == step_at:
                below_a, below_r = below_a + a, below_r + r
    return best[2]


def oracle_sql(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """judge() in DuckDB SQL, for tables with labelled URLs of both kinds in either fold."""
    n, known = SYMBOLS, ALPHABET[1:-1]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in longest]
    case = lambda at: "CASE " + " ".join(f"WHEN {f} THEN '{at(r)}'" for f, r in zip(fits, longest)) + " END"

    def model(name: str, where: str) -> str:
        """Table `name`(id, c, change) from the labelled contexts that satisfy `where`."""
        out = [f"{name}_c AS (SELECT id, c, sum(allow::INT) AS a, sum((NOT allow)::INT) AS r FROM grams WHERE {where} GROUP BY ALL)", f"{name}_n AS (SELECT id, sum(a) AS a, sum(r) AS r FROM {name}_c GROUP BY id)"]
        out.append(f"{name}_k AS (SELECT k.id, k.a AS na, k.r AS nr, t.c, coalesce(x.a, 0) AS a, coalesce(x.r, 0) AS r FROM (SELECT * FROM {name}_n WHERE id = 0 OR a + r >= {LEAST}) k CROSS JOIN (SELECT unnest(range({n})) AS c) t LEFT JOIN {name}_c x ON x.id = k.id AND x.c = t.c)")
        for k in range(ORDER + 1):
            p = lambda x: f"({x} + {BETA} * " + (f"l.p{x})" if k else f"(1.0::DOUBLE / {n}))") + f" / (n{x} + {BETA})"  # noqa: E731, B023
            join = f" JOIN {name}_p{k - 1} l ON l.c = x.c AND l.id = (x.id - {k * LEVEL}) % {n ** (k - 1)} + {(k - 1) * LEVEL}" if k else ""
            was = "l.ratio" if k else "0"
            out.append(f"{name}_p{k} AS (SELECT *, CAST(round((ln(pa) - ln(pr)) * 1000000) AS BIGINT) AS ratio FROM (SELECT x.id, x.c, {p('a').replace('(a ', '(x.a ')} AS pa, {p('r').replace('(r ', '(x.r ')} AS pr, {was} AS was FROM {name}_k x{join} WHERE x.id >= {k * LEVEL} AND x.id < {(k + 1) * LEVEL}))")
        return ", ".join([*out, f"{name} AS (" + " UNION ALL ".join(f"SELECT id, c, ratio - was AS change FROM {name}_p{k}" for k in range(ORDER + 1)) + ")"])

    at = ", ".join("{" + f"'id': {k * LEVEL}" + "".join(f" + s[i - {j}] * {n ** (j - 1)}" for j in range(1, k + 1)) + ", 'c': s[i]}" for k in range(ORDER + 1))
    score = lambda model_, source: f"SELECT {source}.row, floor(coalesce(sum(change), 0) / any_value(len)) / 1000000 AS score FROM {source} LEFT JOIN {model_} USING (id, c) GROUP BY {source}.row"
    return f"""
        WITH u AS (SELECT row_number() OVER () AS row, page_id, url, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
        h AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        f AS (SELECT *, {case(lambda r: r[0] + r[1])} AS rule, {case(lambda r: r[2])} AS fixed, CAST('0x' || substr(md5(url), 1, 6) AS BIGINT) % {FOLDS} AS fold FROM h),
        c AS (SELECT *, list_concat(list_concat([{", ".join("0" * ORDER)}], CASE WHEN coalesce(url, '') = '' THEN [] ELSE list_transform(string_split(lower(url), ''), lambda x: CASE WHEN instr('{known}', x) > 0 THEN instr('{known}', x) ELSE {n - 1} END) END), [0]) AS s FROM f),
        each AS (SELECT row, fixed, fold, len, x.id, x.c FROM (SELECT row, fixed, fold, len(s) - {ORDER} AS len, unnest(flatten(list_transform(range({ORDER + 1}, len(s) + 1), lambda i: [{at}]))) AS x FROM c)),
        grams AS (SELECT id, c, fold, fixed = 'allow' AS allow FROM each WHERE fixed IS NOT NULL),
        {model("part", "fold > 0")}, {model("full_", "true")},
        held AS (SELECT * FROM each WHERE fixed IS NOT NULL AND fold = 0), hs AS ({score("part", "held")}),
        k AS (SELECT least(greatest(floor(score * {STEPS}), {-SPAN * STEPS}), {SPAN * STEPS}) AS step, (fixed = 'allow')::INT AS a, (fixed <> 'allow')::INT AS r FROM hs JOIN f USING (row)),
        q AS (SELECT t.step, (1 - coalesce(sum(a) FILTER (k.step < t.step), 0) / (SELECT sum(a) FROM k)) + coalesce(sum(r) FILTER (k.step < t.step), 0) / (SELECT sum(r) FROM k) AS quality FROM (SELECT unnest(range({-SPAN * STEPS}, {SPAN * STEPS + 1})) AS step) t, k GROUP BY t.step),
        cut AS (SELECT step / {STEPS} AS cut FROM q ORDER BY quality DESC, abs(step), step LIMIT 1), sc AS ({score("full_", "each")})
        SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict, score FROM f JOIN sc USING (row), cut
    """


def judge(pages: DataFrame, key: str = "page_id", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """key, host, path, rule, verdict, score of every row."""
    url = F.col("url").cast("string")
    host, path = host_path(url)
    rows = pages.select(F.col(key), url.alias("url"), host.alias("host"), path.alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    labelled = rows.where("fit is not null").select("url", (F.col("fit.verdict") == "allow").alias("allow"), (F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 6), 16, 10).cast("long") % FOLDS).alias("fold"))
    root = shared_dir(pages.sparkSession, "urls")
    cut = threshold(labelled.where("fold = 0"), fit(labelled.where("fold > 0"), f"{root}/part"), f"{root}/held")
    out = scored(rows, fit(labelled, f"{root}/full"), f"{root}/rows")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return out.select(key, "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")
