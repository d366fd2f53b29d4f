import corpus_pipeline as C
import pytest
from test_similarity import brute_components

from entrofield.llm import packing, pii, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    root = tmp_path_factory.mktemp("pipe")
    for i, (name, stage) in enumerate(C.STAGES):
        path = str(root / f"{i}")
        stage(spark, docs, sf).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "ngram_jaccard_join", "pii", "mixing", "best_fit_packing"]
    for _, before, after in stages[:-1]:
        assert before.columns == after.columns


def test_toxicity_keeps_the_rest(stages):
    _, before, after = stages[0]
    assert 0.8 * before.count() < after.count() <= before.count() and after.exceptAll(before).count() == 0


def test_one_of_each_group(stages):
    _, before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    keep = {doc for (doc, _), (n, comp) in zip(rows, brute_components(rows)) if doc == comp or not n}
    assert sorted(r.doc_id for r in after.collect()) == sorted(keep)


def test_private_data(stages):
    _, before, after = stages[2]
    sur = pii.Surrogates(C.PII_KEY)
    new = {r.doc_id: r.text for r in after.collect()}
    assert len(new) == before.count()
    assert all(new[r.doc_id] == (r.text and pii.replace(r.text, sur)[0]) for r in before.collect())


def test_mixture_and_packing(stages):
    _, before, after = stages[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert rows and all(texts[r.doc_id] == r.text for r in rows)
    packed = stages[4][2].toPandas()
    size = sum(len((r.text or "").encode().split()) + 1 for r in rows)
    assert packed.n_tokens.sum() == size
    assert (packed.groupby(["shard", "bin"]).n_tokens.sum() <= packed.groupby(["shard", "bin"]).capacity.first()).all()
    assert set(packed.capacity) <= set(packing.LENGTHS)


def test_toxicity_is_the_operator(spark, sf, stages):
    from pyspark.sql import functions as F

    docs = stages[0][1]
    net = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"), C.remainder(F.col("doc_id"), 5) != 0)
    want = {r.doc_id for r in toxicity.score(docs, net).where("score < 0.5").collect()}
    assert want == {r.doc_id for r in stages[0][2].collect()}


def test_odd_rows(spark, docs, empty, sf):
    """Null ids and texts, repeated rows, clashing columns and empty tables go through every stage."""
    for table in (docs, empty):
        for i, (name, stage) in enumerate(C.STAGES):
            before, table = table, stage(spark, table, sf)
            assert i == 4 or (table.columns == before.columns and table.dtypes == before.dtypes), name
            if i < 4:
                table = spark.createDataFrame(table.collect(), before.schema)
        n = table.agg({"n_tokens": "sum"}).first()[0]
        assert (n or 0) == sum(len((r.text or "").encode().split()) + 1 for r in before.collect())
