import random

import corpus_pipeline
import pytest

from llm_helpers import CLASHES, DOCS, EXTRA, MORE_CLASHES, family_of, odd_documents, sentence


def test_stages_follow_each_other(spark, tmp_path):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(600):
        text = sentence(rng, rng.randrange(20, 90))
        toxic = i % 6 == 0
        rows.append((i, text + " Grobsatz" * toxic, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + k, text, "en", "s0", 1) for k, text in enumerate(family_of(rng, 30, 150, 1))] + [(2000 + k, "the very same text for all", "en", "s1", 1) for k in range(20)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        left.append([r.doc_id for r in docs.select("doc_id").collect()])
    toxic, unique, mixed, coded = left
    assert set(toxic) == {r[0] for r in rows} - {i for i in range(600) if i % 6 == 0}
    assert set(unique) == set(toxic) - set(range(1001, 1030)) - set(range(2001, 2020)) and len(unique) == len(set(unique))
    assert set(mixed) <= set(unique) and max(mixed.count(i) for i in set(mixed)) <= 2
    assert sorted(coded) == sorted(mixed)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(coded)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_corpora(spark, tmp_path, empty):
    """Nulls in every column, empty, blank and very long texts, repeated rows, rows without id, and columns that clash; or no row at all."""
    odd = odd_documents(spark).collect()
    rows = [] if empty else [tuple(r) + (7,) * 13 for r in odd] + [(None,) * 5 + (None,) * len(EXTRA) + (None,) * 13]
    schema = DOCS + CLASHES + MORE_CLASHES.replace("__toxic double", "__toxic long")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [] if empty else [(1, 1, 0), (2, None, None), (None, 1, 1), (6, 1, 0), (6, 1, 0), (99, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        step(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == [x.split()[0] for x in schema.split(", ")], name
        if not empty:
            assert {r["__n"] for r in docs.collect()} <= {7, None}, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # no labels of both classes: nothing is toxic; one document of an id and of a text stays; texts without words stay or go by a draw
    assert {r.doc_id for r in out} <= {1, 2, 3, 4, 5, 6, 8, None} and bool(out) != empty
