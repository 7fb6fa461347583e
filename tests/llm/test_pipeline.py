"""The pipeline on planted cases, and the guard of the entry module."""

import hashlib
import random

import pytest

import corpus_pipeline
from corroborate.llm import queries
from corroborate.llm.shared import without

from ..conftest import SF, same


def planted(spark, folder):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 7))) for _ in range(600)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = {i: text(60) for i in range(120)}
    toxic = set(range(0, 60))
    for i in toxic:
        docs[i] += " vilestuff you hatefulmess " + text(5) + " vilestuff"
    docs[100] = docs[99]
    docs[101] = docs[98] + " more"
    item = text(30)
    docs[102] = text(20) + " " + item + " " + text(20)
    docs[103] += " write to someone@example.org now"
    docs[104], docs[105] = "", None
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, toxic


def test_stages_catch_what_is_planted(spark, tmp_path):
    docs, toxic = planted(spark, tmp_path)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(docs) - toxic - {100, 101, 102}
    assert got[103].decoded_sha256 == hashlib.sha256(docs[103].replace("someone@example.org", "[EMAIL]").encode()).hexdigest()
    assert all(got[i].decoded_sha256 == hashlib.sha256((docs[i] or "").encode()).hexdigest() for i in got if i != 103)


def test_all_but_the_last_stage_return_documents(spark, tmp_path):
    planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns


def test_queries_equal_their_sql(spark, duck):
    for name, sql in queries.oracle_sql().items():
        same(queries.queries()[name](spark, SF), duck, sql)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def odd(spark, folder, rows):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.7, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(None, "some item without a number"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_nulls_repeats_and_clashing_names(spark, tmp_path):
    long = "word and other words that go on " * 3000
    rows = [(1, "first text of its own here"), (1, "first text of its own here"), (2, "first text of its own here"), (None, "a text without number"), (None, None), (4, None), (5, ""), (6, long), (7, long + "end")]
    odd(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[-2:] == ["score", "component_id"] and set(r.component_id for r in docs.collect()) == {"x"}, name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([1, 1, None, None, 4, 5, 6], key=str)
    assert {r.n_tokens for r in got if r.doc_id in (4, 5)} == {0}


def test_empty_tables(spark, tmp_path):
    odd(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("most", [0, 10])
def test_rows_go_by_id_broadcast_or_shuffled(spark, most):
    docs = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "c", 7), (None, "d", 8), (3, "e", 9)], "doc_id long, text string, gone_id long")
    gone = spark.createDataFrame([(1,), (1,), (None,), (9,)], "id long")
    got = without(docs, gone, most=most)
    assert sorted(r.text for r in got.collect()) == ["c", "d", "e"] and got.columns == docs.columns
    assert without(docs, gone.limit(0), most=most).count() == 5
