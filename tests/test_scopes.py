"""Retrieval over scopes: texts stay where they are, are cut once, and make few blocks."""

import os

from pyspark.sql import functions as F

from sievewright import store_queries
from sievewright.functions import text as T
from sievewright.operators import chunking, lexical
from sievewright.registry import ORACLE, QUERIES
from tests.conftest import TABLES, same

SF = "/root/testdata/sf0.001"


def test_odd_numbers_and_lacking_pages(spark, tmp_path):
    """Documents with numbers below zero, and without a page."""
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t in ("documents", "pages"):
            key = "doc_id" if t == "documents" else "page_id"
            df = df.withColumn(key, F.col(key) - (100 if t == "documents" else 20))
            df.coalesce(1).write.parquet(f"{tmp_path}/made-{t}")
            (part,) = (f for f in os.listdir(f"{tmp_path}/made-{t}") if f.endswith(".parquet"))
            os.rename(f"{tmp_path}/made-{t}/{part}", f"{tmp_path}/{t}.parquet")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    mine, theirs = same(spark, str(tmp_path), QUERIES["hybrid_scopes"], ORACLE["hybrid_scopes"])
    assert mine == theirs and any("'-" in r for r in mine)


def test_texts_are_indexed_where_they_lie(spark, monkeypatch):
    seen, build = [], lexical.build
    monkeypatch.setattr(lexical, "build", lambda docs, *more: seen.append(docs) or build(docs, *more))
    store_queries._retrieved(spark, SF, True)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_windows_clean_once(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([None, "", " \n", "a", " a  b\tc　d\n\ne ", " ".join(f"w{i}" for i in range(25))])], "id long, t string")
    made = chunking.windows(df, ["id"], F.col("t"), 10, 3)
    plan = made.select("chunk")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") + plan.count("split(") <= 2
    w = [f"w{i}" for i in range(25)]
    want = [(3, 0, 1, 1, "a"), (4, 0, 1, 5, "a b c d e")] + [(5, k, 4, min(10, 25 - 7 * k), " ".join(w[7 * k : 7 * k + 10])) for k in range(4)]
    assert sorted(tuple(r) for r in made.select("id", "chunk_index", "n_chunks", "token_count", "chunk").collect()) == want


def test_scopes_share_a_task_without_small_blocks(spark):
    """600,000 words of three scopes in turn: a block for each scope."""
    docs = spark.range(1_500).coalesce(1).select((F.col("id") % 3).cast("string").alias("scope"), "id", F.repeat(F.lit("A b C_1 é "), 133).alias("text"))
    index = lexical.build(docs)
    assert index.filter("term = ''").count() == 3
    assert sorted(r.term for r in index.filter("scope = '1' AND term <> ''").collect()) == ["a", "b", "c_1"]
    assert sorted((r.scope, r.id) for r in lexical.members(index).collect()) == sorted((str(i % 3), i) for i in range(1_500))


def test_words_of_the_index_are_tokens(spark):
    texts = [None, "", "One two_3 É-four", "Kelvin İx", "tail", "x y z\x1cw", "9"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, text string")
    index = lexical.build(df.select(F.lit("").alias("scope"), "id", "text"))
    lists = index.filter("term <> ''").select("block", "term", F.explode(F.arrays_zip("at", "tf")).alias("x"))
    ids = index.filter("term = ''").select("block", F.posexplode("ids").alias("at", "id"))
    got = sorted((r.id, r.term, r.tf) for r in lists.select("block", "term", "x.at", "x.tf").join(ids, ["block", "at"]).collect())
    want = df.select("id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("id", "term").count()
    assert got == sorted(map(tuple, want.collect()))
