"""Plan shape: what must and must not stand in the physical plans."""

import pytest

from corpuslab.catalog import ORACLE, QUERIES
from corpuslab.catalog import standins as st
from corpuslab.operators import corpus, features, graph

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


CHEAP = [
    "bracket_cleanup", "sentences", "sentence_pack", "word_tokens", "sections_explode", "imp_sections_multi", "bow",
    "ngram_profile", "dict_predict", "mean_pool", "cosine_label", "strat_split", "class_report",
]


@pytest.mark.parametrize("name", CHEAP)
def test_no_python_and_no_products(spark, name):
    text = plan(QUERIES[name](spark, DIR))
    for banned in ("PythonUDF", "ArrowEval", "MapInPandas", "CartesianProduct"):
        assert banned not in text


@pytest.mark.parametrize("name", ["bracket_cleanup", "sentence_pack", "sections_explode", "word_tokens"])
def test_row_local_work_does_not_aggregate(spark, name):
    text = plan(QUERIES[name](spark, DIR))
    assert "HashAggregate" not in text and "SortMergeJoin" not in text


def test_documents_are_shuffled_once_for_a_profile(spark):
    df = features.ngram_profile(st.documents(spark, DIR), "doc_id", "text")
    assert plan(df).count("Exchange hashpartitioning") == 1


def test_columns_are_pruned(spark):
    text = plan(features.bag_of_words(st.documents(spark, DIR), "doc_id", "text"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_balance_limits_before_the_shuffle(spark):
    text = plan(corpus.first_per_class(st.documents(spark, DIR), "label", "doc_id"))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_class_profiles_limit_before_the_classes_meet(spark):
    text = plan(QUERIES["class_profile"](spark, DIR))
    assert "Partial" in text and "WindowGroupLimit" in text


def test_first_chunk_vote_combines_before_the_shuffle(spark):
    text = plan(QUERIES["cosine_first_chunk"](spark, DIR))
    assert "partial_min_by" in text


def test_dictionary_report_scans_and_shuffles_the_texts_once(spark):
    text = plan(QUERIES["dict_report"](spark, DIR))
    views = text.split("BroadcastExchange")[0]
    assert views.count("FileScan parquet") == 1
    assert views.count("REPARTITION_BY_COL") == 1


def test_rank_rounds_do_not_move_edges(spark):
    """Edges are read from where they were placed; what is exchanged has a row per node."""
    edges = spark.range(2000).selectExpr("id % 50 AS src", "id % 41 AS dst").distinct()
    nodes = edges.selectExpr("explode(array(src, dst)) AS id").distinct()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        ranks = graph.pagerank(nodes, edges, rounds=2)
        assert abs(ranks.agg({"pagerank": "sum"}).first()[0] - 1) < 1e-9
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
