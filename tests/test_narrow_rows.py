"""Rows that are sorted or grouped are narrow: digests in place of texts, numbers in place of names."""

from memlake.operators import ranking
from memlake.plans import graph


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_text_goes_through_the_windows_of_an_interleaving(spark):
    hits = spark.createDataFrame([("q", "a", 1, "Same  text", 1), ("q", "b", 1, "same text", 2), ("q", "b", 2, None, 3), ("q", "a", 2, None, 4)], "query_id string, provider string, rank int, content string, seq long")
    rows = ranking.interleave(hits, 3)
    assert [(r["seq"], r["place"]) for r in rows.orderBy("place").collect()] == [(1, 1), (4, 2)]
    assert "content" not in rows.columns and "digest" not in rows.columns


def test_edges_are_grouped_by_numbers(spark):
    text = plan(graph.edges(spark, "/root/testdata/sf0.001"))
    assert "Aggregate [l_suppkey" in text and "Aggregate [concat" not in text and "Aggregate [_groupingexpression" not in text
