"""Indexed search against a scan in plain Python."""

from __future__ import annotations

import random

import pytest

from tonearm.operators import postings, search

WORDS = ["être", "Zug", "a", "quartz", "abba", "the", "thé", "x1", "𝄞𝄞", "of", "note"]
QUERIES = ["quartz", "the of", "a", "𝄞𝄞 zug", "être abba note the", "qqq", "THE qu z", "the the the tz"]


def _rows():
    draw = random.Random(4)
    texts = [" ".join(draw.choices(WORDS, [1, 1, 9, 1, 5, 90, 5, 5, 1, 60, 5], k=draw.randint(0, 9))) for _ in range(600)]
    return [(i, t) for i, t in enumerate(texts)] + [(700, None), (None, "quartz"), (701, ""), (702, " quartz\tZUG\n" * 3000)]


@pytest.mark.parametrize("block_ids", [16, 8192])
def test_same_page_as_a_scan(spark, block_ids):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = postings.build(df, "doc_id", ["text"], block_ids).cache()
    assert index.selectExpr("max(size(ids))").first()[0] <= block_ids
    for query in QUERIES:
        grams = search.bigrams(query)
        want = sorted((-n, i) for i, t in rows if i is not None and t and (n := sum(g in t.lower() for g in grams)))[:20]
        assert [(-r["relevance"], r["id"]) for r in postings.top_page(index, query).collect()] == want, query
    index.unpersist()


def test_frequent_lists_are_left_where_the_rare_ones_decide(spark):
    rows = [(i, "quartz the" if i % 10 == 0 else "the") for i in range(1000)]
    index = postings.build(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", ["text"]).cache()
    grams = [g for g, _ in postings.frequencies(index, search.bigrams("quartz the"))]
    read, last, scores = postings.enough(index, grams, 20)
    assert read < len(grams) and last > len(grams) - read and scores.count() == 100
    assert postings.top_page(index.limit(0), "quartz").count() == 0
    index.unpersist()
