"""Prompts with worked examples, replies by schema, laid-out pages."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import drafts, tools
from tessera.sources import documents


def test_every_example_is_a_reply_that_its_judge_reads(spark):
    assert set(drafts.EXAMPLES) == set(tools.REPLIES)
    for task, examples in drafts.EXAMPLES.items():
        rows = spark.createDataFrame([(json.dumps(reply),) for *_, reply in examples], "t string")
        assert [r.error for r in tools.judge_replies(rows, "t", task).collect()] == [None] * len(examples)
        assert task == "reformulate" or len(examples) >= 2
    prompt = spark.range(1).select(drafts.with_examples("SYSTEM  ", "triage").alias("p")).first().p
    assert prompt.startswith("SYSTEM\n\nExample 1: ") and prompt.endswith(drafts.FORMAT) and "Example 2" in prompt
    with pytest.raises(KeyError):
        drafts.with_examples("x", "unknown")


def test_replies_tell_what_is_wrong(spark):
    cases = [
        ('{"grade": 2, "confidence": 0.5, "rationale": "r"}', None), ('Sure: ```json\n{"grade": 0}\n```', None), ("none", "no object"), (None, "no object"), ('{"grade": 2', "no object"),
        ('{"grade": }', "not JSON"), ('{"confidence": 1}', "missing: grade"), ('{"grade": 4, "confidence": 1.5}', "out of range: grade, confidence"),
        ('{"grade": -1}', "out of range: grade"), ('{"grade": 1, "zeal": 2, "mood": 1}', "unknown: mood, zeal"), ("", "no object"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").withColumn("reply_of", F.lit("x"))
    got = tools.judge_replies(df, "t", "relevance").orderBy("i").collect()
    assert [r.error for r in got] == [e for _, e in cases] and all((r.reply is None) == (r.error is not None) for r in got)
    assert got[0].reply.grade == 2 and got[0].reply_of == "x"
    faithful = spark.createDataFrame([('{"total_claims": 2, "cited_claims": 1, "supported_cited_claims": -1, "violations": [{"kind": "k", "claim": "c"}]}',)], "t string")
    assert tools.judge_replies(faithful, "t", "faithfulness").first().error == "out of range: supported_cited_claims"


def test_blocks_of_spans(spark):
    spans = [("p", 1, 0, 0, 0, "2", 9.0, "Times"), ("p", 1, 0, 0, 1, "Method", 14.0, "Times-BOLD"), ("p", 1, 0, 1, 0, "x", 6.0, "T"), ("p", 1, 1, 0, 0, " ", 20.0, "B"), ("p", 2, 0, 1, 0, "end", 10.0, "T"), ("p", 2, 0, 0, 0, "the", 10.0, "T")]
    df = spark.createDataFrame(spans, "paper_id string, page int, block int, line int, span int, text string, size double, font string")
    got = sorted(map(tuple, documents.page_blocks(df).select("page", "block", "text", "size", "bold").collect()))
    assert got == [(1, 0, "2 Method x", 14.0, True), (2, 0, "the end", 10.0, False)]


def test_stub_embeddings_of_both_kinds(spark):
    rows = spark.createDataFrame([(1, "graph model graph"), (2, ""), (3, None)], "i int, text string")
    own = {r.i: r.embedding for r in drafts.stub_embeddings(rows, "i").collect()}
    asked = {r.i: r.embedding for r in drafts.stub_embeddings(rows, "i", "query").collect()}
    assert own.keys() == {1, 2, 3} and own[2] == own[3] and all(sum(x * x for x in v) == pytest.approx(1) and len(v) == 64 for v in own.values())
    assert own[1] != asked[1] and max(own[1]) == pytest.approx(2 / 6**0.5)
