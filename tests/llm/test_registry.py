import importlib
import re

import __spark_entry__
from tessera.llm import registry


def test_every_operator_has_one_query():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    for name, module in registry.MODULES.items():
        assert callable(getattr(importlib.import_module(f"tessera.llm.{module}"), name))
    assert "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stages_in_order():
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "minhash_near_dedup", "source_mixing", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_samples_are_bounded_and_stable(spark):
    from tessera.llm.sampling import hash_sample

    df = spark.range(5000).toDF("doc_id")
    a, b = ({r.doc_id for r in hash_sample(x, 100).collect()} for x in (df, df.repartition(5)))
    assert a == b and len(a) == 100
    assert hash_sample(df.limit(0), 10).count() == 0
    assert hash_sample(spark.sql("select cast(null as long) as doc_id from range(50)"), 10).count() == 10
