"""All trusted rows count in the target of the quality rules."""

import numpy as np
from pyspark.sql import functions as F

from postingworks.llm import rules


def test_target_counts_grow_with_the_trusted_rows(spark):
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    # With every row trusted, target and raw are the same.
    assert np.abs(rules.log_ratios(docs, docs.select("doc_id"))).max() < 1e-12


def test_plan_is_the_same_at_all_sizes(spark, monkeypatch):
    """A broadcast at small sizes alone makes the disk grow faster than the input."""
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    seen, kind = [], type(docs)
    plain = kind.toPandas
    monkeypatch.setattr(kind, "toPandas", lambda self: seen.append(self) or plain(self))
    rules.log_ratios(docs, docs.select("doc_id"))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
