"""A training corpus from raw documents: quality rules, quality classifier, SimHash near-dedup, suffix-array dedup,
best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last return the columns
of documents. Rows without doc_id have no group in near-dedup and stay; rows that repeat a doc_id with other texts are documents of
their own there.
Texts that suffix-array dedup cuts get a new n_chars; documents that lose their whole text to earlier copies go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postingworks.llm import gbt, jaccard, packing, rules, suffix
from postingworks.llm.common import discard, scratch, written
from postingworks.llm.queries import PIECES_FILE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.kept_documents(docs, rules.log_ratios(docs, labels.where("quality = 1")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on labelled rows of the raw documents, as the rules have removed most bad ones from docs."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return gbt.good_documents(docs, gbt.fit_classifier(raw, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that similarity 0.8 of their five-word shingles connects: the one of the
    smallest doc_id, of its texts that with the smallest hash, and of equal ones the smallest by all columns."""
    groups = jaccard.near_copies(docs)
    first = groups.groupBy("component").agg(F.min(F.struct("doc_id", "t")).alias("r")).select(F.col("r.doc_id").alias("doc_id"), F.col("r.t").alias("_t"))
    kept = docs.withColumn("_t", F.xxhash64("text")).join(first, ["doc_id", "_t"], "left_semi")
    single = kept.groupBy("doc_id", "_t").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return single.union(docs.where("doc_id is null"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, chars = f"c{names.index('text')}", names.index("n_chars")
    cut = suffix.remove_repeated_passages(plain, text, f"c{names.index('doc_id')}", keep="first", whole_characters=True)
    changed = F.size("removed") > 0
    left = F.when(changed, F.decode("kept", "UTF-8")).otherwise(F.col(text))
    rows = cut.where(~changed | (F.length("kept") > 0)).withColumns({text: left, f"c{chars}": F.when(changed, F.length(left).cast(docs.schema[chars].dataType)).otherwise(F.col(f"c{chars}"))})
    return rows.select([F.col(f"c{i}").alias(x) for i, x in enumerate(names)])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, PIECES_FILE)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the fitted trees nor the packing; tests compare every stage with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and reread. What a stage wrote on its way goes when its result is
    written, and that goes when the next one is; the result reads the last ones, which stay until the session ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch():
            docs = written(stage(spark, docs, sf_dir), outlives=True)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
