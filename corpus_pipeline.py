"""Cleaning a training corpus in five stages, each over all that the stage before kept.

Toxic documents go; lines found in ten or more documents stay only where they come first (a document that loses all
its words goes); one document of each group of near duplicates stays, the one with the smallest id; documents that
hold benchmark items go; the rest is encoded. Documents with a null text pass all stages; columns keep their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm import decontaminate, jaccard_join, line_dedup, toxicity, viterbi_pieces
from sluicegate.llm.common import discard, materialise

#: SQL has no form of the models and of the encoding; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all else in one struct, so that no operator's own column meets one of the same name. The text
    is not in the struct: it is nearly all of a row, and would be written and shuffled twice."""
    rest = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"]
    return docs.select("doc_id", "text", F.struct(*rest).alias("_rest"))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    return packed.select(*[F.col("text") if c == "text" else F.col("_rest").getField(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(_packed(docs), model)
    return _unpacked(scored.where((F.col("toxic_score") < toxicity.THRESHOLD) | F.col("text").isNull()), docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bitmaps = materialise(line_dedup.line_bitmaps(docs, min_docs=10, keep_first=True).where("n_dropped > 0"), "pipeline-bitmaps")
    kept = line_dedup.keep_lines(_packed(docs), bitmaps).where((F.col("n_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    out = _unpacked(kept, docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: of its smallest doc_id the row with the smallest text hash. Rows without words
    are in no group, and of a group in which no row has a doc_id the one with the smallest text hash stays."""
    keyed = materialise(_packed(docs).withColumn("_own", F.monotonically_increasing_id()), "pipeline-rows")
    # each row is a document of its own here, so rows that share a doc_id or have none can be told apart
    found = jaccard_join.similarity_components(keyed.select(F.col("_own").alias("doc_id"), "text")).where("n_shingles > 0").withColumnsRenamed({"doc_id": "_own", "component_id": "_group"}).select("_own", "_group")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("hash"), "_own")
    grouped = materialise(found.join(keyed.select("_own", rank.alias("_rank")), "_own"), "pipeline-groups")
    first = grouped.groupBy("_group").agg(F.min("_rank").alias("_rank")).select(F.col("_rank._own").alias("_own"))
    copies = materialise(grouped.select("_own").join(first, "_own", "left_anti"), "pipeline-copies")
    return _unpacked(keyed.join(copies, "_own", "left_anti"), docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share a doc_id go together, rows without one as if they were one document."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaked = materialise(found.select(F.col("doc_id").alias("_leaked")).distinct(), "pipeline-leaks")
    packed = _packed(docs)
    return _unpacked(packed.join(leaked, F.col("doc_id").eqNullSafe(F.col("_leaked")), "left_anti"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return viterbi_pieces.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)  # what the next stages read is written by itself
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
