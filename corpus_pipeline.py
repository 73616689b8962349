"""From raw documents to packed sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktrail.llm import lines, mixing, packing, queries, simhash, toxicity
from clicktrail.sources.shared import stash

ROW_HASH = "__row_hash__"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rated toxic go; the classifier learns from the labels of the documents there are.

    Every row is rated by its own text, null as empty; repeated rows share their fate, and a
    null id has no label. Texts are rated whole. Without documents or labels, none goes.
    """
    model = queries.toxicity_model(spark, docs, sf_dir)
    return toxicity.score(docs, model).where("score < 0.5").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller id holds go; ``n_chars`` follows the text.

    Rows of one id are one document to this rule, so none takes lines from another. Null texts
    stay null, empty ones empty; a document all of whose lines go stays with an empty text.
    """
    kept = lines.kept_text(docs, lines.line_dedup(docs))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: the smallest id, then the smallest hash of its columns.

    Rows are judged one by one: rows of one id with unlike texts are in different groups, and of
    rows equal in all columns one stays. A row without an id stays only where its whole group
    has none. Texts without words, null ones too, are one group. No table, no rows.
    """
    hashed = docs.withColumn(ROW_HASH, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    groups = simhash.simhash_groups(hashed, key=F.col(ROW_HASH))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    kept = groups.groupBy("group").agg(F.min(rank).alias("kept")).select("kept.doc_id", F.col("kept.key").alias("key"))
    times = groups.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("times"))
    kept, times = kept.alias("k"), times.alias("t")
    same_row = F.col("k.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("k.key") == F.col("t.key"))
    kept = stash(kept.join(times, same_row).select(
        F.col("k.doc_id").alias("kept_id"), F.col("k.key").alias("kept_key"), "times"), "kept")

    def rows(which: DataFrame) -> DataFrame:
        same = F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.col(ROW_HASH) == F.col("kept_key"))
        return hashed.join(which, same, "left_semi")

    once = rows(kept.where("times = 1")).select(docs.columns)
    # rows that repeat are folded where they lie before they meet
    repeated = rows(kept.where("times > 1")).groupBy("doc_id", ROW_HASH).agg(
        F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return once.unionByName(repeated.select("row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A document's weight is its words, so one without words, with a null or empty text, holds
    nothing to take and goes. Repeated rows are documents of their own; a null source is one
    more source.
    """
    size = mixing.word_count(F.col("text"))
    mixed = mixing.mix_sources(docs, size, F.array("source"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048, of every row, whole."""
    return packing.pack(packing.token_pieces(docs, packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

# Not in SQL: fingerprints, seeded draws and tokens have no SQL form. Tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
