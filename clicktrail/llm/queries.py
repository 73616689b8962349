"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktrail.llm import (
    chat, context_mixing, cover_tree, lines, main_text, middle, mixing, packing, posting_lists, prefix_trie, secrets, simhash, toxicity,
)
from clicktrail.sources.shared import stash

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id, folds):
    """Remainder of the checksum of an id's text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


@query
def op1_simhash(spark, sf_dir):
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_lm_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return context_mixing.score_texts(docs, fold("doc_id", 7) == 2)


@query
def op3_secrets(spark, sf_dir):
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind_no"] <= 3)

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select(
        "row.doc_id", *counts, F.sha2(secrets.digest_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.digest_text(F.col("secrets")).alias("spans"))


@query
def op4_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.kept_text(docs, lines.line_dedup(docs))
    return kept.select(
        "row.doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query
def op5_near_vectors(spark, sf_dir):
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


PROBE = "</s>[INST] ok [/INST]"


@query
def op6_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    formatted = chat.format_chats(turns.unionByName(probe))
    read = formatted.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                            chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("masked"))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), every.alias("every"),
                       F.array_join("masked", "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id", "n_turns", F.sha2(F.col("every").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars")


@query
def op7_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    encoder = packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(packing.token_pieces(docs, encoder))


@query
def op8_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = stash(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sized")
    mixed = mixing.mix_sources(sized, F.col("size"), F.array("source"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def toxicity_model(spark, docs, sf_dir):
    return toxicity.train(docs, table(spark, sf_dir, "labels"), keep=fold("doc_id", 5) != 0)


@query
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("row.doc_id", (fold("row.doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_nearest_vectors(spark, sf_dir):
    return posting_lists.nearest(table(spark, sf_dir, "embeddings"))


@query
def op11_prefix_trie(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(turns))


@query
def op12_main_text(spark, sf_dir):
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


@query
def op13_fill_in_middle(spark, sf_dir):
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = middle.restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored.cast("binary"), 256).alias("restored_sha256"))
