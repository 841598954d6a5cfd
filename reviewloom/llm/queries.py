"""The registered queries over the test tables: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import centroid_clusters as clusters
from reviewloom.llm import chat_format as chat
from reviewloom.llm import mix_sources as mix
from reviewloom.llm import token_counts as tokens
from reviewloom.llm.decontaminate import find_contamination
from reviewloom.llm.embedding_dedup import embedding_dedup
from reviewloom.llm.fingerprints import document_fingerprints
from reviewloom.llm.html_text import extract_text
from reviewloom.llm.language_id import language_id
from reviewloom.llm.minhash_dedup import minhash_dedup
from reviewloom.llm.scratch import stage
from reviewloom.llm.spelling_variants import spelling_variants
from reviewloom.llm.suffix_dedup import suffix_dedup
from reviewloom.llm.toxicity import toxicity
from reviewloom.session import shared_path

#: Vocabulary of the tokenizer that `op10_token_counts` counts with; its argument ``vocabulary`` names another file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op4_mix_sources(spark, sf_dir):
    return mix.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op4_mix_sources"] = mix.SQL % "documents"


@query
def op5_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


@query
def op7_minhash_dedup(spark, sf_dir):
    return minhash_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op6_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"]))).alias("item_ids"),
        F.array_max(F.transform("hits", lambda h: h["similarity"])).alias("similarity"),
    )


@query
def op2_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op3_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query
def op8_chat_format(spark, sf_dir):
    probe = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(probe, rows.schema))
    return chat.digests(chat.format_chats(chat.as_records(rows)), "conv_id")


ORACLE["op8_chat_format"] = chat.SQL % "conversations"


@query
def op10_token_counts(spark, sf_dir, vocabulary=VOCABULARY):
    """Totals after inserts, a batch delivered twice, deletes, their return, and revised counts: those of all documents."""
    docs = table(spark, sf_dir, "documents")
    counts = stage(tokens.count_tokens(docs, [tokens.bpe_tokenizer(vocabulary)]), "token-counts")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    early, late, moved = counts.where(part < 7), counts.where(part >= 7), counts.where(part == 3)
    estimate = late.withColumn("n_tokens", F.col("n_tokens") + 5)  # a first figure, to be revised
    rollup = tokens.Rollup(spark, shared_path(spark, "llm-rollup"))
    for batch, change in [
        ("0", tokens.signed(after=early)),
        ("1", tokens.signed(after=estimate)),
        ("1", tokens.signed(after=estimate)),
        ("2", tokens.signed(before=moved)),
        ("3", tokens.signed(before=estimate, after=late)),
        ("4", tokens.signed(after=moved)),
        ("3", tokens.signed(before=estimate, after=late)),
    ]:
        rollup.commit(batch, change)
    return rollup.totals()


@query
def op9_embedding_dedup(spark, sf_dir):
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


@query
def op11_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


@query
def op12_fingerprints(spark, sf_dir):
    return document_fingerprints(table(spark, sf_dir, "documents"))


@query
def op13_centroid_clusters(spark, sf_dir):
    return clusters.centroid_clusters(table(spark, sf_dir, "embeddings"))


ORACLE["op13_centroid_clusters"] = clusters.sql("embeddings")
