"""The registered queries of the operators. Each takes a session and a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvine.llm.byte_bpe import encode_and_decode
from tallyvine.llm.classifier import fit_quality, score_quality
from tallyvine.llm.fill_in_middle import digests, fill_in_middle
from tallyvine.llm.hard_negatives import mine_hard_negatives, whole_vectors
from tallyvine.llm.minhash import near_duplicates
from tallyvine.llm.ngram_join import link_documents
from tallyvine.llm.packing import pack
from tallyvine.llm.quality_rules import judge
from tallyvine.llm.secret_scan import scan_secrets
from tallyvine.llm.substring_dedup import repeats
from tallyvine.llm.token_files import read_token_files, write_token_files
from tallyvine.llm.topk import build_index, document_queries, search, statistics
from tallyvine.llm.url_filter import host_and_path, judge_urls
from tallyvine.sources.scratch import scratch_path

TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
}
WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
#: Every so many ids is a query of the search.
QUERY_EVERY = 50
GOOD_FROM = 0.3
# Rows of the embeddings that are anchors, rows whose label moves on, and the number of labels.
ANCHOR_EVERY, MOVED_EVERY, LABELS = 100, 7, 10
# Beginnings of host labels whose URLs make up the list of the URL filter.
UNWANTED_LABELS = ("adult", "ads", "casino", "cheap", "free", "spam")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def labels_to_learn_from(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").where(~held_out())


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def top_k_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    index = build_index(docs)
    documents, mean = statistics(index)
    asked = docs.where(F.col("doc_id") % QUERY_EVERY == 0)
    queries = document_queries(asked, index, documents)
    return search(index, queries, mean)


def packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"))


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark)
    write_token_files(table(spark, folder, "documents"), path, public_tokenizers.path(WORD_VOCABULARY))
    read = read_token_files(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The list: URLs of ``pages`` on hosts with an unwanted label."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    unwanted = rf"(^|\.)({'|'.join(UNWANTED_LABELS)})-"
    return judge_urls(pages, pages.where(host_and_path(F.col("url"))[0].rlike(unwanted)).select("url"))


def ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return link_documents(table(spark, folder, "documents"))


def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    both = encode_and_decode(table(spark, folder, "documents"), ranks, pattern)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats(table(spark, folder, "documents"))


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(table(spark, folder, "documents"))
    digest = F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans")


def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = score_quality(docs, fit_quality(docs, labels_to_learn_from(spark, folder)))
    predicted = (F.col("score") >= GOOD_FROM).cast("int").alias("predicted")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted)


def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    vectors = whole_vectors(table(spark, folder, "embeddings").withColumn("label", moved), "vec_id", "embedding", "label")
    return mine_hard_negatives(vectors, vectors.where(F.col("id") % ANCHOR_EVERY == 0))


def minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def fill_in_middle_forms(spark: SparkSession, folder: str) -> DataFrame:
    return digests(fill_in_middle(table(spark, folder, "documents")))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_top_k_search": top_k_search,
        "op2_packing": packing,
        "op3_quality_rules": quality_rules,
        "op4_token_files": token_files,
        "op5_url_filter": url_filter,
        "op6_ngram_join": ngram_join,
        "op7_byte_bpe": byte_bpe,
        "op8_substring_dedup": substring_dedup,
        "op9_secret_scan": secret_scan,
        "op10_quality_classifier": quality_classifier,
        "op11_hard_negatives": hard_negatives,
        "op12_minhash": minhash,
        "op13_fill_in_middle": fill_in_middle_forms,
    }
