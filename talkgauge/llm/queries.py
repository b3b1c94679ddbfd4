"""One query per operator, with production parameters, over its whole table; and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.llm import bpe, embedding_dedup, langid, licenses, mixing, mpegts, ngram_join, oracles, packing, pii, warc
from talkgauge.llm.common import read_table


def _tokenizer() -> tuple[str, str]:
    """The rank file's place and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of(F.col("base_spans"), k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base_spans")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    each = F.transform("licenses", lambda x: F.concat_ws(":", x["part"], x["license"], F.round(x["dice"], 4).cast("string")))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.array_join(each, ",").alias("matches"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = _tokenizer()
    encoded = bpe.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    return bpe.decode(encoded.drop("text"), path, pattern, ["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = mpegts.load(mpegts.store(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    size = F.length("payload").cast("long")
    return media.select(
        "doc_id",
        "n_bytes",
        size.alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string(
            "packets=%d;pes=%d;cc_errors=%d;type=%d;pts=%d-%d;random_access=%d",
            "n_packets", "n_pes", "cc_errors", "stream_type", F.element_at("pts", 1), F.element_at("pts", -1), F.size("random_access"),
        ).alias("feature"),
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_copies(read_table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"), k=4, percent=85)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.train_split())
    prototypes = langid.learn(docs.filter(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "text", "held_out"), prototypes).select("doc_id", "held_out", "lang_pred", "score")


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.records_of_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    page = lambda c: F.floor(F.col(c) / 2).cast("long")
    text = F.array_join(F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n")
    return found.select(page("record_id").alias("page_id"), "canonical_url", page("refers_to").alias("refers_to"), "validator", "digest", text.alias("headers"))


def op10_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = _tokenizer()
    docs, ranks = read_table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.read_ranks(path)
    # A token has a byte at least, so bytes and end marks bound the ids.
    most = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    return packing.pack(packing.tokenise(docs, ranks, pattern), len(ranks), most_ids=most)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_pii, op2_license_scan, op3_byte_bpe, op4_media_columns, op5_embedding_dedup, op6_ngram_jaccard, op7_source_mixing, op8_language_id, op9_warc_revisits, op10_token_packing)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """The others can't be said in SQL (merges, random rounding, learned profiles, media): they are tested against brute force."""
    return {
        "op2_license_scan": oracles.license_scan(),
        "op5_embedding_dedup": oracles.embedding_dedup(),
        "op6_ngram_jaccard": oracles.ngram_jaccard(),
        "op9_warc_revisits": oracles.warc_revisits(),
    }
