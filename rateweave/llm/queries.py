"""The registered query of every operator: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from rateweave.llm import (bpe, chat, decontaminate, manifest, neardup, pii, quality, secrets, sentence_dedup, spelling,
                           token_counts, token_files, url_filter)
from rateweave.llm.common import ascii_lower, table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_quality_rules(spark, sf_dir):
    """Counts and verdict of the line-first rules for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.measured(docs).select("doc_id", *[f"quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_removed_lines",
        "lost_chars", "base_failed", "kept")])


@query
def op7_byte_bpe(spark, sf_dir):
    """Encode every document and decode it again; digests of ids and bytes."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN)


@query
def op3_minhash(spark, sf_dir):
    """Component and verdict of every document by confirmed near-duplicate links."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_decontamination(spark, sf_dir):
    """Benchmark words and items found in every document."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_pii(spark, sf_dir):
    """Personal data in every document: strict spans and what the trees add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.found(docs, pii.fit(docs))


@query
def op8_token_counts(spark, sf_dir):
    """Bytes and tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_token_files(spark, sf_dir):
    """Every document's place, length and checksum as read back from grammar-compressed token files."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


LIST_DAYS = 360


@query
def op6_url_filter(spark, sf_dir):
    """Every page, as a capture of the day its id gives, against a list whose history all pages give.

    A page lists its own host, its host's parent domain or its path, depending on its id, and adds or removes it on
    another day of the year; so every host has a history and every page is both an entry and a capture.
    """
    pages = table(spark, sf_dir, "pages")
    n = F.col("page_id")
    host = url_filter.host_of(F.col("url"))
    captures = pages.select("page_id", "url", F.pmod(n, F.lit(LIST_DAYS)).alias("fetched_at"))
    parent = F.regexp_replace(host, "^[^.]+\\.", "")
    path = F.concat(host, F.regexp_extract("url", "://[^/?#]+(/[^/?#]+)", 1))
    entries = pages.select(
        F.when(n % 3 == 0, host).when(n % 3 == 1, path).otherwise(F.when(n % 30 == 2, parent).otherwise(host)).alias("key"),
        F.concat(F.lit("c"), (n % 4).cast("string")).alias("category"), F.pmod(n * 7 + 11, F.lit(LIST_DAYS)).alias("listed_at"),
        F.when(n % 5 < 2, "add").otherwise("remove").alias("action"))
    return url_filter.judged(captures, entries)


@query
def op2_sentence_dedup(spark, sf_dir):
    """Every document without the sentences of spans that came before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_dedup.deduplicated(docs)


@query
def op1_chat_format(spark, sf_dir):
    """Every conversation with its roles repaired at least cost, rendered."""
    return chat.formatted(table(spark, sf_dir, "conversations"))


@query
def op13_merkle(spark, sf_dir):
    """Every document's leaf, proof and the root it leads to, a fifth of the texts lower-cased after the manifest was made."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest.audited(docs, F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text")))


@query
def op12_secrets(spark, sf_dir):
    """Secrets in every document: strict spans and the runs that look drawn at random."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.found(docs, secrets.fit(docs))


@query
def op11_spelling(spark, sf_dir):
    """Every word of the corpus with its near words' number and the form that its variants lead to."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
