"""The text operators as registered queries over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import (knn, language, lines, mixing, negatives, pieces, pii, quality, simhash, sketch, spelling, tokenfiles,
                          warc)
from flowloom.llm.common import new_path, table

#: Folder of the public tokenizer files, readable on the driver.
TOKENIZERS = "/opt/tokenizers"


#: The registered query's key; a real run takes a secret of its own.
EXAMPLE_KEY = b"flowloom-demonstration-key"


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.protect(table(spark, sf_dir, "documents", "doc_id", "text"), EXAMPLE_KEY)


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_recurring(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "text", "n_lines", "n_dropped")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.hexadecimal("code").alias("fingerprint"), "component_id")


def op5_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.compare_with_edit(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                        "edited_fingerprint", "near_edited", "near_next", "shingles", "in_edited")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.read_model(f"{TOKENIZERS}/piece_bpe_32k.model")
    return digests(pieces.encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), model, decode=True))


def digests(encoded: DataFrame) -> DataFrame:
    """Length and digests of ``encoded`` (doc_id, ids, decoded)."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = knn.scaled(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return knn.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenizer = tokenfiles.read_tokenizer(f"{TOKENIZERS}/word_bpe_49k.json")
    tokenfiles.write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), path, tokenizer)
    found = tokenfiles.read_tokens(spark, path).select(
        "part", "number", "doc_id", "offset", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))
    return found.join(tokenfiles.file_starts(spark, path), ["part", "number"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(warc.archive_records(table(spark, sf_dir, "pages", "page_id", "url", "html")), path)
    return warc.read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents", "doc_id", "text", "n_chars"),
                         table(spark, sf_dir, "labels", "doc_id", "quality"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = negatives.labelled(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return negatives.mine(vectors, vectors.where("vec_id % 100 = 0"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it takes its stages' settings from this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_pseudonyms, op2_line_templates, op3_language, op4_simhash, op5_bottom_k, op6_sentencepiece,
        op7_voronoi_knn, op8_token_files, op9_mixing, op10_warc, op11_spelling, op12_quality, op13_hard_negatives, pipeline)}


ORACLE = {
    "op2_line_templates": lines.ORACLE,
    "op11_spelling": spelling.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
    "op7_voronoi_knn": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10""",
    "op10_warc": """
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages),
f as (
  select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, p.payload_digest,
  case when page_id > first then 'revisit' else 'response' end as record_type,
  case when page_id > first then first end as refers_to
from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes >= 100""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
