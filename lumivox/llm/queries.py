"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.llm import twins
from lumivox.llm.classifier import Neighbours, fit_neighbours, score_quality
from lumivox.llm.decontaminate import find_leaks
from lumivox.llm.html import extract, fit_costs
from lumivox.llm.labelled import crc_fold
from lumivox.llm.language import identify, learn_dictionaries
from lumivox.llm.manifest import folded, leaf_digest, merkle_proofs, proof_digest
from lumivox.llm.packing import pack_documents
from lumivox.llm.passages import repeated_passages
from lumivox.llm.rules import fit_ratio, judge
from lumivox.llm.search import search
from lumivox.llm.shards import jump_hash, read_shards, write_shards
from lumivox.llm.simhash import near_duplicates
from lumivox.llm.token_files import read_token_files, write_token_files
from lumivox.llm.warc import read_warc, resolve_revisits, write_warc
from lumivox.plans.scratch import scratch_path, written
from lumivox.session import ship

#: The least quality score of a kept document.
QUALITY = 0.3
TOKENIZER = "word_bpe_49k.json"
SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    write_token_files(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), end_id=1)
    return read_token_files(spark, folder, ids=False)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=0)


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dictionaries = learn_dictionaries(docs.where(crc_fold("doc_id") != 0))
    found = identify(docs.select("doc_id", "text"), dictionaries, reject=False)  # every text with a letter is of a learned language
    return found.select("doc_id", (crc_fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "narrow")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trusted = _table(spark, sf_dir, "labels").where("quality = 1 AND doc_id IS NOT NULL").select("doc_id")
    return judge(docs, fit_ratio(docs, trusted))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Neighbours:
    """The quality classifier, fitted on labels outside the held-out fold."""
    return fit_neighbours(docs, _table(spark, sf_dir, "labels").where(crc_fold("doc_id") != 0), "quality")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = score_quality(docs.select("doc_id", "text"), quality_model(spark, docs, sf_dir))
    return found.select("doc_id", (crc_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= QUALITY).cast("int").alias("predicted"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit_costs(pages))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    names = write_warc(_table(spark, sf_dir, "pages"), folder)
    pages = resolve_revisits(read_warc(spark, folder, names))
    return pages.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_key").cast("long").alias("refers_to"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    torn = F.when(tampered, leaf_digest(*fields, F.translate("text", "\n", "")))  # null where the row is as it was
    leaves = written(docs.select("doc_id", "source", leaf_digest(*fields, F.col("text")).alias("leaf"), torn.alias("torn")), "digests")
    proofs = merkle_proofs(leaves, "source", ["doc_id"])
    found = proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("torn", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "shards")
    write_shards(_table(spark, sf_dir, "documents"), folder, SHARDS)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = read_shards(spark, folder)
    return rows.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", jump_hash(F.col("doc_id"), SHARDS + 1).alias("grown_shard"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_benchmark_leaks": op7_benchmark_leaks,
    "op8_main_text": op8_main_text,
    "op9_warc": op9_warc,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_shards": op12_shards,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "op9_warc": twins.WARC,
    "op11_merkle_manifest": twins.MERKLE,
    "op12_shards": twins.SHARDS,
    "op13_ranked_search": twins.SEARCH,
}
