"""The corpus pipeline: quality, near copies, repeated passages, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``. A stage works on all that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.llm.decontaminate import find_leaks
from lumivox.llm.packing import pack_documents
from lumivox.llm.passages import repeated_passages, without_passages
from lumivox.llm.queries import QUALITY, TOKENIZER, quality_model
from lumivox.llm.classifier import score_quality
from lumivox.llm.simhash import near_duplicates, with_fingerprints
from lumivox.plans.scratch import written
from lumivox.session import ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject; a rejected document goes, a null or empty text is scored like any.

    Repeated rows have one verdict and stay or go together; an empty table gives an empty one; without labels nothing is rejected.
    """
    ship(spark)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")  # so that no column of theirs is in the way of the score
    return score_quality(rows, quality_model(spark, docs, sf_dir)).where(F.col("score") >= QUALITY).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group one row of the document that names it, also where its row is repeated; rows with a null id stay; an empty table gives an empty one.

    Null and empty texts are alike, so one document of them stays. Of an id that has several texts, those stay that name a group each:
    the row kept has the least fingerprint that the naming id has in the group.
    """
    ship(spark)
    known = docs.where("doc_id is not null")
    found = written(near_duplicates(known), "near")
    kept = found.where("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("fingerprint").alias("fingerprint"))
    several = found.groupBy("doc_id").agg((F.min("fingerprint") != F.max("fingerprint")).alias("several")).where("several").select("doc_id")
    kept = written(kept.join(several.withColumn("several", F.lit(True)), "doc_id", "left").select("doc_id", "fingerprint", F.coalesce("several", F.lit(False)).alias("several")), "kept")
    named = known.join(kept.where("not several").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    several = kept.where("several").drop("several")
    if not several.isEmpty():  # which of their rows is meant only the fingerprint says
        rows = known.join(several.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text", F.struct(*docs.columns).alias("row"))
        marked = with_fingerprints(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "row")
        named = named.unionByName(marked.dropDuplicates(["doc_id", "fingerprint"]).join(several, ["doc_id", "fingerprint"], "left_semi").select("row.*"))
    return named.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every passage that an earlier document has is cut; ``n_chars`` follows, and documents without a word left go.

    Null and wordless texts stay as they are, as do rows with a null id; repeated rows are cut alike; an empty table gives an empty one.
    """
    ship(spark)
    cut = without_passages(docs, repeated_passages(docs))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark question in them; rows with a null id stay, repeated rows go or stay together, an empty table gives an empty one."""
    ship(spark)
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences; repeated rows are all packed, a null text is its end id alone, an empty table gives an empty one."""
    ship(spark)
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), end_id=0)


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack),
]

#: No model, chaining or packing can be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole ``documents`` table, each written to the shared folder and read by the next."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
