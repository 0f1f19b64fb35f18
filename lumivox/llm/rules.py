"""Operator 5: quality rules and a hashed n-gram log-likelihood ratio between trusted and raw text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumivox.llm.storage import slices
from lumivox.llm.words import Words

#: Characters that count as symbols.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_BLANK = " \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Ratio:
    """The fitted ratio: a weight for each n-gram bucket, and the least mean weight of a kept document."""

    weights: np.ndarray
    threshold: float


def _sums(w: Words, mask: np.ndarray) -> np.ndarray:
    """How many of each text's bytes are set in ``mask``."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return np.diff(total[np.append(w.begins, len(mask))])


def _repeated_lines(text: str | None) -> int:
    seen: set[str] = set()
    repeats = 0
    for line in (text or "").split("\n"):
        if line in seen:
            repeats += 1
        elif line.strip(_BLANK):
            seen.add(line)
    return repeats


def _repeated_words(w: Words, size: int = 3) -> np.ndarray:
    """Of each text, the words in windows of ``size`` words that it has twice or more."""
    at, h = w.windows(size)
    which, counts = _grouped(w.text[at], h)
    hit = at[counts[which] > 1]
    marked = np.zeros(len(w.starts), bool)
    for j in range(size):
        marked[hit + j] = True
    return np.bincount(w.text[marked], minlength=len(w.texts))


def _grouped(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the number of its group of equal ones in its text, and the groups' sizes."""
    order = np.lexsort((h, text))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return which, np.bincount(which)


def _ngrams(w: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each word and each pair of words."""
    at, pairs = w.windows(2)
    return np.concatenate([w.text, w.text[at]]), (np.concatenate([w.hashes, pairs]) % np.uint64(buckets)).astype(np.int64)


def _bucket_counts(rows: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of all texts, and of those marked ``trusted``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            w = Words(batch.column("text").to_pylist())
            text, bucket = _ngrams(w, buckets)
            raw += np.bincount(bucket, minlength=buckets)
            trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            target += np.bincount(bucket[trusted[text]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.record_batch({"bucket": pa.array(at), "raw": pa.array(raw[at]), "target": pa.array(target[at])})

    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        raw[r[0]], target[r[0]] = r[1], r[2]
    return raw, target


def measures(rows: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """Adds the counts of the rules and ``score`` (the mean weight of its n-grams; 0 without any) to ``id, text``."""
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = Words(batch.column("text").to_pylist())
            score = np.zeros(len(w.texts))
            if weights is not None and len(w.starts):
                text, bucket = _ngrams(w, len(weights))
                score = np.bincount(text, weights[bucket], len(w.texts)) / np.maximum(1, np.bincount(text, minlength=len(w.texts)))
            columns = [w.counts, _sums(w, ~w.space & (w.buffer & 0xC0 != 0x80)), _sums(w, SYMBOLS[w.buffer]), [_repeated_lines(t) for t in w.texts], _repeated_words(w)]
            yield pa.record_batch([batch.column("id"), *[pa.array(c, pa.int64()) for c in columns], pa.array(score)], names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    return rows.select("id", "text").mapInArrow(scan, schema)


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit_ratio(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 16, share: float = 0.005, slack: float = 0.05, small: int = 2_000_000) -> Ratio:
    """Counts n-grams of all documents and of the trusted ones, and sets the threshold.

    ``trusted`` has the ids of trusted documents, any number of them: up to ``small`` are broadcast, more
    are shuffled with the texts. Four fifths of
    them are counted as the target; the others, that the counts haven't seen, set the threshold: ``slack`` under
    the score that all but ``share`` of those with enough words reach. Scores are binned to thousandths, so the
    threshold is the same at every run. Without trusted documents nothing is told apart and all pass.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = trusted.select(F.col(id_col).alias("id"), (F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(5)) > 0).alias("trusted")).distinct()
    sent = F.broadcast if marks.count() <= small else lambda ids: ids
    raw, target = _bucket_counts(rows.join(sent(marks), "id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")), buckets)
    if not target.sum():
        return Ratio(np.zeros(buckets), -1.0)
    weights = np.log((target + 0.5) / (target.sum() + 0.5 * buckets)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * buckets))
    unseen = rows.join(sent(marks.where(~F.col("trusted")).select("id")), "id", "left_semi")
    bins = measures(unseen, weights).where(~_failed()).groupBy(F.floor(F.col("score") * 1000).alias("bin")).count().orderBy("bin").collect()
    left = int(share * sum(r[1] for r in bins))
    for value, count in bins:
        if left < count:
            return Ratio(weights, value / 1000 - slack)
        left -= count
    return Ratio(weights, -1.0)


def judge(docs: DataFrame, ratio: Ratio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rules' counts, ``base_failed``, ``score`` and ``kept`` of every document.

    A null or empty text has no words, so it fails the base rules; repeated rows and null ids are judged like any;
    a score equal to the threshold passes; an empty table gives an empty one; extra columns are left out.
    """
    found = measures(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ratio.weights)
    return found.withColumn("base_failed", _failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= ratio.threshold)).withColumnRenamed("id", id_col)
