"""Operator 6: quality by nearest-neighbour voting among latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.llm.labelled import label_sample
from lumivox.llm.storage import slices
from lumivox.llm.words import Words, polynomial

#: Buckets of words, of word shapes, and of pairs of shapes; two more features count words equal and unequal to the one before.
WORDS, SHAPES = 4096, 1024
FEATURES = WORDS + 2 * SHAPES + 2


def _classes() -> np.ndarray:
    """A byte's class in shapes: letters by case, digits, any byte beyond ASCII, and each punctuation mark by itself."""
    kind = np.arange(256)
    kind[ord("a") : ord("z") + 1] = ord("a")
    kind[128:] = ord("a")
    kind[ord("A") : ord("Z") + 1] = ord("A")
    kind[ord("0") : ord("9") + 1] = ord("0")
    return kind


_CLASS = _classes()


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and count of everything the texts have, ordered by text and feature."""
    lengths = w.ends - w.starts
    if not len(lengths):
        return (np.empty(0, np.int64),) * 3
    kinds, begins = _CLASS[w.letters], np.cumsum(lengths) - lengths
    turns = np.append(True, kinds[1:] != kinds[:-1])
    turns[begins] = True  # a run of one class counts once
    shapes = polynomial(kinds[turns], np.add.reduceat(turns.astype(np.int64), begins))
    same = np.append(False, (w.hashes[1:] == w.hashes[:-1]) & (w.text[1:] == w.text[:-1]))
    at, pairs = w.windows(2, shapes)
    number = np.concatenate([
        (w.hashes % np.uint64(WORDS)).astype(np.int64),
        WORDS + (shapes % np.uint64(SHAPES)).astype(np.int64),
        WORDS + SHAPES + (pairs % np.uint64(SHAPES)).astype(np.int64),
        np.where(same, FEATURES - 2, FEATURES - 1),
    ])
    text = np.concatenate([w.text, w.text, w.text[at], w.text])
    keys, counts = np.unique(text * FEATURES + number, return_counts=True)
    return keys // FEATURES, keys % FEATURES, counts


@dataclass(frozen=True)
class Neighbours:
    """The fitted model: feature weights, projection, and the labelled documents' unit vectors with their labels."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int = 15
    power: int = 4

    def project(self, w: Words) -> np.ndarray:
        """Unit latent vectors of the texts; zero for a text without words."""
        text, feature, count = features(w)
        out = np.zeros((len(w.texts), self.projection.shape[1]), np.float32)
        if len(text):
            value = (np.log1p(count) * self.idf[feature]).astype(np.float32)
            begins = np.flatnonzero(np.diff(text, prepend=-1))
            for i in range(0, len(begins), 64):
                at = slice(begins[i], begins[i + 64] if i + 64 < len(begins) else len(text))
                out[text[begins[i : i + 64]]] = np.add.reduceat(self.projection[feature[at]] * value[at, None], begins[i : i + 64] - begins[i])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, w: Words) -> np.ndarray:
        """Each text's share of label 1 among its nearest labelled documents, weighted by similarity; exact, in blocks."""
        vectors, out = self.project(w), np.empty(len(w.texts))
        base = float(self.labels.mean()) if len(self.labels) else 1.0
        k = min(self.k, len(self.labels))
        for begin in range(0, len(vectors), 128):
            if not k:
                out[begin : begin + 128] = base
                continue
            products = vectors[begin : begin + 128] @ self.vectors.T
            near = np.argpartition(-products, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(products, near, 1), 0).astype(float) ** self.power
            total = weight.sum(axis=1)
            out[begin : begin + 128] = np.where(total > 0, (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), base)
        return np.clip(out, 0, 1)


def _document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts there are, and how many have each feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, rows = np.zeros(FEATURES + 1, np.int64), 0
        for batch in slices(batches, "text"):
            _, feature, _ = features(Words(batch.column("text").to_pylist()))
            has[:FEATURES] += np.bincount(feature, minlength=FEATURES)
            rows += batch.num_rows
        has[FEATURES] = rows
        at = np.flatnonzero(has)
        yield pa.record_batch({"feature": pa.array(at), "texts": pa.array(has[at])})

    has = np.zeros(FEATURES + 1)
    for r in texts.mapInArrow(count, "feature long, texts long").groupBy("feature").agg(F.sum("texts")).collect():
        has[r[0]] = r[1]
    return int(has[FEATURES]), has[:FEATURES]


@dataclass(frozen=True)
class _Sparse:
    """Rows of numbers by feature, as their ends in one array of features and one of values; products are made in blocks of rows."""

    ends: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def times(self, dense: np.ndarray, block: int = 64) -> np.ndarray:
        """The rows' products with a dense matrix; no row is empty."""
        out = np.empty((len(self.ends), dense.shape[1]), np.float32)
        begins = np.append(0, self.ends[:-1])
        for i in range(0, len(begins), block):
            at = slice(begins[i], self.ends[min(i + block, len(begins)) - 1])
            out[i : i + block] = np.add.reduceat(dense[self.feature[at]] * self.value[at, None], begins[i : i + block] - begins[i])
        return out

    def turned(self) -> tuple[_Sparse, np.ndarray]:
        """The same numbers by the features that any row has, and those features."""
        row = np.repeat(np.arange(len(self.ends), dtype=np.int32), np.diff(self.ends, prepend=0))
        order = np.argsort(self.feature, kind="stable")
        features, counts = np.unique(self.feature, return_counts=True)
        return _Sparse(np.cumsum(counts), row[order], self.value[order]), features


def _axes(x: _Sparse, rank: int) -> np.ndarray:
    """The leading right singular vectors, by seeded subspace iteration on the sparse rows."""
    by_feature, features = x.turned()
    q = np.linalg.qr(x.times(np.random.default_rng(0).standard_normal((FEATURES, rank + 16)).astype(np.float32)))[0]
    back = np.zeros((FEATURES, q.shape[1]), np.float32)
    for _ in range(3):
        back[features] = by_feature.times(q)
        q = np.linalg.qr(x.times(back))[0]
    back[features] = by_feature.times(q)
    return np.ascontiguousarray(np.linalg.svd(back, full_matrices=False)[0][:, :rank])


def fit_neighbours(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", most: int = 6000, rank: int = 32) -> Neighbours:
    """Document frequencies over all of ``docs``; latent axes and vectors from at most ``most`` labelled documents.

    ``most`` bounds what the driver gathers (a sparse row a document, as Arrow) and what is broadcast: ``most`` x
    ``rank`` numbers. An id that has several rows teaches with one of them. Labelled documents without words, labels
    without a document, and null labels teach nothing.
    """
    total, has = _document_frequencies(docs.select(F.col(text_col).alias("text")))
    idf = (np.log((1 + total) / (1 + has)) + 1).astype(np.float32)
    chosen = F.broadcast(label_sample(labels, label_col, most, id_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("label")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("id", "label", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = Words(batch.column("text").to_pylist())
            text, feature, count = features(w)
            ends = np.searchsorted(text, np.arange(len(w.texts) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (feature, count)]
            yield pa.record_batch([batch.column("id"), batch.column("label").cast(pa.float64()), *lists], names=["id", "label", "feature", "count"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, label double, feature array<int>, count array<int>"
    taught = rows.mapInArrow(extract, schema).where(F.size("feature") > 0).groupBy("id").agg(F.min(F.struct("feature", "count", "label")).alias("row"))
    found = taught.orderBy("id").select("row.*").toArrow().combine_chunks()
    if not found.num_rows:
        return Neighbours(idf, np.zeros((FEATURES, rank), np.float32), np.zeros((0, rank), np.float32), np.zeros(0))
    lists = found.column("feature").combine_chunks()
    ends, feature = np.cumsum(lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    value = np.log1p(found.column("count").combine_chunks().flatten().to_numpy()).astype(np.float32) * idf[feature]
    value /= np.repeat(np.sqrt(np.add.reduceat(value * value, np.append(0, ends[:-1]))), np.diff(ends, prepend=0))
    x, known = _Sparse(ends, feature, value), found.column("label").to_numpy()
    del found, lists
    axes = _axes(x, min(rank, len(known)))
    vectors = x.times(axes)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Neighbours(idf, axes, vectors, known)


def score_quality(docs: DataFrame, model: Neighbours, text_col: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) to every row; the other columns pass through.

    A null or empty text, or one like no labelled document, scores the labels' mean; repeated rows score alike; an
    empty table gives an empty one; a column that is called score is replaced. A model without labels scores 1.
    Of labelled vectors that are equally near at the last place some vote and others don't, as they are partitioned; the same ones for the same text.
    """
    kept = [c for c in docs.columns if c != "score"]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            score = shared.value.score(Words(batch.column(text_col).to_pylist()))
            yield pa.record_batch([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(scan, f"{fields}, score double")
