"""Operator 13: ranked lexical search by MaxScore with joint bounds of term pairs.

``build_segments`` makes an index of the whole corpus: a row is a segment, the postings of some documents on end. ``precompute``
adds what a set of queries asks of each segment: its terms' impacts and greatest impact, and the intersection lists of
chosen term pairs with the greatest impact that both terms have in one document. ``search`` reads segment by
segment and leaves out those, and those documents, that can't be among a query's best by these bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumivox.llm.storage import slices
from lumivox.llm.words import polynomial
from lumivox.plans.scratch import scratch_path, written

#: Bytes of terms (letters and digits of ASCII, and all of other characters), and each byte's lower case.
_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

#: A segment's ids and terms a document, its terms, and each one's documents (their place in ``ids``) with the term's occurrences.
SEGMENT = "ids array<{id}>, sizes array<int>, terms array<string>, ends array<int>, places array<int>, counts array<int>"
#: Terms and pairs by number; ``parts`` are impacts without the term's weight, ``floors`` the k-th greatest joint impact or zero.
PREPARED = (
    "ids array<{id}>, terms array<int>, ends array<int>, places array<int>, parts array<int>, most array<bigint>,"
    " pairs array<int>, pair_ends array<int>, pair_places array<int>, joint array<bigint>, floors array<bigint>"
)


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column (null: none), and where each begins, with the end."""
    flat = compute.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def postings(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms a text, distinct terms, ends of their lists, places of texts, occurrences); each list is in order of places.

    Terms are told apart by 64-bit hashes within a segment.
    """
    data, offsets = _strings(texts)
    data = _LOWER[data]
    inside = _TERM[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True  # no term goes on from one text to the next
    starts = np.flatnonzero(inside & (fresh[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (fresh[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    hashes = polynomial(data[inside], ends - starts)
    _, first, term = np.unique(hashes, return_index=True, return_inverse=True)
    met, counts = np.unique(term * len(texts) + text, return_counts=True)
    of, places = np.divmod(met, max(1, len(texts)))
    lengths = (ends - starts)[first]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    letters = data[np.repeat(starts[first] - bounds[:-1], lengths) + np.arange(bounds[-1])]
    names = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes()))
    return np.bincount(text, minlength=len(texts)), names, np.cumsum(np.bincount(of, minlength=len(first))), places, counts


def _row(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of one row of lists."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, f.type.value_type) if not isinstance(c, pa.Array) else c) for c, f in zip(columns, schema)]
    return pa.record_batch(lists, schema=schema)


def build_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 4 << 20, most_docs: int = 4096) -> DataFrame:
    """An index of all rows, a segment for about ``most_bytes`` of text or ``most_docs`` rows (one row at least, however long).

    Within a segment rows are in order of id, null first. Null and wordless texts have no terms. One pass without a shuffle; each
    task needs the memory of one segment.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", most_bytes):
            for at in range(0, batch.num_rows, most_docs):
                some = batch.slice(at, most_docs)
                some = some.take(compute.array_sort_indices(some.column("id"), null_placement="at_start"))
                ids = some.column("id")
                schema = pa.schema([("ids", pa.list_(ids.type)), ("sizes", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), *((n, pa.list_(pa.int32())) for n in ("ends", "places", "counts"))])
                yield _row([ids, *postings(some.column("text"))], schema)

    return rows.mapInArrow(scan, SEGMENT.format(id=kind.simpleString()))


@dataclass(frozen=True)
class Statistics:
    """Of the corpus: documents with a term, and all terms with repeats; of a batch of queries: its terms and their weights."""

    documents: int
    occurrences: int
    terms: list[str]
    weights: list[int]

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        """What a document's length adds to the lower part of its impacts, in exact integers."""
        total = max(1, self.occurrences)
        if 90 * int(sizes.max(initial=0)) * self.documents < 1 << 63:
            return 10 + 90 * sizes.astype(np.int64) * self.documents // total
        return np.array([10 + 90 * int(n) * self.documents // total for n in sizes], np.int64)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def statistics(segments: DataFrame, terms: list[str]) -> Statistics:
    """Counts over all segments; only sums a task, for the given terms, leave it."""
    sizes = segments.select(F.expr("aggregate(sizes, named_struct('n', 0L, 'l', 0L), (a, s) -> named_struct('n', a.n + if(s > 0, 1, 0), 'l', a.l + s))").alias("s"))
    n, total = sizes.agg(F.coalesce(F.sum("s.n"), F.lit(0)), F.coalesce(F.sum("s.l"), F.lit(0))).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, found = pa.array(terms, pa.string()), np.zeros(len(terms), np.int64)
        for batch in batches:
            for names, ends in zip(batch.column("terms"), batch.column("ends")):
                at = compute.index_in(asked, value_set=names.values).to_numpy(zero_copy_only=False)
                held = np.flatnonzero(~np.isnan(at))
                found[held] += np.diff(ends.values.to_numpy(), prepend=0)[at[held].astype(np.int64)]
        some = np.flatnonzero(found)
        yield pa.record_batch([pa.array(some), pa.array(found[some])], names=["term", "n"])

    holding = dict(segments.select("terms", "ends").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect()) if terms else {}
    return Statistics(n, total, terms, [weight(n, holding.get(i, 0)) for i in range(len(terms))])


@dataclass(frozen=True)
class Query:
    """The numbers of its item, of its pairs with their two terms, and of a term without a partner."""

    item: int
    pairs: tuple[tuple[int, int, int], ...]
    single: int | None


def plan(asked: list[tuple[int, list[int]]], known: Statistics) -> tuple[list[Query], list[tuple[int, int]]]:
    """The queries with their terms in pairs, by weight, and all pairs: two heavy terms that are seldom together lower a bound most."""
    numbers: dict[tuple[int, int], int] = {}
    queries = []
    for item, terms in asked:
        order = sorted((t for t in terms if known.weights[t] > 0), key=lambda t: (-known.weights[t], t))
        two = [tuple(sorted(order[i : i + 2])) for i in range(0, len(order) - 1, 2)]
        queries.append(Query(item, tuple((numbers.setdefault(p, len(numbers)), *p) for p in two), order[-1] if len(order) % 2 else None))
    return queries, list(numbers)


def precompute(segments: DataFrame, known: Statistics, pairs: list[tuple[int, int]], k: int) -> DataFrame:
    """A row a segment: impacts of the queries' terms, greatest ones, and the lists of the pairs with their joint impacts."""
    kind = segments.schema["ids"].dataType.elementType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = pa.array(known.terms, pa.string()), np.array(known.weights, np.int64)
        by_first: dict[int, list[tuple[int, int]]] = {}
        for number, (a, b) in enumerate(pairs):
            by_first.setdefault(a, []).append((number, b))
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, names, ends, places, counts = (c[i].values for c in batch.columns)
                at = compute.index_in(asked, value_set=names).to_numpy(zero_copy_only=False)
                terms = np.flatnonzero(~np.isnan(at))
                ends = np.concatenate([[0], ends.to_numpy()])
                places, counts = places.to_numpy(), counts.to_numpy().astype(np.int64)
                longer = 8 * known.lengths(sizes.to_numpy())
                lists = {}
                for t in terms:
                    begin, end = ends[int(at[t])], ends[int(at[t]) + 1]
                    tf = counts[begin:end]
                    lists[t] = places[begin:end], 1_000_000_000 * tf // (1000 * tf + longer[places[begin:end]])
                seen, joint, floors, both = [], [], [], []
                mark = np.zeros(len(sizes), np.int64)
                for a in terms:
                    if a not in by_first:
                        continue
                    mark[lists[a][0]] = weights[a] * lists[a][1]
                    for number, b in by_first[a]:
                        if b not in lists:
                            continue
                        others, parts = lists[b]
                        mine = mark[others]
                        held = np.flatnonzero(mine)
                        if len(held):
                            sums = mine[held] + weights[b] * parts[held]
                            seen.append(number)
                            both.append(others[held])
                            joint.append(int(sums.max()))
                            floors.append(int(np.partition(sums, len(sums) - k)[len(sums) - k]) if len(sums) >= k else 0)
                    mark[lists[a][0]] = 0
                order = np.argsort(seen, kind="stable")
                columns = [
                    ids, terms, np.cumsum([len(lists[t][0]) for t in terms]), _end_to_end([lists[t][0] for t in terms]), _end_to_end([lists[t][1] for t in terms]),
                    [int(weights[t] * lists[t][1].max()) for t in terms], np.array(seen)[order], np.cumsum([len(both[j]) for j in order]), _end_to_end([both[j] for j in order]),
                    np.array(joint)[order], np.array(floors)[order],
                ]
                types = [pa.int32()] * 4 + [pa.int64()] + [pa.int32()] * 3 + [pa.int64()] * 2
                names = ("terms", "ends", "places", "parts", "most", "pairs", "pair_ends", "pair_places", "joint", "floors")
                schema = pa.schema([("ids", pa.list_(ids.type)), *((n, pa.list_(x)) for n, x in zip(names, types))])
                yield _row([c if isinstance(c, pa.Array) else np.asarray(c).astype(f.type.value_type.to_pandas_dtype()) for c, f in zip(columns, schema)], schema)

    return segments.mapInArrow(scan, PREPARED.format(id=kind.simpleString()))


def _end_to_end(lists: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(lists) if lists else np.empty(0, np.int64)


class _Segment:
    """A precomputed segment's lists and bounds by number."""

    def __init__(self, row: list[np.ndarray], documents: int, weights: np.ndarray):
        terms, ends, self.places, self.parts, most, pairs, pair_ends, self.both, joint = row
        self.documents, self.weights = documents, weights
        self.most = dict(zip(terms.tolist(), most.tolist()))
        self.joint = dict(zip(pairs.tolist(), joint.tolist()))
        self.terms = {t: slice(a, b) for t, a, b in zip(terms.tolist(), [0, *ends.tolist()], ends.tolist())}
        self.pairs = {p: slice(a, b) for p, a, b in zip(pairs.tolist(), [0, *pair_ends.tolist()], pair_ends.tolist())}

    def bounds(self, pair: int, a: int, b: int) -> tuple[int, int]:
        """The most that a document has of both terms, and one that isn't in their intersection list."""
        alone = max(self.most.get(a, 0), self.most.get(b, 0))
        return max(alone, self.joint.get(pair, 0)), alone

    def best(self, query: Query, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the query's documents with a score of ``least`` or more, at most the k best (equal ones by place).

        Units are the pairs and the term without a partner. The smallest whose bounds together stay below ``least`` can't
        lift a document alone, so candidates come from the lists of the others; then each further unit is added to the candidates
        whose score so far and bounds still reach ``least``, those outside its intersection list by the lower bound.
        """
        units = [(*self.bounds(*p), p) for p in query.pairs]
        if query.single is not None:
            units.append((self.most.get(query.single, 0), self.most.get(query.single, 0), (-1, query.single, -1)))
        units = sorted((u for u in units if u[0]), key=lambda u: u[0])
        ahead = np.concatenate([[0], np.cumsum([u[0] for u in units], dtype=np.int64)])
        if ahead[-1] < least or not units:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        spared = int(np.searchsorted(ahead[1:], least, "left"))  # units that stay below ``least`` all together
        total = np.zeros(self.documents, np.int64)
        for _, _, (_, a, b) in units[spared:]:
            self._add(total, a)
            self._add(total, b)
        found = np.flatnonzero(total)
        for i in range(spared - 1, -1, -1):
            whole, alone, (pair, a, b) = units[i]
            found = found[total[found] + ahead[i + 1] >= least]
            if whole > alone:
                listed = np.zeros(self.documents, bool)
                listed[self.both[self.pairs[pair]]] = True
                found = found[total[found] + ahead[i] + np.where(listed[found], whole, alone) >= least]
            if not len(found):
                break
            self._add(total, a)
            self._add(total, b)
        scores = total[found]
        kept = scores >= max(1, least)
        found, scores = found[kept], scores[kept]
        if len(found) > k:
            order = np.lexsort((found, -scores))[:k]
            found, scores = found[order], scores[order]
        return found, scores

    def _add(self, total: np.ndarray, term: int) -> None:
        if term in self.terms:
            at = self.terms[term]
            total[self.places[at]] += self.weights[term] * self.parts[at].astype(np.int64)


def best_of_segments(prepared: DataFrame, queries: list[Query], known: Statistics, least: dict[int, int], k: int) -> DataFrame:
    """``item, part, doc_id, score``: the best of each task's segments, which rises the score that the next segments must reach."""
    kind = prepared.schema["ids"].dataType.elementType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(known.weights, np.int64)
        floor = {q.item: max((least.get(p, 0) for p, _, _ in q.pairs), default=0) for q in queries}
        held: dict[int, list[tuple]] = {q.item: [] for q in queries}
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                segment = _Segment([batch.column(c)[i].values.to_numpy() for c in batch.schema.names[1:]], len(ids), weights)
                for q in queries:
                    places, scores = segment.best(q, floor[q.item], k)
                    if len(places):
                        new = zip(scores.tolist(), ids.take(pa.array(places)).to_pylist())
                        held[q.item] = sorted([*held[q.item], *new], key=lambda r: (-r[0], r[1] is not None, r[1]))[:k]
                        if len(held[q.item]) == k:
                            floor[q.item] = max(floor[q.item], held[q.item][-1][0])
        rows = [(item, r[1], r[0]) for item, some in held.items() for r in some]
        if rows:
            items, names, scores = zip(*rows)
            part = np.full(len(rows), TaskContext.get().partitionId())
            yield pa.record_batch([pa.array(items, pa.int64()), pa.array(part, pa.int64()), pa.array(names, id_type), pa.array(scores, pa.int64())], names=["item", "part", "doc_id", "score"])

    return prepared.drop("floors").mapInArrow(scan, f"item long, part long, doc_id {kind.simpleString()}, score long")


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, term)``, each once: the terms of all rows that an id has."""
    lowered = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lowered, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    return queries.select(F.col(id_col).alias("id"), F.explode(found).alias("term")).distinct()


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", per_batch: int = 1 << 17) -> DataFrame:
    """``query_id, rank, doc_id, score``: each query's ``k`` best documents with a score above zero, equal ones by ascending id (null first).

    A query is all rows of an id (a null id is one, too): its terms count once, whatever their number. Documents that repeat an id are
    documents of their own. Queries are worked off in batches of about ``per_batch`` terms, which is what
    a task holds of them; there are as many batches as their terms need. No document, segment or partner is
    left out but by a bound that it can't reach. Extra columns are left out; empty tables give an empty one.
    """
    spark = docs.sparkSession
    segments = _stored(build_segments(docs, id_col, text_col), "segments")
    asked = written(query_terms(queries, query_id, query_text), "asked")
    batches = max(1, -(-asked.count() // per_batch))
    dealt = F.pmod(F.xxhash64("id"), F.lit(batches))
    found = None
    for i in range(batches):
        rows = asked.where(dealt == i)
        names = [r["id"] for r in rows.select("id").distinct().orderBy("id").collect()]
        numbers = {n: j for j, n in enumerate(names)}
        pairs = [(numbers[r["id"]], r["term"]) for r in rows.collect()]
        terms = sorted({t for _, t in pairs})
        place = {t: j for j, t in enumerate(terms)}
        by_item: dict[int, list[int]] = {}
        for item, term in pairs:
            by_item.setdefault(item, []).append(place[term])
        known = statistics(segments, terms)
        plans, two = plan(sorted(by_item.items()), known)
        prepared = _stored(precompute(segments, known, two, k), "prepared")
        least = dict(prepared.select(F.explode(F.arrays_zip("pairs", "floors")).alias("p")).where("p.floors > 0").groupBy("p.pairs").agg(F.max("p.floors")).collect())
        best = best_of_segments(prepared, plans, known, least, k)
        title = spark.createDataFrame(list(enumerate(names)), f"item long, `{query_id}` {asked.schema['id'].dataType.simpleString()}")
        best = best.join(F.broadcast(title), "item")
        found = best if found is None else found.unionByName(best)
    order = [F.desc("score"), F.asc("doc_id")]
    some = Window.partitionBy("item", query_id, F.col("part") % 64).orderBy(*order)
    every = Window.partitionBy("item", query_id).orderBy(*order)
    part = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k).select(query_id, "rank", "doc_id", "score")


def _stored(segments: DataFrame, name: str) -> DataFrame:
    """Segments as a table in small row groups, as one row is large.

    A group's size is looked at after every row: the writer waits for a hundred rows otherwise, which then are in memory at once, and
    again whenever a task reads them.
    """
    path = scratch_path(segments.sparkSession, name)
    segments.write.option("parquet.block.size", 16 << 20).option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 1).parquet(path)
    return segments.sparkSession.read.schema(segments.schema).parquet(path)
