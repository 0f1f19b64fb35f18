"""Operator 2: passages that repeat across documents, by collinear chains of shared k-mers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumivox.llm.storage import slices
from lumivox.llm.words import Words
from lumivox.plans.joins import split_join
from lumivox.plans.scratch import written

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Chaining:
    """k-mers of ``size`` words; one seed at least in ``spread`` k-mers on end; what chains cost and keep.

    A gap of g words between two seeds costs ``gap`` * g on either side, and a chain breaks where that is more than
    it has gained. Passages have ``words`` words or more and ``similarity`` of them in place.
    """

    size: int = 5
    spread: int = 10
    gap: float = 0.125
    words: int = 50
    similarity: float = 0.8


#: Runs of up to so many words in turn are shortened.
_PERIODS = 8


def _turns(period: int) -> int:
    """How many words on end must be those ``period`` words before, for what follows to be gone: a k-mer of one word, two of several in turn."""
    return Chaining.size * min(period, 2)


def _kept(period: int) -> int:
    """How many words a shortened run keeps: so many that it has seeds, and the same ones however long it is."""
    return _turns(period) + period - 1


def _shortened(texts: list[str | None]) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words without those of long runs of a few words in turn, the places of those left in their texts, and at each the period of the run that is cut before it (0: none)."""
    w = Words(texts)
    first = w.first[w.text]
    n = len(w.text)
    period = np.zeros(n, np.int8)
    for p in range(_PERIODS, 0, -1):  # the shortest period is set last
        turns = _turns(p)
        if n >= turns + p:
            same = np.concatenate([[0], np.cumsum((w.hashes[p:] == w.hashes[:-p]) & (w.text[p:] == w.text[:-p]))])
            at = np.flatnonzero(same[turns:] - same[:-turns] == turns) + p + turns - 1
            period[at[w.text[at] == w.text[at - p - turns + 1]]] = p
    gone = period > 0
    place = np.arange(n) - first
    lengths = w.counts
    w.hashes, w.text, w.starts, w.ends = w.hashes[~gone], w.text[~gone], w.starts[~gone], w.ends[~gone]
    w.counts = np.bincount(w.text, minlength=len(w.texts))
    w.first = np.cumsum(w.counts) - w.counts
    w.lengths = lengths
    begins = gone & ~np.append(False, gone[:-1]) if n else gone
    cut = np.zeros(len(w.text) + 1, np.int8)  # a run at the end of the last text is cut behind all words
    np.maximum.at(cut, (np.cumsum(~gone) - ~gone)[begins], period[begins])
    return w, place[~gone], cut


def _cuts(w: Words, place: np.ndarray, cut: np.ndarray, i: int) -> np.ndarray:
    """Where words of text ``i`` are gone, in threes: a place in the shortened text, how many are gone before it in all, and how many words of the run are kept."""
    x, y = int(w.first[i]), int(w.first[i] + w.counts[i])
    less = np.append(place[x:y], w.lengths[i]) - np.arange(y - x + 1)
    at = np.flatnonzero(np.diff(less, prepend=0))
    return np.stack([at, less[at], [_kept(max(1, int(p))) for p in cut[x + at]]], axis=1).ravel().astype(np.int32)


def _seeds(w: Words, c: Chaining) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the seeds: of each window of ``spread`` k-mers within a text the least hash, its first occurrence.

    k-mers of one word alone are seeds too; a text with fewer than ``spread`` k-mers gives them all.
    """
    at, h = w.windows(c.size)
    if not len(at):
        return at, h
    text = w.text[at]
    chosen = np.zeros(len(at), bool)
    if len(at) >= c.spread:
        windows = np.lib.stride_tricks.sliding_window_view(h, c.spread)
        begins = np.flatnonzero(text[: len(windows)] == text[c.spread - 1 :])
        chosen[begins + windows[begins].argmin(axis=1)] = True
    few = np.bincount(text, minlength=len(w.texts)) < c.spread
    chosen |= few[text]
    said = np.ones(len(at), bool)
    for j in range(1, c.size):
        said &= w.hashes[at + j] == w.hashes[at]
    chosen |= said
    return at[chosen], h[chosen]


def find_seeds(rows: DataFrame, c: Chaining) -> DataFrame:
    """``(hash, doc, at, first, said)`` of the seeds of ``doc, text``: whether the document has that hash first, and whether it is shortened."""

    kept = np.array([0, *map(_kept, range(1, _PERIODS + 1))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w, place, cut = _shortened(batch.column("text").to_pylist())
            at, h = _seeds(w, c)
            # A run that is a passage by itself has two more seeds before its cut, so that it meets the first run as long, not the first one.
            all_at, all_h = w.windows(c.size)
            ends = all_at + c.size
            last = w.first[w.text[all_at]] + w.counts[w.text[all_at]]
            on = np.where(ends < last, place[np.minimum(ends, max(0, len(place) - 1))], w.lengths[w.text[all_at]]) if len(all_at) else all_at
            gap = on - place[ends - 1] - 1
            runs = np.flatnonzero((gap > 0) & (gap + kept[cut[ends]] >= c.words))
            twice = runs[(cut[ends[runs]] > 1) & (all_at[runs] > 0)] - 1  # a lone seed is no chain, but that of one word
            at = np.concatenate([at, all_at[runs], all_at[twice]])
            h = np.concatenate([h, all_h[runs] ^ np.uint64(0x9E3779B97F4A7C15), all_h[twice] ^ np.uint64(0x9E3779B97F4A7C15)])
            text = w.text[at]
            order = np.lexsort((at, h, text))
            first = np.ones(len(at), bool)
            first[order[1:]] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
            yield pa.record_batch({"hash": pa.array(h.view(np.int64)), "doc": batch.column("doc").take(pa.array(text)), "at": pa.array((at - w.first[text]).astype(np.int32)), "first": pa.array(first), "said": pa.array((w.lengths != w.counts)[text])})

    return rows.mapInArrow(scan, f"hash long, doc {rows.schema['doc'].dataType.simpleString()}, at int, first boolean, said boolean")


def neighbours(shared: DataFrame, c: Chaining) -> DataFrame:
    """``(doc, at, other, there, said)``: ends of two and of four neighbouring seeds, joined with the first document that has them so.

    ``shared`` are the seeds (``hash, doc, at, other, there, said``) that two documents have. Those whose first
    occurrences lie on one diagonal are chained already, in whatever document they are, and are left out. Every
    common run of 50 words has four neighbouring seeds, so it meets the first document with those four. Of documents
    that meet so all common seeds are given, also those that edits have parted from their neighbours.
    """
    row = Window.partitionBy("doc").orderBy("at", "hash")
    names = ("hash", "at", "other", "there")
    ahead = shared.repartition("doc").dropDuplicates(["doc", "at", "hash"]).select("doc", "said", *names, *[F.lead(k, n).over(row).alias(f"{k}{n}") for n in (1, 2, 3) for k in names])
    at = ["at", "at1", "at2", "at3"]
    held = lambda n: (F.col(at[n]) - F.col(at[n - 1])).between(1, c.spread)
    same = lambda n: (F.col(f"other{n}") == F.col("other")) & (F.col(f"there{n}") - F.col("there") == F.col(at[n]) - F.col("at"))
    key = lambda n: F.xxhash64(F.lit(n), "hash", *[x for m in range(1, n) for x in (F.col(f"hash{m}"), F.col(at[m]) - F.col("at"))])
    two = F.when(held(1) & ~same(1), F.struct(key(2).alias("key"), (F.col("at1") - F.col("at")).alias("span")))
    four = F.when(held(1) & held(2) & held(3) & ~(same(1) & same(2) & same(3)), F.struct(key(4).alias("key"), (F.col("at3") - F.col("at")).alias("span")))
    tuples = ahead.select("doc", "at", "said", F.explode(F.array(two, four)).alias("t")).where("t is not null").select("doc", "at", "said", "t.key", "t.span")
    tuples = written(tuples, "neighbours")
    first = tuples.groupBy("key").agg(F.min(F.struct("doc", "at")).alias("f"), F.max("doc").alias("last")).where("f.doc < last").select("key", F.col("f.doc").alias("other"), F.col("f.at").alias("there"))
    met = written(split_join(tuples, first, "key").where("other < doc").select("doc", "at", "span", "other", "there", "said"), "met_neighbours")
    ends = met.select("doc", F.explode(F.array(F.lit(0), "span")).alias("on"), "at", "other", "there", "said").select("doc", (F.col("at") + F.col("on")).alias("at"), "other", (F.col("there") + F.col("on")).alias("there"), "said")
    own, theirs = shared.select("doc", "hash", "at", "said"), shared.groupBy(F.col("doc").alias("other"), "hash").agg(F.min("at").alias("there"))
    alone = split_join(met.select("doc", "other").distinct().join(own, "doc"), theirs, ["other", "hash"]).select("doc", "at", "other", "there", "said")
    return ends.unionByName(alone)


class _Fenwick:
    """Prefix maxima of (value, index) pairs that come one by one."""

    def __init__(self, size: int):
        self.best = [(0.0, -1)] * (size + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """The largest value at places below ``i``; (0, -1) where there is none above zero."""
        found = (0.0, -1)
        while i > 0:
            found = max(found, self.best[i])
            i -= i & -i
        return found


def chain(begin: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray, gap: float) -> list[list[int]]:
    """Chains of matches that are in order in both texts, each match in one chain, the best chain first.

    Matches are sorted by ``begin``. The best predecessor ends before a match in both texts; with linear gap costs
    that is a prefix maximum over the other text's ends, which the Fenwick tree keeps as the matches are swept.
    """
    n = len(begin)
    if n == 1:
        return [[0]]
    ends = np.unique(other_end)
    tree = _Fenwick(len(ends))
    by_end = np.argsort(end, kind="stable")
    score, back = [0.0] * n, [-1] * n
    waiting = 0
    for i in range(n):
        while waiting < n and end[by_end[waiting]] <= begin[i] and by_end[waiting] < i:
            j = int(by_end[waiting])
            tree.put(int(np.searchsorted(ends, other_end[j])), (score[j] + gap * float(end[j] + other_end[j]) + 1e-9, j))
            waiting += 1
        value, j = tree.upto(int(np.searchsorted(ends, other[i], "right")))
        carried = value - gap * float(begin[i] + other[i]) if j >= 0 else 0.0
        score[i] = float(end[i] - begin[i]) + max(0.0, carried)
        back[i] = j if carried > 0 else -1
    used, chains = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            chains.append(path[::-1])
    return chains


def _chains_of(doc, table: dict[str, np.ndarray], c: Chaining) -> Iterator[dict]:
    """The chains of one document's matches with each other document: ends in both, and the runs in between."""
    order = np.lexsort((table["at"], table["there"] - table["at"], table["other"]))
    other, at, there = (table[k][order] for k in ("other", "at", "there"))
    new = np.ones(len(at), bool)  # rows of a document that is there twice
    new[1:] = (other[1:] != other[:-1]) | (there[1:] != there[:-1]) | (at[1:] != at[:-1])
    other, at, there = other[new], at[new], there[new]
    turn = np.ones(len(at), bool)  # matches on one diagonal make a run, whose words are compared later
    turn[1:] = (other[1:] != other[:-1]) | (there[1:] - at[1:] != there[:-1] - at[:-1]) | (at[1:] - at[:-1] > 4 * c.words)
    begins = np.flatnonzero(turn)
    lasts = np.append(begins[1:], len(at)) - 1
    run = {"other": other[begins], "b": at[begins], "e": at[lasts] + c.size, "ob": there[begins], "oe": there[lasts] + c.size, "from": begins, "to": lasts + 1}
    order = np.lexsort((run["ob"], run["b"], run["other"]))
    run = {k: v[order] for k, v in run.items()}
    found = []
    edges = np.append(np.flatnonzero(np.append(True, run["other"][1:] != run["other"][:-1])), len(order))
    for x, y in zip(edges[:-1], edges[1:]):
        part = {k: v[x:y] for k, v in run.items()}
        for path in chain(part["b"], part["e"], part["ob"], part["oe"], c.gap):
            seeds = sum(int(part["to"][i] - part["from"][i]) for i in path)
            found.append((int(part["b"][path[0]]), int(part["e"][path[-1]]), {"doc": doc, "other": part["other"][0], "runs": [int(z) for i in path for z in (part["b"][i], part["ob"][i], part["e"][i] - part["b"][i])]}, seeds))
    # A lone seed is no chain: two neighbours that an earlier document has so are matched with it as two (see `neighbours`),
    # wherever each of them is first. But a run of one word has no more than one.
    if not table["said"][0]:
        found = [x for x in found if x[3] > 1]
    if not found:
        return
    # No chain is left out for another that covers its words: which of them agree word for word is known after alignment only.
    # Chains with several documents may lie end to end in one passage, so they are kept or left by what they cover together.
    found.sort(key=lambda x: x[0])
    near, least = 2 * c.spread, c.size if table["said"][0] else c.words - 2 * (c.spread + c.size)
    group: list = []
    reach = 0
    for item in [*found, None]:
        if item is None or (group and item[0] > reach + near):
            if reach - group[0][0] >= least:
                yield from (g[2] for g in group)
            group = []
        if item is not None:
            reach = max(reach, item[1]) if group else item[1]
            group.append(item)


def find_chains(matches: DataFrame, c: Chaining) -> DataFrame:
    """``(doc, other, runs array<int>)`` of ``doc, at, other, there``: for each chain its runs' places in both and lengths."""
    kind = matches.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, other {kind}, runs array<int>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = {k: table.column(k).to_numpy(zero_copy_only=False) for k in table.column_names}
            edges = np.append(np.flatnonzero(np.append(True, columns["doc"][1:] != columns["doc"][:-1])), table.num_rows)
            out = [row for x, y in zip(edges[:-1], edges[1:]) for row in _chains_of(columns["doc"][x], {k: v[x:y] for k, v in columns.items()}, c)]
            if out:
                field = table.schema.field("doc").type
                yield pa.record_batch({"doc": pa.array([r["doc"] for r in out], field), "other": pa.array([r["other"] for r in out], field), "runs": pa.array([r["runs"] for r in out], pa.list_(pa.int32()))})

        for batch in batches:  # a document's matches may go on in the next batch
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("doc").to_numpy(zero_copy_only=False)
            whole = int(np.argmax(ids == ids[-1]))
            if whole:
                yield from done(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held).combine_chunks())

    return matches.select("doc", "at", "other", "there", "said").repartition("doc").sortWithinPartitions("doc").mapInArrow(scan, schema)


def _common(a: np.ndarray, b: np.ndarray, most: int = 64) -> int:
    """The longest common subsequence of two gaps; of longer ones, the words that both begin and end with."""
    if not len(a) or not len(b):
        return 0
    if len(a) > most or len(b) > most:
        n = min(len(a), len(b))
        fore = int(np.argmin(np.append(a[:n] == b[:n], False)))
        aft = int(np.argmin(np.append(a[::-1][: n - fore] == b[::-1][: n - fore], False)))
        return fore + aft
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        new = np.maximum(row[1:], row[:-1] + (b == x))
        row = np.append(0, np.maximum.accumulate(new))
    return int(row[-1])


def _onward(a: list[int], b: list[int], most: int = 6, sure: int = 3) -> tuple[int, int, int]:
    """How far two runs of words go on together through edits: places reached in both, and words in place.

    At words that differ up to ``most`` are passed over on either side, the fewest after which ``sure`` words agree. A word in place
    gains one and a word passed over costs two, so what is reached is four fifths alike; the best of all places counts.
    """
    i = j = matched = score = top = 0
    best = (0, 0, 0)
    while True:
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j, matched, score = i + 1, j + 1, matched + 1, score + 1
        if score > top:
            top, best = score, (i, j, matched)
        if score < top - 2 * most:
            return best
        for x, y in _passed(most):
            if a[i + x : i + x + sure] == b[j + y : j + y + sure] and len(a) >= i + x + sure and len(b) >= j + y + sure:
                i, j, score = i + x, j + y, score - 2 * max(x, y)
                break
        else:
            return best


@cache
def _passed(most: int) -> list[tuple[int, int]]:
    """Numbers of words to pass over in two texts, the fewest first, as many in both before others."""
    return sorted(((x, y) for x in range(most + 1) for y in range(most + 1) if x or y), key=lambda p: (max(p), p[0] != p[1], p))


def align(mine: np.ndarray, theirs: np.ndarray, runs: list[tuple[int, int, int]], apart: int, reach: int = 64) -> list[tuple[int, int, int, int, int]]:
    """The aligned stretches of a chain: begin and end of each in both texts, and its words in place.

    A run's words are compared one for one; it is parted where more than ``apart`` words on end differ, and a
    stretch ends where a longer gap than that follows. What lies in a shorter gap is aligned for the most common
    words. The ends of a stretch reach out as far as the words agree, and on through edits, up to ``reach`` words, where most of them do.
    """
    agreed: list[tuple[int, int, int, int]] = []  # begin in both, length, words in place
    for b, ob, length in runs:
        same = np.flatnonzero(mine[b : b + length] == theirs[ob : ob + length])
        if len(same):
            for part in np.split(same, np.flatnonzero(np.diff(same) > apart) + 1):
                agreed.append((b + int(part[0]), ob + int(part[0]), int(part[-1] - part[0]) + 1, len(part)))
    out: list[list[int]] = []
    for b, ob, length, matched in agreed:
        if out:
            gap, other_gap = b - out[-1][1], ob - out[-1][3]
            if gap < 0 or other_gap < 0:  # runs that overlap: the earlier one keeps its words
                cut = max(-gap, -other_gap)
                if cut >= length:
                    continue
                b, ob, length = b + cut, ob + cut, length - cut
                matched = int((mine[b : b + length] == theirs[ob : ob + length]).sum())
                gap, other_gap = gap + cut, other_gap + cut
            if max(gap, other_gap) <= apart:
                out[-1][4] += _common(mine[out[-1][1] : b], theirs[out[-1][3] : ob]) + matched
                out[-1][1], out[-1][3] = b + length, ob + length
                continue
        out.append([b, b + length, ob, ob + length, matched])
    for stretch in out:
        b, e, ob, oe, _ = stretch
        n, m = min(b, ob), min(len(mine) - e, len(theirs) - oe)
        back = int(np.argmin(np.append(mine[b - n : b][::-1] == theirs[ob - n : ob][::-1], False)))
        on = int(np.argmin(np.append(mine[e : e + m] == theirs[oe : oe + m], False)))
        b, e, ob, oe, matched = b - back, e + on, ob - back, oe + on, stretch[4] + back + on
        x, ox, more = _onward(mine[max(0, b - reach) : b][::-1].tolist(), theirs[max(0, ob - reach) : ob][::-1].tolist())
        y, oy, yet = _onward(mine[e : e + reach].tolist(), theirs[oe : oe + reach].tolist())
        stretch[:] = b - x, e + y, ob - ox, oe + oy, matched + more + yet
    return [tuple(x) for x in out]


def _word_arrays(rows: DataFrame) -> DataFrame:
    """``(doc, words array<int>, gone array<int>)``: 32 bits of the hash of each word of the shortened text, and where words are gone.

    ``gone`` has threes, as ``_cuts`` gives them. Most texts have none.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w, place, cut = _shortened(batch.column("text").to_pylist())
            ends = np.append(w.first, len(w.starts))
            held = {int(i): _cuts(w, place, cut, int(i)) for i in np.flatnonzero(w.lengths != w.counts)}
            yield pa.record_batch({
                "doc": batch.column("doc"), "words": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((w.hashes >> np.uint64(32)).astype(np.uint32).view(np.int32))),
                "gone": pa.array([held.get(i, ()) for i in range(len(w.texts))], pa.list_(pa.int32())),
            })

    return rows.mapInArrow(scan, f"doc {rows.schema['doc'].dataType.simpleString()}, words array<int>, gone array<int>")


def _place(x: int, gone: np.ndarray) -> int:
    """The place in the whole text of a place in the shortened one."""
    n = int(np.searchsorted(gone[::3], x, "right"))
    return x + (int(gone[3 * n - 2]) if n else 0)


def _parts(mine: np.ndarray, theirs: np.ndarray, steps: list[tuple[int, int, int]], stretch: tuple, own_gone: np.ndarray, gone: np.ndarray, b: int, ob: int, c: Chaining) -> Iterator[tuple]:
    """What a stretch holds where shortened runs of unlike lengths part it: begin and end of each part in both whole texts, and its similarity.

    A part has ``min(own, their)`` words of the runs at its ends; a run that is a passage by itself is given in pieces of that length.
    """
    x, y, ox, oy, _ = stretch
    on = [(s, o, n) for s, o, n in steps if s < y and s + n > x]
    near = lambda p, side: min(on, key=lambda r: max(r[side] - p, p - r[side] - r[2], 0))
    less = lambda at, held: _place(at, held) - at - (_place(at - 1, held) - at + 1)
    cuts: dict[tuple[int, int], int] = {}
    for p, kept in zip(own_gone[::3] - b, own_gone[2::3]):
        if x < p <= y:
            r = near(p, 0)
            cuts[int(p), int(p - r[0] + r[1])] = int(kept)
    for q, kept in zip(gone[::3] - ob, gone[2::3]):
        if ox < q <= oy:
            r = near(q, 1)
            cuts[int(q - r[1] + r[0]), int(q)] = int(kept)
    bounds, most = [(x, ox, 0, 0)], c.spread + c.size
    for (p, q), kept in sorted(cuts.items()):
        own, their = less(p + b, own_gone), less(q + ob, gone)
        if own != their and bounds[-1][0] < p <= y and bounds[-1][1] < q <= oy:
            n = kept + min(own, their)
            bounds.append((p, q, n, kept))
            if n >= c.words and own > their and (mine[max(0, p - kept) : p] == theirs[max(0, q - kept) : q][-p:]).all():
                first, source = _place(p + b - 1, own_gone) + 1 - kept, _place(q + ob - 1, gone) + 1 - kept
                period = kept if kept == _kept(1) else kept - _turns(2) + 1
                step = n if kept == _kept(1) else n // period * period  # so that every piece begins where the source's run does
                last = kept + own - n if kept == _kept(1) else (kept + own - n) // period * period
                for at in sorted({*range(0, last, step), last}):
                    yield first + at, first + at + n, source, source + n, 1.0
    bounds.append((y, oy, 0, 0))
    for (x0, o0, fore, _), (x1, o1, aft, kept) in zip(bounds[:-1], bounds[1:]):
        inner = []
        for s, o, n in steps:
            cut = max(x0 - s, o0 - o, 0)
            n = min(n, x1 - s, o1 - o)
            if cut < n:
                inner.append((s + cut - x0, o + cut - o0, n - cut))
        for s, e, os, oe, matched in align(mine[x0:x1], theirs[o0:o1], inner, most):
            s, e, os, oe = s + x0, e + x0, os + o0, oe + o0
            places = [_place(s + b, own_gone), _place(e + b - 1, own_gone) + 1, _place(os + ob, gone), _place(oe + ob - 1, gone) + 1]
            more = 0
            if fore and (s, os) == (x0, o0):
                places[0], places[2], more = places[0] - fore, places[2] - fore, fore
            if aft and (e, oe) == (x1, o1):
                places[1], places[3], more = places[1] + aft - kept, places[3] + aft - kept, more + aft - kept
            own, their = places[1] - places[0], places[3] - places[2]
            if matched >= c.similarity * max(e - s, oe - os) and min(own, their) >= c.similarity * max(own, their):
                yield (*places, (matched + more) / (max(e - s, oe - os) + more))


def repeated_passages(docs: DataFrame, c: Chaining = Chaining(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start_word, end_word, n_words, source_doc_id, source_start, source_end, similarity)`` of every repeated passage.

    One row a passage of a document that an earlier one (of lower id) has too, so the first of all that
    share a passage has no row but is, or leads to, the source of the others. Seeds are joined with their first
    occurrence only, so a passage of n documents makes n - 1 chains, not a pair for every two; neighbouring seeds that
    are first in several documents are joined once more, together, with the first document that has them so; a passage
    whose parts first occur in several documents is put together from their chains. The seeds and the aligned
    words are shuffled, a document's own matches are the largest group.
    What is given has ``similarity`` of its words in place. Of passages that are so alike, those that are 0.9 alike or more are found (0.94 of their words and more on edited
    passages); of those between 0.85 and 0.9 three quarters of the words, and below that a third, as two seeds must be left of one in ``spread`` k-mers.
    Texts are compared word by word, long runs of up to eight words in turn (or of one) by their first words and their length
    (stretches whose whole lengths aren't alike, as ``similarity`` is, are parted at such runs then); repeats within one document alone are none; null or wordless
    texts have none; rows with a null id aren't compared; rows that repeat an id and text count once; an empty
    table gives an empty one; extra columns are left out. Exact copies are passages as long as the document.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    seeds = written(find_seeds(rows, c), "seeds")
    first = seeds.where("first").groupBy("hash").agg(F.min("doc").alias("other"), F.min_by("at", "doc").alias("there"), F.max("doc").alias("last")).where("other < last").drop("last")
    shared = written(seeds.join(written(first, "first"), "hash").select("hash", "doc", "at", "other", "there", "said"), "shared")
    matches = shared.where("other < doc").select("doc", "at", "other", "there", "said").unionByName(neighbours(shared, c))
    chains = written(find_chains(matches, c), "chains")

    words = _word_arrays(rows)
    margin = c.words + c.spread + c.size
    begin = lambda at: F.greatest(F.lit(0), F.get("runs", at) - margin)
    size = F.size("runs")
    placed = chains.withColumn("b", begin(F.lit(0))).withColumn("ob", begin(F.lit(1)))
    placed = placed.withColumn("e", F.get("runs", size - 3) + F.get("runs", size - 1) + margin).withColumn("oe", F.get("runs", size - 2) + F.get("runs", size - 1) + margin)
    own = placed.join(words, "doc").withColumn("mine", F.slice("words", F.col("b") + 1, F.col("e") - F.col("b"))).drop("words").withColumnRenamed("gone", "own_gone")
    both = own.join(words.withColumnRenamed("doc", "other"), "other").withColumn("theirs", F.slice("words", F.col("ob") + 1, F.col("oe") - F.col("ob"))).drop("words")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["start_word", "end_word", "source_start", "source_end"]
        for batch in batches:
            keep, out = [], []
            columns = (batch.column(k) for k in ("b", "ob", "runs", "mine", "theirs", "own_gone", "gone"))
            for i, (b, ob, runs, mine, theirs, own_gone, gone) in enumerate(zip(*columns)):
                b, ob, flat, own_gone, gone = b.as_py(), ob.as_py(), runs.values.to_numpy(), own_gone.values.to_numpy(), gone.values.to_numpy()
                steps = [(int(x - b), int(y - ob), int(z)) for x, y, z in flat.reshape(-1, 3)]
                for x, y, ox, oy, matched in align(mine.values.to_numpy(), theirs.values.to_numpy(), steps, c.spread + c.size):
                    if matched >= c.similarity * max(y - x, oy - ox):
                        places = _place(x + b, own_gone), _place(y + b, own_gone), _place(ox + ob, gone), _place(oy + ob, gone)
                        own, their = places[1] - places[0], places[3] - places[2]
                        parts = [(*places, matched / max(y - x, oy - ox))]
                        if min(own, their) < c.similarity * max(own, their):
                            parts = list(_parts(mine.values.to_numpy(), theirs.values.to_numpy(), steps, (x, y, ox, oy, matched), own_gone, gone, b, ob, c))
                        keep += [i] * len(parts)
                        out += parts
            if keep:
                taken = pa.array(keep)
                *places, share = zip(*out)
                yield pa.record_batch([batch.column("doc").take(taken), batch.column("other").take(taken), *[pa.array(v, pa.int32()) for v in places], pa.array(share)], names=["doc", "other", *names, "share"])

    kind = rows.schema["doc"].dataType.simpleString()
    spans = both.mapInArrow(scan, f"doc {kind}, other {kind}, start_word int, end_word int, source_start int, source_end int, share double").distinct()
    order = Window.partitionBy("doc").orderBy("start_word", "end_word", "other", "source_start")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = spans.withColumn("new", F.when(F.col("start_word") <= reach, 0).otherwise(1)).withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    longest = F.struct((F.col("end_word") - F.col("start_word")).alias("n"), (-F.col("start_word")).alias("early"), "other", "source_start", "source_end", "share")
    joined = parted.groupBy("doc", "passage").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.max(longest).alias("s"))
    return joined.where(F.col("end_word") - F.col("start_word") >= c.words).select(
        F.col("doc").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"),
        F.col("s.other").alias("source_doc_id"), F.col("s.source_start").alias("source_start"), F.col("s.source_end").alias("source_end"), F.col("s.share").alias("similarity"),
    )


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the words of their ``passages``; what stands around them stays as it is.

    Documents of which no word is left are dropped; the others keep their columns (also those without passages, and
    those with a null id or text).
    """
    names = docs.columns
    mark = "_" * (1 + max(map(len, names)))  # no column of the documents has such a name
    spans = passages.groupBy(F.col("doc_id").alias(f"{mark}doc")).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(f"{mark}spans"))
    joined = docs.join(spans, F.col(f"`{id_col}`") == F.col(f"{mark}doc"), "left").drop(f"{mark}doc")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(text_col).to_pylist(), []
            for i, spans in enumerate(batch.column(f"{mark}spans").to_pylist()):
                if spans and texts[i] is not None:
                    places = [m.span() for m in _WORD.finditer(texts[i])]
                    parts, at = [], 0
                    for s in spans:
                        parts.append(texts[i][at : places[s["start_word"]][0]])
                        at = places[s["end_word"] - 1][1]
                    rest = "".join([*parts, texts[i][at:]])
                    if not _WORD.search(rest):
                        continue
                    texts[i] = rest.strip()
                keep.append(i)
            changed = pa.record_batch([pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in names], names=names)
            yield changed.take(pa.array(keep, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(scan, fields)
