"""Merkle manifests, shards and ranked search against brute force and SQL, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumivox.llm import manifest, queries, search, shards
from lumivox.plans.ranks import laid_out, placed
from lumivox.plans.scratch import scratch_path, written

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_shards", "op13_ranked_search"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    expected = db.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(expected.select(*columns).fetchall())


# 11: manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(level):
    """The root of a list of digests, and each one's siblings."""
    paths, under = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        runs = [range(i, min(i + 3, len(level))) for i in range(0, len(level), 3)]
        for run in runs:
            for j in run:
                step = ("".join(level[x] for x in run if x < j), "".join(level[x] for x in run if x > j))
                for leaf in under[j]:
                    paths[leaf].append(step)
        under = [[leaf for j in run for leaf in under[j]] for run in runs]
        level = [digest("".join(level[j] for j in run)) for run in runs]
    return level[0], paths


def brute_manifest(rows):
    """``(group, order, leaf, path, subroot, root)`` of rows ``(group, order, leaf)``."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees[g] = brute_tree([r[2] for r in groups[g]])
    root, over = brute_tree([trees[g][0] for g in names])
    return [(*r, p + up, trees[g][0], root) for g, up in zip(names, over) for r, p in zip(groups[g], trees[g][1])]


@pytest.mark.parametrize("depth, sizes", [(7, {"a": 1, None: 5, "b": 28}), (1, {"a": 30, "ü": 1, "z": 3, "": 10}), (2, {"hot": 400, **{f"g{i}": i % 4 + 1 for i in range(90)}})])
def test_manifest_equals_brute_force(spark, monkeypatch, depth, sizes):
    monkeypatch.setattr(manifest, "DEPTH", depth)  # several tiers of blocks with few rows
    rows = [(g, None if i == 2 else i // 2, digest(f"{g}/{i // 4 * 4 if g == 'hot' else i}")) for g, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    leaves = spark.createDataFrame(rows, "source string, doc_id int, leaf string").repartition(5)
    found = manifest.merkle_proofs(leaves, "source", ["doc_id"])
    again = found.withColumn("again", manifest.folded(F.col("leaf"), F.col("path"))).withColumn("proof", manifest.proof_digest(F.col("path"))).collect()
    got = [(r["source"], r["doc_id"], r["leaf"], [tuple(s) for s in r["path"]], r["subroot"], r["root"]) for r in again]
    assert sorted(got, key=str) == sorted(brute_manifest(rows), key=str)
    assert all(r["again"] == r["root"] and r["proof"] == digest("".join(a + b for a, b in r["path"])) for r in again)


def test_manifest_finds_a_changed_row_and_takes_odd_ones(spark):
    rows = [(None, None, None, 1), (1, "s", "x\ny", 2), (1, "s", "x\ny", 2), (2, "s", "", 3), (3, "é", "word " * 50_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, path int")
    leaves = docs.withColumn("leaf", manifest.leaf_digest(F.col("doc_id"), F.col("source"), F.col("text")))
    found = manifest.merkle_proofs(leaves, "source", ["doc_id"]).collect()
    assert len(found) == 5 and len({r["root"] for r in found}) == 1
    assert {r["leaf"] for r in found if r["doc_id"] is None} == {digest("---")}
    assert {r["leaf"] for r in found if r["doc_id"] == 1} == {digest("1:11:s3:x\ny")}
    assert {r["leaf"] for r in found if r["doc_id"] == 3} == {digest("1:32:é250000:" + "word " * 50_000)}
    other = manifest.merkle_proofs(leaves.withColumn("leaf", F.when(F.col("doc_id") == 2, F.sha2(F.lit("!"), 256)).otherwise(F.col("leaf"))), "source", ["doc_id"])
    assert other.first()["root"] != found[0]["root"]
    assert manifest.merkle_proofs(leaves.limit(0), "source", ["doc_id"]).count() == 0


def test_ranks_of_a_hot_group_are_of_many_parts(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("g"), F.lit(7).alias("v")).union(spark.range(5).select(F.lit(None).cast("string"), F.col("id").cast("int")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        table = written(laid_out(rows, ["g"], ["v"]), "ranks")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert table.where("g = 'hot'").groupBy("_part").count().agg(F.max("count"), F.count("*")).first()[0] < 15_000
    for most in (0, 100):  # joined by a shuffle, and by a broadcast
        got = placed(table, ["g"], members="n", most=most).collect()
        assert sorted(r["rank"] for r in got if r["g"]) == list(range(20_000)) and {r["n"] for r in got if r["g"]} == {20_000}
        assert sorted((r["rank"], r["v"], r["n"]) for r in got if not r["g"]) == [(i, i, 5) for i in range(5)]


# 12: shards


def brute_jump(key, shards):
    key, at, ahead = key % (1 << 64), -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at


def test_jump_hash_moves_rows_into_the_new_shard_only(spark):
    keys = [*range(3000), -1, -(1 << 63), (1 << 63) - 1, 123456789012345]
    held = spark.createDataFrame([(k,) for k in keys], "k long")
    got = held.select("k", *[shards.jump_hash(F.col("k"), n).alias(f"n{n}") for n in (1, 2, 24, 25, 1000)]).collect()
    for r in got:
        assert [r[f"n{n}"] for n in (1, 2, 24, 25, 1000)] == [brute_jump(r["k"], n) for n in (1, 2, 24, 25, 1000)]
        assert r["n25"] in (r["n24"], 24)
    assert 80 <= sum(r["n25"] == 24 for r in got) <= 165  # about a twenty-fifth
    assert max(Counter(r["n24"] for r in got).values()) < 1.4 * 3000 / 24
    assert held.limit(1).select(shards.jump_hash(F.lit(None).cast("long"), 24)).first()[0] == 0


def test_shards_keep_every_row_in_gapless_slots(spark):
    rows = [(None, "no id", 1), (5, None, 2), (6, "", 3), (7, "word " * 60_000, 4), *[(8, "same", 5)] * 500, *[(i, f"text {i}", i) for i in range(100, 400)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(6)
    folder = scratch_path(spark, "shards")
    shards.write_shards(docs, folder, 5)
    got = shards.read_shards(spark, folder).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(r[:2] for r in rows)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]))
        assert r["shard"] == (0 if r["doc_id"] is None else brute_jump(r["doc_id"], 5))
    for some in by_shard.values():
        some.sort()
        assert [s for s, _ in some] == list(range(len(some))) and [i for _, i in some] == sorted(i for _, i in some)
    empty = scratch_path(spark, "shards")
    shards.write_shards(docs.limit(0), empty, 5)
    with pytest.raises(ValueError):
        shards.write_shards(docs, empty, 0)


def test_no_python_runs_in_shards(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = docs.select(shards.jump_hash(F.col("doc_id"), 24))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 13: search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    found = []
    for i, some in asked.items():
        scores = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in some if w in c)
            if score:
                scores.append((-score, d is not None, d or 0))
        found += [(i, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:k])]
    return sorted(found, key=str)


def found(docs, items, **options):
    return sorted(map(tuple, search.search(docs, items, **options).collect()), key=str)


@pytest.mark.parametrize("seed, most, per_batch", [(1, 40, 1 << 17), (2, 7, 10), (3, 4096, 1 << 17)])
def test_search_equals_brute_force(spark, seed, most, per_batch, monkeypatch):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(None if i == 17 else i // 2, " ".join(draw.choices(words, weights, k=draw.randint(1, 40)))) for i in range(600)]
    docs += [(1000 + i, "w0 w1 w2 w3") for i in range(200)] + [(5000, None), (5001, ""), (5002, "!?"), (5003, "W5 ñandú W5 w40 " * 3000)]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 9)))) for i in range(25)] + [(3, "w7 w8"), (None, "w9 Ñandú ñandú"), (90, None), (91, "..."), (92, "unheard of")]
    build = search.build_segments
    monkeypatch.setattr(search, "build_segments", lambda *a: build(*a, most_docs=most))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).repartition(3)
    got = found(frame, spark.createDataFrame(items, "item_id long, text string"), per_batch=per_batch)
    assert got == brute_search(docs, items)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert found(docs.limit(0), items) == [] and found(docs, items.limit(0)) == []
    assert found(docs.selectExpr("cast(doc_id as string) as doc_id", "text"), items) == [(1, 1, "1", brute_search([(1, "a b")], [(1, "a")])[0][3])]


def test_terms_of_segments_equal_a_pattern():
    texts = ["Ab1-c_d é中x\x7fY", None, "", "z", "Z z", "ab1"]
    sizes, names, ends, places, counts = search.postings(pa.array(texts))
    lists = {n: dict(zip(places[a:b].tolist(), counts[a:b].tolist())) for n, a, b in zip(names.to_pylist(), [0, *ends], ends)}
    expected = defaultdict(dict)
    for i, t in enumerate(texts):
        for w, c in Counter(terms(t)).items():
            expected[w][i] = c
    assert lists == expected and sizes.tolist() == [len(terms(t)) for t in texts]


def test_joint_bounds_leave_out_what_single_bounds_keep():
    """Two heavy terms that no document has together: their joint bound is that of one, and the segment needs no look."""
    row = [np.array(x) for x in ([0, 1], [2, 4], [0, 1, 2, 3], [5, 5, 5, 5], [50, 50], [], [], [], [])]
    segment = search._Segment(row, 4, np.array([10, 10]))
    query = search.Query(0, ((0, 0, 1),), None)
    assert segment.bounds(0, 0, 1) == (50, 50)  # not 100
    assert segment.best(query, 60, 10)[0].tolist() == [] and segment.best(query, 50, 10)[0].tolist() == [0, 1, 2, 3]


def test_segments_are_stored_in_small_row_groups(spark):
    numbers = F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.hash(i, "id"))
    stored = search._stored(spark.range(0, 30, 1, 1).select(numbers.alias("places")), "segments")  # 24 MB, fewer rows than the writer waits for
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in stored.inputFiles()]
    assert max(m.row_group(g).num_rows for m in groups for g in range(m.num_row_groups)) < 30
    assert max(m.row_group(g).total_byte_size for m in groups for g in range(m.num_row_groups)) < 20 << 20
    assert stored.where("size(places) = 200000").count() == 30
