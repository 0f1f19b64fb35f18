"""The training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

import html as htmllib
import re
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumivox.llm import classifier, decontaminate, html, language, packing, passages, queries, rules, simhash, token_files, tokens, warc
from lumivox.llm.labelled import label_sample
from lumivox.llm.words import Words
from lumivox.plans.scratch import scratch_path, written

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, score double, id string"
ODD = [(3, "Über  straße x <|endoftext|> it's 12,5 ΣΑΣ İ é", 1.0, "a"), (1, None, None, None), (2, "", 0.0, "b"), (2, "", 0.0, "b"), (7, " \n\t", 0.0, "c"), (None, "no id at all", 0.0, "d"), (5, "word " * 30000, 0.0, "e")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")


# 1: token files


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abéßñ's 'll,.!<|>09\n\t́ ")), max_size=60))
def test_encoder_equals_tokenizer(text):
    expected = test_encoder_equals_tokenizer.tokenizer.encode(text, add_special_tokens=False).ids
    assert tokens.encoder(PATH).encode(text).tolist() == expected


test_encoder_equals_tokenizer.tokenizer = Tokenizer.from_file(PATH)


def test_token_files_round_trip(spark, odd, nothing):
    folder = scratch_path(spark, "tokens")
    token_files.write_token_files(odd, folder, PATH, 1)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 2, 3, 5, 7]
    start, by_id = 0, {r[0]: r[1] for r in ODD}
    for r in got:
        ids = test_encoder_equals_tokenizer.tokenizer.encode(by_id[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = scratch_path(spark, "tokens")
    assert token_files.write_token_files(nothing, empty, PATH, 1)["parts"] == []
    assert token_files.read_token_files(spark, empty).count() == 0


# 2: passages


def brute_passages(texts, words=50):
    """Of every text the first words of the windows that an earlier text has."""
    seen, found = {}, {}
    for i, text in texts:
        w = text.split()
        own = {tuple(w[j : j + words]): j for j in range(len(w) - words + 1)}
        found[i] = [j for j in range(len(w) - words + 1) if tuple(w[j : j + words]) in seen]
        for key in own:
            seen.setdefault(key, i)
    return found


def test_passages_cover_every_exact_repeat(spark, documents):
    got = passages.repeated_passages(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    spans = {}
    for r in got:
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    for doc, windows in brute_passages(zip(documents.doc_id, documents.text)).items():
        for j in windows:
            assert any(a <= j and b >= j + 50 for a, b in spans.get(doc, [])), (doc, j)
    texts = dict(zip(documents.doc_id, documents.text))
    for r in got:
        mine, theirs = texts[r["doc_id"]].split(), texts[r["source_doc_id"]].split()
        assert r["source_doc_id"] < r["doc_id"] and r["similarity"] >= 0.8 and r["n_words"] >= 50
        common = set(mine[r["start_word"] : r["end_word"]]) & set(theirs[r["source_start"] : r["source_end"]])
        assert common


def test_fuzzy_passage_and_edge_cases(spark, nothing):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    own = [[word() for _ in range(80)] for _ in range(4)]
    passage = [word() for _ in range(70)]
    edited = list(passage)
    edited[20], edited[40] = "xx", "yy"
    del edited[55]
    rows = [(1, " ".join(own[0] + passage + own[1]), 0.0, ""), (4, " ".join(own[2] + edited + own[3]), 0.0, ""), (2, None, 0.0, ""), (3, "", 0.0, ""), (None, " ".join(passage), 0.0, ""), (9, "la " * 300, 0.0, "")]
    df = spark.createDataFrame(rows, DOCS)
    got = passages.repeated_passages(df).collect()
    assert [(r["doc_id"], r["source_doc_id"], r["start_word"], r["end_word"]) for r in got] == [(4, 1, 80, 149)]
    cut = {r["doc_id"]: r["text"] for r in passages.without_passages(df, passages.repeated_passages(df)).collect()}
    assert cut[4] == " ".join(own[2]) + "  " + " ".join(own[3]) and cut[1] == rows[0][1] and len(cut) == 6
    assert passages.repeated_passages(nothing).count() == 0


def test_copies_make_one_row_each(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = passages.repeated_passages(spark.createDataFrame([(i, text, 0.0, "") for i in range(40)] + [(3, text, 0.0, "")], DOCS)).collect()
    assert sorted((r["doc_id"], r["source_doc_id"], r["n_words"]) for r in got) == [(i, 0, 60) for i in range(1, 40)]


def spans_of(spark, texts):
    got = passages.repeated_passages(spark.createDataFrame([(i, t, 0.0, "") for i, t in enumerate(texts)], DOCS)).collect()
    return sorted((r["doc_id"], r["source_doc_id"], r["start_word"], r["end_word"]) for r in got)


def test_passage_whose_seeds_are_first_in_many_documents(spark):
    passage = [f"p{i}" for i in range(60)]
    noise = lambda k: [f"{k}{i}" for i in range(40)]
    stock = [" ".join(passage[i : i + 5]) for i in range(56)]  # every k-mer is first in a document of its own
    edited = [*passage[:18], "x", *passage[19:40], "y", "z", *passage[41:]]
    found = spans_of(spark, [*stock, " ".join(noise("a") + passage + noise("b")), " ".join(noise("c") + passage + noise("d")), " ".join(noise("e") + edited)])
    assert found == [(57, 56, 40, 100), (58, 56, 40, 101)]


def likeness(a, b):
    """The words of two passages in order in both, as a share of the longer, by the whole table of a longest common subsequence."""
    row = np.zeros(len(b) + 1, int)
    for x in a:
        row = np.append(0, np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (np.array(b) == x))))
    return row[-1] / max(len(a), len(b))


def test_recall_of_edited_passages_by_likeness(spark):
    """Passages edited in common words, by how alike they are by brute force: of their words so many are found, and what is found is alike, too."""
    rng = np.random.default_rng(5)
    vocabulary = np.array(["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 8)))) for _ in range(3000)])
    share = 1 / np.arange(1, 3001)
    words = lambda n: vocabulary[rng.choice(3000, n, p=share / share.sum())].tolist()
    first, second, places = [], [], []
    for m in range(400):
        edits = (0.03, 0.06, 0.1, 0.14, 0.18)[m % 5]
        passage, edited = words(int(rng.integers(60, 150))), []
        for w in passage:
            kind = rng.random() / edits  # another word, a word more, a word less
            edited += words(1) if kind < 0.6 else [w, *words(1)] if kind < 0.8 else [] if kind < 1 else [w]
        before, behind = int(rng.integers(20, 200)), int(rng.integers(20, 200))
        first.append(words(behind) + passage + words(before))
        second.append(words(before) + edited + words(behind))
        places.append((before, before + len(edited), likeness(passage, edited)))
    got = passages.repeated_passages(spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(first + second)], "doc_id long, text string")).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
        mine, theirs = (first + second)[r["doc_id"]], (first + second)[r["source_doc_id"]]
        source = theirs[r["source_start"] : r["source_end"]]  # of the longest of the stretches that a passage is put together from
        assert max(likeness(mine[r["start_word"] : r["end_word"]][k : k + len(source)], source) for k in range(max(1, r["n_words"] - len(source) + 1))) > 0.7
    covered = np.array([sum(max(0, min(y, p[1]) - max(x, p[0])) for x, y in found.get(400 + n, [])) / (p[1] - p[0]) for n, p in enumerate(places)])
    alike = np.array([p[2] for p in places])
    for low, high, least in ((0.95, 1.01, 0.97), (0.9, 0.95, 0.9), (0.85, 0.9, 0.65)):
        band = (alike >= low) & (alike < high)
        assert band.sum() > 50 and covered[band].mean() >= least, (low, band.sum(), covered[band].mean())


@pytest.mark.parametrize("size", [5, 12, 20, 30, 45])
def test_passage_whose_parts_stray_through_many_documents(spark, size):
    """However long the parts are that other documents have first, a copy of the whole is found, but for some words at its ends if they are nearly passages."""
    rng = np.random.default_rng(size)
    vocabulary = [f"w{int(n)}" for n in rng.integers(1000, 9999, 800)]
    passage = [vocabulary[int(n)] for n in rng.integers(0, 800, 200)]
    strays = [" ".join(passage[i : i + size]) for i in range(0, 201 - size)]
    rng.shuffle(strays)
    found = spans_of(spark, [*strays, "x " + " ".join(passage) + " y", "u " + " ".join(passage) + " v"])
    covered = sum(b - a for doc, _, a, b in found if doc == len(strays) + 1)
    assert covered >= (0.99 if size <= 30 else 0.95) * 200 and not [f for f in found if f[0] < len(strays)]


def test_chain_is_kept_until_it_is_aligned():
    rows = [(at, 1, at) for at in (0, 9, 24, 33, 48, 57)] + [(at, 2, at) for at in (14, 19, 38, 43)]  # 10 words between the runs of document 1
    table = {k: np.array([r[n] for r in rows]) for n, k in enumerate(("at", "other", "there"))} | {"said": np.zeros(len(rows), bool)}
    assert {r["other"] for r in passages._chains_of(3, table, passages.Chaining())} == {1, 2}


def test_copy_of_a_revised_page(spark):
    page = [f"p{i}" for i in range(110)]
    revised = [w if i % 24 < 14 else f"r{i}" for i, w in enumerate(page)]
    assert spans_of(spark, [" ".join(revised), " ".join(page), " ".join(page)])[-1] == (2, 1, 0, 110)


def test_text_around_a_run_of_other_length(spark):
    p, q = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(60))
    assert spans_of(spark, [f"{p} {'- ' * 20}{q}", f"{p} {'- ' * 300}{q}"]) == [(1, 0, 0, 80), (1, 0, 340, 420)]
    assert spans_of(spark, ["la " * 200, "la " * 60]) == [(1, 0, 0, 60)]
    assert [x[2:] for x in spans_of(spark, ["la " * 60, "la " * 200])] == [(0, 200)]
    assert spans_of(spark, ["la " * 30, "la " * 60, "la " * 60]) == [(2, 1, 0, 60)]


@pytest.mark.parametrize("turn", ["a b", "one two three", "a a b", "p q r s t u v w"])
def test_runs_of_words_in_turn(spark, turn):
    n = len(turn.split())
    run = lambda words: " ".join((turn.split() * words)[:words])
    assert spans_of(spark, [run(400), run(400)]) == [(1, 0, 0, 400)]
    p, q = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(60))
    short, long = 10 * n, 90 * n
    found = spans_of(spark, [f"{p} {run(short)} {q}", f"{p} {run(long)} {q}"])
    covered = {w for _, _, a, b in found for w in range(a, b)}
    assert {*range(60), *range(60 + long, 120 + long)} <= covered and min(len(covered), 120 + long) >= 120
    found = spans_of(spark, [run(70), " ".join([*[f"x{i}" for i in range(30)], run(200)])])
    assert found and all(a >= 30 and b <= 230 for _, _, a, b in found) and sum(b - a for _, _, a, b in found) >= 190


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "a b", "c d e", "x1 x2 x3 x4 x5 x6 x7", "f g h i j k l m"]), st.integers(1, 60)), min_size=1, max_size=4))
def test_shortened_words_are_in_place(parts):
    texts = [" ".join(" ".join([t] * n) for t, n in parts), None, " ".join(t for t, _ in parts)]
    w, place, cut = passages._shortened(texts)
    whole = [t.split() if t else [] for t in texts]
    hashes = [Words([x]).hashes[0] for t in whole for x in t]
    base = np.cumsum([0, *map(len, whole)])
    assert [hashes[base[i] + j] for i, j in zip(w.text, place)] == list(w.hashes)
    for i in np.flatnonzero(w.lengths != w.counts):
        gone = passages._cuts(w, place, cut, int(i))
        assert [passages._place(j, gone) for j in range(int(w.counts[i]))] == place[w.text == i].tolist()


def test_copy_of_a_repeated_line(spark):
    assert spans_of(spark, ["one two three " * 30, "one two three " * 30]) == [(1, 0, 0, 90)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=12))
def test_chain_score_is_the_best(points):
    points = sorted(set(points))
    b = np.array([p[0] for p in points])
    o = np.array([p[1] for p in points])
    best = passages.chain(b, b + 5, o, o + 5, 0.25)[0]
    score = [0.0] * len(points)
    for i in range(len(points)):
        before = [score[j] - 0.25 * float((b[i] - b[j] - 5) + (o[i] - o[j] - 5)) for j in range(i) if b[j] + 5 <= b[i] and o[j] + 5 <= o[i]]
        score[i] = 5 + max([0.0, *before])
    got = sum(5 for _ in best) - sum(0.25 * float((b[y] - b[x] - 5) + (o[y] - o[x] - 5)) for x, y in zip(best, best[1:]))
    assert got == pytest.approx(max(score), abs=1e-6)


# 3: SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64(" ".join(w[i : i + 4]), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, bits=4):
    names = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = names[i], names[j]
                names = [min(a, b) if n in (a, b) else n for n in names]
    return names


def test_simhash_equals_brute_force(spark, documents):
    got = simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).toPandas().set_index("doc_id")
    fps = [brute_fingerprint(t) for t in documents.text]
    assert [got.fingerprint[i] for i in documents.doc_id] == [f"{f:016x}" for f in fps]
    ids = list(documents.doc_id)
    assert [got.component_id[i] for i in ids] == [ids[n] for n in brute_components(fps)]


@pytest.mark.parametrize(("crowd", "number"), [(4096, 3), (3, 3), (4096, 2)])
def test_links_in_crowds(spark, crowd, number):
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    fps = {base, base ^ (1 << 63)}
    for _ in range(60):
        f = base
        for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from lumivox.plans.components import connected_components

    found = connected_components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, crowd, number)).toPandas().set_index("node").component.to_dict()
    got = [found.get(s, s) for s in signed]
    expected = brute_components(fps)
    assert {(got[i] == got[j]) == (expected[i] == expected[j]) for i in range(len(fps)) for j in range(i)} == {True}


def test_simhash_edge_cases(odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] in (1, 2, 7)} == {1}
    assert simhash.near_duplicates(nothing).count() == 0


# 4 to 6: language, rules, classifier


def test_language(spark, odd, nothing):
    sf = "/root/testdata/sf0.01"
    truth = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").lang
    got = queries.op4_language(spark, sf).toPandas().set_index("doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == truth[held.index]).mean() > 0.97
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = language.learn_dictionaries(docs.where(queries.crc_fold("doc_id") != 0))
    compressors = {k: zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False) for k, v in learned.items()}
    for r in docs.join(spark.createDataFrame(got.reset_index()[["doc_id", "lang_pred", "narrow"]]), "doc_id").orderBy("doc_id").limit(400).collect():
        letters = " ".join(re.findall(r"[^\W\d_]+", r["text"] or "")).lower()
        sizes = sorted((len(c.compress(letters.encode())), i, k) for i, (k, c) in enumerate(compressors.items()))
        assert not letters or sizes[0][0] >= 0.98 * sizes[1][0] or (r["lang_pred"], r["narrow"]) == (sizes[0][2], False)
    english = " ".join(r["text"] for r in docs.where("lang = 'en'").orderBy("doc_id").limit(150).collect())
    long = spark.createDataFrame([(1, english * 20, "mine", "a")], "doc_id long, text string, lang_pred string, narrow string")
    assert [tuple(r) for r in language.identify(long, learned).select("doc_id", "lang_pred", "narrow").collect()] == [(1, "en", False)]
    mixed = spark.createDataFrame([(1, "xq zv")], "doc_id long, text string")
    assert language.identify(mixed, learned, margin=0.9).first()["lang_pred"] == "und" and language.identify(mixed, learned, margin=0.9, reject=False).first()["lang_pred"] in learned
    assert len({r["lang_pred"] for r in language.identify(odd.where("doc_id = 2"), learned).collect()}) == 1
    marks = {r["doc_id"]: r for r in language.identify(odd, {"a": b"word word word", "b": b"zzz"}).collect()}
    assert marks[1]["lang_pred"] == marks[7]["lang_pred"] == "und" and marks[5]["lang_pred"] == "a" and marks[5]["id"] == "e"
    assert {r["lang_pred"] for r in language.identify(odd, {}).collect()} == {"und"}
    assert language.identify(nothing, {"a": b"x"}).count() == 0 and language.learn_dictionaries(nothing.withColumn("lang", F.lit("a"))) == {}


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    trigrams, marked, lines, repeated = [tuple(w[i : i + 3]) for i in range(len(w) - 2)], set(), set(), 0
    counts = pd.Series(trigrams, dtype=object).value_counts() if trigrams else {}
    for i, t in enumerate(trigrams):
        if counts[t] > 1:
            marked |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(marked)


def test_rules_equal_brute_force(spark, documents, odd):
    ratio = rules.Ratio(np.zeros(64), -1.0)
    for df, texts in ((spark.read.parquet(f"{SF}/documents.parquet"), dict(zip(documents.doc_id, documents.text))), (odd, {r[0]: r[1] for r in ODD})):
        for r in rules.judge(df, ratio).collect():
            n = brute_rules(texts[r["doc_id"]])
            assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
            assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and r["kept"] != r["base_failed"]


def test_ratio_equals_brute_force(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trusted = spark.createDataFrame([(int(i),) for i in documents.doc_id[::3]], "doc_id long")
    buckets = 1 << 10
    ratio = rules.fit_ratio(docs, trusted, buckets=buckets)
    marks = {r["doc_id"]: r["m"] for r in trusted.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) > 0).alias("m")).collect()}

    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        one = {x: int(Words([x]).hashes[0]) % buckets for x in set(w)}
        two = {p: int(Words([" ".join(p)]).windows(2)[1][0]) % buckets for p in set(zip(w, w[1:]))}
        return [one[x] for x in w] + [two[p] for p in zip(w, w[1:])]

    held = {i: grams(t) for i, t in zip(documents.doc_id, documents.text)}
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for i, g in held.items():
        np.add.at(raw, g, 1)
        if marks.get(i):
            np.add.at(target, g, 1)
    weights = np.log((target + 0.5) / (target.sum() + 0.5 * buckets)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * buckets))
    assert np.allclose(ratio.weights, weights)
    for r in rules.judge(docs, ratio).collect():
        score = np.mean(weights[held[r["doc_id"]]]) if held[r["doc_id"]] else 0.0
        assert r["score"] == pytest.approx(score) and r["kept"] == (not r["base_failed"] and r["score"] >= ratio.threshold)


def test_rules_part_clean_from_junk(spark):
    sf = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").quality
    got = queries.op5_quality_rules(spark, sf).toPandas().set_index("doc_id")
    judged = got[~got.base_failed].join(labels, how="inner")
    assert judged[judged.quality == 1].kept.mean() > 0.99 and judged[judged.quality == 0].kept.mean() < 0.2


def test_rules_without_trusted_documents(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.fit_ratio(odd, none).threshold == -1.0
    assert rules.judge(nothing, rules.fit_ratio(nothing, none)).count() == 0


def test_classifier(spark, odd, nothing):
    sf = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").quality
    got = queries.op6_quality_classifier(spark, sf).toPandas().set_index("doc_id")
    held = got[got.held_out].join(labels, how="inner")
    assert held[held.quality == 1].predicted.mean() > 0.97 and held[held.quality == 0].predicted.mean() < 0.3
    none = spark.createDataFrame([], "doc_id long, quality int")
    scored = classifier.score_quality(odd, classifier.fit_neighbours(odd, none, "quality")).collect()
    assert len(scored) == len(ODD) and {r["score"] for r in scored} == {1.0}
    assert classifier.score_quality(nothing, classifier.fit_neighbours(nothing, none, "quality")).count() == 0


def test_votes_equal_brute_force(spark, documents):
    model = queries.quality_model(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    texts = [*documents.text[:120], None, "", "zzzz qqqq"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in classifier.score_quality(rows, model).collect()}
    for i, text in enumerate(texts):
        dense = np.zeros(classifier.FEATURES)
        _, feature, count = classifier.features(Words([text]))
        dense[feature] = np.log1p(count) * model.idf[feature]
        v = dense @ model.projection
        cosines = model.vectors @ (v / max(np.linalg.norm(v), 1e-12))
        near = sorted(range(len(cosines)), key=lambda j: -cosines[j])[: model.k]
        weight = {j: max(cosines[j], 0.0) ** model.power for j in near}
        expected = sum(w * model.labels[j] for j, w in weight.items()) / sum(weight.values()) if sum(weight.values()) > 0 else model.labels.mean()
        assert got[i] == pytest.approx(expected, abs=2e-4)
    assert np.allclose(np.linalg.norm(model.vectors, axis=1), 1, atol=1e-4)


def test_fit_takes_an_id_once(spark):
    docs = spark.createDataFrame([(1, "good text here")] * 50 + [(2, "bad ### text"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert classifier.fit_neighbours(docs, labels, "quality").labels.tolist() == [1.0, 0.0]


def test_quality_rules_learn_from_every_trusted_label(spark, tmp_path, monkeypatch):
    spark.range(20_500).selectExpr("id AS doc_id", "'some words' AS text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(20_500).selectExpr("id AS doc_id", "1 AS quality").write.parquet(str(tmp_path / "labels.parquet"))
    seen = []
    monkeypatch.setattr(queries, "fit_ratio", lambda docs, trusted: seen.append(trusted.count()) or rules.Ratio(np.zeros(8), -1.0))
    queries.op5_quality_rules(spark, str(tmp_path))
    assert seen == [20_500]


def test_label_sample_is_bounded_and_stable(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    a, b = label_sample(labels, "quality", 100).collect(), label_sample(labels.orderBy(F.desc("doc_id")), "quality", 100).collect()
    assert len(a) == 100 and a == b


# 7: leaks


def test_leaks(spark, nothing):
    question = "A train leaves Springfield at 9 o'clock and travels 120 km to reach the old town, where Alice waits. How far does Alice walk in 2 hours if she walks 5 km each hour?"
    changed = question.replace("Alice", "Maria").replace("120", "350").replace("5 km", "7 miles").replace("2 hours", "3 minutes")
    mixed = question.replace("Alice waits", "Maria waits").replace("does Alice", "does Peter")
    other = "some words in front that have nothing to do with it and go on for a while , "
    rows = [(1, other + question.upper().lower() + other, 0.0, ""), (2, other + changed + " " + other, 0.0, ""), (3, other * 3, 0.0, ""), (4, None, 0.0, ""), (5, "", 0.0, ""), (None, question, 0.0, ""), (6, " ".join(question.split()[:9]), 0.0, ""), (2, other + changed + " " + other, 0.0, "")]
    benchmark = spark.createDataFrame([(10, question), (11, None), (12, "tiny item"), (13, "")], "item_id int, text string")
    df = spark.createDataFrame(rows, DOCS)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(df, benchmark).collect()}
    assert set(got) == {(1, 10), (2, 10)} and got[2, 10]["changed_slots"] >= 4 and got[2, 10]["consistency"] == pytest.approx(8 / 9)  # a unit is changed at one of two places
    loose = decontaminate.find_leaks(spark.createDataFrame([(1, other + mixed, 0.0, "")], DOCS), benchmark, consistency=0.0).collect()
    assert loose and loose[0]["consistency"] < 1.0
    assert decontaminate.find_leaks(spark.createDataFrame([(8, "here is a tiny item in it", 0.0, "")], DOCS), benchmark).collect()[0]["item_id"] == 12
    assert decontaminate.find_leaks(nothing, benchmark).count() == 0 and decontaminate.find_leaks(df, benchmark.limit(0)).count() == 0


def test_leaks_beside_other_matches(spark):
    question = "a farmer has 12 sheep and sells 5 of them before the long winter, how many of the 12 sheep are left in the barn"
    first, second = question.replace("12", "30").replace("5", "7"), question.replace("12", "44").replace("5", "9")
    numbers = "what comes after " + " ".join(str(2 * n) for n in range(1, 21)) + " in this list"
    benchmark = spark.createDataFrame([(1, question), (2, numbers)], "item_id int, text string")
    words = "and then some other words that stand between them for quite a while so that nothing meets across the two of them "
    rows = [(1, f"{question} {words}{first} {words}{second}", 0.0, ""), *[(10 + n, " ".join(f"w{m}" for m in "abcdef"[:n]) + f" {numbers}", 0.0, "") for n in range(6)]]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), benchmark).collect()}
    assert got == {(1, 1), *[(10 + n, 2) for n in range(6)]}


def test_edited_leaks_equal_brute_force(spark):
    """Against every place of every document: items with changed words, other numbers and names, words put in and left out."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    common = [word() for _ in range(40)]

    def question(n):
        return [common[int(rng.integers(40))] if rng.random() < 0.8 else str(int(rng.integers(100))) for _ in range(n)]

    items = {i: question(int(n)) for i, n in enumerate([3, 5, 7, 10, 12, 15, 15, 20, 20, 23, 30, 40, 60])}
    rows, planted = [], set()
    for doc in range(260):
        item = doc % len(items)
        new, names, n = [], {}, len(items[item])
        bad = set(rng.choice(n, int(0.2 * n), replace=False).tolist())
        for i, w in enumerate(items[item]):  # re-parameterised: each number becomes another, everywhere
            new.append(word() if i in bad else names.setdefault(w, str(int(rng.integers(1000, 2000)))) if w.isdigit() and doc % 2 else w)
        if doc % 5 == 4 and n >= 20:  # instead a word put in and one left out
            new = [*items[item][: n // 2], "zzzzz", *items[item][n // 2 : n - 4], *items[item][n - 3 :]]
        rows.append((doc, " ".join([*question(int(rng.integers(30))), *new, *question(int(rng.integers(30)))]), 0.0, ""))
        planted.add((doc, item))
    benchmark = spark.createDataFrame([(i, " ".join(q)) for i, q in items.items()], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), benchmark).collect()}
    kind = lambda w: "<num>" if w.isdigit() else w
    expected = set()
    for doc, text, _, _ in rows:
        d = text.split()
        for item, q in items.items():
            for shift in range(-len(q), len(d)):
                pairs = [(q[i], d[shift + i]) for i in range(len(q)) if 0 <= shift + i < len(d) and kind(q[i]) == kind(d[shift + i])]
                slots = {p for p in pairs if p[0].isdigit()}
                if len(pairs) >= 0.8 * len(q) and (not slots or len({p[0] for p in slots}) >= 0.8 * len(slots)):
                    expected.add((doc, item))
    assert expected <= set(got)
    moved = {p for p in planted if p[0] % 5 == 4 and len(items[p[1]]) >= 20}
    assert len(moved & set(got)) >= 0.95 * len(moved) and len(planted & set(got)) >= 0.97 * len(planted)
    assert set(got) - expected <= moved  # what only several alignments together show


def test_leaks_in_long_texts_and_ties(spark):
    question = "how many apples does the farmer sell on the market if 12 of them are rotten and 30 are left"
    benchmark = spark.createDataFrame([(1, question), (2, question), (3, "the the the the the the")], "item_id int, text string")
    rows = [(1, "word " * 100_000 + question + " word" * 100_000, 0.0, ""), (2, f"{question} . {question}", 0.0, ""), (3, "the " * 30_000, 0.0, "")]
    got = sorted(tuple(r)[:4] for r in decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), benchmark).collect())
    assert got == [(1, 1, 100_000, 20), (1, 2, 100_000, 20), (2, 1, 0, 20), (2, 2, 0, 20), (3, 3, 0, 6)]


def test_an_item_id_with_several_texts(spark):
    one, two = "which river flows through the old town before it meets the sea", "how many bridges were built over the wide canal in that year"
    items = spark.createDataFrame([(7, one), (7, two), (7, one), (8, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {one} then"), (2, two), (3, "none of both"), (4, f"{one} {two}")], "doc_id long, text string")
    got = sorted(map(tuple, decontaminate.find_leaks(docs, items).select("doc_id", "item_id", "matched_words").collect()))
    assert got == [(1, 7, 12), (2, 7, 12), (4, 7, 12)]


@given(st.integers(1, 120), st.data())
@settings(max_examples=200, deadline=None)
def test_leaks_keep_as_many_windows_as_they_must(words, data):
    """Words changed at any places, of which a fifth at most: the short windows that are left are at least as many as are asked for."""
    changed = int(words * 0.2 + 1e-9)
    size = words // (changed + 1)
    gone = data.draw(st.sets(st.integers(0, words - 1), max_size=changed))
    left = sum(not gone & set(range(i, i + 3)) for i in range(words - 2))
    least = max(1, int(np.ceil((words - 3 * changed) * (size - 2) / size - 1e-9))) if size >= 3 else 1
    if size >= 3:
        assert left >= least


def test_stock_phrases_make_no_alignments(spark, monkeypatch):
    """Documents that share phrases of three words with an item are counted and left; the leak among them is found."""
    item = "in one of the towns near the coast of that land how many of the people who live there work at the harbour in the summer"
    phrases = ["one of the", "near the coast", "of the people", "how many of", "in the summer", "at the harbour"]
    docs = [(i, " ".join(f"{phrases[(i + j) % 6]} w{i}x{j} y{j}" for j in range(40))) for i in range(60)] + [(99, f"well {item} indeed")]
    tables = {}
    monkeypatch.setattr(decontaminate, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r["doc_id"] for r in got] == [99] and {r["doc_id"] for r in tables["met"].collect()} == {99}


def test_leaks_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    plain = lambda t: " ".join(re.sub(r"[^\w\s]", "", t.lower()).split())
    docs, items = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/benchmark.parquet")
    expected = {(d, i) for d, t in zip(docs.doc_id, map(plain, docs.text)) for i, q in zip(items.item_id, map(plain, items.text)) if q in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_benchmark_leaks(spark, sf).collect()}
    assert got == expected


# 8: HTML


def test_main_text():
    page = (
        '<!doctype html><html><head><title>T</title><style>x{}</style></head><body><header class="top"><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="with-sidebar"><article><header><h1>Title</h1></header>'
        "<p>One &amp; two  <b>four</b><i>five</i><br>six.</p><div class='ad'>Buy now, cheap things for all of you</div><ul><li>a<li>b long item</ul><form><p>Mail</form><p>End.<script>if (a<b) x('</p>')</script></p><aside>rel</aside>"
        '<section id="comments"><article class="comment"><p>A long comment of a reader, on and on.</p></article></section></article></div><div class="cookie-notice">We use cookies</div><footer>c</footer></body></html>'
    )
    assert html.main_text(page) == "Title\nOne & two fourfive six.\na\nb long item\nEnd."
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav><a href=1>x</a></nav>") == ""
    assert html.main_text("<article><p>cut off he") == "cut off he" and html.main_text("<article><p>done</p><p cla") == "done"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.data())
def test_cut_is_minimal(n, data):
    number = st.integers(0, 6).map(float)
    source, sink = data.draw(st.lists(number, min_size=n, max_size=n)), data.draw(st.lists(number, min_size=n, max_size=n))
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), number), max_size=8))
    cost = lambda side: sum(t if s else f for s, f, t in zip(side, source, sink)) + sum(w for a, b, w in edges if side[a] != side[b])
    best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
    assert cost(html.cut(source, sink, edges)) == pytest.approx(best)


def article_blocks(page):
    """The blocks of a page's article by a regular expression, as the test tables write it."""
    parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", page, re.S)[1])
    parts = [" ".join(htmllib.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
    return [x for x in parts if x]


def test_main_text_of_all_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = pd.read_parquet(f"{sf}/pages.parquet").set_index("page_id").html
    got = queries.op8_main_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == "\n".join(article_blocks(pages[r["page_id"]])) and r["n_chars"] == len(r["text"])


def test_cut_is_nearer_the_article_than_costs(spark):
    """On pages without telling elements and classes neighbours set right what a block's own costs get wrong."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    costs = html.fit_costs(pages)
    assert costs.edges[0] > costs.edges[1] and costs.weights[2] < 0 < costs.weights[1]
    wrong = np.zeros(2, int)
    for row in pages.collect():
        bare = re.sub(r"<(/?)(?:nav|article|footer)>", r"<\1div>", row["html"].replace(' class="ad"', ""))
        found, article = html.blocks(bare), set(article_blocks(row["html"]))
        assert not any(b.mark for b in found)
        truth = np.array([b.text in article for b in found])
        wrong += [(truth != (html.evidence(found, costs) > 0)).sum(), (truth != np.array(html.content(found, costs))).sum()]
    assert wrong[1] < wrong[0] / 2, wrong


def test_the_cut_sets_misleading_classes_right(spark):
    """A paragraph of the article with a class that looks like boilerplate: its neighbours and its text outweigh the sign, whose worth is fitted."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    costs = html.fit_costs(pages)
    words, article = costs.signs[html.SIGNS.index("words")], costs.signs[html.SIGNS.index("article")]
    assert html.SIGN < words < article
    texts = [r["html"] for r in pages.collect()]
    for name, least in (("share-price", 0.9), ("related", 0.9), ("comment", 0.95)):
        mended = [re.sub("(<article>.*?)<p>", rf'\1<p class="{name}">', page, count=1, flags=re.S) for page in texts]
        listed = sum(any(b.mark < 0 and b.text in set(article_blocks(p)) for b in html.blocks(m)) for p, m in zip(texts, mended))
        right = sum(html.main_text(m, costs) == "\n".join(article_blocks(p)) for p, m in zip(texts, mended))
        assert listed == len(texts) and right >= least * len(texts), (name, right)


def test_costs_without_marked_blocks(spark):
    pages = spark.createDataFrame([(1, "<p>no mark at all</p>"), (2, None), (None, "")], "page_id long, html string")
    assert (html.fit_costs(pages).weights == html.PRIOR).all() and html.fit_costs(pages.limit(0)) is not None


@pytest.mark.parametrize("page", ["<div>x " * 50000, "<b>" * 50000 + "<p>y " * 50000, "<ul><li>" * 20000 + "</b></i>" * 50000, "<table><tr><td>a" * 20000])
def test_deep_pages_take_linear_time(page):
    begin = time.process_time()
    html.blocks(page)
    assert time.process_time() - begin < 2


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="<>/apdiv \"'=&;!-\nx", max_size=80))
def test_any_markup_is_read(page):
    html.main_text(page)


def test_extract_keeps_columns(spark):
    df = spark.createDataFrame([(1, "u", None, "mine", 5), (2, "v", "<article><p>x y</p></article>", "mine", 6)], "page_id long, url string, html string, text string, extra int")
    got = html.extract(df).orderBy("page_id").collect()
    assert [(r["text"], r["n_chars"], r["extra"]) for r in got] == [("", 0, 5), ("x y", 3, 6)]


# 9: WARC


def test_warc_round_trip(spark):
    pages = [(i, f"http://x/{i}", "é" * 700 + str(i % 3)) for i in range(9)] + [(20, None, None), (21, "u v", ""), (22, "u", "short"), (23, "u", "short"), (24, "u", "long " * 30000), (24, "u", "long " * 30000), (None, "u", "long " * 30000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc")
    names = warc.write_warc(df, folder, segment=1000)
    records = warc.read_warc(spark, folder, names)
    back = {(r["key"], r["kind"]): bytes(r["payload"] or b"").decode() for r in records.collect()}
    assert back["24", "response"] == "long " * 30000 and back["22", "response"] == "short" and back["20", "response"] == ""
    got = warc.resolve_revisits(records).collect()
    assert len(got) == len(pages)
    kinds = {r["key"]: (r["kind"], r["payload_bytes"], r["refers_key"]) for r in got}
    assert kinds["6"] == ("response", 1401, None) and kinds["0"] == ("revisit", 1401, "6") and kinds[None] == ("revisit", 150000, "24") and kinds["23"][0] == "response"
    named = {r["record_id"]: r for r in records.collect()}
    assert len(named) == len(pages)  # identifiers of their own, also of repeated rows
    for r in named.values():
        assert r["kind"] == "response" or (named[r["refers_id"]]["kind"] == "response" and named[r["refers_id"]]["digest"] == r["digest"])
    empty = warc.write_warc(df.limit(0), scratch_path(spark, "warc"))
    assert empty == [] and warc.resolve_revisits(warc.read_warc(spark, folder, empty)).count() == 0


def test_warc_of_a_large_page_among_clashing_columns(spark):
    html = "".join(chr(97 + i % 26) for i in range(1000)) * 12_000
    df = spark.createDataFrame([(1, "u", html, "x", 7), (2, "u", html, "y", 8)], "page_id long, url string, html string, digest string, size int")
    folder = scratch_path(spark, "warc")
    begin = time.time()
    got = {r["key"]: r for r in warc.resolve_revisits(warc.read_warc(spark, folder, warc.write_warc(df, folder))).collect()}
    assert got["2"]["kind"] == "response" and got["1"]["refers_key"] == "2" and {r["payload_bytes"] for r in got.values()} == {12_000_000}
    assert time.time() - begin < 60


def test_missing_segment_fails(spark, monkeypatch):
    df = spark.createDataFrame([(1, "u", "y" * 5000)], "page_id long, url string, html string")
    folder = scratch_path(spark, "warc")
    names = warc.write_warc(df, folder, segment=1000)
    whole = warc.read_records
    monkeypatch.setattr(warc, "read_records", lambda *a, **k: whole(*a, **k).where("segment IS NULL OR segment <> 3"))
    with pytest.raises(Exception, match="segments are missing"):
        warc.read_warc(spark, folder, names).collect()


# 10: packing


def check_packed(rows, limits):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(places) <= limits.documents and sum(n * n for _, n in places) <= limits.attention
    return len(by)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.sampled_from(["norm", "dot"]), st.integers(2, 9), st.integers(2500, 5000))
def test_best_fit_equals_brute_force(lengths, choose, documents, attention):
    limits = packing.Limits(tokens=64, documents=documents, attention=attention, choose=choose, weights=(1.0, 0.7, 0.4))
    full, bins = np.array([64, documents, attention], float), {}
    weights = np.array(limits.weights)
    gain = lambda rest, need: (weights * rest / full * need / full).sum() if choose == "dot" else -((weights * (rest - need) / full) ** 2).sum()
    of, offset = packing.best_fit(np.array(lengths, np.int64), limits)
    for n, k in zip(lengths, of.tolist()):  # each choice against all bins that are open at the time; equal gains may go to any
        need = np.array([n, 1, n * n], float)
        fit = {b: gain(rest, need) for b, rest in bins.items() if (rest >= need).all()}
        assert (k in fit and fit[k] >= max(fit.values()) - 1e-9) if fit else k not in bins, (n, k, fit)
        bins[k] = bins.get(k, full) - need
    for k in set(of.tolist()):
        mine = [(int(o), n) for o, n, b in zip(offset, lengths, of) if b == k]
        assert [o for o, _ in mine] == list(np.cumsum([0, *[n for _, n in mine]])[:-1]) and sum(n for _, n in mine) <= 64
        assert len(mine) <= documents and sum(n * n for _, n in mine) <= attention


def test_capacities_other_than_tokens_have_a_say():
    """The choice differs from plain best fit on many pieces, at the same number of sequences."""
    lengths = np.sort(np.random.default_rng(4).geometric(1 / 300, 6000).clip(1, 2048))[::-1]
    of, plain = (packing.best_fit(lengths, x)[0] for x in (packing.Limits(), packing.Limits(choose="norm", weights=(1.0, 0.0, 0.0))))
    assert of.max() == plain.max() and (of != plain).mean() > 0.1 and of.max() + 1 <= -(-lengths.sum() // 2048) + 2


def test_packing_of_one_repeated_row(spark):
    rows = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit(0).alias("piece"), F.lit(100).cast("long").alias("length"), F.lit("mine").alias("offset"))
    got = packing.pack(rows, per_task=500).collect()
    assert len(got) == 3000 and check_packed(got, packing.Limits()) <= 3000 // 20 + 8


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_packing(spark, odd, nothing, choose):
    limits = packing.Limits(choose=choose)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack_documents(docs, PATH, 0, limits).collect()
    total = sum(r["length"] for r in rows)
    assert check_packed(rows, limits) <= -(-total // 2048) + 2
    few = packing.Limits(tokens=64, documents=3, attention=2000)
    rows = packing.pack(packing.pieces(odd, PATH, 0, 40), few).collect()
    check_packed(rows, few)
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 30001 and len([r for r in rows if r["doc_id"] == 2]) == 2
    assert packing.pack_documents(nothing, PATH, 0).count() == 0


# the words helper and the pipeline


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é \n\t\x1c", max_size=20)), max_size=6))
def test_words(texts):
    w = Words(texts)
    expected = [(i, x) for i, t in enumerate(texts) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    raw = w.buffer.tobytes()
    assert [(int(i), raw[a:b].decode()) for i, a, b in zip(w.text, w.starts, w.ends)] == expected
    assert len({int(h) for h in w.hashes}) == len({x for _, x in expected})


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    from lumivox.plans.scratch import written

    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, SF), name)
        if name == "quality_classifier":
            scores = classifier.score_quality(before, queries.quality_model(spark, before, SF)).where("score >= 0.3")
            assert after.count() == scores.count()
        if name == "simhash_near_dedup":
            ids = [r["doc_id"] for r in before.select("doc_id").orderBy("doc_id").collect()]
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            names_ = brute_components([brute_fingerprint(texts[i]) for i in ids])
            assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted({ids[n] for n in names_})
        if name == "substring_dedup":
            left = sorted((r["doc_id"], r["text"]) for r in after.collect())
            assert not any(brute_passages(left).values())
        if name == "benchmark_decontamination":
            leaks = {r["doc_id"] for r in decontaminate.find_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - leaks
        if name != "best_fit_packing":
            assert after.dtypes == docs.dtypes
            before = after
    check_packed(after.collect(), packing.Limits())
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumn("score", F.lit("mine")).withColumn("fp", F.lit(1)).withColumn("_spans", F.lit(2)).withColumn("shift", F.lit(3))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert {tuple(r) for r in docs.select("score", "fp", "_spans", "shift").distinct().collect()} == {("mine", 1, 2, 3)}


def test_an_id_with_several_texts_keeps_those_that_name_a_group(spark):
    """Whatever the order of the rows: of id 5 the text that no other id has stays, and its copy of id 3's goes."""
    a, b = "a text of its own with some words " * 3, "another text that two documents have " * 3
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(3, b, "x", "s", 1), (5, a, "x", "s", 2), (5, b, "x", "s", 3), (None, b, "x", "s", 4), (7, None, "x", "s", 5), (8, "", "x", "s", 6)]
    for order in (rows, rows[::-1]):
        got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(order, schema).coalesce(1), SF).collect()
        assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in got), key=str) == sorted([(3, b, 1), (5, a, 2), (None, b, 4), (7, None, 5)], key=str)


def test_pipeline_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(i, t, None, None, None) for i, t, _, _ in ODD]
    mixed = spark.createDataFrame(odd, docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        mixed = stage(spark, mixed, SF)
    assert mixed.where("doc_id IS NULL").count() == 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_slices_of_texts_are_small_and_whole():
    """A worker's arrays are many times its slice of texts, and workers share an executor's memory: a quarter of a MB at a time, every row once and in order."""
    import pyarrow as pa

    from lumivox.llm.storage import slices

    texts = ["x" * 60_000, None, "", "y" * 700_000] * 5
    got = list(slices(iter([pa.record_batch({"text": texts})]), "text"))
    assert [t for b in got for t in b.column("text").to_pylist()] == texts
    assert all(sum(len(t or "") for t in b.column("text").to_pylist()[:-1]) < 1 << 18 for b in got)
    small = list(slices(iter([pa.record_batch({"text": ["z" * 60_000] * 16})]), "text"))
    assert len(small) == 4
