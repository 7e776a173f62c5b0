"""Spelling variants, hard negatives and the Jaccard join, against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from llm_rows import clashing, docs

from adlake.llm import hard_negatives, jaccard, spelling
from adlake.llm.queries import QUERIES

LARGE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def small(text):
    return text.translate(str.maketrans(LARGE, LARGE.lower()))


def near_by_definition(words):
    """Words one code point apart, by every way to take a letter out or to mask one."""
    near, masked = collections.defaultdict(set), collections.defaultdict(list)
    for word in words:
        for i in range(len(word)):
            masked[word[:i], word[i + 1 :]].append(word)
            shorter = word[:i] + word[i + 1 :]
            if shorter in words:
                near[word].add(shorter)
                near[shorter].add(word)
    for group in masked.values():
        for word in group:
            near[word].update(other for other in group if other != word)
    return near


def variants_by_definition(n):
    near, form = near_by_definition(n), {}
    for word in n:
        if near[word]:
            best = min(near[word], key=lambda w: (-n[w], w))
            if n[best] >= 2 * n[word]:
                form[word] = best

    def root(word):
        while word in form:
            word = form[word]
        return word

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def variant_rows(found):
    return [(r.word, r.form, r.root, r.n, r.near, r.form_n) for r in found.collect()]


def test_op11_agrees_with_brute_force(spark, sf_dir):
    counts = collections.Counter()
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", row.text or ""):
            run = small(run)
            checksum = zlib.crc32(f"{'' if row.doc_id is None else row.doc_id}:{run}".encode())
            if checksum % 97 == 0:
                at = checksum % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {word: count for word, count in counts.items() if len(word) >= 5 and count >= 3}
    found = QUERIES["op11_kd_tree_spelling"](spark, sf_dir)
    rows = [tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == variants_by_definition(n)


@pytest.mark.parametrize("cell", [spelling.CELL, 8])
def test_variants_of_crowded_and_odd_words(spark, monkeypatch, cell):
    """Anagrams, letters beyond Latin, very long words, ties; with many cells and parts."""
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "SAMPLED", 4)
    monkeypatch.setattr(spelling, "LEAF", 4)
    rnd = random.Random(3)
    n = {"".join(rnd.choice("abc") for _ in range(rnd.choice([3, 4, 5]))): rnd.randrange(1, 40) for _ in range(300)}
    n |= {"".join(rnd.sample("abcdef", 6)): rnd.randrange(1, 9) for _ in range(200)}
    long = "xy" * 4000
    n |= {long: 9, long + "x": 3, long[:-1] + "z": 3, "жжж": 5, "жжя": 2, "a": 1, "b": 4, "tie": 1, "tia": 2, "tib": 2}
    rows = list(n.items())
    table = spark.createDataFrame([*rows, (None, 5), ("", 5)], "word string, n long")
    rows = variant_rows(spelling.variants(clashing(table)))
    assert len(rows) == len(n) and set(rows) == variants_by_definition(n)


def test_words_in_awkward_texts(spark):
    found = spelling.words_in(clashing(docs(spark))).groupBy("run").count().collect()
    runs = {row.run: row["count"] for row in found}
    assert runs["three"] == 3 and runs["quick"] == 4000 and "ten" not in runs
    assert "a" not in {run[0] for run in runs if len(run) < 5}
    assert spelling.variants(spelling.counted(spelling.words_in(docs(spark, [])).withColumnRenamed("run", "word"))).count() == 0
    words = spelling.words_in(spark.createDataFrame([(1, "Éclair ÉCLAIR naïve×naïve")], "doc_id long, text string"))
    assert sorted(row.run for row in words.collect()) == ["naïve×naïve", "Éclair", "ÉclaIR".replace("I", "i").replace("R", "r")]


def negatives_by_definition(rows, anchors, k=5):
    """Scores as Python integers; of rows with one id the first by label and vector."""
    first = {}
    for id, label, vector in sorted(rows, key=lambda r: (r[0], str(r[1]), r[2])):
        first.setdefault(id, (label, [int(np.floor(256 * x)) if abs(x) < 1e15 else 256 * int(x) for x in vector]))
    out = []
    for anchor in anchors:
        label, own = first[anchor]
        score = {
            id: max(-(1 << 56), min(1 << 56, sum(a * b for a, b in zip(own, other, strict=True))))
            for id, (_, other) in first.items()
            if id != anchor and len(other) == len(own)
        }
        order = sorted(score, key=lambda id: (-score[id], id))
        for positive in [id for id in order if first[id][0] == label][:k]:
            fits = [
                id
                for id in order
                if first[id][0] != label and 80 * score[positive] <= 100 * score[id] <= 100 * score[positive]
            ]
            out += [
                (anchor, positive, rank, id, score[positive], score[id]) for rank, id in enumerate(fits[:k], start=1)
            ]
    return sorted(out)


def test_op12_agrees_with_brute_force(spark, sf_dir):
    rows = []
    for row in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect():
        vector = row.embedding
        if vector is None or row.label is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        rows.append((row.vec_id, (row.label + 1) % 10 if row.vec_id % 7 == 0 else row.label, vector))
    found = sorted(tuple(r) for r in QUERIES["op12_segment_summaries"](spark, sf_dir).collect())
    assert found == negatives_by_definition(rows, [r[0] for r in rows if r[0] % 100 == 0])
    assert found


def test_hard_negatives_of_awkward_rows(spark):
    rnd = random.Random(5)
    rows = [(i, i % 3, [rnd.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(7)]) for i in range(120)]
    rows += [(200 + i, i % 2, [rnd.choice([1e200, -1e200, 1e-200, 3.0]) for _ in range(7)]) for i in range(12)]
    rows += [(300 + i, i % 2, [float(i), 1.0]) for i in range(6)]
    rows += [(400, 1, []), (401, 2, []), rows[5], (7, 2, [9.0] * 7)]
    broken = [(None, 1, [1.0] * 7), (500, None, [1.0] * 7), (501, 1, None), (502, 1, [None] * 7), (503, 1, [float("nan")] * 7), (504, 2, [float("inf")] * 7)]
    schema = "vec_id long, label int, embedding array<double>"
    table = spark.createDataFrame(rows + broken, schema).selectExpr("*", "1 AS id", "'x' AS vector", "2 AS size", "3 AS rank")
    anchors = [0, 7, 50, 203, 301, 400]
    asked = table.where(f"vec_id IN ({', '.join(map(str, anchors))})")
    found = sorted(tuple(r) for r in hard_negatives.hard_negatives(table, asked).collect())
    assert found == negatives_by_definition(rows, anchors) != []
    none = spark.createDataFrame([], schema)
    assert hard_negatives.hard_negatives(none, none).count() == 0


def test_bounds_hold_and_rule_rows_out():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((10, 64)) * 40
    vectors = np.floor(centres[rng.integers(0, 10, 600)] + rng.standard_normal((600, 64)) * 30)
    import pyarrow as pa

    summaries = hard_negatives.summarize(vectors)
    table = pa.table(
        {
            "id": np.arange(600),
            "label": [str(i % 4) for i in range(600)],
            "vector": [v.tobytes() for v in vectors],
            "summary": [s.tobytes() for s in summaries],
        }
    )
    shard = hard_negatives.Shard(table, 64)
    for query in range(0, 600, 97):
        every = np.arange(600)
        exact = shard.vectors @ shard.vectors[query]
        width = None
        for step in range(len(shard.steps)):
            low, high = shard.bounds(shard, query, every, step)
            assert (low <= exact).all() and (exact <= high).all()
            assert width is None or (high - low <= width + 1e-3).all(), "bounds only become narrower"
            width = high - low
    shard.looked[:] = 0
    hard_negatives._positives(shard, shard, 5)
    assert shard.looked[-1] < shard.looked[0] / 2


def similar_by_definition(rows, part=9, whole=10, size=3):
    sets = {}
    for id, text in rows:
        words = [small(w) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
        shingles = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        sets[id] = frozenset(shingles or ([tuple(words)] if words else []))
    parent = {id: id for id in sets}

    def root(id):
        while parent[id] != id:
            id = parent[id]
        return id

    for a in sets:
        for b in sets:
            if a < b and sets[a] and whole * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((id, len(sets[id]), root(id)) for id in sets)


def jaccard_rows(found):
    return sorted((r.id, r.n, r.component) for r in found.collect())


def test_op13_agrees_with_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = sorted(tuple(r) for r in QUERIES["op13_universe_partition"](spark, sf_dir).collect())
    expected = similar_by_definition([tuple(r) for r in rows])
    assert found == expected and any(id != component for id, _, component in expected)


def edited(seed):
    """Texts of many lengths with copies up to some edits apart, and one template."""
    rnd, rows = random.Random(seed), []
    words = [f"w{k}" for k in range(300)]
    for _ in range(24):
        base = [rnd.choice(words) for _ in range(rnd.choice([4, 9, 12, 15, 20, 30, 40, 60, 120]))]
        for _ in range(rnd.choice([1, 2, 4, 12])):
            text = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                at = rnd.randrange(len(text))
                text[at : at + rnd.choice([0, 1])] = [rnd.choice(words)]
            rows.append((len(rows) + 1, " ".join(text)))
    for k in range(40):
        text = [f"t{i}" for i in range(14)]
        text[rnd.randrange(14)] = f"u{k}"
        rows.append((len(rows) + 1, " ".join(text)))
    return rows


@pytest.mark.parametrize("price, few", [(0.0, 16), (1.0, 2)])
def test_jaccard_join_loses_no_link(spark, monkeypatch, price, few):
    """With segments taken together wherever pairs are left, and with crowded keys."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "PART", 5)
    rows = edited(7)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert jaccard_rows(jaccard.near_duplicates(table, price=price)) == similar_by_definition(rows)


def test_jaccard_join_of_awkward_rows(spark):
    found = jaccard_rows(jaccard.near_duplicates(clashing(docs(spark)).where("doc_id IS NOT NULL")))
    expected = dict.fromkeys([3, 4, 5], 0) | {1: 8, 2: 8, 8: 1}
    assert [n for id, n, _ in found if id in expected] == [expected[id] for id, _, _ in found if id in expected]
    assert {(id, component) for id, _, component in found if id != component} == {(2, 1)}
    assert len(found) == 9
    unnamed = jaccard.near_duplicates(docs(spark).where("doc_id IS NULL")).collect()
    assert [(row.id, row.component) for row in unnamed] == [(None, None)]
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0


def test_unions_and_segments_catch_what_they_promise():
    """Sets within the bound share a segment; those one member apart share an entry."""
    rng = np.random.default_rng(1)
    bands = jaccard.Bands(9, 10)
    for n in (10, 25, 80, 300):
        own = np.unique(rng.integers(1, 1 << 63, n, np.uint64))
        band = bands.of(len(own))
        most = bands.differences(band)
        for _ in range(20):
            keep = rng.permutation(len(own))[min(most, len(own) // 20) :]
            other = np.sort(own[keep])
            first, second = (jaccard.segment_keys(s, band, bands) for s in (own, other))
            assert (first == second).any()
            one = np.sort(own[rng.permutation(len(own))[1:]])
            keys = [set(jaccard.deletion_keys(s, band, 0, 1, bands).tolist()) for s in (own, one)]
            assert keys[0] & keys[1]
