"""Quality rules, line dedup, SimHash and the pipeline."""

import collections
import re

import duckdb
import numpy as np
import pytest
import xxhash
from llm_rows import DOCS, LONG, clashing, docs

import corpus_pipeline
from adlake.llm import components, line_spread, quality, simhash
from adlake.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = db.execute(ORACLES[name])
    names = [column[0] for column in cursor.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def counts_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = collections.Counter(windows)
    covered = {i + k for i, window in enumerate(windows) if seen[window] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(covered)


def test_quality_counts_match_brute_force(spark):
    rows = quality.judge(clashing(docs(spark))).collect()
    assert len(rows) == len(DOCS)
    for row in rows:
        assert (row.n_words, row.word_chars, row.n_repeat_words) == counts_of(row["row"].text)
        assert row["row"].kept == "own kept"
        if row.kept:
            assert not row.base_failed


def test_quality_keeps_columns_and_good_rows(spark):
    good = "The cat of the house sat on a mat and it was in the sun. " * 2
    body = " ".join(f"{good} word{i}" for i in range(8)) + " " + " ".join(
        f"the thing{i} of day{i}" for i in range(200)
    )
    kept = quality.keep_good(clashing(docs(spark, [(9, body, "en", "a", 1), *DOCS])))
    assert kept.columns == clashing(docs(spark)).columns
    assert [row.doc_id for row in kept.collect()] == [9]
    assert quality.keep_good(docs(spark, [])).count() == 0


def test_line_dedup_takes_out_what_many_sites_share(spark):
    shared = "Shared by all sites, here and there."
    rows = [(i, f"Own line {i} of text {i}, long enough to stay.\n{shared}\n", "en", f"s{i % 6}", 9) for i in range(12)]
    rows += [(50 + i, "A copy that is wholly the same.", "en", f"s{i}", 9) for i in range(7)]
    rows += [(90, None, None, None, None), (91, "", "en", None, 0), (92, f"x\n{shared}", "en", None, 0)]
    out = {row["row"].doc_id: row for row in line_spread.drop_spread_lines(clashing(docs(spark, rows))).collect()}
    assert out[3].text == "Own line 3 of text 3, long enough to stay.\n" and out[3].n_removed == 1
    assert out[52].text == "A copy that is wholly the same." and out[52].n_removed == 0
    assert out[90].text is None and out[90].n_lines == 0 and out[91].text == ""
    assert out[92].n_removed == 1 and out[92].text == "x"
    assert line_spread.without_boilerplate(docs(spark, [])).count() == 0


@pytest.mark.parametrize("sites", [4, 5, 6, 40])
def test_spread_near_the_threshold_is_exact(spark, sites):
    seen = spark.range(sites * 3).selectExpr("1L AS of_text", f"CAST(id % {sites} AS STRING) AS at_site", "7L AS line")
    assert line_spread.spread_lines(seen).count() == int(sites >= line_spread.MIN_SITES)


def fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(gram, 42) for gram in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def linked(rows, distance):
    """Component of each row: the smallest id reachable over links."""
    labels = [id for id, _ in rows]
    moved = True
    while moved:
        moved = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= distance and labels[j] < labels[i]:
                    labels[i], moved = labels[j], True
    return labels


@pytest.mark.parametrize("leaf, most", [(2048, 1 << 15), (8, 1 << 15), (8, 16)])
def test_simhash_matches_brute_force(spark, sf_dir, monkeypatch, leaf, most):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "MOST", most)
    rows = QUERIES["op2_simhash_vp_trees"](spark, sf_dir).collect()
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows.sort(key=lambda row: row.doc_id)
    prints = [fingerprint(texts[row.doc_id]) for row in rows]
    assert [row.fingerprint for row in rows] == [f"{p:016x}" for p in prints]
    expected = linked([(row.doc_id, p) for row, p in zip(rows, prints, strict=True)], 4)
    assert [row.component_id for row in rows] == expected


def test_simhash_stands_awkward_rows(spark):
    found = simhash.near_duplicates(clashing(docs(spark)))
    by_id = collections.defaultdict(set)
    for row in found.collect():
        by_id[row.id].add((row.component, bytes(row["print"]) == bytes(8)))
    assert by_id[1] == {(1, False)} and by_id[2] == {(1, False)}
    assert by_id[3] == by_id[4] == by_id[5] == {(3, True)}
    assert found.count() == len(DOCS)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    words = [f"w{i}" for i in range(300)]
    near = [*words[:150], "changed", *words[151:]]
    rows = [
        (5, " ".join(words), "en", "a", 1),
        (5, " ".join(words), "en", "a", 1),
        (3, " ".join(near), "en", "b", 1),
        (7, " ".join(f"other{i}" for i in range(300)), "en", "c", 1),
    ]
    kept = simhash.one_of_each(clashing(docs(spark, rows)))
    assert kept.columns == clashing(docs(spark)).columns
    assert sorted(row.doc_id for row in kept.collect()) == [3, 7]
    assert simhash.one_of_each(docs(spark, [])).count() == 0


def test_groups_are_those_of_exact_similarity(spark, monkeypatch):
    """Pairs just at 0.8 and just below, one group dealt out in parts, and repeats."""
    monkeypatch.setattr(simhash, "FAMILY", 3)

    def text(name, n, cut=0):
        return " ".join([*(f"{name}w{i}" for i in range(n)), *(f"{name}x{cut}y{i}" for i in range(cut))])

    rows = []
    for pair in range(40):  # 100 shared shingles: of 125 in all, or of 127
        name, more = f"p{pair}", 25 if pair % 2 else 27
        rows.append((2 * pair, text(name, 104), "en", "a", 1))
        rows.append((2 * pair + 1, text(name, 104, more), "en", "a", 1))
    rows += [(200 + i, text("same", 300, i), "en", "a", 1) for i in range(12)]
    # The same set but for few shingles, one of them repeated very often.
    rows += [(300, text("r", 200), "en", "a", 1), (301, text("r", 200) + " again" * 2000, "en", "a", 1)]
    kept = {row.doc_id for row in simhash.one_of_each(docs(spark, rows)).collect()}
    grams = {i: set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for i, t, *_ in rows}
    alone = {
        i for i in grams
        if not any(j < i and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) for j in grams)
    }
    assert kept == alone and 1 in kept and 3 not in kept


def changed(rng, rows, count):
    """The fingerprints with ``count`` drawn bits of each changed."""
    ones = np.unpackbits(rows, axis=1)
    for row in ones:
        row[rng.choice(ones.shape[1], count, replace=False)] ^= 1
    return np.packbits(ones, axis=1)


def sets_of(prints, distance):
    """The smallest row that each reaches over links, comparing all with all."""
    words, of = prints.view(np.uint64), np.arange(len(prints))
    for i in range(len(words)):
        near = np.bitwise_count(words ^ words[i]).sum(1, dtype=np.int64) <= distance
        of[np.isin(of, np.unique(of[near]))] = of[near].min()
    return of.tolist()


def test_candidates_match_brute_force(spark, monkeypatch):
    """In several cells per table, one of which a group of like fingerprints crowds."""
    monkeypatch.setattr(simhash, "CELL", 1024)
    simhash.ship(spark)
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 256, (6000, 96), dtype=np.uint8)
    for at, count in ((0, 90), (200, 117), (400, 130)):
        prints[3000 + at : 3200 + at] = changed(rng, prints[at : at + 200], count)
    prints[1000:3000] = changed(rng, np.repeat(prints[1000:1001], 2000, 0), 30)
    rows = [(i, bytearray(row.tobytes())) for i, row in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "id long, print binary").repartition(4)
    found = components.connected_components(simhash.near_links(nodes, 768, 156))
    roots = {row.node.id: row.root.id for row in found.collect()}
    assert [roots.get(i, i) for i in range(6000)] == sets_of(prints, 156)


def test_candidates_of_one_key_form_the_right_sets():
    rng = np.random.default_rng(6)
    chain = [rng.integers(0, 256, (1, 96), dtype=np.uint8)]
    for _ in range(99):
        chain.append(changed(rng, chain[-1], 120))
    like = changed(rng, np.repeat(chain[0][::-1] ^ 255, 120, 0), 20)
    prints = rng.permutation(np.concatenate([*chain, like, rng.integers(0, 256, (50, 96), dtype=np.uint8)]))
    sets = simhash._Sets(prints, 156)
    sets.link_all(np.arange(len(prints)))
    first = {}
    assert [first.setdefault(k, i) for i, k in enumerate(sets.of.tolist())] == sets_of(prints, 156)
    assert sorted(map(len, sets.members.values())) == [100, 120]


def test_candidates_compared_grow_with_the_rows(monkeypatch):
    """Four times the fingerprints were sixteen times the comparisons."""
    monkeypatch.setattr(simhash, "CELL", 2048)

    def compared(total):
        prints = np.random.default_rng(7).integers(0, 256, (total, 96), dtype=np.uint8)
        spots, count = simhash._spots(total, 768, 156), 0
        for number, cells in enumerate(simhash._cells(prints, spots)):
            for cell in np.unique(cells):
                count += simhash._near_sets(prints[cells == cell], number, spots[number], 156).compared
        return count

    few, many = compared(1 << 13), compared(1 << 15)
    assert 0 < few and many < 7 * few


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 400)] + [(500, 500)]
    found = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {found[i] for i in range(41)} == {0}
    assert {found[i] for i in range(100, 400)} == {100} and found[500] == 500


def test_pipeline_against_brute_force(spark, sf_dir):
    """Stage by stage, each judged on what its predecessor kept."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, table, sf_dir)
    assert {row.doc_id for row in good.select("doc_id").collect()} == {
        row["row"].doc_id for row in quality.judge(table).where("kept").collect()
    }
    lines = stages["line_dedup"](spark, good, sf_dir)
    assert lines.columns == table.columns and lines.count() == good.count()
    sites = collections.defaultdict(set)
    before = {row.doc_id: row for row in good.collect()}
    for row in before.values():
        for line in row.text.split("\n"):
            sites[line].add(row.source)
    for row in lines.collect():
        old = [line for line in before[row.doc_id].text.split("\n") if line.split()]
        spread = [line for line in old if len(sites[line]) >= line_spread.MIN_SITES]
        gone = set(spread) if len(spread) < len(old) else set()
        assert row.text == "\n".join(x for x in before[row.doc_id].text.split("\n") if x not in gone)
    one = stages["simhash_near_dedup"](spark, lines, sf_dir)
    kept = {row.doc_id for row in one.collect()}
    texts = {row.doc_id: row.text for row in lines.collect()}
    grams = {i: set(zip(*[t.lower().split()[k:] for k in range(5)], strict=False)) for i, t in texts.items()}
    for i in grams:
        close = [j for j in grams if len(grams[i] & grams[j]) >= 0.9 * len(grams[i] | grams[j])]
        assert len([j for j in close if j in kept]) <= 1
        if all(len(grams[i] & grams[j]) < 0.4 * len(grams[i] | grams[j]) for j in grams if j != i):
            assert i in kept
    pieces = stages["packing"](spark, one, sf_dir).toPandas()
    assert set(pieces.doc_id) == kept
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_wide_fingerprints_measure_similarity():
    words = LONG.split()[:400]
    text = " ".join(f"{word}{i}" for i, word in enumerate(words))
    other = " ".join(f"{word}{i}" if i % 45 else "new" for i, word in enumerate(words))
    a, b = (np.frombuffer(simhash.fingerprint(t.encode(), 5, 512), ">u8") for t in (text, other))
    assert np.bitwise_count(a ^ b).sum() <= 88
