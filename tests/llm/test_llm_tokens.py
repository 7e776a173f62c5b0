"""Encoding, id files, packing and scoring against the library and brute force."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_rows import DOCS, clashing, docs

from adlake.llm import bitplanes, bpe, chunks, packing, pitman_yor
from adlake.llm.common import shuffles_dropped
from adlake.llm.queries import QUERIES
from adlake.sources import shared_dir

PIECES = (
    " ", " ", " ", "\n", "\t", "\r", " ", " ", "\x1c", "\x85", "a", "b", "the", "The", "'s",
    "'LL", "n't", ".", "!!", "1", "23", "é", "ß", "中", "文", "\U0001f600", "<|endoftext|>", "<|",
    "|>", "\x00", "́", "_", "-", "²", "İ", "ǆ",
)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.default_path())


def library_ids(encoder, text):
    return encoder.library.encode(text or "", add_special_tokens=False).ids


def ids_of(encoder, data):
    return np.frombuffer(data, encoder.dtype).tolist()


def test_units_and_chunks_agree_with_the_library(encoder, monkeypatch):
    monkeypatch.setattr(chunks, "BITS", 3)
    monkeypatch.setattr(chunks, "LEAST", 4)
    draw, chunked = random.Random(3), chunks.ChunkEncoder(encoder)
    for _ in range(3000):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 50)))
        expected = library_ids(encoder, text)
        assert ids_of(encoder, encoder.encode(text)) == expected, repr(text)
        assert ids_of(encoder, chunked.encode(text)) == expected, repr(text)
        assert encoder.decode(np.array(expected, int)) == encoder.library.decode(expected, skip_special_tokens=False)
    assert chunked.reused


def test_shared_passages_are_encoded_once(encoder):
    passage = " ".join(f"word{i} of text" for i in range(2000))
    chunked = chunks.ChunkEncoder(encoder)
    chunked.encode("One start. " + passage)
    made = chunked.made
    chunked.encode("Quite another beginning, longer. " + passage)
    assert chunked.made - made <= 3 and chunked.reused >= made - 3


def test_encode_stands_awkward_rows(spark, encoder):
    tokens = chunks.encode(clashing(docs(spark)))
    rows = collections.Counter((row.id, tuple(ids_of(encoder, row.ids))) for row in tokens.collect())
    assert rows == collections.Counter((row[0], tuple(library_ids(encoder, row[1]))) for row in DOCS)
    back = collections.Counter((row.id, row.text) for row in chunks.decode(tokens).collect())
    assert back == collections.Counter((row[0], row[1] or "") for row in DOCS)
    assert chunks.encode(docs(spark, [])).count() == 0


def test_chunk_query_against_the_library(spark, sf_dir, encoder):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for row in QUERIES["op4_chunk_reuse"](spark, sf_dir).collect():
        ids = library_ids(encoder, texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("by, planes", [(1, 16), (1, 32), (8, 2), (8, 4)])
@pytest.mark.parametrize("count", [0, 1, 7, 8, 9, 1000])
def test_planes_round_trip(by, planes, count):
    ids = np.random.default_rng(1).integers(0, 1 << min(32, planes * by), count).astype("<u4")
    assert (bitplanes.from_planes(bitplanes.to_planes(ids, planes, by), count, by) == ids).all()


@pytest.mark.parametrize("by", [1, 8])
def test_id_files_hold_all_rows_in_order(spark, encoder, by):
    manifest = bitplanes.write_ids(clashing(docs(spark)), shared_dir(spark, "planes"), by=by)
    rows = sorted(bitplanes.read_ids(spark, manifest).collect(), key=lambda row: row.start)
    assert [row.doc_id for row in rows] == sorted((row[0] for row in DOCS), key=lambda i: (i is not None, i or 0))
    expected = collections.Counter()
    for row in DOCS:
        ids = [*library_ids(encoder, row[1]), 2]
        expected[row[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == expected
    starts = [0, *itertools.accumulate(row.n_tokens for row in rows)]
    assert [row.start for row in rows] == starts[:-1]
    empty = bitplanes.write_ids(docs(spark, []), shared_dir(spark, "planes"))
    assert bitplanes.read_ids(spark, empty).count() == 0


def test_curve_visits_neighbours():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    keys = packing.hilbert_keys(points, 3)
    walked = points[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(walked, axis=0)).sum(1) == 1).all()


def test_packing_holds_every_id_once(spark, encoder):
    pieces = packing.pack(clashing(docs(spark))).toPandas()
    totals = collections.Counter(len(library_ids(encoder, row[1])) + 1 for row in DOCS)
    assert pieces.length.sum() == sum(n * k for n, k in totals.items())
    lengths = pieces.groupby("sequence_id").length.sum()
    assert lengths.max() <= 1024 and all(n & (n - 1) == 0 for n in lengths)
    for _, sequence in pieces.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum().tolist()[:-1]]
    eight = pieces[pieces.doc_id == 8].sort_values("start")
    ids, at = np.array([*library_ids(encoder, DOCS[-1][1]), 0]), 0
    for piece in eight.itertuples():
        assert piece.start == at and piece.doc_tokens == len(ids)
        assert piece.ids_crc32 == zlib.crc32(ids[at : at + piece.length].astype("<u4").tobytes())
        at += piece.length
    assert at == len(ids)
    assert packing.pack(docs(spark, [])).count() == 0


def test_similar_documents_lie_closer():
    draw = np.random.default_rng(2)
    kinds = [draw.integers(k * 5000, k * 5000 + 400, (20, 600)) for k in range(4)]
    places = [np.array([packing.position(ids) for ids in kind]) for kind in kinds]
    within = np.mean([np.linalg.norm(p - p.mean(0), axis=1).mean() for p in places])
    between = np.linalg.norm(np.array([p.mean(0) for p in places]) - np.mean([p.mean(0) for p in places], 0), axis=1).mean()
    assert within < between


def test_scores_against_brute_force(spark, sf_dir):
    rows = QUERIES["op9_pitman_yor"](spark, sf_dir).collect()
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    words = {i: pitman_yor.tokens(text) for i, text in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    seen = collections.Counter(w for i in words if not held[i] for w in words[i])
    total, kinds = sum(seen.values()), len(seen)
    better = 0.0
    assert len(rows) == len(texts)
    for row in rows:
        own = words[row.doc_id]
        base = sum(math.log10((seen[w] + 1) / (total + kinds + 1)) for w in own)
        assert (row.held_out, row.n_tokens, row.train_tokens) == (held[row.doc_id], len(own), total)
        assert row.n_known == sum(seen[w] > 0 for w in own)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        better += (row.score - row.base_score) if row.held_out else 0
    assert better > 0


def with_held(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(docs.doc_id.alias("id"), pitman_yor.held_out_of(docs.doc_id).alias("held_out"), "text")


def seats_of(model):
    """Per pair its customers and the tables of each seating, and per word its customers
    and for each seating tables after it and both numbers of the shared restaurant."""
    pairs, words = {}, {}
    for row in model.pairs.collect():
        keys, before, after = pitman_yor._dense(row.asDict())
        kept = pitman_yor._ints(row.z).reshape(len(model.seatings), -1).T.tolist()
        seats = zip(pitman_yor._ints(row.c).tolist(), kept, strict=True)
        pairs |= dict(zip(zip(keys[before].tolist(), keys[after].tolist(), strict=True), seats, strict=True))
    for row in model.words.collect():
        keys = pitman_yor._hashes(row.keys).tolist()
        kept = pitman_yor._ints(row.z).reshape(len(model.seatings), 3, len(keys)).transpose(2, 0, 1).tolist()
        words |= dict(zip(keys, zip(pitman_yor._ints(row.c).tolist(), kept, strict=True), strict=True))
    return pairs, words


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return pitman_yor.learn(with_held(spark, sf_dir))


@pytest.fixture(scope="module")
def learnt(spark, sf_dir):
    """Per row of the table: id, whether held out, and hashes of its tokens."""
    rows = with_held(spark, sf_dir).collect()
    return [(r.id, r.held_out, [xxhash.xxh64_intdigest(w) for w in pitman_yor.tokens(r.text)]) for r in rows]


def pairs_of(words):
    return zip([pitman_yor.END, *words], words, strict=False)


def test_seats_against_brute_force(model, learnt):
    met = collections.Counter(p for _, held, words in learnt if not held for p in pairs_of(words))
    seen = collections.Counter(w for _, held, words in learnt if not held for w in words)
    pairs, words = seats_of(model)
    assert {pair: c for pair, (c, _) in pairs.items()} == {pair: n for pair, n in met.items() if n > 1}
    assert {word: c for word, (c, _) in words.items()} == seen
    for at, shared in enumerate(model.seatings):
        after, served = collections.Counter(), collections.Counter()
        for pair, n in met.items():
            tables = pairs[pair][1][at] if n > 1 else 1
            assert 1 <= tables <= n
            after[pair[0]] += tables
            served[pair[1]] += tables
        assert all(kept[at][:2] == [after[w], served[w]] for w, (_, kept) in words.items())
        assert all(1 <= kept[at][2] <= kept[at][1] for _, kept in words.values())
        assert (shared.customers, shared.kinds) == (sum(seen.values()), len(seen))
        assert shared.served == sum(served.values()) and shared.held == sum(k[at][2] for _, k in words.values())


def chance(model, met, pairs, words, before, word):
    """Probability of one word after another, averaged over the seatings, by the rule."""
    n = met[before, word]
    total, none = 0.0, (0, [[0, 0, 0]] * len(model.seatings))
    for at, shared in enumerate(model.seatings):
        _, served, held = words.get(word, none)[1][at]
        new = (pitman_yor.THETA_TOP + shared.d_top * shared.held) / (shared.kinds + 1)
        top = (served - shared.d_top * held + new) / (pitman_yor.THETA_TOP + shared.served)
        context, after = words.get(before, none)
        tables = pairs[before, word][1][at] if n > 1 else n
        room = pitman_yor.THETA + shared.d * after[at][0]
        total += (n - shared.d * tables + room * top) / (pitman_yor.THETA + context)
    return total / len(model.seatings)


def test_model_scores_against_brute_force(model, learnt):
    met = collections.Counter(p for _, held, words in learnt if not held for p in pairs_of(words))
    pairs, words = seats_of(model)
    expected = sorted(
        (id, sum(math.log10(chance(model, met, pairs, words, *pair)) for pair in pairs_of(own)))
        for id, _, own in learnt
    )
    found = sorted((row.id, row.score) for row in pitman_yor.score(model).collect())
    assert [id for id, _ in found] == [id for id, _ in expected]
    assert [s for _, s in found] == pytest.approx([s for _, s in expected], rel=1e-9)


def test_probabilities_sum_to_one(model, learnt):
    met = collections.Counter(p for _, held, words in learnt if not held for p in pairs_of(words))
    pairs, words = seats_of(model)
    frequent = [word for word, _ in collections.Counter(p[0] for p in met).most_common(3)]
    for before in [*frequent, pitman_yor.END, next(iter(words)), 1]:  # 1 is the hash of no word
        sums = math.fsum(chance(model, met, pairs, words, before, word) for word in [*words, 2])
        assert sums == pytest.approx(1, rel=1e-9)


def test_held_out_texts_are_predicted_from_the_word_before(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[(i * 7 + k * (1 + i % 2)) % 40] for k in range(60))) for i in range(200)]
    rows = pitman_yor.score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [row for row in rows if row.held_out]
    # Two words may follow each, so some two bits a token at the most; 40 are known.
    assert held and max(row.perplexity for row in held) < 4


def test_held_out_perplexity(spark):
    """Plain counts come to 11,658 there, nine classes of contexts came to 6,046."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [row for row in pitman_yor.score_corpus(docs).collect() if row.held_out]
    assert 10 ** (-sum(row.score for row in rows) / sum(row.n_tokens for row in rows)) < 3500


def mean_tables(count, weight, d):
    """Expected tables of a dish, from generalised Stirling numbers."""
    tables = np.arange(count + 2)
    ways = np.where(tables == 1, 0.0, -np.inf)
    for seated in range(1, count):
        stay = ways + np.log(np.maximum(seated - d * tables, 1e-300))
        ways = np.logaddexp(stay, np.concatenate(([-np.inf], ways[:-1])))
    p = ways + tables * np.log(weight)
    p = np.exp(p - p.max())
    return (p * tables).sum() / p.sum()


@pytest.mark.parametrize("exact", [64, 1024])
@pytest.mark.parametrize(
    ("count", "p", "theta", "d"),
    [(40, 0.3, 3.0, 0.6), (400, 0.02, 60.0, 0.8), (300, 0.001, 2.0, 0.5), (1000, 0.02, 500.0, 0.7)],
)
def test_seatings_follow_their_distribution(monkeypatch, exact, count, p, theta, d):
    """Up to ``EXACT`` by the numbers themselves, beyond by what is close to them."""
    ways = pitman_yor.stirling(d, count)[count, 1:]
    weight = ways + np.cumsum(np.log(p * (theta + d * (20 + np.arange(count)))))
    weight = np.exp(weight - weight.max())
    tables = np.arange(1, count + 1)
    mean = (weight * tables).sum() / weight.sum()
    spread = math.sqrt((weight * (tables - mean) ** 2).sum() / weight.sum())
    monkeypatch.setattr(pitman_yor, "EXACT", exact)
    many = 20_000
    drawn = pitman_yor.draw_tables(
        np.full(many, count), np.full(many, 20), np.full(many, p), theta, d, np.random.default_rng(1)
    )
    assert drawn.min() >= 1 and drawn.max() <= count
    assert drawn.mean() == pytest.approx(mean, rel=0.01 if exact >= count else 0.05)
    assert drawn.std() == pytest.approx(spread, rel=0.05 if exact >= count else 0.15, abs=0.05)


def test_stirling_numbers_give_the_expected_tables():
    p = pitman_yor.stirling(0.6, 40)[40, 1:41] + np.arange(1, 41) * np.log(3.0)
    p = np.exp(p - p.max())
    assert (p * np.arange(1, 41)).sum() / p.sum() == pytest.approx(mean_tables(40, 3.0, 0.6), rel=1e-9)


@pytest.mark.parametrize("values", [[], [0, 0], [3, 0, 255], [256], [1 << 40, 7]])
def test_packed_numbers_come_back(values):
    assert pitman_yor._ints(pitman_yor._pack(np.array(values, np.int64))).tolist() == values


def test_log_gamma():
    values = np.array([1e-3, 0.4, 1, 2.5, 30, 1e6])
    assert pitman_yor.log_gamma(values) == pytest.approx([math.lgamma(x) for x in values], rel=1e-10, abs=1e-10)


def test_a_frequent_pair_gets_as_many_tables_as_its_weight_asks():
    # About ``room * log(1 + count / room)`` tables where ``d`` is small.
    counts, p = np.full(50, 1_000_000), np.full(50, 0.05)
    drawn = pitman_yor.draw_tables(counts, np.full(50, 20_000), p, 1.0, 0.05, np.random.default_rng(1))
    room = 0.05 * (1 + 0.05 * 20_000)
    assert drawn.mean() == pytest.approx(room * math.log(1 + 1e6 / room), rel=0.3)


def test_blocks_hold_every_token(spark):
    rows = [(i, i % 2 == 0, text) for i, text in enumerate([" A b\u00a0B \x1c x\x0b", "", None, "\tÄ a\n", "e" * 70_000])]
    batch = pa.RecordBatch.from_pylist([dict(zip(("id", "held_out", "text"), row, strict=True)) for row in rows])
    row = pitman_yor._block([batch], 0)
    words = pitman_yor._hashes(row["words"])
    own = [[xxhash.xxh64_intdigest(w) for w in pitman_yor.tokens(text)] for _, _, text in rows]
    assert words[pitman_yor._ints(row["codes"])].tolist() == [w for words in own for w in words]
    assert row["lengths"] == [len(words) for words in own]


def test_scoring_stands_awkward_rows(spark):
    rows = pitman_yor.score_corpus(clashing(docs(spark))).collect()
    assert len(rows) == len(DOCS)
    assert {row.n_tokens for row in rows if row.id in (3, 4, 5)} == {1}
    assert all(math.isfinite(row.score) for row in rows)
    assert pitman_yor.score_corpus(docs(spark, [])).count() == 0


def test_id_files_query_against_the_library(spark, sf_dir, encoder):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    start, expected = 0, []
    for row in sorted(rows, key=lambda row: row.doc_id):
        ids = [*library_ids(encoder, row.text), 2]
        expected.append((row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = QUERIES["op7_bit_planes"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, found.collect())) == expected


def test_packing_query_against_the_library(spark, sf_dir, encoder):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    ids = {row.doc_id: np.array([*library_ids(encoder, row.text), 0], "<u4") for row in rows}
    pieces = QUERIES["op10_hilbert_packing"](spark, sf_dir).collect()
    held, filled = collections.defaultdict(list), collections.defaultdict(list)
    for row in pieces:
        piece = ids[row.doc_id][row.start : row.start + row.length]
        assert len(piece) == row.length and zlib.crc32(piece.tobytes()) == row.ids_crc32
        assert row.doc_tokens == len(ids[row.doc_id])
        held[row.doc_id].append((row.start, row.length))
        filled[row.sequence_id].append((row.offset, row.length))
    for spans, whole in [*((held[i], len(ids[i])) for i in ids), *((s, None) for s in filled.values())]:
        ends = [0, *itertools.accumulate(length for _, length in sorted(spans))]
        assert [at for at, _ in sorted(spans)] == ends[:-1]
        assert ends[-1] == whole if whole else ends[-1] <= 1024


def test_seatings_kept_are_some_sweeps_away_from_the_start(spark, sf_dir, monkeypatch, tmp_path):
    assert pitman_yor.BURN_IN >= 5 and pitman_yor.SWEEPS - pitman_yor.BURN_IN >= 3
    root = f"file://{tmp_path}"
    monkeypatch.setattr(pitman_yor, "shared_dir", lambda spark, name: f"{root}/{name}")
    model = pitman_yor.learn(with_held(spark, sf_dir).limit(50))
    assert len(model.seatings) == pitman_yor.SWEEPS - pitman_yor.BURN_IN
    # However many sweeps, two of them lie on disk.
    kept = sorted(path.name for path in (tmp_path / "pitman_yor").iterdir())
    assert kept == ["blocks", "counts", "pairs0", "pairs1", "words0", "words1"]


def test_what_blocks_are_told_takes_the_place_of_the_sweep_before_the_last(spark, sf_dir, monkeypatch, tmp_path):
    monkeypatch.setattr(pitman_yor, "shared_dir", lambda spark, name: f"file://{tmp_path}/{name}")
    model = pitman_yor.learn(with_held(spark, sf_dir).limit(50))
    before = sorted(pitman_yor.score(model).collect())
    root = tmp_path / "pitman_yor"
    assert [path.name for path in tmp_path.iterdir()] == ["pitman_yor"]
    assert sorted(path.name for path in root.iterdir()) == ["blocks", "counts", "pairs0", "pairs1", "words0", "words1"]
    for name, seating in (("pairs", model.pairs), ("words", model.words)):
        spare = root / f"{name}{1 - pitman_yor.SWEEPS % 2}"
        assert [path.name for path in spare.iterdir() if path.is_dir()] == ["block=0"]
        assert seating.count() > 0
    assert sorted(pitman_yor.score(model).collect()) == before


ODD = ["", " ", "a", "b.\nC", "b.\n\nC", "b.\t\nC d", "x  y", "word$$$ word.%%% it's", "a\n b", "é.\nÈl, don't", "end ", "1,2\n3", "a<|endoftext|>b c<|", "\nа\n б", "ɐ$ a\u00a0b\nc", "s't\n's"]


def test_texts_encoded_together_have_the_librarys_ids(encoder):
    end = np.array([7], encoder.dtype).tobytes()
    drawn = random.Random(4)
    texts = ODD + ["".join(drawn.choices("ab \n\t.,'$<|é7", k=drawn.randrange(12))) for _ in range(2000)]
    library = encoder.library.encode_batch(texts, add_special_tokens=False)
    wanted = [np.array(found.ids, encoder.dtype).tobytes() for found in library]
    assert [encoder.encode(text) for text in texts] == wanted
    assert encoder.encode_all(pa.array(texts), end).to_pylist() == [ids + end for ids in wanted]
    assert encoder.encode_all(pa.array(texts).slice(3, 9)).to_pylist() == wanted[3:12]
    assert encoder.encode_all(pa.array([], pa.string())).to_pylist() == []


def test_parts_of_odd_words_are_encoded_once(monkeypatch):
    encoder, asked = bpe.Encoder(bpe.default_path()), []
    merge = encoder._merge
    monkeypatch.setattr(encoder, "_merge", lambda written: asked.append(written) or merge(written))
    for text in ["one two three", "begin two.\nThree two.\nOne three.\nThree two$$$ three$$$"]:
        encoder.encode(text)
    assert len(asked) == len(set(asked))


def test_integers_are_packed_byte_by_byte():
    # One large value among small ones costs little, as the higher bytes are apart.
    values = np.random.default_rng(1).integers(0, 200, 10_000)
    alone = len(pitman_yor._pack(values))
    values[0] = 1 << 30
    assert len(pitman_yor._pack(values)) < 1.1 * alone
    assert pitman_yor._ints(pitman_yor._pack(values)).tolist() == values.tolist()


def test_the_session_setting_is_as_before_shuffles_were_dropped(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with shuffles_dropped(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before
