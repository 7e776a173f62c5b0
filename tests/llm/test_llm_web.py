"""Archives, main texts and nearest neighbours."""

import base64
import gzip
import hashlib
import io
import time

import numpy as np
import pyarrow as pa
import pytest

from adlake.llm import host_paths, multi_index, warc
from adlake.llm.queries import QUERIES
from adlake.sources import shared_dir

PAGES = [
    (1, "http://a.example/1", "<p>same</p>"),
    (2, None, "<p>same</p>"),
    (3, "http://b.example/\r\nx", None),
    (4, "not a url [", ""),
    (5, "http://b.example", "\x1f\x8b\x08\x00" * 4000),
    (6, "http://c.example", "é" * 300_000),
    (None, "http://c.example", "<p>same</p>"),
]
PAGE = "page_id long, url string, html string"


def test_archives_round_trip_in_any_ranges(spark):
    pages = spark.createDataFrame(PAGES, PAGE).selectExpr("*", "'own' AS digest", "'own' AS first", "'own' AS id")
    archives = warc.write_archives(pages, shared_dir(spark, "warc"))
    for size in (64, 1000, 1 << 20):
        rows = {row.page_id: row for row in warc.read_archives(spark, archives, size).collect()}
        assert len(rows) == len(PAGES)
        for id, _, html in PAGES:
            data = (html or "").encode()
            assert rows[id].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
            if rows[id].record_type == "response":
                assert bytes(rows[id].payload) == data
        assert (rows[2].record_type, rows[2].refers_to) == ("revisit", 1)
        assert (rows[4].record_type, rows[4].refers_to) == ("revisit", 3)
        assert rows[None].record_type == rows[1].record_type == "response"
    none = warc.write_archives(pages.where("false"), shared_dir(spark, "warc"))
    assert warc.read_archives(spark, none).count() == 0


def test_least_bytes_keep_small_payloads_whole(spark):
    archives = warc.write_archives(spark.createDataFrame(PAGES, PAGE), shared_dir(spark, "warc"), least=5)
    kinds = {row.page_id: row.record_type for row in warc.read_archives(spark, archives).collect()}
    assert kinds[4] == "response" and kinds[2] == "revisit"


def test_archive_query_against_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    first = {}
    for row in sorted(pages, key=lambda row: row.page_id):
        first.setdefault(row.html or "", row.page_id)
    found = {row.page_id: row for row in QUERIES["op5_splittable_warc"](spark, sf_dir).collect()}
    assert len(found) == len(pages)
    for row in pages:
        got, data = found[row.page_id], (row.html or "").encode()
        assert got.payload_bytes == len(data)
        assert (got.refers_to or row.page_id) == first[row.html or ""]


ARTICLE = """<!DOCTYPE html><html><head><title>t</title></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article class="post-12"><header><h1>Head &amp; line</h1></header><p>One <b>two</b>&nbsp;three<br>four
<ul><li>a<li>b</ul><form><input>find</form><div class="share-bar">Share</div><script>if (a<b) "</p>"</script>
<table><tr><td>c1<td>c2</table>tail &lt;i&gt;</article><section id="comments"><p>nice</section></main>
<aside>side</aside><!-- <p>no --><footer>&copy; x</footer>"""


def _member(kind, id, payload, name=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {id}\r\nContent-Length: {len(payload)}\r\n\r\n"
    packed = io.BytesIO()
    with gzip.GzipFile(name, "wb", fileobj=packed) as out:
        out.write(head.encode() + payload + b"\r\n\r\n")
    return packed.getvalue()


def _places(data, size):
    file, size = pa.BufferReader(data), size or len(data)
    return [
        (at, found and found["payload"])
        for start in range(0, len(data), size)
        for at, found in warc.records_in(file, len(data), start, min(start + size, len(data)))
    ]


def test_archives_of_other_programs_are_read(spark, tmp_path):
    members = [
        _member("warcinfo", "<urn:uuid:6f1c0e5e-0000-4000-8000-0123456789ab>", b"software: x", "a.warc"),
        _member("request", "<urn:page:9999999999999999999999>", b"GET / HTTP/1.1", "b"),
        _member("response", "<urn:page:7>", np.random.default_rng(1).bytes(3 << 20)),
        _member("response", "", b""),
    ]
    path = tmp_path / "other.warc.gz"
    path.write_bytes(b"".join(members))
    size = path.stat().st_size
    listed = spark.createDataFrame([(str(path), size)], "path string, size long")
    for step in (1 << 16, size):
        rows = warc.read_archives(spark, listed, step).orderBy("at").collect()
        assert [row.record_type for row in rows] == ["warcinfo", "request", "response", "response"]
        assert [row.page_id for row in rows] == [None, None, 7, None]
        assert rows[0].record_id.startswith("<urn:uuid:") and len(rows[2].payload) == 3 << 20


@pytest.mark.parametrize("hurt", range(5))
@pytest.mark.parametrize("offset", [0, 2, 10, 40, -3])
def test_no_damaged_record_is_passed_over(hurt, offset):
    members = [_member("response", f"<urn:page:{i}>", bytes([65 + i]) * 3 + bytes(range(256)) * 3) for i in range(5)]
    starts = [sum(map(len, members[:i])) for i in range(5)]
    data = bytearray(b"".join(members))
    data[starts[hurt] + offset % len(members[hurt])] ^= 0xFF
    for size in (7, 64, len(members[0]), 0):
        found = _places(bytes(data), size)
        assert [at for at, payload in found if payload is not None] == [s for i, s in enumerate(starts) if i != hurt]
        assert [at for at, payload in found if payload is None] == [starts[hurt]]


def test_damage_ends_the_job_or_is_a_row(spark, tmp_path):
    data = b"".join(_member("response", f"<urn:page:{i}>", b"x" * 900) for i in range(3))
    path = tmp_path / "cut.warc.gz"
    path.write_bytes(data[:-5])
    listed = spark.createDataFrame([(str(path), len(data) - 5)], "path string, size long")
    with pytest.raises(Exception, match="damaged record at byte"):
        warc.read_archives(spark, listed).collect()
    rows = warc.read_archives(spark, listed, strict=False).orderBy("at").collect()
    assert [row.record_type for row in rows] == ["response", "response", warc.DAMAGED]
    assert rows[2].path == str(path) and rows[2].payload is None


def test_main_text_of_a_page():
    page = host_paths.Page(ARTICLE)
    path = page.proposal()[0]
    text = "Head & line\nOne two three four\na\nb\nc1\nc2\ntail <i>"
    assert page.text([path]) == text
    assert page.text(["html>body>nowhere", path]) == text


def test_a_host_outvotes_a_page(spark):
    body = "<html><body><div class='text-{0}'>{1}</div><div class='box'>{2}</div></body></html>"
    rows = [(i, "http://h.example/", body.format(i, "<p>Long article text here. " * 9, "<p>few words")) for i in range(9)]
    rows.append((9, "http://h.example/", body.format(9, "<p>Short.", "<p>" + "much more in the box " * 30)))
    rows += [(10, None, None), (11, "http://[bad", ""), (None, "x", "<p>no host")]
    df = spark.createDataFrame(rows, PAGE).selectExpr("*", "'own' AS host", "'own' AS paths", "'own' AS text")
    found = {row.id: row.text for row in host_paths.extract(df).collect()}
    assert found[9] == "Short." and found[3].startswith("Long article")
    assert found[10] == found[11] == "" and found[None] == "no host"
    assert host_paths.extract(df.where("false")).count() == 0


def test_page_query_keeps_articles(spark, sf_dir):
    for row in QUERIES["op6_consensus_paths"](spark, sf_dir).collect():
        assert row.n_chars == len(row.text) > 0
        assert "<p>" not in row.text and "&middot;" not in row.text


BODY = "<p>A sentence of the article that goes on for a while."


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='content with-sidebar'><article>{BODY}</article><div class='sidebar'>x</div></div>",
        f"<form id='aspnetForm'><div class='nav'><p>x</div><main>{BODY}</main></form>",
        f"<div class='layout-sidebar-right'><div class='post'>{BODY}</div><div class='sidebar'>x</div></div>",
        f"<svg class='i'/><article>{BODY}</article>",
        f"<article><svg/>{BODY}</article><svg><path d='M0'/></svg><p>x",
        f"<button-group></button-group><article>{BODY}</article><button>b</button>",
        f"<article>{BODY}</article><div class='comments'><article>" + "<p>More was said. " * 9 + "</article></div>",
    ],
)
def test_articles_in_marked_containers_and_after_empty_elements_stay(page):
    page = host_paths.Page(f"<html><body>{page}</body></html>")
    assert page.text([page.proposal()[0]]) == BODY.removeprefix("<p>")


def test_deep_and_broken_pages_are_read():
    deep = "<div>" * 5000 + "<p>text" + "</span>" * 10
    page = host_paths.Page(deep)
    assert page.text([page.proposal()[0]]) == "text"
    broken = host_paths.Page("<p>a < b <p class='x>y <b")
    assert broken.text([broken.proposal()[0]]).startswith("a < b")


@pytest.mark.parametrize(
    "piece", ["<a ", "<div>", "<a<b'", "<ul><li>", "<!-", "<script ", '<a ">" ', "<div class=x></section>"]
)
def test_hostile_pages_take_linear_time(piece):
    def seconds(n):
        start = time.process_time()
        page = host_paths.Page(piece * n + '"')
        page.text([(page.proposal() or ("",))[0]])
        return time.process_time() - start

    seconds(100)
    assert seconds(40_000) < 20 * seconds(5_000) + 0.5


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a<script>if (a > b) c", "a"),
        ("<p>a<!-- b > c", "a"),
        ("<p>a<p>b <!-- c", "a\nb"),
        ("<p>a<script>b</script>c", "ac"),
        ("no tags", "no tags"),
        ("a < b", "a < b"),
        ("<div class='[&>p]:mt-2'><p>a</div>", "a"),
        ("<p>a</section></div>b", "ab"),
    ],
)
def test_what_a_page_leaves_open(page, text):
    page = host_paths.Page(page)
    assert page.text([page.proposal()[0]]) == text


def test_repeated_rows_are_extracted_alike(spark):
    rows = [(1, "http://a.example/1", f"<html><body><article>{BODY}</article></body></html>")] * 3
    found = host_paths.extract(spark.createDataFrame(rows, PAGE)).collect()
    assert len(found) == 3 and {row.text for row in found} == {BODY.removeprefix("<p>")}


def test_probing_finds_all_within_the_radius():
    codes = np.random.default_rng(4).integers(0, 1 << 63, (300, 4)).astype("<u8")
    codes[100:200] = codes[:100] ^ np.uint64(0b1011)
    shard = multi_index.Shard(codes)
    for i in range(0, 300, 17):
        apart = np.bitwise_count(codes ^ codes[i]).sum(1)
        for radius in (0, 3, 15, 16, 17, 110, 128, 256):
            assert shard.within(codes[i], radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_recall_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, unit = rows.vec_id.to_numpy(), np.stack(rows.embedding.tolist()).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    found = QUERIES["op1_multi_index_hashing"](spark, sf_dir).toPandas()
    hits = 0
    for query, mine in found.groupby("query_id"):
        cosine = unit @ unit[ids == query][0]
        cosine[ids == query] = -2
        hits += len(set(mine.vec_id) & set(ids[np.lexsort((ids, -cosine))[:5]]))
        assert mine.sort_values("rank")["rank"].tolist() == [1, 2, 3, 4, 5]
        assert mine.sort_values("rank").score.is_monotonic_decreasing
    assert hits >= 0.9 * len(found) and len(found) == 5 * (ids % 50 == 0).sum()


def test_neighbours_stand_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]),
        (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (10, []),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'own' AS id", "'own' AS code")
    found = multi_index.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(row.vec_id, row.score) for row in found] == [(1, 1.0), (2, 1.0), (3, 0.0)]
    assert multi_index.nearest(df.where("false"), df).count() == 0


@pytest.mark.parametrize("length", [8, 100, 300])
def test_codes_of_any_length_of_vector(length):
    book = multi_index.fit(np.random.default_rng(1).standard_normal((400, length)), 5)
    assert book.codes(np.ones((3, length))).shape == (3, multi_index.BITS // 64)
