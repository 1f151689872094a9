"""Pages, archives, conversations, vectors, the registered queries and the pipeline."""

import base64
import gzip
import hashlib
import json
import random
import re
from glob import glob

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from wavetable.llm import chat, embdedup, html, langid, packing, queries, toxicity, warc
from wavetable.llm.util import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# pages

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><p>Site</p></header><nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head&nbsp;line</h1><p>First <b>bo</b>ld   text.<p>Second &lt;one&gt; 3 < 4.<div class="ad">Buy</div><form><p>Name</p></form><section id="comments"><p>Nice!</p></section><p>Last.</article>
<aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_article_alone():
    assert html.main_text(html.lines_of(PAGE), set()) == "Head line First bold text. Second <one> 3 < 4. Last."


@pytest.mark.parametrize(
    ("inside", "stays"),
    [
        ('<div class="post has-sidebar">', True), ('<div class="no-comments">', True), ('<p style="overflow:hidden">', True), ('<p data-x="hidden menu">', True), ('<div class="adaptive header">', True), ("<section>", True), ('<p title="ad">', True),
        ('<div class="ad">', False), ('<div id="comments">', False), ('<div class="x promo_box">', False), ('<div class="cookieBanner">', False), ("<div hidden>", False), ('<div role="navigation">', False), ("<aside>", False), ("<form>", False), ('<span class="share-bar">', False),
    ],
)
def test_markup_inside_an_article(inside, stays):
    tag = inside[1:].split()[0].rstrip(">")
    text = html.main_text(html.lines_of(f"<body class='page-with-menu'><article><p>Begin</p>{inside}word</{tag}><p>End</article>"), set())
    assert text == ("Begin word End" if stays else "Begin End")


def test_markup_that_never_ends():
    for text in ("<div><p>a<p>b", "<article><p>a<b>b", "<!-- open", "<script>x", "<p title='a>b'>c", "a</p></div>b", "<", "a<b", ""):
        html.lines_of(text)
    assert html.main_text(html.lines_of("<p title='a>b'>c"), set()) == "c"


def brute_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(0, 14))] for _ in range(2))
        kept = html.shared_lines(a, b)
        assert len(kept) == brute_common(a, b)
        rest = iter(b)
        assert all(x in rest for x in (a[i] for i in sorted(kept)))


def test_differencing_without_an_article(spark):
    page = lambda k: f"<html><body><div>Welcome</div><div><p>Story {k} is here</p></div><div>Contact us</div></body></html>"
    rows = [(i, f"http://h.com/news/{i}", page(i)) for i in range(6)] + [(6, "http://alone.com/x", page(6)), (7, None, page(7)), (8, "http://h.com/e", None), (9, "http://h.com/f", "")]
    rows += [(10, "http://h.com/zz", PAGE), (11, "http://h.com/zz", PAGE)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert all(got[i][0] == f"Story {i} is here" for i in range(6))
    assert got[6][0] == "Welcome Story 6 is here Contact us" and got[7][0].startswith("Welcome") and got[8] == got[9] == ("", 0)
    assert got[10][0] == got[11][0] != "" and len(got) == 12
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_equal_pages_without_an_article(spark):
    page = lambda k: f"<html><body><div>Welcome</div><div><p>Story {k} is here</p></div><div>Contact us</div></body></html>"
    rows = [(0, "http://h.com/a/1", page(0)), (1, "http://h.com/a/2", page(1)), (2, "http://h.com/a/2", page(1)), (3, "http://h.com/a/2?ref=x", page(1)), (3, "http://h.com/a/2?ref=x", page(1)), (4, "http://h.com/b", page(4))]
    rows += [(5, "http://twice.com/a", page(5)), (6, "http://twice.com/b", page(5))]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    story = {i: f"Story {k} is here" for i, k in ((0, 0), (1, 1), (2, 1), (3, 1), (4, 4))}
    assert len(got) == 8 and all(r["text"] == story[r["page_id"]] and r["n_shared"] == 2 for r in got if r["page_id"] < 5)
    assert {(r["text"], r["n_shared"]) for r in got if r["page_id"] >= 5} == {("Welcome Story 5 is here Contact us", 0)}


def test_pages_at_the_edges_of_ranges(spark):
    page = lambda k: f"<html><body><div>Welcome</div><div><p>Story {k} is here</p></div><div>Contact us</div></body></html>"
    rows = [(i, f"http://h.com/{'ab'[i % 2]}/{i}", page(i)) for i in range(9)] + [(20 + i, f"http://same.com/{i}", page(20)) for i in range(9)] + [(29, "http://same.com/z", page(29)), (30, None, page(30)), (31, None, page(31))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 5, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append(sorted((r["page_id"], r["text"], r["n_shared"]) for r in html.extract(df).collect()))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    assert all((text, n) == (f"Story {min(i, 20) if i < 29 else i} is here", 2) for i, text, n in found[0] if i < 30)
    assert all((text, n) == (f"Welcome Story {i} is here Contact us", 0) for i, text, n in found[0] if i >= 30)


@pytest.mark.parametrize("bad", ["<a " * 350_000, '<a "' * 250_000, "<script " * 130_000, "<!x" * 300_000, "<div>" * 90_000 + "</x>" * 90_000, "<li><div>" + "<span>" * 80_000 + "</li>" * 80_000])
def test_a_bad_page_takes_linear_time(bad):
    import time

    began = time.process_time()
    html.lines_of(bad)
    assert time.process_time() - began < 5


def test_long_pages_are_halved(monkeypatch):
    monkeypatch.setattr(html, "MOST_BITS", 40)
    rng = random.Random(5)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 40))] for _ in range(2))
        pairs = sorted(html.align(a, b))
        assert len(pairs) == brute_common(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))


def brute_extract(rows):
    """Texts and line counts by comparing each page with the two runs of pages on either side of it, by a plain table of common lengths."""
    from urllib.parse import urlsplit

    def shared(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        return t[0][0]

    pages = []
    for page, url, text in rows:
        u = urlsplit(url)
        pages.append((u.netloc.lower(), u.path, f"?{u.query}" if u.query else "", page, html.lines_of(text)))
    runs = []
    for p in sorted(pages):
        if runs and runs[-1][0] == p[0] and runs[-1][1] == p[4]:
            runs[-1][2].append(p[3])
        else:
            runs.append((p[0], p[4], [p[3]]))
    out = {}
    for r, (host, lines, ids) in enumerate(runs):
        near = [x[1] for x in (*runs[max(0, r - 2) : r], *runs[r + 1 : r + 3]) if x[0] == host and [t for _, t, _ in x[1]] != [t for _, t, _ in lines]]
        keys = [html.keys_of(x) for x in (lines, *near)]
        for i in ids:
            out[i] = (len(lines), len(near), sum(shared(keys[0], k) for k in keys[1:]))
    return out


def test_differencing_decides_on_whole_table_pages(spark):
    """Nearly all deleted lines are deleted as shared ones, on every page; counts of neighbours and shared lines are those of brute force."""
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    got = html.extract(pages).collect()
    shared, by_place = sum(r["n_shared"] for r in got), sum(r["n_by_place"] for r in got)
    assert shared > 50 * by_place and all(r["n_shared"] > 0 for r in got if r["n_neighbours"] > 1)
    want = brute_extract([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])
    assert all((r["n_lines"], r["n_neighbours"]) == want[r["page_id"]][:2] for r in got)
    for r in got:  # a line has to be shared with half of the neighbours
        votes = want[r["page_id"]][2]
        assert 2 * votes >= r["n_neighbours"] * (r["n_shared"] + r["n_tied"])


def test_menus_of_any_words_align_by_their_place(spark):
    """No word of menus and notices recurs; without an article element differencing leaves the story."""
    page = lambda k: f"<html><body><nav><ul><li>menu{k}<li>entry{k}</ul></nav><div>Welcome</div><div><p>Story {k} is here</p></div><div class='cookie-bar'>Cookies {k * 7}</div></body></html>"
    rows = [(i, f"http://h.com/news/{i}", page(i)) for i in range(6)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all((r["text"], r["n_shared"], r["n_by_place"]) == (f"Story {r['page_id']} is here", 4, 0) for r in got)
    clash = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as part", "'x' as own", "3 as digest", "'y' as text", "'z' as path")
    assert sorted(map(tuple, html.extract(clash).collect())) == sorted(map(tuple, got))


def test_pages_of_the_table(spark, sf):
    from html import unescape

    got = {r["page_id"]: r["text"] for r in html.extract(table(spark, sf, "pages")).collect()}
    for r in table(spark, sf, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert got[r["page_id"]] == " ".join(unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inner))).split())


# archives


def test_archives_round_trip(spark, tmp_path):
    rows = [(5, "http://a.com/x", "same"), (3, "http://b.com/", "same"), (9, None, "same"), (1, "http://A.com/b?q=1", "other\r\n\r\nWARC/1.1\r\n"), (2, "bad url [", None), (4, "http://a.com/x", ""), (7, "http://a.com/é", "ü" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 7
    for i, _, h in rows:
        raw = (h or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), 1: ("response", None), 2: ("response", None), 4: ("revisit", 2), 7: ("response", None)}
    large = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages, min_bytes=5).collect()}
    assert set(large.values()) == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (2, "u", "b"), (None, "u", "a"), (None, "v", "c"), (None, None, "c")], "page_id long, url string, html string")
    found = [(r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(twice.withColumns({"first": F.lit("x"), "payload_digest": F.lit("y")})).collect()]
    assert sorted(found, key=str) == [(0, 1, "response", None)] * 2 + [(0, 1, "revisit", 1)] + [(1, 1, "response", None)] * 3 + [(2, 1, "revisit", 1)]


def test_records_are_where_the_index_says(spark, tmp_path, sf):
    pages = table(spark, sf, "pages")
    warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=4_000)
    index = warc.read_index(spark, str(tmp_path / "w")).collect()
    keys = [(r["url_key"], r["ts"], r["page_id"]) for r in index]
    assert keys == sorted(keys) and len(keys) == pages.count()
    files = {f.rsplit("/", 1)[1]: f for f in glob(str(tmp_path / "w/part-*"))}
    assert len(files) > 10 and all(len(open(f, "rb").read()) < 8_000 for f in files.values())
    htmls, ids = {r["page_id"]: r["html"].encode() for r in pages.collect()}, set()
    for r in index:
        with open(files[r["archive"]], "rb") as f:  # a reader that knows the index seeks to the record
            f.seek(r["offset"])
            record = gzip.decompress(f.read(r["length"]))
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and b"\r\nContent-Type: application/http; msgtype=response\r\n" in record
        ids.add(record.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0])
        if r["record_type"] == "response":
            assert record.endswith(b"\r\n\r\n" + htmls[r["page_id"]] + b"\r\n\r\n")
    assert len(ids) == len(index)
    for f in files.values():  # any reader of gzip files sees the records in turn, the archive's own first
        assert gzip.open(f).read().startswith(b"WARC/1.1\r\nWARC-Record-ID: <urn:uuid:") and b"WARC-Type: warcinfo" in gzip.open(f).read(200)


def test_index_over_many_ranges(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 10)
    warc.write_archives(table(spark, sf, "pages"), str(tmp_path / "w"), archive_bytes=5_000)
    merged = warc.read_index(spark, str(tmp_path / "w"))
    keys = [(r["url_key"], r["ts"], r["page_id"]) for r in merged.collect()]
    assert merged.rdd.getNumPartitions() > 3 and keys == sorted(keys)


def test_loser_tree():
    rng = random.Random(0)
    for k in range(0, 12):
        runs = [sorted(rng.choices(range(50), k=rng.randrange(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


# conversations


def test_calls_by_hand(spark):
    schemas = {"add": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"}}, "required": ["a"], "additionalProperties": False}}
    calls = [(1, "c", 2, "add", '{"b": 2.5, "a": 1}', "b"), (1, "b", 1, "add", '{"a": -1}', "a"), (1, "a", 0, "add", '{"a": "x"}', None), (1, "a", 5, "add", '{"a": 7}', None), (1, "d", 3, "sub", "{}", "gone"), (1, "e", 4, "add", "no", None), (1, "f", 6, "add", None, "g"), (1, "g", 7, "add", '{"a": 1, "z": 1}', "f"), (2, "a", 0, "add", '{"a": true}', None), (None, "a", 0, "add", "{}", None), (1, None, 0, "add", "{}", None)]
    results = [(1, "a", 1, "ré"), (1, "a", 9, "late"), (1, "zzz", 1, "lost"), (2, "a", 1, None)]
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link_calls(spark.createDataFrame(calls, "conv_id long, call_id string, pos long, name string, arguments string, after string"), spark.createDataFrame(results, "conv_id long, call_id string, pos long, content string"), schemas).collect()}
    assert {k: r["step"] for k, r in got.items()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 0, (1, "e"): 0, (1, "f"): -1, (1, "g"): -1, (2, "a"): 0}
    assert {k for k, r in got.items() if r["valid"]} == {(1, "c")} and {k for k, r in got.items() if r["linked"]} == {(1, "a"), (2, "a")}
    assert got[1, "c"]["json"] == '{"arguments":{"a":1,"b":2.5},"id":"c","name":"add","result":null,"step":2}'
    assert json.loads(got[1, "a"]["json"])["result"] == "ré" and "é" in got[1, "a"]["json"]
    assert (got[1, "b"]["error"], got[1, "d"]["error"], got[1, "e"]["error"], got[1, "g"]["error"]) == ("$.a: out of range", "no such tool", "arguments are no JSON", "$.z: not known")


def test_long_chain(spark):
    calls = spark.range(300).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("string").alias("call_id"), (F.col("id") - 1).cast("string").alias("after"))
    assert {int(r["call_id"]): r["step"] for r in chat.steps(calls).collect()} == {i: i for i in range(300)}


def brute_steps(calls):
    """Longest chains by settling one call after the other."""
    ups = {(c, i): {(c, u) for u in after} for c, i, after in calls}
    ups = {k: {u for u in v if u in ups} for k, v in ups.items()}
    level = {}
    while ready := [k for k, v in ups.items() if k not in level and all(u in level for u in v)]:
        level.update({k: max((level[u] + 1 for u in ups[k]), default=0) for k in ready})
    return {k: level.get(k, -1) for k in ups}


def test_calls_with_several_predecessors(spark):
    rng = random.Random(2)
    calls = []
    for conv in range(8):
        for i in range(40):
            after = [str(rng.randrange(0, i)) for _ in range(rng.randrange(0, 4))] if i else []
            if conv == 3 and i % 9 == 0:
                after.append(str(i + 1))  # some go in circles, others wait for them
            calls.append((conv, str(i), [*after, *after[:1], "gone"][: rng.randrange(0, 6)]))
    got = {(r["conv_id"], r["call_id"]): r["step"] for r in chat.steps(spark.createDataFrame(calls, "conv_id long, call_id string, after array<string>")).collect()}
    want = brute_steps(calls)
    assert got == want and -1 in want.values() and max(want.values()) > 5


def test_conversations_odd_cases(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s", 1), (1, 1, "user", None, 1), (1, 2, "assistant", "x", 1), (1, 3, "user", "", 1), (1, 3, "user", "", 1), (2, 1, "assistant", "y", 1), (None, 0, "user", "q", 1), (2, None, "assistant", "z", 1), (2, 7, None, None, 1), (1, 0, "system", "s", 1)], "conv_id long, turn long, role string, text string, step int")
    found = chat.format_conversations(turns).collect()
    got = {(r["conv_id"], r["pos"]): (r["step"], r["linked"], r["valid"]) for r in found if r["call_id"]}
    assert got == {(1, 1): (0, True, False), (1, 3): (1, False, False)}
    messages = sorted([(r["conv_id"], r["pos"], r["valid"], r["json"]) for r in found if not r["call_id"]], key=str)
    said = lambda role, text: chat.canonical({"content": text, "role": role})
    assert messages == sorted([(1, 0, True, said("system", "s"))] * 2 + [(2, 1, True, said("assistant", "y")), (None, 0, True, said("user", "q")), (2, None, True, said("assistant", "z")), (2, 7, False, said(None, None))], key=str)
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_every_turn_is_in_the_result(spark, sf):
    turns = table(spark, sf, "conversations").collect()
    found = chat.format_conversations(table(spark, sf, "conversations")).collect()
    assert len(found) + sum(r["linked"] for r in found) == len(turns)
    assert {"system"} <= {json.loads(r["json"]).get("role") for r in found}


# vectors


def brute_links(rows, threshold=0.93):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            (i, v, x), (j, w, y) = good[a], good[b]
            if x == y and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                links.append((i, j))
    return links


def planted(n=400, d=12):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(20):
        base = rng.normal(size=d)
        for _ in range(n // 20):
            rows.append((len(rows), (base + rng.normal(size=d) * rng.choice([0.0, 0.1, 0.3, 0.6])).tolist(), c % 3))
    rows += [(len(rows) + i, x, 1) for i, x in enumerate([None, [], [0.0] * d, [float("nan")] * d, [None] * d, [1.0] * 3, [2.0] * 3])]
    return rows + [(900, rows[5][1], None), (None, rows[5][1], 0)]


@pytest.mark.parametrize(("cell", "block"), [(2048, 2048), (20, 16)])
def test_links_are_those_of_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embdedup, "CELL_ROWS", cell)
    monkeypatch.setattr(embdedup, "BLOCK_ROWS", block)
    rows = planted()
    links = brute_links(rows)
    ids = [r[0] for r in rows if r[0] is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    n = {i: 0 for i in ids}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None} == {i: (n[i], find(i), find(i) == i) for i in ids}
    assert max(n.values()) > 3


@pytest.mark.parametrize("block", [32 << 20, 12 * 8 * 30])
def test_vectors_without_structure_are_joined_as_a_triangle(spark, monkeypatch, block):
    monkeypatch.setattr(embdedup, "CELL_ROWS", 20)
    monkeypatch.setattr(embdedup, "BLOCK_BYTES", block)
    asked, real = [], embdedup._triangles
    monkeypatch.setattr(embdedup, "_triangles", lambda *a: asked.append(real(*a)) or asked[-1])
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).tolist(), i % 2) for i in range(200)]
    rows += [(200 + i, (np.array(rows[i % 50][1]) * 2 + rng.normal(size=12) * 0.2).tolist(), (i % 50) % 2) for i in range(150)] + [(350 + i, rows[3][1], 1) for i in range(5)]
    n = {i: 0 for i, *_ in rows}
    for a, b in brute_links(rows):
        n[a] += 1
        n[b] += 1
    got = embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert asked[0] and {r["vec_id"]: r["n_links"] for r in got} == n and max(n.values()) > 5
    small = {r["vec_id"]: r["component_id"] for r in got}
    assert all(small[a] == small[b] for a, b in brute_links(rows))


def test_vectors_odd_cases(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert embdedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    zeros = embdedup.near_duplicates(spark.createDataFrame([(1, [1.0, -0.0], 0), (2, [1.0, 0.0], 0)], kind).selectExpr("*", "1 as h1", "2 as rep", "3 as n")).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in zeros} == {(1, 1, 1), (2, 1, 1)}
    twice = embdedup.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0)], kind)).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in twice} == {(1, 2, 1), (2, 2, 1)}


# queries and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toArrow(), con.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    rows = lambda t: sorted(zip(*[map(repr, t.column(c).to_pylist()) for c in sorted(t.column_names)]))
    assert sorted(got.column_names) == sorted(want.column_names) and rows(got) == rows(want)


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}


CLASHING = ["row", "score", "lang_pred", "fit", "toxic", "p_toxic", "_p_toxic", "_row"]


def test_pipeline_stages_keep_columns_and_clean_rows(spark, sf):
    """Whatever further columns are called, they are kept as they are, and no clean row goes for its language."""
    docs = table(spark, sf, "documents")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in CLASHING])
    dirty = docs.limit(1).select(F.lit(10_001).cast("long").alias("doc_id"), F.lit("### 123").alias("text"), *docs.columns[2:])
    given = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs.unionByName(dirty), sf)
        assert kept.columns == docs.columns, name
        rows = [tuple(r) for r in kept.collect()]
        assert len(rows) > 100 and {r for r in rows if r[0] != 10_001} <= given, name
        if name == "language":
            assert kept.count() == docs.count()


def test_language_stage_drops_what_no_language_fits(spark):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents")
    odd = ["qzx xkcd zzz wvw qqx", "これは日本語の文章です。今日は天気がいいですね。", "x" * 400, "Привет мир, как твои дела сегодня?"]
    more = spark.createDataFrame([(20_000 + i, t, None, "s", 1) for i, t in enumerate(odd)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.keep_known_language(spark, docs.unionByName(more), sf).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}


def test_stages_on_rows_without_an_id_and_repeated_rows(spark, sf):
    words = [f"word{k}" for k in range(300)]
    rng = random.Random(4)
    text = [" ".join(rng.choices(words, k=80)) for _ in range(4)]
    item = table(spark, sf, "benchmark").filter("length(text) > 200").first()["text"]
    rows = [(1, text[0]), (1, text[0]), (1, text[1]), (None, text[1]), (None, text[2]), (None, text[2]), (None, item), (5, item), (6, None), (7, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], table(spark, sf, "documents").schema)
    shown = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert shown(corpus_pipeline.drop_near_duplicates(spark, docs, sf)) == sorted([(1, text[0]), (1, text[1]), (None, text[2]), (5, item), (6, None)], key=str)
    assert shown(corpus_pipeline.drop_contaminated(spark, docs, sf)) == sorted([x for x in rows if x[1] != item], key=str)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        assert stage(spark, docs, sf).count() >= 0, name


def brute_similar(text):
    """Two fingerprints of the words, and the set of five-word shingles."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    if not w:
        return 0, 0, frozenset()
    weights = {xxhash.xxh3_128_intdigest(x.encode()): len(f"{w.count(x):b}") for x in set(w)}
    both = sum(1 << b for b in range(128) if 2 * sum(n for h, n in weights.items() if h >> b & 1) > sum(weights.values()))
    return both >> 64, both & (1 << 64) - 1, frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_linked(p, q):
    """Word fingerprints within 7 bits, and a cosine of the shingles of 0.8 or more, in integers."""
    near = (p[0] ^ q[0]).bit_count() <= 7 or (p[1] ^ q[1]).bit_count() <= 7
    return p[2] == q[2] or (near and 25 * len(p[2] & q[2]) ** 2 >= 16 * len(p[2]) * len(q[2]) > 0)


def brute_first(rows):
    """Of each group of similar texts the smallest id, by all pairs."""
    from tests.llm.test_text_operators import brute_components

    prints = {d: brute_similar(t) for d, t in rows.items()}
    ids = sorted(prints)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if brute_linked(prints[a], prints[b])]
    comp = brute_components(ids, linked)
    return {d for d in ids if comp[d] == d}


def test_pipeline_is_its_stages_by_brute_force(spark, sf):
    from tests.llm.test_text_operators import brute_contamination, brute_language

    docs = table(spark, sf, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, table(spark, sf, "labels")).filter("toxic").collect()}
    model = langid.train(docs.filter(langid.learned_from()))
    left = {d: t for d, t in rows.items() if d not in toxic and any(c.isalpha() for c in t or "") and brute_language(t, model)[2] >= -2}
    first = brute_first(left)
    assert len(first) < len(left)
    left = {d: t for d, t in left.items() if d in first}
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    clean = {d for d, *_, bad in brute_contamination(left.items(), items) if not bad}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == clean
    for d in list(clean)[:50]:
        assert sorted(r["length"] for r in got if r["doc_id"] == d)[::-1] == packing.piece_lengths(next(r["doc_tokens"] for r in got if r["doc_id"] == d))
