"""Texts through page differencing, recomputed from pages whose lines are known by construction."""

import random

from wavetable.llm import html

KIND = "page_id long, url string, html string"


def page_of(lines):
    """Blocks in the order given: o outside, m in the article, g in a menu."""
    out = ""
    for where, text in lines:
        block = f"<p>{text}</p>"
        out += {"o": f"<div>{block}</div>", "m": f"<article>{block}</article>", "g": f"<nav>{block}</nav>"}[where]
    return f"<html><body>{out}</body></html>"


def test_a_story_outside_the_main_element_stays(spark):
    story = lambda i: f'<div class="story"><p>Story {i} text</p></div><main><p>Teaser {i}</p></main><div>Contact us</div>'
    rows = [(i, f"http://h.com/a/{i}", story(i)) for i in range(4)]
    got = {r["page_id"]: (r["text"], r["n_shared"]) for r in html.extract(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {i: (f"Story {i} text Teaser {i}", 1) for i in range(4)}
    assert html.main_text(html.lines_of(story(1)), set()) == "Teaser 1"  # by places alone
    alone = html.extract(spark.createDataFrame(rows[:1], KIND)).first()
    assert (alone["text"], alone["n_neighbours"]) == ("Teaser 0", 0)


def test_texts_are_those_of_the_votes_by_brute_force(spark):
    rng = random.Random(3)
    site, rows, known = [f"site line {i}" for i in range(8)], [], {}
    for i in range(60):
        lines = [("o", s) for s in site if rng.random() < 0.55]
        lines += [("m", f"page {i} part {j}") for j in range(rng.randrange(3))] + [("m", "a passage of many pages")] * (rng.random() < 0.5)
        lines += [("o", f"page {i} beside")] * (rng.random() < 0.5) + [("o", "foot")] * (rng.random() < 0.8)
        known[i] = lines
        rows.append((i, f"http://host{i % 3}.org/x/{i:03d}", page_of(lines)))
    order = sorted(known, key=lambda i: (i % 3, i))
    differs = 0
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, KIND).repartition(6)).collect()}
    for at, i in enumerate(order):
        near = []
        for step in (-1, 1):
            k, taken, last = at + step, 0, [t for _, t in known[i]]
            while 0 <= k < len(order) and order[k] % 3 == i % 3 and taken < html.SIDE:
                other = [t for _, t in known[order[k]]]
                assert other != last  # no runs of equal pages here
                near.append(set(other))
                k, taken = k + step, taken + 1
        kept = [t for w, t in known[i] if w == "m" or 2 * sum(t in n for n in near) < len(near)]  # lines are unique and in one order: aligned if on both
        assert got[i]["text"] == " ".join(kept) and got[i]["n_neighbours"] == len(near)
        differs += got[i]["text"] != html.main_text(html.lines_of(page_of(known[i])), set())
    assert differs > 20  # differencing decides


def test_arguments_that_are_no_json(spark):
    from wavetable.llm import chat

    given = ["[" * 100_000, '{"a":1.0,"b":NaN}', '{"a":Infinity}', '{"a":1e999}', '{"a":2.0}', '{"a":2}', '{"a":2.5}', None]
    calls = spark.createDataFrame([(1, i, f"c{i}", "f", g, []) for i, g in enumerate(given)], "conv_id long, pos long, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv_id long, pos long, call_id string, content string")
    schemas = {"f": {"type": "object", "properties": {"a": {"type": "integer"}}}}
    got = {r["pos"]: (r["valid"], r["json"]) for r in chat.link_calls(calls, results, schemas).collect()}
    assert [got[i][0] for i in range(8)] == [False] * 4 + [True, True, False, False]
    assert all('"arguments":null' in got[i][1] for i in (0, 1, 2, 3, 7)) and "NaN" not in got[1][1]


def test_pages_with_ids_beyond_all_years(spark):
    from wavetable.llm import warc

    ids = [0, 5, 2**62, 300_000_000_000, -3, -(2**63), None]
    rows = [(i, "http://h.com/a", f"text {i}") for i in ids]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(map(str, (r["page_id"] for r in got))) == sorted(map(str, ids))
    assert all(len(r["ts"]) == 14 for r in got) and [r["ts"] for r in got] == sorted(r["ts"] for r in got)
