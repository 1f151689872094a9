"""Whitening, manifest and exact duplicates: brute force, planted cases and odd tables."""

import random
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetable.llm import charpoly, exactdedup, merkle, queries, whitening
from wavetable.llm.util import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, salt int, tree string, leaf string, pos long"


def docs_of(spark, rows):
    """rows: (doc_id, text, lang, source, n_chars); the other columns have names that the operators use."""
    return spark.createDataFrame([(*r, "x", 1, "y", None, 0) for r in rows], DOCS)


def odd_rows(n=300, seed=0):
    rng = random.Random(seed)
    texts = [None, "", "a", "A", "\n", "ab\ncd", "Ä", "ä", "Straße\n", "long " * 20_000, "same"]
    rows = [(i, rng.choice(texts) if rng.random() < 0.7 else f"t{i}\n", rng.choice(["en", None, "é"]), rng.choice(["hot", "hot", "hot", None, "", "b", "ü", "z"]), rng.choice([None, i])) for i in range(n)]
    return rows + [rows[5], rows[5], rows[17], (None, "same", "en", "hot", 1), (None, "same", "en", "hot", 1), (None, "only", None, None, None), (2**62, "a", "en", "hot", 0), (-7, "a", "en", "hot", 0)]


# exact duplicates


def brute_duplicates(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(LOWER), []).append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), i == keep, sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_duplicates_by_brute_force(spark, parts):
    rows = odd_rows()
    assert as_rows(exactdedup.exact_duplicates(docs_of(spark, rows).repartition(parts))) == brute_duplicates(rows)


def test_texts_that_share_a_digest_are_told_apart_by_content(spark):
    rows = odd_rows(120)
    weak = lambda text: F.substring(exactdedup.sha256(text), 1, 1)
    assert as_rows(exactdedup.exact_duplicates(docs_of(spark, rows).repartition(5), weak)) == brute_duplicates(rows)
    assert as_rows(exactdedup.exact_duplicates(docs_of(spark, rows).repartition(5), lambda text: F.lit(b"one"))) == brute_duplicates(rows)


def test_one_row_of_each_text_stays(spark):
    rows = odd_rows()
    df = docs_of(spark, rows)
    left = exactdedup.unique_rows(df)
    assert left.columns == df.columns
    texts = [(r["text"] or "").translate(LOWER) for r in left.collect()]
    assert sorted(texts) == sorted({(r[1] or "").translate(LOWER) for r in rows})
    assert exactdedup.exact_duplicates(docs_of(spark, [])).count() == 0 == exactdedup.unique_rows(docs_of(spark, [])).count()


def test_exact_duplicates_stay_in_the_jvm(spark, sf):
    plan = queries.QUERIES["op13_exact_dedup"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# manifest


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(nodes):
    """(root, proof of each node as a list of (before, after))."""
    proofs, owners, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        up, up_owners = [], []
        for i in range(0, len(level), 3):
            run = level[i : i + 3]
            for j, own in enumerate(owners[i : i + 3]):
                for o in own:
                    proofs[o].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H(*run))
            up_owners.append([o for own in owners[i : i + 3] for o in own])
        level, owners = up, up_owners
    return level[0], proofs


def brute_manifest(rows):
    sources = {}
    for doc_id, text, lang, source, n_chars in rows:
        head = part(doc_id) + part(source) + part(lang) + part(n_chars)
        given = None if text is None else text.replace("\n", "")
        tampered = doc_id is not None and crc32(str(doc_id).encode()) % 2 == 0
        leaf = H(head, part(text))
        sources.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, H(head, part(given)) if tampered else leaf))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(sources[s])]) for s in names}
    root, over = brute_tree([trees[s][0] for s in names])
    out = []
    for s, upper in zip(names, over):
        for (known, doc_id, leaf, given), path in zip(sorted(sources[s]), trees[s][1]):
            path = path + upper
            folded = given
            for b, a in path:
                folded = H(b, folded, a)
            out.append((doc_id if known else None, leaf, trees[s][0], root, H(*(b + a for b, a in path)), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("height", "parts"), [(1, 6), (2, 1), (7, 3)])
def test_manifest_by_brute_force(spark, height, parts):
    rows = odd_rows()
    assert as_rows(merkle.manifest(docs_of(spark, rows).repartition(parts), height)) == brute_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, f"t\n{i}", "en", "one", i) for i in range(n)]
    assert as_rows(merkle.manifest(docs_of(spark, rows), 1)) == (brute_manifest(rows) if rows else [])


def test_manifest_of_many_sources(spark):
    rows = [(i, "x", None, f"s{i}", None) for i in range(40)]
    assert as_rows(merkle.manifest(docs_of(spark, rows), 1)) == brute_manifest(rows)


# whitening


def brute_whitening(vectors):
    x = [[int(np.floor(256 * float(c))) for c in v] for _, v in vectors]
    fit = [list(v) for v in {tuple(v) for v in x}]
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array(fit, float) - np.array(s) / n
    cov = a.T @ a / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    dev = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    w = (np.array(x, float) - np.array(s) / n) @ u[:, :4] / np.sqrt(e[:4])
    return n, dev, w, e / e.sum()


def test_whitening_by_brute_force(spark, sf):
    vectors = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    vectors += [(9001, vectors[0][1]), (9002, vectors[0][1])]
    n, dev, w, share = brute_whitening(vectors)
    odd = [(-1, None), (-2, []), (-3, [None] * 64), (-4, [float("nan")] + [0.0] * 63), (-5, [float("inf")] * 64), (-6, [0.5] * 3), (-7, [1e30] * 64)]
    df = spark.createDataFrame([(i, v, 0.0) for i, v in vectors + odd], "vec_id long, embedding array<float>, x double").repartition(5)
    got = whitening.whitening(df).collect()
    assert {r["vec_id"] for r in got} == {i for i, _ in vectors} and len(got) == 4 * len(vectors)
    places = {i: k for k, (i, _) in enumerate(vectors)}
    for c in range(4):
        own = [r for r in got if r["component"] == c + 1]
        ours, theirs = np.array([r["whitened"] for r in own]), np.array([w[places[r["vec_id"]], c] for r in own])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-9
        assert all(r["deviation"] == dev[places[r["vec_id"]]] and r["n"] == n and abs(r["explained"] - share[c]) < 1e-12 for r in own)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    run = lambda rows: whitening.whitening(spark.createDataFrame(rows, kind)).collect()
    assert run([]) == [] == run([(1, None)]) == run([(1, [1.0, 2.0])] * 3)
    line = run([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])  # one component alone
    assert len(line) == 5 and all(r["component"] == 1 and abs(r["explained"] - 1) < 1e-12 for r in line)
    cross = run([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0])])  # the same eigenvalue twice
    assert len(cross) == 8 and cross[0]["identity_error"] < 1e-12
    wide = run([(1, [2.0**53, 0.0]), (2, [-(2.0**53), 2.0**50]), (None, [0.0, 2.0**52])])  # beyond what doubles and longs hold
    assert len(wide) == 6 and all(r["deviation"] is None for r in wide if r["vec_id"]) and wide[0]["identity_error"] < 1e-9


def test_roots_between_exact_bounds():
    for roots in ([7, 5, 5, 2, 0, 0], [1], [10**20, 10**20, 10**20 - 1, 3], [0, 0, 0, 1], [6, 6, 6, 6, 6]):
        c = [1]
        for r in roots:
            c = [-r * a + b for a, b in zip([*c, 0], [0, *c])]
        got = charpoly.largest_roots(c, 4)
        want = sorted((r for r in roots if r), reverse=True)[:4]
        assert len(got) == len(want) and all(abs(g - w) <= Fraction(w, 1 << charpoly.DIGITS) for g, w in zip(got, want))


def test_polynomial_by_modular_reduction():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 6):
        x = rng.integers(-9, 9, (4, d))
        m = (x.T @ x).astype(object)
        found = {p: charpoly.residues((m % p).astype(np.int64), p) for p in charpoly.primes_for(charpoly.coefficient_bound(int(np.trace(m)), d))}
        assert np.allclose([float(c) for c in charpoly.from_residues(found)][::-1], np.poly(m.astype(float)), atol=1e-3)


@pytest.mark.parametrize("name", ["op12_merkle", "op13_exact_dedup"])
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert as_rows(queries.QUERIES[name](spark, sf).select(names)) == sorted(map(tuple, want.fetchall()), key=repr)
