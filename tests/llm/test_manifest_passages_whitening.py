"""Merkle manifest, repeated passages and whitening against brute force, with their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidemark.llm.merkle as M
import tidemark.llm.passages as P
from tidemark.llm.whitening import clusters, refine, whiten
from tidemark.llm.merkle import manifest
from tidemark.llm.passages import dedup_passages
from tidemark.llm.registry import QUERIES

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("id", "key", "check", "grp", "n", "hash", "pos", "place", "leaf", "root", "x", "seed", "found", "own", "more", "component")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(hashes):
    """Root and, for every leaf, its siblings with True for one on the right (None for a level without)."""
    ways, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, p in enumerate(at):
            q = p ^ 1
            ways[i].append((level[q], q > p) if q < len(level) else None)
        level, at = [H(*level[i:i + 2]) for i in range(0, len(level), 2)], [p // 2 for p in at]
    return level[0], ways


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[b"" if r[2] is None else b"g" + r[2].encode()].append(r)
    subs, low = [], []
    for g in sorted(groups):
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, ways = climb([leaf(r) for r in own])
        subs.append(root)
        low.append(list(zip(own, ways, strict=True)))
    root, high = climb(subs)
    out = []
    for sub, members, up in zip(subs, low, high, strict=True):
        for r, way in members:
            way = way + up
            forged = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf((*r[:4], r[4] + 1)) if forged else leaf(r)
            for s in way:
                h = H(h) if s is None else H(h, s[0]) if s[1] else H(s[0], h)
            out.append((r[0], leaf(r), sub, root, H(*[s[0] for s in way if s]), h, h == root))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def leaves():
    rng = random.Random(3)
    rows = [(i, rng.choice(["é" * 3, "", None, "text"]), lang, rng.choice(["s", None]), rng.choice([i, None, 2**63 - 1]))
            for k, lang in enumerate(["en", "de", None, "", "é", "z"] + [f"l{j}" for j in range(12)]) for i in range((500, 17, 16, 3, 1, 2)[k] if k < 6 else 1)]
    rows += [rows[0]] * 3 + [(None, "null id", "en", "s", 1)] * 2 + [(5, "another text of this id", "en", "s", 1)]
    return rows


@pytest.mark.parametrize("few", [0, 2000])
def test_manifest_equals_brute_force(spark, leaves, monkeypatch, few):
    monkeypatch.setattr(M, "FEW_NODES", few)
    monkeypatch.setattr(M, "FEW_ROWS", 16)
    docs = spark.createDataFrame(leaves, DOCS).withColumns({c: F.lit("x") for c in CLASH}).repartition(5)
    forged = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    got = manifest(docs, tampered=("n_chars", forged)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest(leaves)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "t", "en", "s", i) for i in range(n)]
    got = manifest(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == n and all(r.verified and len(r.siblings) % 32 == 0 for r in got)
    assert {r.root for r in got} == ({climb([leaf(r) for r in rows])[0]} if n else set())


def brute_passages(rows, length=35):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[i:i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {k for i in range(len(w) - length + 1) if seen[tuple(w[i:i + length])] > 1 for k in range(i, i + length)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1, 2000])
def test_passages_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(P, "HOT", hot)
    rng = random.Random(5)
    text = lambda n, kinds=400: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
    shared, rows = [text(k) for k in (34, 35, 36, 50, 90)], []
    for i in range(150):
        parts = [text(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), text(rng.choice([0, 1, 7, 30]))]
        rows.append((i, " ".join(parts)))
    base = text(300).split()
    for i in range(40):  # near copies, so that seeds meet with reaches that differ
        w = list(base)
        for _ in range(6):
            w[rng.randrange(300)] = f"x{rng.randrange(3)}"
        rows.append((1000 + i, "\n ".join(w)))
    rows += [(2000, "a " * 300), (2001, "a b " * 60), (2002, text(40, 3)), (2003, "A" + shared[3][1:]), (7, rows[7][1]), (7, "other"), (None, shared[4]), (None, None), (2004, ""), (2005, " \t\n"), (2006, text(60_000, 5000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH})
    got = dedup_passages(docs.repartition(4)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_passages(rows)
    assert dedup_passages(docs.filter("doc_id < 0")).count() == 0


def test_repeated_rows_of_one_id_repeat_each_other(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(50)))] * 2 + [(1, "short one")] * 3
    assert sorted(r.n_removed for r in dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [0, 0, 0, 50, 50]


def test_refinement_of_clustered_eigenvalues():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    for e in (np.linspace(1, 40, 40), np.repeat([9.0, 4, 1, 0], 10), 1 + np.arange(40) * 1e-9, np.concatenate((np.full(20, 5.0), 3 + np.arange(20) * 1e-6)), np.geomspace(1e-8, 1, 40)):
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        values, x = refine(a)
        assert np.all(np.diff(values) <= 1e-15 * abs(e).max()) and np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 4e-15 * abs(e).max()
        assert np.abs(x.T @ x - np.eye(40)).max() < 4e-16 * 4
        assert np.abs(a @ x - x * values).max() < 4e-15 * abs(e).max()
    assert [sorted(c.tolist()) for c in clusters(np.array([5.0, 1.0, 1.1, 5.05, 9]), 0.2)] == [[1, 2], [0, 3]]
    assert refine(np.zeros((3, 3)))[0].tolist() == [0, 0, 0] and refine(np.zeros((0, 0)))[1].shape == (0, 0)


def brute_whitening(x, fit):
    mean = fit.mean(0)
    v = (fit - mean).T @ (fit - mean) / len(fit)
    e, q = np.linalg.eigh(v)
    return (x - mean) @ q[:, ::-1] / np.sqrt(e[::-1]), e[::-1] / np.trace(v)


def test_whitening_equals_brute_force(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    bad = [(9000, None), (9001, [None] * 64), (9002, [float("nan")] + [0.0] * 63), (9003, [float("inf")] * 64)]
    again = [(9100 + i, rows[3][1]) for i in range(200)] + [(None, rows[4][1]), (rows[0][0], rows[5][1])]
    df = spark.createDataFrame(rows + bad + again, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in CLASH})
    got = whiten(df.repartition(5)).collect()
    x = np.floor(256 * np.array([r[1] for r in rows + again], np.float32).astype(float)).astype(int)
    fit = np.unique(x, axis=0)
    assert len(got) == 4 * len(x) and {r.n for r in got} == {len(fit)} and {r.component for r in got} == {1, 2, 3, 4}
    want, share = brute_whitening(x, fit)
    total = fit.sum(0)
    exact = Counter((i, sum((len(fit) * int(v) - int(s)) ** 2 for v, s in zip(row, total, strict=True))) for (i, _), row in zip(rows + again, x, strict=True))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == exact
    one = {r: k for k, (r, _) in enumerate(rows[1:], 1)}
    for c in range(4):
        pairs = [(r.whitened, want[one[r.vec_id], c]) for r in got if r.component == c + 1 and r.vec_id in one]
        sign = np.sign(sum(a * b for a, b in pairs))
        assert max(abs(a - sign * b) for a, b in pairs) < 1e-9
        assert all(abs(r.explained / share[c] - 1) < 1e-10 for r in got if r.component == c + 1)
    assert max(r.identity_error for r in got) < 1e-10 and len({r.identity_error for r in got}) == 1


def test_whitening_of_few_and_odd_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whiten(make([])).count() == 0 and whiten(make([(1, []), (2, None)])).count() == 0
    one = whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, None, 0.0)] * 4
    line = whiten(make([(1, [1.0, 1.0, -0.0]), (2, [-1.0, 1.0, 0.0])])).collect()
    assert sorted((r.component, r.whitened is None) for r in line if r.vec_id == 1) == [(1, False), (2, True), (3, True)]
    assert {abs(r.whitened) for r in line if r.component == 1} == {1.0} and {r.explained for r in line if r.component == 1} == {1.0}
    huge = whiten(make([(1, [3e38]), (2, [-3e38]), (3, [0.0])])).collect()
    assert [r.deviation for r in huge if r.vec_id == 1] == [None] and len(huge) == 3


def test_queries_run(spark):
    for name, columns in (("op11_merkle_manifest", 7), ("op12_substring_dedup", 4), ("op13_embedding_whitening", 7)):
        df = QUERIES[name](spark, DATA)
        assert len(df.columns) == columns and df.count() > 0
