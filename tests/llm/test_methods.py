"""The operators against brute force on small inputs, and the models on held-out rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import tidemark.llm.decontaminate as D
import tidemark.llm.jaccard_join as J
import tidemark.llm.substring_dedup as S
import tidemark.llm.suffix_array as A
from tidemark.llm import html_text, langid, secrets, toxicity
from tidemark.llm.components import components
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.html_text import main_text, smooth
from tidemark.llm.registry import ORACLE, QUERIES
from tidemark.llm.sentencepiece_codec import Codec, Pieces
from tidemark.llm.suffix_array import common_prefixes, induced_suffix_array
from tidemark.llm.toxicity import CLEAN, TOXIC, label_model

DATA, MODEL = "/root/testdata/sf0.001", "/opt/tokenizers/piece_bpe_32k.model"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())


def noisy_copies(n, seed, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(2, words))] for _ in range(6)]
    out = []
    for _ in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        out.append(" ".join(t))
    return out


def brute_components(docs, size=3, least=90):
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = defaultdict(list)
    for i in sorted(docs):
        for j, k in Counter(j for s in sets[i] for j in owners[s]).items():
            if 100 * k >= least * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            owners[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in docs}


@pytest.mark.parametrize("block, crowd, size, least", [(8192, 64, 3, 90), (7, 2, 3, 90), (3, 64, 5, 80)])
def test_jaccard_equals_brute_force(spark, texts, monkeypatch, block, crowd, size, least):
    """Blocks of 7 and 3 sets: nearly all places are hot, and their sets meet by other parts."""
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "CROWD", crowd)
    docs = dict(enumerate(noisy_copies(300, 4))) | {1000 + i: t for i, t in texts.items()}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, size=size, num=least).collect()} == brute_components(docs, size, least)


def test_sets_that_share_boilerplate_meet_elsewhere(spark, monkeypatch):
    """Two hundred texts that are half one passage, each with a near copy: the shared places are left, the copies found, and few pairs tried."""
    monkeypatch.setattr(J, "BLOCK", 4)
    rng, passage = random.Random(6), " ".join(f"p{j}" for j in range(120))
    docs = {}
    for i in range(200):
        own = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        docs[2 * i], docs[2 * i + 1] = f"{passage} {' '.join(own)}", f"{passage} {' '.join(own[:-2])} x y"
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    tried, whole = [], J.Join.verified
    monkeypatch.setattr(J.Join, "verified", lambda self, pairs: tried.append(pairs.count()) or whole(self, pairs))
    assert {r.doc_id: r.component_id for r in J.jaccard_components(df).collect()} == {i: i - i % 2 for i in docs}
    stars, trees, moved_stars, moved_trees = tried  # one pair a set and place, then only what the bounds let pass
    assert stars < 40 * len(docs) and moved_stars < 40 * len(docs) and trees + moved_trees < len(docs)


def test_tree_finds_all_pairs_of_the_bound():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 3, (5, J.GROUPS))
    points = (base[rng.integers(0, 5, 400)] + (rng.random((400, J.GROUPS)) < 0.02)).astype(np.uint16)
    n, comp = points.sum(1).astype(int), rng.integers(0, 90, 400)
    got = {tuple(sorted(p)) for a, b in J.tree_pairs(points, n, comp, np.zeros(400, int), 90, 100) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if comp[i] != comp[j] and np.minimum(points[i], points[j]).sum() >= J.enough(int(n[i]), int(n[j]), 90, 100) and 100 * min(n[i], n[j]) >= 90 * max(n[i], n[j])}
    assert got == want and want


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(2)
    for n in (9, 10, 14, 15, 16, 60, 400, 3000):
        a = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        for drop in range(0, n // 10 + 2):
            b = np.sort(np.concatenate((a[drop:], rng.integers(0, 2**63, drop // 2).astype(np.uint64))))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 90 * (len(a) + len(b) - shared):
                owner, part = J.parts_of(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]), 90, 100)
                assert set(part[owner == 0]) & set(part[owner == 1]), (n, drop)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    want = {}
    for s in sorted(near):
        if s not in want:
            todo = [s]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = s
                    todo += near[x]
    assert got == want


def brute_removal(docs):
    seen, out = set(), {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 99):
            w = b[s:s + 100]
            if w in seen:
                gone[s] += 1
                gone[min(s + 100, len(b))] -= 1
            seen.add(w)
        cover = np.cumsum(gone)[:len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        out[i] = (len(b), int(cover.sum()), int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot, wide", [(20_000, 8), (1, 8), (20_000, 1), (20_000, 2), (1, 1)])
def test_substrings_equal_brute_force(spark, texts, monkeypatch, hot, wide):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "WIDE", wide)
    rng = random.Random(9)
    docs = {i: t for i, t in texts.items() if i < 80} | {500 + i: "".join(rng.choice("ab") for _ in range(rng.randint(0, 400))) + "é" * rng.randint(0, 90) for i in range(20)}
    docs |= {600: "ab" * 300, 601: "x" + "ab" * 200, 602: docs[3] + docs[5], 603: docs[5][7:] + docs[3]}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedup_substrings(df).collect()} == brute_removal(docs)


def test_suffix_array_and_prefixes(monkeypatch):
    rng = random.Random(3)
    for size in [*range(40), 3000, 9000]:
        a = rng.choice([1, 2, 3, 200, 5000]) if size < 3000 else 2
        t = np.array([rng.randint(1, a) for _ in range(size)] + [0], np.int16)
        monkeypatch.setattr(A, "BUCKET_COST", 10**9)  # suffix by suffix
        sa, raw = induced_suffix_array(t), t.tolist()
        monkeypatch.setattr(A, "BUCKET_COST", 0)  # by buckets
        assert induced_suffix_array(t).tolist() == sa.tolist()
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert sa.tolist() == want
        shared = common_prefixes(t.astype(np.uint8), sa, 100)
        for x, y in zip(want[:200], want[1:200], strict=False):
            k = 0
            while k < 100 and x + k < len(raw) and y + k < len(raw) and raw[x + k] == raw[y + k]:
                k += 1
            assert shared[y] == k


def test_exact_dedup_with_heavy_digests_and_colliding_ones(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 6 + ["warm", "cold", f"own {i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    group = defaultdict(list)
    for i, t in rows:
        group[t].append(i)
    want = {i: (max(group[t]), len(group[t])) for i, t in rows}
    for digest in (lambda t: F.sha2(t.cast("binary"), 256), lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)):
        for broadcast_rows in (1000, 0):  # 0: the heavy digests are joined by lanes
            got = exact_dedup(df, rows_per_salt=10, digest=digest, broadcast_rows=broadcast_rows).collect()
            assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want and all(r.kept == (r.doc_id == r.keep_id) for r in got)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, cur.fetchall()))


def test_decontamination_spans_point_into_the_original(spark, texts):
    items = duckdb.connect().execute(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench).filter("contaminated").collect()
    assert got
    for r in got:
        said = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id][r.spans[0].start:r.spans[0].end].translate(FOLD)))
        assert any(said[:40] in " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(FOLD))) for _, t in items)


def test_sentencepiece_equals_the_library(texts):
    rng = random.Random(1)
    odd = [" a  b", "", " ", "x ", "hello\nworld  \t", "日本 \x00 ﬁ²", "a" * 50, " " * 37, "aaaa bbb " * 5, "   lead", "é" * 9, "x" * 3000 + " y", "\x00"]
    odd += ["".join(rng.choice("ab thenigo  \n日éX1.") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    rows = odd + list(texts.values())[:100]
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), Codec(Pieces(MODEL))
    ids, n = codec.encode(rows)
    cuts = np.concatenate(([0], np.cumsum(n)))
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == sp.encode(rows)
    assert codec.decode(ids, n) == rows
    codec.keep = 10  # a memory that is emptied all the time gives the same
    assert np.array_equal(codec.encode(rows)[0], ids) and np.array_equal(codec.encode(rows)[0], ids)


def hand_made_model(tmp_path, change):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    change(m)
    path = tmp_path / "own.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_sentencepiece_with_long_pieces_and_many_characters(tmp_path):
    def change(m):
        low, have = min(x.score for x in m.pieces), {x.piece for x in m.pieces}
        word = "▁abcdefghijklmnopqrstuvwxyzabcdefghij"
        for k, piece in enumerate([*map(chr, range(0x4E00, 0x4E00 + 3000)), *(word[:k] for k in range(2, len(word) + 1))]):
            if piece not in have:
                m.pieces.add(piece=piece, score=low - 1 - k, type=1)

    path = hand_made_model(tmp_path, change)
    sp, pieces = sentencepiece.SentencePieceProcessor(model_file=path), Pieces(path)
    rows = ["abcdefghijklmnopqrstuvwxyzabcdefghij abcdefghijklmnopqrstuvwxyzabcde x", "丁" * 5 + "七万丈 三上下 abcdefghijklmnopqrstu", "plain words, too"]
    ids, n = Codec(pieces).encode(rows)
    cuts = np.concatenate(([0], np.cumsum(n)))
    assert pieces.n_codes > 4096 and pieces.widths[-1] >= 37 and n[0] == 3
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == sp.encode(rows)


@pytest.mark.parametrize("change", [lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.trainer_spec, "byte_fallback", False), lambda m: setattr(m.normalizer_spec, "name", "nmt_nfkc"),
                                    lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.pieces[400], "piece", "a▁b"), lambda m: setattr(m.pieces[400], "type", 4)])
def test_sentencepiece_refuses_models_it_would_get_wrong(tmp_path, change):
    with pytest.raises(ValueError, match="can't be used"):
        Pieces(hand_made_model(tmp_path, change))


def test_codecs_are_kept_by_model():
    from types import SimpleNamespace

    import tidemark.llm.sentencepiece_codec as C

    one = SimpleNamespace(value=Pieces(MODEL))
    other = SimpleNamespace(value=Pieces(MODEL))
    assert C._codec(one) is C._codec(other)  # a new broadcast of the same model
    first = C._codec(one)
    other.value.digest = "another model of the same size"
    assert C._codec(other) is not first and C._codec(other).p is other.value


def test_items_longer_than_a_block_lie_in_several(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 3)
    rng = random.Random(8)
    items = {1: " ".join(f"a{rng.randrange(40)}" for _ in range(400)), 2: "Short one", 3: "", 4: " ".join(f"b{i}" for i in range(12))}
    docs = {i: " ".join(items[1].split()[i * 7:i * 7 + 9 + i % 5]) + (" x SHORT, one y" if i % 3 == 0 else " z") for i in range(30)} | {99: items[4] + " " + items[1], 100: None}
    df, bench = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    want = {}
    for i, t in docs.items():
        w, hit, found = words(t), set(), set()
        for k, item in items.items():
            v = words(item)
            for win in {tuple(v[j:j + 10]) for j in range(max(1, len(v) - 9))} if v else ():
                for j in range(len(w) - len(win) + 1):
                    if tuple(w[j:j + len(win)]) == win:
                        hit |= set(range(j, j + len(win)))
                        found.add(str(k))
        want[i] = (len(w), len(hit), sorted(found))
    assert {len(x[2]) for x in want.values()} >= {0, 1, 2}
    for nodes in (2_000, 6_000_000):
        assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate(df, bench, block_nodes=nodes).collect()} == want


def test_gradients_of_the_network():
    rng = np.random.default_rng(3)
    p = {n: a.astype(np.float64) * 2 for n, a in langid.init(3, 4, rng).items()}
    x, y = rng.integers(0, 5, (7, 6)), np.array([0, 1, 2, 0, 1, 2])
    _, g = langid.loss_and_gradients(p, x, y)
    for name, a in p.items():
        for at in [tuple(rng.integers(0, k) if n else k - 1 for n, k in enumerate(a.shape)) for _ in range(6)] if name[0] != "e" else [(int(b), j) for b in (0, 2, 4) for j in (0, 5, 11)]:
            old, e = a[at], 1e-6
            a[at] = old + e
            up, _ = langid.loss_and_gradients(p, x, y)
            a[at] = old - e
            down, _ = langid.loss_and_gradients(p, x, y)
            a[at] = old
            assert abs((up - down) / (2 * e) * 8 - g[name][at]) < 1e-5, (name, at)


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 20, f"l{i % 70:02d}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train, seen = langid.train, []
    try:
        langid.train = lambda windows, k: seen.append((len(windows), k)) or {}
        assert len(langid.fit(df)[0]) == 70 and len(langid.fit(df, most_rows=140)[0]) > 60
    finally:
        langid.train = train
    assert seen[0][1] == 70 and seen[1][0] <= 200


def test_language_on_held_out_rows(spark, texts):
    lang = dict(duckdb.connect().execute(f"SELECT doc_id, lang FROM '{DATA}/documents.parquet'").fetchall())
    got = QUERIES["op9_language_id"](spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    told = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert len(told) > 20 and sum(told) / len(told) > 0.9


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    good = [np.where(rng.random(4000) < np.where(y, 0.6, 0.02), TOXIC, 0) for _ in range(4)]
    none = np.where(rng.random(4000) < np.where(y, 0.1, 0.8), CLEAN, 0)
    votes = np.stack([*good, good[0], none, np.where(rng.random(4000) < np.where(y, 0.95, 0.05), TOXIC, CLEAN)], 1)
    q, table, corr = label_model(votes, np.ones(4000), 0.2)
    assert ((q > 0.5) == y).mean() > 0.97 and abs(table[1, 1, TOXIC] - 0.6) < 0.05 and corr[0, 4] > 0.95 and abs(corr[0, 1]) < 0.1


def test_toxicity_on_held_out_rows(spark):
    labels = dict(duckdb.connect().execute("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").fetchall())
    got = [r for r in QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    score, y = np.array([r.score for r in got]), np.array([labels[r.doc_id] for r in got])
    said = score >= 0.5
    rank = np.argsort(np.argsort(score))
    area = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    assert y.sum() > 50 and said[y == 1].mean() > 0.85 and y[said].mean() > 0.85 and area > 0.95, (said[y == 1].mean(), y[said].mean(), area)


def test_labels_are_no_votes():
    """Words steer, labels don't: with a tenth of the labels wrong, the classifier follows the words."""
    rng = random.Random(2)
    plain = [" ".join(rng.choice(("calm", "river", "stone", "green", "house", "paper")) for _ in range(30)) for _ in range(600)]
    toxic = np.array([i % 4 == 0 for i in range(600)])
    texts = [f"{t} {rng.choice(('scumbag', 'wretch', 'moron'))} {rng.choice(('scumbag', 'wretch', 'moron'))}" if y else t for t, y in zip(plain, toxic, strict=True)]
    given = np.array([int(y) if rng.random() > 0.04 else 1 - int(y) for y in toxic])
    vocabulary, w, b = toxicity.train(texts, given, np.ones(600))
    p = np.full(600, b)
    owner, words = toxicity.distinct_words([t.encode() for t in texts])
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    known = vocabulary[at] == words
    p += np.bincount(owner[known], w[at[known]], 600)
    assert ((p > 0) == toxic).mean() > 0.98


def test_randomness_battery():
    rng = random.Random(4)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(200)]
    assert sum(secrets.randomness(k) < 0.01 for k in keys) < 12
    assert all(secrets.randomness(t) < 1e-3 for t in ("00000000000000000001", "abcabcabcabcabcabcabcabcabcabc12", "aaaaaaaaaaaaaaaabbbbbbbbbbbbbbbb1111", "0123456789abcdef0123456789abcdef0123456789abcdef"))


def test_secret_scan_reports_keys_and_leaves_identifiers(spark):
    """Random keys of every encoding and ordinary identifiers in the texts at hand: most keys, hardly any identifier; without the battery neither is told."""
    texts = [t or "" for t, in duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()] * 4
    rng, keys, names = random.Random(3), set(), "getElementsByTagNameNS2 HttpServletRequestWrapperFactory internationalization_settings /usr/local/share/applications/firefox com/example/project/module/ClassName CONFIGURATION_DIRECTORY_PATH ----------------------".split()
    alphabets = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    for i in range(0, len(texts), 8):
        if i % 16:
            texts[i] += " " + rng.choice(names) + " "
        else:
            key = "".join(rng.choice(alphabets[i // 16 % 4]) for _ in range(48))
            keys.add(key)
            texts[i] += f" {key}. "
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {texts[r.doc_id][s.start:s.end] for r in secrets.find_secrets(df).collect() for s in r.spans if s.kind == "random"}
    assert len(found & keys) > 0.75 * len(keys) and not found & set(names) and len([f for f in found - keys if not f.isdigit()]) < 0.1 * len(keys)
    base = [s for r in secrets.find_secrets(df).collect() for s in r.base]
    assert base and all(0 < s.p_value <= 1 for s in base)


def test_base_spans_equal_a_plain_scan(spark):
    """The fixed patterns over the table, by a scan character after character."""
    rows = duckdb.connect().execute("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()

    def plain(t):
        out, low = [], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        for kind, alphabet, least, prefix in (("access", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20, "AKIA"), ("hex", set("0123456789abcdef"), 24, "")):
            i = 0
            while i < len(t):
                j = i
                if t.startswith(prefix, i):
                    j += len(prefix)
                    while j < len(t) and t[j] in alphabet:
                        j += 1
                if j > i + len(prefix):
                    out += [(i, ("assign", "access", "hex").index(kind), j)] if j - i >= least else []
                    i = j
                else:
                    i += 1
        value, i = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), 0
        while i < len(t):
            for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
                j = i + len(word)
                if low.startswith(word, i):
                    j += j < len(t) and t[j] in "\"'"
                    while j < len(t) and t[j] == " ":
                        j += 1
                    if j < len(t) and t[j] in ":=":
                        j += 1
                        while j < len(t) and t[j] == " ":
                            j += 1
                        j += j < len(t) and t[j] in "\"'"
                        k = j
                        while k < len(t) and t[k] in value:
                            k += 1
                        if k > j:
                            out += [(i, 0, k)] if k - j >= 6 else []
                            i = k - 1
                            break
            i += 1
        return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))

    want = {i: plain(t or "") for i, t in rows}
    assert sum(map(bool, want.values())) > 10
    got = QUERIES["op6_secret_scan"](spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: r.base_sha256 for r in got} == {i: hashlib.sha256(x.encode()).hexdigest() for i, x in want.items()}


def test_candidates_walk_both_lists_once():
    text = " ".join("0123456789abcdef" * 2 for _ in range(20_000))
    began = time.perf_counter()
    base = secrets.base_spans(text)
    assert len(base) == 20_000 and secrets.candidates(text, base) == [] and time.perf_counter() - began < 5
    long = "A" * 3 + "x" * 8 + "0123456789abcdef01234567" + "Z" * 5
    assert [(c["start"], c["end"]) for c in secrets.candidates(long, secrets.base_spans(long))] == [(0, len(long))]  # partly covered: tested whole


def test_base_patterns_keep_failing_matches_from_overlapping():
    assert secrets.base_spans("secret: token: abcdefgh") == [] and secrets.base_spans('api_key = "a1b2c3"') == [(0, 0, 17, "a1b2c3")]
    assert secrets.base_spans("AKIA" + "A" * 15) == [] and secrets.base_spans("ſecret=abcdefgh") == []


def test_main_text():
    page = """<html><head><title>x</title></head><body><header><h1>Site</h1><nav><a>m</a></nav></header><div class="cookie-notice">We use cookies, accept them please, all of them.</div><main><article><header><h1>Title</h1></header>
      <p>Short.</p><p><b>Long</b> paragraph &amp; more of the
      same, with <i>words</i>.<br>next<p>Open<ul><li>one<li>two</ul><div class="ad">buy now</div><table><tr><td>cell</td></tr></table></article><section id="comments"><p>I disagree strongly with all this, dear sir, as I always do.</p></section></main>
      <aside>side</aside><form><label>Name</label></form><script>var a = "<p>";</script><footer>(c)</footer></body></html>"""
    assert main_text(page) == "Title\n\nShort.\n\nLong paragraph & more of the same, with words. next\n\nOpen\n\none\n\ntwo\n\ncell"
    plain = "<body><ul>" + "".join(f"<li><a href='{i}'>go</a></li>" for i in range(9)) + "</ul><div><p>" + "A sentence of plain text that goes on. " * 9 + "</p><p>" + "Another one. " * 20 + "</p></div></body>"
    assert main_text(plain).startswith("A sentence") and "go\n" not in main_text(plain)
    assert np.allclose(smooth(np.ones(7)), 1)


LINE = "A sentence of plain text that goes on and on for a while. "


def said(html):
    return main_text(html).replace(LINE.strip(), "S").split("\n\n")


def test_clusters_decide_what_names_leave_open(monkeypatch):
    """Names that only resemble a mark, lists of links within an article, teasers in article elements: the ratio decides each."""
    article = ("<article><h1>T</h1><p>" + LINE * 5 + "</p><div class='related-work'><p>" + LINE * 4 + "</p></div><p class='notice-period'>" + LINE * 3 + "</p><div class='related-links'><a href=x>one thing</a> <a href=y>two</a></div>"
               "<ul><li><a href=1>Read more</a></li><li><a href=2>And this</a></li></ul><p>" + LINE * 4 + "</p><ul><li>point</li><li>other</li></ul></article>")
    assert said(article) == ["T", "S S S S S", "S S S S", "S S S", "S S S S", "point", "other"]
    teasers = "<body><article class='teaser'><a href=1>Go there</a></article><article><a href=2>Look here</a></article><div><p>" + LINE * 9 + "</p><p>" + LINE * 8 + "</p></div><div class='x'><a href=1>one</a><a href=2>two</a></div></body>"
    assert said(teasers) == ["S S S S S S S S S", "S S S S S S S S"]
    plain = "<body><div id=top><a href=1>Home</a> <a href=2>News</a></div><div class='comments'><p>" + LINE * 9 + "</p></div><div><p>" + LINE * 6 + "</p><ul><li>item</li></ul></div></body>"
    assert said(plain) == ["S S S S S S", "item"]
    monkeypatch.setattr(html_text, "smooth", lambda x: np.zeros(len(x)))  # without the ratio each of them comes out differently
    assert said(article) == [""] or "Read more" in said(article)
    assert "Look here" in said(teasers) and "one" in " ".join(said(plain)) or "Home News" in said(plain)


def test_pages_equal_a_plain_reading(spark):
    """The pages at hand have one article each: its blocks, read by regular expressions."""
    import html as h

    for r in QUERIES["op3_html_text"](spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", r.html or "", flags=re.S)
        body = "".join(re.findall(r"<article\b[^>]*>(.*?)</article>", body, flags=re.S))
        blocks = (" ".join(h.unescape(re.sub(r"</?b>", "", re.sub(r"<br/?>", " ", x))).split()) for x in re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|table|tr|td|th|blockquote|section|pre)\b[^>]*>", body))
        assert r.text == "\n\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


def test_pipeline(spark, texts):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "exact", "near", "decontaminate", "sentencepiece"]
    kept = P.language(spark, docs, DATA)
    assert kept.columns == docs.columns
    have = {r.doc_id: r.text for r in kept.collect()}
    last = {}
    for i in sorted(have):
        last[have[i]] = i
    unique = {i: have[i] for i in last.values()}
    near = {i: t for i, t in unique.items() if brute_components(unique, 5, 80)[i][1] == i} if len(unique) < 60 else {i: unique[i] for i, (_, c) in brute_components(unique, 5, 80).items() if c == i}
    items = [t for _, t in duckdb.connect().execute(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()]
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(FOLD))
    windows = {" ".join(w[i:i + 10]) for w in map(norm, items) for i in range(max(1, len(w) - 9)) if w}
    clean = {i for i, t in near.items() if not any(f" {w} " in f" {' '.join(norm(t))} " for w in windows)}
    got = P.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == clean and all(r.round_trip for r in got)


def test_pipeline_stages_with_null_and_repeated_ids(spark, texts):
    import corpus_pipeline as P

    def stage(name, rows):
        df = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], base.schema).repartition(3)
        out = dict(P.STAGES)[name](spark, df, DATA)
        assert out.columns == df.columns
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    have = [(r.doc_id, r.text, r.lang) for r in base.collect()]
    i, text, lang = next(r for r in have if r[2] == "en" and len(r[1]) > 500)
    got = stage("language", [*have, (None, text, lang), (None, "12 34", lang), (i, "56 78", lang)])
    assert (None, text) in got and got.count((i, text)) == 1 and (None, "12 34") not in got and (i, "56 78") not in got

    rows = [(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, "a"), (2, "c"), (2, "c"), (3, "d"), (None, "d")]
    assert stage("exact", [(i, t, "en") for i, t in rows]) == sorted([(None, "b"), (2, "a"), (2, "c"), (3, "d")], key=str)

    words = [[f"{k}w{j}" for j in range(100)] for k in "abcde"]
    a, b, c, d, e = map(" ".join, words)
    tail = " more"
    rows = [(1, a), (1, a), (1, b), (None, c), (None, c + tail), (None, d), (7, d + tail), (6, d), (9, e), (9, e + tail), (8, ""), (None, "")]
    got = stage("near", [(i, t, "en") for i, t in rows])
    assert len(got) == 7 and {x for x in got if x[1][:1] in "abd"} == {(1, a), (1, b), (6, d), (8, ""), (None, "")} and sum(x[1][:1] == "c" for x in got) == sum(x[1][:1] == "e" for x in got) == 1
    assert got.count((8, "")) == got.count((None, "")) == 1 and got.count((1, a)) == 1

    item = next(r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len((r.text or "").split()) > 10)
    rows = [(1, a), (1, item), (None, b), (None, item), (2, a), (2, a)]
    assert stage("decontaminate", [(i, t, "en") for i, t in rows]) == sorted([(1, a), (None, b), (2, a), (2, a)], key=str)
