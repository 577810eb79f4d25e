"""Language identification: a bidirectional gated recurrent network over bytes.

Texts are cut into segments of `STEPS` bytes, each a sequence of its own, so that all segments of a batch advance together. Every
byte gets a probability of each language; a document's probabilities are the means over all its bytes. Training is plain
backpropagation through time in numpy on a bounded sample: about `per_lang` windows of `WINDOW` characters for each language, and no more
than `most_rows` windows together (fewer for each, the more languages there are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, held_out, let_go
from .shingles import batch_slices

STEPS, HIDDEN, WINDOW, UNKNOWN, SLICE = 64, 8, 2000, "und", 1_000_000


def init(k: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p["e" + d] = rng.normal(0, 0.3, (256, 3 * hidden))  # input weights of the gates z, r and of the candidate, biases included
        p["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        p["o" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, k))
    return {n: a.astype(np.float32) for n, a in (p | {"c": np.zeros(k)}).items()}


def squash(x: np.ndarray) -> np.ndarray:
    """A rational form of tanh, within 0.024 of it and a third of its cost; in place."""
    np.clip(x, -3, 3, out=x)
    y = x * x
    x *= y + 27
    y *= 9
    y += 27
    x /= y
    return x


def slope(x: np.ndarray) -> np.ndarray:
    """The derivative of squash() at x: 0 where it is clipped."""
    y = np.minimum(x * x, 9)
    return ((y - 9) / (3 * (y + 3))) ** 2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * squash(0.5 * x) + 0.5


def forward(e: np.ndarray, u: np.ndarray, x: np.ndarray, keep: bool = False):
    """States (steps, batch, hidden) of one direction; x is (steps, batch) bytes in the order of that direction."""
    h_size, (steps, batch) = u.shape[0], x.shape
    h, states, saved = np.zeros((batch, h_size), e.dtype), np.empty((steps, batch, h_size), e.dtype), []
    for t in range(steps):
        a, g = e[x[t]], h @ u
        in_zr = a[:, :2 * h_size] + g[:, :2 * h_size]
        zr = sigmoid(in_zr)
        z, r = zr[:, :h_size], zr[:, h_size:]
        in_n = a[:, 2 * h_size:] + r * g[:, 2 * h_size:]
        n = squash(in_n.copy())
        if keep:
            saved.append((h, z, r, n, g[:, 2 * h_size:].copy(), 0.25 * slope(0.5 * in_zr), slope(in_n)))
        h = n + z * (h - n)
        states[t] = h
    return states, saved


def backward(e: np.ndarray, u: np.ndarray, x: np.ndarray, saved: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of e and u by backpropagation through time."""
    de, du, dh = np.zeros_like(e), np.zeros_like(u), np.zeros_like(d_states[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, gn, at_zr, at_n = saved[t]
        k = h.shape[1]
        dh = dh + d_states[t]
        dn = dh * (1 - z) * at_n
        da = np.concatenate((dh * (h - n) * at_zr[:, :k], dn * gn * at_zr[:, k:], dn), 1)
        dg = np.concatenate((da[:, :2 * h.shape[1]], dn * r), 1)
        np.add.at(de, x[t], da)
        du += h.T @ dg
        dh = dh * z + dg @ u.T
    return de, du


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def loss_and_gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over all positions of segments x (steps, batch) of languages y, and 8 times its gradients."""
    hf, sf = forward(p["ef"], p["uf"], x, True)
    hb, sb = forward(p["eb"], p["ub"], x[::-1], True)
    prob = softmax(hf @ p["of"] + hb[::-1] @ p["ob"] + p["c"])
    own = (slice(None), np.arange(len(y)), y)
    loss = float(-np.log(np.maximum(prob[own], 1e-30)).mean())
    prob[own] -= 1
    d = prob / prob[..., 0].size * 8
    g = {"of": np.einsum("tbh,tbk->hk", hf, d), "ob": np.einsum("tbh,tbk->hk", hb[::-1], d), "c": d.sum((0, 1))}
    g["ef"], g["uf"] = backward(p["ef"], p["uf"], x, sf, d @ p["of"].T)
    g["eb"], g["ub"] = backward(p["eb"], p["ub"], x[::-1], sb, (d @ p["ob"].T)[::-1])
    return loss, g


def train(windows: list[tuple[bytes, int]], k: int, hidden: int = HIDDEN, steps: int = 350, batch: int = 128, seed: int = 7) -> dict[str, np.ndarray]:
    """Every byte of a segment is a training position with the language of its document; languages are drawn evenly."""
    rng = np.random.default_rng(seed)
    by_lang = [np.array(rows) for rows in ([np.frombuffer(w[i:i + STEPS].ljust(STEPS), np.uint8) for w, y in windows if y == lang for i in range(0, max(1, len(w) - STEPS // 2), STEPS)] for lang in range(k))]
    p = init(k, hidden, rng)
    m, v = ({n: np.zeros_like(a) for n, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(0, k, batch)
        x = np.stack([by_lang[i][rng.integers(len(by_lang[i]))] for i in y], 1)
        _, g = loss_and_gradients(p, x, y)
        rate = 0.02 * (1 - step / (steps + 1))
        for n in p:
            m[n], v[n] = 0.9 * m[n] + 0.1 * g[n], 0.99 * v[n] + 0.01 * g[n] ** 2
            p[n] = (p[n] - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def states_of(e: np.ndarray, u: np.ndarray, x: np.ndarray) -> np.ndarray:
    """As forward(), without what training keeps, laid out as (steps, hidden, batch): each gate is one block of memory."""
    n = u.shape[0]
    half = np.r_[np.full(2 * n, 0.5), np.ones(n)].astype(np.float32)[:, None]  # sigmoid(x) = squash(x / 2) / 2 + 1 / 2
    e, u = np.ascontiguousarray(e.T) * half, np.ascontiguousarray(u.T) * half
    h, out, g, a = np.zeros((n, x.shape[1]), np.float32), np.empty((len(x), n, x.shape[1]), np.float32), *np.empty((2, 3 * n, x.shape[1]), np.float32)
    for t in range(len(x)):
        np.take(e, x[t], axis=1, out=a, mode="clip")
        np.matmul(u, h, out=g)
        zr, c = a[:2 * n], a[2 * n:]
        zr += g[:2 * n]
        squash(zr)
        zr *= 0.5
        zr += 0.5
        g[2 * n:] *= zr[n:]
        c += g[2 * n:]
        squash(c)
        h -= c
        h *= zr[:n]
        h += c
        out[t] = h
    return out


def label(texts: list[bytes], p: dict[str, np.ndarray], positions: bool = False, batch: int = 2048) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mean probabilities of each text, and with `positions` the most likely language of every byte of each text."""
    k = len(p["c"])
    sums, n_seg = np.zeros((len(texts), k)), np.array([-(-len(t) // STEPS) for t in texts], int)
    owner = np.repeat(np.arange(len(texts)), n_seg)
    raw = np.frombuffer(b"".join(t.ljust(-(-len(t) // STEPS) * STEPS) for t in texts), np.uint8).reshape(-1, STEPS)
    first = np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
    sizes = np.minimum(STEPS, np.array([len(t) for t in texts], int)[owner] - (np.arange(len(raw)) - first) * STEPS) if len(raw) else np.zeros(0, int)
    best, of, ob, c = np.empty(raw.shape if positions else (0, STEPS), np.uint8), p["of"].T.copy(), p["ob"].T.copy(), p["c"][:, None]
    for i in range(0, len(raw), batch):
        x, size = np.ascontiguousarray(raw[i:i + batch].T), sizes[i:i + batch]
        hf, hb = states_of(p["ef"], p["uf"], x), states_of(p["eb"], p["ub"], x[::-1])
        total = np.zeros((k, x.shape[1]), np.float32)
        for t in range(STEPS):
            q = of @ hf[t] + ob @ hb[STEPS - 1 - t] + c
            if positions:
                best[i:i + batch, t] = q.argmax(0)
            np.exp(np.clip(q, -60, 60, out=q), out=q)
            q *= (t < size) / q.sum(0)
            total += q
        np.add.at(sums, owner[i:i + batch], total.T)
    labels = [best[b - n:b].reshape(-1)[:len(t)] for t, n, b in zip(texts, n_seg, np.cumsum(n_seg), strict=True)]
    return sums / np.maximum(1, [[len(t)] for t in texts]), labels


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, most_rows: int = 25_000):
    """(languages, weights) from documents that are not held out and have a language; None without any. Every language that occurs is learned.

    Rows are drawn by a hash of id and text, so the sample is the same in each run; where `most_rows` binds, the rows of least hash stay.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) & (F.length(text_col) > 0))
    counts = known.groupBy(F.col(lang_col).alias("lang")).count().collect()  # one row per language
    if not counts:
        return None
    langs, n = sorted(r["lang"] for r in counts), {r["lang"]: r["count"] for r in counts}
    each = max(1, min(per_lang, most_rows // len(langs)))
    share = F.create_map(*[F.lit(x) for g in langs for x in (g, min(1.0, each / n[g]) * 2**31)])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(2)), F.lit(2**31))
    start = 1 + F.pmod(F.xxhash64(id_col, F.lit(1)), F.greatest(F.length(text_col) - WINDOW, F.lit(1)))
    sample = known.withColumn("_draw", draw).filter(F.col("_draw") < share[F.col(lang_col)])
    sample = sample.select(F.substring(F.col(text_col), start.cast("int"), F.lit(WINDOW)).alias("t"), F.col(lang_col).alias("lang"), "_draw")
    rows = sample.orderBy("_draw", "lang", "t").limit(max(most_rows, len(langs))).collect()
    windows = sorted((r["t"].encode(), langs.index(r["lang"])) for r in rows)
    have = sorted({y for _, y in windows})
    windows = [(w, have.index(y)) for w, y in windows]
    return [langs[y] for y in have], train(windows, len(have))


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", positions: bool = False, with_text: bool = False) -> DataFrame:
    """One row per document: id, lang_pred, score, with `positions` also `labels`, a byte per byte of text (index of its language), and with `with_text` the text.

    A null text, one without any letter, and any text where there is no model is `und` with score 0. Repeated rows keep their
    rows; an empty table gives an empty table; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("told"), F.col(text_col).alias("text"))
    langs, weights = model or ([], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for whole in batches:
            for i, j in batch_slices(whole["text"], SLICE):
                x = whole.slice(i, j - i)
                texts = [t.encode() if told else b"" for t, told in zip(x["text"].to_pylist(), x["told"].to_pylist(), strict=True)] if weights else [b""] * len(x)
                prob, labels = label(texts, weights, positions) if weights else (np.zeros((len(x), 1)), [np.zeros(0, np.uint8)] * len(x))
                best = prob.argmax(1)
                out = {"id": x["id"], "lang_pred": pa.array([langs[b] if t else UNKNOWN for t, b in zip(texts, best, strict=True)], pa.string()),
                       "score": pa.array([float(q[b]) if t else 0.0 for t, q, b in zip(texts, prob, best, strict=True)], pa.float64())}
                out |= {"labels": pa.array([a.tobytes() for a in labels], pa.binary())} if positions else {}
                yield pa.RecordBatch.from_pydict(out | ({"text": x["text"]} if with_text else {}))
        give_back()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double" + ", labels binary" * positions + ", text string" * with_text).withColumnRenamed("id", id_col)
