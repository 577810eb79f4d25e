"""Toxicity scores by weak supervision.

Words, and beginnings of words, that go with label 1 in a bounded sample of labelled rows become lexicon and pattern voters, each voting
"toxic" where one stands and abstaining elsewhere; other voters look at the whole text. A generative model with a hidden label, fitted by expectation maximisation,
estimates how each voter behaves under either label, and from what the hidden label leaves unexplained how voters correlate;
correlated voters count for less in a second fit. A linear classifier over words is trained on the posterior labels and scores
every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import held_out
from .decontaminate import FOLD
from .shingles import in_slices, word_hashes

ABSTAIN, TOXIC, CLEAN = 0, 1, 2
LEXICON, FEATURES, SLICE, PREFIXES, KEPT = 100, 200, 1_000_000, (4, 5, 6), 0.3


def distinct_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct words and beginnings of words of each text; words are runs of letters and digits, A-Z folded."""
    words, owner = word_hashes([t.translate(FOLD) for t in texts], PREFIXES)
    order = np.lexsort((words, owner))
    words, owner = words[order], owner[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], words[new]


def association(owner: np.ndarray, words: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their signed log-likelihood ratio statistic with the label, in how many toxic rows they stand, and the share of those."""
    vocabulary, index = np.unique(words, return_inverse=True)
    w = weight * len(weight) / weight.sum()
    t = np.bincount(index, (w * toxic)[owner], len(vocabulary))
    c = np.bincount(index, (w * (1 - toxic))[owner], len(vocabulary))
    n_t, n_c = (w * toxic).sum(), (w * (1 - toxic)).sum()
    both, share = t + c, n_t / (n_t + n_c)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(t > 0, t * np.log(t / (both * share)), 0) + np.where(c > 0, c * np.log(c / (both * (1 - share))), 0))
    return vocabulary, np.where(t / max(n_t, 1e-9) > c / max(n_c, 1e-9), g, -g), np.bincount(index, toxic[owner], len(vocabulary)), t / both


def pattern_votes(texts: list[bytes], hits: np.ndarray) -> np.ndarray:
    """Votes on the whole text: several lexicon words, none, one in a short text, shouting, exclamations, direct address."""
    n = np.array([max(1, t.count(b" ") + 1) for t in texts])
    upper = np.array([sum(map(t.count, (b"A", b"E", b"I", b"O", b"S", b"T"))) / max(1, sum(map(t.lower().count, (b"a", b"e", b"i", b"o", b"s", b"t")))) for t in texts])
    shout = np.array([t.count(b"!") for t in texts])
    you = np.array([t.lower().count(b" you ") for t in texts])
    return np.stack([np.where(hits >= 2, TOXIC, ABSTAIN), np.where(hits == 0, CLEAN, ABSTAIN), np.where((hits >= 1) & (n < 60), TOXIC, ABSTAIN),
                     np.where(upper > 0.6, TOXIC, ABSTAIN), np.where(shout > 3, TOXIC, ABSTAIN), np.where((you > 0) & (hits > 0), TOXIC, ABSTAIN)], 1)


def label_model(votes: np.ndarray, weight: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of label 1, table [label, voter, vote] of probabilities, correlations of voters given the label)."""
    n, k = votes.shape
    one_hot = np.eye(3)[votes]
    strength, corr = np.ones(k), np.eye(k)
    fired = (votes == TOXIC).sum(1)
    q = np.clip(0.05 + 0.3 * np.minimum(fired, 3), 0.05, 0.95)
    for _ in range(2):
        for _ in range(rounds):
            mass = np.stack((weight * (1 - q), weight * q))
            table = np.einsum("yn,njv->yjv", mass, one_hot) + 0.5
            table /= table.sum(2, keepdims=True)
            log = np.einsum("njv,yjv,j->ny", one_hot, np.log(table), strength) + np.log([1 - prior, prior])
            q = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        sign = np.array([0.0, 1.0, -1.0])
        rest = sign[votes] - np.stack((1 - q, q), 1) @ (table @ sign)
        cov = (rest * weight[:, None]).T @ rest / weight.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / np.outer(sd, sd)
        strength = 1 / (1 + np.maximum(np.abs(corr) - 0.05, 0).sum(1) - 0.95)
    return q, table, corr


def linear(owner: np.ndarray, column: np.ndarray, n: int, k: int, q: np.ndarray, weight: np.ndarray, rounds: int = 800, penalty: float = 2e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on word presence against soft labels.

    Each round sees a random part of the words of each row, so that one telling word is enough and none leans on the others.
    """
    rng = np.random.default_rng(11)
    owners, columns = owner, column
    w, b, m, v = np.zeros(k), float(np.log((q @ weight + 1) / ((1 - q) @ weight + 1))), np.zeros(k + 1), np.zeros(k + 1)
    share = weight / weight.sum()
    for i in range(1, rounds + 1):
        seen = rng.random(len(owners)) < KEPT
        owner, column = owners[seen], columns[seen]
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[column], n) + b, -50, 50)))
        d = (p - q) * share
        g = np.append(np.bincount(column, d[owner], k) + penalty * w / k, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        s = 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
        w, b = w - s[:k], b - s[k]
    return w, b


def _apart(features: np.ndarray, index: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Features in their order, without those that stand in the same rows as an earlier one (a word and its beginning)."""
    seen, out = set(), []
    order = np.argsort(index, kind="stable")
    cuts = np.searchsorted(index[order], np.stack((features, features + 1)))
    for f, a, b in zip(features, *cuts, strict=True):
        if (rows := owner[order[a:b]].tobytes()) not in seen:
            seen.add(rows), out.append(f)
    return np.array(out, int)


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray):
    """(sorted word hashes, their weights, bias); None without both labels."""
    if len(set(toxic.tolist())) < 2:
        return None
    raw = [(t or "").encode() for t in texts]
    parts = [(i, distinct_words(raw[i:j])) for i, j in in_slices([len(t) for t in raw], SLICE)]
    owner, words = (np.concatenate([f(i, p) for i, p in parts]) for f in (lambda i, p: p[0] + i, lambda i, p: p[1]))
    vocabulary, g, support, precision = association(owner, words, toxic, weight)
    best = np.argsort(-g)
    lexicon = best[(g[best] > 15) & (support[best] >= 2) & (precision[best] >= 0.9)][:20 * LEXICON]
    lexicon = _apart(lexicon, np.searchsorted(vocabulary, words), owner)[:LEXICON]
    if not len(lexicon):
        lexicon = best[:3]
    index = np.searchsorted(vocabulary, words)
    votes = np.zeros((len(raw), len(lexicon)), int)
    for j, word in enumerate(lexicon):
        votes[owner[index == word], j] = TOXIC
    votes = np.hstack([votes, pattern_votes(raw, (votes == TOXIC).sum(1))])
    q, _, _ = label_model(votes, weight, float(toxic @ weight / weight.sum()))
    common = np.argsort(-np.bincount(index, minlength=len(vocabulary)), kind="stable")[:FEATURES - len(lexicon)]
    chosen = np.unique(np.concatenate((lexicon, common)))
    use = np.isin(index, chosen)
    w, b = linear(owner[use], np.searchsorted(chosen, index[use]), len(raw), len(chosen), q, weight)
    return vocabulary[chosen], w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 1500, most_chars: int = 60_000_000):
    """Model from labelled rows that are not held out; rows weigh as much as they stand for.

    The sample has about `per_label` rows of either label, at most three times that together where rows repeat an id, and at most `most_chars`
    characters of text (but one row at least); rows of the least hash of id and text stay. Labels steer which words become voters, never a vote.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    share = {y: min(1.0, per_label / n) for y, n in counts.items()}
    draw = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2**31))
    some = known.withColumn("draw", draw).filter(F.col("draw") < F.when(F.col("y") == 1, F.lit(share[1] * 2**31)).otherwise(F.lit(share[0] * 2**31))).orderBy("draw", "id").limit(3 * per_label)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(some), "id")
    rows = rows.withColumn("draw", F.xxhash64("id", "text")).orderBy("draw", "id", "text").limit(3 * per_label)
    so_far = F.sum(F.length("text")).over(W.orderBy("draw", "id", "text"))  # over the limited sample
    rows = rows.withColumns({"so_far": so_far, "first": F.row_number().over(W.orderBy("draw", "id", "text"))}).filter((F.col("so_far") <= most_chars) | (F.col("first") == 1)).collect()
    rows.sort(key=lambda r: (r["id"], r["text"]))
    y = np.array([r["y"] for r in rows])
    return train([r["text"] for r in rows], y, np.array([1 / share[v] for v in y.tolist()])) if rows else None


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1), predicted (score >= 0.5).

    A null text is scored as an empty one. Without a model every score is 0. Repeated rows keep their rows; an empty table gives an empty
    table; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            raw = [(t or "").encode() for t in x["text"].to_pylist()]
            p = np.zeros(len(raw))
            if model:
                vocabulary, w, b = model
                z = np.full(len(raw), b)
                for i, j in in_slices([len(t) for t in raw], SLICE):
                    owner, words = distinct_words(raw[i:j])
                    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                    known = vocabulary[at] == words
                    z[i:j] += np.bincount(owner[known], w[at[known]], j - i)
                p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_pydict({"id": x["id"], "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)
