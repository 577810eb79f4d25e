"""Secret scans: fixed patterns plus a battery of randomness tests with length-aware false-discovery control.

Candidates are all runs of 16 or more token characters, and the values of the fixed patterns. For each, an encoding is inferred (the smallest alphabet of
ENCODINGS that holds it), and three tests ask whether its symbols could be drawn at random from that alphabet: chi-squared uniformity over the symbols,
Wald-Wolfowitz runs about the middle of the alphabet, and lag-one serial correlation. The Cauchy rule combines them, which holds under dependence.

What that means is measured against ordinary text, all of it. Every document yields background tokens: its words, each in one token, joined with
their neighbours the way identifiers and paths are, of all lengths and alphabets. A candidate's p-value is the share of background tokens of its length class and encoding
that look as random as it does. Where hardly any do, the share is not counted but read from a tail: the square root of the score is close to normal, so
its median and its twentieth part fit one, joined to the counts where they end. So a single key in a large corpus can have a p-value
as small as it deserves.

Candidates outside the fixed patterns whose symbols the battery doesn't reject as random are reported by a Benjamini-Hochberg step in each length class, with the share of ordinary tokens estimated from the
large p-values (Storey). That bounds the share of ordinary tokens among the reports of a class to about `fdr`; the many short candidates, which nothing
can tell apart, don't weigh on the long ones. Values of the fixed patterns are always reported and carry their p-value.

The step needs counts by encoding, length class and a fixed grid of scores, so what reaches the driver has a fixed size.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
CANDIDATE, WORD = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}"), re.compile(r"[A-Za-z]{2,}")
#: Alphabets of the encodings, smallest first, each in the order of its characters.
ENCODINGS = ("0123456789", "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
             "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
             "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")
SETS = tuple(map(frozenset, ENCODINGS))
PLACES = tuple({c: i for i, c in enumerate(a)} for a in ENCODINGS)
#: Length classes begin at 16 and at these lengths; scores are cells of 1/20 of -log10 p.
LENGTHS, GRID = (20, 25, 30, 35, 40, 50, 65), 300
KINDS_OF, CLASSES, CELLS = len(ENCODINGS) + 1, len(LENGTHS) + 1, GRID + 1
#: Cells from here on (p of 0.001 and less) don't look random.
LOOKS = 60
#: Letters of background tokens; an encoding with fewer of them than LEAST is held against all. Counts below TAIL are read from the fit.
CANDIDATE_LEAST, JOINED, LEAST, TAIL = 16, (16, 17, 18, 20, 22, 25, 27, 30, 32, 35, 37, 40, 44, 50, 57, 65, 80), 300, 5
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("ord", pa.int32()), ("end", pa.int32()), ("cell", pa.int32())]))
COUNTS = pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64())]))
#: Background tokens that are scored at once. By character: the encodings that hold it as bits, and its place in each.
AT_ONCE = 4096
HOLDERS = np.array([sum((chr(c) in s) << k for k, s in enumerate(SETS)) for c in range(128)], np.int64)
PLACE_OF = np.array([[a.get(chr(c), 0) for c in range(128)] for a in PLACES])


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, ordinal of the kind, end, value) of the fixed patterns; leftmost and non-overlapping for each kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    return sorted(found + [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)])


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def inferred(token: str) -> int:
    """The smallest encoding that holds the token, or one beyond the last."""
    return next((k for k, s in enumerate(SETS) if s.issuperset(token)), len(SETS))


@lru_cache(200_000)
def randomness(token: str) -> float:
    """Combined p-value of "the symbols are independent and uniform over the inferred alphabet"; small: not random."""
    token = token.rstrip("=")
    if len(token) < 2:
        return 1e-15
    k = inferred(token)
    at = PLACES[k] if k < len(PLACES) else {c: i for i, c in enumerate(sorted(set(token)))}
    size, n = len(at), len(token)
    v = [at[c] for c in token]
    df = max(1, size - 1)
    x = max(0.0, sum(c * c for c in Counter(v).values()) * size / n - n)
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    p = [math.erfc(z / math.sqrt(2)) / 2]
    high = [2 * x >= size for x in v]
    a = sum(high)
    b = n - a
    if a and b:
        mean, runs = 2 * a * b / n + 1, 1 + sum(map(operator.ne, high, high[1:]))
        var = (mean - 1) * (mean - 2) / (n - 1)
        p.append(two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    mid = sum(v) / n
    d = [x - mid for x in v]
    var = sum(map(operator.mul, d, d)) / n
    p.append(two_sided(sum(map(operator.mul, d, d[1:])) / (n - 1) / var * math.sqrt(n - 1)) if var > 0 else 2.0 ** (1 - n))
    t = sum(math.tan((0.5 - min(max(q, 1e-15), 0.95)) * math.pi) for q in p) / len(p)
    return min(1.0, max(0.5 - math.atan(t) / math.pi, 1e-15) if t < 1e12 else 1 / (t * math.pi))


def cell_of(token: str) -> int:
    """Encoding, length class and score as one number."""
    return (inferred(token.rstrip("=")) * CLASSES + sum(len(token) >= k for k in LENGTHS)) * CELLS + min(GRID, int(-math.log10(randomness(token)) * 20))


def cells_of(tokens: list[str]) -> np.ndarray:
    """cell_of() of background tokens, which are ASCII, have 16 characters at least and don't end in "=". Those that no encoding holds go one by one."""
    if not tokens:
        return np.zeros(0, np.int64)
    n = np.array([len(t) for t in tokens], np.int64)
    start, owner, data = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n), np.frombuffer("".join(tokens).encode("ascii"), np.uint8)
    held = np.bitwise_and.reduceat(HOLDERS[data], start)
    k = np.minimum(np.log2(held & -held, where=held > 0, out=np.zeros(len(n))).astype(np.int64), len(ENCODINGS) - 1)
    v, size = PLACE_OF[k[owner], data], np.array([len(a) for a in ENCODINGS])[k]
    inner = np.ones(len(v), bool)
    inner[start] = False
    inner = np.flatnonzero(inner)
    together = lambda x, of=owner: np.bincount(of, x, len(n))
    two = lambda z: np.array([math.erfc(q) for q in (np.abs(z) / math.sqrt(2)).tolist()])
    x = np.maximum(0.0, (np.bincount(owner * 64 + v, minlength=64 * len(n)).reshape(-1, 64) ** 2).sum(1) * size / n - n)
    df = size - 1
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    uniform = np.array([math.erfc(q) / 2 for q in (z / math.sqrt(2)).tolist()])
    high = 2 * v >= size[owner]
    a, runs = together(high), 1 + together(high[inner] != high[inner - 1], owner[inner])
    b, few = n - a, np.exp2(1.0 - n)
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    by_runs = np.where(a * b == 0, few, np.where(var > 0, two((runs - mean) / np.sqrt(np.where(var > 0, var, 1.0))), 1.0))
    d = v - (together(v) / n)[owner]
    var = together(d * d) / n
    by_lag = np.where(var > 0, two(together(d[inner] * d[inner - 1], owner[inner]) / (n - 1) / np.where(var > 0, var, 1.0) * np.sqrt(n - 1)), few)
    t = sum(np.tan((0.5 - np.clip(q, 1e-15, 0.95)) * math.pi) for q in (uniform, by_runs, by_lag)) / 3
    p = np.minimum(1.0, np.where(t < 1e12, np.maximum(0.5 - np.arctan(t) / math.pi, 1e-15), 1 / (np.where(t < 1e12, 1.0, t) * math.pi)))
    out = (k * CLASSES + np.searchsorted(LENGTHS, n, "right")) * CELLS + np.minimum(GRID, (-np.log10(p) * 20).astype(np.int64))
    for i in np.flatnonzero(held == 0):
        out[i] = cell_of(tokens[i])
    return out


def background(text: str) -> list[str]:
    """Tokens of neighbouring words, joined in turn as lower and upper case with and without a number, CamelCase with and without one, snake, upper
    snake and a path. Each word of the text is in one token; what is left at the end belongs to the last one."""
    groups: list[list[str]] = []
    used, size, want = [], 0, JOINED[len(text) % len(JOINED)]
    for w in WORD.findall(text):
        used.append(w.lower())
        size += len(w)
        if size >= want:
            groups.append(used)
            used, size, want = [], 0, JOINED[(len(groups) + len(text)) % len(JOINED)]
    if size >= CANDIDATE_LEAST:
        groups.append(used)
    elif used and groups:
        groups[-1] += used
    out, number = [], str(len(text) % 997)
    for k, used in enumerate(groups, len(text) // len(JOINED)):
        style = k % 9
        if style in (2, 3):
            camel = "".join([w.capitalize() for w in used])
            out.append(camel if style == 2 else camel[0].lower() + camel[1:] + number)
        elif style < 6:
            low = "".join(used) + (number if style >= 4 else "")
            out.append(low.upper() if style in (1, 5) else low)
        else:
            low = ("/" if style == 8 else "_").join(used)
            out.append(low.upper() if style == 7 else low)
    return out


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[dict]:
    """Tested strings that no base span covers wholly. Both lists are walked once: a base span covers a candidate if, of those that
    start no later, the furthest end lies at or behind its end."""
    out, i, reach = [], 0, -1
    for m in CANDIDATE.finditer(text):
        while i < len(base) and base[i][0] <= m.start():
            reach, i = max(reach, base[i][2]), i + 1
        if reach < m.end():
            out.append({"start": m.start(), "ord": 3, "end": m.end(), "cell": cell_of(m[0])})
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        base, tested, tokens, counts = [], [], [], np.zeros(KINDS_OF * CLASSES * CELLS, np.int64)
        for text in x["text"].to_pylist():
            b = base_spans(text or "")
            base.append([{"start": s, "ord": k, "end": e, "cell": cell_of(v)} for s, k, e, v in b])
            tested.append(candidates(text or "", b))
            tokens += background(text or "")
            if len(tokens) >= AT_ONCE:
                counts, tokens = _add(counts, tokens), []
        counts = _add(counts, tokens)
        ordinary = [[{"cell": c, "n": counts[c]} for c in np.flatnonzero(counts).tolist()]] + [[]] * (x.num_rows - 1)  # a batch's counts stand in its first row
        yield pa.RecordBatch.from_pydict({"id": x["id"], "base": pa.array(base, SPANS), "tested": pa.array(tested, SPANS), "ordinary": pa.array(ordinary[:x.num_rows], COUNTS)})


def _add(counts: np.ndarray, tokens: list[str]) -> np.ndarray:
    for i in range(0, len(tokens), AT_ONCE):
        counts = counts + np.bincount(cells_of(tokens[i:i + AT_ONCE]), minlength=len(counts))
    return counts


def _normal(z: float) -> float:
    return math.erfc(-z / math.sqrt(2)) / 2


def tail(counts: np.ndarray) -> np.ndarray:
    """Share of tokens in each cell or below. Up to where TAIL tokens are counted, it follows a normal fit to the square root of the score, scaled to meet
    the count there."""
    total = counts.sum()
    share = (1 + np.cumsum(counts)) / (1 + total)
    if total < LEAST:
        return share
    root = np.sqrt(np.arange(CELLS) + 0.5)
    low, mid = (root[np.searchsorted(np.cumsum(counts), q * total)] for q in (0.05, 0.5))
    spread = max((mid - low) / 1.645, 1e-6)
    end = int(np.searchsorted(np.cumsum(counts), TAIL))
    if end == 0:
        return share
    scale = share[end] / max(_normal((root[end] - mid) / spread), 1e-300)
    share[:end] = np.minimum(share[end], [scale * _normal((r - mid) / spread) for r in root[:end]])
    return np.maximum(share, 1e-12)


def p_values(ordinary: dict[int, int]) -> np.ndarray:
    """By cell: the share of background tokens of its length class, and encoding where these are enough, that score as random or more; without any, 1."""
    counts = np.zeros((KINDS_OF, CLASSES, CELLS))
    for cell, n in ordinary.items():
        counts[np.unravel_index(cell, counts.shape)] += n
    pooled = counts.sum(0)
    return np.array([[tail(own if own.sum() >= LEAST else pooled[c]) for c, own in enumerate(kind)] for kind in counts]).ravel()


def screened(p: np.ndarray) -> np.ndarray:
    """p-values for the step: 1 where the battery itself rejects that the symbols are random (LOOKS), however few ordinary tokens score as low. A random key is
    lost to this once in a thousand."""
    return np.where(np.arange(len(p)) % CELLS >= LOOKS, 1.0, p)


def reported(tested: dict[int, int], p: np.ndarray, fdr: float) -> np.ndarray:
    """By cell: whether the step-up rule of its length class reports it."""
    out = np.zeros(len(p), bool)
    of = np.arange(len(p)) // CELLS % CLASSES
    for c in range(CLASSES):
        own = sorted(((p[cell], n) for cell, n in tested.items() if of[cell] == c))
        total, done, level = sum(n for _, n in own), 0, -1.0
        nulls = min(1.0, (1 + sum(n for q, n in own if q > 0.5)) / (0.5 * total)) if total else 1.0
        for q, n in own:
            done += n
            if q <= fdr * done / (total * nulls):
                level = q
        out |= (of == c) & (p <= level)
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05) -> DataFrame:
    """One row per document: id, base and spans, arrays of (start, kind, end, p_value) by start and kind, in code points.

    A null text counts as empty. Repeated rows and null ids keep their rows. Documents without findings have empty arrays, an empty
    table gives an empty table. A table with little text has little background, and so few or no findings beyond the fixed patterns. Other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, span = rows.schema["id"].dataType.simpleString(), "array<struct<start:int,ord:int,end:int,cell:int>>"
    found = cut(rows.mapInArrow(_scan, f"id {kind}, base {span}, tested {span}, ordinary array<struct<cell:int,n:long>>"))
    count = lambda c, cell, n: {r["cell"]: r["n"] for r in found.select(F.explode(c).alias("x")).groupBy(F.col(cell).alias("cell")).agg(n.alias("n")).collect()}  # noqa: E731  a fixed grid
    p = p_values(count("ordinary", "x.cell", F.sum("x.n")))
    said = docs.sparkSession.sparkContext.broadcast((p, reported(count("tested.cell", "x", F.count("*")), screened(p), fdr)))
    out = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("p_value", pa.float64())]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, report = said.value
        for x in batches:
            base, spans = [], []
            for b, t in zip(x["base"].to_pylist(), x["tested"].to_pylist(), strict=True):
                own = [s for s in t if report[s["cell"]]]
                for to, found in ((base, b), (spans, b + own)):
                    to.append([{"start": s["start"], "kind": KINDS[s["ord"]], "end": s["end"], "p_value": float(p[s["cell"]])} for s in sorted(found, key=lambda s: (s["start"], s["ord"], s["end"]))])
            yield pa.RecordBatch.from_pydict({"id": x["id"], "base": pa.array(base, out), "spans": pa.array(spans, out)})

    span = "array<struct<start:int,kind:string,end:int,p_value:double>>"
    return found.select("id", "base", "tested").mapInArrow(decide, f"id {kind}, base {span}, spans {span}").withColumnRenamed("id", id_col)


def span_list(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
