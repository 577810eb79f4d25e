"""SentencePiece encoding and decoding (BPE models with byte fallback) by suffix-array matching.

A batch's distinct words are laid end to end and indexed by a suffix array (ranks of prefixes by doubling, to the longest piece). Every
piece is binary-searched in it; its range of suffixes gives all places where it occurs, each an edge from its first to its last
character. Edges are sorted by where they end and relaxed in that order.

Relaxing is exact for BPE: of all edges that end at a character just one belongs to the encoding of the text up to there, the one
whose piece may follow the piece that ends before it. Two pieces may follow each other if undoing their merges in reverse order
finds no merge across their border that would have come first; the merges of a vocabulary are few enough for a lookup table.
The ids equal those of the public library (see the tests).

No piece has a space behind another character, so words (spaces, then all up to the next space) can be encoded one by one. A model of
which that does not hold, or that is no BPE with byte fallback, or that changes the text before it encodes, is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, give_back
from .shingles import batch_slices

SPACE, CHUNK, KEEP, LONG, SLICE = "▁", 150_000, 300_000, 400, 1_000_000
WORD = re.compile(r" *[^ ]+| +")
NEVER = np.int64(1) << 60


def check_model(path: str) -> None:
    """Raise ValueError for a model whose encoding this module would not reproduce."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    t, n = m.trainer_spec, m.normalizer_spec
    faults = {"it is no BPE model": t.model_type != 2, "it has no byte fallback": not t.byte_fallback, "it normalises text": n.name not in ("", "identity") or bool(n.precompiled_charsmap),
              "it removes white space": n.remove_extra_whitespaces, "it puts no space before a text": not n.add_dummy_prefix, "it keeps spaces as they are": not n.escape_whitespaces,
              "it has spaces behind words": t.treat_whitespace_as_suffix, "it has user-defined pieces": any(x.type == 4 for x in m.pieces),
              "a piece has a space behind another character": any(SPACE in x.piece.lstrip(SPACE) for x in m.pieces if x.type == 1)}
    if said := [k for k, v in faults.items() if v]:
        raise ValueError(f"{path} can't be used: {', '.join(said)}")


class Pieces:
    """A vocabulary as arrays; `rank` orders merges, 0 for single characters. Pieces may have any length, characters any number."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        check_model(path)
        sp = SentencePieceProcessor(model_file=path)
        self.digest = hashlib.sha256(Path(path).read_bytes()).hexdigest()  # the driver reads the model; tasks get it by broadcast
        ids = range(sp.vocab_size())
        self.unk = len(ids)
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        text = {i: sp.id_to_piece(i).replace(SPACE, " ") for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        raw = [text[i].encode() if i in text else b"" for i in ids]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.raw_at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        by_text = {t: i for i, t in text.items()}
        self.rank = np.zeros(len(ids) + 1, np.int64)
        many = sorted((i for i, t in text.items() if len(t) > 1), key=lambda i: -sp.get_score(i))
        self.rank[many] = np.arange(1, len(many) + 1)
        rank = {t: int(self.rank[i]) for t, i in by_text.items() if len(t) > 1}
        self.left, self.right = np.full(len(ids) + 1, -1, np.int32), np.full(len(ids) + 1, -1, np.int32)
        made, pairs = [], []
        for i in many:
            t = text[i]
            pairs += [(by_text[t[:k]], by_text[t[k:]], rank[t]) for k in range(1, len(t)) if t[:k] in by_text and t[k:] in by_text]
            if split := self._last_merge(t, rank, by_text):
                self.left[i], self.right[i] = split
                made.append(i)
        self._table([p for p in pairs])
        chars = sorted({c for t in text.values() for c in t})
        self.n_codes = len(chars) + 1
        self.bits_of_code = max(12, int(self.n_codes).bit_length())
        first = 60 // self.bits_of_code  # characters in one number
        longest = max((len(text[i]) for i in made), default=1)
        self.widths = [first << k for k in range(max(1, int(np.ceil(np.log2(max(1, -(-longest // first)))) + 1)))]
        self.code = np.zeros(0x110000, np.uint16 if self.n_codes < 65536 else np.uint32)
        self.code[[ord(c) for c in chars]] = np.arange(1, self.n_codes)
        self.single = np.full(self.n_codes, self.unk, np.int32)
        for c, k in zip(chars, range(1, self.n_codes), strict=True):
            self.single[k] = by_text.get(c, self.unk)
        self.found = np.array(made, np.int32)
        self.length = np.array([len(text.get(i, " ")) for i in ids] + [1], np.int32)
        self.codes = np.zeros((len(made), self.widths[-1]), np.uint64)
        for row, i in enumerate(made):
            self.codes[row, :len(text[i])] = self.code[[ord(c) for c in text[i]]]

    @staticmethod
    def _last_merge(t: str, rank: dict[str, int], ids: dict[str, int]):
        """The two pieces that BPE joins last on its way to this piece; None where it doesn't get there."""
        parts = list(t)
        while len(parts) > 2:
            k = min(range(len(parts) - 1), key=lambda j: rank.get(parts[j] + parts[j + 1], NEVER))
            if parts[k] + parts[k + 1] not in rank:
                return None
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return tuple(ids[p] for p in parts) if all(p in ids for p in parts) else None

    def _table(self, pairs: list[tuple[int, int, int]]) -> None:
        """Open addressing by (left, right); values are ranks."""
        a, b, r = np.array(pairs, np.int64).reshape(-1, 3).T
        self.bits = max(4, int(np.ceil(np.log2(4 * len(a) + 1))))
        self.keys, self.vals = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int64)
        key, todo, step = a << 32 | b, np.arange(len(a)), 0
        while len(todo):
            at = self._slot(key[todo], step)
            free = self.keys[at] < 0
            self.keys[at[free]] = key[todo[free]]  # the last of several writers stays
            won = self.keys[at] == key[todo]
            self.vals[at[won]] = r[todo[won]]
            todo, step = todo[~won], step + 1
        self.probes = step

    def _slot(self, key: np.ndarray, step: int) -> np.ndarray:
        return ((((key * np.int64(-7046029254386353131)) >> np.int64(64 - self.bits)) + step) & np.int64((1 << self.bits) - 1))

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        out, todo = np.full(len(key), NEVER, np.int64), np.arange(len(key))
        for step in range(self.probes):
            at = self._slot(key[todo], step)
            there = self.keys[at]
            hit = there == key[todo]
            out[todo[hit]] = self.vals[at[hit]]
            todo = todo[~hit & (there >= 0)]
            if not len(todo):
                break
        return out

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the border between two pieces alone."""
        ok, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), NEVER, np.int64)
        while len(live):
            bad = self.merge_rank(a, b) < limit
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            undo_a = ra > rb
            go = ~bad & (undo_a | (rb > 0))
            limit = np.where(undo_a, ra, rb + 1)[go]
            a, b = np.where(undo_a, self.right[a], a)[go], np.where(undo_a, b, self.left[b])[go]
            live = live[go]
        return ok


def key_of(codes: np.ndarray, at: int, fill: int, bits: int, width: int) -> np.ndarray:
    """`width` characters as one number; behind the end of a piece stands `fill`."""
    k = np.zeros(len(codes), np.uint64)
    for j in range(width):
        c = codes[:, at + j]
        k = k << np.uint64(bits) | np.where(c > 0, c, np.uint64(fill))
    return k


class SuffixArray:
    """Suffixes of the codes in order of their first widths[-1] characters, with the ranks that doubling goes through."""

    def __init__(self, codes: np.ndarray, bits: int, widths: list[int]):
        self.bits, self.widths = bits, widths
        n = len(codes)
        c = np.concatenate((codes.astype(np.uint64), np.zeros(widths[-1], np.uint64)))
        k = np.zeros(n, np.uint64)
        for j in range(widths[0]):
            k = k << np.uint64(bits) | c[j:n + j]
        self.levels = []
        for level, width in enumerate(widths):
            order = np.argsort(k, kind="stable")
            s = k[order]
            new = np.concatenate(([True], s[1:] != s[:-1])) if n else np.zeros(0, bool)
            self.levels.append(s[new])
            self.starts, self.order = np.append(np.flatnonzero(new), n), order
            if level + 1 < len(widths):
                rank = np.empty(n, np.uint64)
                rank[order] = np.cumsum(new) - 1
                k = rank << np.uint64(32) | np.concatenate((rank[width:], np.zeros(min(width, n), np.uint64)))[:n]

    def ranges(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and behind-last place in the order, by binary search, for every piece."""
        lo, hi = self._within(codes, len(self.widths) - 1, 0, length)
        return self.starts[lo], self.starts[hi]

    def _within(self, codes: np.ndarray, level: int, at: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A method, as a function that calls itself from within would hold the array in a cycle, and with it all ranks until the next full collection."""
        if level == 0:
            low, high = (key_of(codes, at, fill, self.bits, self.widths[0]) for fill in (0, (1 << self.bits) - 1))
            lo = np.searchsorted(self.levels[0], low, "left")
            return lo, np.maximum(lo, np.searchsorted(self.levels[0], high, "right"))
        half = self.widths[level - 1]
        lo, hi = self._within(codes, level - 1, at, left)
        lo2, hi2 = self._within(codes, level - 1, at + half, left - half) if at + half < self.widths[-1] else (np.zeros_like(lo), np.zeros_like(hi))
        far = left > half  # then the first half has one rank, or none
        a = lo.astype(np.uint64) << np.uint64(32)
        first = np.searchsorted(self.levels[level], a | np.where(far, lo2, 0).astype(np.uint64), "left")
        b = np.where(far, a | hi2.astype(np.uint64), hi.astype(np.uint64) << np.uint64(32))
        last = np.searchsorted(self.levels[level], b, "left")
        return first, np.where(hi > lo, np.maximum(first, last), first)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one after another."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


def encode_words(words: list[str], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and how many each has."""
    points = np.frombuffer("\x00".join(words).encode("utf-32-le"), "<u4")
    n_chars = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(n_chars + 1) - (n_chars + 1)
    codes = p.code[points]
    place = np.arange(len(points)) - np.repeat(begin, n_chars + 1)[:len(points)]
    codes[begin[1:] - 1] = 0
    sa = SuffixArray(codes, p.bits_of_code, p.widths)
    lo, hi = sa.ranges(p.codes, p.length[p.found])
    piece = np.repeat(p.found, hi - lo)
    start = sa.order[ragged(lo, hi - lo)]
    end = start + p.length[piece] - 1
    order = np.argsort(place[end].astype(np.uint32), kind="stable")
    start, end, piece = start[order], end[order], piece[order]
    cuts = np.searchsorted(place[end], np.arange(int(n_chars.max(initial=0)) + 1))
    last = np.full(len(points), -1, np.int32)
    char_order = np.argsort(place.astype(np.uint32), kind="stable")
    char_cuts = np.searchsorted(place[char_order], np.arange(int(n_chars.max(initial=0)) + 1))
    single = p.single[codes]
    for e in range(len(cuts) - 1):
        at = char_order[char_cuts[e]:char_cuts[e + 1]]
        alone = single[at]
        s, t, g = start[cuts[e]:cuts[e + 1]], end[cuts[e]:cuts[e + 1]], piece[cuts[e]:cuts[e + 1]]
        if e:
            last[at] = alone  # stands unless a longer edge may follow: just one edge can
            inner = place[s] > 0
            ok = ~inner
            ok[inner] = p.may_follow(last[s[inner] - 1], g[inner])
            s, t, g = s[ok], t[ok], g[ok]
        else:
            last[at] = alone
        last[t] = g
    rows = np.flatnonzero(n_chars)
    at, who, ids, owner = begin[rows] + n_chars[rows] - 1, rows, [], []
    char = []
    while len(at):
        g = last[at]
        ids.append(g), owner.append(who), char.append(at)
        at = at - p.length[g]
        go = at >= begin[who]
        at, who = at[go], who[go]
    if not ids:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    ids, owner, char = map(np.concatenate, (ids, owner, char))
    order = np.argsort(owner[::-1], kind="stable")
    ids, owner, char = ids[::-1][order], owner[::-1][order], char[::-1][order]
    unknown = np.flatnonzero(ids == p.unk)
    width = np.ones(len(ids), np.int64)
    tails = [chr(points[char[u]]).encode() for u in unknown]
    width[unknown] = [len(x) for x in tails]
    out = np.repeat(ids, width)
    out[ragged((np.cumsum(width) - width)[unknown], width[unknown])] = p.byte_ids[np.frombuffer(b"".join(tails), np.uint8)]
    return out, np.bincount(owner, width, len(words)).astype(np.int64)


class Codec:
    """Encoder with a memory of the words it has met, emptied once it holds `keep`."""

    def __init__(self, pieces: Pieces, keep: int = KEEP):
        self.p, self.keep = pieces, keep
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.at, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        words.sort(key=len)
        ids, n, i = [self.ids], [self.n], 0
        while i < len(words):
            j, size = i, 0
            while j < len(words) and (j == i or size + len(words[j]) < CHUNK and (len(words[j]) <= LONG or len(words[j]) < 2 * len(words[i]))):
                size, j = size + len(words[j]) + 1, j + 1
            a, b = encode_words(words[i:j], self.p)
            ids.append(a), n.append(b)
            i = j
        for w in words:
            self.index[w] = len(self.index)
        self.ids, self.n = np.concatenate(ids), np.concatenate(n)
        self.at = np.cumsum(self.n) - self.n

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has. A piece's space sign in a text counts as a space."""
        if len(self.index) > self.keep:
            self._forget()
        split = [WORD.findall(f" {t.replace(SPACE, ' ')}") if t else [] for t in texts]
        words = [w for ws in split for w in ws]
        if new := set(words).difference(self.index):
            self._learn(list(new))
        k = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        n = self.n[k]
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        return self.ids[ragged(self.at[k], n)], np.bincount(owner, n, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """Texts; without the space put before the first word. Bytes that are no UTF-8 become U+FFFD."""
        at, size = self.p.raw_at[ids], np.diff(self.p.raw_at)[ids]
        raw = self.p.raw[ragged(at, size)].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))]
        return [raw[a:b].decode(errors="replace")[raw[a:a + 1] == b" ":] for a, b in zip(ends, ends[1:], strict=False)]


_codecs: dict[str, Codec] = KEPT


def _codec(pieces) -> Codec:
    """The codec of this model; a worker keeps the last one, with the words it has learned, for the tasks that follow until another operator needs the memory."""
    key = pieces.value.digest
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(pieces.value)
    return _codecs[key]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (array<int>), n_tokens, n_chars, round_trip (decoding gives the text back).

    A null or empty text has no ids. Repeated rows keep their rows, an empty table gives an empty table, other columns are ignored.
    The vocabulary is read on the driver and broadcast: its size is that of the model, whatever the input.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(pieces)
        for whole in batches:
            for i, j in batch_slices(whole["text"], SLICE):
                x = whole.slice(i, j - i)
                texts = x["text"].to_pylist()
                ids, n = codec.encode(texts)
                same = [a == (t or "") for a, t in zip(codec.decode(ids, n), texts, strict=True)]
                yield pa.RecordBatch.from_pydict({"id": x["id"], "ids": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids, pa.int32())),
                                                  "n_tokens": pa.array(n, pa.int64()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "round_trip": pa.array(same)})
        give_back()

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, n_tokens long, n_chars long, round_trip boolean").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id, text. Null ids give an empty text."""
    pieces = encoded.sparkSession.sparkContext.broadcast(Pieces(model_path))
    rows = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(pieces)
        for x in batches:
            ids = x["ids"]
            texts = codec.decode(ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict({"id": x["id"], "text": pa.array(texts, pa.string())})

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
