"""Word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of UTF-8: A-Z become a-z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
STEP = U(0x9E3779B97F4A7C15)
STEP_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
#: So many bytes of text are hashed at once, or one text: sums over bytes take some 60 times as much memory.
AT_ONCE = 250_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(texts: list[bytes], prefixes: tuple[int, ...] = (), fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and index of its text. Words are runs of bytes that are no ASCII white space; A-Z become a-z unless `fold` is off.

    After the words come their beginnings of so many bytes, where they are shorter than the word.
    """
    whole = b"\n".join(texts)
    raw = np.frombuffer(whole.translate(LOWER) if fold else whole, np.uint8)
    space = SPACE[raw]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    powers = np.full(len(raw) + 1, STEP, np.uint64)
    powers[:1] = 1
    np.multiply.accumulate(powers, out=powers)
    total = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(BYTE_CODE[raw] * powers[:-1])))
    back = np.full(len(raw) + 1, STEP_INVERSE, np.uint64)
    back[:1] = 1
    np.multiply.accumulate(back, out=back)
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(ends, start, "right")
    found, owners = [mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))], [owner]
    for k in prefixes:
        a = start[end - start > k]
        found.append(mix((total[a + k] - total[a]) * back[a] + U(k + 10**6)))
        owners.append(owner[end - start > k])
    return np.concatenate(found), np.concatenate(owners)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by text and hash, and the index of the text of each.

    A text of fewer words than `size`, but not none, has its whole sequence as one shingle.
    """
    found = []
    for i, j in in_slices([len(t) for t in texts], AT_ONCE):
        hashes, owner = _sets_at_once(texts[i:j], size)
        found.append((hashes, owner + i))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in found]), np.concatenate([o for _, o in found])


def _sets_at_once(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    words, owner = word_hashes(texts)
    n = np.bincount(owner, minlength=len(texts))
    place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    left = n[owner] - place
    take = (left >= size) | (place == 0)
    at, width = np.flatnonzero(take), np.minimum(left[take], size)
    sums = width.astype(np.uint64) * PLACES[-1]
    for j in range(size):
        has = width > j
        sums[has] += mix(words[at[has] + j] * PLACES[j])
    hashes, owner = mix(sums), owner[at]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def batch_slices(column: pa.Array, most: int, row: int = 0):
    """in_slices() of a column of texts by its bytes, and `row` more for each, without making Python strings of all of it at once."""
    yield from in_slices(pc.add(pc.fill_null(pc.binary_length(column), 0), row).to_pylist(), most)


def in_slices(sizes: list[int], most: int):
    """Ranges of consecutive texts of about `most` bytes together; one longer text is a range of its own."""
    i = 0
    while i < len(sizes):
        j, total = i, 0
        while j < len(sizes) and (j == i or total + sizes[j] <= most):
            total, j = total + sizes[j], j + 1
        yield i, j
        i = j
