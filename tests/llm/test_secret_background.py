"""The background of the secret scan is all of the text, and its scores are those of the plain form."""

import random

import duckdb

from tidemark.llm import secrets as S


def test_every_word_is_in_one_token():
    """a token began every 1000 characters, and the words between them counted for nothing."""
    rng = random.Random(5)
    for size in (3, 40, 900):
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 12))) for _ in range(size))
        letters = "".join(c for t in S.background(text) for c in t.lower() if c.isalpha())
        assert letters == text.replace(" ", "") or size == 3 and len(text) < 18 and not letters


def test_scores_at_once_equal_the_plain_ones():
    texts = [t for t, in duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE text IS NOT NULL LIMIT 500").fetchall()]
    tokens = [t for text in texts for t in S.background(text)] + ["a" * 16, "a_b/c" * 5, "ab" * 20, "0" * 2000]
    assert len(tokens) > 10_000 and S.cells_of(tokens).tolist() == [S.cell_of(t) for t in tokens] and not len(S.cells_of([]))
