"""What the codec needs for a batch is freed with the batch."""

import gc
import weakref

from tidemark.llm import sentencepiece_codec as C
from tidemark.llm.registry import SENTENCEPIECE_MODEL


def test_suffix_arrays_are_freed_without_a_collection(monkeypatch):
    """Each was held by a cycle, so a worker grew by some MB a batch until Python collected its garbage."""
    seen, plain = [], C.SuffixArray.__init__

    def init(self, *args):
        plain(self, *args)
        seen.append(weakref.ref(self))

    monkeypatch.setattr(C.SuffixArray, "__init__", init)
    codec = C.Codec(C.Pieces(SENTENCEPIECE_MODEL))
    gc.collect()
    gc.disable()
    try:
        codec.encode(["some words and others", "words that follow"])
        assert seen and all(r() is None for r in seen)
    finally:
        gc.enable()
