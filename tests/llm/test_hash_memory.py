"""Hashing a block's words takes memory for a run of them, not for all, and gives what one run gives."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from assay.llm import blocks, bpe

WORDS = [b"%d,%s" % (i, b"xyz!"[: i % 5]) for i in range(300_000)]


def test_memory_of_a_blocks_words():
    words = pa.array(WORDS, pa.binary())
    for work in (blocks.word_hashes, lambda w: bpe._homes(w, 51)):
        tracemalloc.start()
        try:
            assert len(work(words)) == len(WORDS)
            assert tracemalloc.get_traced_memory()[1] < 40e6  # 8 bytes a word twice over, and a run
        finally:
            tracemalloc.stop()


def test_runs_change_nothing(monkeypatch):
    words = pa.array([b"", b"y" * 5000, *WORDS[:3000], b"", b"z" * 999, b""], pa.binary()).slice(1)
    whole, home = blocks.word_hashes(words), bpe._homes(words.slice(0, 3000), 7)
    for size in (1, 100, 5000):
        monkeypatch.setattr(blocks, "HASH_BYTES", size)
        assert pa.concat_arrays(list(blocks.word_runs(words))) == words
        assert np.array_equal(blocks.word_hashes(words), whole) and np.array_equal(bpe._homes(words.slice(0, 3000), 7), home)
    assert len(blocks.word_hashes(pa.array([], pa.binary()))) == len(bpe._homes(pa.array([], pa.binary()), 7)) == 0
