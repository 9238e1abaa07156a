"""Strings of a chunk are laid out in bounded memory: they are several times the chunk, and their places eight times that."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.llm import suffixes


def test_strings_are_laid_out_piece_by_piece():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 255, 5000).astype(np.uint8)
    starts, sizes = rng.integers(0, 4000, 300), rng.integers(0, 900, 300)
    want = b"".join(data[a : a + n].tobytes() for a, n in zip(starts, sizes))
    for most in (1, 700, 1 << 20):
        assert suffixes._laid_out(data, starts, sizes, most).tobytes() == want
    assert not len(suffixes._laid_out(data, starts[:0], sizes[:0]))


def test_asking_holds_little_more_than_its_strings():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=3000)) for _ in range(60)]
    chunk = suffixes._Chunk(pa.table({"doc_id": list(range(60)), "text": texts}), 100, 32)
    tracemalloc.start()
    try:
        values, _ = chunk.anchors()
        start, windows = chunk.asked(np.ones(len(values), np.uint8), 8)[2:4]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 6 * int((windows + 99).sum())  # numpy's share; with the places of all bytes at once it was 17 times the strings on a chunk of check_s
