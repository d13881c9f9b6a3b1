"""Groups by shared windows, from pieces of one least seed."""

import random

import numpy as np
import pyarrow as pa

from seqloom.operators import loci


def _plain(texts, window):
    of, least = {}, {i: i for i in texts}
    def root(i):
        while least[i] != i:
            i = least[i]
        return i
    for i, t in texts.items():
        s = "".join(c for c in t or "" if c.isascii() and c.isalpha()).upper()
        for o in range(len(s) - window + 1):
            a, b = root(of.setdefault(s[o : o + window], i)), root(i)
            least[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}


def test_components_equal_plain_ones(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghij klm") for _ in range(n))
    texts = {i: word(r.randint(0, 900)) for i in range(60)}
    for _ in range(25):  # runs of 38 to 43 letters, around the length that ties
        a, b = r.sample(range(60), 2)
        run = "".join(r.choice("nopqrstu") for _ in range(r.randint(38, 43)))
        texts[a], texts[b] = texts[a] + " " + run.upper(), run + "-" + texts[b]
    texts |= {60: None, 61: "", 62: "a" * 3000, 63: "b" + "a" * 40, 64: "é" + "ab" * 700, 65: "ba" * 20, 66: texts[3], 67: "a" * 39}
    rows = [*texts.items(), (None, texts[3])]
    got = {x.id: x.component for x in loci.components(spark.createDataFrame(rows, "id bigint, text string").repartition(3), "id", "text", 40).collect()}
    assert got.pop(None, 0) is None and got == _plain(texts, 40)


def test_pieces_hold_each_window_once_and_are_few():
    r = random.Random(7)
    texts = ["".join(r.choice("abcdefgh") for _ in range(n)) for n in (20_000, 39, 40, 0, 5_000)]
    row, _, start, length, _ = loci._pieces(pa.array(texts, pa.large_string()), 40)
    seen = np.concatenate([np.arange(s, s + n - 39) for s, n in zip(start, length, strict=True)])
    windows = sum(max(len(t) - 39, 0) for t in texts)
    assert len(seen) == len(set(seen.tolist())) == windows
    assert 8 * len(row) < windows  # before, a row for each window travelled
