"""Statistics of whole texts, computed a column batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than the six ASCII white-space characters, which is what bytes.split() cuts at.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that the decision lists may test.
RATIOS = ("mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_share", "stop_share", "echo_share", "words_per_line")
_KIND = pa.struct([(c, pa.int64()) for c in COUNTS] + [(c, pa.float64()) for c in RATIOS])
SCHEMA = "struct<" + ", ".join([f"{c}: bigint" for c in COUNTS] + [f"{c}: double" for c in RATIOS]) + ">"
_UPPER, _DIGIT, _MARK = bytes(range(65, 91)), b"0123456789", b"!?*#$%&|<>=~^_@+"


#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de et des en un une du que est pour qui dans par sur au pas plus se ce il ne avec son "
    "el los las y del que con por para una su al lo como más pero sus".split()
)
_STOP = frozenset(w.encode() for w in STOP_WORDS)


def repeated_words(words: list[bytes], width: int = WINDOW) -> tuple[int, int, float, int]:
    """Words that lie in a window of `width` words found twice or more, distinct words, the share of words equal to their predecessor, function words.

    Exact: words become ids, and windows of 2, 4, 8 words become ids of pairs of ids.
    """
    n = len(words)
    known = dict(zip(dict.fromkeys(words), range(n)))
    ids = np.fromiter(map(known.__getitem__, words), np.int64, n)
    stop = known.keys() & _STOP
    stops = int(np.bincount(ids)[[known[w] for w in stop]].sum()) if stop else 0
    echo = float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0
    if n <= width or len(known) == n:
        return 0, len(known), echo, stops
    span, size = 1, len(known)
    while span < width:
        pairs = ids[: n - 2 * span + 1] * size + ids[span : span + n - 2 * span + 1]
        span *= 2
        if span == width:
            pairs_sorted = np.argsort(pairs, kind="stable")
            s = pairs[pairs_sorted]
            same = s[1:] == s[:-1]
            twice = np.zeros(len(s), bool)
            twice[1:] |= same
            twice[:-1] |= same
            at = pairs_sorted[twice]
        else:
            distinct, ids = np.unique(pairs, return_inverse=True)
            size = len(distinct)
            if size == len(pairs):
                return 0, len(known), echo, stops
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), len(known), echo, stops


def statistics(text: bytes) -> tuple:
    words = text.split()
    n = len(words)
    n_bytes = len(text)
    word_bytes = sum(map(len, words))
    word_chars = word_bytes if text.isascii() else word_bytes - sum(1 for b in text if 128 <= b < 192) if n_bytes < 64 else len(text.decode("utf-8", "replace")) - (n_bytes - word_bytes)
    n_symbols = n_bytes - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeated, distinct, echo, stops = repeated_words(words) if n else (0, 0, 0.0, 0)
    chars, m = max(word_chars, 1), max(n, 1)
    share = lambda which: (n_bytes - len(text.translate(None, which))) / chars
    return (
        n, word_chars, n_symbols, dup, repeated,
        word_chars / m, n_symbols / chars, dup / max(lines, 1), repeated / m, distinct / m, share(_UPPER), share(_DIGIT), share(_MARK),
        stops / m, echo, n / max(lines, 1),
    )


def _columns(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = [statistics(t or b"") for t in batch.cast(pa.binary()).to_pylist()]
        columns = list(zip(*rows, strict=True)) or [()] * _KIND.num_fields
        yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KIND, strict=True)], fields=list(_KIND))


def text_statistics(text):
    """Column of SCHEMA: the statistics of a text column; a null text has those of the empty one."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _columns(batches)

    return F.arrow_udf(run, SCHEMA).asNondeterministic()(text)  # kept from being evaluated twice, once in a pushed-down filter
