"""N-gram Jaccard join by signature trees: every link of texts whose shingle sets overlap enough, as connected groups.

A text's set holds 64-bit hashes of its distinct runs of words. Texts with equal sets are one class; only one of each class
takes part. The join is exact and goes down a tree of nodes, each with the OR of its members' token bitmaps and the range
of their set sizes:

* The upper level is distributed. A class can only link with another if the two share a token among the first few of each
  in a common order (rare tokens first, by a frequency sketch over all documents): with none in common their largest
  possible overlap is too small, and it is no more than what either has from that token on. One shuffle brings equal
  tokens together and drops those that no two classes have; tokens that the sketch shows to be frequent are dealt out.
* Star rounds come first: of all classes that have a token one is the centre, against which the others are held. Each
  class has few distinct centres, so this is linear in the tokens, and a large group of near copies is one component
  after it. What is left are classes of different components that share a token.
* These gather in leaves of bounded size, members of one component or, of components of one, those of one token. A leaf's
  bitmap is the sparse set of its members' first tokens; two leaves of different components meet only where their bitmaps
  do and size ranges and largest overlaps allow it.
* Before texts travel to a unit of work, its members' own bitmaps do, of about a bit for each token: who can link with no
  member of the other side by size or largest overlap has no seat there. So texts of unlinked documents stay where they are.
* Below, a task takes two sides (a centre and its members, or two leaves), builds the tree of dense bitmaps of each and
  walks both at once. A pair of nodes is left as soon as its size ranges or the largest overlap that the bitmaps allow
  rule out a link, or all below it are connected already; pairs of texts that are left are compared exactly.

No pair of texts is ever a row but for those of a class and its centre, and each unit of work returns at most one edge less
than it has members. Groups are connected components of the edges.

Cases: a text without words has an empty set and links with nothing; repeated rows share a class; a text of fewer words
than a shingle is one shingle; an empty table gives an empty result; a null id takes part under no name: such rows come
back with a null component_id; rows of one id are one document, linked through each of its texts, and all have the same
component_id; extra columns are never read; a text of any length is one set, and a unit of work holds few of very long ones.
Classes are 64-bit numbers made from 128-bit digests; should two digests give one number, another seed is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch, documents
from seqloom.llm.components import components

WIDTH, PERCENT = 4, 85
#: Members of a leaf on average at most, leaves that one leaf is held against at a time, children of a node, cells of the frequency sketch.
LEAF, ABREAST, FANOUT, CELL_BITS = 256, 16, 4, 18
#: Star rounds; tokens of all members of one part of a star at most, on average; parts that a frequent token is dealt out to, and how many times the mean of all cells its cell has.
ROUNDS, STAR_TOKENS, SALT, FREQUENT = 2, 1 << 16, 64, 64
#: Bits of the filter by which a round leaves out texts that have no seat, before they are shuffled.
BLOOM_BITS = 1 << 26
#: Most bits of a dense bitmap: tokens beyond are counted as excess, so larger sets stay exact.
MOST_BITS = 1 << 17
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct runs of `width` words; letters A-Z count as small ones."""
    words = text.lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += h[k : k + n] * _MIX[k % len(_MIX)] * np.uint64(2 * (k // len(_MIX)) + 1)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def needed(size: int, percent: int = PERCENT) -> int:
    """Least overlap of a set of this size with any set that it links with."""
    return -(-percent * size // 100)


def first_tokens(tokens: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """Those of which two linked sets share one: all but needed - 1 of the set, rare ones first."""
    order = np.lexsort((tokens, sketch[(tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)]))
    return tokens[order[: len(tokens) - needed(len(tokens), percent) + 1]]


class Node:
    """OR of the bitmaps below, range of set sizes, and the most tokens that a set below has beyond its bits."""

    __slots__ = ("bits", "excess", "items", "kids", "large", "small", "whole")

    def __init__(self, bits, small, large, excess, items=(), kids=()):
        self.bits, self.small, self.large, self.excess, self.items, self.kids = bits, small, large, excess, items, kids
        self.whole = not kids  # whether all items below are known to be connected

    def first(self) -> int:
        node = self
        while node.kids:
            node = node.kids[0]
        return node.items[0]


def bitmap(tokens: np.ndarray, size: int) -> np.ndarray:
    on = np.zeros(size, bool)
    on[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(on).view(np.uint64)


def tree(sets: list[np.ndarray], items: list[int], size: int) -> Node:
    """Items ordered by set size, then by their least token, so that similar sets stand side by side."""
    items = sorted(items, key=lambda i: (len(sets[i]), int(sets[i][0])))
    level = []
    for i in items:
        bits = bitmap(sets[i], size)
        level.append(Node(bits, len(sets[i]), len(sets[i]), len(sets[i]) - int(np.bitwise_count(bits).sum()), items=(i,)))
    while len(level) > 1:
        up = []
        for k in range(0, len(level), FANOUT):
            kids = level[k : k + FANOUT]
            up.append(kids[0] if len(kids) == 1 else Node(np.bitwise_or.reduce([x.bits for x in kids]), min(x.small for x in kids), max(x.large for x in kids), max(x.excess for x in kids), kids=kids))
        level = up
    return level[0]


def can_link(x: Node, y: Node, percent: int) -> bool:
    """False if no set below x can link with one below y: by size, or as too few bits, and tokens beyond bits, are common."""
    if 100 * x.large < percent * y.small or 100 * y.large < percent * x.small:
        return False
    least = -(-percent * (x.small + y.small) // (100 + percent))
    return int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.excess, y.excess) >= least


def own_bitmap(tokens: np.ndarray) -> bytes:
    """Bitmap of the least power of two of bits that has one for each token, within bounds."""
    return bitmap(tokens, min(MOST_BITS, max(64, 1 << (len(tokens) - 1).bit_length()))).tobytes()


class _Octave:
    """Members of one side of a unit that have bitmaps of one size: places, set sizes and bitmaps, folded on demand."""

    def __init__(self, at: list[int], n: np.ndarray, bits: list[bytes]):
        self.at, self.n = np.array(at), n[at]
        self.folds = [np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), -1)]

    def fold(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of so many 64-bit words, and the tokens that each set has beyond its bits."""
        while self.folds[-1].shape[1] > words:
            x = self.folds[-1]
            self.folds.append(x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :])
        x = next(f for f in self.folds if f.shape[1] == words)
        return x, self.n - np.bitwise_count(x).sum(1).astype(np.int64)


def _octaves(at: list[int], n: np.ndarray, bits: list[bytes]) -> list[_Octave]:
    by_size: dict[int, list[int]] = {}
    for i in at:
        by_size.setdefault(len(bits[i]), []).append(i)
    return [_Octave(v, n, bits) for v in by_size.values()]


def with_partner(sides: list[int], n: list[int], bits: list[bytes], percent: int = PERCENT) -> np.ndarray:
    """Which members of a unit can link with one of the other side (or, of side 2, of their own) by sizes and largest overlap."""
    n = np.array(n, np.int64)
    found = np.zeros(len(n), bool)
    left, right = ([i for i, s in enumerate(sides) if bool(s) == want] for want in (True, False))
    ours = _octaves(left, n, bits)
    others = _octaves(right, n, bits) + (ours if left and sides[left[0]] == 2 else [])
    for x in ours:
        for y in others:
            if 100 * x.n.max() < percent * y.n.min() or 100 * y.n.max() < percent * x.n.min():
                continue
            words = min(x.folds[0].shape[1], y.folds[0].shape[1])
            (xs, x_over), (ys, y_over) = x.fold(words), y.fold(words)
            for k in range(len(xs)):
                near = (100 * x.n[k] >= percent * y.n) & (100 * y.n >= percent * x.n[k])
                if x is y:
                    near[k] = False
                at = np.flatnonzero(near)
                most = np.bitwise_count(ys[at] & xs[k]).sum(1).astype(np.int64) + np.minimum(x_over[k], y_over[at])
                at = at[(100 + percent) * most >= percent * (x.n[k] + y.n[at])]
                if len(at):
                    found[x.at[k]] = True
                    found[y.at[at]] = True
    return found


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def dual_walk(sets: list[np.ndarray], left: list[int], right: list[int] | None, percent: int = PERCENT, known: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Edges, besides the known ones, that connect all that links between left and right, or within left; a pair that earlier edges connect is passed over."""
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in known:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    def whole(node: Node) -> bool:
        """Once connected, always connected: so it is kept."""
        if not node.whole:
            node.whole = all(map(whole, node.kids)) and len({root(k.first()) for k in node.kids}) == 1
        return node.whole

    size = 64
    while size < min(MOST_BITS, 8 * max(len(sets[i]) for i in (*left, *(right or ())))):
        size *= 2
    top = tree(sets, left, size)
    todo = [(top, top if right is None else tree(sets, right, size))]
    edges = []
    while todo:
        x, y = todo.pop()
        if x is y:
            if not whole(x):  # each child with itself first, so that what is connected need not be walked
                todo += [(p, q) for k, p in enumerate(x.kids) for q in x.kids[k + 1 :]] + [(p, p) for p in x.kids]
        elif whole(x) and whole(y) and root(x.first()) == root(y.first()):
            continue
        elif can_link(x, y, percent):
            if x.kids and (not y.kids or x.large - x.small >= y.large - y.small):
                todo += [(p, y) for p in x.kids]
            elif y.kids:
                todo += [(x, q) for q in y.kids]
            else:
                i, j = x.items[0], y.items[0]
                a, b = root(i), root(j)
                if a != b and linked(sets[i], sets[j], percent):
                    parent[max(a, b)] = min(a, b)
                    edges.append((i, j))
    return edges


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _class(key: bytes, seed: int) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(key, seed=seed), "big", signed=True)


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int, kept: Scratch) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, n, class, key, mark, bits) of all documents, key the digest of the set, mark a hash of the text and bits the set's own bitmap, and the frequency sketch over them."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            ns, keys, bits = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                t = shingles(text or b"", width)
                cells += np.bincount((t >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells)) if len(t) > 20_000 else 0
                if len(t) <= 20_000:
                    np.add.at(cells, (t >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
                ns.append(len(t))
                keys.append(xxhash.xxh3_128_digest(t.tobytes()) if len(t) else None)
                bits.append(own_bitmap(t) if len(t) else None)
            classes = [None if k is None else _class(k, seed) for k in keys]
            none = pa.nulls(len(ns), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(classes, pa.int64()), pa.array(keys, pa.binary()), batch.column(2), none, pa.array(bits, pa.binary())], names=["id", "n", "class", "key", "mark", "cell", "bits"])
            id_type = batch.schema.field(0).type
        at = np.flatnonzero(cells)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), id_type), pa.array(cells[at], pa.int64()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.int64()), pa.array(at, pa.int32()), pa.nulls(len(at), pa.binary())], names=["id", "n", "class", "key", "mark", "cell", "bits"])

    made = kept.stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark")).mapInArrow(run, f"id {kind}, n bigint, class bigint, key binary, mark bigint, cell int, bits binary"), "sets")
    sketch = np.zeros(1 << CELL_BITS, np.int64)
    for r in made.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n")).toPandas().itertuples():  # one row for each cell
        sketch[r.cell] = r.n
    return made.where("cell IS NULL").select("id", "n", "class", "key", "mark", "bits"), sketch


def _postings(docs: DataFrame, text_col: str, width: int, percent: int, sketch: np.ndarray, seed: int) -> DataFrame:
    """Rows (token, class, pack): first tokens of every text, and how many tokens it has from there on; copies within a task count once.

    pack holds n, reach and whether the token's cell is a frequent one, so that the one large shuffle carries three numbers.
    """
    frequent = sketch > FREQUENT * max(1.0, float(sketch.mean()))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            tokens, packs, classes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                t = shingles(text or b"", width)
                if len(t):
                    c = _class(xxhash.xxh3_128_digest(t.tobytes()), seed)
                    if c not in seen:
                        seen.add(c)
                        first = first_tokens(t, sketch, percent)
                        tokens.append(first)
                        packs.append(np.int64(len(t)) << 32 | (len(t) - np.arange(len(first), dtype=np.int64)) << 1 | frequent[(first >> np.uint64(64 - CELL_BITS)).astype(np.int64)])
                        classes.append(c)
            each = [len(x) for x in tokens[1:]]
            yield pa.RecordBatch.from_arrays([_as_long(np.concatenate(tokens)), pa.array(np.repeat(np.array(classes, np.int64), each)), pa.array(np.concatenate(packs))], names=["token", "class", "pack"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token bigint, class bigint, pack bigint")


#: Parts of a set are counted in so many, rounded up.
_WHOLE = 4096


def _part():
    return F.ceil(F.col("reach").cast("bigint") * _WHOLE / F.col("n")).cast("int")


def _least_sum(percent: int) -> int:
    """Two linked sets have an overlap of percent / (100 + percent) of their sizes' sum at least. Divided by either size and
    added, the parts that they have from their first common token on are 4 times that at least, whatever the sizes."""
    return 4 * percent * _WHOLE // (100 + percent)


def _shared(postings: DataFrame, percent: int) -> DataFrame:
    """Rows (token, class, n, reach) of tokens that two classes have early enough for a link to be possible; each once.

    The only shuffle of all postings. Rows of a token come sorted by falling part, so that a row can link with some other one
    if it can with the first; nothing but that first row is held. A frequent token's rows are in several tasks and all pass.
    """
    least = _least_sum(percent)
    pack = F.col("pack")
    packed = postings if "pack" in postings.columns else postings.select("token", "class", (F.shiftleft(F.col("n").cast("bigint"), 32) + F.shiftleft(F.col("reach").cast("bigint"), 1)).alias("pack"))

    def run(batches):
        last = None  # token, salt, class, part, n, reach of the row before; of the first row until a second one is seen
        head = None
        for batch in batches:
            token, salt, part, cls, n, reach = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            m = len(token)
            if not m:
                continue
            before = last if last is not None else (0, -1, 0, 0)
            t0, s0, c0 = (np.concatenate([[v], x[:-1]]) for v, x in ((before[0], token), (before[1], salt), (before[2], cls)))
            begins = (token != t0) | (salt != s0)
            again = ~begins & (cls == c0)
            starts = np.flatnonzero(begins)
            first = np.maximum.accumulate(np.where(begins, np.arange(m), -1))
            most = np.where(first >= 0, part[np.maximum(first, 0)], head[3] if head is not None else 0)
            passes = ~begins & ~again & ((part + most >= least) | (salt > 0))
            lone = begins & (salt > 0)  # all rows of a frequent token pass
            with_first = np.zeros(m, bool)
            hit = np.flatnonzero(passes & (salt == 0))
            with_first[first[hit[first[hit] >= 0]]] = True  # the first row passes with the first that can link with it
            pick = passes | lone | with_first
            out = [token[pick], cls[pick], n[pick], reach[pick]]
            if head is not None and head[6] is False and len(hit) and first[hit[0]] < 0:
                out = [np.concatenate([[h], x]) for h, x in zip((head[0], head[2], head[4], head[5]), out, strict=True)]
                head = (*head[:6], True)
            if len(starts):
                k = int(starts[-1])
                head = (token[k], salt[k], cls[k], int(part[k]), n[k], reach[k], bool(with_first[k] or salt[k] > 0))
            last = (token[-1], salt[-1], cls[-1], part[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["token", "class", "n", "reach"])

    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.when(pack % 2 == 1, 1 + F.pmod("class", F.lit(SALT))).otherwise(F.lit(0)).cast("int")
    rows = packed.repartition(parts, "token", salt).select("token", salt.alias("salt"), F.shiftright(pack, 32).cast("int").alias("n"), F.shiftright(pack.bitwiseAND(0xFFFFFFFF), 1).cast("int").alias("reach"), "class")
    rows = rows.select("token", "salt", _part().alias("part"), "class", "n", "reach").sortWithinPartitions("token", "salt", F.desc("part"), "class")
    return rows.mapInArrow(run, "token bigint, class bigint, n int, reach int")


def _fits(percent: int, n: str, reach: str, n_b: str, reach_b: str):
    """Whether sizes and the largest overlap from a common token on allow a link."""
    n, reach, n_b, reach_b = (F.col(c).cast("bigint") for c in (n, reach, n_b, reach_b))
    return (100 * n >= percent * n_b) & (100 * n_b >= percent * n) & ((100 + percent) * F.least(reach, reach_b) >= percent * (n + n_b))


def _stars(shared: DataFrame, percent: int, number: int, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """Seats (a, part, side, class) of every class (side 0) and its centres (side 1, a), and the rows of shared that are no centre's."""
    centre = F.min(F.struct(F.xxhash64("class", F.lit(number)).alias("h"), F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("reach").alias("reach_a")))
    # a table of its own, as adaptive execution splits a hot token only where no aggregate stands between shuffle and join
    centres = work.stored(shared.groupBy("token").agg(centre.alias("_c")).select("token", "_c.a", "_c.n_a", "_c.reach_a"), "centres")
    with_centre = shared.join(centres, "token")
    rest = with_centre.where(F.col("class") != F.col("a"))
    pairs = rest.where(_fits(percent, "n", "reach", "n_a", "reach_a"))
    pairs = pairs.groupBy("a", "class").agg(F.first("n").alias("n"))
    sizes = pairs.groupBy("a").agg(F.ceil(F.sum("n") / STAR_TOKENS).alias("parts"))
    members = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("class"), "parts").alias("part"), F.lit(0).alias("side"), "class")
    centres = sizes.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), F.col("a").alias("class"))
    return members.unionByName(centres), rest.select(*shared.columns)


def _leaf_pairs(shared: DataFrame, leaves: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a <= b, of leaves that meet: sparse bitmaps, size ranges and the largest overlap that these allow.

    leaves: class, leaf and, where all members are of one component, its label: such leaves do not meet themselves or each other.
    """
    named = leaves.select("class", "leaf", *([] if "label" in leaves.columns else [F.lit(None).cast("bigint").alias("label")]), *(["label"] if "label" in leaves.columns else []))
    marks = shared.select("token", "class", "n", "reach").join(named, "class").groupBy("token", "leaf").agg(
        F.first("label").alias("label"), F.min("n").cast("bigint").alias("small"), F.max("n").cast("bigint").alias("large"), F.max("reach").cast("bigint").alias("reach"),
        F.slice(F.sort_array(F.collect_list(_part()), asc=False), 1, 2).alias("parts"),  # a leaf is bounded
    )
    other = marks.select("token", F.col("leaf").alias("b"), F.col("label").alias("label_b"), F.col("small").alias("small_b"), F.col("large").alias("large_b"), F.col("reach").alias("reach_b"))
    fits = (100 * F.col("large") >= percent * F.col("small_b")) & (100 * F.col("large_b") >= percent * F.col("small"))
    overlap = (100 + percent) * F.least("reach", "reach_b") >= percent * (F.col("small") + F.col("small_b"))
    apart = ~F.coalesce(F.col("label") == F.col("label_b"), F.lit(False))
    meet = marks.withColumnRenamed("leaf", "a").join(other, "token").where((F.col("a") < F.col("b")) & fits & overlap & apart)
    own = marks.where(F.col("label").isNull() & (F.size("parts") > 1) & (F.get("parts", F.lit(0)) + F.get("parts", F.lit(1)) >= _least_sum(percent))).select(F.col("leaf").alias("a"), F.col("leaf").alias("b"))
    return meet.select("a", "b").unionByName(own).distinct()


def _leaf_seats(pairs: DataFrame, leaves: DataFrame) -> DataFrame:
    """Seats (a, part, side, class): a unit is a leaf a and at most about ABREAST leaves b that it meets, itself among them (side 2) or not: a's members travel once for all of these."""
    met = pairs.groupBy("a").agg(F.ceil(F.count("*") / ABREAST).alias("parts"))
    work = pairs.join(met, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b")
    own = work.groupBy("a", "part").agg(F.max(F.when(F.col("a") == F.col("b"), 2).otherwise(1)).alias("side")).select("a", "part", F.col("a").alias("leaf"), "side")
    ends = own.unionByName(work.where("a < b").select("a", "part", F.col("b").alias("leaf"), F.lit(0).alias("side")))
    return ends.join(leaves.select("leaf", "class"), "leaf").select("a", "part", "side", "class")


def _possible(seats: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Seats whose class can link with another of its unit, as far as sizes and bitmaps tell; classes: class, n and bits."""

    def pick(unit: list[tuple]) -> list[tuple]:
        keep = with_partner([u[2] for u in unit], [u[4] for u in unit], [u[5] for u in unit], percent)
        return [u[:4] for u, k in zip(unit, keep, strict=True) if k]

    def run(batches):
        unit: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if unit and unit[-1][:2] != row[:2]:
                    out += pick(unit)
                    unit = []
                unit.append(row)
            yield made(out)
        if unit:
            yield made(pick(unit))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["a", "part", "side", "class"])

    n = int(seats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = seats.join(classes.select("class", "n", "bits"), "class").select("a", "part", "side", "class", "n", "bits")
    return rows.repartition(n, "a", "part").sortWithinPartitions("a", "part").mapInArrow(run, "a bigint, part bigint, side int, class bigint")


def _perhaps(marks: DataFrame, bits: int = BLOOM_BITS):
    """Function from a column of marks to whether one may be among the given ones: a bitmap of fixed size, which only saves shuffling."""
    place = 1 + F.pmod("mark", F.lit(bits))
    found = marks.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()  # bits / 8 bytes at most
    table = np.zeros((bits // 32768, 4096), np.uint8)
    for r in found:
        table[r.b - 1] = np.frombuffer(r.m, np.uint8)
    shared = marks.sparkSession.sparkContext.broadcast(table.reshape(-1))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            at = np.mod(batch.to_numpy(zero_copy_only=False), bits)
            yield pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return F.arrow_udf(run, "boolean")


def _edges(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, seats: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) of classes found in each unit (a, part) of the seats; classes: class, rep and mark (an id that has it, and the hash of the text that it has it by)."""
    wanted = seats.join(classes.select("class", "rep", "mark"), "class")
    perhaps = _perhaps(wanted)
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark")).where(perhaps("mark"))
    rows = texts.join(wanted.hint("shuffle_hash"), ["rep", "mark"]).select("a", "part", "side", "class", "text")

    def once(batches):
        seen = set()  # repeated rows of a class that this task has had
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True)
            yield batch.filter(pa.array([not (k in seen or seen.add(k)) for k in keys], pa.bool_()))

    rows = rows.mapInArrow(once, "a bigint, part bigint, side int, class bigint, text string")

    def solve(unit: list[tuple]) -> list[tuple]:
        """unit: (side, class, set); side 0: right, 1: left, 2: left, which is to be joined with itself too."""
        sets = [s for _, _, s in unit]
        left = [i for i, u in enumerate(unit) if u[0]]
        right = [i for i, u in enumerate(unit) if not u[0]]
        if not left:
            return []
        found = dual_walk(sets, left, None, percent) if unit[left[0]][0] == 2 else []
        found += dual_walk(sets, left, right, percent, found) if right else []
        return [(unit[i][1], unit[j][1]) for i, j in found]

    def run(batches):
        held_key, unit = None, []
        for batch in batches:
            out = []
            for a, part, side, i, text in zip(*batch.columns, strict=True):
                key = (a.as_py(), part.as_py())
                if key != held_key:
                    if held_key:
                        out += solve(unit)
                    held_key, unit = key, []
                unit.append((side.as_py(), i.as_py(), shingles(text.as_py().encode(), width)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        if held_key:
            out = solve(unit)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    # a unit is bounded, so no partition grows with one key
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "a", "part").sortWithinPartitions("a", "part").mapInArrow(run, "a bigint, b bigint")


def _labelled(shared: DataFrame, labels: DataFrame, work: Scratch) -> DataFrame:
    """shared with the label of each class's component, of tokens that two components have."""
    marked = work.stored(shared.drop("label").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")), "marked")
    several = marked.groupBy("token").agg(F.min("label").alias("_l"), F.max("label").alias("_h")).where("_l < _h").select("token")
    several = work.stored(several, "several")
    return marked.join(several, "token", "left_semi").select("token", "class", "n", "reach", "label")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """id, n_shingles, component_id: the smallest id reachable by links, itself included."""
    scratch = Scratch(docs.sparkSession)
    for seed in range(8):
        sets, sketch = _sets(docs, id_col, text_col, width, seed, scratch)
        named = sets.where("id IS NOT NULL AND key IS NOT NULL")
        classes = named.groupBy("class").agg(F.min("id").alias("rep"), F.min_by("mark", "id").alias("mark"), F.min("key").alias("_k"), F.max("key").alias("_z"), F.first("n").alias("n"), F.first("bits").alias("bits"))
        classes = scratch.stored(classes.select("class", "rep", "mark", "n", "bits", (F.col("_k") != F.col("_z")).alias("mixed")), "classes")
        if not classes.where("mixed").limit(1).count():
            break
    else:
        raise RuntimeError("set digests collide under every seed")
    work = Scratch(docs.sparkSession)
    postings = _postings(docs.where(F.col(id_col).isNotNull()), text_col, width, percent, sketch, seed)
    shared = work.stored(_shared(postings, percent), "shared")
    # the classes of one id are tied to the least of them
    each = scratch.stored(named.groupBy("id").agg(F.min("class").alias("class"), F.max("class").alias("high")), "ids")
    edges = named.select("id", F.col("class").alias("b")).join(each.where("class < high").select("id", F.col("class").alias("a")), "id").where("a < b").select("a", "b")
    edges = work.stored(edges, "edges")
    find = lambda seats: work.stored(_edges(docs, id_col, text_col, classes, work.stored(_possible(seats, classes, percent), "seats"), width, percent), "edges")
    left = shared
    for number in range(ROUNDS):
        seats, left = _stars(left, percent, number, work)
        edges = edges.unionByName(find(seats))
        labels = components(edges).select(F.col("v").alias("class"), "label")
        left = work.stored(_labelled(left, labels, work), "left")
        if not left.limit(1).count():
            break
    else:
        # members of one component gather in leaves of their own, components of one by the least token that they share
        keyed = work.stored(left.groupBy("class").agg(F.min("token").alias("token"), F.first("label").alias("label")), "keyed")
        sizes = keyed.groupBy("label").agg(F.count("*").alias("_m"))
        keyed = keyed.join(sizes, "label").select("class", F.when(F.col("_m") > 1, F.col("label")).alias("label"), F.when(F.col("_m") > 1, F.col("label")).otherwise(F.col("token")).alias("token"))
        keyed = keyed.select("class", "label", F.xxhash64("token", F.col("label").isNull()).alias("place"))
        many = keyed.groupBy("place").agg(F.ceil(F.count("*") / leaf).alias("parts"))
        dealt = keyed.join(many, "place").select("class", "label", F.xxhash64("place", F.pmod(F.xxhash64("class"), "parts")).alias("leaf"))
        leaves = work.stored(dealt, "leaves")
        pairs = work.stored(_leaf_pairs(left, leaves, percent), "pairs")
        edges = edges.unionByName(find(_leaf_seats(pairs, leaves)))
        labels = components(edges).select(F.col("v").alias("class"), "label")
    labelled = scratch.stored(classes.select("class", "rep").join(labels, "class", "left").select("class", "rep", F.coalesce("label", "class").alias("label")), "labelled")
    work.drop()
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    reached = each.join(labelled.select("class", "label").join(least, "label"), "class").select("id", "component_id")
    out = sets.where("id IS NOT NULL").join(reached, "id", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    rest = sets.where("id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return out.unionByName(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
