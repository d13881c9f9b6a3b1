"""Votes by widening radii and fuzzy windows, against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators import neighbours

ALPHABET = "ACDE"


def hamming(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 99


def plain_rows(queries, panel, sig, enough, cap):
    out = []
    for q in set(queries):
        if sig(q) is None:
            continue
        near = sorted((hamming(sig(q), sig(e)), e, a) for e, a in panel if e != q and sig(e) is not None)
        for s in range(4):
            hits = [r for r in near if r[0] <= s]
            if len(hits) >= enough:
                break
        out += [(q, e, a, d) for d, e, a in hits[:cap]]
    return sorted(out)


@pytest.mark.parametrize("cls", ["mhc1", "mhc2"])
def test_nearest_rows_by_widening(spark, cls):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice(ALPHABET + "FGHIKL" * (rng.random() < 0.2)) for _ in range(n))
    panel = [(word(rng.choice([9, 10, 15]) if cls == "mhc2" else rng.choice([1, 2, 4, 8, 9])), rng.choice("XYZ")) for _ in range(300)]
    panel += [("AAAAAAAAA", a) for a in "XYZ" for _ in range(9)] + [("AAACCCCAA", "X")] * 40
    queries = [e for e, _ in panel[::7]] + [word(9) for _ in range(25)] + ["WWWWWWWWW", "AAAAAAAAA", "AAAGGGGAA", "A", ""]
    starts = {r.p: r.s for r in spark.createDataFrame([(p,) for p in {*queries, *(e for e, _ in panel)}], "p string").select("p", S.best_register("p").alias("s")).collect()}
    sig = (lambda p: p[:3] + p[-2:]) if cls == "mhc1" else (lambda p: None if starts[p] is None else "".join(p[starts[p] + j - 1] for j in (1, 4, 6, 9)))
    df, q = spark.createDataFrame(panel, "epitope string, allele string"), spark.createDataFrame([(x,) for x in queries], "query string")
    got = sorted((r["query"], r.epitope, r.allele, r.dist) for r in neighbours.nearest_rows(q, df, enough=6, cap=12, cls=cls).collect())
    want = plain_rows(queries, panel, sig, 6, 12)
    # rows that are equal in all columns are the same whichever is kept
    assert got == want
    votes = Counter((x, a) for x, _, a, _ in want)
    assert {(r["query"], r.allele): r.votes for r in neighbours.votes(q, df, enough=6, cap=12, cls=cls).collect()} == votes


def test_wide_radii_make_only_pairs_that_are_near(spark):
    rng = random.Random(6)
    sigs = ["".join(rng.choice(S.RESIDUES) for _ in range(5)) for _ in range(700)]
    a, b = spark.createDataFrame([(s,) for s in sigs[:200]], "sq string"), spark.createDataFrame([(s,) for s in sigs], "sp string")
    for d in range(4):
        got = sorted((r.sq, r.sp, r.dist) for r in neighbours.signature_pairs(a, b, 5, d).collect())
        assert got == sorted((x, y, hamming(x, y)) for x in set(sigs[:200]) for y in set(sigs) if hamming(x, y) <= d)
    # at the widest radius, keys of two letters meet far fewer pairs than pieces of one would
    assert len(got) < 0.05 * 200 * 700


def test_fuzzy_windows_against_a_plain_version(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(S.RESIDUES[:7]) for _ in range(rng.randint(2, 14)))
    queries, refs = [word() for _ in range(25)] + ["ACDEF"], [word() for _ in range(60)] + ["ACDEF", "ACDEFACDEF", None]
    q, r = spark.createDataFrame([(x,) for x in queries], "query string"), spark.createDataFrame([(x,) for x in refs], "ref string")
    windows = lambda s, k: {s[i : i + k] for i in range(len(s) - k + 1)}
    for k, subs, least, face in ((4, 0, 1, False), (4, 1, 2, False), (3, 1, 1, True), (5, 2, 1, False)):
        cut = (lambda s: s[2:-1]) if face else (lambda s: s)
        want = []
        for x in set(queries):
            found = []
            for y in {y for y in refs if y}:
                near = [min(hamming(a, b) for b in windows(cut(y), k)) for a in windows(cut(x), k)] if windows(cut(y), k) else []
                near = [d for d in near if d <= subs]
                if len(near) >= least:
                    found.append((-len(near), min(near), y))
            want += [(x, y, -s, d, i + 1) for i, (s, d, y) in enumerate(sorted(found))]
        got = neighbours.fuzzy_kmers(q, r, k, subs=subs, least=least, feature=(lambda c: F.substring(c, F.lit(3), F.length(c) - 3)) if face else None).collect()
        assert sorted((g["query"], g.ref, g.shared, g.score, g.place) for g in got) == sorted(want)


def test_anchor_weights_and_pruning(spark):
    import math

    from seqloom.operators import counts

    rng = random.Random(4)
    rows = []
    for i in range(80):
        y = rng.choice("DEK")
        direct = {"D": "A", "E": "C", "K": "F"}[y] if rng.random() < 0.9 else "G"
        linked = {"A": "L", "C": "M", "F": "N", "G": "P"}[direct] if rng.random() < 0.9 else "Q"
        rows.append((f"a{i}", linked + direct + rng.choice("STV") + "W", y))
    rows += [("short", "AA", "D")]
    grooves, residues = spark.createDataFrame([r[:2] for r in rows], "allele string, seq string"), spark.createDataFrame([(a, y) for a, _, y in rows] + [("none", "D")], "allele string, residue string")

    def mi(xs, ys):
        n, x, y, xy = len(xs), Counter(xs), Counter(ys), Counter(zip(xs, ys, strict=True))
        return max(0.0, sum(c / n * math.log2(c * n / (x[a] * y[b])) for (a, b), c in xy.items()))

    full = [r for r in rows if len(r[1]) == 4]
    cols, ys = [[s[p] for _, s, _ in full] for p in range(4)], [y for *_, y in full]
    told = [mi(c, ys) for c in cols]
    for prune in (False, True):
        w = list(told)
        if prune:
            w = [0.0 if any(told[q] > told[p] and told[p] <= mi(cols[p], cols[q]) for q in range(4) if q != p) and told[p] > 1e-12 else told[p] for p in range(4)]
            assert w[0] == 0 and w[1] > 0  # the linked place is explained by the direct one
        mean = sum(w) / 4
        got = {r.pos: r for r in counts.anchor_weights(grooves, residues, 4, prune=prune).collect()}
        assert len(got) == 4 and all(abs(got[p].mi - told[p]) < 1e-9 and abs(got[p].w - w[p] / mean) < 1e-9 for p in range(4))
    assert {r.w for r in counts.anchor_weights(grooves.limit(0), residues, 4, prune=True).collect()} == {1.0}


def test_novel_registers(spark):
    from seqloom.operators import cassette

    units = [("u1", "G", "ABCDEFGHIJ", 2, "missense"), ("u2", "G", "ABCDEFGHIJ", 2, " Frameshift "), ("u3", "G", "AAAAAA", 0, None), ("u4", "G", "AB", 1, "fusion")]
    got = {(r.unit, r.register): r.novel for r in cassette.novel_registers(spark.createDataFrame(units, "unit string, gene string, peptide string, mutation_index int, kind string"), [3, 8]).collect()}
    want = {}
    for u, _, p, m, kind in units:
        for n in (3, 8):
            for i in range(len(p) - n + 1):
                new = i + n > m and (i <= m or (kind or "").strip().lower() in ("frameshift", "fusion"))
                want[u, p[i : i + n]] = want.get((u, p[i : i + n]), False) or new
    assert got == want


def test_short_and_long_strings_meet_once(spark):
    rng = random.Random(12)
    words = sorted({"".join(rng.choice("ABC") for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8, 9, 12]))) for _ in range(160)})
    left, right = spark.createDataFrame([(w,) for w in words[::2]], "query string"), spark.createDataFrame([(w,) for w in words] * 2 + [(None,)], "ref string")
    for d in range(4):
        for least in (0, 1):
            got = sorted((r["query"], r.ref, r.dist) for r in neighbours.hamming_join(left, right, d, least=least).collect())
            assert got == sorted((x, y, hamming(x, y)) for x in words[::2] for y in words if least <= hamming(x, y) <= d)


def test_neighbours_are_counted_without_pairs(spark):
    rng = random.Random(13)
    words = sorted({"".join(rng.choice("ABC") for _ in range(rng.choice([0, 1, 2, 3, 5, 12, 13, 14]))) for _ in range(250)} | {"ABCABCABCABCA", "ABCABCABCABCB", "BBCABCABCABCB"})
    df = spark.createDataFrame([(w,) for w in words + words[:9]] + [(None,)], "pep string")
    for d in (1, 2, 3):
        got = {r.pep: [r[f"n{k}"] for k in range(1, d + 1)] for r in neighbours.neighbour_counts(df, d).collect()}
        assert got == {x: [sum(hamming(x, y) == k for y in words) for k in range(1, d + 1)] for x in words}
