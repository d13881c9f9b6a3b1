"""Encodings against plain counting; blocks of a head add up to its score."""

import pytest
from pyspark.sql import functions as F

from seqloom.functions.sequences import RESIDUES as R
from seqloom.operators import complement, immunity

ONE = {r: (i % 7 - 3) / 10.0 for i, r in enumerate(R)}
TWO = {a + b: (i * j % 5 - 2) / 10.0 for i, a in enumerate(R) for j, b in enumerate(R)}
SCALE = {r: float(r in "IVLF") for r in R}
ODD = ["GILGFVFTL", "AAAIIDIAA", "AAAIIXIAA", "AAAIDIDAA", "SIINFEKL", "AC", "", None, "ACD", "acdefghiklmnpq", "CCCCCCCCCCCC", "GILGFVFTL"]


def plain_places(p, cls, start):
    n = len(p)
    if n < 3:
        return []
    if cls == "mhc2":
        return ["anchor" if i - start in (0, 3, 5, 8) else "nflank" if i < start else "core" if i < start + 9 else "cflank" for i in range(n)]
    face = [i for i in range(n) if i not in {k % n for k in (0, 1, 2, -2, -1)}]
    zone = {i: ("tcr_n" if k < len(face) // 3 else "tcr_m" if k < 2 * len(face) // 3 else "tcr_c") for k, i in enumerate(face)}
    return [zone.get(i, "anchor") for i in range(n)]


@pytest.mark.parametrize("cls", ["mhc1", "mhc2"])
def test_design_and_tallies_equal_plain_counting(spark, cls):
    df = spark.createDataFrame([(i, p, 1) for i, p in enumerate(ODD)], "id int, pep string, bin int")
    zone = complement.ZONES[cls][1]
    tables = {"z": (zone, ONE), "t": ("tcr", ONE), "p": ("pair", TWO), "b": (f"anchor@{9 if cls == 'mhc1' else 1}", ONE)}
    got = {r.id: r for r in complement.design(df, "pep", tables, {"kd": SCALE}, runs=("kd", 0.5), means=["kd"], cls=cls, register=F.lit(1), blind="C").collect()}
    rows = {(r.pep, r.source, r.key): r.n for r in complement.tallies(df, "pep", cls, F.lit(1)).collect()}
    want_rows = {}
    for i, p in enumerate(ODD):
        if p is None:
            assert got[i].t is None and got[i].run_n is None and got[i].length is None and got[i].b is None
            continue
        u = p.upper()
        roles = plain_places(u, cls, 1)
        at = list(zip(u, roles, strict=False))
        pairs = [a + b for (a, x), (b, y) in zip(at, at[1:], strict=False) if "anchor" not in (x, y)]
        sighted = lambda w, keys: sum(w.get(k, 0.0) for k in keys if "C" not in k)
        face = [c for c, r in at if r != "anchor"]
        marks = "".join("1" if r != "anchor" and c in "IVLF" else "0" for c, r in at)
        runs = [x for x in marks.split("0") if x]
        inside = (len(u) in (9,)) if cls == "mhc1" else 14 <= len(u) < 16
        want = (sighted(ONE, [c for c, r in at if r == zone]), sighted(ONE, face), sighted(TWO, pairs), sighted(ONE, [c for c, r in at if r == "anchor"]) * inside, marks.count("1") / max(1, sum(c in R for c in face)), max(map(len, runs), default=0), len(runs), marks.count("1") / max(1, len(face)), len(u))
        g = got[i]
        assert (g.z, g.t, g.p, g.b, g.kd_mean, g.run_max, g.run_n, g.run_frac, g.length) == pytest.approx(want)
        if (p, "seen") not in want_rows:
            want_rows[p, "seen"] = 0
            for key, source in [(c, r) for c, r in at] + [(k, "pair") for k in pairs]:
                if set(key) <= set(R):
                    want_rows[p, source, key] = want_rows.get((p, source, key), 0) + 1
    assert rows == {k: v for k, v in want_rows.items() if len(k) == 3}


def test_blocks_add_up_to_the_score(spark):
    df = spark.createDataFrame([("GILGFVFTL",), ("SIINFEKL",)], "pep string")
    d = complement.design(df, "pep", {"aa": ("tcr", ONE), "kmer": ("pair", TWO)}, {"kd": SCALE}, runs=("kd", 0.5))
    blocks = {"phys": ["length", "kd_all"], "motif": ["run_max"], "table": ["aa", "kmer"]}
    model = [{"feature": f, "block": b, "coef": 0.3 + k, "mu": 0.1, "sigma": 2.0} for k, (b, f) in enumerate((b, f) for b, fs in blocks.items() for f in fs)]
    whole = {r.pep: r.score for r in immunity.head(d, model, intercept=0.4, prevalence=0.5).collect()}
    parts = [{r.pep: r.score for r in immunity.head(d, model, intercept=0.4, prevalence=0.5, blocks=[b]).collect()} for b in blocks]
    assert all(whole[p] == pytest.approx(0.4 + sum(x[p] for x in parts)) for p in whole)
    long = complement.features(d, "pep", blocks).where("pep = 'SIINFEKL'").collect()
    assert {(r.block, r.feature) for r in long} <= {(b, f) for b, fs in blocks.items() for f in fs} and all(r.value for r in long)
    with pytest.raises(ValueError):
        complement.design(df, "pep", {"x": ("nflank", ONE)}, {})
