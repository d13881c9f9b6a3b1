"""The anchor model against a plain version in dicts."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.operators import anchor_model as M

AA = "ACDEFGHIKLMNPQRSTVWY"


def plain_places(n, anchors):
    if n < max(map(abs, anchors)):
        return None
    seen, out = set(), {}
    for j in anchors:
        at = j - 1 if j > 0 else n + j
        if at not in seen:
            out[j] = at
        seen.add(at)
    return out


def plain_shrink(prefs, kernel, allele, tau):
    own, near = prefs.get(allele, {}), Counter()
    for (a, b), k in kernel.items():
        if a == allele and k > 0 and b != a:
            for r, c in prefs.get(b, {}).items():
                near[r] += k * c
    n, m = sum(own.values()), sum(near.values())
    if not n and not m:
        return {}
    return {r: (own.get(r, 0) + (tau * near[r] / m if m else 0)) / (n + (tau if m else 0)) for r in set(own) | set(near)}


class Plain:
    def __init__(self, rows, kernel, anchors, tau):
        self.kernel, self.anchors, self.tau = kernel, anchors, tau
        self.prefs, self.by = defaultdict(lambda: defaultdict(Counter)), defaultdict(lambda: defaultdict(Counter))
        for ep, a, w in rows:
            for j, at in (plain_places(len(ep), anchors) or {}).items():
                self.prefs[j][a][ep[at]] += w
                self.by[j, len(ep)][a][ep[at]] += w

    def theta(self, j, a, length):
        over = plain_shrink(self.prefs[j], self.kernel, a, self.tau)
        n = sum(self.by[j, length][a].values())
        if not n:
            return over
        at = plain_shrink(self.by[j, length], self.kernel, a, self.tau)
        return {r: (n * at.get(r, 0) + self.tau * over.get(r, 0)) / (n + self.tau) for r in set(at) | set(over)}

    def bg(self, j, r):
        total = Counter()
        for c in self.prefs[j].values():
            total.update(c)
        return total[r] / sum(total.values())

    def score(self, pep, a, bg=None):
        at = plain_places(len(pep), self.anchors)
        if at is None:
            return -math.inf
        return sum(math.log((self.theta(j, a, len(pep)).get(pep[i], 0) + 1e-3) / ((bg.get(pep[i], 1e-4) if bg else self.bg(j, pep[i])) + 1e-3)) for j, i in at.items())


@pytest.fixture(scope="module")
def panel():
    rng = random.Random(2)
    rows = [("".join(rng.choice(AA[i % 3 :: 3] if rng.random() < 0.7 else AA + "X") for _ in range(rng.choice([7, 8, 9, 9, 9, 10]))), f"A{i}", rng.choice([1.0, 2.5])) for i in range(5) for _ in range(60 if i else 4)]
    kernel = {(f"A{i}", f"A{j}"): math.exp(-abs(i - j)) for i in range(6) for j in range(6) if i != j}
    kernel["A0", "A4"] = 0.0
    return rows, kernel


def frames(spark, panel):
    rows, kernel = panel
    return spark.createDataFrame(rows, "epitope string, allele string, w double"), spark.createDataFrame([(*k, v) for k, v in kernel.items()], "allele string, other string, k double")


def test_places_of_short_strings(spark):
    for anchors in (M.ANCHORS["mhc1"], M.CORE["mhc1"], (-1, 1, 2)):
        got = spark.range(1, 13).select("id", M.places(F.repeat(F.lit("A"), F.col("id").cast("int")), anchors).alias("p")).collect()
        assert all((None if r.p is None else {x.anchor: x.at for x in r.p}) == plain_places(r.id, anchors) for r in got)


def test_two_stages_of_back_off(spark, panel):
    df, kernel = frames(spark, panel)
    counts = M.anchor_counts(df, M.CORE["mhc1"], weight="w")
    got = {(r.anchor, r.length, r.allele, r.residue): r.p for r in M.distributions(counts, kernel, 7.0).collect()}
    plain = Plain(*panel, M.CORE["mhc1"], 7.0)
    want = {}
    for j in M.CORE["mhc1"]:
        for a in (f"A{i}" for i in range(6)):  # A5 has no rows, its likes have
            want |= {(j, 0, a, r): p for r, p in plain_shrink(plain.prefs[j], plain.kernel, a, 7.0).items()}
            for n in (7, 8, 9, 10):
                if sum(plain.by[j, n][a].values()):
                    want |= {(j, n, a, r): p for r, p in plain.theta(j, a, n).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_scores_of_seen_and_unseen_lengths(spark, panel):
    df, kernel = frames(spark, panel)
    anchors = M.ANCHORS["mhc1"]
    counts = M.anchor_counts(df, anchors, weight="w")
    shares = M.distributions(counts, kernel, 7.0)
    rng = random.Random(5)
    asked = [("".join(rng.choice(AA + "XB") for _ in range(n)), f"A{i}") for n in (2, 3, 4, 7, 8, 9, 12) for i in range(6)]
    pairs = spark.createDataFrame(asked, "pep string, allele string")
    plain = Plain(*panel, anchors, 7.0)
    for bg in (None, {"A": 0.3, "C": 0.1, "L": 0.6}):
        table = bg and spark.createDataFrame(list(bg.items()), "residue string, bg double")
        got = {(r.pep, r.allele): r.score for r in M.score(pairs, M.models(shares, counts, range(2, 13), background=table)).collect()}
        assert len(got) == len(asked) and all(got[k] == pytest.approx(plain.score(*k, bg)) for k in got)
        every = M.score(pairs.select("pep").distinct(), M.models(shares, counts, range(4, 10), background=table)).collect()
        mine = {k: v for k, v in got.items() if 4 <= len(k[0]) < 10}
        each = {(r.pep, r.allele): r.score for r in every}
        assert len(each) == len(every) == 6 * len(mine) and {k: each[k] for k in mine} == pytest.approx(mine)


def test_rare_alleles_lengths_and_residues_before(spark, panel):
    df, kernel = frames(spark, panel)
    anchors = M.CORE["mhc1"]
    counts = M.anchor_counts(df, anchors, weight="w")
    shares = M.distributions(counts, kernel, 7.0)
    terms = M.length_terms(df, kernel, [8, 9, 10], 7.0, weight="w")
    pairs = spark.createDataFrame([("ACDEFGHIK", "A0"), ("ACDEFGHIK", "A3"), ("ACDEFGHK", "A3")], "pep string, allele string")
    rare = spark.createDataFrame([("A0",)], "allele string")
    bg = {r: 1 / 20 for r in AA}
    table = spark.createDataFrame(list(bg.items()), "residue string, bg double")
    prev = spark.createDataFrame([("A", "C", 0.5), ("I", "K", 0.01)], "prev string, residue string, p double")
    got = {(r.pep, r.allele): r.score for r in M.score(pairs, M.models(shares, counts, [8, 9], background=table, conditional=True, terms=terms, rare=None), anchors, bg=M.transitions(prev, table)).collect()}
    plain = Plain(*panel, anchors, 7.0)
    lengths = defaultdict(Counter)
    for ep, a, w in panel[0]:
        lengths[a][len(ep)] += w
    for pep, a in got:
        term = math.log((plain_shrink(lengths, plain.kernel, a, 7.0).get(len(pep), 0) + 1e-3) / (1 / 3 + 1e-3))
        want = term
        for j, i in plain_places(len(pep), anchors).items():
            before = pep[i - 1] if i else ""
            b = {("A", "C"): 0.5, ("I", "K"): 0.01}.get((before, pep[i]), 1 / 20)
            want += math.log((plain.theta(j, a, len(pep)).get(pep[i], 0) + 1e-3) / (b + 1e-3))
        assert got[pep, a] == pytest.approx(want)
    masked = {(r.pep, r.allele): r.score for r in M.score(pairs, M.models(shares, counts, [8, 9], rare=rare, primary=M.ANCHORS["mhc1"]), anchors).collect()}
    some = Plain(*panel, anchors, 7.0)
    want = sum(math.log((some.theta(j, "A0", 9).get("ACDEFGHIK"[i], 0) + 1e-3) / (some.bg(j, "ACDEFGHIK"[i]) + 1e-3)) for j, i in plain_places(9, anchors).items() if j in M.ANCHORS["mhc1"])
    assert masked["ACDEFGHIK", "A0"] == pytest.approx(want) and masked["ACDEFGHIK", "A3"] == pytest.approx(some.score("ACDEFGHIK", "A3"))


def test_prior_strength_by_moments(spark, panel):
    df, kernel = frames(spark, panel)
    counts = M.anchor_counts(df, M.ANCHORS["mhc1"], weight="w")
    got = M.fitted_tau(counts, (*M.ANCHORS["mhc1"], 4), rich=50)
    plain = Plain(*panel, M.ANCHORS["mhc1"], 7.0)
    for j in M.ANCHORS["mhc1"]:
        rich = [c for c in plain.prefs[j].values() if sum(c.values()) >= 50]
        total = sum(rich, Counter())
        n = sum(total.values())
        m = {r: total[r] / n for r in AA}
        var = sum(sum((c[r] / sum(c.values()) - m[r]) ** 2 for c in rich) / len(rich) for r in AA)
        assert got[j] == pytest.approx(min(1e3, max(0.05, sum(x * (1 - x) for x in m.values()) / var - 1)))
    assert got[4] == 10.0 and M.fitted_tau(counts, (1,), rich=1e9) == {1: 10.0}


def test_pseudocounts_keep_sums(spark, panel):
    df, _ = frames(spark, panel)
    counts = M.anchor_counts(df, (1, -1), weight="w")
    same = [(a, b, 0.8 if a == b else 0.2 / 19) for a in AA for b in AA]
    got = M.pseudocounts(counts, spark.createDataFrame(same, "seen string, residue string, p double"), 5.0)
    keys = ["anchor", "length", "allele"]
    sums = lambda d: {tuple(r)[:3]: r.s for r in d.groupBy(*keys).agg(F.sum("cnt").alias("s")).collect()}
    a, b = sums(counts), sums(got)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    row = {r.residue: r.cnt for r in counts.where("anchor = 1 AND length = 9 AND allele = 'A1'").collect()}
    n = sum(row.values())
    want = (n / (n + 5)) * row.get("A", 0) + 5 / (n + 5) * sum(c * (0.8 if r == "A" else 0.2 / 19) for r, c in row.items() if r != "X")
    assert {r.residue: r.cnt for r in got.where("anchor = 1 AND length = 9 AND allele = 'A1'").collect()}["A"] == pytest.approx(want)


def test_registers_settle_and_frames_are_summed(spark):
    rng = random.Random(3)
    rows, kernel = [], [("A", "B", 0.5), ("B", "A", 0.5)]
    for a, motif in (("A", "FAALAASAL"), ("B", "YAAMAATAV")):
        for _ in range(40):
            core = "".join(c if i in (0, 3, 5, 8) else rng.choice(AA) for i, c in enumerate(motif))
            left = rng.randint(0, 4)
            rows.append(("".join(rng.choice("DEKRNQ") for _ in range(left)) + core + "".join(rng.choice("DEKRNQ") for _ in range(4 - left)), a, 1.0, left))
    df = spark.createDataFrame(rows, "epitope string, allele string, w double, truth int")
    k = spark.createDataFrame(kernel, "allele string, other string, k double")
    for rounds in (2, None):
        at = M.registers(df, k, M.ANCHORS["mhc2"], rounds=rounds, weight="w")
        found = {(r.pep, r.allele): r.start for r in at.collect()}
        assert sum(found[e, a] == t for e, a, _, t in rows) >= 76
    counts = M.anchor_counts(at, M.ANCHORS["mhc2"], pep="pep", weight="weight", start="start")
    model = M.models(M.distributions(counts, k, 10.0, by_length=False), counts, [0])
    priors = M.start_priors(at, k)
    table, prior = {r.allele: r.table for r in model.collect()}, {(r.length, r.allele): r.prior for r in priors.collect()}
    assert all(sum(map(math.exp, p)) == pytest.approx(1) and len(p) == n - 8 for (n, _), p in prior.items())
    pairs = spark.createDataFrame([(rows[0][0], "A"), (rows[0][0], "B"), ("A" * 11, "A"), ("AAA", "A")], "pep string, allele string")
    for register in ("marginal", "max"):
        for r in M.score_frames(pairs, model, priors, M.ANCHORS["mhc2"], register=register).collect():
            if len(r.pep) < 9:
                assert (r.start, r.score) == (-1, -math.inf)
                continue
            f = [sum(table[r.allele].get(f"{j}:{r.pep[s + j - 1]}", table[r.allele][f"{j}:*"]) for j in M.ANCHORS["mhc2"]) for s in range(len(r.pep) - 8)]
            p = prior.get((len(r.pep), r.allele), [-math.log(len(f))] * len(f))
            assert r.start == f.index(max(f))
            assert r.score == pytest.approx(max(f) if register == "max" else math.log(sum(math.exp(x + y) for x, y in zip(f, p, strict=True))))
    with pytest.raises(ValueError):
        M.score_frames(pairs, model, priors, register="sum")
