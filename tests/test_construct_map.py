"""Maps of constructs against a plain version, and their files."""

import glob
import json
import random

from seqloom.functions import sequences as S
from seqloom.operators import construct_map as C

LENGTHS = {"mhc1": (8, 9), "mhc2": (12, 13)}


def test_maps_of_several_constructs(spark, tmp_path):
    rng = random.Random(3)
    cassettes, units, parts = [], [], {}
    for name, sizes in (("c1", [20, 30, 25]), ("c2", [14]), ("c3", [18, 18])):
        seq, bounds = ("GG" if name == "c3" else ""), []
        for i, n in enumerate(sizes):
            seq += "AAY" if i else ""
            bounds.append((len(seq), len(seq) + n))
            seq += "".join(rng.choice("ACDEFGHIKLX") for _ in range(n))
        cassettes.append((name, seq, "AAY"))
        parts[name] = (seq, bounds)
        units += [(name, i + 1, f"G{i}", None if i else "A1", a, b) for i, (a, b) in enumerate(bounds)]
    ranks = {}
    for cls, sizes in LENGTHS.items():
        windows = {s[o : o + n] for s, _ in parts.values() for n in sizes for o in range(len(s) - n + 1)}
        ranks[cls] = [(w, a, round(rng.random() * 6, 3)) for w in sorted(windows) for a in ("A1", "A2") if rng.random() < 0.5] + [("A" * 40, "A1", 0.1)]
    cf = spark.createDataFrame(cassettes, "cassette string, sequence string, spacer string")
    uf = spark.createDataFrame(units, "cassette string, unit int, gene string, allele string, start int, end int")
    rf = {cls: spark.createDataFrame(r + r[:3], "peptide string, allele string, rank double") for cls, r in ranks.items()}
    core = {r.p: r.s for r in spark.createDataFrame([(w,) for w, *_ in ranks["mhc2"]], "p string").select("p", S.best_register("p").alias("s")).collect()}
    want = []
    for name, (seq, bounds) in parts.items():
        last, rows = 0, []
        for i, (a, b) in enumerate(bounds, 1):
            if a > last:
                rows.append({"id": f"l{i - 1}", "kind": "linker", "start": last + 1, "end": a, "seq": seq[last:a]})
            rows.append({"id": f"u{i}", "kind": "unit", "start": a + 1, "end": b, "seq": seq[a:b], "unit": i, "gene": f"G{i - 1}", "allele": "" if i > 1 else "A1"})
            last = b
        n, eps = 0, []
        for cls, sizes in LENGTHS.items():
            for size in sizes:
                for o in range(len(seq) - size + 1):
                    w = seq[o : o + size]
                    for rank, allele in sorted((r, a) for p, a, r in ranks[cls] if p == w and r <= 2):
                        n += 1
                        unit = next((i for i, (a, b) in enumerate(bounds, 1) if a <= o and o + size <= b), 0)
                        at = core.get(w) if cls == "mhc2" else None
                        own = w if size <= 9 and cls == "mhc1" else w[at : at + 9] if cls == "mhc2" else w[:5] + w[-4:]
                        eps.append({"id": f"e{n}", "kind": "epitope", "start": o + 1, "end": o + size, "seq": w, "cls": cls, "allele": allele, "rank": round(rank, 4), "unit": unit, "gene": f"G{unit - 1}" if unit else "", "core": own, "core_start": o + at + 1 if cls == "mhc2" else None, "core_end": o + at + 9 if cls == "mhc2" else None})
        for e in eps:
            e["overlaps"] = [f["id"] for f in eps if f["cls"] != e["cls"] and f["start"] <= e["end"] and e["start"] <= f["end"]]
        for r in rows + eps:
            full = {"cls": "", "allele": "", "rank": None, "unit": 0, "gene": "", "core": "", "core_start": None, "core_end": None, "overlaps": []} | r
            want.append({"cassette": name, **{c: full.get(c) for c in C.MAP_COLUMNS}, "length": full["end"] - full["start"] + 1, "n_overlaps": len(full["overlaps"])})
    features = C.epitope_map(cf, uf, rf, lengths=LENGTHS)
    got = [r.asDict() for r in features.collect()]
    key = lambda r: (r["cassette"], r["id"])
    assert sorted(got, key=key) == sorted(want, key=key) and any(r["overlaps"] for r in got) and any(r["kind"] == "epitope" and r["unit"] == 0 for r in got)
    summary = {(r.cassette, r.unit): r for r in C.unit_summary(features).collect()}
    assert len(summary) == len(units)
    for (name, unit), r in summary.items():
        mine = [f for f in want if f["cassette"] == name and f["kind"] == "epitope" and f["unit"] == unit]
        one = [f for f in mine if f["cls"] == "mhc1"]
        assert (r.n_mhc1, r.n_mhc2, r.n_mhc1_with_mhc2_overlap, r.self_help) == (len(one), len(mine) - len(one), sum(bool(f["overlaps"]) for f in one), any(f["overlaps"] for f in one))
        assert r.alleles_mhc1 == sorted({f["allele"] for f in one})
    C.write_map(cf, features, tsv=str(tmp_path / "tsv"), json=str(tmp_path / "json"))
    lines = [line.rstrip("\n").split("\t") for f in glob.glob(f"{tmp_path}/tsv/*.csv") for line in open(f)]
    assert lines[0] == ["cassette", *C.MAP_COLUMNS]
    assert sorted((x[0], x[1], x[15]) for x in lines if x[0] != "cassette") == sorted((r["cassette"], r["id"], ",".join(r["overlaps"])) for r in want)
    docs = {d["cassette"]: d for f in glob.glob(f"{tmp_path}/json/*.json") for d in map(json.loads, open(f))}
    for name, (seq, bounds) in parts.items():
        d, mine = docs[name], [r for r in want if r["cassette"] == name]
        assert d["sequence"] == seq and d["spacer"] == "AAY" and d["summary"]["n_units"] == len(bounds) and d["summary"]["length_aa"] == len(seq)
        assert [f["id"] for f in d["features"]] == [r["id"] for r in mine]
        assert d["summary"]["n_junction_spanning"] == sum(r["kind"] == "epitope" and r["unit"] == 0 for r in mine)
    bare = C.epitope_map(cf, uf, {}).collect()
    assert {r.kind for r in bare} == {"unit", "linker"} and all(r.overlaps == [] and r.n_overlaps == 0 for r in bare)
