"""URL filters, divergence audit and centroid clustering, against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from seqloom.llm import op11_url_filter as op11
from seqloom.llm import op12_divergence as op12
from seqloom.llm import op13_delta_lloyd as op13
from seqloom.llm import radix

SF = "/root/testdata/sf0.001"


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def plain_verdict(url, rules):
    host, path = plain_url(url)
    fits = [r for r in rules if None not in r and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_urls_against_a_plain_version(spark):
    rng = random.Random(4)
    hosts = ["com", "COM", "example.com", "www.Example.com", "a.www.example.com", "badexample.com", "net", "x.y.net", ".com", "com.", "", "éx.com", "host:80", "u@m.example.com", "a" * 300 + ".com", ".".join(["l"] * 200) + ".net"]
    paths = ["", "/", "/en/", "/en", "/EN/", "/en/1", "/es/", "/fr/x/y", "//en/", "/" + "e" * 5000, "/é/ü"]
    tails = ["", "?q=/en/", "#x?y", "?://", "/#?"]
    urls = [f"{s}://{h}{p}{t}" for s in ("http", "") for h in hosts for p in paths for t in tails]
    urls += [None, "", "nothing", "a:/b", "://", "http://a\nb.com/en/\n", "http://x.com/://y.net/es/"] + [rng.choice(urls) for _ in range(300)] + ["http://www.example.com/en/1"] * 300
    rules = [*op11.RULES, ("l.net", "", "allow"), ("example.com", "/e", "allow"), ("m.example.com", "/", "block"), ("com", "/é/", "block"), ("com", "/é/", "allow"), (None, "/", "block"), ("x.com", None, "block"), ("", "/en/", "block"), ("www.example.com", "", "block")]
    df = spark.createDataFrame([(i if i % 9 else None, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    for given in (op11.RULES, rules):
        table = op11.rule_table(spark, given)
        got = sorted(map(str, op11.judge(df, table).select("page_id", "host", "path", "rule", "verdict").collect()))
        want = [(i if i % 9 else None, *plain_verdict(u, given)) for i, u in enumerate(urls)]
        assert got == sorted(map(str, spark.createDataFrame(want, "page_id bigint, host string, path string, rule string, verdict string").collect()))


def test_urls_with_clashing_columns_and_without_rows_or_rules(spark):
    names = "page_id bigint, url string, host string, path string, rule string, verdict string, short string, r_host string, _id int"
    df = spark.createDataFrame([(1, "http://a.net/es/", *["x"] * 6, 3)], names)
    assert [tuple(r) for r in op11.judge(df, op11.rule_table(spark)).collect()] == [(1, "a.net", "/es/", "net/es/", "block")]
    assert op11.judge(df.limit(0), op11.rule_table(spark)).count() == 0
    none = op11.rule_table(spark).limit(0)
    assert [tuple(r) for r in op11.judge(df, none).collect()] == [(1, "a.net", "/es/", None, "allow")]


def test_short_digests_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(op11, "shortened", lambda found: found.substr(1, 0))  # all collide
    urls = ["http://a.com/en/1", "http://www.example.com/en/", "http://b.net/fr/", "http://b.org/fr/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op11.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), op11.rule_table(spark)).collect()}
    assert got == {i: plain_verdict(u, op11.RULES) for i, u in enumerate(urls)}


def plain_clusters(rows, k, dim, rounds, scale):
    """Every vector against every centroid in every round, in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    centroids = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        owned = {}
        for _, q in kept:
            owned.setdefault(near(q)[1], []).append(q)
        centroids = [[sum(x) // len(owned[j]) for x in zip(*owned[j], strict=True)] if j in owned else c for j, c in enumerate(centroids)]
    out = [(i, *near(q)[::-1]) for i, q in kept]
    own = {j: sum(d for _, x, d in out if x == j) for j in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda n: n if n < 2**63 else None
    return sorted(map(str, [(i, j, fits(d), fits(own[j]), fits(sum(own.values())), digest[j]) for i, j, d in out]))


def test_clusters_against_a_plain_version(spark, monkeypatch):
    rng = random.Random(6)
    near = [[rng.gauss(m, 0.2) for _ in range(4)] for m in (0, 0, 1, -1, 3) for _ in range(60)]
    ties = [[x, y, 0.0, 0.0] for x in (-1.0, 0.0, 1.0) for y in (-1.0, 1.0)] * 5
    odd = [[1.0] * 3, [1.0] * 5, [], None, [1.0, None, 1.0, 1.0], [float("nan")] * 4, [1.0, float("inf"), 0.0, 0.0]]
    huge = [[2.0**40, -(2.0**39), 1.5, 0.0], [2.0**19, 1.0, 1.0, 1.0], [1e30, 0.0, 0.0, -3.0]]
    schema = "vec_id bigint, embedding array<double>, q int, cluster string"
    monkeypatch.setattr(op13, "FEW", 3)
    for vectors in (near + ties + odd, near + odd + huge, ties, near[:3], [near[0]] * 50, odd, []):
        ids = [(i if i % 7 else None) if i % 11 else 5 for i in range(len(vectors))]
        df = spark.createDataFrame([(i, v, 1, "x") for i, v in zip(ids, vectors, strict=True)], schema).repartition(3)
        got = op13.cluster(df, k=6, dim=4, rounds=3, scale=8).collect()
        assert sorted(str(tuple(r)) for r in got) == plain_clusters(zip(ids, vectors, strict=True), 6, 4, 3, 8)


def test_cluster_query_equals_its_sql(spark):
    got = op13.op13_delta_lloyd(spark, SF).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(op13.ORACLE_SQL["op13_delta_lloyd"]).df()
    key = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(got[key].itertuples(index=False, name=None)) == sorted(want[key].itertuples(index=False, name=None))


def test_only_what_moved_is_compared():
    rng = np.random.default_rng(3)
    q = np.floor(rng.normal(0, 40, (500, 8)))
    before = [[int(x) for x in row] for row in q[:10]]
    none = np.zeros(500, bool)
    owner, distance, made = op13.reassigned(q, np.full(500, -1, np.int32), np.zeros(500, np.int64), none, before, list(range(10)))
    assert made == 5000
    after = [[x + 3 for x in c] if i in (2, 7) else c for i, c in enumerate(before)]
    got, far, made = op13.reassigned(q, owner, distance, ~none, after, [2, 7])
    full, want, _ = op13.reassigned(q, np.full(500, -1, np.int32), np.zeros(500, np.int64), none, after, [])
    assert (got == full).all() and (far == want).all() and made < 2000


def test_limbs_of_large_sums_add_up():
    values = [0, 5, -7, 2**200 + 1, -(2**90), 2**30, -(2**30) + 1]
    rows = op13.limbs(values)
    assert [sum(r[i] << (op13.LIMB * n) for n, r in enumerate(rows)) for i in range(len(values))] == values and op13.limbs([0, 0]) == [[0, 0]]


@pytest.mark.parametrize("name", ["op11_url_filter"])
def test_url_query_equals_its_sql(spark, name):
    got = op11.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.sql(op11.ORACLE_SQL[name]).df()
    rows = lambda df: sorted(map(str, df[sorted(df)].astype(object).where(df[sorted(df)].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want) and len(got)


def plain_audit(rows, least=3, top=200):
    """Dense: every group, every kept term, every pair, in Python's integers. rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    docs, counts, whole = Counter(), {(g, s): Counter() for _, g, s in rows}, {g: Counter() for _, g, _ in rows}
    for t, g, s in rows:
        counts[g, s].update(terms(t))
        whole[g].update(terms(t))
        docs.update((g, x) for x in set(terms(t)))
    out = []
    for (g, s), mine in counts.items():
        kept = [x for x in whole[g] if docs[g, x] >= least]
        share = lambda c, kept=kept: {x: 1 + 10**9 * (c[x] + 1) // (sum(c[y] for y in kept) + len(kept)) for x in kept}
        p, q = share(mine), share(whole[g])
        f = lambda a, b: (a - b) * (a - b) // b
        parts = {"pair": [(o, sum(f(p[x], r[x]) for x in kept)) for (h, o), theirs in counts.items() if h == g and o != s for r in [share(theirs)]], "term": [(x, f(p[x], q[x])) for x in kept if mine[x] and p[x] > q[x]]}
        for part, found in parts.items():
            found.sort(key=lambda r: (-r[1], r[0].encode()))
            out += [(g, s, part, item, value, i + 1) for i, (item, value) in enumerate(found) if part == "pair" or i < top]
    return sorted(map(str, out))


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("TILE", 2), ("BLOCK_ROWS", 20), ("AT_ONCE", 50)):
        monkeypatch.setattr(op12, name, value)
    monkeypatch.setattr(op12, "top_ranked", lambda *a: radix.top_ranked(*a, few=2, digit=5))


def test_audit_against_a_plain_version(spark, small_blocks):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "abcdÉéß漢" for b in "xyzwvut"] + ["same" * 40 + x for x in "abcdefg"] + ["Straße", "STRASSE", "\u212a", "q"]
    rows = []
    for g, sources in (("en", [f"s{i}" for i in range(9)] + [None, ""]), ("de", ["s0", "s1", "Ü"]), ("", ["only"]), (None, ["only", "two"]), ("fr", ["a", "b", "c"])):
        for _ in range(60 if g != "fr" else 4):
            n = rng.choice([0, 1, 5, 30])
            text = "".join(rng.choice(words if g != "fr" else [f"u{rng.random()}"[:9]]) + rng.choice([" ", "1", "\n", "_", "\x7f", "..", "\x00"]) for _ in range(n))
            rows.append((text.upper() if rng.random() < 0.1 else text, g, rng.choice(sources[:1] * 4 + sources)))
    rows += [(None, "en", "blank"), ("", "xx", None), ("漢" * 9000, "de", "long")] + [("ax ax bx", "de", "s1")] * 40
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string").repartition(5)
    for given, plain in ((df, rows), (df.limit(0), [])):
        got = op12.audit(given, top=6).collect()
        assert sorted(str(tuple(r)) for r in got) == plain_audit(plain, top=6)


def test_audit_query_equals_its_sql(spark):
    got = op12.op12_source_divergence(spark, SF).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(op12.ORACLE_SQL["op12_source_divergence"]).df()
    key = ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(got[key].itertuples(index=False, name=None)) == sorted(want[key].itertuples(index=False, name=None)) and len(got)


def test_shares_are_exact_beyond_doubles(spark):
    cases = [(0, 1), (0, 9 * 10**15), (10**15 - 1, 10**15), (123456789012345, 999999999999999), (7, 9), (10**15, 9 * 10**15)]
    got = spark.createDataFrame(cases, "n bigint, m bigint").select("n", "m", op12.share("n", "m").alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 1) // r.m for r in got)


def test_radix_selection_of_ties_and_long_shared_prefixes(spark, tmp_path):
    rng = random.Random(1)
    rows = [(g, rng.choice([0, 1, 7, 7, 7, 2**60 + 5, 2**62]), "p" * 300 + f"{i:03d}"[:: rng.choice([1, -1])] + "é" * (i % 3) + str(i)) for g in "abc" for i in range({"a": 200, "b": 1, "c": 30}[g])]
    rows += [("d", 5, "x" * i) for i in range(50)] + [("e", 3, "same")] * 20
    spark.createDataFrame(rows, "g string, v bigint, item string").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    for k in (1, 9, 40):
        got = sorted((r.g, r.rank, r.v, r["item"]) for r in radix.top_ranked(df, ["g"], "v", "item", k, "rank", few=3, digit=7).collect())
        want = [(g, i + 1, v, x) for g in "abcde" for i, (_, v, x) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:k])]
        assert got == want
    assert radix.top_ranked(df.limit(0), ["g"], "v", "item", 3, "rank").count() == 0
