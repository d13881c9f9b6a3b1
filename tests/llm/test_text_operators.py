"""Each operator against a plain version, and the odd cases that its docstring defines."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import op1_quality_rules as op1
from seqloom.llm import op2_token_counts as op2
from seqloom.llm import op4_toxicity as op4
from seqloom.llm import op5_bpe as op5
from seqloom.llm import op7_packing as op7
from seqloom.llm import op8_importance as op8
from seqloom.llm import op9_training_order as op9
from seqloom.llm import op10_fingerprints as op10
from seqloom.llm.chunks import slices
from seqloom.llm.common import documents, labels
from seqloom.llm.text_stats import statistics

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Null, empty, blank, repeated rows, tangled white space, special strings, more than one sequence long.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "a  b \n c d"), (6, "x <|endoftext|> <|startoftext|>y"), (7, "Word. " * 5000), (8, "é" * 40 + " 中文\x85 ok"), (9, "A,b.c.. d!. E1."), (None, "no id")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", None) for i, t in ODD]
    extra = spark.createDataFrame(rows, SCHEMA)
    for name in ("kept", "score", "n_tokens", "_text", "id", "rule", "_stats", "_key", "slot", "fingerprint"):
        extra = extra.withColumn(name, F.lit("clash"))
    return extra


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in documents(spark, SF).collect()}


def plain_counts(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = {}
    for i in range(len(w) - 7):
        win.setdefault(tuple(w[i : i + 8]), []).append(i)
    at = {i + k for v in win.values() if len(v) > 1 for i in v for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(at)


def test_statistics_match_the_plain_version(texts):
    for t in [*texts.values(), *(t for _, t in ODD), "a b c d e f g h " * 3, "é ñ\nü\n\né ñ"]:
        assert statistics((t or "").encode())[:5] == plain_counts(t), t


def test_quality_rules(spark, odd, none):
    docs = documents(spark, SF)
    rules = op1.fit(docs, labels(spark, SF))
    out = op1.judge(docs, rules).join(labels(spark, SF), "doc_id").toPandas()
    left = out[~out.base_failed]
    assert (left.kept == (left.quality == 1)).mean() > 0.95
    assert out[(out.quality == 1) & ~out.base_failed].kept.mean() > 0.97
    got = op1.judge(odd, rules).collect()
    assert len(got) == len(ODD) and all(r.base_failed and not r.kept for r in got if r.n_words < 20)
    assert op1.judge(none, rules).count() == 0
    assert op1.fit(docs, labels(spark, SF).limit(0)) == [] and op1.judge(odd, []).where("kept").count() == 0
    assert op1.keep(odd, rules).columns == odd.columns


def test_decision_list_is_learned_and_pruned():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000), "noise": rng.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] < 0.5)
    rules = op1.learn(x, bad)
    hit = np.logical_or.reduce([r.holds(x) for r in rules])
    assert (hit == bad).mean() > 0.985 and all(t.feature != "noise" for r in rules for t in r.tests[:2])


def test_token_counts_and_the_cache(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op2.tokenizer_file())
    path = str(tmp_path / "cache")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in op2.token_counts(odd, path).collect())
    count = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    assert got == sorted((i or 0, len((x or "").encode()), count(x), count(x) > 512) for i, x in ODD)
    before = spark.read.parquet(path).count()
    assert before == len({x or "" for _, x in ODD})
    op2.token_counts(odd, path).collect()
    assert spark.read.parquet(path).count() == before  # nothing was missing the second time
    more = odd.unionByName(spark.createDataFrame([(77, "quite new", "en", "s", None)], SCHEMA), allowMissingColumns=True)
    op2.token_counts(more, path).collect()
    assert spark.read.parquet(path).count() == before + 1
    assert op2.token_counts(none, str(tmp_path / "empty")).count() == 0


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, odd, none, texts, tiktoken_encoding):
    codec = op5.codec(op5.rank_file(), op5.pattern())
    rng = random.Random(1)
    parts = ["a", " ", "\n", "don't", " x", "<|endoftext|>", "é", "1", "!", "  ", "\t", "中", "'s", "\x1c", "\x85", "\xa0", "aaaa", "🙂", "Ⅷ"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + list(texts.values())
    got = []
    for part in slices(pa.array(rows), 2000):
        ids = codec.encode(part)
        back = codec.decode(ids)
        got += [ids.row(i).tolist() for i in range(len(part))]
        assert [back.row(i).tobytes().decode() for i in range(len(part))] == part.to_pylist()
    assert got == [tiktoken_encoding.encode_ordinary(t) for t in rows]
    out = odd.select("doc_id", "text", op5.round_trip(F.col("text"), op5.rank_file(), op5.pattern()).alias("r")).collect()
    for r in out:
        ids = tiktoken_encoding.encode_ordinary(r.text or "")
        assert (r.r.n_tokens, r.r.ids_sha256, r.r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    both = odd.where("text is not null").select("text", op5.encode_ids(F.col("text"), op5.rank_file(), op5.pattern()).alias("ids")).select("text", op5.decode_ids(F.col("ids"), op5.rank_file(), op5.pattern()).alias("back"))
    assert all(r.text.encode() == bytes(r.back) for r in both.collect())
    assert none.select(op5.round_trip(F.col("text"), op5.rank_file(), op5.pattern())).count() == 0


def test_merge_replay_with_ranks_out_of_order():
    """A vocabulary in which a merge makes a pair of a lower rank, which then goes first."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"cd": 258, b"xab": 259, b"ab": 300}
    import tiktoken

    other = tiktoken.Encoding("odd", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
    replay = op5.MergeReplay(ranks)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdx") for _ in range(rng.randint(1, 12))) for _ in range(500)]
    assert replay.encode([w.encode() for w in words]) == [other.encode_ordinary(w) for w in words]


def test_packing(spark, odd, none):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = op7.pack(odd).toPandas()
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all() and g.length.sum() <= op7.CAPACITY
    want = []
    for i, x in ODD:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i or 0, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    got = [(0 if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()]
    assert sorted(got) == sorted(want)
    assert out.sequence_id.nunique() == -(-sum(w[3] for w in want) // 4096)
    assert op7.pack(none).count() == 0


def test_open_bins_are_bounded_and_best_fitting():
    bins = op7.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)] and bins.count == 0
    bins.place(3), bins.place(5 + 3), bins.place(9)
    assert bins.count == 2 and bins.by_free.get(1, []) == []  # the fullest was closed


def test_importance_resampling(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, marks = documents(spark, sf), labels(spark, sf)
    out = op8.select(docs, marks).join(marks, "doc_id").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.98 and out[out.quality == 0].kept.mean() < 0.15
    again = op8.select(docs.repartition(7), marks).toPandas().set_index("doc_id")
    assert (again.loc[out.doc_id].kept.to_numpy() == out.kept.to_numpy()).all()
    got = op8.select(odd, marks).collect()
    assert len(got) == len(ODD) and all(r.log_weight == 0 for r in got if not r.doc_id and r.doc_id is not None)
    assert op8.select(odd, marks.limit(0)).where("kept").count() == len(ODD)
    assert op8.select(none, marks).count() == 0 and op8.keep(odd, marks.limit(0)).columns == odd.columns


def test_kth_largest_is_exact(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0, 100), 5.0, 5.0]) for _ in range(9000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 17, 3000, 8999, 9000):
        assert op8.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_features_of_windows_and_pairs():
    rng = random.Random(3)
    rows = ["".join(rng.choice("ab c\n") for _ in range(rng.randint(0, 9))) for _ in range(300)] + ["", "éé"]
    bucket, n, same, pairs = op8.features(pa.array(rows, pa.large_string()))
    want, sizes, eq = [], [], []
    for t in rows:
        z = t.encode()
        w = [((int.from_bytes(z[i : i + 4], "big") * 2654435761) & 0xFFFFFFFF) >> 17 for i in range(len(z) - 3)]
        want += w
        sizes.append(len(w))
        k = t.split(" ")
        eq += [a == b for a, b in zip(k, k[1:])]
    assert bucket.tolist() == want and n.tolist() == sizes and same.tolist() == eq and pairs.sum() == len(eq)


def test_toxicity_held_out(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, marks = documents(spark, sf), labels(spark, sf)
    g = op4.fit(docs, marks)
    out = op4.score(docs, g).join(marks, "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in held.doc_id]).all()
    assert (held.predicted == held.toxic).mean() > 0.95 and held[held.toxic == 0].predicted.mean() < 0.02
    got = op4.score(odd, g).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert op4.score(none, g).count() == 0
    blank = op4.fit(docs, marks.limit(0))
    assert blank.stems == {} and op4.score(odd, blank).agg(F.max("score")).first()[0] < 1e-9


def test_clauses_not_words():
    w = lambda s: [(k, 3.0) for k in s]
    assert op4.clause_matches(w(["", "I"])) == [("plain", 3.0)]
    assert op4.clause_matches(w(["T", "", "I"])) == [("aimed", 3.0)] and op4.clause_matches(w(["I", "T"])) == [("aimed", 3.0)]
    assert op4.clause_matches(w(["N", "", "I"])) == [("negated", 3.0)] and op4.clause_matches(w(["N", *[""] * 9, "I"])) == [("plain", 3.0)]
    assert op4.clause_matches(w(["R", "I"])) == [("reported", 3.0)] and op4.clause_matches(w(["H"])) == []
    assert op4.clause_matches(w(["T", "H"])) == [("threat", 3.0)]


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 17, 64, 1000):
        p = op9.feistel(np.arange(n), n)
        assert sorted(p.tolist()) == list(range(n)) and (op9.feistel(p, n, inverse=True) == np.arange(n)).all()
    assert (op9.feistel(np.arange(1000), 1000, 1) != op9.feistel(np.arange(1000), 1000, 2)).mean() > 0.9


def test_training_order(spark, odd, none, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for i, x in ODD:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, op9.END_ID]
        want += [(i or 0, k, tuple(ids[s : s + 64])) for k, s in enumerate(range(0, len(ids), 64))]
    path = str(tmp_path / "shards")
    op9.write(odd, path, length=64, records=10)
    rows = spark.read.parquet(path).orderBy("shard").collect()
    got = []
    for r in rows:
        block = np.frombuffer(r.payload, "<u2").reshape(-1, 64)
        assert r.first_slot == r.shard * 10 and r.stride == 128 and hashlib.sha256(r.payload).hexdigest() == r.sha256
        got += [(d or 0, p, tuple(block[k, :n].tolist())) for k, (d, p, n) in enumerate(zip(r.doc_ids, r.pieces, r.lengths))]
    assert sorted(got) == sorted(want) and got != sorted(got)
    mid = {r.slot: tuple(r.ids) for r in op9.read(spark, path, 7, 25, records=10).collect()}
    assert mid == {s: got[s][2] for s in range(7, 32)}
    assert op9.shards(none).count() == 0


def test_gear_hash_and_boundaries():
    data = bytes(random.Random(4).randbytes(3000))
    x, want = 0, []
    for b in data:
        x = ((x << 1) + int(op10.GEAR[b])) & 0xFFFFFFFF
        want.append(x)
    assert op10.gear_hashes(data).tolist() == want
    ends = op10.chunk_ends(data)
    assert ends[-1] == len(data) and all(op10.LEAST <= b - a <= op10.MOST for a, b in zip([0, *ends[:-2]], ends[:-1]))
    shifted = op10.chunks(b"some words before " + data)
    assert op10.likeness(op10.chunks(data), shifted) > 0.9  # boundaries shift with the text
    assert op10.likeness({}, {}) == 1.0 and op10.likeness({}, {"a": 1}) == 0.0 == op10.likeness({"a": 1}, {})


def test_fingerprints(spark, odd, none):
    docs = documents(spark, SF)
    for df, rows in ((docs.repartition(3), [(r.doc_id, r.text) for r in docs.collect()]), (odd, ODD)):
        key = lambda r: (r[0] is None, -(r[0] or 0), r[1] or "")
        rows = sorted(((i, t or "") for i, t in rows), key=key)
        got = sorted((tuple(r) for r in op10.with_next(df).collect()), key=lambda r: (r[0] is None, -(r[0] or 0), str(r)))
        want = []
        for k, (i, t) in enumerate(rows):
            following = rows[(k + 1) % len(rows)][1]
            half = len(t) // 2
            e = t[: len(t) - half] + following[:half]
            a, b, c = (op10.chunks(x.encode()) for x in (t, e, following))
            want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), op10.written(a), op10.written(b), op10.likeness(a, b), op10.likeness(a, c)))
        assert got == sorted(want, key=lambda r: (r[0] is None, -(r[0] or 0), str(r)))
    assert op10.with_next(none).count() == 0
    one = spark.createDataFrame([(1, "alone here, with a few words", "en", "s", 1)], SCHEMA)
    assert op10.with_next(one).first().near_next == 1.0


def test_fingerprints_of_repeated_and_null_ids_over_many_ranges(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(30)]
    rows = [(rng.choice([None] * 30 + [5] * 30 + list(range(40))), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted(((i or -1), hashlib.sha256((t[: len(t) - len(t) // 2] + rows[(k + 1) % len(rows)][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(rows))
    assert sorted((-1 if r.doc_id is None else r.doc_id or -1, r.edited_sha256) for r in op10.with_next(df, partitions=9).collect()) == want
    begin = df.select(F.col("doc_id").alias("id"), F.substring("text", 1, op10.BEGIN).alias("begin"))
    range_of, n = op10._ranges(begin, 9)
    counts = {r.r: r.n for r in begin.where("id is null").groupBy(range_of("id", "begin").alias("r")).agg(F.count("*").alias("n")).collect()}
    assert len(counts) > 2 and max(counts) < n  # null ids are dealt out as well


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_a_rule_list_is_learned_at_every_size(spark, sf):
    docs, marks = documents(spark, f"/root/testdata/{sf}"), labels(spark, f"/root/testdata/{sf}")
    rules = op1.fit(docs, marks)
    assert rules
    out = op1.judge(docs, rules).join(marks, "doc_id").toPandas()
    left = out[~out.base_failed]
    assert left[left.quality == 0].kept.mean() < 0.2 and left[left.quality == 1].kept.mean() > 0.97


def test_verdicts_of_the_rules_equal_a_plain_version(spark):
    """Base rule at its bounds, repeated and null ids, and the ordered list, through judge."""
    word = "abcd efgh ijkl mnop qrst uvwx yzab cdef"
    loop = [f"u{i}" for i in range(37)]
    rows = [(1, " ".join(f"w{i}" for i in range(19))), (2, " ".join(f"w{i}" for i in range(20))), (3, f"{word} {word} " + " ".join(loop)), (4, f"{word} {word} " + " ".join([*loop, "one"])), (4, "# " * 40), (None, " ".join(f"x{i}" for i in range(30)) + " $$"), (5, None), (6, "long " * 30_000 + " ".join(f"y{i}" for i in range(90_000)))]
    rules = [op1.Rule((op1.Test("symbol_share", True, 0.5),), 1.0, 1), op1.Rule((op1.Test("n_words", True, 31.0), op1.Test("symbol_share", True, 0.01)), 1.0, 1)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    want = []
    for i, t in rows:
        n, chars, symbols, dup, rep = plain_counts(t)
        failed = n < 20 or 100 * rep > 30 * n
        share = symbols / max(chars, 1)
        rule = 1 if share >= 0.5 else 2 if n >= 31 and share >= 0.01 else 0
        want.append((i or 0, n, chars, symbols, dup, rep, failed, rule, not failed and rule == 0))
    got = [(r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.rule, r.kept) for r in op1.judge(df, rules).collect()]
    assert sorted(got) == sorted(want)


def plain_kinds(clause):
    """Kinds of the matches of one clause, straight from the definition."""
    out = []
    for k, x in enumerate(clause):
        if x not in ("I", "H"):
            continue
        before = clause[:k]
        reported = "R" in before
        first_report = before.index("R") if reported else len(before)
        negated = not reported and any(y == "N" and k - j <= op4.REACH for j, y in enumerate(before[:first_report]))
        aimed = "T" in clause[:k] + clause[k + 1 :]
        if reported or negated:
            out += [("reported" if reported else "negated")] if x == "I" else []
        elif x == "I":
            out.append("aimed" if aimed else "plain")
        elif aimed:
            out.append("threat")
    return out


def test_composed_transducers_equal_the_definition():
    import itertools

    for n in range(6):
        for clause in itertools.product(("", "T", "N", "R", "I", "H"), repeat=n):
            assert [k for k, _ in op4.clause_matches([(x, 1.0) for x in clause])] == plain_kinds(list(clause)), clause
    one, two = op4._scope(), op4._kind()
    both = op4.compose(one, two)
    rng = random.Random(3)
    for _ in range(300):
        x = [rng.choice(op4.CLASSES) for _ in range(rng.randint(0, 20))]
        assert both.run(x) == two.run(one.run(x))


def plain_features(stems, text):
    import re

    total = dict.fromkeys(op4.KINDS, 0.0)
    low = text.lower()
    for clause in re.split(r"[.!?;:,\n|]+", low):
        classes, weights = [], []
        for w in re.findall(r"(?<![\w'])[^\W\d_][\w']*", clause):
            found = [v for s, v in stems.items() if (w == s[:-1] if s.endswith(" ") else w.startswith(s))]
            classes.append("I" if found else op4._CLASS.get(w, ""))
            weights.append(max(found) if found else 1.0)
        kinds = iter(plain_kinds(classes))
        at = [k for k, x in enumerate(classes) if x in ("I", "H")]
        said = op4.clause_matches([(x, w) for x, w in zip(classes, weights)])
        assert [k for k, _ in said] == list(kinds) and len(said) <= len(at)
        for k, w in said:
            total[k] += w
    each = [min(op4.MOST, x) for x in total.values()]
    return [*each, min(op4.MOST, 100 * sum(total.values()) / (len(low.split()) + 20)) if sum(total.values()) else 0.0]


def test_matcher_equals_a_plain_scan():
    stems = {"zork": 2.0, "zorkist ": 3.5, "blim ": 1.5}
    m = op4.Matcher(stems)
    rng = random.Random(9)
    parts = ["zork", "zorks", "Zorkist", "blim", "blimp", "ablim", "you", "not", "said", "kill", "the", "house", "é", "don't", "9blim", "x_blim"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", " ", ", ", ". ", "\n", "\t", "!"]) for _ in range(rng.randint(0, 14)))
        got = m.features(text)
        want = plain_features(stems, text)
        assert got[:-1] == pytest.approx(want[:-1]), text
        assert got[-1] == pytest.approx(want[-1]) or not sum(want[:-1]), text
    assert op4.Matcher(stems).features("zork " * 200_000)[0] == op4.MOST


def test_clauses_change_verdicts(spark):
    docs, marks = documents(spark, "/root/testdata/sf0.01"), labels(spark, "/root/testdata/sf0.01")
    g = op4.fit(docs, marks)
    weight = dict(zip(op4.KINDS, g.kinds))
    assert weight["negated"] < 0.5 * weight["plain"] and weight["reported"] < 0.7 * weight["plain"]
    insult = max((s for s in g.stems if s.endswith(" ") or len(s) > 3), key=lambda s: g.stems[s]).strip()
    rows = [(1, f"the {insult} is here. an {insult} was that"), (2, f"the man is not an {insult}. nor was that an {insult}"), (3, f"he said {insult}. the report says {insult}")]
    got = {r.doc_id: r.score for r in op4.score(spark.createDataFrame(rows, "doc_id bigint, text string"), g).collect()}
    assert got[1] >= op4.THRESHOLD > max(got[2], got[3])


def test_importance_selection_equals_a_plain_version(spark):
    docs, marks = documents(spark, SF), labels(spark, SF)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()] + [(None, "no id"), (None, ""), (0, "again " * 40)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labelled = {}
    for r in marks.collect():
        labelled[r.doc_id] = min(labelled.get(r.doc_id, 1), r.quality)

    def events(text):
        z = text.encode()
        w = [((int.from_bytes(z[i : i + 4], "big") * 2654435761) & 0xFFFFFFFF) >> 17 for i in range(len(z) - 3)]
        k = text.split(" ")
        return w + [op8.BUCKETS + (a == b) for a, b in zip(k, k[1:])]

    raw, target = np.zeros(op8.N_FEATURES), np.zeros(op8.N_FEATURES)
    seen = [np.bincount(np.array(events(t), np.int64), minlength=op8.N_FEATURES) for _, t in rows]
    for (i, _), e in zip(rows, seen):
        raw += e
        target += e * (labelled.get(i) == 1)
    ratio = np.zeros(op8.N_FEATURES)
    for part in (slice(0, op8.BUCKETS), slice(op8.BUCKETS, None)):
        t, r = target[part] + op8.SMOOTHING, raw[part] + op8.SMOOTHING
        ratio[part] = np.log(t / t.sum() / (r / r.sum()))
    mean = [round(float(e @ ratio / (e.sum() + op8.DAMPING)), 9) for e in seen]
    good = {}
    for (i, _), m in zip(rows, mean):
        if labelled.get(i) == 1:
            good[i] = min(m, good.get(i, m))
    low, first, third = np.quantile(list(good.values()), [op8.QUANTILE, 0.25, 0.75], method="inverted_cdf")
    factor = 1.349 / (third - first)
    got = op8.select(df, marks).collect()
    weights = sorted(round(m * factor, 3) for m in mean)
    assert sorted(round(r.log_weight, 3) for r in got) == pytest.approx(weights, abs=2e-3)
    k = sum(r.log_weight >= low * factor - op8.SLACK for r in got)
    least = sorted((r.perturbed for r in got), reverse=True)[k - 1]
    assert all(r.kept == (r.perturbed >= least) for r in got)
    noise = {r.doc_id: r.g for r in df.where("doc_id is not null").select("doc_id", op8.gumbel(F.col("doc_id")).alias("g")).collect()}
    assert all(abs(r.perturbed - r.log_weight - noise[r.doc_id]) < 3e-6 for r in got if r.doc_id is not None)
    assert np.subtract(*np.quantile([m * factor for m in good.values()], [0.75, 0.25])) == pytest.approx(1.349, abs=0.2)  # the target spreads as noise does
