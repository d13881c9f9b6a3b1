"""Toxicity: a weighted finite-state pattern grammar over clauses.

Transducers are composed. The lexical one maps words to classes: insult, threat, target, negation, reported speech. Insult
stems, with weights, are learned from labelled rows, as whole words or as beginnings of words; the other classes are short
fixed lists. A transducer that reads a clause from its end marks insults and threats that a target follows. Two more read it
from its beginning and are composed into one: the first keeps whether negation or report holds and marks what stands
within it, the second keeps whether a target has been named and turns each mark into an output: the kind of match. So matches
are scored by clause, as plain, aimed at someone, negated, reported or a threat, and not as isolated words. A logistic
model, fitted on the labelled rows, weighs the kinds; it is drawn towards weights of their own (CENTRES), by which negated
and reported insults say little as long as labels do not say otherwise.

Only labelled rows whose crc32 of the id as text is not 1 modulo 3 are learned from, at most SAMPLE_ROWS of them. A score
depends on the text alone. A text without any match is not read word by word: one automaton finds the stems.

Cases: null and empty texts have no matches and the base score; repeated rows are each returned; without labels of both
values there are no stems and every score is 0; an empty table gives an empty result; a very long text is one text, whose sums
saturate; extra columns are never read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import documents, labels, stored, text_or_empty

#: Labelled rows that a fit uses at most; those of them for the weights of the kinds.
SAMPLE_ROWS, WEIGHT_ROWS = 20_000, 6_000
THRESHOLD = 0.7
#: Lengths of word beginnings that may become stems; a stem is learned from at least MIN_TOXIC toxic texts, of MIN_SHARE of all that have it.
STEM_LENGTHS, MIN_TOXIC, MIN_SHARE = range(3, 11), 4, 0.35
#: Least log likelihood ratio of a stem against chance, and of a longer stem against the shorter one that it begins with.
CHANCE, REFINED = 14.0, 7.0
#: Stems that a task counts before it hands them on.
FLUSH = 200_000
#: Where the weight of one kind in a text saturates: more says no more.
MOST = 30.0

#: Closed classes of the grammar in English, German, French and Spanish.
THREATS = frozenset("kill killing hurt destroy murder stab shoot beat töten umbringen vernichten tuer tuerai détruire matar mataré destruir".split())
TARGETS = frozenset("you your yourself u he she they them him her his their du dich dir dein ihr euch er sie tu toi te ton ta vous votre il elle ils elles tú te ti usted vosotros ellos ellas".split())
NEGATIONS = frozenset("not never no nor neither cannot don't isn't aren't wasn't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún ninguna tampoco".split())
REPORTS = frozenset("said says say reported reports quoted quote wrote writes called calls claimed alleged sagte sagt schrieb berichtete behauptete dit écrit rapporte appelé dijo dice escribió llamó".split())

KINDS = ("plain", "aimed", "negated", "reported", "threat")
#: Of a text: weights of the matches of each kind, and of all for each hundred words.
FEATURES = (*KINDS, "density")
#: Weights that the fit is drawn towards.
CENTRES = (0.8, 0.9, 0.1, 0.3, 0.9, 0.1)
_CLAUSE = re.compile(r"[.!?;:,\n|]+")
#: A word begins where no letter, digit, underscore or apostrophe stands before it.
_WORD = re.compile(r"(?<![\w'])[^\W\d_][\w']*")
_CLASS = {w: c for c, words in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("H", THREATS)) for w in words}
#: Words that a negation holds for.
REACH = 4
#: Classes of words: none, target, negation, report, insult, threat; insult and threat with a target after them.
CLASSES = ("", "T", "N", "R", "I", "H", "It", "Ht")


@dataclass(frozen=True)
class Transducer:
    """A sequential transducer: arcs map (state, input) to (next state, output)."""

    start: object
    arcs: dict

    def run(self, symbols: list) -> list:
        state, out, arcs = self.start, [], self.arcs
        for x in symbols:
            state, y = arcs[state, x]
            out.append(y)
        return out


def compose(first: Transducer, then: Transducer) -> Transducer:
    """One machine that does what `then` makes of the output of `first`; only pairs of states that can be reached are made."""
    start = (first.start, then.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        p, q = todo.pop()
        for (state, x), (p2, mid) in first.arcs.items():
            if state == p:
                q2, y = then.arcs[q, mid]
                arcs[(p, q), x] = ((p2, q2), y)
                if (p2, q2) not in seen:
                    seen.add((p2, q2))
                    todo.append((p2, q2))
    return Transducer(start, arcs)


def _scope() -> Transducer:
    """Marks insults and threats as negated or reported. States: words that a negation still holds for, or "reported"."""
    arcs = {}
    for state in (*range(REACH + 1), "reported"):
        for x in CLASSES:
            passed = state if state == "reported" else max(0, state - 1)
            if x == "N" and state != "reported":
                arcs[state, x] = (REACH, x)
            elif x == "R":
                arcs[state, x] = ("reported", x)
            elif x[:1] in ("I", "H"):
                arcs[state, x] = (passed, x + ("r" if state == "reported" else "n" if state else ""))
            else:
                arcs[state, x] = (passed, x)
    return Transducer(0, arcs)


def _kind() -> Transducer:
    """Turns marked insults and threats into kinds of matches, "" for none. States: whether a target has been named."""
    arcs = {}
    for named in (False, True):
        for x in ("", "T", "N", "R"):
            arcs[named, x] = (named or x == "T", "")
        for after in ("", "t"):
            aimed = named or bool(after)
            for mark, insult, threat in (("", "aimed" if aimed else "plain", "threat" if aimed else ""), ("n", "negated", ""), ("r", "reported", "")):
                arcs[named, f"I{after}{mark}"] = (named, insult)
                arcs[named, f"H{after}{mark}"] = (named, threat)
    return Transducer(False, arcs)


#: Read from the end: insults and threats that a target follows.
FOLLOWED = Transducer(False, {(t, x): (t or x == "T", x + "t" if t and x in ("I", "H") else x) for t in (False, True) for x in ("", "T", "N", "R", "I", "H")})
CLAUSAL = compose(_scope(), _kind())


@dataclass(frozen=True)
class Grammar:
    """stems: a stem to its weight (log odds), ending in a space if it is a whole word; kinds: weights of the kinds; bias."""

    stems: dict[str, float]
    kinds: tuple[float, ...]
    bias: float


def clause_matches(words: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Runs the clausal transducers over one clause of (class or '', weight): outputs with weights."""
    classes = FOLLOWED.run([k for k, _ in reversed(words)])[::-1]
    return [(kind, w) for kind, (_, w) in zip(CLAUSAL.run(classes), words, strict=True) if kind]


class Matcher:
    """The lexical transducer and the clauses around its insults and threats."""

    def __init__(self, stems: dict[str, float]):
        import ahocorasick

        self.stems = stems
        self.automaton = ahocorasick.Automaton()
        for s in stems:
            self.automaton.add_word(s.rstrip(" "), s)
        for w in THREATS:
            self.automaton.add_word(w, w)
        self.automaton.make_automaton()
        self.lengths = sorted({len(s) for s in stems if not s.endswith(" ")})

    def weight(self, word: str) -> float | None:
        """Of the longest stem that holds."""
        found = self.stems.get(f"{word} ")
        for n in self.lengths:
            if n <= len(word) and (w := self.stems.get(word[:n])) is not None and (found is None or w > found):
                found = w
        return found

    def features(self, text: str) -> list[float]:
        """The FEATURES of a text."""
        total = [0.0] * len(FEATURES)
        low = text.lower()
        last = -1
        for end, found in self.automaton.iter(low):
            begin = end + 1 - len(found.rstrip(" "))
            if end <= last or begin and (low[begin - 1].isalnum() or low[begin - 1] in "_'"):
                continue
            # the clause around the match
            left = begin
            while left > 0 and low[left - 1] not in ".!?;:,\n|":
                left -= 1
            stop = _CLAUSE.search(low, end)
            last = stop.start() if stop else len(low)
            words = []
            for w in _WORD.findall(low[left:last]):
                insult = self.weight(w)
                words.append(("I", insult) if insult is not None else (_CLASS.get(w, ""), 1.0))
            for kind, weight in clause_matches(words):
                total[KINDS.index(kind)] += weight
        if last >= 0:
            total[-1] = min(MOST, 100 * sum(total) / (len(low.split()) + 20))
        return [min(MOST, x) for x in total]


def probability(x: np.ndarray, kinds: tuple[float, ...], bias: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(kinds) + bias, -40, 40)))


def learnable(marked: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return marked.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 3 != 1))


def near_copy_key(text: Column) -> Column:
    """Column: the least hash of four words in a row; copies and most near copies of a text share it."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            keys = []
            for t in batch.cast(pa.binary()):
                w = (t.as_py() or b"").split()
                keys.append(min((zlib.crc32(b" ".join(w[i : i + 4])) for i in range(max(1, len(w) - 3)))))
            yield pa.array(keys, pa.int64())

    return F.arrow_udf(run, "bigint")(text)


def fit(docs: DataFrame, marked: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """Learns stems and weights. Words are counted by Spark; only stems that pass, and features of WEIGHT_ROWS rows, reach the driver."""
    sample = learnable(marked, id_col, label_col).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).join(F.broadcast(sample), "_id")  # at most sample_rows rows
    rows = stored(rows.select("_label", "_text", near_copy_key(F.col("_text")).alias("_copy")), "toxicity-sample")

    def stems(batches):
        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())], names=["stem", "n"])
            counter.clear()
            return made

        counter: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                found = set()
                for w in set(_WORD.findall(text.as_py().lower())):
                    found.add(f"{w} ")
                    found.update(w[:n] for n in STEM_LENGTHS if n <= len(w))
                counter.update(found)
                if len(counter) > FLUSH:
                    yield flush()
        yield flush()

    # near copies of a text count once
    toxic = rows.where("_label = 1").dropDuplicates(["_copy"]).select("_text").mapInArrow(stems, "stem string, n bigint").groupBy("stem").agg(F.sum("n").alias("toxic")).where(F.col("toxic") >= MIN_TOXIC)
    clean = rows.where("_label = 0").dropDuplicates(["_copy"]).select("_text").mapInArrow(stems, "stem string, n bigint").groupBy("stem").agg(F.sum("n").alias("clean"))
    found = toxic.join(clean, "stem", "left").select("stem", "toxic", F.coalesce("clean", F.lit(0)).alias("clean"))
    n = {r._label: r.n for r in rows.groupBy("_label").agg(F.countDistinct("_copy").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Grammar({}, (0.0,) * len(FEATURES), -40.0)
    t, c, base = F.col("toxic"), F.col("clean"), n[1] / (n[0] + n[1])
    ratio = t * F.log(t / (t + c) / base) + c * F.log((c + 0.5) / (t + c + 0.5) / (1 - base))
    best = found.where(t >= MIN_SHARE * (t + c)).where(ratio >= CHANCE / 2).orderBy(ratio.desc(), "stem").collect()  # of a bounded sample
    chosen = choose(best, n[1], n[0])
    some = rows.withColumn("_r", F.xxhash64("_copy", F.lit(5))).orderBy("_r", "_label").limit(WEIGHT_ROWS).select("_label", kind_features(F.col("_text"), chosen).alias("x")).collect()
    x, y = np.array([r.x for r in some], float).reshape(len(some), len(FEATURES)), np.array([r._label for r in some])
    kinds, bias = logistic(x, y)
    return Grammar(chosen, kinds, bias)


def surprise(t: int, c: int, base: float) -> float:
    """Log likelihood ratio of t toxic and c clean texts against a share of base toxic ones."""
    share = t / (t + c)
    return t * math.log(share / base) + (c * math.log((1 - share) / (1 - base)) if c else 0.0)


def choose(found: list, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Stems that chance does not explain, short ones first; a longer one only if it says more than the one it begins with. The weight is the log odds over those of any text."""
    by = {r.stem: (r.toxic, r.clean) for r in found}
    # of stems of nearly the same texts only the longest, which reaches the fewest other words
    for long in list(by):
        word = long.rstrip(" ")
        for n in STEM_LENGTHS:
            short = word[:n]
            if short != long and n <= len(word) and short in by and long in by and by[long][0] >= 0.93 * by[short][0]:
                del by[short]
    chosen: dict[str, float] = {}
    shares: dict[str, float] = {}
    for s, (t, c) in sorted(by.items(), key=lambda kv: (len(kv[0]), kv[0])):
        if surprise(t, c, n_toxic / (n_toxic + n_clean)) < CHANCE:
            continue
        word = s.rstrip(" ")
        short = max((shares[word[:n]] for n in STEM_LENGTHS if n <= len(word) and word[:n] in shares and word[:n] != s), default=None)
        if short is not None and (t / (t + c) <= short or surprise(t, c, min(short, 0.99)) < REFINED):
            continue
        shares[s] = t / (t + c)
        chosen[s] = math.log((t + 0.5) / (c + 0.5)) - math.log(n_toxic / n_clean)
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, *, ridge: float = 0.02, steps: int = 60) -> tuple[tuple[float, ...], float]:
    """Newton's method with a ridge that draws weights towards CENTRES, and no weight below 0."""
    z = np.column_stack([x, np.ones(len(x))])
    centre = np.array([*CENTRES, -3.0])
    w = centre.copy()
    pull = ridge * len(y) ** 0.5

    def loss(v: np.ndarray) -> float:
        u = z @ v
        return float((np.logaddexp(0, u) - y * u).sum() + pull / 2 * ((v - centre) ** 2).sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull * np.eye(len(w)), z.T @ (p - y) + pull * (w - centre))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(np.maximum(w[:-1], 0).tolist()), float(w[-1])


_MATCHERS: dict[int, tuple[dict, Matcher]] = {}


def matcher(stems: dict[str, float]) -> Matcher:
    key = hash(frozenset(stems.items()))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = (stems, Matcher(stems))
    return _MATCHERS[key][1]


def kind_features(text: Column, stems: dict[str, float]) -> Column:
    """Column array<double>: the FEATURES of a text column."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = matcher(stems)
        for batch in batches:
            yield pa.array([m.features(t.as_py() or "") for t in batch], pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>").asNondeterministic()(text)


def toxicity(text: Column, grammar: Grammar) -> Column:
    """Column of the score of a text column, from 0 to 1."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = matcher(grammar.stems)
        for batch in batches:
            x = np.array([m.features(t.as_py() or "") for t in batch], float).reshape(len(batch), len(FEATURES))
            yield pa.array(np.round(probability(x, grammar.kinds, grammar.bias), 9), pa.float64())

    return F.arrow_udf(run, "double").asNondeterministic()(text)


def score(docs: DataFrame, grammar: Grammar, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted."""
    scored = docs.select(F.col(id_col), (F.crc32(F.col(id_col).cast("string")) % 3 == 1).alias("held_out"), toxicity(F.col(text_col), grammar).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, labels(spark, sf_dir)))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE_SQL: dict[str, str] = {}
