"""Presentation model of anchors: residue shares of each allele, drawn towards its likes and its own other lengths, and the scores they give.

A panel (epitope, allele, weight) is counted once, by anchor, length, allele and residue. All that follows is on that table,
whose size is that of the panel's alleles and lengths, not of its rows: shares are drawn towards the kernel-weighted counts of
similar alleles, those of one length towards the allele's shares over all lengths. A model is one map of log odds for each
allele and length, so that scoring any number of peptides is one join by (allele, length) and an expression. In class II the
register is learned by assigning every row to its best frame and counting again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators.rounds import Rounds

#: Anchors by class, of the pockets and of the whole core; 1-based, from the end where negative; in class II within the core of nine.
ANCHORS = {"mhc1": (1, 2, 3, -2, -1), "mhc2": (1, 4, 6, 9)}
CORE = {"mhc1": (1, 2, 3, 4, 5, -4, -3, -2, -1), "mhc2": (1, 2, 3, 4, 5, 6, 7, 8, 9)}
WIDTH = 9
#: Prior strength where it cannot be fitted, its bounds, rows and alleles that a fit needs; regulariser of log odds; share of a
#: residue that a background does not list; what each frame adds to the counts of starts; rounds after which registers stop moving at the latest.
TAU, TAU_LEAST, TAU_MOST, RICH, RICH_ALLELES = 10.0, 0.05, 1e3, 200, 3
EPS, UNLISTED, START_ADDED, MOST_ROUNDS = 1e-3, 1e-4, 0.5, 64
#: Stands for residues that no row of an anchor has.
OTHER = "*"


def places(pep: str | Column, anchors: Sequence[int]) -> Column:
    """array<struct<anchor, at>>: the index of each signed anchor; the first anchor to claim an index keeps it, later ones are left out; null for a string that some anchor does not fit."""
    n = F.length(F.col(pep) if isinstance(pep, str) else pep)
    parts = []
    for i, j in enumerate(anchors):
        lost = [max(j, e) - 1 - min(j, e) for e in anchors[:i] if (e > 0) != (j > 0)]
        here = F.struct(F.lit(j).alias("anchor"), (F.lit(j - 1) if j > 0 else n + j).alias("at"))
        parts.append(F.when(~n.isin(lost), here) if lost else here)
    return F.when(n >= max(map(abs, anchors)), F.filter(F.array(*parts), lambda p: p.isNotNull()))


def anchor_counts(panel: DataFrame, anchors: Sequence[int], *, pep: str = "epitope", group: str = "allele", weight: str | None = None, start: str | None = None) -> DataFrame:
    """anchor, length, allele, residue, cnt. With start, anchors are places of a core that begins there, and length is 0."""
    if start:
        at = F.array(*(F.struct(F.lit(j).alias("anchor"), (F.col(start) + j - 1).alias("at")) for j in anchors))
        rows, length = panel.where((F.col(start) >= 0) & (F.col(start) + WIDTH <= F.length(pep))), F.lit(0)
    else:
        rows, at, length = panel, places(pep, anchors), F.length(pep)
    each = rows.select(F.col(group).alias("allele"), F.col(pep).alias("_p"), length.alias("length"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"), F.explode(at).alias("_a"))
    return each.groupBy(F.col("_a.anchor").alias("anchor"), "length", "allele", F.substring(F.col("_p"), F.col("_a.at") + 1, F.lit(1)).alias("residue")).agg(F.sum("_w").alias("cnt"))


def pseudocounts(counts: DataFrame, conditional: DataFrame, beta: float) -> DataFrame:
    """counts with each allele's residues spread over their likes by beta / (n + beta) of their mass; conditional: seen, residue, p. Residues that it lacks keep their mass, and sums stay."""
    keys = ["anchor", "length", "allele"]
    part = F.lit(beta) / (F.sum("cnt").over(Window.partitionBy(*keys)) + beta)
    rows = counts.withColumn("_w", part)
    table = conditional.select(F.col("seen").alias("residue"), F.col("residue").alias("_to"), "p")
    moved = rows.join(table, "residue", "left").select(*keys, F.coalesce("_to", "residue").alias("residue"), (F.col("_w") * F.col("cnt") * F.coalesce("p", F.lit(1.0))).alias("cnt"))
    return rows.select(*keys, "residue", ((1 - F.col("_w")) * F.col("cnt")).alias("cnt")).unionByName(moved).groupBy(*keys, "residue").agg(F.sum("cnt").alias("cnt"))


def pooled(counts: DataFrame) -> DataFrame:
    """counts over all lengths: anchor, allele, residue, cnt."""
    return counts.groupBy("anchor", "allele", "residue").agg(F.sum("cnt").alias("cnt"))


def fitted_tau(counts: DataFrame, anchors: Sequence[int], *, rich: float = RICH, alleles: int = RICH_ALLELES) -> dict[int, float]:
    """Prior strength of each anchor by moments over its well-sampled alleles: sum of m (1 - m) by the variance between alleles, less 1. One number for each anchor comes to the driver."""
    w = Window.partitionBy("anchor", "allele")
    own = pooled(counts).withColumn("n", F.sum("cnt").over(w)).where(F.col("n") >= rich)
    standard = own.where(F.col("residue").isin(*S.RESIDUES)).groupBy("anchor", "residue").agg(F.sum("cnt").alias("c"), F.sum(F.col("cnt") / F.col("n")).alias("s"), F.sum(F.pow(F.col("cnt") / F.col("n"), 2)).alias("q"))
    sizes = own.select("anchor", "allele", "n").distinct().groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    m = F.col("c") / F.col("total")
    # alleles that lack a residue have share 0: their (0 - m)^2 is in k m^2
    spread = F.greatest((F.col("q") - 2 * m * F.col("s") + F.col("k") * m * m) / F.col("k"), F.lit(0.0))
    found = standard.join(sizes, "anchor").groupBy("anchor").agg(F.max("k").alias("k"), F.sum(m * (1 - m)).alias("num"), F.sum(spread).alias("var"))
    tau = F.when(F.col("var") > 0, F.least(F.lit(TAU_MOST), F.greatest(F.lit(TAU_LEAST), F.col("num") / F.col("var") - 1))).otherwise(TAU_MOST)
    known = {r.anchor: r.tau for r in found.where(F.col("k") >= alleles).select("anchor", tau.alias("tau")).collect()}
    return {j: known.get(j, TAU) for j in anchors}


def _tau(tau: float | dict[int, float]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in tau.items() for x in kv)), F.col("anchor")) if isinstance(tau, dict) else F.lit(float(tau))


def shrunk(counts: DataFrame, kernel: DataFrame, keys: Sequence[str], tau: Column | float, value: str = "residue") -> DataFrame:
    """keys, allele, value, n, p = (cnt + tau m) / (n + tau): an allele's own counts drawn towards the kernel-weighted shares m of its likes.

    kernel: allele, other, k, and anchor where it differs between anchors. An allele without counts takes the shares of its likes,
    n being 0; one without likes keeps its own.
    """
    by = [c for c in ("anchor",) if c in kernel.columns and c in keys]
    near = kernel.where("k > 0 AND allele <> other").join(counts.withColumnRenamed("allele", "other"), [*by, "other"]).select(*keys, "allele", value, F.lit(0.0).alias("cnt"), (F.col("k") * F.col("cnt")).alias("m"))
    both = counts.select(*keys, "allele", value, F.col("cnt").cast("double").alias("cnt"), F.lit(0.0).alias("m")).unionByName(near).groupBy(*keys, "allele", value).agg(F.sum("cnt").alias("cnt"), F.sum("m").alias("m"))
    w = Window.partitionBy(*keys, "allele")
    n, m = F.sum("cnt").over(w), F.sum("m").over(w)
    t = tau if isinstance(tau, Column) else F.lit(float(tau))
    p = (F.col("cnt") + F.when(m > 0, t * F.col("m") / m).otherwise(0.0)) / (n + F.when(m > 0, t).otherwise(0.0))
    return both.select(*keys, "allele", value, n.alias("n"), p.alias("p"))


def distributions(counts: DataFrame, kernel: DataFrame, tau: float | dict[int, float], *, by_length: bool = True) -> DataFrame:
    """anchor, length, allele, residue, p. Rows of length 0 are shares over all lengths; a length stands where the allele has rows of it.

    First stage: an allele's counts towards those of its likes, over all lengths and at each length. Second: its shares at a length
    towards its own over all lengths, theta = (n p_length + tau p) / (n + tau).
    """
    t = _tau(tau)
    over_all = shrunk(pooled(counts), kernel, ["anchor"], t)
    out = over_all.select("anchor", F.lit(0).alias("length"), "allele", "residue", "p")
    if not by_length:
        return out
    at = shrunk(counts, kernel, ["anchor", "length"], t).where("n > 0")
    sizes = at.select("anchor", "length", "allele", "n").distinct()
    back = sizes.join(over_all.select("anchor", "allele", "residue", F.col("p").alias("m")), ["anchor", "allele"]).select("anchor", "length", "allele", "residue", "n", F.lit(0.0).alias("p"), "m")
    both = at.select("anchor", "length", "allele", "residue", "n", "p", F.lit(0.0).alias("m")).unionByName(back)
    theta = both.groupBy("anchor", "length", "allele", "residue").agg(F.max("n").alias("n"), F.sum("p").alias("p"), F.sum("m").alias("m"))
    return out.unionByName(theta.select("anchor", "length", "allele", "residue", ((F.col("n") * F.col("p") + t * F.col("m")) / (F.col("n") + t)).alias("p")))


def length_terms(panel: DataFrame, kernel: DataFrame, lengths: Sequence[int], tau: float = TAU, *, pep: str = "epitope", weight: str | None = None, eps: float = EPS) -> DataFrame:
    """allele, length, term: ln of an allele's share of a length, drawn towards its likes, by an even share of the given lengths."""
    counts = panel.groupBy("allele", F.length(pep).alias("length")).agg(F.sum(F.col(weight).cast("double") if weight else F.lit(1.0)).alias("cnt"))
    common = kernel.drop("anchor").distinct()
    seen = shrunk(counts, common, [], tau, "length")
    all_ = seen.select("allele").distinct().withColumn("length", F.explode(F.array(*map(F.lit, lengths))))
    return all_.join(seen, ["allele", "length"], "left").select("allele", "length", F.ln((F.coalesce("p", F.lit(0.0)) + eps) / (1.0 / len(lengths) + eps)).alias("term"))


def models(shares: DataFrame, counts: DataFrame, lengths: Sequence[int], *, background: DataFrame | None = None, conditional: bool = False, terms: DataFrame | None = None, rare: DataFrame | None = None, primary: Sequence[int] = (), eps: float = EPS) -> DataFrame:
    """allele, length, table map<string, double>, term: log odds ln((p + eps) / (b + eps)) by "anchor:residue".

    b is the share of the residue at the anchor over all alleles, or in `background` (residue, bg), or, with conditional, left out,
    for a background that depends on the residue before (see transitions). terms: allele, length, term. rare (allele): scored at
    the primary anchors only. lengths: those of the peptides to score, 0 alone for cores.
    """
    at = pooled(counts)
    if background is None:
        bg = at.groupBy("anchor", "residue").agg(F.sum("cnt").alias("c")).withColumn("bg", F.col("c") / F.sum("c").over(Window.partitionBy("anchor"))).drop("c")
        none = 0.0
    else:
        listed = at.select("anchor").distinct().join(F.broadcast(background.select("residue", "bg")))  # twenty residues
        bg = at.select("anchor", "residue").distinct().join(listed, ["anchor", "residue"], "full").select("anchor", "residue", F.coalesce("bg", F.lit(UNLISTED)).alias("bg"))
        none = UNLISTED
    seen = shares.select("anchor", "length", "allele").distinct()
    full = seen.join(bg.unionByName(at.select("anchor").distinct().select("anchor", F.lit(OTHER).alias("residue"), F.lit(none).alias("bg"))), "anchor").join(shares, ["anchor", "length", "allele", "residue"], "left")
    value = F.ln(F.coalesce("p", F.lit(0.0)) + eps) - (F.lit(0.0) if conditional else F.ln(F.col("bg") + eps))
    if rare is not None:
        full = full.join(rare.select("allele", F.lit(True).alias("_rare")), "allele", "left")
        value = F.when(F.coalesce("_rare", F.lit(False)) & ~F.col("anchor").isin(*primary), 0.0).otherwise(value)
    rows = full.select("allele", "length", "anchor", F.concat_ws(":", F.col("anchor").cast("string"), "residue").alias("key"), value.alias("value"))
    own = rows.where("length <> 0").select("allele", "length", "anchor").distinct()
    for_all = rows.where("length = 0").drop("length").withColumn("length", F.explode(F.array(*map(F.lit, lengths)))).join(own, ["allele", "length", "anchor"], "left_anti")
    table = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))  # the residues of a few anchors
    out = rows.where(F.col("length").isin(*lengths) & (F.col("length") != 0)).unionByName(for_all.select(*rows.columns)).groupBy("allele", "length").agg(table.alias("table"))
    return out.withColumn("term", F.lit(0.0)) if terms is None else out.join(terms, ["allele", "length"], "left").withColumn("term", F.coalesce("term", F.lit(0.0)))


def transitions(table: DataFrame, background: DataFrame) -> DataFrame:
    """One row, bg map<string, double>: shares of a residue after another ("prev|residue", from prev, residue, p), and by itself ("|residue")."""
    rows = table.select(F.concat_ws("|", "prev", "residue").alias("key"), F.col("p").alias("value")).unionByName(background.select(F.concat(F.lit("|"), "residue").alias("key"), F.col("bg").alias("value")))
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("bg"))  # 420 entries


def _odds(table: Column, anchor: Column, residue: Column) -> Column:
    at = lambda r: F.concat_ws(":", anchor.cast("string"), r)
    return F.coalesce(F.try_element_at(table, at(residue)), F.try_element_at(table, at(F.lit(OTHER))), F.lit(0.0))


def _null_odds(bg: Column | None, pep: Column, at: Column, eps: float) -> Column:
    """ln of the background share of the residue at an index, after the one before it."""
    if bg is None:
        return F.lit(0.0)
    r, prev = F.substring(pep, at + 1, F.lit(1)), F.when(at > 0, F.substring(pep, at, F.lit(1))).otherwise("")
    return F.ln(F.coalesce(F.try_element_at(bg, F.concat_ws("|", prev, r)), F.try_element_at(bg, F.concat(F.lit("|"), r)), F.lit(UNLISTED)) + eps)


def terms_of(pairs: DataFrame, model: DataFrame, anchors: Sequence[int], *, pep: str = "pep", bg: DataFrame | None = None, eps: float = EPS) -> DataFrame:
    """pairs (pep, allele) with terms (a log odds for each anchor that counts, null where the string does not fit) and the length's term.

    Without a column allele, every string is paired with the alleles that have a model of its length, by that same join.
    """
    known = model.select(F.col("allele").alias("_a"), F.col("length").alias("_n"), "table", "term")
    if "allele" in pairs.columns:
        rows = pairs.join(known, (F.col("allele") == F.col("_a")) & (F.length(pep) == F.col("_n")), "left").drop("_a", "_n")
    else:
        rows = pairs.join(known, F.length(pep) == F.col("_n")).withColumnRenamed("_a", "allele").drop("_n")
    rows = rows if bg is None else rows.join(F.broadcast(bg))  # one row
    null = F.col("bg") if bg is not None else None
    p = F.col(pep)
    terms = F.transform(places(pep, anchors), lambda a: _odds(F.col("table"), a["anchor"], F.substring(p, a["at"] + 1, F.lit(1))) - _null_odds(null, p, a["at"], eps))
    return rows.withColumn("terms", F.when(F.col("table").isNotNull(), terms)).drop("table", *(["bg"] if bg is not None else []))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def score(pairs: DataFrame, model: DataFrame, anchors: Sequence[int] = ANCHORS["mhc1"], *, pep: str = "pep", bg: DataFrame | None = None, eps: float = EPS) -> DataFrame:
    """pairs (pep, allele) with score: summed log odds of the anchors and the length's term; minus infinity for a string that does not fit, null for an allele without a model."""
    t = terms_of(pairs, model, anchors, pep=pep, bg=bg, eps=eps)
    fits = F.length(pep) >= max(map(abs, anchors))
    return t.withColumn("score", F.when(~fits, F.lit(float("-inf"))).otherwise(_sum(F.col("terms")) + F.col("term"))).drop("terms", "term")


def frame_scores(table: Column, pep: Column, anchors: Sequence[int], bg: Column | None = None, eps: float = EPS) -> Column:
    """array<double>: log odds of every frame of nine; null for a shorter string."""
    one = lambda s: sum((_odds(table, F.lit(j), F.substring(pep, s + j, F.lit(1))) - _null_odds(bg, pep, s + (j - 1), eps) for j in anchors), F.lit(0.0))
    return F.when(F.length(pep) >= WIDTH, F.transform(F.sequence(F.lit(0), F.length(pep) - WIDTH), one))


def registers(panel: DataFrame, kernel: DataFrame, anchors: Sequence[int] = CORE["mhc2"], *, rounds: int | None = 2, pep: str = "epitope", weight: str | None = None, tau: float = TAU, background: DataFrame | None = None) -> DataFrame:
    """pep, allele, weight, start: the frame of every row that the model learned from all rows scores best, leftmost of equals.

    Begins with the register by pockets; every round counts the frames of the round before. rounds None: until no allele moves,
    an allele whose rows all stay being left as it is from then on. Each round is written to the shared folder; the result is
    the last one.
    """
    kept = Rounds(panel.sparkSession, "registers")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    at = kept.kept(panel.where(F.length(pep) >= WIDTH).select(F.col(pep).alias("pep"), "allele", w.alias("weight"), S.best_register(pep).alias("start"), F.lit(True).alias("moving")))
    for _ in range(MOST_ROUNDS if rounds is None else rounds):
        counts = kept.kept(anchor_counts(at, anchors, pep="pep", weight="weight", start="start"))
        model = models(distributions(counts, kernel, tau, by_length=False), counts, [0], background=background).select("allele", "table")
        frames = frame_scores(F.col("table"), F.col("pep"), anchors)
        best = F.array_position(frames, F.array_max(frames)).cast("int") - 1
        after = at.join(model, "allele", "left").select("pep", "allele", "weight", F.when(F.col("moving"), best).otherwise(F.col("start")).alias("start"), F.col("start").alias("_old"), "moving")
        if rounds is None:
            after = kept.kept(after)
            changed = after.where("start <> _old").select("allele").distinct().withColumn("_c", F.lit(True))
            after = after.join(changed, "allele", "left").withColumn("moving", F.coalesce("_c", F.lit(False))).drop("_c")
        at = kept.kept(after.drop("_old"))
        kept.drop(keep=1)
        if rounds is None and not at.where("moving").limit(1).count():
            break
    return at.drop("moving")


def start_priors(starts: DataFrame, kernel: DataFrame, tau: float = TAU, *, pep: str = "pep") -> DataFrame:
    """length, allele, prior array<double>: ln of the share of every start among the frames of a length, with half a row added to each, drawn towards the allele's likes."""
    seen = starts.groupBy(F.length(pep).alias("length"), "allele", "start").agg(F.sum("weight").alias("c"))
    all_ = seen.select("length", "allele").distinct().withColumn("start", F.explode(F.sequence(F.lit(0), F.col("length") - WIDTH)))
    counts = all_.join(seen, ["length", "allele", "start"], "left").select("length", "allele", "start", (F.coalesce("c", F.lit(0.0)) + START_ADDED).alias("cnt"))
    p = shrunk(counts, kernel.drop("anchor").distinct(), ["length"], tau, "start")
    row = F.array_sort(F.collect_list(F.struct("start", "p")))  # the frames of one length
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["p"])
    return p.groupBy("length", "allele").agg(row.alias("r")).select("length", "allele", F.transform("r", lambda x: F.ln(x["p"] / total(F.col("r")))).alias("prior"))


def score_frames(pairs: DataFrame, model: DataFrame, priors: DataFrame, anchors: Sequence[int] = CORE["mhc2"], *, register: str = "marginal", pep: str = "pep", bg: DataFrame | None = None, eps: float = EPS) -> DataFrame:
    """pairs (pep, allele) with start (the best frame) and score: ln of the sum of exp(prior + frame) over all frames, or the best frame ("max"); minus infinity for a string below nine.

    A length that neither the allele nor its likes have gives every frame an even prior.
    """
    if register not in ("marginal", "max"):
        raise ValueError(f"register must be marginal or max, not {register!r}")
    rows = pairs.withColumn("_n", F.length(pep)).join(model.select("allele", "table"), "allele", "left").join(priors.select(F.col("length").alias("_n"), "allele", "prior"), ["_n", "allele"], "left")
    rows = rows if bg is None else rows.join(F.broadcast(bg))  # one row
    rows = rows.withColumn("_f", F.when(F.col("table").isNotNull(), frame_scores(F.col("table"), F.col(pep), anchors, F.col("bg") if bg is not None else None, eps)))
    even = F.transform("_f", lambda x: -F.ln(F.size("_f").cast("double")))
    both = F.zip_with("_f", F.coalesce("prior", even), lambda a, b: a + b)
    rows = rows.withColumn("_z", both).withColumn("_m", F.array_max("_z"))
    soft = F.col("_m") + F.ln(_sum(F.transform("_z", lambda z: F.exp(z - F.col("_m")))))
    value = soft if register == "marginal" else F.array_max("_f")
    short = F.col("_n") < WIDTH
    out = rows.withColumn("start", F.when(short, -1).otherwise(F.array_position("_f", F.array_max("_f")).cast("int") - 1)).withColumn("score", F.when(short, F.lit(float("-inf"))).otherwise(value))
    return out.select(*pairs.columns, "start", "score")
