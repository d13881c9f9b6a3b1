"""Column functions over short strings of residues: validity, positions, masks, cores, windows, codons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The twenty standard residues, the mask letter, and the longest class I string.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
MASK = "X"
CLASS_I_MOST = 11

#: The standard genetic code, codon bases in the order T, C, A, G.
CODONS = {
    a + b + c: r
    for r, (a, b, c) in zip(
        "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
        ((a, b, c) for a in "TCAG" for b in "TCAG" for c in "TCAG"),
        strict=True,
    )
}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def letters(text: str | Column) -> Column:
    """Letters A-Z of any text in upper case: the stand-in for a sequence."""
    return F.upper(F.regexp_replace(_c(text), "[^A-Za-z]", ""))


def is_standard(seq: str | Column) -> Column:
    return _c(seq).rlike(f"^[{RESIDUES}]+$")


def residue_code(ch: str | Column) -> Column:
    """0-19, or -1 for a letter that is no standard residue."""
    return F.instr(F.lit(RESIDUES), _c(ch)) - 1


def infer_class(seq: str | Column) -> Column:
    return F.when(F.length(_c(seq)) <= CLASS_I_MOST, F.lit("mhc1")).otherwise(F.lit("mhc2"))


def chars(seq: str | Column) -> Column:
    return F.split(_c(seq), "")


def register_score(core: str | Column) -> Column:
    """Pocket score of a nine-letter frame: large hydrophobic residues at the first pocket, small or aliphatic ones at the others."""
    p = lambda i: F.substring(_c(core), i, 1)
    first = F.when(p(1).isin("F", "Y", "W"), 4.0).when(p(1).isin("I", "L", "V", "M"), 3.0).otherwise(0.0)
    fourth = F.when(p(4).isin("L", "I", "V", "M", "F", "A", "Q"), 1.0).otherwise(0.0)
    sixth = F.when(p(6).isin("T", "S", "A", "G", "N", "V"), 1.0).otherwise(0.0)
    ninth = F.when(p(9).isin("L", "I", "V", "A", "K", "Y", "F"), 1.0).otherwise(0.0)
    return first + fourth + sixth + ninth


def best_register(seq: str | Column) -> Column:
    """Offset of the best nine-letter frame, the leftmost of equals; null below nine letters."""
    s = _c(seq)
    frames = F.transform(F.sequence(F.lit(0), F.length(s) - 9), lambda i: F.struct(register_score(F.substring(s, i + 1, 9)).alias("score"), (-i).alias("at")))
    return F.when(F.length(s) >= 9, -F.array_max(frames)["at"])


def anchor_indices(seq: str | Column, cls: str | Column | None = None, register: Column | None = None) -> Column:
    """Zero-based anchors: the second and last position for class I, pockets 1, 4, 6, 9 of the core for class II."""
    s = _c(seq)
    kind = infer_class(s) if cls is None else _c(cls)
    start = best_register(s) if register is None else register
    return F.when(kind == "mhc1", F.array(F.lit(1), F.length(s) - 1)).otherwise(F.transform(F.array(*map(F.lit, (0, 3, 5, 8))), lambda i: i + start))


def masked(seq: str | Column, positions: Column, *, inside: bool) -> Column:
    """The letters at (inside) or off the positions replaced by the mask."""
    return F.array_join(F.transform(chars(seq), lambda ch, i: F.when(F.array_contains(positions, i) == F.lit(inside), F.lit(MASK)).otherwise(ch)), "")


def binding_core(seq: str | Column, cls: str | Column | None = None) -> Column:
    """struct<core, offset>: first five and last four letters for class I, nine letters at the register for class II."""
    s = _c(seq)
    kind = infer_class(s) if cls is None else _c(cls)
    one = F.when(F.length(s) <= 9, s).otherwise(F.concat(F.substring(s, 1, 5), F.right(s, F.lit(4))))
    at = F.when(kind == "mhc1", F.lit(0)).otherwise(best_register(s))
    return F.struct(F.when(kind == "mhc1", one).otherwise(F.substring(s, at + 1, F.lit(9))).alias("core"), at.alias("offset"))


def signed_anchor(length: Column, anchor: Column) -> Column:
    """Zero-based place of an anchor counted from the front (1, 2, …) or the end (-1, -2, …); null beyond the string or at 0."""
    at = F.when(anchor > 0, anchor - 1).when(anchor < 0, length + anchor)
    return F.when((at >= 0) & (at < length), at)


def claimed_positions(length: Column, anchors: list[int]) -> list[Column]:
    """signed_anchor of each; a place that an earlier anchor has claimed is null for the later one."""
    out: list[Column] = []
    for a in anchors:
        at = signed_anchor(length, F.lit(a))
        taken = F.lit(False)
        for before in out:
            taken = taken | F.coalesce(before == at, F.lit(False))
        out.append(F.when(~taken, at))
    return out


def face_codes(seq: str | Column, k: int) -> Column:
    """Base-20 codes of all runs of k standard residues between the anchors (class I: without the second and last)."""
    s = _c(seq)
    inner = F.substring(s, F.lit(3), F.length(s) - 3)
    code = lambda w: F.aggregate(F.transform(F.split(w, ""), lambda ch: residue_code(ch).cast("bigint")), F.lit(0).cast("bigint"), lambda acc, d: F.when((acc < 0) | (d < 0), F.lit(-1).cast("bigint")).otherwise(acc * 20 + d))
    runs = F.when(F.length(inner) >= k, F.transform(F.sequence(F.lit(1), F.length(inner) - (k - 1)), lambda i: code(F.substring(inner, i, F.lit(k))))).otherwise(F.array().cast("array<bigint>"))
    return F.filter(runs, lambda c: c >= 0)


def face_anchors(seq: str | Column, cls: str = "mhc1", register: Column | None = None) -> Column:
    """Zero-based places that face the groove: the first three and last two for class I, pockets 1, 4, 6 and 9 of the core for class II, as far as they are in the string; none where a class II string has no core."""
    s = _c(seq)
    n = F.length(s)
    if cls == "mhc1":
        return F.when(n > 0, F.array_sort(F.array_distinct(F.array(*(F.pmod(F.lit(i), n) for i in range(3)), *(F.pmod(n - i, n) for i in (2, 1)))))).otherwise(F.array().cast("array<int>"))
    start = best_register(s) if register is None else register
    inside = F.filter(F.transform(F.array(*map(F.lit, (0, 3, 5, 8))), lambda i: i + start), lambda i: (i >= 0) & (i < n))
    return F.when(start.isNotNull(), inside).otherwise(F.array().cast("array<int>"))


def face_kmers(seq: str | Column, k: int, cls: str = "mhc1", *, register: Column | None = None, wildcard: bool = False) -> Column:
    """Codes of all runs of k residues of the face; none for a string with other letters.

    The face is what is left without the anchors, in base 20; with wildcard it is the whole string with its anchors replaced by a
    sign of their own, in base 21, so that runs span pockets. Codes of the two are not to be compared.
    """
    s = _c(seq)
    anchors = face_anchors(s, cls, register)
    each = F.transform(F.split(s, ""), lambda ch: residue_code(ch).cast("bigint"))
    base, sign = (21, 20) if wildcard else (20, -1)
    marked = F.transform(each, lambda d, i: F.when(F.array_contains(anchors, i), F.lit(sign).cast("bigint")).otherwise(d))
    face = marked if wildcard else F.filter(marked, lambda d: d >= 0)
    code = lambda w: F.aggregate(w, F.lit(0).cast("bigint"), lambda acc, d: acc * base + d)
    runs = F.transform(F.array(face), lambda f: F.when(F.size(f) >= k, F.transform(F.sequence(F.lit(1), F.size(f) - (k - 1)), lambda i: code(F.slice(f, i, k)))).otherwise(F.array().cast("array<bigint>")))[0]
    return F.when(is_standard(s), runs).otherwise(F.array().cast("array<bigint>"))


def strip_marker(seq: str | Column) -> Column:
    return F.regexp_replace(_c(seq), "[()]", "")


def aligned_window(mutant: Column, wild: Column, piece: Column) -> Column:
    """The wild-type string at the place of piece in the mutant window; null where the windows differ in length or piece is not there."""
    at = F.instr(mutant, piece)
    return F.when((F.length(mutant) == F.length(wild)) & (at > 0), F.substring(wild, at, F.length(piece)))


def centred_cut(context: Column, offset: Column, length: int) -> Column:
    """struct<seq, index>: `length` letters around a zero-based offset, moved inwards at the ends, and the offset within them."""
    n = F.length(context)
    start = F.greatest(F.lit(0), F.least(offset - length // 2, n - length))
    return F.struct(F.substring(context, start + 1, F.lit(length)).alias("seq"), (offset - start).alias("index"))


def flank_identity(a: Column, a_at: Column, b: Column, b_at: Column, length: Column, k: int) -> Column:
    """Part of equal letters among the k before and after a shared stretch that both strings have; 0 if none can be compared."""
    same, seen = F.lit(0), F.lit(0)
    for d in [*range(-k, 0), *range(k)]:
        i = a_at + d if d < 0 else a_at + length + d
        j = b_at + d if d < 0 else b_at + length + d
        both = (i >= 0) & (j >= 0) & (i < F.length(a)) & (j < F.length(b))
        seen = seen + both.cast("int")
        same = same + (both & (F.substring(a, i + 1, F.lit(1)) == F.substring(b, j + 1, F.lit(1)))).cast("int")
    return F.when(seen > 0, same / seen).otherwise(F.lit(0.0))


def bases(cds: str | Column) -> Column:
    """A coding sequence without blanks around it, in upper case, RNA as DNA."""
    return F.replace(F.upper(F.trim(_c(cds))), F.lit("U"), F.lit("T"))


def codons(cds: str | Column) -> Column:
    """Codons in frame; a rest of one or two letters is left out."""
    return F.regexp_extract_all(_c(cds), F.lit("(?s).{3}"), F.lit(0))


def _with_next(cds: str | Column) -> Column:
    """array<struct<x, y>>: each codon and the one after it, null after the last."""
    c = codons(cds)
    return F.arrays_zip(c.alias("x"), F.slice(c, 2, F.greatest(F.size(c), F.lit(1))).alias("y"))


def _slips(z: Column) -> Column:
    return (z["x"] == "TTT") & F.coalesce(F.substring(z["y"], 1, 1).isin("T", "C"), F.lit(False))


def slippery_codons(cds: str | Column) -> Column:
    """Zero-based numbers of in-frame TTT codons that are followed by T or C."""
    return F.filter(F.transform(_with_next(bases(cds)), lambda z, i: F.when(_slips(z), i)), lambda i: i.isNotNull())


def deslip(cds: str | Column) -> Column:
    """Slippery TTT codons made TTC, which codes for the same residue; what is left beyond the last codon stays. slippery_codons tells which change."""
    s = bases(cds)
    rest = F.substring(s, F.floor(F.length(s) / 3).cast("int") * 3 + 1, F.lit(2))
    return F.concat(F.array_join(F.transform(_with_next(s), lambda z: F.when(_slips(z), F.lit("TTC")).otherwise(z["x"])), ""), rest)


def translate(cds: str | Column) -> Column:
    """Residues of the codons; an unknown codon is X."""
    table = F.create_map(*(F.lit(x) for kv in CODONS.items() for x in kv))
    return F.array_join(F.transform(codons(cds), lambda x: F.coalesce(F.try_element_at(table, x), F.lit("X"))), "")


def neglog10(p: str | Column, floor: float = 1e-4) -> Column:
    return -F.log10(F.greatest(_c(p), F.lit(floor)))


def blank_nan(x: str | Column) -> Column:
    """NaN and infinite values as null, the only missing value."""
    v = _c(x)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def centred_context(kind: Column, marked: Column, windows: Column, span: Column, seq: Column) -> Column:
    """struct<context, offset>: the string that a unit of a variant is cut from, and the place it is built around; null without a centre.

    Somatic: the marked window and the place of its mark. Fusion and CNV: two or three parts joined, up to a stop, and the
    end of the left one. Isoform: the sequence and the middle of the last two numbers of the span, within it.
    """
    made = lambda ok, context, offset: F.when(ok, F.struct(context.alias("context"), offset.cast("int").alias("offset")))
    somatic = made(F.instr(marked, "(") > 0, strip_marker(marked), F.instr(marked, "(") - 1)
    parts = F.split(windows, r"\|")
    joined, left = F.substring_index(F.array_join(parts, ""), "*", 1), F.length(F.get(parts, F.lit(0)))
    fused = made(F.size(parts).isin(2, 3) & (left < F.length(joined)), joined, left)
    numbers = F.transform(F.filter(F.split(span, "[:-]"), lambda n: n.rlike("^[0-9]+$")), lambda n: n.cast("bigint"))
    middle = F.floor((F.try_element_at(numbers, F.lit(-1)) + F.try_element_at(numbers, F.lit(-2))) / 2)
    isoform = made((F.size(numbers) >= 2) & (F.length(seq) > 0), seq, F.least(middle, F.length(seq) - 1))
    return F.when(kind == "Somatic", somatic).when(kind.isin("Fusion", "CNV"), fused).when(kind == "Isoform", isoform)
