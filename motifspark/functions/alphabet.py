"""Bases, complements and composition, as column expressions. Anything but A, C, G, T in either case is masked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def base_code(base: Column) -> Column:
    """0 to 3 for A, C, G, T in either case, -1 for a masked character."""
    return F.when(F.length(base) == 1, F.instr(F.lit(BASES), F.upper(base)) - 1).otherwise(-1)


def check_base(base: Column) -> Column:
    """base_code, or an error for a masked character."""
    code = base_code(base)
    return F.when(code >= 0, code).otherwise(F.raise_error(F.concat(F.lit("not a base: "), base)).cast("int"))


def check_code(code: Column) -> Column:
    """The base of a code 0 to 3, or an error."""
    return F.when(code.between(0, 3), F.substr(F.lit(BASES), code + 1, F.lit(1))).otherwise(F.raise_error(F.concat(F.lit("not a base code: "), code.cast("string"))))


def reverse_complement(seq: Column) -> Column:
    """Keeps case; masked characters are only moved."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def upper_reverse_complement(seq: Column) -> Column:
    """Complements upper-case bases only, then writes all in upper case."""
    return F.upper(F.translate(F.reverse(seq), "ACGT", "TGCA"))


def matrix_reverse_complement(mat: Column) -> Column:
    """Rows A, C, G, T: the complement swaps A with T and C with G, so both orders are reversed."""
    return F.reverse(F.transform(mat, lambda row: F.reverse(row)))


def normalised(mat: Column, pseudo: float = 0.0) -> Column:
    """Adds the pseudo count to every cell and divides by the row's sum."""

    def row(r: Column) -> Column:
        raised = F.transform(r, lambda x: x + F.lit(float(pseudo)))
        total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
        return F.transform(raised, lambda x: F.try_divide(x, total))

    return F.transform(mat, row)


def share_of(seq: Column, bases: str) -> Column:
    """Share of the characters that are among bases, in either case; masked ones count below; null for an empty string."""
    return F.try_divide(F.regexp_count(F.upper(seq), F.lit(f"[{bases}]")).cast("double"), F.length(seq))


def content(seq: Column, bases: str, left: Column | int, right: Column | int, nucs_after_tss: Column) -> Column:
    """share_of the half-open window [left, right) around the TSS, clipped to the sequence."""
    n = F.length(seq)
    tss = n - nucs_after_tss
    start = F.greatest(F.lit(0), F.lit(left) + tss)
    end = F.least(n, F.lit(right) + tss)
    return share_of(F.substr(seq, (start + 1).cast("int"), F.greatest(F.lit(0), end - start).cast("int")), bases)
