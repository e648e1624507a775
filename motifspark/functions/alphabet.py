"""Bases, rotations and strands as Column expressions.

Bases T, G, C, A are the digits 0 to 3, whatever their case; other characters break
windows, digits in a read as well. Motifs of one length compare as strings of digits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, DIGITS, COMPLEMENT = "TGCA", "0123", "3210"


def encode(seq: Column) -> Column:
    return F.translate(F.upper(seq), BASES + DIGITS, DIGITS + "xxxx")


def decode(motif: Column) -> Column:
    return F.translate(motif, DIGITS, BASES)


def reverse_complement(motif: Column) -> Column:
    return F.reverse(F.translate(motif, DIGITS, COMPLEMENT))


def canonical(motif: Column) -> Column:
    """The least rotation."""
    twice, k = F.concat(motif, motif), F.length(motif)
    return F.array_min(F.transform(F.sequence(F.lit(1), k), lambda i: F.substr(twice, i, k)))


def strand_canonical(motif: Column) -> Column:
    """The lesser of a canonical motif and its other strand's."""
    return F.least(motif, canonical(reverse_complement(motif)))


def is_palindrome(motif: Column) -> Column:
    """Whether a canonical motif is its own other strand. Such a motif has each base as often as its complement, which is told first."""
    balanced = reduce(Column.__and__, ((F.length(F.replace(motif, F.lit(d))) == F.length(F.replace(motif, F.lit(c)))) for d, c in ("03", "12")))
    return F.when(balanced, canonical(reverse_complement(motif)) == motif).otherwise(balanced)


def distinct_bases(motif: Column) -> Column:
    return sum((F.contains(motif, F.lit(d)).cast("int") for d in DIGITS), F.lit(0))


def is_homopolymer(motif: Column) -> Column:
    return motif == F.repeat(F.substring(motif, 1, 1), F.length(motif))


def has_short_period(motif: Column, below: int) -> Column:
    """Whether the motif repeats with a period from 3 up to below - 1."""
    out = F.lit(False)
    for p in range(3, below):
        out = out | ((F.length(motif) > p) & (F.substr(motif, F.lit(1), F.length(motif) - p) == F.substr(motif, F.lit(p + 1))))
    return out
