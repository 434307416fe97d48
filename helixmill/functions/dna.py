"""Column functions on nucleotide sequences; all of them built-in expressions.

Bases have the codes A=0, C=1, T=2, G=3, written as a string of digits, so a
complement is ``code xor 2`` and the order of equally long digit strings is the
order of their numbers.  That order (A < C < T < G) defines canonical forms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import EPS
from .params import MAX_INT_K

BASES = "ACTG"
#: Hashing this value first with Spark's fixed seed leaves the seed 1312 for the next column.
SEED_PREIMAGE = -5563857264322183404


def clean(text: Column) -> Column:
    """Only the letters ACGTacgt of a text, in upper case; a null stays null."""
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]+", ""))


def with_gaps(text: Column) -> Column:
    """A text of the same length: the letters ACGTacgt in upper case, and N for every other."""
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]", "N"))


def digits(seq: Column) -> Column:
    return F.translate(seq, BASES, "0123")


def bases(d: Column) -> Column:
    return F.translate(d, "0123", BASES)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def reverse_digits(d: Column) -> Column:
    """Reverse complement of a digit string."""
    return F.translate(F.reverse(d), "0123", "2301")


def canonical(d: Column) -> Column:
    """The lesser of a digit string and its reverse complement."""
    return F.least(d, reverse_digits(d))


def number(d: Column) -> Column:
    """A digit string of up to 31 bases as a BIGINT."""
    return F.conv(d, 4, 10).cast("bigint")


def text_of(n: Column, size: int) -> Column:
    """Bases of a number, padded to ``size``."""
    return bases(F.lpad(F.conv(n.cast("string"), 10, 4), size, "0"))


def kmer_text(kmer: Column, k: int) -> Column:
    """Bases of a k-mer's key: a number, or beyond 31 bases a struct of ``hi`` (all but the last 32 bases) and ``lo`` (those, less 2**63)."""
    if k <= MAX_INT_K:
        return text_of(kmer, k)
    # As text of a number below zero, conv takes its 64 bits for an unsigned one.
    return F.concat(text_of(kmer["hi"], k - 32), text_of(kmer["lo"].bitwiseXOR(F.lit(-(2**63)).cast("bigint")), 32))


def seeded_hash(mmer: Column) -> Column:
    """XXH64 (seed 1312) of the eight little-endian bytes of a number, as a signed BIGINT."""
    return F.xxhash64(F.lit(SEED_PREIMAGE).cast("bigint"), mmer.cast("bigint"))


def hash_order(mmer: Column) -> Column:
    """A BIGINT whose signed order is the unsigned order of the seeded hash."""
    return seeded_hash(mmer).bitwiseXOR(F.lit(-(2**63)).cast("bigint"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def with_minimizer(left: Column, minimizer: Column, right: Column) -> Column:
    """A maximal super-k-mer put together from its flanks and its minimizer."""
    return F.concat(left, minimizer, right)


def decycling_class(d: Column, m: int) -> Column:
    """Class of an m-mer under a decycling set: 2 if its weighted sum of sines is
    positive and that of its rotation (last base first) isn't, 1 for the mirrored case, else 0."""
    from math import pi, sin

    eps = EPS
    sines = F.array(*[F.lit(sin(2 * pi * i / m)) for i in range(m)])
    codes = F.transform(F.sequence(F.lit(1), F.lit(m)), lambda i: F.substring(d, i, F.lit(1)).cast("double"))
    weigh = lambda c: F.aggregate(F.zip_with(c, sines, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    here, turned = weigh(codes), weigh(F.concat(F.slice(codes, m, 1), F.slice(codes, 1, m - 1)))
    return F.when((here > eps) & (turned < eps), 2).when((here < -eps) & (turned > -eps), 1).otherwise(0)
