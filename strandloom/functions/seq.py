"""Sequence functions: Column in, Column out, all in the JVM.

Sequences are upper-case strings unless said otherwise; null in gives null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ambiguity codes and the bases they stand for (fixed values).
IUPAC = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def let(value: Column, use) -> Column:
    """``use(value)`` with value evaluated once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of ``seq`` are among ``letters``."""
    return F.length(seq) - F.length(F.regexp_replace(seq, f"[{letters}]", ""))


def gc_counts(seq: Column) -> tuple[Column, Column]:
    """(G + C, A + C + G + T) of a sequence in any case."""
    up = F.upper(seq)
    return count_of(up, "GC"), count_of(up, "ACGT")


def gc_percent(seq: Column) -> Column:
    """100 (G+C) / (A+C+G+T); null for the empty sequence and without a base."""
    gc, n = gc_counts(seq)
    return F.when(n > 0, 100.0 * gc / n)


def gc_percent_of_length(seq: Column) -> Column:
    """100 (G+C) / length, ambiguity letters included; null for the empty sequence."""
    return F.when(F.length(seq) > 0, 100.0 * gc_counts(seq)[0] / F.length(seq))


def reverse_complement(seq: Column) -> Column:
    """Reverse complement; letters other than A, C, G, T become N."""
    up = F.upper(seq)
    return F.reverse(F.translate(F.regexp_replace(up, "[^ACGT]", "N"), "ACGT", "TGCA"))


def reverse_complement_keep(seq: Column) -> Column:
    """Reverse complement that keeps unknown letters as they are."""
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def is_palindrome(seq: Column) -> Column:
    """True if the sequence is its own reverse complement."""
    return F.upper(seq) == reverse_complement_keep(seq)


def mutation_type(ref: Column, alt: Column) -> Column:
    """``ts`` for A<->G and C<->T, else ``tv``, in any case."""
    pair = F.upper(F.concat(ref, alt))
    return F.when(pair.isin("AG", "GA", "CT", "TC"), "ts").when(pair.isNotNull(), "tv")


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order, with repeats; empty for shorter sequences."""
    def cut(s):
        at = F.sequence(F.lit(1), F.greatest(F.length(s) - (k - 1), F.lit(1)))
        return F.when(F.length(s) >= k, F.transform(at, lambda i: F.substr(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return let(seq, cut)


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement_keep(kmer))


def dust_numerator(seq: Column, k: int = 3) -> Column:
    """Sum of c (c - 1) / 2 over the counts of all k-mers."""
    def pairs(all_kmers):
        kinds = F.array_distinct(all_kmers)
        return F.aggregate(kinds, F.lit(0).cast("long"), lambda s, m: s + let(F.size(F.filter(all_kmers, lambda x: x == m)).cast("long"), lambda c: (c * (c - 1) / 2).cast("long")))

    return let(kmers(F.upper(seq), k), pairs)


def dust(seq: Column, k: int = 3) -> Column:
    """DUST score: dust_numerator / (length - k); 0 where the length is k or less."""
    return F.when(F.length(seq) <= k, F.lit(0.0)).otherwise(dust_numerator(seq, k) / (F.length(seq) - k))


def entropy(seq: Column, base: float = 2.0) -> Column:
    """Shannon entropy of the characters; null for the empty sequence."""
    chars = F.split(seq, "")
    kinds = F.array_sort(F.array_distinct(chars))
    n = F.length(seq)

    def term(c):
        return let((F.length(seq) - F.length(F.replace(seq, c, F.lit("")))) / n, lambda p: -p * F.log(p))

    return F.when(n > 0, F.aggregate(kinds, F.lit(0.0), lambda s, c: s + term(c)) / F.log(F.lit(base)))


def window_entropy(seq: Column, window: int, step: int = 1, base: float = 2.0) -> Column:
    """Entropy of every full window, as an array; empty for shorter sequences."""
    at = F.sequence(F.lit(1), F.greatest(F.length(seq) - (window - 1), F.lit(1)), F.lit(step))
    return F.when(F.length(seq) >= window, F.transform(at, lambda i: entropy(F.substr(seq, i, F.lit(window)), base))).otherwise(F.array().cast("array<double>"))


def ambiguous_count(seq: Column) -> Column:
    """Characters other than A, C, G, T."""
    return F.length(F.regexp_replace(F.upper(seq), "[ACGT]", ""))


def pick(choices: Column, *key: Column) -> Column:
    """One of ``choices`` (a string of letters), always the same for the same key."""
    at = F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 6), 16, 10).cast("int") % F.length(choices) + 1
    return F.substr(choices, at, F.lit(1))


def replace_ambiguous(seq: Column, key: Column) -> Column:
    """Each IUPAC letter replaced by one of its bases, chosen by key and place; other
    unknown letters stay."""
    table = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    chars = F.transform(F.split(F.upper(seq), ""), lambda c, i: F.coalesce(pick(F.try_element_at(table, c), key, i.cast("string")), c))
    return F.array_join(chars, "")


def third_base(ref: Column, alt: Column, key: Column) -> Column:
    """A base that is neither ref nor alt, chosen by the key."""
    return pick(F.regexp_replace(F.lit("ACGT"), F.concat(F.lit("["), F.upper(ref), F.upper(alt), F.lit("]")), F.lit("")), key)


def similarity_percent(length: Column, mismatches: Column) -> Column:
    """100 (length - mismatches) / length; 0 for length 0."""
    return F.when(length > 0, (length - mismatches) / length * 100.0).otherwise(F.lit(0.0))


def ungapped_position(window: Column, original: Column) -> Column:
    """0-based place of an alignment window without its gaps; -1 if it isn't there."""
    return F.position(F.replace(window, F.lit("-"), F.lit("")), original) - 1
