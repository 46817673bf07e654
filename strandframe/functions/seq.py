"""Nucleotide functions as Column expressions (inventory C1-C9, C12-C17, B9, B10).

They stay in the JVM, but for those that look at every k-mer of a read (C1 of a list, C7-C9), which code
a batch of reads at once. Sequences are upper-case strings; letters outside ACGT are IUPAC ambiguity codes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W

# IUPAC letters and their complements.
IUPAC = "ACGTURYKMSWBDHVN"
IUPAC_COMPLEMENT = "TGCAAYRMKSWVHDBN"
# Letters in the order of their base-4 digit.
BASES = "ACGT"
AMBIGUOUS = "[^ACGT]"
UNK = "<unk>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def kmer_to_int(kmer: Column | str) -> Column:
    """C1. Base-4 code, first base least significant; null if not pure ACGT, k <= 31."""
    kmer = _col(kmer)
    digits = F.reverse(F.translate(kmer, BASES, "0123"))
    return F.when(~kmer.rlike(AMBIGUOUS) & (F.length(kmer) > 0), F.conv(digits, 4, 10).cast("bigint"))


def kmers_to_int(kmers: Column | str) -> Column:
    """C1 of every element of an array of k-mers."""
    return W.codes_column(_col(kmers))


def int_to_kmer(code: Column | str, k: int) -> Column:
    """C2. Inverse of C1 for the k lowest digits."""
    digits = F.reverse(F.conv(_col(code).cast("string"), 10, 4))
    return F.translate(F.rpad(digits, k, "0"), "0123", BASES)


def complement(seq: Column | str, not_ac: bool = False) -> Column:
    """C3. IUPAC complement; ``not_ac`` leaves sequences starting with A or C alone."""
    seq = _col(seq)
    flipped = F.translate(seq, IUPAC + IUPAC.lower(), IUPAC_COMPLEMENT + IUPAC_COMPLEMENT.lower())
    return F.when(starts_ac(seq), seq).otherwise(flipped) if not_ac else flipped


def reverse_complement(seq: Column | str, not_ac: bool = False) -> Column:
    """C4. Reversed complement, with the same ``not_ac`` option."""
    seq = _col(seq)
    flipped = F.reverse(complement(seq))
    return F.when(starts_ac(seq), seq).otherwise(flipped) if not_ac else flipped


def starts_ac(seq: Column) -> Column:
    return F.substr(seq, F.lit(1), F.lit(1)).isin("A", "C")


def canonical(kmer: Column | str, strand: str | None = "revcomp") -> Column:
    """C5. First-base rule: A/C-leading k-mers stay, others are flipped.

    ``strand`` is ``revcomp``, ``complement`` or None (no canonical form).
    """
    if strand is None:
        return _col(kmer)
    flip = {"revcomp": reverse_complement, "complement": complement}[strand]
    return flip(kmer, not_ac=True)


def kmer_starts(read: Column | str, k: int, s: int = 1) -> Column:
    """1-based k-mer start positions 1, 1+s, ...; empty when the read is shorter than k."""
    last = F.length(_col(read)) - F.lit(k - 1)
    return F.when(last >= 1, F.sequence(F.lit(1), last, F.lit(s))).otherwise(F.array().cast("array<int>"))


def kmers(
    read: Column | str, k: int, s: int = 1, strand: str | None = "revcomp", remove_unk: bool = False
) -> Column:
    """C6, C7. Array of canonical k-mers with stride s, optionally without ambiguous ones."""
    read = _col(read)
    if remove_unk and k <= W.MAX_K:
        return W.known_words_column(read, k, s, strand)
    if strand is None and not remove_unk:
        return W.plain_words_column(read, k, s)
    words = F.transform(
        kmer_starts(read, k, s), lambda i: canonical(F.substr(read, i, F.lit(k)), strand)
    )
    return F.filter(words, lambda w: ~w.rlike(AMBIGUOUS)) if remove_unk else words


def kmer_sentence(read: Column | str, k: int, max_length: int = -1) -> Column:
    """C8. Canonical k-mers of the (truncated) read, joined by spaces."""
    read = _col(read)
    if max_length > 0:
        read = F.substr(read, F.lit(1), F.lit(max_length))
    if k <= W.MAX_K:
        return W.canonical_sentence_column(read, k, (IUPAC + IUPAC.lower(), IUPAC_COMPLEMENT + IUPAC_COMPLEMENT.lower()))
    return F.array_join(kmers(read, k), " ")


def kmer_sentence_unk(
    read: Column | str, k: int, s: int = 1, mode: str = "c", remove_unk: bool = False
) -> Column:
    """C9. Sentence with ambiguous k-mers as ``<unk>``, runs of them collapsed.

    Mode ``b`` cuts the tail to a multiple of k, ``e`` drops the first L mod k
    bases, ``c`` keeps the read. ``remove_unk`` drops ambiguous k-mers instead.
    """
    read = _col(read)
    if mode == "b":
        read = F.substr(read, F.lit(1), F.length(read) - F.length(read) % k)
    elif mode == "e":
        read = F.substr(read, F.length(read) % k + 1)
    if remove_unk:
        return F.array_join(kmers(read, k, s, remove_unk=True), " ")
    if k <= W.MAX_K:
        return W.sentence_column(read, k, s, "revcomp", UNK)
    words = F.transform(
        kmers(read, k, s), lambda w: F.when(w.rlike(AMBIGUOUS), F.lit(UNK)).otherwise(w)
    )
    return F.regexp_replace(F.array_join(words, " "), f"{UNK}( {UNK})+", UNK)


def gc_rate(read: Column | str) -> Column:
    """C12. Share of C and G letters; null for an empty read."""
    read = _col(read)
    return F.length(F.regexp_replace(read, "[^CG]", "")) / F.nullif(F.length(read), F.lit(0))


def acgt_length(seq: Column | str) -> Column:
    """C13. Number of A, C, G and T letters."""
    return F.length(F.regexp_replace(_col(seq), AMBIGUOUS, ""))


def fragments(seq: Column | str, max_length: int) -> Column:
    """C14. Runs of two or more N deleted, then pieces of exactly ``max_length``; the rest is dropped."""
    clean = F.regexp_replace(_col(seq), "NN+", "")
    return F.regexp_extract_all(clean, F.lit(f"(.{{{max_length}}})"), F.lit(1))


def hamming(a: Column | str, b: Column | str) -> Column:
    """C15. Number of differing positions of two strings of equal length over ``IUPAC``.

    Fifteen letters at a time become the hex digits of a number; the digits in which two numbers
    differ are folded to one bit each and counted.
    """
    digits = lambda x: F.translate(_col(x), IUPAC, "0123456789abcdef")
    a, b = digits(a), digits(b)

    def chunk(start: Column) -> Column:
        number = lambda x: F.coalesce(F.conv(F.substr(x, start, F.lit(15)), 16, 10).cast("bigint"), F.lit(0))
        other = number(a).bitwiseXOR(number(b))
        pairs = other.bitwiseOR(F.shiftright(other, 1))
        return F.bit_count(pairs.bitwiseOR(F.shiftright(pairs, 2)).bitwiseAND(F.lit(0x111111111111111)))

    starts = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)), F.lit(15))
    return F.aggregate(F.transform(starts, chunk), F.lit(0), lambda acc, x: acc + x)


def orient_pair(a: Column | str, b: Column | str) -> Column:
    """C17. Struct (a, b): flipped as one sequence when it starts and ends with G or T."""
    a, b = _col(a), _col(b)
    whole = F.concat(a, b)
    flipped = reverse_complement(whole)
    flip = whole.rlike("^[GT](.*[GT])?$")
    return F.struct(
        F.when(flip, F.substr(flipped, F.lit(1), F.length(a))).otherwise(a).alias("a"),
        F.when(flip, F.substr(flipped, F.length(a) + 1)).otherwise(b).alias("b"),
    )


def clean_anonymous_id(read_id: Column | str) -> Column:
    """B9. Without ``@`` and without the last ``-suffix``."""
    return F.regexp_replace(F.regexp_replace(_col(read_id), "@", ""), "(.*)-.*$", "$1")


def mate_key(read_id: Column | str) -> Column:
    """B10. Read id without a trailing /1 or /2."""
    return F.regexp_replace(_col(read_id), "/[12]$", "")


def pair_suffix(read_id: Column | str) -> Column:
    """Last part of the id after ``/`` (the whole id when there is none)."""
    return F.element_at(F.split(_col(read_id), "/"), -1)


def seeded_order(seed: int | str, *keys: Column | str) -> Column:
    """Portable pseudo-random order: hex md5 of the keys and the seed."""
    return F.md5(F.concat_ws("-", *[_col(k).cast("string") for k in keys], F.lit(str(seed))))
