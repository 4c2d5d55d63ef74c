"""2-bit k-mer codec and record arithmetic, as Column expressions.

A k-mer is stored as ``ceil(k / 32)`` words of 64 bits, first base in the top two bits, zero-filled at the end.
Spark has no unsigned 64-bit type, so a packed k-mer is ``binary`` (big-endian words): Spark compares binary values
byte by byte without sign, hence packed order equals the order of the strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the packed format.
BASES = "ACGT"
DIGITS = "0123"
BASES_PER_WORD = 32
BYTES_PER_WORD = 8
BYTES_PER_COUNT = 4
MAX_COUNT = 2**32 - 1


def n_words(k: int) -> int:
    """Number of 64-bit words of one k-mer."""
    if k < 1:
        raise ValueError(f"k must be 1 or more, not {k}")
    return -(-k // BASES_PER_WORD)


def record_width(k: int) -> int:
    """Bytes of one (k-mer, count) record on disk."""
    return BYTES_PER_WORD * n_words(k) + BYTES_PER_COUNT


def padded(kmer: Column, k: int) -> Column:
    """The letters right-padded with A to whole words."""
    return F.rpad(kmer, BASES_PER_WORD * n_words(k), "A")


def _word(kmer: Column, k: int, i: int) -> Column:
    return F.substring(padded(kmer, k), BASES_PER_WORD * i + 1, BASES_PER_WORD)


def word_halves(kmer: Column, k: int) -> list[Column]:
    """Each word as two non-negative bigints (high and low 32 bits), high first; 2 * n_words(k) columns."""
    out = []
    for i in range(n_words(k)):
        for half in (1, 17):
            digits = F.translate(F.substring(_word(kmer, k, i), half, 16), BASES, DIGITS)
            out.append(F.conv(digits, 4, 10).cast("bigint"))
    return out


def encode_words(kmer: Column, k: int) -> Column:
    """Packed big-endian binary of ``8 * n_words(k)`` bytes."""
    words = [
        F.unhex(F.lpad(F.conv(F.translate(_word(kmer, k, i), BASES, DIGITS), 4, 16), 16, "0"))
        for i in range(n_words(k))
    ]
    return F.concat(*words)


def pack(letters: Column) -> Column:
    """The word of up to 32 letters as a bigint with the word's bits, filled with A."""
    digits = F.translate(F.rpad(letters, BASES_PER_WORD, "A"), BASES, DIGITS)
    return F.conv(digits, 4, -10).cast("bigint")


def words(kmer: Column, k: int) -> list[Column]:
    """All words of a k-mer, as ``pack`` has them."""
    return [pack(_word(kmer, k, i)) for i in range(n_words(k))]


def halves_of(word: Column) -> list[Column]:
    """The high and low 32 bits of a word as ``pack`` has it, as non-negative bigints."""
    return [F.shiftrightunsigned(word, BASES_PER_WORD), word.bitwiseAND(F.lit(2**32 - 1).cast("bigint"))]


def binary_of(*words: Column) -> Column:
    """What ``encode_words`` gives, of words as ``pack`` has them."""
    return F.unhex(F.concat(*[F.lpad(F.hex(w), 2 * BYTES_PER_WORD, "0") for w in words]))


def word_letters(word: Column) -> Column:
    """The 32 letters of a word as ``pack`` has it, those of each byte from a constant table: ``conv`` and ``translate`` take seven times as long."""
    table = F.split(F.lit(",".join("".join(BASES[b >> s & 3] for s in (6, 4, 2, 0)) for b in range(256))), ",")
    return F.concat(*[F.get(table, F.shiftright(word, s).bitwiseAND(F.lit(255)).cast("int")) for s in range(56, -1, -8)])


def decode_padded(packed: Column, k: int) -> Column:
    """Letters of a packed k-mer, whole words (padding A's included)."""
    words = [F.conv(F.hex(F.substring(packed, BYTES_PER_WORD * i + 1, BYTES_PER_WORD)), 16, -10).cast("bigint") for i in range(n_words(k))]
    return F.concat(*[word_letters(w) for w in words])


def decode_words(packed: Column, k: int) -> Column:
    """Letters of a packed k-mer, trimmed to k."""
    return F.substring(decode_padded(packed, k), 1, k)


def little_endian(word8: Column) -> Column:
    """Reverse the bytes of each 8-byte word of a binary column holding one word."""
    h = F.hex(word8)
    return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(BYTES_PER_WORD - 1, -1, -1)]))


def windows_bound(seq: Column, k: int) -> Column:
    """Windows that a read can emit at most: ``greatest(length - k + 1, 0)``."""
    return F.greatest(F.length(seq) - F.lit(k) + 1, F.lit(0)).cast("bigint")


def chunk_bytes(line_length: Column, k: int, memory_limit: int) -> Column:
    """Input bytes of fixed-length reads whose input and output records fit in ``memory_limit`` bytes; 0 if none fit.

    One read needs its own bytes and one record of a quarter byte per base plus a count word for each window.
    """
    words_per_record = -(-(-(-k // 4)) // 8) + 1
    per_read = F.lit(8 * words_per_record).cast("bigint") * (line_length - F.lit(k) + 1) - 1
    reads = F.floor((F.lit(memory_limit).cast("bigint") - line_length) / F.nullif(per_read, F.lit(0)))
    return (line_length * F.greatest(reads, F.lit(0))).cast("bigint")
