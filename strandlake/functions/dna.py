"""Column functions over sequences; all are built-in expressions, so they stay inside Catalyst.

A residue is a byte of the UTF-8 text. A, C, G and T count in either case; a residue's code is (byte >> 1) & 3, that is
A 0, C 1, T 2, G 3, and other bytes have codes too, which keep-mode encodings use. Words are 64 bits, the first residue
in the lowest bits, and show as signed longs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import INVALID_BASE

ACTG = "ACGTacgt"
RUN = "([ACGTacgt]+)"

#: All bytes as characters, and each one's code, its two bits, and whether it is outside ACTG or an N.
_BYTES = "".join(map(chr, range(256)))
_CODES = "".join(str(b >> 1 & 3) for b in range(256))
_HIGH = "".join(str(b >> 2 & 1) for b in range(256))
_LOW = "".join(str(b >> 1 & 1) for b in range(256))
_OTHER = "".join("0" if chr(b) in ACTG else "1" for b in range(256))
_N = "".join("1" if chr(b) in "Nn" else "0" for b in range(256))


def col(seq: Column | str) -> Column:
    return F.col(seq) if isinstance(seq, str) else seq


def digits(seq: Column | str, table: str) -> Column:
    """A digit for each byte of seq."""
    return F.translate(F.decode(col(seq).cast("binary"), "ISO-8859-1"), _BYTES, table)


def words_of(text: Column, width: int, base: int) -> Column:
    """Texts of digits as 64-bit words of `width` digits each, the last one partial, or zero if none is left over."""
    chunks = F.regexp_extract_all(text, F.lit("(.{1,%d})" % width), F.lit(1))
    words = F.transform(chunks, lambda c: F.conv(F.reverse(c), base, -10).cast("long"))
    return F.when(F.length(text) % width == 0, F.array_append(words, F.lit(0).cast("long"))).otherwise(words)


def running_sums(values: Column | str, block: int = 512) -> Column:
    """The sums of an array of longs up to each element. Blocks are summed one by one and then shifted by those before, as an
    array that grows by an element is copied each time."""
    zero = F.lit(0).cast("long")
    at = lambda a: F.coalesce(F.get(a, F.size(a) - 1), zero)
    sums = lambda x: F.aggregate(x, F.array().cast("array<bigint>"), lambda a, v: F.array_append(a, at(a) + v))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(col(values)) / block) - 1, F.lit(0)).cast("int")), lambda i: sums(F.slice(col(values), i * block + 1, block)))
    both = F.aggregate(
        blocks,
        F.struct(zero.alias("before"), F.array().cast("array<array<bigint>>").alias("out")),
        lambda a, b: F.struct((a["before"] + at(b)).alias("before"), F.array_append(a["out"], F.transform(b, lambda v: v + a["before"])).alias("out")),
        lambda a: a["out"],
    )
    return F.flatten(both)


def dna_len(seq: Column | str) -> Column:
    """Residues, as bytes."""
    return F.octet_length(col(seq)).cast("long")


def actg_len(seq: Column | str) -> Column:
    """Residues that are A, C, G or T."""
    return F.octet_length(col(seq)).cast("long") - F.octet_length(F.translate(col(seq), ACTG, "")).cast("long")


def base_count(seq: Column | str, base: str) -> Column:
    """How often a base stands in seq, in either case."""
    return F.octet_length(col(seq)).cast("long") - F.octet_length(F.translate(col(seq), base.upper() + base.lower(), "")).cast("long")


def is_actg(seq: Column | str) -> Column:
    """Whether all residues are A, C, G or T; true of an empty sequence."""
    return F.translate(col(seq), ACTG, "") == ""


def actg_runs(seq: Column | str) -> Column:
    """The maximal runs of A, C, G and T, in order; none of them is empty."""
    return F.regexp_extract_all(col(seq), F.lit(RUN), F.lit(1))


def skip_non_actg(seq: Column | str) -> Column:
    """seq without other residues."""
    return F.regexp_replace(col(seq), "[^ACGTacgt]", "")


def first_non_actg(seq: Column | str) -> Column:
    """Where the first other residue stands, from 0; null if there is none."""
    prefix = F.regexp_extract(col(seq), "^[ACGTacgt]*", 0)
    return F.when(~is_actg(seq), F.length(prefix).cast("long"))


def base_error(seq: Column | str) -> Column:
    """The error struct of a sequence with another residue, else null."""
    at = first_non_actg(seq)
    byte = F.conv(F.hex(F.substring(col(seq).cast("binary"), (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    shown = F.lower(F.hex(F.substring(col(seq).cast("binary"), (at + 1).cast("int"), F.lit(1))))
    message = F.format_string(INVALID_BASE.format(byte="%s", char="%s", pos="%d"), shown, F.char(byte), at)
    return F.when(at.isNotNull(), F.struct(F.lit("InvalidBase").alias("kind"), byte.alias("byte"), at.alias("pos"), message.alias("message")))


def reject_non_actg(seq: Column | str) -> Column:
    """seq, or a failure of the query at the first other residue."""
    return F.when(is_actg(seq), col(seq)).otherwise(F.raise_error(base_error(seq)["message"]).cast("string"))


def pack_words(seq: Column | str) -> Column:
    """Two bits a residue, 32 residues a word; len div 32 + 1 words."""
    return words_of(digits(seq, _CODES), 32, 4)


def pack_dna(seq: Column | str) -> Column:
    """struct(len, words)."""
    return F.struct(dna_len(seq).alias("len"), pack_words(seq).alias("words"))


def packed_bytes(words: Column | str) -> Column:
    """The words as little-endian bytes: residue i in byte i / 4."""
    swapped = F.transform(col(words), lambda w: F.concat(*[F.substring(F.lpad(F.hex(w), 16, "0"), F.lit(15 - 2 * i), F.lit(2)) for i in range(8)]))
    return F.unhex(F.array_join(swapped, ""))


def words_from_bytes(packed: Column | str) -> Column:
    """The words of a little-endian binary whose length is a multiple of eight: the inverse of packed_bytes."""
    chunks = F.regexp_extract_all(F.hex(col(packed)), F.lit("(.{16})"), F.lit(1))
    return F.transform(chunks, lambda c: F.conv(F.concat(*[F.substring(c, F.lit(15 - 2 * i), F.lit(2)) for i in range(8)]), 16, -10).cast("long"))


def packed_from_bytes(length: Column, packed: Column | str) -> Column:
    """struct(len, words) of a length and packed bytes."""
    return F.struct(length.cast("long").alias("len"), words_from_bytes(packed).alias("words"))


def columnar_dna(seq: Column | str) -> Column:
    """struct(len, hi, lo): two bit planes of the codes, 64 residues a word."""
    return F.struct(dna_len(seq).alias("len"), words_of(digits(seq, _HIGH), 64, 2).alias("hi"), words_of(digits(seq, _LOW), 64, 2).alias("lo"))


def mask_non_actg(seq: Column | str) -> Column:
    """struct(len, words): a bit for each residue that is not A, C, G or T."""
    return F.struct(dna_len(seq).alias("len"), words_of(digits(seq, _OTHER), 64, 2).alias("words"))


def mask_n(seq: Column | str) -> Column:
    """struct(len, words): a bit for each N, in either case."""
    return F.struct(dna_len(seq).alias("len"), words_of(digits(seq, _N), 64, 2).alias("words"))


def code_at(words: Column | str, i: Column) -> Column:
    """The code of residue i (from 0) of packed words; null past the end."""
    word = F.get(col(words), (i / 32).cast("int"))
    return F.call_function("shiftrightunsigned", word, (2 * (i % 32)).cast("int")).bitwiseAND(F.lit(3)).cast("int")


def base_at(words: Column | str, i: Column) -> Column:
    return F.substring(F.lit("ACTG"), code_at(words, i) + 1, F.lit(1))


def columnar_code_at(planes: Column | str, i: Column) -> Column:
    """The code of residue i (from 0) of a columnar_dna struct."""
    bit = lambda p: F.call_function("shiftrightunsigned", F.get(col(planes)[p], (i / 64).cast("int")), (i % 64).cast("int")).bitwiseAND(F.lit(1))
    return (bit("hi") * 2 + bit("lo")).cast("int")


def mask_at(mask: Column | str, i: Column) -> Column:
    """Whether bit i (from 0) of a mask struct is set."""
    return F.call_function("shiftrightunsigned", F.get(col(mask)["words"], (i / 64).cast("int")), (i % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def unpack_dna(packed: Column | str) -> Column:
    """The upper-case text of a pack_dna struct."""
    fours = F.transform(col(packed)["words"], lambda w: F.reverse(F.lpad(F.conv(w.cast("string"), 10, 4), 32, "0")))
    return F.substring(F.translate(F.array_join(fours, ""), "0123", "ACTG"), F.lit(1), col(packed)["len"].cast("int"))


def unpack_columnar(planes: Column | str) -> Column:
    """The upper-case text of a columnar_dna struct. Bits become base-4 digits, so that one shift and one `or` give the codes of 32
    residues at a time."""

    def text(high: Column, low: Column) -> Column:
        high, low = (F.lpad(F.conv(w.cast("string"), 10, 2), 64, "0") for w in (high, low))
        digits_of = lambda bits, at: F.conv(F.substring(bits, F.lit(at), F.lit(32)), 4, -10).cast("long")
        codes = lambda at: F.shiftleft(digits_of(high, at), 1).bitwiseOR(digits_of(low, at))
        return F.concat(*[F.reverse(F.lpad(F.conv(codes(at).cast("string"), 10, 4), 32, "0")) for at in (33, 1)])

    found = F.array_join(F.zip_with(col(planes)["hi"], col(planes)["lo"], text), "")
    return F.translate(F.substring(found, F.lit(1), col(planes)["len"].cast("int")), "0123", "ACTG")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(col(seq), "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column | str) -> Column:
    """The lesser of a word and its reverse complement."""
    return F.least(col(kmer), reverse_complement(kmer))


def kmers(run: Column | str, k: int, stretch: int = 512) -> Column:
    """All words of k residues of a run, in order; none of a shorter one.

    The run is cut into stretches first, each with the k - 1 residues behind it: finding a place in a text takes time in
    proportion to the place, so a chromosome in one piece would take the square of its length.
    """
    pattern = F.lit("(.{1,%d})(?=(.{0,%d}))" % (stretch, k - 1))
    heads, tails = (F.regexp_extract_all(col(run), pattern, F.lit(group)) for group in (1, 2))

    def words(piece: Column) -> Column:
        last = F.length(piece) - k + 1
        found = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(piece, i, F.lit(k)))
        return F.when(last >= 1, found).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.zip_with(heads, tails, lambda a, b: F.concat(a, b)), words))


def phred_mean(quality: Column | str, offset: int = 33) -> Column:
    """The mean Phred score of a quality line."""
    scores = F.transform(F.split(col(quality), ""), lambda c: F.ascii(c) - offset)
    return F.aggregate(scores, F.lit(0).cast("long"), lambda a, s: a + s, lambda a: a / F.length(col(quality)))
