"""Column expressions over base strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code, codons in TCAG order, * for stops.
CODON_ORDER = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# Ambiguity codes and the bases they stand for.
AMBIGUITY = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(seq: Column) -> Column:
    """The lesser of a word and its reverse complement."""
    return F.least(seq, reverse_complement(seq))


def canonical_by_middle(word: Column, k: int) -> Column:
    """The other rule for odd ``k``: the strand whose middle base is A or C; for even ``k`` the lesser strand."""
    if k % 2 == 0:
        return canonical(word)
    return F.when(F.substring(word, k // 2 + 1, 1).isin("G", "T"), reverse_complement(word)).otherwise(word)


def is_palindrome(seq: Column) -> Column:
    return seq == reverse_complement(seq)


def count_of(seq: Column, letters: str) -> Column:
    """How many characters are one of ``letters``."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_count(seq: Column) -> Column:
    return count_of(seq, "GC")


def gc_percent(seq: Column) -> Column:
    return 100.0 * gc_count(seq) / F.length(seq)


def is_homopolymer(seq: Column) -> Column:
    return F.length(seq) == F.greatest(*(count_of(seq, b) for b in "ACGT"))


def runs(seq: Column) -> Column:
    """The maximal runs of equal bases, as an array."""
    return F.regexp_extract_all(seq, F.lit("(A+|C+|G+|T+)"), F.lit(1))


def longest_run(seq: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(runs(seq), F.length)), F.lit(0))


def capped_runs(seq: Column, n: int) -> Column:
    """Runs of more than ``n`` equal bases cut to ``n``."""
    return F.regexp_replace(seq, f"(([ACGT])\\2{{{n - 1}}})\\2+", "$1")


def dominant_base(seq: Column) -> Column:
    """Struct of the most frequent base and its share in percent; the first of A, C, G, T at a tie."""
    rows = [F.struct(count_of(seq, b).alias("n"), F.lit(-i).alias("rank"), F.lit(b).alias("base")) for i, b in enumerate("ACGT")]
    best = F.greatest(*rows)
    return F.struct(best["base"].alias("base"), (100.0 * best["n"] / F.length(seq)).alias("percent"))


def kmer_array(seq: Column, k: int) -> Column:
    """All words of ``k`` bases in order; empty for shorter sequences."""
    n = F.length(seq) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_code(word: Column) -> Column:
    """Two bits per base, A = 0 to T = 3, up to 31 bases."""
    return F.conv(F.translate(word, "ACGT", "0123"), 4, 10).cast("long")


def shaped_kmer(seq: Column, pos: Column, shape: str) -> Column:
    """The word at ``pos`` (from 1) of a gapped shape such as ``110011``: only the places marked 1."""
    return F.concat(*(F.substr(seq, pos + i, F.lit(1)) for i, c in enumerate(shape) if c == "1"))


def amino_acid(codon: Column) -> Column:
    index = F.lit(0)
    for i in range(3):
        index = index * 4 + F.instr(F.lit(CODON_ORDER), F.substring(codon, i + 1, 1)) - 1
    return F.substr(F.lit(AMINO_ACIDS), index + 1, F.lit(1))


def translated(seq: Column, frame: int = 0) -> Column:
    """Amino acids of the whole codons from ``frame`` on."""
    n = F.floor((F.length(seq) - frame) / 3).cast("int")
    codons = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substr(seq, i * 3 + 1 + frame, F.lit(3)))
    return F.when(n > 0, F.concat_ws("", F.transform(codons, amino_acid))).otherwise("")


def open_frames(seq: Column) -> Column:
    """Open reading frames: a start codon, whole codons, the first stop codon; non-overlapping, leftmost first."""
    return F.regexp_extract_all(seq, F.lit("(ATG(?:[ACGT]{3})*?(?:TAA|TAG|TGA))"), F.lit(1))


def melting_temperature(seq: Column, salt: float = 0.05) -> Column:
    """Degrees by length class: 2 per A/T and 4 per G/C below 20 bases, else from GC content, length and salt."""
    n, gc = F.length(seq).cast("double"), gc_count(seq).cast("double")
    at = n - gc
    log_salt = F.log10(F.lit(float(salt)))
    short = 2 * at + 4 * gc
    middle = 81.5 + 16.6 * log_salt + 41 * gc / n - 600 / n
    long_ = 81.5 + 16.6 * log_salt + 41 * gc / n - 500 / n
    return F.when(n < 20, short).when(n <= 70, middle).otherwise(long_)


def expanded_ambiguity(code: Column) -> Column:
    """The bases that an ambiguity code stands for, as an array."""
    pairs = [x for c, bases in AMBIGUITY.items() for x in (F.lit(c), F.array(*(F.lit(b) for b in bases)))]
    return F.element_at(F.create_map(*pairs), code)


def ambiguity_pattern(pattern: str) -> str:
    """A regular expression for a pattern of ambiguity codes."""
    return "".join(c if len(AMBIGUITY[c]) == 1 else f"[{AMBIGUITY[c]}]" for c in pattern)


def digest(seq: Column, site: str, cut: int) -> Column:
    """Fragments of a linear digest: the sequence is cut ``cut`` bases into each place of ``site``."""
    body = ambiguity_pattern(site[:cut]), ambiguity_pattern(site[cut:])
    return F.split(F.regexp_replace(seq, f"({body[0]})(?={body[1]})", "$1|"), r"\|")


def suffix_prefix_overlap(left: Column, right: Column, least: int = 1) -> Column:
    """Length of the largest suffix of ``left`` that is a prefix of ``right``, 0 if below ``least``."""
    most = F.least(F.length(left), F.length(right))
    sizes = F.sequence(F.lit(least), F.greatest(most, F.lit(least)))
    return F.coalesce(F.array_max(F.filter(sizes, lambda n: (n <= most) & (F.right(left, n) == F.left(right, n)))), F.lit(0))


def mismatches(a: Column, b: Column) -> Column:
    """Places at which two sequences differ, over the shorter length, in one pass over both."""
    places = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y) & (x != "") & (y != ""))
    return F.size(F.filter(places, lambda d: d))


def quality(seq_pos: Column, base: Column) -> Column:
    """The made-up quality of a base at a place: (7 * code + 13 * place) mod 41."""
    return (F.ascii(base) * 7 + seq_pos * 13) % 41
