"""Nucleotide letters: complement, ambiguity classes and quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC ambiguity codes and their complements.
CODES = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
COMPLEMENT_FROM = "ACGTRYKMBDHVacgtrykmbdhv"
COMPLEMENT_TO = "TGCAYRMKVHDBtgcayrmkvhdb"
_TABLE = str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse_complement(seq: Column) -> Column:
    """Reverse complement in either case; other letters stay. Null stays null."""
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def revcomp(seq: str) -> str:
    return seq.translate(_TABLE)[::-1]


def class_regex(pattern: str) -> str:
    """Regular expression of an IUPAC pattern; letters outside the code stand for themselves."""
    return "".join(f"[{CODES[c]}{c if c not in CODES[c] else ''}]" if c in CODES and len(CODES[c]) > 1 else c for c in pattern.upper())


def correct_probability(quality: Column) -> Column:
    """Probability that a base call with this Phred+33 character is right; qualities are held to 0..93."""
    q = F.least(F.greatest(F.ascii(quality) - 33, F.lit(0)), F.lit(93))
    return F.lit(1.0) - F.pow(F.lit(10.0), -q / 10)


def dna(text: Column) -> Column:
    """A 32-letter sequence made of a text, for tests on tables without sequences."""
    return F.translate(F.md5(text), "0123456789abcdef", "ACGTACGTACGTACGT")
