"""Primer sites, demultiplexing and in-silico PCR."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.functions.iupac import CODES, revcomp

_BITS = {c: sum(1 << "ACGT".index(x) for x in v) for c, v in CODES.items()}


def _masks(text: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for c, m in _BITS.items():
        table[ord(c)] = table[ord(c.lower())] = m
    return table[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def sites(seq: str, pattern: str, most: int, mode: str) -> list[tuple[int, int]]:
    """(0-based start, mismatches) of all sites with at most ``most`` mismatches, in order.

    mode ``literal``: letters are equal; ``pattern``: codes of the pattern are classes, which the text's letters are in
    or equal to (lower case never is); ``both``: codes on either side stand for any of their
    bases, in either case, and a site may hang over an end, the letters beyond counting as mismatches.
    """
    n, m = len(seq), len(pattern)
    if not m or (mode != "both" and n < m):
        return []
    if mode == "both":
        s, p, over = _masks(seq), _masks(pattern), most
        s = np.concatenate([np.zeros(over, np.uint8), s, np.zeros(over, np.uint8)])
        if len(s) < m:
            return []
        wrong = np.zeros(len(s) - m + 1, int)
        for j in range(m):
            wrong += (s[j : j + len(wrong)] & p[j]) == 0
    else:
        over = 0
        s = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)
        wrong = np.zeros(n - m + 1, int)
        for j, c in enumerate(pattern):
            part = s[j : j + len(wrong)]
            ok = part == ord(c)
            if mode == "pattern":
                for x in CODES.get(c, ""):
                    ok = ok | (part == ord(x))
            wrong += ~ok
    return [(int(i) - over, int(wrong[i])) for i in np.nonzero(wrong <= most)[0]]


def find_primer_binding_sites(refs: DataFrame, primer: str, is_reverse: bool = False, max_mismatch: int = 3) -> DataFrame:
    """(name, start, end, mismatches): 1-based inclusive sites of a primer; codes are letters like others here. Null sequences have none."""
    pattern = (revcomp(primer) if is_reverse else primer).upper()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, i + 1, i + len(pattern), w) for n, s in zip(b.name, b.seq) if s for i, w in sites(s.upper(), pattern, max_mismatch, "literal")]
            yield pd.DataFrame(rows, columns=["name", "start", "end", "mismatches"])

    return refs.select("name", "seq").mapInPandas(run, f"name {dict(refs.dtypes)['name']}, start int, end int, mismatches int")


def split_tags(tag: str | None) -> tuple[str, str]:
    """Forward and reverse tag of a cell: parted at the first inner colon, else both the whole; upper case."""
    t = (tag or "").upper()
    at = t.find(":")
    return (t[:at], t[at + 1 :]) if 0 < at < len(t) - 1 else (t, t)


class PrimerTable:
    """Rows of a primer table, prepared for lookups by the tags found beside the primers."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.pairs = sorted({(r["forward_primer"], r["reverse_primer"]) for r in rows})
        self.tags: dict[tuple[str, str], dict[tuple[int, int], tuple[dict[tuple[str, str], int], list[int]]]] = {}
        for n, r in enumerate(rows):
            ft, rt = r["ftag"], revcomp(r["rtag"])
            plain, coded = self.tags.setdefault((r["forward_primer"], r["reverse_primer"]), {}).setdefault((len(ft), len(rt)), ({}, []))
            if set(ft + rt) <= set("ACGT"):
                plain.setdefault((ft, rt), n)
            else:
                coded.append(n)

    def first(self, pair: tuple[str, str], text: str, begin: int, end: int) -> int | None:
        """First row of this primer pair whose tags stand before ``begin`` and from ``end`` on."""
        found: list[int] = []
        for (nf, nr), (plain, coded) in self.tags[pair].items():
            if begin < nf or end + nr > len(text):
                continue
            left, right = text[begin - nf : begin], text[end : end + nr]
            if (left, right) in plain:
                found.append(plain[left, right])
            for n in coded:
                ft, rt = self.rows[n]["ftag"], revcomp(self.rows[n]["rtag"])
                if (not ft or sites(left, ft, 0, "pattern")) and (not rt or sites(right, rt, 0, "pattern")):
                    found.append(n)
                    break
        return min(found, default=None)


def assign(seq: str | None, table: PrimerTable, most: int) -> tuple | None:
    """(row number, insert, forward mismatches, reverse mismatches) of the first table row that fits a read."""
    if not seq:
        return None
    turned, best = revcomp(seq), None
    for pair in table.pairs:
        for text in (seq, turned):
            f = sites(text, pair[0], most, "pattern")
            r = sites(text, revcomp(pair[1]), most, "pattern") if f else []
            if f and r:
                a, end = f[0][0] + len(pair[0]), r[-1][0]
                n = table.first(pair, text, f[0][0], end + len(pair[1])) if a < end else None
                if n is not None and (best is None or n < best[0]):
                    best = (n, text[a:end], min(w for _, w in f), min(w for _, w in r))
                break
    return best


def demultiplex(reads: DataFrame, primer_table: DataFrame, primer_mismatch: int = 3, with_tag: bool = True, most_rows: int = 100_000) -> DataFrame:
    """All reads with identified, exp, sample, tag, fwd, rev, fwd_mismatch, rev_mismatch and, where identified, the insert as seq.

    The first row of the primer table (by its column ``row_no``) that fits decides. A read is searched in both directions;
    sites allow substitutions only. Mismatches told are those of the winning pair. The table is small and its size is checked,
    as every task holds it. Null reads are unidentified.
    """
    if primer_table.count() > most_rows:
        raise ValueError(f"a primer table of more than {most_rows} rows is not held by a task; split it by primer pair")
    table = []
    for r in primer_table.orderBy("row_no").collect():
        ft, rt = split_tags(r["tags"]) if with_tag else ("", "")
        table.append({"exp": r["exp"], "sample": r["sample"], "ftag": ft, "rtag": rt, "forward_primer": r["forward_primer"].upper(), "reverse_primer": r["reverse_primer"].upper()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prepared = PrimerTable(table)
        for b in batches:
            out = []
            for rec, ident, seq in zip(b.rec_no, b.id, b.seq):
                hit = assign(seq, prepared, primer_mismatch)
                if hit is None:
                    out.append((rec, ident, seq, False, None, None, None, None, None, None, None))
                else:
                    row = table[hit[0]]
                    out.append((rec, ident, hit[1], True, row["exp"], row["sample"], f"{row['ftag']}+{row['rtag']}" if with_tag else "none", row["forward_primer"], row["reverse_primer"], hit[2], hit[3]))
            yield pd.DataFrame(out, columns=["rec_no", "id", "seq", "identified", "exp", "sample", "tag", "fwd", "rev", "fwd_mismatch", "rev_mismatch"])

    return reads.select("rec_no", "id", "seq").mapInPandas(run, "rec_no long, id string, seq string, identified boolean, exp string, sample string, tag string, fwd string, rev string, fwd_mismatch int, rev_mismatch int")


def _strict(primer: str) -> tuple[str, list[int]]:
    """Primer without ``#`` and the 0-based places of the letters that a ``#`` follows."""
    out, places = [], []
    for c in primer:
        if c == "#":
            places.append(len(out) - 1)
        else:
            out.append(c)
    return "".join(out).upper(), [p for p in places if p >= 0]


def amplicons(seq: str, forward: str, reverse: str, mis_match: int, trim: bool, max_hits: int, drop_whole: bool = True) -> list[tuple[int, int, str]]:
    """(begin, end, text), 1-based, of all products of a primer pair on one strand."""
    fwd, f_strict = _strict(forward)
    rev, r_strict = _strict(reverse)
    back = revcomp(rev)
    r_strict = [len(rev) - 1 - p for p in r_strict]
    f_sites = [(i + 1, i + len(fwd)) for i, _ in sites(seq, fwd, mis_match, "both")[:max_hits]]
    r_sites = [(i + 1, i + len(back)) for i, _ in sites(seq, back, mis_match, "both")[:max_hits]]
    masks, out = _masks(seq), []
    fits = lambda at, c: 1 <= at <= len(seq) and bool(masks[at - 1] & _BITS.get(c, 0))
    for r in r_sites:
        for f in f_sites:
            a, b = (r, f) if f[1] > r[1] else (f, r)
            if a[1] >= b[0]:
                continue
            if not (all(fits(a[1] - len(fwd) + 1 + p, fwd[p]) for p in f_strict) and all(fits(b[0] + p, back[p]) for p in r_strict)):
                if drop_whole:
                    return []
                continue
            x, y = (a[1] + 1, b[0] - 1) if trim else (max(1, a[0]), min(len(seq), b[1]))
            out.append((x, y, seq[x - 1 : y]))
    return out


def in_silico(refs: DataFrame, pairs: list[tuple[str, str]], mis_match: int = 3, try_reverse: bool = False, trim: bool = True, max_hits: int = 5, keep_genome: bool = False, keep_genome_threshold: int = 10_000, drop_whole: bool = True) -> DataFrame:
    """(primer_pair, name, begin, end, seq): products of each primer pair ``F_<forward>__R_<reverse>``.

    Codes are wildcards on both sides. A ``#`` after a letter makes its place strict, and a reference
    with a product that breaks it gives none (``drop_whole``) or loses that product. With ``try_reverse`` references are
    also read backwards, named ``[REVERSE]``. References of ``keep_genome_threshold`` letters or more are left out unless ``keep_genome``.
    """
    use = refs.where(F.col("seq").isNotNull())
    if not keep_genome:
        use = use.where(F.length("seq") < keep_genome_threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, seq in zip(b.name, b.seq):
                strands = [(name, seq.upper()), *([(f"[REVERSE]{name}", revcomp(seq.upper()))] if try_reverse else [])]
                for label, text in strands:
                    out.extend((f"F_{f}__R_{r}", label, *hit) for f, r in pairs for hit in amplicons(text, f, r, mis_match, trim, max_hits, drop_whole))
            yield pd.DataFrame(out, columns=["primer_pair", "name", "begin", "end", "seq"])

    return use.select(F.col("name").cast("string").alias("name"), "seq").mapInPandas(run, "primer_pair string, name string, begin int, end int, seq string")


def in_silico_multiprimer(refs: DataFrame, forwards: list[str], reverses: list[str], **options) -> DataFrame:
    """``in_silico`` over primer pairs given as two lists of one length."""
    if len(forwards) != len(reverses):
        raise ValueError("forwards and reverses must have the same length")
    return in_silico(refs, list(zip(forwards, reverses)), **options)
