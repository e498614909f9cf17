"""Genes out of longer sequences: a window around the gene, its reading frames, the best of them.

A sequence's candidates are three frames and, if wanted, the frame-shift program's
reading. All need the dynamic programs of ``alignment``, so a sequence is one call of an
Arrow-batched function and nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe import genes
from cladeframe.operators import alignment

#: Local alignment that finds the window; ambiguous bases are N and neither match nor differ.
WINDOW = alignment.Scores(gap_open=-5.0, gap_extend=-1.0, wildcard="N")
FLANK = 30
BATCH = 1024  # sequences whose alignments are one batch of programs


@dataclass(frozen=True)
class Reading:
    """A reading of the gene: whole codons, their residues, both aligned to the reference."""

    stops: int
    score: float  # identity over columns that say something
    informative: int
    ignored: int
    frame: int
    nt: str
    aa: str
    aligned_ref: str
    aligned_query: str
    aligned_ref_nt: str
    aligned_query_nt: str
    signatures: int = 0


FIELDS = "stops int, score double, informative int, ignored int, frame int, nt string, aa string, aligned_ref string, aligned_query string, aligned_ref_nt string, aligned_query_nt string, signatures int"


def residues(nt: str) -> str:
    return "".join(genes.CODONS.get(nt[k : k + 3], "X") for k in range(0, len(nt) - 2, 3))


def gene_windows(pairs: list[tuple[str, str]], flank: int = FLANK) -> list[tuple[int, int] | None]:
    """Of each (sequence, gene) the stretch (from 0, end exclusive) that holds all of the gene and a margin; None if nothing aligns."""
    masked = [tuple(re.sub("[^ACGT]", "N", s) for s in pair) for pair in pairs]
    out: list[tuple[int, int] | None] = []
    for (seq, ref), al in zip(pairs, alignment.align_all(masked, WINDOW, local=True), strict=True):
        out.append(None if al.score <= 0 else (max(0, al.query_start - al.ref_start - flank), min(len(seq), al.query_end + len(ref) - al.ref_end + flank)))
    return out


def gene_window(seq: str, ref: str, flank: int = FLANK) -> tuple[int, int] | None:
    return gene_windows([(seq, ref)], flank)[0]


@dataclass(frozen=True)
class Coding:
    """Whole codons to be aligned with a gene, and what is known of its protein's ends."""

    nt: str
    ref: str
    frame: int
    begin: str = ""
    end: str = ""


def _overhang(aligned_ref: str) -> tuple[int, int]:
    """Residues before and after the reference's first and last."""
    inner = aligned_ref.strip("-")
    lead = aligned_ref.index(inner) if inner else 0
    return (lead, len(aligned_ref) - lead - len(inner)) if inner else (0, 0)


def codons_aligned(codings: list[Coding]) -> list[Reading]:
    """Whole codons along the reference's; what overhangs the reference is cut off and the rest is aligned again."""
    nts = [c.nt for c in codings]
    found = alignment.align_all([(residues(c.nt), residues(c.ref)) for c in codings])
    again = []
    for k, al in enumerate(found):
        lead, trail = _overhang(al.ref)
        kept = nts[k][3 * lead : len(nts[k]) // 3 * 3 - 3 * trail]
        if lead + trail and kept:
            nts[k] = kept
            again.append(k)
    for k, al in zip(again, alignment.align_all([(residues(nts[k]), residues(codings[k].ref)) for k in again]), strict=True):
        found[k] = al
    out = []
    for c, nt, al in zip(codings, nts, found, strict=True):
        aa = residues(nt)
        both = [(r, q) for r, q in zip(al.ref, al.query, strict=True) if r != "-" and q != "-"]
        said = [(r, q) for r, q in both if q not in "X*"]
        score = sum(r == q for r, q in said) / len(said) if said else 0.0
        known = int(bool(c.begin) and aa.startswith(c.begin)) + int(bool(c.end) and aa.endswith(c.end))
        out.append(Reading(aa.count("*"), score, len(said), len(both) - len(said), c.frame, nt, aa, al.ref, al.query, alignment.residues_to_codons(al.ref, c.ref), alignment.residues_to_codons(al.query, nt), known))
    return out


def codon_aligned(nt: str, ref: str, frame: int, begin: str = "", end: str = "") -> Reading:
    return codons_aligned([Coding(nt, ref, frame, begin, end)])[0]


@dataclass(frozen=True)
class Asked:
    """A sequence, the gene to find in it, its own frame (0 to 2) and known ends."""

    seq: str
    ref: str
    preferred: int | None = None
    begin: str = ""
    end: str = ""


def all_readings(asked: list[Asked], refine: bool = False, flank: int = FLANK) -> list[list[Reading]]:
    """All readings of every sequence's window, that of its preferred frame first, the frame-shift program's last."""
    codings: list[Coding] = []
    owner: list[int] = []
    windows = gene_windows([(a.seq, a.ref) for a in asked], flank)
    refined: list[dict] = []
    if refine:
        refined = alignment.frameshift_all([(residues(a.ref), a.seq[slice(*found)]) for a, found in zip(asked, windows, strict=True) if found is not None])
    following = iter(refined)
    for k, (a, found) in enumerate(zip(asked, windows, strict=True)):
        if found is None:
            continue
        start, window = found[0], a.seq[slice(*found)]
        for f in sorted(range(3), key=lambda f: a.preferred is None or (start + f) % 3 != a.preferred):
            coding = window[f : f + (len(window) - f) // 3 * 3]
            if coding:
                codings.append(Coding(coding, a.ref, (start + f) % 3, a.begin, a.end))
                owner.append(k)
        if refine:
            read = next(following)
            if read["nt"]:
                codings.append(Coding(read["nt"], a.ref, (start + read["nt_start"]) % 3, a.begin, a.end))
                owner.append(k)
    out: list[list[Reading]] = [[] for _ in asked]
    for k, reading in zip(owner, codons_aligned(codings), strict=True):
        out[k].append(reading)
    return out


def readings(seq: str, ref: str, preferred: int | None = None, refine: bool = False, begin: str = "", end: str = "", flank: int = FLANK) -> list[Reading]:
    return all_readings([Asked(seq, ref, preferred, begin, end)], refine, flank)[0]


def best_reading(found: list[Reading]) -> Reading | None:
    """Least stops, then identity, known ends, informative columns, least ignored ones; the first of equals."""
    return min(found, key=lambda x: (x.stops, -x.score, -x.signatures, -x.informative, x.ignored), default=None)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows by a hash of ``key`` over all shuffle partitions: extraction costs time, not bytes, so small tables aren't coalesced."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def extracted(seq: Column, ref: Column, preferred: Column | None = None, begin: Column | None = None, end: Column | None = None, refine: bool = False, flank: int = FLANK) -> Column:
    """struct of the best reading of the gene ``ref`` (bases) in ``seq``; its fields are null where nothing aligns.

    ``preferred``: the sequence's own frame (0 to 2), which wins ties; ``begin``, ``end``: residues that the gene is known to
    begin and end with; ``refine``: the frame-shift program's reading takes part.
    """

    @F.pandas_udf(FIELDS)
    def run(seqs: pd.Series, refs: pd.Series, frames: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
        asked = [Asked(s or "", r or "", None if pd.isna(f) else int(f), b or "", e or "") for s, r, f, b, e in zip(seqs, refs, frames, begins, ends, strict=True)]
        rows = []
        for a in range(0, len(asked), BATCH):
            best = [best_reading(x) for x in all_readings(asked[a : a + BATCH], refine, flank)]
            rows += [asdict(x) if x else {} for x in best]
        # Objects keep null integers apart from numbers.
        return pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")], dtype=object)

    text = lambda c: F.lit(None).cast("string") if c is None else c
    return run(seq, ref, F.lit(None).cast("int") if preferred is None else preferred.cast("int"), text(begin), text(end))
