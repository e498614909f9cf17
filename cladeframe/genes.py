"""Gene parameters and sequence tables: data, not code paths."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Gene:
    name: str
    positions: tuple[int, ...]  # resistance positions
    window: tuple[int, int]
    reference_length: int
    reference_label: str
    genome_start: int | None
    divergence_percent: float
    divergence_coverage: int


# Resistance positions, windows, reference lengths and quality limits by gene.
GENES = {
    "NS3": Gene("NS3", (36, 41, 43, 54, 55, 56, 80, 122, 155, 156, 158, 166, 168, 170, 175), (36, 175), 631, "NS3", None, 15.0, 0),
    "NS5A": Gene("NS5A", (24, 26, 28, 29, 30, 31, 32, 38, 58, 62, 92, 93), (24, 93), 213, "NS5A_NTD", 6258, 30.0, 0),
    "NS5B": Gene("NS5B", (150, 159, 206, 282, 316, 320, 321), (150, 321), 591, "NS5B", 7605, 30.0, 250),
}

# Residue order, symbols and the standard genetic code in TCAG order.
AA_ORDER = "ACDEFGHIKLMNPQRSTVWY*"
VALID_AA = "ACDEFGHIKLMNPQRSTVWY"
MISSING_AA = "-X?*"
BASES = "TCAG"
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
COMPLEMENT = ("ACGTRYSWKMBDHVNU", "TGCAYRSWMKVHDBNA")

CODONS = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}

MIN_OVERLAP_NT = 200
MIN_OVERLAP_AA = 80
MIN_GROUP = 10
EXEMPT_GENOTYPES = ("7", "8")  # of the group floor where calls are external


def iupac_codons() -> dict[str, str]:
    """Residue of every codon of ambiguity codes: one residue if all expansions agree, else X."""
    out = {}
    for a, x in IUPAC.items():
        for b, y in IUPAC.items():
            for c, z in IUPAC.items():
                found = {CODONS[i + j + k] for i in x for j in y for k in z}
                out[a + b + c] = found.pop() if len(found) == 1 else "X"
    return out
