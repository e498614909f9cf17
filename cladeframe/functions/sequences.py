"""Sequence functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cladeframe import genes


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in sorted(table.items()) for x in pair))


def normalize_nt(seq: Column, mask: bool = False) -> Column:
    """Upper case, U as T; other than ambiguity codes is deleted, or masked by N."""
    up = F.translate(F.upper(F.regexp_replace(seq, r"\s", "")), "U", "T")
    return F.regexp_replace(up, f"[^{''.join(genes.IUPAC)}]", "N" if mask else "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), *genes.COMPLEMENT))


def codons(seq: Column) -> Column:
    """Whole codons; an incomplete last one is dropped."""
    n = F.floor(F.length(seq) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.substring(seq, k * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def _translated(seq: Column, table: dict[str, str], gaps: bool = False) -> Column:
    aa = lookup(table)
    one = lambda c: F.coalesce(F.element_at(aa, c), F.lit("X"))
    if gaps:
        plain = one
        one = lambda c: F.when(c == "---", F.lit("-")).otherwise(plain(c))
    return F.array_join(F.transform(codons(F.upper(seq)), one), "")


def translate(seq: Column) -> Column:
    """Residues by codon; a codon with anything but ACGT is X."""
    return _translated(seq, genes.CODONS)


def translate_iupac(seq: Column) -> Column:
    """As ``translate``, but an ambiguous codon whose expansions agree has their residue."""
    return _translated(seq, genes.iupac_codons())


def translate_gapped(seq: Column) -> Column:
    """As ``translate``; a codon of gaps is a gap."""
    return _translated(seq, genes.CODONS, gaps=True)


def frame_shift(first_na: Column) -> Column:
    """Bases before the first whole codon of a gene that starts at ``first_na`` (from 1)."""
    return F.pmod(F.lit(3) - F.pmod(first_na - 1, F.lit(3)), F.lit(3)).cast("int")


def frames(seq: Column) -> Column:
    """The three forward translations."""
    return F.array(*(translate(F.substring(seq, k + 1, 1 << 30)) for k in range(3)))


def aa_window(seq: Column, start: Column) -> Column:
    """Translation of an aligned stretch that starts at reference base ``start``: leading bases up to the next codon are trimmed."""
    return translate(F.substring(seq, frame_shift(start) + 1, F.length(seq)))


def aa_window_start(start: Column) -> Column:
    """Reference residue at which ``aa_window`` starts."""
    return F.floor((start - 1 + frame_shift(start)) / 3).cast("int") + 1


def residue_at(seq: Column, start: Column, pos: Column) -> Column:
    """The residue of a sequence that begins at ``start``; null outside it."""
    k = pos - start + 1
    return F.when((k >= 1) & (k <= F.length(seq)), F.substring(seq, k.cast("int"), F.lit(1)))


def base_at(seq: Column, start: Column, pos: Column) -> Column:
    """Base of a nucleotide sequence that begins at residue ``start``; anything but ACGT is a gap, null outside."""
    base = residue_at(seq, (start - 1) * 3 + 1, pos)
    return F.when(base.isNotNull(), F.when(base.rlike("^[ACGT]$"), base).otherwise("-"))


def is_nucleotide(seq: Column) -> Column:
    return F.coalesce(F.upper(seq).rlike(f"^[{''.join(genes.IUPAC)}U-]+$"), F.lit(False))


def residue_score(ref: Column, query: Column) -> Column:
    return F.when(query == "X", -3).when(query == "*", -6).when(ref == query, 3).otherwise(-2)


def chars(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda c: c != "")


def _columns(ref: Column, query: Column) -> Column:
    return F.zip_with(chars(ref), chars(query), lambda a, b: F.struct(a.alias("r"), b.alias("q")))


def identity(ref: Column, query: Column) -> Column:
    """Matches by informative columns: query residues X and * and gaps of either side say nothing; null without any."""
    said = F.filter(_columns(ref, query), lambda x: ~x["q"].isin("X", "*", "-") & (x["r"] != "-"))
    return F.when(F.size(said) > 0, F.size(F.filter(said, lambda x: x["r"] == x["q"])) / F.size(said))


def marker(ref: Column, query: Column, blank: str = "-X*") -> Column:
    """Alignment marks: '|' for equal, '.' for different, blank where either holds one of ``blank``."""
    none = lambda c: c.isin(*blank)
    return F.array_join(F.transform(_columns(ref, query), lambda x: F.when(none(x["r"]) | none(x["q"]), " ").when(x["r"] == x["q"], "|").otherwise(".")), "")


def _walk(ref: Column, query: Column) -> Column:
    """Columns with the reference position and the place within an insertion."""
    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("i"), F.expr("cast(array() as array<struct<r:string,q:string,p:int,i:int>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = x["r"] == "-"
        p, i = acc["p"] + F.when(gap, 0).otherwise(1), F.when(gap, acc["i"] + 1).otherwise(0)
        return F.struct(p.alias("p"), i.alias("i"), F.concat(acc["out"], F.array(F.struct(x["r"].alias("r"), x["q"].alias("q"), p.alias("p"), i.alias("i")))).alias("out"))

    return F.aggregate(_columns(ref, query), start, step, lambda acc: acc["out"])


def _numbered(rows: Column, text) -> Column:
    """Entries of one reference position that lie in an insertion are numbered from 1 among themselves."""
    start = F.struct(F.lit(-1).alias("p"), F.lit(0).alias("n"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        n = F.when(x["i"] == 0, 0).when(acc["p"] == x["p"], acc["n"] + 1).otherwise(1)
        return F.struct(x["p"].alias("p"), n.alias("n"), F.concat(acc["out"], F.array(text(x, n))).alias("out"))

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def stop_positions(ref: Column, query: Column) -> Column:
    """Reference places of stops: ``12``, or ``12+ins1`` within an insertion."""
    stops = F.filter(_walk(ref, query), lambda x: x["q"] == "*")
    return _numbered(stops, lambda x, n: F.when(x["i"] == 0, x["p"].cast("string")).otherwise(F.concat(x["p"].cast("string"), F.lit("+ins"), n.cast("string"))))


def insertions(ref: Column, query: Column) -> Column:
    found = F.filter(_walk(ref, query), lambda x: (x["i"] > 0) & (x["q"] != "-"))
    return _numbered(found, lambda x, n: F.concat(x["p"].cast("string"), F.lit("+ins"), n.cast("string"), F.lit(":"), x["q"]))


def deletions(ref: Column, query: Column) -> Column:
    found = F.filter(_walk(ref, query), lambda x: (x["i"] == 0) & (x["q"] == "-"))
    return F.transform(found, lambda x: F.concat(x["p"].cast("string"), F.lit(":"), x["r"]))


def edges(seq: Column, n: int = 3) -> tuple[Column, Column]:
    """First and last residues."""
    return F.substring(seq, 1, n), F.right(seq, F.lit(n))


def wrap(seq: Column, width: int = 70) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def split_terminal(seq: Column, codons_first: int = 213) -> tuple[Column, Column]:
    """A gene's N-terminal domain, of so many codons, and the rest."""
    return F.substring(seq, 1, codons_first * 3), F.substring(seq, codons_first * 3 + 1, 1 << 30)


def flank_slice(seq: Column, frame: Column, first_aa: Column, last_aa: Column, flank: int = 15) -> Column:
    """Bases of a residue range in a frame, with a margin."""
    low = F.greatest(F.lit(0), frame + (first_aa - 1) * 3 - flank)
    high = F.least(F.length(seq), frame + last_aa * 3 + flank)
    return F.substring(seq, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
