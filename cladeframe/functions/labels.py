"""Functions on headers, labels, free text and numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_empty(c: Column) -> Column:
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def or_null(c: Column) -> Column:
    return F.nullif(strip(c.cast("string")), F.lit(""))


def accession_of(header: Column) -> Column:
    return F.regexp_extract(header, r"^(\S+)", 1)


def versionless(accession: Column) -> Column:
    return F.substring_index(accession, ".", 1)


def ref_id(name: Column, rule: str = "prefix") -> Column:
    """Study id of a file name: before the first ``_`` (prefix), its leading digits, or a part that a ``_`` follows (strict)."""
    pattern = {"prefix": r"^([^_]*)", "digits": r"^(\d+)", "strict": r"^([^_]+)_"}[rule]
    return F.regexp_extract(name, pattern, 1)


def sanitize(label: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(label, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(clean == "", "job").otherwise(clean)


def number(c: Column) -> Column:
    return strip(c.cast("string")).try_cast("double")


def contains_ci(c: Column, value: Column) -> Column:
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(value))


def equals_ci(c: Column, value: Column) -> Column:
    return F.lower(blank_to_empty(c)) == F.lower(value)


def first_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def bounded_token(c: Column, pattern: str) -> Column:
    """A token that no letter or digit adjoins, in either case."""
    return F.coalesce(c, F.lit("")).rlike(rf"(?i)(?<![A-Za-z0-9])(?:{pattern})(?![A-Za-z0-9])")


def genotype(c: Column) -> Column:
    return F.regexp_extract(strip(c.cast("string")), r"^([1-8])", 1)


def subtype(c: Column, gt: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(low.rlike("^[a-z][a-z0-9]*$") & (gt != ""), F.concat(gt, low)).otherwise(low)


def genotype_subtype(c: Column) -> Column:
    """struct(genotype, subtype) said in free text, null if none: 'genotype 1a', 'subtype b', 'HCV-1a', or a bare '1a'; recombinants say none."""
    said = F.coalesce(strip(c), F.lit(""))
    find = lambda pattern: F.regexp_extract(said, pattern, 1)
    full = r"^[1-8][A-Za-z][A-Za-z0-9]*$"
    by_gt = find(r"(?i)\bgenotype\s*[:=]?\s*([1-8](?:[A-Za-z][A-Za-z0-9]*)?)\b")
    by_sub = find(r"(?i)\bsubtype\s*[:=]?\s*([1-8]?[A-Za-z][A-Za-z0-9]*)\b")
    by_virus = find(r"(?i)\bHCV[-\s]*([1-8][A-Za-z][A-Za-z0-9]*)\b")
    bare = find(r"^\s*([1-8][A-Za-z][A-Za-z0-9]*)\s*$")
    gt = genotype(by_gt)
    sub = F.when(by_sub != "", subtype(by_sub, gt)).when(by_gt.rlike(full), F.lower(by_gt)).otherwise("")
    sub = F.when((sub == "") & (by_virus != ""), F.lower(by_virus)).otherwise(sub)
    gt = F.when(gt != "", gt).otherwise(genotype(sub))
    none = (gt == "") & (sub == "")
    gt, sub = F.when(none, genotype(bare)).otherwise(gt), F.when(none, F.lower(bare)).otherwise(sub)
    return F.when(~F.contains(F.lower(said), F.lit("recombinant")) & ((gt != "") | (sub != "")), F.struct(gt.alias("genotype"), sub.alias("subtype")))


def first_genotype_subtype(columns: list[str]) -> Column:
    """struct(genotype, subtype, column_name) of the first column that says one; empty texts if none does."""
    found = [F.when(genotype_subtype(F.col(c)).isNotNull(), F.struct(genotype_subtype(F.col(c))["genotype"].alias("genotype"), genotype_subtype(F.col(c))["subtype"].alias("subtype"), F.lit(c).alias("column_name"))) for c in columns]
    return F.coalesce(*found, F.struct(*(F.lit("").alias(n) for n in ("genotype", "subtype", "column_name"))))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


def clone_key(c: Column) -> Column:
    """Without its last ``_`` part, if it has several."""
    text = squeeze(F.coalesce(c, F.lit("")))
    parts = F.filter(F.split(text, "_"), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "_")).otherwise(text)


def isolate_key(c: Column) -> Column:
    """Up to the word week or day, without blanks, ``_`` and ``-`` at its ends."""
    text = F.regexp_replace(squeeze(F.coalesce(c, F.lit(""))), r"(?i)\b(week|day)\b.*$", "")
    return F.regexp_replace(text, r"^[ _-]+|[ _-]+$", "")


def patient_code(comment: Column) -> Column:
    return squeeze(F.regexp_extract(F.coalesce(comment, F.lit("")), r"(?im)^Patient Code\s*::\s*(.+?)\s*$", 1))


def effective_isolate(isolate: Column, comment: Column) -> Column:
    """The comment's patient code if the isolate holds it, else the isolate."""
    own, code = blank_to_empty(isolate), patient_code(comment)
    return F.when((code != "") & F.contains(own, code), code).otherwise(own)


def structured_comment(record: Column) -> Column:
    """Bodies of the ``##...-START##`` blocks of a record's comment, unindented, joined by a blank line."""
    body = F.regexp_extract_all(record, F.lit(r"(?s)##[^\n#]*-START##\n?(.*?)##[^\n#]*-END##"), F.lit(1))
    return F.array_join(F.transform(body, lambda b: strip(F.regexp_replace(b, r"(?m)^ {12}", ""))), "\n\n")


def without_clone_suffix(c: Column) -> Column:
    text = strip(c)
    out = text
    for tag in ("cl", "qs", "clone"):  # the last is asked first
        head = F.regexp_extract(text, rf"(?i)^(.+?)[-_ ]{tag}[-_ ]?[a-z0-9]+$", 1)
        out = F.when(head != "", F.regexp_replace(head, r"^[ _-]+|[ _-]+$", "")).otherwise(out)
    return out


def likely_clone(fields: list[Column], isolate: Column, person: Column) -> Column:
    said = F.concat_ws(" ", *fields).rlike(r"(?i)\bclone\b|\bquasispecies\b|\bqs\b")
    return said | ((blank_to_empty(person) != "") & (blank_to_empty(isolate) != "") & (person != isolate))


def flatten(values: Column) -> Column:
    return F.array_join(values, " | ")


def normalize_text(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def organism_name(acronym: Column, common: Column, organism: Column) -> Column:
    words = F.split(strip(organism), r"\s+")
    return F.coalesce(or_null(acronym), or_null(common), F.array_join(F.slice(words, 1, 2), " "))


def distinct_queries(parts: list[Column]) -> Column:
    """Non-blank query strings in order, each once."""
    return F.array_distinct(F.filter(F.array(*(blank_to_empty(p) for p in parts)), lambda x: x != ""))


def sentences(c: Column) -> Column:
    return F.split(squeeze(c), r"(?<=[.!?])\s+")


def json_block(c: Column) -> Column:
    """JSON in a fenced block, else from the first bracket to the last."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(fenced != "", strip(fenced)).otherwise(F.regexp_extract(c, r"(?s)([\[{].*[\]}])", 1))


def positions(c: Column) -> Column:
    """Numbers of a comma-separated list; blanks are passed over."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: strip(x).try_cast("int")), lambda x: x.isNotNull())


def first_filled(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: F.coalesce(strip(x), F.lit("")) != ""), F.lit(0))


def job_id(stamp: Column, text: Column) -> Column:
    return F.concat(F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), F.substring(F.sha1(text), 1, 8))


def key_values(header: Column) -> Column:
    """``a=1|b=2`` as a map."""
    return F.str_to_map(header, F.lit(r"\|"), F.lit("="))


def reference_name(name: Column, gene: str) -> Column:
    """Genotype of ``HCV1NS3``."""
    return F.regexp_extract(name, f"^HCV([1-8]){gene}$", 1)


def genotype_name(name: Column) -> Column:
    """Subtype of ``Genotype1a`` or ``Genotype 1a``."""
    return F.lower(F.regexp_extract(name, r"(?i)^Genotype\s*([1-8][a-z0-9]*)$", 1))


def label_genotype(label: Column) -> Column:
    return F.regexp_extract(label, r"^GT(\d+)(?:\s|_)", 1)


def label_total(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, r"\((\d+)", 1), F.lit("")).cast("long")


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def round_significant(value: Column, digits: int = 2) -> Column:
    """Half-even rounding to significant digits; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, 0.0).otherwise(F.bround(value * scale, 0) / scale)


def format_percent(value: Column) -> Column:
    """No decimals from 10 on, one from 1 on, one significant digit below; '0' at 0 or less."""
    small = round_significant(value, 1)
    plain = F.regexp_replace(F.format_number(small, 12), r"\.?0+$", "")
    return F.when(value <= 0, "0").when(value >= 10, F.bround(value, 0).cast("bigint").cast("string")).when(value >= 1, F.format_number(F.bround(value, 1), 1)).otherwise(plain)


def cell_variants(cell: Column) -> Column:
    """array of 'A12.5' parts of a rendered cell."""
    return F.regexp_extract_all(cell, F.lit(r"([A-Z*]\d+(?:\.\d+)?)"), F.lit(1))
