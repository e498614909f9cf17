"""Secret scans in DataFrame functions alone.

Three patterns give the base spans. A battery of randomness tests gives further ones,
from every stretch of at least ``CANDIDATE`` characters that holds a letter. The
stretch's encoding is inferred from its characters (``ENCODINGS``, the first that fits)
and sets the alphabet and the constants of three tests: chi-squared uniformity over that
alphabet, the number of runs of character classes (vowels and consonants where there is
one class only; elsewhere a capital before a small letter begins a word) and the serial
correlation of neighbours' places in the alphabet.

A stretch passes if no test rejects that it is drawn at random (``GATE`` standard
errors). Passing says little of short stretches, so it must also be unlike ordinary
text: Fisher's method combines the chances that ordinary text is as uniform and has such
runs. Within each class of length, the Benjamini-Hochberg rule over the candidates of
all documents keeps false discoveries below ``FALSE_RATE``: probabilities are counted in
tenths of a decade, so only a table of classes and bins reaches the driver.

A regular expression's matches get their places from the lengths of the pieces
between them: all in one row, so neither joins nor groups are needed.

Cases: null is the empty text; no matches give empty strings and the digest of an
empty string; repeated rows are scanned each; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm import shared

# The base patterns, the group that is measured and its least length.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{32,})"  # whole runs, as the pattern is greedy and starts leftmost
PATTERNS = {"assign": (ASSIGN, 2, 8), "access": (ACCESS, 1, 16), "hex": (HEX, 1, 32)}
CANDIDATE = 20
STRETCH = rf"([A-Za-z0-9+/_=-]{{{CANDIDATE},}})"
LENGTH_CLASSES = (20, 24, 32, 48, 64)
FALSE_RATE = 0.01
GATE = 3.7  # standard errors from what a random string has


@dataclass(frozen=True)
class Encoding:
    """What a random string and ordinary text look like in an encoding. ``change``, ``spread``: mean and variance of a random
    string's changes of class a step; ``text_change``: ordinary text's; ``equal``, ``triple``: chance that two, three of its characters are equal.
    ``vowels``: classes are vowels and consonants. ``folds``: in one case, whichever."""

    pattern: str
    alphabet: str
    change: float
    spread: float
    text_change: float
    equal: float = 0.066
    triple: float = 0.0054
    vowels: bool = False
    folds: bool = False


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: In order; the last fits all. Changes of two classes follow from their shares, those of three from simulation.
ENCODINGS = (
    Encoding("^([a-z]+|[A-Z]+)$", LOWER, 0.311, 0.332, 0.62, vowels=True, folds=True),
    Encoding("^[A-Za-z]+$", UPPER + LOWER, 0.249, 0.183, 0.05),
    Encoding("^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 0.469, 0.278, 0.12, 0.12, 0.017, folds=True),
    Encoding("^[A-Z2-7]+$", UPPER + "234567", 0.305, 0.331, 0.08),
    Encoding("^([a-z0-9]+|[A-Z0-9]+)$", DIGITS + LOWER, 0.401, 0.32, 0.12, folds=True),
    Encoding("", UPPER + LOWER + DIGITS + "+/", 0.479, 0.305, 0.15),
)


def matches(text: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<s, e, v>> of the pattern's matches whose group is long enough: code points, end exclusive."""
    zipped = F.when(F.col(text).rlike(pattern), F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"), F.split(text, pattern, -1).alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        # The last piece has no match after it.
        s = acc["at"] + F.length(x["gap"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["g"].alias("v")))
        return F.struct(e.alias("at"), F.when(F.length(x["g"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.coalesce(F.aggregate(zipped, start, step, lambda acc: acc["out"]), start["out"])


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution at z (from below 1e-300 to 1), by a bound-like closed form."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) * poly / math.sqrt(2 * math.pi)
    return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-300))


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once (a lambda's own variable)."""
    return F.get(F.transform(F.array(value), then), 0)


def _encoding(value: Column) -> Column:
    """The constants of the first encoding whose alphabet holds all of ``value``."""
    fields = lambda e: F.struct(*(F.lit(getattr(e, k)).alias(k) for k in ("change", "spread", "text_change", "equal", "triple", "vowels", "folds", "alphabet")), F.lit(float(len(e.alphabet))).alias("size"))
    out = fields(ENCODINGS[-1])
    for e in reversed(ENCODINGS[:-1]):
        out = F.when(value.rlike(e.pattern), fields(e)).otherwise(out)
    return out


def _changes(value: Column, vowels: Column) -> Column:
    """Number of neighbours that differ in class."""
    cased = value
    for pattern, sign in (("[A-Z](?=[a-z])", "a"), ("[a-z]", "a"), ("[A-Z]", "B"), ("[0-9]", "0"), ("[+/_-]", "-")):
        cased = F.regexp_replace(cased, pattern, sign)
    spoken = F.regexp_replace(F.regexp_replace(F.lower(value), "[aeiou]", "1"), "[a-z]", "2")
    return F.length(F.regexp_replace(F.when(vowels, spoken).otherwise(cased), r"(.)\1*", ".")).cast("double") - 1


def _uniformity(x: Column) -> tuple[Column, Column]:
    """Standard errors of chi-squared above that of a random string, and below that of ordinary text; from equal pairs."""
    n, size, equal = x["n"], x["e"]["size"], x["e"]["equal"]
    chi = (n + 2 * x["pairs"]) * size / n - n
    text = (n + n * (n - 1) * equal) * size / n - n
    text_spread = F.sqrt(2 * n * (n - 1) * (equal * (1 - equal) + 2 * (n - 2) * (x["e"]["triple"] - equal * equal))) * size / n
    return (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n), (text - chi) / text_spread


def _runs(x: Column) -> tuple[Column, Column]:
    """Standard errors of the changes of class from a random string's, and from ordinary text's on the random side."""
    e, steps = x["e"], x["n"] - 1
    side = F.when(e["text_change"] < e["change"], 1.0).otherwise(-1.0)
    return (x["changes"] - steps * e["change"]) / F.sqrt(steps * e["spread"]), side * (x["changes"] - steps * e["text_change"]) / F.sqrt(steps * e["text_change"] * (1 - e["text_change"]))


def _serial(x: Column) -> Column:
    """Standard errors of the correlation between neighbours' places in the alphabet."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, y: a + y)

    def correlation(off: Column) -> Column:
        square = total(F.transform(off, lambda y: y * y))
        cross = total(F.zip_with(off, F.slice(off, 2, F.size(off)), lambda y, z: F.coalesce(y * z, F.lit(0.0))))
        return F.when(square > 0, (cross / square + 1 / x["n"]) * F.sqrt(x["n"])).otherwise(F.lit(math.inf))

    return _let(total(x["place"]) / x["n"], lambda mean: _let(F.transform(x["place"], lambda y: y - mean), correlation))


def probability(value: Column) -> Column:
    """Chance of the battery's result for ordinary text; 1 for stretches that a test rejects as not random."""
    state = F.struct(F.lit("").alias("c"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("pairs"))

    def folded(acc: Column, c: Column) -> Column:
        run = F.when(acc["c"] == c, acc["run"] + 1).otherwise(0)
        return F.struct(c.alias("c"), run.alias("run"), (acc["pairs"] + run).alias("pairs"))

    def measured(v: Column, e: Column, chars: Column) -> Column:
        pairs = F.aggregate(F.array_sort(chars), state, folded, lambda acc: acc["pairs"])
        place = F.transform(chars, lambda c: F.instr(e["alphabet"], c).cast("double"))
        return F.struct(e.alias("e"), F.length(v).cast("double").alias("n"), pairs.alias("pairs"), _changes(v, e["vowels"]).alias("changes"), place.alias("place"))

    def judged(x: Column) -> Column:
        chi, text_chi = _uniformity(x)
        runs, text_runs = _runs(x)
        random = (chi < GATE) & (F.abs(runs) < GATE) & (F.abs(_serial(x)) < GATE)
        combined = _let(F.log(_tail(text_chi)) + F.log(_tail(text_runs)), lambda log: F.least(F.exp(log) * (1 - log), F.lit(1.0)))
        return F.when((x["n"] >= CANDIDATE) & random, combined).otherwise(F.lit(1.0))

    bare = F.regexp_replace(value, "=+$", "")
    bare = F.when(value.rlike("[0-9]"), bare).otherwise(F.regexp_replace(value, "[+/_=-]", ""))
    lower = lambda v, e: F.when(e["folds"], F.lower(v)).otherwise(v)
    chance = _let(bare, lambda v: _let(_encoding(v), lambda e: _let(F.split(lower(v, e), ""), lambda chars: _let(measured(v, e, chars), judged))))
    return F.when(value.rlike("[A-Za-z]"), chance).otherwise(F.lit(1.0))


def _class_of(n: Column) -> Column:
    out = F.lit(LENGTH_CLASSES[0])
    for low in LENGTH_CLASSES[1:]:
        out = F.when(n >= low, F.lit(low)).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    """Tenths of a decade below 1."""
    return F.floor(-F.log10(p) * 10).cast("int")


def thresholds(candidates: DataFrame, rate: float = FALSE_RATE) -> dict[int, int]:
    """Least bin that is a discovery by class of length: of m candidates the largest k with p(k) <= rate * k / m."""
    counts = candidates.groupBy("class", "bin").count().collect()  # classes times bins, at most 5 * 3001
    out = {}
    for low in LENGTH_CLASSES:
        own = sorted(((r["bin"], r["count"]) for r in counts if r["class"] == low), reverse=True)
        m, k = sum(c for _, c in own), 0
        for b, c in own:
            k += c
            if 10 ** (-b / 10) <= rate * k / m:
                out[low] = b
    return out


def scan_secrets(docs: DataFrame, rate: float = FALSE_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: array<struct<start, end, kind, p>> in order of start, then kind as in KINDS."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    scanned = own.select("doc_id", *(matches("text", *PATTERNS[k]).alias(k) for k in PATTERNS), matches("text", STRETCH, 1, CANDIDATE).alias("stretch"))
    rated = F.transform("stretch", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _class_of(x["e"] - x["s"]).alias("class"), probability(x["v"]).alias("p")))
    slim = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    kept = shared.stored(scanned.select("doc_id", *(slim(k).alias(k) for k in PATTERNS), rated.alias("stretch")), "secrets")
    at = thresholds(kept.select(F.explode("stretch").alias("c")).select("c.class", _bin(F.col("c.p")).alias("bin")), rate)
    least = F.create_map(*(F.lit(x) for low in LENGTH_CLASSES for x in (low, at.get(low, 1 << 30))))

    def ordered(kind: str, order: int) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("start"), F.lit(order).alias("order"), x["e"].alias("end"), F.lit(None).cast("double").alias("p")))

    named = [ordered(k, i) for i, k in enumerate(PATTERNS)]
    flat = kept.withColumn("base", F.array_sort(F.concat(*named))).withColumn("least", least)
    hit = F.filter("stretch", lambda x: (_bin(x["p"]) >= F.element_at("least", x["class"])) & ~F.exists("base", lambda b: (b["start"] < x["e"]) & (x["s"] < b["end"])))
    more = F.transform(hit, lambda x: F.struct(x["s"].alias("start"), F.lit(len(PATTERNS)).alias("order"), x["e"].alias("end"), x["p"].alias("p")))
    names = F.array(*(F.lit(k) for k in KINDS))
    told = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at("names", x["order"] + 1).alias("kind"), x["p"].alias("p")))
    out = flat.withColumn("every", F.array_sort(F.concat("base", more))).withColumn("names", names)
    return out.select("doc_id", told("every").alias("found"))


def rendered(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
