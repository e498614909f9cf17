"""One plan for every gene: what differs between genes is in ``genes.GENES`` and in the options.

Every step is a lazy table; nothing is written between steps. Two ways lead to
assignments: alignment hits, or external calls. Options name the places where the
established workflows differ or where their documented and actual behaviour do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cladeframe import genes, workdir
from cladeframe.functions import labels, sequences
from cladeframe.operators import alignment, distance, extraction, hits, profiles, search, selection, sized

LABEL_COLUMNS = ["source_note", "source_organism", "source_strain", "source_serotype"]


@dataclass(frozen=True)
class Options:
    """``subtype_min_nt``: least aligned bases of subtype hits (0: none are dropped). ``keep_blank``: sequences without an
    extracted protein stay, as blanks. ``quality_gate``: only sequences that pass go into profiles. ``all_positions``: profiles
    take sequences with a residue at every resistance position only. ``exempt``: genotypes without a group floor."""

    subtype_min_nt: int = 0
    keep_blank: bool = False
    quality_gate: bool = False
    all_positions: bool = False
    exempt: tuple[str, ...] = ()
    least_percent: float = 1.0


#: As the established workflows run; keys are gene and whether calls are external.
DEFAULTS = {
    ("NS3", False): Options(keep_blank=True), ("NS5A", False): Options(quality_gate=True), ("NS5B", False): Options(),
    ("NS3", True): Options(keep_blank=True, quality_gate=True, exempt=genes.EXEMPT_GENOTYPES), ("NS5A", True): Options(exempt=genes.EXEMPT_GENOTYPES), ("NS5B", True): Options(quality_gate=True, all_positions=True, exempt=genes.EXEMPT_GENOTYPES),
}


# What says that a gene is present.
PRESENT = ("yes", "y", "true", "1", "present")


@dataclass(frozen=True)
class Staged:
    """``entries``: ref_id, header, accession, seq in file order; ``seed``: ref_id, ref_name, patients, count; ``counters``: one row."""

    entries: DataFrame
    seed: DataFrame
    counters: DataFrame


def staged(metadata: DataFrame, fasta: DataFrame, gene: str) -> Staged:
    """What the metadata (ref_id, accession, ``gene``, ordinal) select for a run, out of the first file of each study (``read_fasta``).

    A metadata row has the first reason for which it is left out: ``no_gene``, ``missing_id``,
    ``duplicate`` (of an earlier row's study and accession). A selected accession is
    ``missing_fasta`` (its study has no file) or ``missing_sequence`` (the file lacks it). Reasons
    are counted while the marked rows are written: no pass of their own.
    """
    study, name = (F.coalesce(F.trim(c), F.lit("")) for c in ("ref_id", "accession"))
    able = metadata.select(study.alias("ref_id"), name.alias("accession"), F.lower(F.trim(F.coalesce(F.col(gene), F.lit("")))).isin(*PRESENT).alias("present"), "ordinal")
    reason = F.when(~F.col("present"), "no_gene").when((F.col("ref_id") == "") | (F.col("accession") == ""), "missing_id")
    first = F.row_number().over(Window.partitionBy("ref_id", "accession", F.col("reason").isNull()).orderBy("ordinal"))
    marked = able.withColumn("reason", reason).withColumn("reason", F.when(F.col("reason").isNull() & (first > 1), "duplicate").otherwise(F.col("reason")))
    seen = Observation()
    kinds = ("no_gene", "missing_id", "duplicate")
    chosen = workdir.stored(marked.observe(seen, *(F.count_if(F.col("reason") == k).alias(f"skipped_{k}") for k in kinds), F.count_if(F.col("reason").isNull()).alias("selected_accessions")).filter("reason is null").select("ref_id", "accession"), "selected")
    own = fasta.join(fasta.groupBy("ref_id").agg(F.min("path").alias("path")), ["ref_id", "path"], "left_semi")
    entries = workdir.stored(own.join(chosen, ["ref_id", "accession"], "left_semi").select("ref_id", "path", "ordinal", "header", "accession", "seq"), "staged")
    counts = entries.groupBy("ref_id").agg(F.count("*").alias("n"))
    seed = counts.select("ref_id", F.concat(F.lit("metadata_"), "ref_id").alias("ref_name"), F.col("n").alias("patients"), F.col("n").alias("count"))
    with_file = chosen.join(fasta.select("ref_id").distinct().withColumn("f", F.lit(True)), "ref_id", "left").join(entries.select("ref_id", "accession").distinct().withColumn("s", F.lit(True)), ["ref_id", "accession"], "left")
    lost = with_file.agg(F.count_if(F.col("f").isNull()).alias("missing_fasta"), F.count_if(F.col("f") & F.col("s").isNull()).alias("missing_sequence"), F.count_distinct("ref_id").alias("selected_studies"))
    total = counts.agg(F.count("*").alias("staged_studies"), F.coalesce(F.sum("n"), F.lit(0)).alias("staged_accessions"))
    told = {k: int(v) for k, v in seen.get.items()}
    spark = metadata.sparkSession
    row = {**told, **lost.first().asDict(), **total.first().asDict()}
    return Staged(entries, seed, spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row)))


def folder_assignments(records: DataFrame, gene_refs: DataFrame, subtype_refs: DataFrame, least: int = genes.MIN_OVERLAP_NT) -> DataFrame:
    """Every gene that a sequence holds, with its genotype and nearest subtype, from one search in all genes' references.

    ``records``: accession, seq; ``gene_refs``: gene, gt, seq, ordinal; ``subtype_refs``: subtype, accession, seq, ordinal.
    Per sequence and gene the hit of most bits, then of most columns, then of the first
    reference; then the same among the subtypes' references of that genotype, for every gene
    alike. Sequences without a gene have no row; a gene without a subtype hit has nulls there.
    """
    named = gene_refs.select(F.concat_ws("|", "gene", "gt", F.col("ordinal").cast("string")).alias("ref"), F.col("seq").alias("ref_seq"), F.struct("gene", "gt").alias("target"), "ordinal")
    asked = records.select(F.col("accession").alias("query"), "seq")
    found = search.as_targets(search.hits(asked, named, targets=1000), named, "target").filter(F.col("length") >= least)
    best = hits.best(found.select("query", "target.gene", "target.gt", "length", "pident", "bitscore", "ordinal"), ["query", "gene"], hits.by_bitscore()).drop("rank")
    best = workdir.stored(best, "genes_found")  # read again below, with the search behind it
    types = subtype_refs.select(F.concat_ws("|", "subtype", F.col("ordinal").cast("string")).alias("ref"), F.col("seq").alias("ref_seq"), F.struct("subtype", "accession").alias("target"), "ordinal", labels.genotype(F.col("subtype")).alias("gt"))
    # A sequence whose genes have several genotypes is asked once for each.
    wanted = best.select("query", "gt").distinct().join(asked, "query").withColumn("query", F.concat_ws("\t", "query", "gt"))
    near = search.as_targets(search.hits(wanted, types, on="gt", targets=1000), types, "target").filter(F.col("length") >= least)
    nearest = hits.best(near, ["query"], hits.by_bitscore()).select(F.substring_index("query", "\t", 1).alias("query"), F.substring_index("query", "\t", -1).alias("gt"), F.col("target.subtype").alias("subtype"), F.col("target.accession").alias("subtype_reference_accession"), F.col("length").alias("subtype_aligned_nt"), F.col("pident").alias("subtype_pident"))
    out = best.join(nearest, ["query", "gt"], "left")
    return out.select(F.col("query").alias("accession"), "gene", F.col("gt").alias("genotype"), F.col("length").alias("genotype_aligned_nt"), F.col("pident").alias("genotype_pident"), "subtype", "subtype_reference_accession", "subtype_aligned_nt", "subtype_pident")


class GenePlan:
    def __init__(self, gene: str, external: bool = False, options: Options | None = None):
        self.gene = genes.GENES[gene]
        self.external = external
        self.options = options or DEFAULTS[gene, external]

    # Selection

    def studies(self, sheet: DataFrame, patients: str = "patients", positive: list[str] = (), blocked: list[str] = ()) -> DataFrame:
        """Studies that are not excluded; the alignment way also needs a number of patients above 0."""
        kept = sheet.filter(selection.not_excluded(F.col(patients)) & selection.positive(list(positive)) & ~F.col("ref_id").isin(*blocked))
        return kept if self.external else kept.filter(selection.positive([patients]))

    def records(self, studies: DataFrame, fasta: DataFrame, metadata: DataFrame, rules: DataFrame | None = None, fields: list[str] = (), lists: DataFrame | None = None) -> DataFrame:
        """Sequences of the studies' files; a study with rules keeps the accessions whose metadata meet them."""
        own = fasta.join(studies.select("ref_id"), "ref_id", "left_semi")
        if rules is None:
            return own
        ruled = rules.select("ref_id").distinct()
        met = selection.apply_rules(metadata.join(ruled, "ref_id", "left_semi"), rules, list(fields), lists).select("ref_id", "accession").withColumn("__met", F.lit(True)).dropDuplicates(["ref_id", "accession"])
        marked = own.join(sized.small(ruled.withColumn("__ruled", F.lit(True))), "ref_id", "left").join(met, ["ref_id", "accession"], "left")
        return marked.filter(F.col("__ruled").isNull() | F.col("__met")).drop("__ruled", "__met")

    @staticmethod
    def labels(metadata: DataFrame) -> DataFrame:
        """accession, genotype, subtype, column_name that the metadata say."""
        found = metadata.withColumn("x", labels.first_genotype_subtype([c for c in LABEL_COLUMNS if c in metadata.columns]))
        return found.select("accession", "x.*").dropDuplicates(["accession"])

    # Search

    @staticmethod
    def genotype_hits(records: DataFrame, references: DataFrame) -> DataFrame:
        """Hits of the records (accession, seq) in the genotypes' references (gt, seq, ordinal), as ``genotypes`` takes them."""
        named = references.select(F.concat_ws("|", "gt", F.col("ordinal").cast("string")).alias("ref"), F.col("seq").alias("ref_seq"), "gt", "ordinal")
        found = search.hits(records.select(F.col("accession").alias("query"), "seq"), named)
        return search.as_targets(found, named, "gt")

    @staticmethod
    def subtype_hits(assigned: DataFrame, records: DataFrame, references: DataFrame) -> DataFrame:
        """Hits of assigned records in the references (subtype, seq, ordinal) of their own genotype, at most 100 a record."""
        named = references.select(F.concat_ws("|", "subtype", F.col("ordinal").cast("string")).alias("ref"), F.col("seq").alias("ref_seq"), "subtype", "ordinal", labels.genotype(F.col("subtype")).alias("gt"))
        asked = records.select(F.col("accession").alias("query"), "seq").join(assigned.select(F.col("accession").alias("query"), "gt"), "query")
        return search.as_targets(search.hits(asked, named, on="gt", targets=100), named, "subtype")

    @staticmethod
    def protein_windows(assigned: DataFrame, records: DataFrame, references: DataFrame) -> DataFrame:
        """The best translated hit of every assigned record in its genotype's protein (gt, seq): query, qstart, qend, sstart, send, frame, ..."""
        named = references.select(F.col("gt").alias("ref"), F.col("seq").alias("ref_seq"), "gt")
        asked = records.select(F.col("accession").alias("query"), "seq").join(assigned.select(F.col("accession").alias("query"), "gt"), "query")
        found = search.hits(asked, named, search.TRANSLATED, on="gt", targets=1).withColumn("ordinal", F.lit(0))
        return hits.best_protein(found, "query", genes.MIN_OVERLAP_AA)

    # Assignment

    def genotypes(self, records: DataFrame, gt_hits: DataFrame, said: DataFrame) -> DataFrame:
        """ref_id, accession, gt, source, covered: the metadata's genotype, else that of the nearest reference."""
        best = hits.best_target(hits.with_distance(gt_hits), "query", "target", genes.MIN_OVERLAP_NT)
        covered = hits.covered_positions(F.col("sstart"), F.col("send"), self.gene.positions)
        by_hit = best.select(F.col("query").alias("accession"), F.col("target").cast("string").alias("hit_gt"), "distance", covered.alias("covered"))
        rows = records.select("ref_id", "accession").join(by_hit, "accession", "left")
        return selection.assigned(rows, said.select("accession", F.col("genotype").alias("gt")), "accession", "gt", "hit_gt").filter("gt <> ''")

    def subtypes(self, assigned: DataFrame, sub_hits: DataFrame, said: DataFrame) -> DataFrame:
        """Adds subtype, next_subtype and their distances; hits are those with references of the sequence's genotype."""
        own = sub_hits.join(assigned.select(F.col("accession").alias("query"), F.col("gt").alias("__gt")), "query").filter(labels.genotype(F.col("target")) == F.col("__gt")).filter(F.col("length") >= self.options.subtype_min_nt).drop("__gt")
        two = hits.best_two_targets(hits.with_distance(own), "query", "target")
        rows = assigned.join(two.select(F.col("query").alias("accession"), F.col("best").alias("hit_subtype"), "best_distance", F.col("second").alias("next_subtype"), F.col("second_distance").alias("next_distance")), "accession", "left")
        return selection.assigned(rows.withColumnRenamed("source", "gt_source"), said.select("accession", "subtype"), "accession", "subtype", "hit_subtype")

    def called(self, records: DataFrame, calls: DataFrame, priority: DataFrame | None = None) -> DataFrame:
        """External calls by accession or its versionless form; unassigned ones go, priority subtypes win and are added."""
        rows = selection.with_fallback(records.select("ref_id", "accession"), calls, "subtype")
        if priority is not None:
            won = selection.overridden(rows.select("accession", "subtype").dropDuplicates(["accession"]), priority.join(rows.select("accession"), "accession", "left_semi"), "accession", "subtype")
            rows = rows.drop("subtype").join(won, "accession")
        kept = rows.filter(F.col("subtype").isNotNull() & ~F.lower("subtype").startswith("unassign"))
        return kept.withColumn("gt", labels.genotype(F.col("subtype")))

    # Proteins

    def proteins(self, assigned: DataFrame, records: DataFrame, windows: DataFrame, references: DataFrame) -> DataFrame:
        """Adds seq, start, end: the aligned window (query, qstart, qend, sstart) is translated in its reference's frame and anchored on the genotype's protein."""
        cut = F.substring(F.col("nt"), F.col("qstart").cast("int"), (F.col("qend") - F.col("qstart") + 1).cast("int"))
        own = windows.join(records.select(F.col("accession").alias("query"), F.col("seq").alias("nt")), "query").select(F.col("query").alias("accession"), sequences.aa_window(cut, F.col("sstart").cast("int")).alias("aa"))
        rows = assigned.join(own, "accession", "left").join(sized.small(references.select("gt", F.col("seq").alias("ref"))), "gt", "left").repartition("accession")
        aligned = rows.withColumn("al", alignment.aligner()(F.coalesce("aa", F.lit("")), F.coalesce("ref", F.lit(""))))
        return self._anchored(aligned, F.col("al.query"), F.col("al.ref"), F.col("al.ref_start")).drop("al", "aa", "ref")

    def extracted_proteins(self, assigned: DataFrame, records: DataFrame, references: DataFrame, refine: bool = False) -> DataFrame:
        """As ``proteins`` without hits: the gene's best reading in the whole sequence. ``references``: gt, seq (bases) [, begin, end: known residues]."""
        known = [c for c in ("begin", "end") if c in references.columns]
        refs = references.select("gt", F.col("seq").alias("ref_nt"), *(F.col(c).alias(f"known_{c}") for c in known))
        rows = extraction.spread(assigned.join(records.select("accession", F.col("seq").alias("nt")), "accession", "left").join(sized.small(refs), "gt", "left"), "accession")
        ends = {c: F.col(f"known_{c}") for c in known}
        found = rows.withColumn("gene", extraction.extracted(F.col("nt"), F.col("ref_nt"), refine=refine, **ends)).withColumn("ref", sequences.translate(F.col("ref_nt")))
        return self._anchored(found, F.col("gene.aligned_query"), F.col("gene.aligned_ref"), F.lit(1)).drop("gene", "nt", "ref", "ref_nt", *(f"known_{c}" for c in known))

    def _anchored(self, aligned: DataFrame, query: Column, ref: Column, ref_start: Column) -> DataFrame:
        """Adds seq, start, end and quality of an aligned protein; the genotype's protein is in ``ref``."""
        out = aligned.withColumn("x", alignment.anchored(query, ref, ref_start))
        has = F.length("x.aa") >= genes.MIN_OVERLAP_AA
        out = out.withColumns({"seq": F.when(has, F.col("x.aa")), "start": F.when(has, F.col("x.start")), "end": F.when(has, F.col("x.end"))}).drop("x")
        out = out.withColumn("quality", alignment.quality(F.col("seq"), F.col("start"), F.col("end"), F.col("ref"), self.gene))
        return out if self.options.keep_blank else out.filter("seq is not null")

    def profile_rows(self, proteins: DataFrame) -> DataFrame:
        """Sequences that go into profiles."""
        rows = proteins.filter("seq is not null and seq <> '' and start is not null")
        if self.options.quality_gate:
            rows = rows.filter("quality.status = 'PASS'")
        if self.options.all_positions:
            callable_ = [sequences.residue_at(F.col("seq"), F.col("start"), F.lit(p)).isin(*genes.VALID_AA) for p in self.gene.positions]
            rows = rows.filter(F.forall(F.array(*(F.coalesce(x, F.lit(False)) for x in callable_)), lambda x: x))
        return rows

    # Reports

    def floor(self) -> Column | None:
        return F.col("gt").isin(*self.options.exempt) if self.options.exempt else None

    def reports(self, rows: DataFrame, by: list[str] = ("gt",)) -> dict[str, DataFrame]:
        """profile, grid, consensus, entropy, distance and mutations of one grouping; all share one count table."""
        by = list(by)
        counts = profiles.position_counts(rows, by)
        prof = profiles.profile(counts)
        at = F.col("pos").isin(*self.gene.positions)
        group = F.concat_ws("_", *by)
        low, high = self.gene.window
        calls = counts.filter(F.col("pos").between(low, high) & ~F.col("aa").isin(*genes.MISSING_AA)).withColumn("g", group).select("g", "pos", F.col("aa").alias("call"), "n")
        enough = profiles.sufficient(counts.filter(at), by, exempt=self.floor())
        return {
            "profile": prof, "grid": profiles.ras_grid(prof, counts, by, self.gene.positions, self.options.least_percent), "consensus": profiles.consensus(prof, by, self.gene.reference_length),
            "entropy": profiles.entropy(counts.filter(at), by), "distance": distance.pair_distance(calls, "g"), "mutations": profiles.frequent_mutations(prof.filter(at), by), "sufficient": enough,
        }
