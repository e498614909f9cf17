"""Queries of the search operators: cohorts of gene-long sequences, made of the tables at hand.

The first ``CODONS`` parts give a gene's codons. A genotype changes some of them, a subtype
a few more. Every customer is a sequence: a stretch of the reference of its own
genotype and subtype, with changes of its own, on either strand. All of it is joins and
aggregations over ``part`` and ``customer``, so work grows with the customers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe import genes, workdir
from cladeframe.operators import alignment, hits, msa, search, sized
from cladeframe.plans import cohort as c
from cladeframe.plans import gene as g
from cladeframe.plans.queries import query
from cladeframe.sources import files, genbank

CODONS = 150
SENSE = [codon for codon, aa in sorted(genes.CODONS.items()) if aa != "*"]


def _codon(*seed: Column | str) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in SENSE)), (F.pmod(F.xxhash64(*seed), F.lit(len(SENSE))) + 1).cast("int"))


def _one_in(n: int, *seed: Column | str) -> Column:
    return F.pmod(F.xxhash64(*seed, F.lit(n)), F.lit(n)) == 0


def references(spark: SparkSession, d: str) -> DataFrame:
    """gt, subtype, pos, gt_codon, codon: 8 genotypes of two subtypes, a row a codon."""
    base = c.table(spark, d, "part").filter(F.col("p_partkey") <= CODONS).select(F.col("p_partkey").alias("pos"), "p_name")
    kinds = base.withColumn("gt", F.explode(F.array(*(F.lit(str(k)) for k in range(1, 9))))).withColumn("s", F.explode(F.array(F.lit("a"), F.lit("b"))))
    of_gt = F.when(_one_in(4, "pos", "gt"), _codon("p_name", "gt")).otherwise(_codon("p_name"))
    rows = kinds.withColumn("gt_codon", of_gt).withColumn("subtype", F.concat("gt", "s"))
    return rows.select("gt", "subtype", "pos", "gt_codon", F.when(_one_in(12, "pos", "subtype"), _codon("p_name", "subtype")).otherwise(F.col("gt_codon")).alias("codon"))


def _joined(rows: DataFrame, by: list[str], codon: str, name: str = "seq") -> DataFrame:
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", codon))), lambda x: x[codon]), "").alias(name))


def genotype_references(spark: SparkSession, d: str) -> DataFrame:
    return _joined(references(spark, d).filter(F.col("subtype").endswith("a")), ["gt"], "gt_codon").withColumn("ordinal", F.col("gt").cast("int"))


def subtype_references(spark: SparkSession, d: str) -> DataFrame:
    rows = _joined(references(spark, d), ["subtype"], "codon")
    return rows.withColumn("ordinal", (F.col("subtype").substr(1, 1).cast("int") * 2 + F.col("subtype").endswith("b").cast("int")).cast("int")).withColumn("accession", F.concat(F.lit("AC"), "subtype"))


def codons(spark: SparkSession, d: str) -> DataFrame:
    """accession, ref_id, truth (subtype), pos, codon: a row a codon of every customer's sequence."""
    own = c.table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("accession"), F.col("c_nationkey").cast("string").alias("ref_id"), F.concat((F.pmod(F.xxhash64("c_custkey"), F.lit(8)) + 1).cast("string"), F.when(F.col("c_acctbal") > 4500, "a").otherwise("b")).alias("truth"), (F.pmod("c_custkey", F.lit(40)) + 1).alias("first"))
    # A sequence's codons are made, looked up and put together where its row was dealt to: the file's few bytes are no measure of that work.
    own = own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "accession")
    at = own.select("accession", "ref_id", "truth", F.explode(F.sequence(F.col("first"), F.col("first") + 100)).alias("pos"))
    refs = references(spark, d).select(F.col("subtype").alias("truth"), F.col("pos").cast("long").alias("pos"), "codon")
    rows = at.withColumn("pos", F.col("pos").cast("long")).join(sized.small(refs), ["truth", "pos"])
    return rows.withColumn("codon", F.when(_one_in(25, "accession", "pos"), _codon("accession", "pos")).otherwise(F.col("codon")))


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """accession, ref_id, truth, seq: a row a customer."""
    seqs = _joined(codons(spark, d), ["accession", "ref_id", "truth"], "codon")
    back = F.reverse(F.translate("seq", "ACGT", "TGCA"))
    return seqs.withColumn("seq", F.when(_one_in(5, "accession"), back).otherwise(F.col("seq")))


def _assigned(spark: SparkSession, d: str, again: bool = True) -> tuple[g.GenePlan, DataFrame, DataFrame]:
    """``again``: the genotypes are read more than once, so the search behind them is written down."""
    plan, records = g.GenePlan("NS5A"), workdir.stored(sequences(spark, d), "sequences")
    said = spark.createDataFrame([], "accession string, genotype string, subtype string")
    assigned = plan.genotypes(records, plan.genotype_hits(records, genotype_references(spark, d)), said)
    return plan, records, workdir.stored(assigned, "assigned") if again else assigned


@query()
def al_blastn_search(spark, d):
    """The genotype of every sequence, by its own search."""
    return _assigned(spark, d, False)[2].select("accession", "gt", "distance", "covered")


@query()
def al_blastn_subtype(spark, d):
    plan, records, assigned = _assigned(spark, d)
    said = spark.createDataFrame([], "accession string, genotype string, subtype string")
    return plan.subtypes(assigned, plan.subtype_hits(assigned, records, subtype_references(spark, d)), said).select("accession", "gt", "subtype", "next_subtype", "best_distance", "next_distance")


@query()
def al_blastn_folder(spark, d):
    gene_refs = genotype_references(spark, d).withColumn("gene", F.lit("NS5A"))
    # A second gene: the same codons read backwards.
    other = gene_refs.withColumn("seq", F.reverse("seq")).withColumn("gene", F.lit("NS5B")).withColumn("ordinal", F.col("ordinal") + 10)
    return g.folder_assignments(workdir.stored(sequences(spark, d), "sequences"), gene_refs.unionByName(other), subtype_references(spark, d))


@query()
def al_blastx_aa(spark, d):
    plan, records, assigned = _assigned(spark, d)
    residues = F.array_join(F.transform(F.sequence(F.lit(0), (F.length("seq") / 3).cast("int") - 1), lambda k: F.element_at(F.create_map(*(F.lit(x) for pair in sorted(genes.CODONS.items()) for x in pair)), F.substring("seq", k * 3 + 1, F.lit(3)))), "")
    proteins = genotype_references(spark, d).select("gt", residues.alias("seq"))
    return plan.protein_windows(assigned, records, proteins).select("query", F.col("ref").alias("gt"), "frame", "qstart", "qend", "sstart", "send", "length", "mismatch", "gaps", "bitscore")


@query()
def jn_cross_refs(spark, d):
    """The best of all references, without a key."""
    rows = sequences(spark, d).select("accession", "seq")
    refs = subtype_references(spark, d).select(F.col("ordinal").alias("ref_ordinal"), F.col("subtype").alias("ref_name"), F.col("seq").alias("ref_seq"))
    return alignment.best_reference(rows, refs, [], "accession", traced=False).select("accession", "ref_name", "score", "aligned")


@query()
def al_msa(spark, d):
    """The subtypes' consensus sequences in one alignment: the most frequent codon at each place, some places left out by subtype."""
    counts = codons(spark, d).groupBy("truth", "pos", "codon").agg(F.count("*").alias("n"))
    most = counts.groupBy("truth", "pos").agg(F.max_by("codon", F.struct("n", "codon")).alias("codon"))
    consensus = _joined(most.filter(~_one_in(9, "truth", "pos")), ["truth"], "codon")
    return msa.progressive(consensus.withColumnRenamed("truth", "name"), msa.BASES)


# Records by byte ranges, bundles


def _genbank(spark: SparkSession, d: str) -> str:
    """Every customer as a GenBank record; a third of the files' lines end as on another system."""
    path = workdir.new_path(spark, "genbank")
    key, end = F.col("c_custkey").cast("string"), F.when(F.pmod("c_custkey", F.lit(3)) == 0, "\r\n").otherwise("\n")
    bases = F.when(F.pmod("c_custkey", F.lit(2)) == 0, "acgt").otherwise("ggttaa")
    text = F.concat(F.lit("LOCUS       C"), key, end, F.lit("ACCESSION   C"), key, end, F.lit("ORIGIN"), end, F.lit("        1 "), bases, end, F.lit("//"), F.when(F.pmod("c_custkey", F.lit(3)) == 0, "\r").otherwise(""))
    c.table(spark, d, "customer").select(text.alias("value")).write.text(path)
    return path


@query("SELECT 'C' || c_custkey AS accession, CAST(2 * length('C' || c_custkey) + CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 6 END + CASE WHEN c_custkey % 3 = 0 THEN 52 ELSE 47 END AS BIGINT) AS n_bytes FROM customer")
def src_genbank_offsets(spark, d):
    """Every record's bytes, by its offsets."""
    rows = genbank.as_text(genbank.read_records(spark, _genbank(spark, d)))
    return rows.select(F.element_at(files.raw_accessions(F.col("record")), 1).alias("accession"), (F.col("end_byte") - F.col("start_byte")).alias("n_bytes"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS study, 'C' || c_custkey AS accession, CASE WHEN c_custkey % 2 = 0 THEN 'ACGT' ELSE 'GGTTAA' END AS sequence FROM customer WHERE c_acctbal > 0")
def rp_genbank_bundles(spark, d):
    """Bundles by nation, written and cut out again by their index."""
    wanted = c.table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").cast("string").alias("study"), F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit(".1")).alias("accession"))
    path = workdir.new_path(spark, "bundles")
    genbank.write_bundles(genbank.read_records(spark, _genbank(spark, d)), wanted, path)
    rows = files.parsed_genbank(genbank.read_bundles(spark, path).withColumn("record", F.regexp_replace(F.regexp_replace("record", "\r", ""), "\n//\n?$", "\n")).withColumn("asked", F.col("accession")))
    return rows.select("study", F.substring_index("asked", ".", 1).alias("accession"), "sequence")


@query("SELECT 'C' || c_custkey AS accession FROM customer WHERE c_acctbal > 5000")
def jn_gb_semi(spark, d):
    """Records of the wanted accessions; of repeated records the last."""
    wanted = c.table(spark, d, "customer").filter("c_acctbal > 5000").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("accession"))
    records = genbank.read_records(spark, _genbank(spark, d))
    twice = records.unionByName(records.withColumn("path", F.concat("path", F.lit("~"))))
    return genbank.matching(twice, wanted).filter(F.col("path").endswith("~")).select(F.col("asked").alias("accession"))


@query("""SELECT count(*) FILTER (WHERE NOT present) AS skipped_no_gene, count(*) FILTER (WHERE present AND study = '') AS skipped_missing_id,
  count(*) FILTER (WHERE present AND study <> '' AND nth > 1) AS skipped_duplicate, count(*) FILTER (WHERE present AND study <> '' AND nth = 1) AS selected_accessions,
  count(*) FILTER (WHERE present AND study <> '' AND nth = 1 AND c_custkey IS NULL) AS missing_fasta
FROM (SELECT *, o_totalprice > 1000 AS present, CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS study,
  row_number() OVER (PARTITION BY CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_custkey AS VARCHAR) END, o_orderpriority, o_totalprice > 1000 ORDER BY o_orderkey) AS nth FROM orders)
LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON study = CAST(c_custkey AS VARCHAR)""")
def rp_stage_metadata(spark, d):
    """Counters of a staging: orders as metadata rows, customers with a balance as files."""
    orders = c.table(spark, d, "orders")
    metadata = orders.select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string")).alias("ref_id"), F.col("o_orderpriority").alias("accession"), F.when(F.col("o_totalprice") > 1000, "yes").alias("NS3"), F.col("o_orderkey").alias("ordinal"))
    fasta = c.table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("ref_id"), F.concat("c_name", F.lit(".fa")).alias("path"), F.lit(0).alias("ordinal"), F.lit("h").alias("header"), F.lit("1-URGENT").alias("accession"), F.lit("ACGT").alias("seq"))
    return g.staged(metadata, fasta, "NS3").counters.select("skipped_no_gene", "skipped_missing_id", "skipped_duplicate", "selected_accessions", "missing_fasta")
