"""Queries of record readers, look-up chains, rule tables, labels and aligned reference distances; registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe import genes, workdir
from cladeframe.functions import labels, sequences
from cladeframe.operators import alignment, distance, grouping, hits, reports, selection
from cladeframe.plans import cohort as c
from cladeframe.plans import rules
from cladeframe.plans.gene import GenePlan, Options
from cladeframe.plans.queries import _RULES, query
from cladeframe.sources import files

AA = genes.VALID_AA
_key = lambda: F.col("c_custkey")
_text = lambda name: F.col(name).cast("string")
_every = lambda n: F.pmod(_key(), F.lit(n)) == 0
_letter = lambda c: F.substring(F.lit(AA), (F.pmod(c, F.lit(len(AA))) + 1).cast("int"), F.lit(1))


def _letter_sql(c: str) -> str:
    return f"substr('{AA}', CAST(({c}) % {len(AA)} + 1 AS INTEGER), 1)"


# Distances to aligned references

#: A customer's reference has 40 residues. Up to two residues of its consensus differ and one place may have none: three
#: unequal columns cost 9, any gap at least 12, so the best alignment has no gaps, which SQL can say.
_LENGTH, _WANTED = 40, (3, 5, 12, 20, 39)


@query(
    f"""WITH cells AS (SELECT c_custkey, p, (c_custkey * 7 + p * p * 3 + p) AS k,
 (p = 5 AND c_custkey % 2 = 0) OR (p = 12 AND c_custkey % 3 = 0) AS changed, p = 20 AND c_custkey % 7 = 0 AS lost FROM customer, (SELECT unnest({list(_WANTED)}) AS p) WHERE c_custkey % 11 <> 0)
SELECT 's' || c_custkey AS subtype, 'R' || c_custkey AS reference, CAST(count(*) FILTER (NOT lost) AS INTEGER) AS compared, CAST(count(*) FILTER (changed) AS INTEGER) AS differences,
 coalesce(string_agg(CASE WHEN changed THEN p || ':' || {_letter_sql('k')} || '>' || {_letter_sql('k + 1')} END, ';' ORDER BY p), '') AS changes, round(count(*) FILTER (changed) / count(*) FILTER (NOT lost)::DOUBLE, 9) AS distance, 'ok' AS status FROM cells GROUP BY c_custkey
UNION ALL SELECT 's' || c_custkey, NULL, NULL, NULL, NULL, NULL, 'reference_not_found' FROM customer WHERE c_custkey % 11 = 0"""
)
def al_ref_distance(spark, d):
    """Every customer as a subtype's consensus, aligned to its reference; one in eleven has none."""
    own = c.table(spark, d, "customer").select("c_custkey")
    cells = own.withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(_LENGTH)))).withColumn("k", _key() * 7 + F.col("pos") * F.col("pos") * 3 + F.col("pos"))
    name = lambda letter: F.concat(F.lit(letter), _text("c_custkey"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", _letter(F.col("k")).alias("aa")))), lambda x: x["aa"]), "")
    refs = cells.filter(~_every(11)).groupBy("c_custkey").agg(ordered.alias("seq")).select(name("s").alias("subtype"), name("R").alias("accession"), "seq", F.lit(1).alias("ordinal"))
    changed = ((F.col("pos") == 5) & _every(2)) | ((F.col("pos") == 12) & _every(3))
    consensus = cells.filter(~((F.col("pos") == 20) & _every(7))).select(name("s").alias("subtype"), "pos", _letter(F.when(changed, F.col("k") + 1).otherwise(F.col("k"))).alias("aa"))
    return distance.aligned_reference_distance(consensus, refs, list(_WANTED), distance.reference_scores("NS3")).withColumn("distance", F.round("distance", 9))


# Look-up chains


@query(
    """WITH refs AS (SELECT 'A' || o_custkey AS accession, o_orderkey AS k, o_custkey AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'P' || o_orderkey END AS own,
 CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 THEN 'S' || o_orderkey END AS hit, o_orderkey % 7 = 0 AS broken,
 CASE WHEN o_orderkey % 2 = 0 THEN '10.1/' || o_orderkey END AS doi, CASE WHEN o_orderkey % 4 = 1 THEN 'W' || o_orderkey END AS web, CASE WHEN o_orderkey % 4 IN (1, 2, 3) THEN '10.2/' || o_orderkey END AS web_doi FROM orders),
two AS (SELECT *, CASE WHEN own IS NOT NULL THEN own WHEN NOT broken THEN hit END AS found FROM refs), three AS (SELECT *, bool_or(found IS NULL) OVER (PARTITION BY a) AS still FROM two)
SELECT accession, CAST(k AS VARCHAR) AS reference, coalesce(found, CASE WHEN still THEN web END) AS pubmed,
 CASE WHEN own IS NOT NULL THEN 'genbank' WHEN found IS NOT NULL THEN 'pubmed_esearch' WHEN web IS NOT NULL THEN 'openai_web_search' END AS pmid_source, doi AS crossref_doi, CASE WHEN still AND doi IS NULL THEN web_doi END AS web_doi,
 CASE WHEN own IS NOT NULL THEN 'kept_existing_pubmed' ELSE 'missing_pubmed' END AS kept, CASE WHEN own IS NOT NULL THEN NULL WHEN broken AND k % 5 = 0 THEN 'error' WHEN hit IS NOT NULL THEN 'matched' ELSE 'no_match' END AS search,
 CASE WHEN doi IS NULL THEN 'no_match' ELSE 'matched' END AS doi_search, CASE WHEN still THEN 'completed' ELSE 'skipped' END AS web_search FROM three"""
)
def fn_reference_chain(spark, d):
    """Orders as the references of a customer's record; a third have an id, searches find some of the rest."""
    orders = c.table(spark, d, "orders")
    k = F.col("o_orderkey")
    key = [F.concat(F.lit("A"), _text("o_custkey")).alias("accession"), _text("o_orderkey").alias("reference")]
    when = lambda test, letter: F.when(test, F.concat(F.lit(letter), _text("o_orderkey")))
    refs = orders.select(*key, F.coalesce(when(k % 3 == 0, "P"), F.lit(" ")).alias("pubmed"))
    searched = orders.filter(k % 5 == 0).select(*key, when(F.lit(True), "S").alias("pmid"), F.when(k % 7 == 0, "timeout").alias("error"), k.alias("ordinal"))
    crossref = orders.filter(k % 2 == 0).select(*key, when(F.lit(True), "10.1/").alias("doi"), F.lit("").alias("error"), k.alias("ordinal"))
    early = orders.select(*key, F.lit("early").alias("pmid"), F.lit("early").alias("doi"), F.lit(0).alias("ordinal"))  # of several the last counts
    web = early.unionByName(orders.select(*key, when(k % 4 == 1, "W").alias("pmid"), when(k % 4 > 0, "10.2/").alias("doi"), F.lit(1).alias("ordinal")))
    return reports.reference_steps(refs, searched, crossref, web)


# Labels, boundaries, signatures


@query("SELECT c_custkey, 'GT' || c_nationkey AS genotype, c_mktsegment || '_x' AS name FROM customer WHERE c_custkey % 4 <> 0")
def grp_by_genotype(spark, d):
    rows = c.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("GT"), _text("c_nationkey"), F.when(_every(4), "").otherwise(F.concat(F.lit("_"), "c_mktsegment", F.lit("_x")))).alias("label"))
    return grouping.by_genotype(rows).select("c_custkey", "genotype", "name")


@query("SELECT 'NS3' AS gene, subtype || '_' || accession AS subtype, left(seq, 3) AS begin, right(seq, 3) AS end FROM cohort WHERE subtype <> '5'", c.COHORT_SQL)
def rp_boundaries(spark, d):
    rows = c.cohort(spark, d).select(F.concat_ws("_", "gt", "subtype", "accession").alias("header"), F.when(F.col("subtype") == "5", "").otherwise(F.col("seq")).alias("seq"))
    return reports.boundaries(rows, "NS3")


_SIGNED = ", ".join(f"('{gt}', '{gene}', '{begin}', '{end}')" for gt, gene, begin, end in rules.SIGNATURES)


@query(
    f""", signed AS (SELECT * FROM (VALUES {_SIGNED}) AS t(g, gene, b, e))
SELECT accession, gene, m AS matches, CAST(2 - m AS INTEGER) AS mismatches FROM (SELECT accession, gene, CAST((left(s, 3) = b)::INTEGER + (right(s, 3) = e)::INTEGER AS INTEGER) AS m
 FROM (SELECT *, CASE start WHEN 1 THEN 'API' || seq || 'VVT' WHEN 2 THEN 'SMS' || seq || 'PAR' ELSE seq END AS s FROM cohort) JOIN signed ON g = subtype)""",
    c.COHORT_SQL,
)
def fn_signature(spark, d):
    """Ends of every sequence against those of its genotype, gene by gene."""
    seq = F.when(F.col("start") == 1, F.concat(F.lit("API"), "seq", F.lit("VVT"))).when(F.col("start") == 2, F.concat(F.lit("SMS"), "seq", F.lit("PAR"))).otherwise(F.col("seq"))
    rows = c.cohort(spark, d).select("accession", F.col("subtype").alias("gt"), seq.alias("s"))
    return rows.join(F.broadcast(rules.signatures(spark)), "gt").select("accession", "gene", rules.signature_matches(F.col("s"), F.col("begin"), F.col("end")).alias("x")).select("accession", "gene", "x.*")


# Texts of records


@query("SELECT c_custkey, 'Method :: ' || c_mktsegment || chr(10) || 'Nation :: ' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || chr(10) || 'Code :: x' || c_custkey ELSE '' END AS comment FROM customer")
def fn_structured_comment(spark, d):
    body = F.concat(F.lit("            Method :: "), "c_mktsegment", F.lit("\n            Nation :: "), _text("c_nationkey"))
    more = F.when(_every(3), F.concat(F.lit("\n            ##More-START##\n            Code :: x"), _text("c_custkey"), F.lit("\n            ##More-END##"))).otherwise("")
    record = F.concat(F.lit("LOCUS       L\nCOMMENT     words\n            ##Data-START##\n"), body, F.lit("\n            ##Data-END##"), more, F.lit("\nFEATURES"))
    return c.table(spark, d, "customer").select("c_custkey", labels.structured_comment(record).alias("comment"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'A' || c_custkey || ',B' || c_nationkey ELSE 'A' || c_custkey END || ',A' || c_custkey || '.2' AS names FROM customer")
def fn_raw_accessions(spark, d):
    own = F.concat(F.lit("A"), _text("c_custkey"))
    record = F.concat(F.lit("LOCUS       x\nACCESSION   "), own, F.when(_every(3), F.concat(F.lit("  B"), _text("c_nationkey"))).otherwise(""), F.lit("\nVERSION     "), own, F.lit(".2\n"))
    return c.table(spark, d, "customer").select("c_custkey", F.array_join(files.raw_accessions(record), ",").alias("names"))


@query(r"""SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL)""")
def fn_sentences(spark, d):
    rows = c.table(spark, d, "documents").filter("text is not null").select("doc_id", labels.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'A' || c_custkey || ' K' || c_nationkey || '.5' ELSE '*' || c_custkey END AS variants FROM customer")
def fn_rich_parse(spark, d):
    cell = F.when(_every(5), F.concat(F.lit("A"), _text("c_custkey"), F.lit(", K"), _text("c_nationkey"), F.lit(".5 (x)"))).otherwise(F.concat(F.lit("- *"), _text("c_custkey"), F.lit(" ")))
    return c.table(spark, d, "customer").select("c_custkey", F.array_join(labels.cell_variants(cell), " ").alias("variants"))


@query("SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 4 = 0 OR (c_custkey % 5 <> 0 AND c_nationkey % 2 = 0) AS clone FROM customer")
def fn_likely_clone(spark, d):
    note = F.when(_every(3), F.concat(F.lit("a Clone of "), "c_name")).otherwise(F.lit("cloned"))
    kind = F.when(_every(4), "qs 4").otherwise("")
    person = F.when(_every(5), " ").otherwise(F.when(F.pmod("c_nationkey", F.lit(2)) == 0, F.lit("p")).otherwise("i"))
    return c.table(spark, d, "customer").select("c_custkey", labels.likely_clone([note, kind], F.lit("i"), person).alias("clone"))


@query("SELECT c_custkey, repeat('-', CAST(c_custkey % 3 AS INTEGER)) || left(c_mktsegment, 3) || '-' || substr(c_mktsegment, 4, 2) || repeat('-', 10 - 6 - CAST(c_custkey % 3 AS INTEGER)) AS placed FROM customer")
def al_project(spark, d):
    """Insertions fall away, deletions and what lies outside are gaps."""
    part = F.col("c_mktsegment")
    query_ = F.concat(F.substring(part, 1, 2), F.lit("xy"), F.substring(part, 3, 1), F.lit("-"), F.substring(part, 4, 2))
    placed = alignment.projected(query_, F.lit("AC--DEFG"), (F.pmod(_key(), F.lit(3)) + 1).cast("int"), F.lit(10))
    return c.table(spark, d, "customer").select("c_custkey", placed.alias("placed"))


@query("SELECT o_orderkey, string_agg(CASE WHEN l_linenumber IS NULL THEN 'XX' WHEN l_linenumber % 2 = 0 THEN 'AX' ELSE 'KR' END, '' ORDER BY k) AS sequence FROM (SELECT o_orderkey, unnest(range(1, 9)) AS k FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey AND l_linenumber = k GROUP BY o_orderkey")
def al_reconstruct(spark, d):
    """Every line of an order as a hit of two residues; even ones have a deletion, all have an insertion of the subject."""
    line = F.col("l_linenumber").cast("int")
    chains = c.table(spark, d, "lineitem").select("l_orderkey", line.alias("l")).distinct().select(
        F.col("l_orderkey").alias("o_orderkey"), F.lit(16).alias("qlen"), (2 * F.col("l") - 1).alias("qstart"), F.lit("M-M").alias("qseq"), F.when(F.col("l") % 2 == 0, "AW-").otherwise("KWR").alias("sseq")
    )
    return alignment.painted(chains, ["o_orderkey"])


# Rules as a table, quality, calls


_CASES = """CASE ref_id WHEN '1' THEN contains(lower(source_isolate), 'week 1') WHEN '2' THEN NOT contains(lower(source_isolate), 'error') WHEN '3' THEN lower(trim(source_isolate)) = 'click-3 week 3'
 WHEN '4' THEN CAST(regexp_extract(source_date, '\\b((?:19|20)\\d{2})\\b', 1) AS INTEGER) < 2025 WHEN '5' THEN event_type = 'view' WHEN '6' THEN regexp_matches(source_isolate, '(?i)\\bweek [1-4]\\b') AND contains(source_isolate, '-') ELSE true END"""


@query(f"SELECT accession FROM features WHERE {_CASES}", c.FEATURES_SQL)
def flt_rules_table(spark, d):
    """The rules written as a table, read again and applied."""
    path = workdir.new_path(spark, "rules")
    told = spark.createDataFrame([*_RULES, ("", "source_isolate", "equals", "nothing")], "RefID string, Field string, Operator string, Value string")
    files.write_table(told, path)
    rows = c.features(spark, d)
    lists = rows.filter("event_type = 'view'").select(F.lit("view").alias("list"), "accession")
    return selection.apply_rules(rows, rules.read_rules(spark, path), ["source_isolate", "source_date", "accession"], lists).select("accession")


@query("SELECT DISTINCT ref_id, CASE ref_id WHEN '1' THEN 'source_isolate contains Week 1' WHEN '6' THEN 'source_isolate contains -; source_isolate matches_regex Week [1-4]' WHEN '2' THEN 'source_isolate not_contains ERROR' WHEN '3' THEN 'source_isolate equals click-3 week 3' WHEN '4' THEN 'source_date year_before 2025' WHEN '5' THEN 'accession in_accession_list view' ELSE '' END AS filter_text, CASE WHEN ref_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0) THEN 'Present' ELSE 'Absent' END AS included FROM features", c.FEATURES_SQL)
def rp_filter_summary(spark, d):
    present = c.table(spark, d, "customer").filter("c_acctbal > 0").select(_text("c_custkey").alias("ref_id"))
    told = spark.createDataFrame(_RULES, "ref_id string, field string, op string, value string")
    return rules.summary(c.features(spark, d).select("ref_id").distinct(), told, present)


@query("SELECT accession, gt FROM cohort WHERE start = 1", c.COHORT_SQL)
def flt_qc_pass(spark, d):
    """Only sequences of passing quality go into profiles where the plan says so."""
    plan = GenePlan("NS5A", options=Options(quality_gate=True))
    rows = c.cohort(spark, d).withColumn("quality", F.struct(F.when(F.col("start") == 1, "PASS").when(F.col("start") == 2, "FLAGGED").otherwise("HIGH_DIVERGENCE").alias("status")))
    return plan.profile_rows(rows).select("accession", "gt")


@query(
    """WITH calls AS (SELECT 'C' || o_custkey AS a, max_by(CASE left(o_orderpriority, 1) WHEN '5' THEN 'Unassigned' ELSE left(o_orderpriority, 1) || 'a' END, -o_orderkey) AS s FROM orders GROUP BY 1)
SELECT CAST(c_nationkey AS VARCHAR) AS ref_id, 'C' || c_custkey || '.1' AS accession, CASE WHEN c_custkey % 9 = 0 THEN '1d' ELSE s END AS subtype, left(CASE WHEN c_custkey % 9 = 0 THEN '1d' ELSE s END, 1) AS gt
FROM customer LEFT JOIN calls ON a = 'C' || c_custkey WHERE c_custkey % 9 = 0 OR (s IS NOT NULL AND s <> 'Unassigned')"""
)
def rp_comet_gt(spark, d):
    """Customers as sequences, the first of their orders as an external call that lacks the version; one in nine has a priority subtype."""
    name = F.concat(F.lit("C"), _text("c_custkey"), F.lit(".1")).alias("accession")
    customers = c.table(spark, d, "customer")
    first = F.substring("o_orderpriority", 1, 1)
    calls = c.table(spark, d, "orders").select(F.concat(F.lit("C"), _text("o_custkey")).alias("accession"), F.when(first == "5", "Unassigned").otherwise(F.concat(first, F.lit("a"))).alias("subtype"), F.col("o_orderkey").alias("ordinal"))
    priority = customers.filter(_every(9)).select(name, F.lit("1d").alias("subtype"))
    found = GenePlan("NS3", external=True).called(customers.select(_text("c_nationkey").alias("ref_id"), name), calls, priority)
    return found.select("ref_id", "accession", "subtype", "gt")


@query("SELECT 'L' || l_orderkey AS accession, string_agg(DISTINCT g, ',' ORDER BY g) AS genes FROM (SELECT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN 'NS3' WHEN 1 THEN 'NS5A' WHEN 2 THEN 'NS5B' ELSE 'core' END AS g FROM lineitem WHERE l_discount <= 0.05) WHERE g <> 'core' GROUP BY l_orderkey")
def agg_gene_sets(spark, d):
    """Two searches, of open and of closed lines; hits of a discount above 0.05 are no hits."""
    kind = F.col("l_linenumber") % 4
    rows = c.table(spark, d, "lineitem").select(
        F.concat(F.lit("L"), _text("l_orderkey")).alias("accession"), F.when(kind == 0, "NS3").when(kind == 1, "NS5A").when(kind == 2, "NS5B").otherwise("core").alias("sseqid"), F.when(F.col("l_discount") <= 0.05, 1e-9).otherwise(1e-3).alias("evalue"), "l_linestatus"
    )
    found = hits.gene_sets([rows.filter("l_linestatus = 'O'"), rows.filter("l_linestatus <> 'O'")])
    return found.select("accession", F.array_join("genes", ",").alias("genes"))


# Readers and writers: what is written is read again


@query("SELECT accession, regexp_replace(regexp_replace(seq, '(.{4})', '\\1' || chr(10), 'g'), '\\n$', '') AS body FROM cohort", c.COHORT_SQL)
def src_fasta_raw(spark, d):
    """The lines of a record as they stand in the file."""
    path = workdir.new_path(spark, "fasta")
    files.write_fasta(c.cohort(spark, d), path, header="accession", width=4)
    return files.read_fasta(spark, path, raw=True).select("accession", F.regexp_replace("body", r"\n$", "").alias("body"))


@query("SELECT accession, lower(seq) AS seq FROM cohort", c.COHORT_SQL)
def src_fasta_case(spark, d):
    """Aligned files keep their letters' case; a file without a record, or a repeated accession, would be an error."""
    path = workdir.new_path(spark, "fasta")
    files.write_fasta(c.cohort(spark, d).withColumn("seq", F.lower("seq")).repartition(2), path, header="accession")
    return files.read_fasta(spark, path, upper=False, filled=True, unique=True).select("accession", "seq")


@query("SELECT '/data/' || c_name || '.fasta' AS path FROM customer")
def src_path_list(spark, d):
    path = workdir.new_path(spark, "paths")
    named = F.concat(F.lit("/data/"), "c_name", F.lit(".fasta"))
    c.table(spark, d, "customer").select(F.explode(F.array(F.concat(F.lit("  "), named), F.lit(" "))).alias("value")).write.text(path)
    return files.read_paths(spark, path)


def _json_arrays(rows: DataFrame, block: Column, path: str) -> None:
    """One JSON array a file, of the rows of a block."""
    rows.groupBy(block.alias("block")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).alias("value")).write.partitionBy("block").text(path)


@query("SELECT CAST(c_custkey % 8 + 1 AS VARCHAR) AS gt, CAST(c_custkey % 8 + 1 AS VARCHAR) || 'b' AS subtype, 'R' || c_custkey AS accession, 'ACGT' || repeat('A', CAST(c_custkey % 5 AS INTEGER)) AS seq, CAST(c_custkey AS INTEGER) AS first_na FROM customer WHERE c_custkey % 6 <> 0")
def src_json_refs(spark, d):
    path = workdir.new_path(spark, "json")
    named = F.when(_every(6), "unknown").otherwise(F.concat(F.lit("Genotype "), (_key() % 8 + 1).cast("string"), F.lit("B")))
    rows = c.table(spark, d, "customer").select(F.concat(F.lit("R"), _text("c_custkey")).alias("accession"), named.alias("genotypeName"), F.concat(F.lit("acgt"), F.repeat(F.lit("a"), (_key() % 5).cast("int"))).alias("sequence"), _key().cast("int").alias("firstNA"))
    _json_arrays(rows, F.floor(F.col("firstNA") / 500), path)
    return files.read_subtype_references(spark, path)


@query("SELECT 'genotype ' || c_custkey || ' | ' || CASE g WHEN 'NS5A_NTD' THEN 'NS5A' ELSE g END AS header, upper(c_mktsegment) || CASE g WHEN 'NS3' THEN 'A' WHEN 'NS5A_NTD' THEN 'C' ELSE 'D' END AS seq FROM customer, (SELECT unnest(['NS3', 'NS5A_NTD', 'NS5B']) AS g) WHERE c_custkey % 5 <> 0")
def rp_gt_refs_fasta(spark, d):
    """JSON references as FASTA in the order of genotypes and genes; repeated ones, other genes, other strains and empty ones go."""
    source, target = workdir.new_path(spark, "json"), workdir.new_path(spark, "fasta")
    kinds = F.array(*(F.struct(F.lit(k).alias("n"), F.lit(g).alias("abstractGene"), F.lit(x).alias("x")) for k, (g, x) in enumerate([("NS3", "a"), ("NS5A_NTD", "c"), ("NS5B", "d"), ("core", "e"), ("NS3", "z"), ("NS5B", "")])))
    rows = c.table(spark, d, "customer").withColumn("k", F.explode(kinds))
    seq = F.when(F.col("k.x") == "", "").otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.col("k.x")))
    rows = rows.select((_key() * 10 + F.col("k.n")).alias("name"), F.col("k.abstractGene").alias("abstractGene"), F.concat(F.when(_every(5), "lab").otherwise("HCV"), _text("c_custkey")).alias("strain"), seq.alias("refSequence"))
    _json_arrays(rows, F.floor(F.col("name") / 5000), source)
    found = files.exported_references(spark, source, ["NS3", "NS5A_NTD", "NS5B"], {"NS5A_NTD": "NS5A"})
    files.write_fasta(found, target, order=["genotype", "place"])
    return files.read_fasta(spark, target).select("header", "seq")


@query("SELECT 'a, \"' || c_custkey || '\"' AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE ' ' || c_mktsegment || ' ' END AS segment FROM customer")
def snk_tsv_migrate(spark, d):
    """A tab-separated index as CSV; its cells keep their white space, and the old table is gone."""
    old, new = workdir.new_path(spark, "tsv"), workdir.new_path(spark, "csv")
    rows = c.table(spark, d, "customer").select(F.concat(F.lit('a, "'), _text("c_custkey"), F.lit('"')).alias("name"), F.when(_every(3), "").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("segment"))
    rows.write.csv(old, header=True, sep="\t", escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    files.migrated(spark, {old: new, old + "-none": new + "-none"})
    return spark.read.csv(new, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


@query("SELECT CAST(c_custkey AS VARCHAR) AS accession, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS source_isolate, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' | x' END AS source_country, CAST(c_nationkey AS VARCHAR) AS source_zone FROM customer")
def prj_rename_dynamic(spark, d):
    """Qualifiers become columns: the preferred first, the others by name."""
    pairs = F.array(F.struct(F.lit("zone"), F.array(_text("c_nationkey"))), F.when(_every(3), F.struct(F.lit("country"), F.array(F.col("c_name"), F.lit("x")))), F.when(_every(2), F.struct(F.lit("isolate"), F.array(F.col("c_mktsegment")))))
    rows = c.table(spark, d, "customer").select(_text("c_custkey").alias("accession"), F.map_from_entries(F.filter(pairs, lambda x: x.isNotNull())).alias("q"))
    return grouping.qualifier_columns(rows, "q", ["isolate"])


@query("SELECT gt, count(*) AS n FROM cohort GROUP BY gt", c.COHORT_SQL)
def src_cache(spark, d):
    """A stage that is written once and read twice; another setting makes another stage."""
    path = workdir.new_path(spark, "cache")
    stage = lambda least: workdir.cached(spark, path, lambda: c.cohort(spark, d).filter(F.length("seq") >= least).select("accession", "gt"), [f"{d}/lineitem.parquet", f"{d}/orders.parquet"], {"least": least})
    stage(3), stage(1)
    return stage(1).groupBy("gt").agg(F.count("*").alias("n"))
