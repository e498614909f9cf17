"""Search by seeds against enumeration: the best local alignment of every pair, by the whole matrix."""

import random

import numpy as np
import pytest

from cladeframe.operators import alignment, extraction, pairbatch, search


def codes(s):
    return np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64)


def mutated(s, r, rate, symbols="ACGT", gaps=0.01):
    out = []
    for c in s:
        x = r.random()
        if x < rate:
            out.append(r.choice(symbols))
        elif x < rate + gaps:
            out.append(c + r.choice(symbols))
        elif x >= rate + 2 * gaps:
            out.append(c)
    return "".join(out)


@pytest.mark.parametrize("scores", [alignment.GLOBAL_AA, alignment.LOCAL_NT, alignment.PLAIN, extraction.WINDOW])
@pytest.mark.parametrize("local", [False, True])
def test_batch_equals_single(scores, local):
    r = random.Random(1)
    pairs = [tuple("".join(r.choice("ACGTN") for _ in range(r.randint(0, 25))) for _ in range(2)) for _ in range(200)] + [("", ""), ("A", ""), ("", "CC")]
    got = pairbatch.align([codes(q) for q, _ in pairs], [codes(t) for _, t in pairs], alignment.costs(scores), local)
    for (q, t), g in zip(pairs, got, strict=True):
        want = alignment.align(q, t, scores, local)
        a, b = ("".join(map(chr, x)) for x in g.rows(codes(q), codes(t), ord("-")))
        assert (g.score, a, b) == (want.score, want.query, want.ref)
        if g.steps.size:
            assert (g.query[0] + 1, g.query[1], g.ref[0] + 1, g.ref[1]) == (want.query_start, want.query_end, want.ref_start, want.ref_end)


def test_band_equals_whole_matrix_where_the_path_fits():
    r = random.Random(4)
    refs = ["".join(r.choice("ACGT") for _ in range(300)) for _ in range(40)]
    queries = [mutated(t[50 : 50 + r.randint(60, 200)], r, 0.05) for t in refs]
    args = [codes(q) for q in queries], [codes(t) for t in refs], search.BASES.costs
    whole, banded = pairbatch.align(*args, True), pairbatch.align(*args, True, [(10, 90)] * 40)
    assert [(x.score, x.query, x.ref, x.steps.tolist()) for x in whole] == [(x.score, x.query, x.ref, x.steps.tolist()) for x in banded]


def enumerated(queries, refs, plan):
    """(query, ref): (score, strand or frame, span) of the best local alignment by the whole matrix, if it is significant."""
    space = sum(len(t) for t in refs.values())
    out = {}
    for name, q in queries.items():
        read = search.readings(search._bytes(q), plan.translated)
        for ref, t in refs.items():
            paths = pairbatch.align([s for _, s in read], [search._bytes(t)] * len(read), plan.costs, True)
            best = max(range(len(read)), key=lambda k: paths[k].score)
            path, n = paths[best], len(read[best][1])
            if path.score > 0 and n * space * 2.0 ** -plan.bits(path.score) <= plan.evalue:
                out[name, ref] = path.score, read[best][0]
    return out


def bits_of(found, plan):
    return {(h["query"], h["ref"]): (round(h["bitscore"], 6), h["frame"]) for h in found}


def test_nucleotide_search(spark):
    r = random.Random(7)
    refs = {f"r{k}": "".join(r.choice("ACGT") for _ in range(r.randint(300, 900))) for k in range(6)}
    refs["poly"] = "".join(r.choice("ACGT") for _ in range(100)) + "A" * 200 + "".join(r.choice("ACGT") for _ in range(150))
    back = str.maketrans("ACGT", "TGCA")
    queries = {"none": "".join(r.choice("ACGT") for _ in range(300)), "empty": "", "short": "ACGT", "null": None, "a": "A" * 150, "n": "N" * 100}
    for k in range(40):
        t = refs[r.choice(sorted(refs))]
        at = r.randrange(max(1, len(t) - 250))
        piece = mutated(t[at : at + r.randint(60, 250)], r, r.choice([0.0, 0.05, 0.1, 0.2]))
        queries[f"q{k}"] = piece if k % 3 else piece[::-1].translate(back)
    df = spark.createDataFrame(sorted(queries.items()), "query string, seq string")
    rd = spark.createDataFrame(sorted(refs.items()), "ref string, ref_seq string")
    found = search.hits(df, rd).collect()
    got = bits_of(found, search.BASES)
    want = {k: (round(search.BASES.bits(s), 6), f) for k, (s, f) in enumerated({k: v for k, v in queries.items() if v}, refs, search.BASES).items()}
    same = sum(got.get(k) == v for k, v in want.items())
    assert set(got) <= set(want) and len(want) > 30 and same >= 0.95 * len(want), (same, len(want))
    assert got["a", "poly"] == want["a", "poly"]  # only masked words lead there
    for h in found:
        plain = h["sseq"].replace("-", "")
        t, q = refs[h["ref"]], queries[h["query"]]
        if h["frame"] == 1:
            assert q[h["qstart"] - 1 : h["qend"]] == h["qseq"].replace("-", "") and t[h["sstart"] - 1 : h["send"]] == plain
        else:
            assert t[h["send"] - 1 : h["sstart"]] == plain and q[h["qstart"] - 1 : h["qend"]].translate(back)[::-1] == h["qseq"].replace("-", "")
        assert h["length"] == len(h["qseq"]) and h["gaps"] == (h["qseq"] + h["sseq"]).count("-")
        assert h["mismatch"] == sum(a != b and "-" not in (a, b) for a, b in zip(h["qseq"], h["sseq"], strict=True))


def test_translated_search(spark):
    from cladeframe import genes

    r = random.Random(3)
    refs = {f"p{k}": "".join(r.choice(search.RESIDUES) for _ in range(r.randint(120, 250))) for k in range(5)}
    codon = {}
    for c, a in genes.CODONS.items():
        codon.setdefault(a, []).append(c)
    back = str.maketrans("ACGT", "TGCA")
    queries, planted = {"none": "".join(r.choice("ACGT") for _ in range(300))}, {}
    for k in range(30):
        name = r.choice(sorted(refs))
        at = r.randrange(len(refs[name]) - 90)
        aa = mutated(refs[name][at : at + r.randint(40, 90)], r, r.choice([0.1, 0.3]), search.RESIDUES)
        lead = r.randrange(3)
        nt = "".join(r.choice("ACGT") for _ in range(lead)) + "".join(r.choice(codon[a]) for a in aa)
        queries[f"q{k}"] = nt if k % 2 else nt[::-1].translate(back)
        planted[f"q{k}"] = name, lead + 1
    df = spark.createDataFrame(sorted(queries.items()), "query string, seq string")
    rd = spark.createDataFrame(sorted(refs.items()), "ref string, ref_seq string")
    plan = search.TRANSLATED
    found = search.hits(df, rd, plan).collect()
    got = bits_of(found, plan)
    want = {k: (round(plan.bits(s), 6), f) for k, (s, f) in enumerated(queries, refs, plan).items()}
    same = sum(got.get(k) == v for k, v in want.items())
    assert set(got) <= set(want) and len(want) >= 25 and same >= 0.95 * len(want), (same, len(want))
    for h in found:
        q = queries[h["query"]]
        low, high = sorted((h["qstart"], h["qend"]))
        piece = q[low - 1 : high] if h["frame"] > 0 else q[low - 1 : high][::-1].translate(back)
        assert (h["frame"] > 0) == (h["qstart"] < h["qend"]) and "".join(genes.CODONS[piece[i : i + 3]] for i in range(0, len(piece), 3)) == h["qseq"].replace("-", "")
        assert refs[h["ref"]][h["sstart"] - 1 : h["send"]] == h["sseq"].replace("-", "")


def test_neighbours_and_statistics():
    plan = search.TRANSLATED
    place, code = search.word_codes(search._bytes("WCXACD"), plan)
    assert place.tolist() == [3]
    _, near = search._with_neighbours(place, code, plan)
    a = len(plan.symbols)
    want = set()
    for x in plan.symbols:
        for y in plan.symbols:
            for z in plan.symbols:
                if sum(plan.matrix[ord(p), ord(q)] for p, q in zip("ACD", x + y + z, strict=True)) >= plan.neighbours:
                    want.add((plan.symbols.index(x) * a + plan.symbols.index(y)) * a + plan.symbols.index(z))
    assert set(near.tolist()) == want
    assert search.decay(search.base_matrix(1, -1), "ACGT", (1, 1, 1, 1)) == pytest.approx(np.log(3), abs=1e-9)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "query string, seq string")
    refs = spark.createDataFrame([("r", "ACGT" * 30)], "ref string, ref_seq string")
    assert search.hits(none, refs).count() == 0
    assert search.hits(spark.createDataFrame([("q", "ACGT" * 30)], "query string, seq string"), refs.filter("ref = 'x'")).count() == 0


def test_bounds_and_winners():
    """No alignment beats its bound; the winner is that of all pairs, and related references save alignments."""
    r = random.Random(12)
    for scores, symbols in ((alignment.LOCAL_NT, "ACGT"), (alignment.GLOBAL_AA, search.RESIDUES), (extraction.WINDOW, "ACGTN"), (alignment.PLAIN, "ACGT")):
        for local in (True, False):
            refs = ["".join(r.choice(symbols) for _ in range(r.randint(0, 60))) for _ in range(12)]
            queries = [mutated(r.choice(refs), r, 0.1, symbols) for _ in range(15)] + ["", "A"]
            known = alignment.Sketches(refs, scores)
            got = alignment.winners(queries, refs, scores, local)
            for q, (best, al, n) in zip(queries, got, strict=True):
                every = [alignment.align(q, t, scores, local).score for t in refs]
                assert (np.array(every) <= known.bounds(q) + 1e-9).all()
                assert best == every.index(max(every)) and al == alignment.align(q, refs[best], scores, local) and 1 <= n <= 12
    refs = ["".join(r.choice("ACGT") for _ in range(300)) for _ in range(30)]
    got = alignment.winners([mutated(t, r, 0.03) for t in refs], refs, alignment.LOCAL_NT, True)
    assert [g[0] for g in got] == list(range(30)) and sum(g[2] for g in got) <= 3 * 30


@pytest.mark.parametrize("on", [[], ["gt"]])
def test_best_reference_of_all(spark, on, monkeypatch):
    r = random.Random(21)
    refs = [("12"[k % 2], k, f"r{k}", "".join(r.choice("ACGT") for _ in range(80))) for k in range(9)]
    rows = [(f"q{k}", "12"[k % 2], mutated(r.choice(refs)[3], r, 0.2)) for k in range(30)] + [("none", "9", "ACGT"), ("null", "1", None)]
    df = spark.createDataFrame(rows, "name string, gt string, seq string")
    rd = spark.createDataFrame(refs, "gt string, ref_ordinal int, ref_name string, ref_seq string")
    want = {}
    for name, gt, seq in rows:
        own = [x for x in refs if not on or x[0] == gt]
        if own:
            scored = [(-alignment.align(seq or "", x[3], alignment.LOCAL_NT, True).score, x[1], x[2]) for x in own]
            want[name] = min(scored)[2], -min(scored)[0]
    ask = lambda: {x["name"]: (x["ref_name"], x["score"]) for x in alignment.best_reference(df, rd, on, "name").collect()}
    assert ask() == want
    monkeypatch.setattr("cladeframe.operators.sized.BYTES", 10)
    assert ask() == want


def test_plan_searches_by_itself(spark):
    """Genotypes, subtypes, protein windows and a folder's assignments from own hits, on sequences of known origin."""
    from cladeframe import genes
    from cladeframe.plans.gene import GenePlan, Options, folder_assignments

    r = random.Random(31)
    codon = {}
    for c, a in genes.CODONS.items():
        codon.setdefault(a, c)
    proteins = {g: "".join(r.choice(genes.VALID_AA) for _ in range(213)) for g in "123"}
    gt_nt = {g: "".join(codon[a] for a in p) for g, p in proteins.items()}
    types = {f"{g}{s}": mutated(gt_nt[g], r, 0.08, gaps=0) for g in "123" for s in "ab"}
    truth, rows = {}, []
    for k in range(24):
        t = r.choice(sorted(types))
        at = 3 * r.randrange(20)
        truth[f"S{k}"] = t
        rows.append((f"S{k}", "x", "GG" + mutated(types[t][at : at + 450], r, 0.02, gaps=0)))
    rows.append(("junk", "x", "".join(r.choice("ACGT") for _ in range(400))))
    records = spark.createDataFrame(rows, "accession string, ref_id string, seq string")
    gt_refs = spark.createDataFrame([(g, s, int(g)) for g, s in gt_nt.items()], "gt string, seq string, ordinal int")
    sub_refs = spark.createDataFrame([(t, f"AC{t}", s, k) for k, (t, s) in enumerate(sorted(types.items()))], "subtype string, accession string, seq string, ordinal int")
    plan = GenePlan("NS5A", options=Options())
    said = spark.createDataFrame([], "accession string, genotype string, subtype string")
    assigned = plan.genotypes(records, plan.genotype_hits(records, gt_refs), said)
    subs = plan.subtypes(assigned, plan.subtype_hits(assigned, records, sub_refs), said).cache()
    assert {x["accession"]: x["subtype"] for x in subs.collect()} == truth
    refs = spark.createDataFrame(sorted(proteins.items()), "gt string, seq string")
    windows = plan.protein_windows(subs, records, refs)
    assert {x["frame"] for x in windows.collect()} == {3} and windows.count() == 24
    from pyspark.sql import functions as F

    nt_windows = plan.genotype_hits(records, gt_refs)
    own = nt_windows.join(subs.select(F.col("accession").alias("query"), F.col("gt").alias("target")), ["query", "target"]).select("query", "qstart", "qend", "sstart")
    found = plan.proteins(subs, records, own, refs).collect()
    assert len(found) == 24 and all(abs(len(x["seq"]) - 150) <= 2 for x in found)
    genes_of = spark.createDataFrame([("NS5A", g, s, int(g)) for g, s in gt_nt.items()] + [("NS3", "1", "".join(r.choice("ACGT") for _ in range(600)), 9)], "gene string, gt string, seq string, ordinal int")
    folder = {x["accession"]: x for x in folder_assignments(records, genes_of, sub_refs).collect()}
    assert {k: (x["gene"], x["genotype"], x["subtype"], x["subtype_reference_accession"]) for k, x in folder.items()} == {k: ("NS5A", t[0], t, f"AC{t}") for k, t in truth.items()}
    plan_of_none = folder_assignments(records.filter("accession = 'junk'"), genes_of, sub_refs)
    assert plan_of_none.count() == 0


def test_queries_of_a_search_are_made_once(spark):
    from pyspark.sql import functions as F

    r = random.Random(17)
    ref = "".join(r.choice("ACGT") for _ in range(200))
    made = spark.sparkContext.accumulator(0)

    def counted(seq):
        made.add(1)
        return seq

    plain = spark.createDataFrame([(f"q{k}", mutated(ref, r, 0.05)) for k in range(20)], "query string, seq string")
    asked = plain.withColumn("seq", F.udf(counted, "string").asNondeterministic()("seq"))
    assert search.hits(asked, spark.createDataFrame([("r", ref)], "ref string, ref_seq string")).count() == 20
    assert made.value == 20


@pytest.mark.parametrize("name", ["al_blastn_subtype", "al_blastx_aa", "al_blastn_folder"])
def test_a_search_behind_a_search_runs_once(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("MapInArrow" in line and "sseq" in line for line in plan.splitlines()) == 1


PLAIN_COSTS = [search.BASES.costs, alignment.costs(alignment.LOCAL_NT), alignment.costs(extraction.WINDOW), pairbatch.Costs(2, -1, -2, -1), pairbatch.Costs(1.5, -1, -2, -0.5)]


def banded_pairs(r, n, symbols):
    out = [(codes(""), codes("ACGT"), (-3, 3)), (codes("ACGT"), codes(""), (-3, 3))]
    for _ in range(n):
        t = "".join(r.choice(symbols) for _ in range(r.randint(0, 90)))
        a = r.randint(0, len(t) // 2)
        low = a - r.randint(-8, 30)
        out.append((codes(mutated(t[a:], r, r.choice([0.0, 0.1, 0.3]), symbols, r.choice([0.0, 0.02, 0.1]))), codes(t), (low, low + r.randint(0, 60))))
    return out


@pytest.mark.parametrize("symbols", ["ACGT", "ACGTN", "AC"])
@pytest.mark.parametrize("costs", PLAIN_COSTS)
def test_paths_from_kept_values(costs, symbols, monkeypatch):
    """Every path as of its pair alone in its own band, whatever pairs share its batch; small batches and single rows too."""
    pairs = banded_pairs(random.Random(5), 120, symbols)
    said = lambda x: (x.score, x.query, x.ref, x.steps.tolist())
    want = [said(pairbatch.align([q], [t], costs, True, [band])[0]) for q, t, band in pairs]
    queries, refs, bands = (list(x) for x in zip(*pairs, strict=True))
    plain = not (costs.wild and "N" in symbols)  # scores of other kinds go by another program
    for wave in (1 << 24, 20_000):
        monkeypatch.setattr(pairbatch, "WAVE", wave)
        got = [said(x) for x in pairbatch.traced(queries, refs, costs, bands)]
        assert not plain or got == want
    whole = pairbatch.align(queries, refs, costs, True)
    assert pairbatch.scores(queries, refs, costs).tolist() == [x.score for x in whole]


def test_words_of_queries_are_made_once(spark):
    r = random.Random(17)
    ref = "".join(r.choice("ACGT") for _ in range(200))
    asked = spark.createDataFrame([("q", ref, "")], "query string, seq string, grp string")
    plan = lambda t: search.candidates(asked, spark.createDataFrame([("r", t, "")], "ref string, ref_seq string, grp string"), search.BASES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(ref).count("MapInArrow") == 2 < plan(ref + "A" * 200).count("MapInArrow")
