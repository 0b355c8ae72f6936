"""Reads, references and files on small invented input."""

import random

from pyspark.sql import functions as F

from taxatally.functions.sequences import reverse_complement, trim_window
from taxatally.operators import assign
from taxatally.operators import reads as rd
from taxatally.session import small_table
from taxatally.sources import biom, fasta, genbank, manifest

random.seed(3)


def dna(n):
    return "".join(random.choice("acgt") for _ in range(n))


def turn(seq):
    return seq[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))


def trim(qual, quality=30, crop=110, window=5):
    """Step by step: crop, both ends, first low window."""
    q = list(enumerate(qual[:crop]))
    while q and q[0][1] < quality:
        q.pop(0)
    while q and q[-1][1] < quality:
        q.pop()
    for i in range(len(q) - window + 1):
        if sum(v for _, v in q[i : i + window]) < quality * window:
            return q[:i]
    return q


def test_trimming(spark):
    rows = []
    for i in range(200):
        n = random.randint(5, 130)
        rows.append((f"r{i}", dna(n), [random.choice([38, 38, 38, 34, 31, 20, 9]) for _ in range(n)]))
    df = spark.createDataFrame(rows, "read_id string, seq string, qual array<int>")
    got = {r["read_id"]: r for r in rd.trim_reads(df, shortest=3).collect()}
    for name, seq, qual in rows:
        kept = trim(qual)
        if len(kept) < 3:
            assert name not in got
        else:
            assert got[name]["seq"] == seq[kept[0][0] : kept[0][0] + len(kept)]
            assert got[name]["qual"] == [v for _, v in kept]


def test_merging(spark):
    whole = dna(120).upper()
    other = dna(110).upper()
    wrong = whole[:60] + ("A" if whole[60] != "A" else "C") + whole[61:]
    rows = [
        ("exact", 1, whole[:80], [35] * 80), ("exact", 2, turn(whole[40:]), [35] * 80),
        ("mismatch", 1, wrong[:80], [20] * 80), ("mismatch", 2, turn(whole[40:]), [35] * 80),
        ("apart", 1, whole, [35] * 120), ("apart", 2, turn(other), [35] * 110),
        ("forward", 1, whole, [35] * 120), ("reverse", 2, whole, [35] * 120),
    ]
    df = spark.createDataFrame([("s", *r) for r in rows], "sample string, read_id string, mate int, seq string, qual array<int>")
    out = {r["read_id"]: r for r in rd.merge_pairs(rd.pair_mates(df)).collect()}
    assert out["exact"]["seq"] == out["mismatch"]["seq"] == whole
    assert len(out["mismatch"]["qual"]) == 120
    assert (out["apart"]["merged"], out["apart"]["seq"]) == (0, whole)
    assert out["forward"]["merged"] == 0 and "reverse" not in out


def test_dereplicate_and_funnel(spark):
    merged = small_table(spark, "sample string, seq string", [["a", "acgt"]] * 3 + [["a", "aaaa"]] * 2 + [["b", "acgt"]] * 4)
    kept = rd.dereplicate(merged)
    assert {(r["sample"], r["reads"]) for r in kept.collect()} == {("a", 3), ("b", 4)}
    assert kept.select("otu").distinct().count() == 1


def brute(query, ref, identity=0.98, coverage=0.8, anchor=4):
    best = None
    for diag in range(-len(query), len(ref)):
        start = max(0, -diag)
        n = min(len(query), len(ref) - diag) - start
        if n >= coverage * len(query) and n > 0:
            pairs = [(query[start + i], ref[start + diag + i]) for i in range(n)]
            share = sum(x == y or x not in "acgt" or y not in "acgt" for x, y in pairs) / n
            equal = "".join("=" if x == y and x in "acgt" else "." for x, y in pairs)
            if share >= identity and "=" * min(anchor, n) in equal:
                best = max(best or (0, 0), (share, n))
    return best


def references():
    refs = {f"r{i}": dna(300) for i in range(6)}
    refs["repeat"] = "ta" * 150
    return refs


def queries(refs):
    out = {"none": dna(100), "repeat": "at" * 45}
    for i, (name, seq) in enumerate(refs.items()):
        for changes in range(4):
            q = list(seq[i * 20 : i * 20 + 100])
            for p in random.sample(range(100), changes):
                q[p] = random.choice("acgt".replace(q[p], ""))
            out[f"{name}-{changes}"] = "".join(q)
        out[f"{name}-turned"] = turn(seq[50:150])
        out[f"{name}-hang"] = dna(15) + seq[:85]
    return out


def test_search_finds_every_match(spark):
    refs = references()
    asked = queries(refs)
    rdf = small_table(spark, "ref string, seq string", refs.items())
    qdf = small_table(spark, "query string, seq string", asked.items())
    got = {(r["query"], r["ref"]): round(r["identity"], 9) for r in assign.search(qdf, rdf).collect()}
    want = {}
    for q, qs in asked.items():
        for r, rs in refs.items():
            found = [b for b in (brute(qs, rs), brute(qs, turn(rs))) if b]
            if found:
                want[(q, r)] = round(max(found)[0], 9)
    assert got == want and len(want) > 20


def test_search_of_short_and_ambiguous_queries(spark):
    refs = {f"r{i}": dna(90) for i in range(4)}
    refs |= {"copy": refs["r0"], "few": refs["r1"][:40] + "n" + refs["r1"][41:80] + "ry", "run": dna(30) + "n" * 25 + dna(30), "tiny": "acg", "holes": "".join(c if i % 9 else "n" for i, c in enumerate(refs["r2"]))}
    asked = {f"s{n}": refs["r3"][7 : 7 + n] for n in range(1, 30)} | {f"h{n}": dna(2) + refs["r0"][: n] for n in (8, 12, 20)}
    asked |= {"every12": "".join(c if i % 12 else "n" for i, c in enumerate(refs["r2"])), "nrun": refs["r1"][:30] + "n" * 12 + refs["r1"][42:60], "all": "n" * 20, "one": "N", "upper": refs["r3"][5:25].upper(), "none": "", "mixed": refs["r0"][10:16] + "nnn" + refs["r0"][19:27]}
    asked |= {f"wrong{n}": refs["r1"][20 : 20 + n] + "acgt"["cgta".index(refs["r1"][20 + n])] + refs["r1"][21 + n : 69] for n in (3, 24, 40)}
    rdf = small_table(spark, "ref string, seq string", refs.items())
    qdf = small_table(spark, "query string, seq string", asked.items())
    got = {(r["query"], r["ref"]): (round(r["identity"], 9), r["aligned"]) for r in assign.search(qdf, rdf).collect()}
    want = {}
    for q, qs in asked.items():
        for r, rs in refs.items():
            found = [b for b in (brute(qs.lower(), rs), brute(qs.lower(), turn(rs).translate(str.maketrans("ry", "yr")))) if b]
            if found:
                want[(q, r)] = (round(max(found)[0], 9), max(found)[1])
    assert got == want and {q for q, _ in want} >= {"s1", "s5", "s29", "every12", "nrun", "mixed"}


def test_two_passes(spark):
    refs = references()
    asked = queries(refs)
    lin = {r: ["root", "odd" if i % 2 else "even", r] for i, r in enumerate(refs)}

    def side(names):
        return (
            small_table(spark, "ref string, seq string", [(n, refs[n]) for n in names]),
            spark.createDataFrame([(n, lin[n]) for n in names], "ref string, lineage array<string>"),
        )

    names = list(refs)
    qdf = small_table(spark, "query string, seq string", asked.items())
    out = {r["query"]: (r["taxon"], r["pass"]) for r in assign.assign_in_two_passes(qdf, side(names[:3]), side(names[3:])).collect()}
    for q, qs in asked.items():
        hit = [[n for n in part if brute(qs, refs[n]) or brute(qs, turn(refs[n]))] for part in (names[:3], names[3:])]
        want = (hit[0][0], 1) if hit[0] else ((hit[1][0], 2) if hit[1] else ("unassigned", 2))
        assert out[q] == want, q


def test_search_and_assign(spark):
    """The same as from the written hits; what leaves the tasks is a row for a query and block, not for a hit."""
    refs = references()
    asked = queries(refs)
    names = [(n, s) for n, s in refs.items()] + [("copy", refs["r0"]), ("copy2", refs["r0"]), ("unnamed", refs["r1"]), ("null", refs["r2"])]
    lin = [(n, ["root", "odd" if i % 2 else "even", n]) for i, n in enumerate(refs)] + [("copy", ["root", None, "r0"]), ("copy2", ["other"]), ("null", None)]
    qdf, rdf = small_table(spark, "query string, seq string", asked.items()), small_table(spark, "ref string, seq string", names)
    ldf = spark.createDataFrame(lin, "ref string, lineage array<string>")
    want = sorted(map(tuple, assign.assign(qdf, assign.search(qdf, rdf), ldf).collect()))
    assert sorted(map(tuple, assign.search_and_assign(qdf, rdf, ldf).collect())) == want and len({w[1] for w in want}) > 3
    many = small_table(spark, "ref string, seq string", [(f"m{i}", refs["r0"]) for i in range(500)])
    same = many.select("ref", F.array(F.lit("root"), "ref").alias("lineage"))
    one = small_table(spark, "query string, seq string", [("q", refs["r0"])])
    short, targets, named = assign._asked(one, many, 0.98, 0.8, 16, 4, True)
    assert assign.matched_lineages(short, targets, named, same, 0.98, 0.8, 16).count() == 1
    assert [tuple(r) for r in assign.search_and_assign(one, many, same).collect()] == [("q", "root", 1, 500)]
    assert assign.search_and_assign(qdf, rdf.where("false"), ldf).where("hits > 0").count() == 0


def test_common_lineage(spark):
    rows = [("a", ["x", "y", "z"]), ("a", ["x", "y", "w"]), ("b", ["x"]), ("c", ["x", "y"]), ("c", ["v", "y"])]
    df = spark.createDataFrame(rows, "query string, lineage array<string>")
    got = {r["query"]: r["common"] for r in assign.common_lineage(df).collect()}
    assert got == {"a": ["x", "y"], "b": ["x"], "c": []}


def test_chimeras(spark):
    refs = references()
    rdf = small_table(spark, "ref string, seq string", refs.items())
    qdf = small_table(spark, "query string, seq string", [["good", refs["r0"][:110]], ["bad", refs["r1"][:55] + refs["r2"][100:155]], ["new", dna(110)]])
    got = {r["query"]: r["chimera"] for r in assign.split_chimeras(qdf, rdf).collect()}
    assert got == {"good": 0, "bad": 1, "new": 0}


def test_fastq_over_many_splits(spark, tmp_path):
    rows = [(f"r{i}", dna(40), [31] * 39 + [2 if i % 2 else 31]) for i in range(3000)]
    for part in range(2):
        text = "".join(f"@{n} extra\n{s}\n+\n{'@' + ''.join(chr(q + 33) for q in qs[1:])}\n" for n, s, qs in rows[part::2])
        (tmp_path / f"{part}.fastq").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r["read_id"]: (r["seq"], r["qual"]) for r in fasta.read_fastq(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {n: (s, [31, *qs[1:]]) for n, s, qs in rows}


def test_fasta_with_wrapped_lines(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one first > entry\nacgt\nacg\n>two\nttt\n")
    got = {tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {("one", "first > entry", "acgtacg"), ("two", "", "ttt")}


def test_genbank_record(spark, tmp_path):
    (tmp_path / "a.gb").write_text(
        "LOCUS       AB1  12 bp  DNA\nDEFINITION  Some frog.\nACCESSION   AB1 REGION: 70..81\nVERSION     AB1.1\nSOURCE      frog\n"
        "  ORGANISM  Rana temporaria\n            Eukaryota; Metazoa; Chordata;\n            Amphibia.\nREFERENCE   1\n"
        "FEATURES             Location/Qualifiers\n     source          1..12\n                     /organism=\"Rana temporaria\"\n"
        "                     /db_xref=\"taxon:8407\"\n     rRNA            1..12\n                     /product=\"12S ribosomal\n                     RNA\"\n"
        "ORIGIN      \n        1 acgtnacgtr\n       11 ac\n//\n"
    )
    r = genbank.read_genbank(spark, str(tmp_path / "a.gb")).collect()
    assert len(r) == 1 and (r[0]["accession"], r[0]["length"], r[0]["taxon_id"], r[0]["seq"]) == ("AB1", 12, 8407, "acgtnacgtrac")
    assert r[0]["organism"] == "Rana temporaria" and r[0]["lineage"] == ["Eukaryota", "Metazoa", "Chordata", "Amphibia"]
    assert [f["type"] for f in r[0]["features"]] == ["source", "rRNA"]
    assert r[0]["features"][1]["qualifiers"]["product"] == "12S ribosomal RNA"


def test_biom_documents(spark, tmp_path):
    rows = [(f"o{i % 7}", f"s{i}", i + 1, None if i % 7 == 0 else ["root", f"o{i % 7}"]) for i in range(50)]
    df = spark.createDataFrame(rows, "otu string, sample string, reads bigint, taxonomy array<string>")
    biom.write_biom(df, str(tmp_path / "b"), cells_per_document=9)
    got = sorted(tuple(r) for r in biom.read_biom(spark, str(tmp_path / "b")).select("otu", "sample", "reads").collect())
    assert got == sorted((o, s, n) for o, s, n, _ in rows)


def test_manifest(spark, tmp_path):
    for name in ("A-12S_R1.fastq", "A-12S_R2.fastq", "B-12S_R1.fastq", "GLOBAL_R1.fastq"):
        (tmp_path / name).write_text("x")
    out = {r["sample"]: r for r in manifest.paired_manifest(manifest.list_files(spark, str(tmp_path))).collect()}
    assert set(out) == {"A-12S", "B-12S"} and out["B-12S"]["file2"] is None and out["A-12S"]["clip_fwd"] == 18


def test_reverse_complement(spark):
    assert spark.range(1).select(reverse_complement(F.lit("AACGTN"))).first()[0] == "NACGTT"


def test_biom_over_many_lines(spark, tmp_path):
    (tmp_path / "t.biom").write_text(
        '{"id": "x", "rows": [\n {"id": "o1", "metadata": {"taxonomy": ["root", "a"]}},\n {"id": "o2", "metadata": null}],\n'
        ' "columns": [{"id": "s1"}, {"id": "s2"}],\n "data": [[0, 0, 3], [1, 1, 4.0]]}\n'
    )
    got = {tuple(r) for r in biom.read_biom_file(spark, str(tmp_path / "t.biom")).select("otu", "sample", "reads").collect()}
    assert got == {("o1", "s1", 3), ("o2", "s2", 4)}


def test_trimming_looks_at_many_reads_together(spark):
    rng = random.Random(12)
    quals = [[rng.choice((12, 29, 31, 33, 38)) for _ in range(rng.choice((0, 3, 5, 40, 130)))] for _ in range(200)]
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(quals)] + [(-1, None)], "id int, qual array<int>")
    found = rows.select("id", trim_window("qual", 30, 110, 5).alias("keep"))
    # Letter by letter in an interpreted expression was slow.
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r["keep"] for r in found.collect()}
    assert got[-1] is None
    for i, q in enumerate(quals):
        q = q[:110]
        good = [x for x, v in enumerate(q) if v >= 30]
        want = (0, 0)
        if good:
            low = [x for x in range(good[0], good[-1] - 3) if sum(q[x : x + 5]) < 150]
            want = (good[0] + 1, (low[0] if low else good[-1] + 1) - good[0])
        assert tuple(got[i]) == want if good else got[i]["bases"] == 0


def test_fastq_files_hold_a_bounded_number_of_reads(spark, tmp_path):
    """A compressed file is read by one task; its lines are put together without its path."""
    df = spark.range(1000).coalesce(1).select(F.col("id").alias("read_id"), F.lit("acgt").alias("seq"), F.array(*[F.lit(q) for q in (31, 2, 30, 9)]).alias("qual"))
    fasta.write_fastq(df, str(tmp_path / "out"), most=300)
    assert len(list((tmp_path / "out").glob("*.gz"))) == 4
    found = fasta.read_fastq(spark, str(tmp_path / "out"))
    rows = found.collect()
    assert sorted(int(r.read_id) for r in rows) == list(range(1000)) and {(r.seq, tuple(r.qual)) for r in rows} == {("acgt", (31, 2, 30, 9))}
    assert all(r.file.endswith(".gz") for r in rows) and len({r.file for r in rows}) == 4
    plan = found.drop("file")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[1].strip().startswith("+- Filter") and "file" not in plan.split("+- Join")[0]
