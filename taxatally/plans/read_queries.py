"""Queries over reads, references and files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from taxatally.functions.sequences import reverse_complement
from taxatally.operators import assign, counts as ct, reads as rd
from taxatally.plans.count_queries import COUNTS, RAWC, counted, raw
from taxatally.plans.registry import Tables, query
from taxatally.session import new_path, small_table, stored
from taxatally.sources import biom, fasta, genbank, manifest, tables

ALPHABET, BASES = "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac"

# ---------------------------------------------------------------- text lines as reads
L = f"""WITH l AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {{documents}}),
w AS (SELECT source AS sample, lang, doc_id, doc_id || '-' || pos AS read_id, regexp_replace(lower(line), '[^a-z]', '', 'g') AS word FROM l),
reads AS (SELECT sample, read_id, lang, doc_id, translate(word, '{ALPHABET}', '{BASES}') AS seq,
  list_transform(string_split(word, ''), lambda c: CASE WHEN c IN ('q', 'x', 'z', 'j', 'k', 'w') THEN 9 ELSE 30 + ascii(c) % 11 END) AS qual FROM w WHERE word <> '')"""


def lines(t: Tables) -> DataFrame:
    # What follows works on single letters, so texts are dealt out evenly first.
    split = t.documents.select("doc_id", "source", "lang", "text").repartition("doc_id").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    word = F.regexp_replace(F.lower("line"), "[^a-z]", "")
    return split.select(F.col("source").alias("sample"), "lang", "doc_id", F.concat("doc_id", F.lit("-"), "pos").alias("read_id"), word.alias("word")).where("word <> ''")


#: Quality of each letter.
QUALITY = np.array([9 if chr(c) in "qxzjkw" else 30 + c % 11 for c in range(128)], np.int32)


@F.arrow_udf(ArrayType(IntegerType()))
def letter_qualities(word: pa.Array) -> pa.Array:
    text = np.frombuffer("".join(word.to_pylist()).encode("ascii"), np.uint8)
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(word).to_numpy(zero_copy_only=False))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(QUALITY[text]))


def reads(t: Tables) -> DataFrame:
    """Mate 1: every line as a sequence over four letters, with a quality per letter."""
    return lines(t).select("sample", "read_id", "lang", "doc_id", F.translate("word", ALPHABET, BASES).alias("seq"), letter_qualities("word").alias("qual"))


def mates(t: Tables) -> DataFrame:
    """Both mates: the second is the line read from its other end, where letters are less certain."""
    one = reads(t).select("sample", "read_id", F.lit(1).alias("mate"), F.upper("seq").alias("seq"), "qual")
    low = F.transform(F.reverse("qual"), lambda q: q - 1)
    two = one.select("sample", "read_id", F.lit(2).alias("mate"), reverse_complement("seq").alias("seq"), low.alias("qual"))
    return one.unionByName(two)


def prepared(t: Tables) -> DataFrame:
    """Reads clipped, trimmed and paired, ready to merge."""
    return rd.pair_mates(rd.trim_reads(rd.clip_primers(mates(t))))


@query("q1_clip_primers", L + " SELECT read_id, seq[19:] AS seq, array_to_string(qual[19:], ',') AS qual FROM reads")
def _(t):
    return rd.clip_primers(reads(t)).select("read_id", "seq", F.array_join(F.col("qual").cast("array<string>"), ",").alias("qual"))


TRIM = """, c AS (SELECT sample, read_id, mate, seq, qual[:110] AS q FROM both_mates WHERE length(seq) >= 90),
g AS (SELECT *, list_position(list_transform(q, lambda x: x >= 30), true) AS a,
  len(q) + 1 - list_position(list_transform(list_reverse(q), lambda x: x >= 30), true) AS z FROM c),
s AS (SELECT *, (SELECT MIN(i) FROM unnest(range(a, z - 3)) u(i) WHERE q[i] + q[i + 1] + q[i + 2] + q[i + 3] + q[i + 4] < 150) AS bad FROM g WHERE a > 0),
k AS (SELECT sample, read_id, mate, seq, q, a, COALESCE(bad, z + 1) - a AS bases FROM s),
trimmed AS (SELECT sample, read_id, mate, seq[a:a + bases - 1] AS seq, q[a:a + bases - 1] AS qual FROM k WHERE bases >= 90)"""
ONE_MATE = ", both_mates AS (SELECT sample, read_id, 1 AS mate, seq, qual FROM reads)"
TWO_MATES = """, r1 AS (SELECT sample, read_id, 1 AS mate, upper(seq) AS seq, qual FROM reads),
both_raw AS (SELECT * FROM r1 UNION ALL SELECT sample, read_id, 2, reverse(translate(seq, 'ACGT', 'TGCA')), list_transform(list_reverse(qual), lambda q: q - 1) FROM r1),
both_mates AS (SELECT sample, read_id, mate, seq[19:] AS seq, qual[19:] AS qual FROM both_raw)"""


@query("q2_trim_reads", L + ONE_MATE + TRIM + " SELECT read_id, seq, array_to_string(qual, ',') AS qual FROM trimmed")
def _(t):
    return rd.trim_reads(reads(t)).select("read_id", "seq", F.array_join(F.col("qual").cast("array<string>"), ",").alias("qual"))


@query("j8_pair_mates", L + TWO_MATES + TRIM + """, p AS (SELECT sample, read_id, MAX(seq) FILTER (WHERE mate = 1) AS seq1, MAX(seq) FILTER (WHERE mate = 2) AS seq2 FROM trimmed GROUP BY 1, 2)
SELECT *, CASE WHEN seq2 IS NULL THEN 'orphan_1' WHEN seq1 IS NULL THEN 'orphan_2' ELSE 'pair' END AS state FROM p""")
def _(t):
    return prepared(t).select("sample", "read_id", "seq1", "seq2", "state")


MERGE = """, mp AS (SELECT a.sample, a.read_id, a.seq AS f, a.qual AS qa, reverse(translate(b.seq, 'ACGT', 'TGCA')) AS r, list_reverse(b.qual) AS qb
  FROM trimmed a LEFT JOIN trimmed b ON a.sample = b.sample AND a.read_id = b.read_id AND b.mate = 2 WHERE a.mate = 1),
mo AS (SELECT sample, read_id, f, r, qa, qb, n, len(list_filter(range(1, n + 1), lambda i: f[length(f) - n + i] <> r[i])) / n AS share
  FROM (SELECT *, unnest(range(10, least(length(f), length(r)) + 1)) AS n FROM mp WHERE r IS NOT NULL)),
mb AS (SELECT sample, read_id, arg_min(n, struct_pack(s := share, m := -n)) AS n FROM mo WHERE share <= 0.25 GROUP BY 1, 2),
mm AS (SELECT mp.*, COALESCE(mb.n, 0) AS n FROM mp LEFT JOIN mb ON mp.sample = mb.sample AND mp.read_id = mb.read_id),
merged AS (SELECT sample, read_id, CAST(n > 0 AS INT) AS merged, CASE WHEN n = 0 THEN f ELSE f[1:length(f) - n] ||
  array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN qb[i] > qa[length(f) - n + i] THEN r[i] ELSE f[length(f) - n + i] END), '') || r[n + 1:] END AS seq FROM mm)"""


@query("q3_merge_pairs", L + TWO_MATES + TRIM + MERGE + " SELECT read_id, merged, seq FROM merged")
def _(t):
    return rd.merge_pairs(prepared(t)).select("read_id", "merged", "seq")


@query("q4_length_filter", L + " SELECT read_id, seq FROM reads WHERE length(seq) BETWEEN 90 AND 110")
def _(t):
    return rd.filter_length(reads(t)).select("read_id", "seq")


@query("q6_dereplicate", L + " SELECT sample, seq, COUNT(*) AS reads, sha256(seq) AS otu FROM reads GROUP BY 1, 2 HAVING COUNT(*) >= 3")
def _(t):
    return rd.dereplicate(reads(t)).select("sample", "seq", "reads", "otu")


@query("q7_otu_table", L + " SELECT sha256(seq) AS otu, sample, COUNT(*) AS reads FROM reads GROUP BY seq, sample")
def _(t):
    return rd.otu_table(rd.dereplicate(reads(t), least=1))


@query("q12_funnel", L + TWO_MATES + TRIM + MERGE + """, p AS (SELECT sample, read_id, COUNT(*) AS mates FROM trimmed GROUP BY 1, 2),
kc AS (SELECT sample, seq, COUNT(*) AS n FROM merged GROUP BY 1, 2),
ta AS (SELECT sample, COUNT(*) AS total FROM both_raw GROUP BY 1),
tb AS (SELECT sample, SUM(CASE WHEN mates = 2 THEN 2 ELSE 0 END)::BIGINT AS trimmed_pe, COUNT(*) FILTER (WHERE mates = 1) AS trimmed_orphans FROM p GROUP BY 1),
tc AS (SELECT sample, COUNT(*) AS merged FROM merged GROUP BY 1),
td AS (SELECT sample, COUNT(*) AS clusters_total, COUNT(*) FILTER (WHERE n >= 3) AS clusters_above, SUM(CASE WHEN n >= 3 THEN n ELSE 0 END)::BIGINT AS queries FROM kc GROUP BY 1)
SELECT sample, total, COALESCE(trimmed_pe, 0) AS trimmed_pe, COALESCE(trimmed_orphans, 0) AS trimmed_orphans, COALESCE(merged, 0) AS merged, clusters_total, clusters_above, queries,
COALESCE(trimmed_pe, 0) + COALESCE(trimmed_orphans, 0) AS trimmed_total FROM ta LEFT JOIN tb USING (sample) LEFT JOIN tc USING (sample) LEFT JOIN td USING (sample)""")
def _(t):
    pairs = stored(prepared(t), "pairs")
    return rd.funnel(mates(t).select("sample"), pairs, rd.merge_pairs(pairs).select("sample", "seq"))


# ---------------------------------------------------------------- assignment
REFS = L + """, q AS (SELECT DISTINCT sha256(seq) AS query, seq FROM reads),
refs AS (SELECT read_id AS ref, seq, [lang, sample, CAST(reads.doc_id AS VARCHAR)] AS lineage FROM reads JOIN {labels} ON labels.doc_id = reads.doc_id WHERE quality = 1)"""
# Distinct sequences are compared once. From 20 bases on a match holds 16 equal bases in a row
# (24 compared positions without mismatch, 33 between two, and so on); below that none may differ,
# so the shorter of the two lies in the other, or an end of one is an end of the other.
HITS = """, rs AS (SELECT DISTINCT seq FROM refs), sides AS (SELECT seq AS fwd, seq FROM rs UNION ALL SELECT seq, reverse(translate(seq, 'acgt', 'tgca')) FROM rs),
rk AS (SELECT fwd, unnest(range(1, length(seq) - 14)) AS rpos, seq FROM sides WHERE length(seq) >= 16),
qk AS (SELECT query, unnest(range(1, length(seq) - 14)) AS qpos, seq FROM q WHERE length(seq) >= 20),
cand AS (SELECT DISTINCT query, fwd, rpos - qpos AS diag, qk.seq AS qs, rk.seq AS rs FROM qk JOIN rk ON qk.seq[qpos:qpos + 15] = rk.seq[rpos:rpos + 15]),
ov AS (SELECT *, greatest(0, -diag) AS st, least(length(qs), length(rs) - diag) - greatest(0, -diag) AS al FROM cand),
ok AS (SELECT query, fwd, len(list_filter(range(1, al + 1), lambda i: qs[st + i] = rs[st + diag + i])) / al AS idn FROM ov WHERE al >= 0.8 * length(qs)),
small AS (SELECT query, seq FROM q WHERE length(seq) < 20),
part AS (SELECT query, seq, unnest(range(CAST(ceil(0.8 * length(seq)) AS BIGINT), length(seq))) AS m FROM small),
tip AS (SELECT DISTINCT fwd, seq, unnest(range(1, least(20, length(seq) + 1))) AS m FROM sides),
close AS (SELECT query, fwd FROM small JOIN sides ON contains(sides.seq, small.seq)
  UNION SELECT query, fwd FROM small JOIN sides ON length(sides.seq) < length(small.seq) AND length(sides.seq) >= 0.8 * length(small.seq) AND contains(small.seq, sides.seq)
  UNION SELECT query, fwd FROM part JOIN tip ON part.m = tip.m AND right(part.seq, part.m) = left(tip.seq, tip.m)
  UNION SELECT query, fwd FROM part JOIN tip ON part.m = tip.m AND left(part.seq, part.m) = right(tip.seq, tip.m)),
best AS (SELECT query, fwd, MAX(idn) AS identity FROM (SELECT * FROM ok WHERE idn >= 0.98 UNION ALL SELECT query, fwd, 1.0 FROM close) GROUP BY 1, 2),
hits AS (SELECT query, ref, identity FROM best JOIN refs ON refs.seq = best.fwd)"""


def line_queries(t: Tables) -> DataFrame:
    return stored(rd.otu_sequences(rd.dereplicate(reads(t), least=1)).select(F.col("otu").alias("query"), "seq"), "queries")


def line_references(t: Tables, quality: int = 1) -> DataFrame:
    """Lines of labelled documents as references, with language, source and document as lineage."""
    known = t.labels.where(F.col("quality") == quality).select("doc_id")
    rows = reads(t).join(known, "doc_id")
    return rows.select(F.col("read_id").alias("ref"), "seq", F.array("lang", "sample", F.col("doc_id").cast("string")).alias("lineage"))


@query("q8_search", REFS + HITS + " SELECT query, ref, ROUND(identity, 9) AS identity FROM hits")
def _(t):
    hits = assign.search(line_queries(t), stored(line_references(t).select("ref", "seq"), "references"))
    return hits.select("query", "ref", F.round("identity", 9).alias("identity"))


@query("q8_shared_words", L + """, b AS (SELECT item_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '""" + ALPHABET + "', '" + BASES + """') AS seq FROM {benchmark}),
q AS (SELECT DISTINCT sha256(seq) AS query, seq FROM reads), qk AS (SELECT DISTINCT query, seq[i:i + 15] AS w FROM (SELECT query, seq, unnest(range(1, length(seq) - 14)) AS i FROM q WHERE length(seq) >= 16)),
rk AS (SELECT DISTINCT item_id, seq[i:i + 15] AS w FROM (SELECT item_id, seq, unnest(range(1, length(seq) - 14)) AS i FROM b WHERE length(seq) >= 16))
SELECT query, item_id AS ref, COUNT(*) AS words FROM qk JOIN rk USING (w) GROUP BY 1, 2""")
def _(t):
    items = t.benchmark.select(F.col("item_id").alias("ref"), F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), ALPHABET, BASES).alias("seq"))
    return assign.shared_words(line_queries(t), items, 16)


@query("q5_chimera_votes", L + """, r AS (SELECT read_id AS ref, seq FROM reads JOIN {labels} ON labels.doc_id = reads.doc_id WHERE quality = 1),
q AS (SELECT DISTINCT sha256(seq) AS query, seq FROM reads),
qk AS (SELECT DISTINCT query, seq[i:i + 15] AS w, CASE WHEN i + 15 <= length(seq) // 2 THEN 'L' WHEN i - 1 >= length(seq) // 2 THEN 'R' END AS side
  FROM (SELECT query, seq, unnest(range(1, length(seq) - 14)) AS i FROM q WHERE length(seq) >= 16)),
rk AS (SELECT DISTINCT ref, seq[i:i + 15] AS w FROM (SELECT ref, seq, unnest(range(1, length(seq) - 14)) AS i FROM r WHERE length(seq) >= 16)),
v AS (SELECT query, ref, COUNT(*) FILTER (WHERE side = 'L') AS l, COUNT(*) FILTER (WHERE side = 'R') AS r FROM qk JOIN rk USING (w) WHERE side IS NOT NULL GROUP BY 1, 2),
b AS (SELECT query, MAX(l) AS l, MAX(r) AS r, MAX(l + r) AS s FROM v GROUP BY 1)
SELECT q.query, CAST(COALESCE(l > 0 AND r > 0 AND l + r - s > 0.2 * (l + r), FALSE) AS INT) AS chimera, l AS "left", r AS "right", s AS single FROM q LEFT JOIN b USING (query)""")
def _(t):
    out = assign.split_chimeras(line_queries(t), line_references(t).select("ref", "seq"))
    return out.select("query", "chimera", "left", "right", "single")


READS_TO_TAXA = L + TWO_MATES + TRIM + MERGE + """, kept AS (SELECT sample, lower(seq) AS seq, COUNT(*) AS n FROM merged WHERE length(seq) BETWEEN 90 AND 110 GROUP BY 1, 2 HAVING COUNT(*) >= 3),
q0 AS (SELECT DISTINCT sha256(seq) AS query, seq FROM kept),
refs AS (SELECT read_id AS ref, seq, lang, sample, CAST(reads.doc_id AS VARCHAR) AS doc FROM reads JOIN {labels} ON labels.doc_id = reads.doc_id WHERE quality = 1),
ck AS (SELECT DISTINCT query, seq[i:i + 15] AS w, CASE WHEN i + 15 <= length(seq) // 2 THEN 'L' WHEN i - 1 >= length(seq) // 2 THEN 'R' END AS side
  FROM (SELECT query, seq, unnest(range(1, length(seq) - 14)) AS i FROM q0)),
cr AS (SELECT DISTINCT ref, seq[i:i + 15] AS w FROM (SELECT ref, seq, unnest(range(1, length(seq) - 14)) AS i FROM refs WHERE length(seq) >= 16)),
cv AS (SELECT query, ref, COUNT(*) FILTER (WHERE side = 'L') AS l, COUNT(*) FILTER (WHERE side = 'R') AS r FROM ck JOIN cr USING (w) WHERE side IS NOT NULL GROUP BY 1, 2),
cb AS (SELECT query, MAX(l) AS l, MAX(r) AS r, MAX(l + r) AS s FROM cv GROUP BY 1),
q AS (SELECT q0.query, q0.seq FROM q0 LEFT JOIN cb USING (query) WHERE NOT COALESCE(l > 0 AND r > 0 AND l + r - s > 0.2 * (l + r), FALSE))""" + HITS + """,
an AS (SELECT query, COUNT(DISTINCT lang) AS a, COUNT(DISTINCT (lang, refs.sample)) AS b, COUNT(DISTINCT (lang, refs.sample, doc)) AS c, ANY_VALUE(lang) AS lang, ANY_VALUE(refs.sample) AS src, ANY_VALUE(doc) AS doc
  FROM hits JOIN refs USING (ref) GROUP BY 1),
named AS (SELECT q.seq, CASE WHEN c = 1 THEN doc WHEN b = 1 THEN src WHEN a = 1 THEN lang ELSE 'unassigned' END AS taxon FROM q LEFT JOIN an USING (query))
SELECT kept.sample, taxon, CAST(SUM(n) AS BIGINT) AS reads FROM kept JOIN named USING (seq) GROUP BY 1, 2"""


@query("pipeline_reads_to_taxa", READS_TO_TAXA)
def _(t):
    """Raw reads to a table of taxa: trim, merge, filter, dereplicate, drop chimeras, search, ancestor, collapse."""
    merged = rd.merge_pairs(prepared(t)).select("sample", F.lower("seq").alias("seq"))
    kept = stored(rd.dereplicate(rd.filter_length(merged)), "clusters")
    refs = stored(line_references(t), "references")
    split = assign.split_chimeras(rd.otu_sequences(kept).withColumnRenamed("otu", "query"), refs.select("ref", "seq"))
    good = stored(split.where("chimera = 0").select("query", "seq"), "good")
    assigned = assign.assign(good, assign.search(good, refs.select("ref", "seq")), refs.select("ref", "lineage"))
    return assign.collapse(rd.otu_table(kept), assigned).select("sample", "taxon", "reads")


ORDER_HITS = """WITH h AS (SELECT l_orderkey AS query, p_type, p_brand, p_name FROM {lineitem} JOIN {part} ON l_partkey = p_partkey),
a AS (SELECT query, COUNT(*) AS hits, COUNT(DISTINCT p_type) AS t, COUNT(DISTINCT (p_type, p_brand)) AS b, COUNT(DISTINCT (p_type, p_brand, p_name)) AS n,
  ANY_VALUE(p_type) AS p_type, ANY_VALUE(p_brand) AS p_brand, ANY_VALUE(p_name) AS p_name FROM h GROUP BY 1),
assigned AS (SELECT o_orderkey AS query, CASE WHEN n = 1 THEN p_name WHEN b = 1 THEN p_brand WHEN t = 1 THEN p_type ELSE 'unassigned' END AS taxon,
  CASE WHEN n = 1 THEN 3 WHEN b = 1 THEN 2 WHEN t = 1 THEN 1 ELSE 0 END AS depth, COALESCE(hits, 0) AS hits FROM {orders} LEFT JOIN a ON o_orderkey = a.query)"""


def order_assignment(t: Tables) -> DataFrame:
    """Orders as queries, the parts of their lines as hits."""
    hits = t.lineitem.select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("ref"))
    lineages = t.part.select(F.col("p_partkey").alias("ref"), F.array("p_type", "p_brand", "p_name").alias("lineage"))
    return assign.assign(t.orders.select(F.col("o_orderkey").alias("query")), hits, lineages)


@query("q9_common_ancestor", ORDER_HITS + " SELECT query, taxon, depth, hits FROM assigned")
def _(t):
    return order_assignment(t)


@query("q10_collapse_to_taxa", ORDER_HITS + """ SELECT taxon, c_name AS sample, COUNT(*) AS reads FROM assigned JOIN {orders} ON query = o_orderkey
JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2""")
def _(t):
    otus = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("otu"), F.col("c_name").alias("sample"), F.lit(1).cast("bigint").alias("reads")
    )
    return assign.collapse(otus, order_assignment(t))


# Comparing every diagonal of repetitive junk lines is too slow in SQL; checked by brute force in the tests.
@query("q11_second_pass")
def _(t):
    sets = []
    for quality in (1, 0):
        refs = stored(line_references(t, quality), "references")
        sets.append((refs.select("ref", "seq"), refs.select("ref", "lineage")))
    return assign.assign_in_two_passes(line_queries(t), *sets)


@query("j6_sequences_of_table", L + """ SELECT sha256(seq) AS query, seq FROM reads GROUP BY seq HAVING COUNT(*) >= 3""")
def _(t):
    table = rd.otu_table(rd.dereplicate(reads(t), least=1)).groupBy(F.col("otu").alias("query")).agg(F.sum("reads").alias("reads"))
    return line_queries(t).join(table.where("reads >= 3").select("query"), "query", "left_semi")


# ---------------------------------------------------------------- files
@query("s1_read_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM {customer}")
def _(t):
    path = new_path(t.spark, "csv")
    segment = F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment")
    tables.write_table(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", segment), path)
    return tables.read_table(t.spark, path, "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, segment STRING")


@query("s2_read_manifest", "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderstatus = 'F'")
def _(t):
    path = new_path(t.spark, "tsv")
    tables.write_table(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, sep="\t")
    rows = tables.read_table(t.spark, path, "o_orderkey BIGINT, o_orderstatus STRING, o_orderpriority STRING", sep="\t")
    return rows.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("s3_read_count_table", """SELECT CASE n_nationkey WHEN 0 THEN NULL WHEN 1 THEN 'OTU' ELSE n_name || ', state' END AS taxon, s.sample, (SELECT COUNT(*) FROM {customer} WHERE c_nationkey = n_nationkey AND c_mktsegment = s.sample) AS reads, 'root;' || n_regionkey AS lineage
FROM {nation} CROSS JOIN (SELECT DISTINCT c_mktsegment AS sample FROM {customer}) s""")
def _(t):
    path = new_path(t.spark, "counts")
    per = t.nation.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    wide = per.groupBy("n_name", "n_nationkey", "n_regionkey").pivot("c_mktsegment", SEGMENTS).agg(F.count("c_custkey")).fillna(0)
    name = F.when(F.col("n_nationkey") == 0, "").when(F.col("n_nationkey") == 1, "OTU").otherwise(F.concat(F.lit('"'), "n_name", F.lit(', state"')))
    body = wide.select(F.concat_ws(",", name, *SEGMENTS, F.concat(F.lit("root;"), "n_regionkey")).alias("value"))
    header = "OTU," + ",".join(f"{s}-nc.blast" for s in SEGMENTS) + ",taxomomy"
    top = small_table(t.spark, "value string, place int", [["# exported,,,,,,", 0], [header, 1]])
    whole = top.unionByName(body.withColumn("place", F.lit(2)))
    whole.repartition(1).sortWithinPartitions("place").select("value").write.text(path)
    return tables.read_count_table(t.spark, path).select("taxon", "sample", "reads", "lineage")


@query("s4_write_table", f"{COUNTS} SELECT sample, taxon, reads FROM counts")
def _(t):
    path = new_path(t.spark, "csv")
    tables.write_table(counted(t), path)
    return tables.read_table(t.spark, path, "sample STRING, taxon STRING, reads BIGINT")


GENBANK = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '" + ALPHABET + "', '" + BASES + "')"


@query("s5_read_genbank", f"""SELECT 'AB' || doc_id AS accession, 'AB' || doc_id || '.1' AS version, CAST(length({GENBANK}) AS INT) AS length, lang || ' ' || source AS organism, doc_id AS taxon_id,
'Text;' || lang || ';' || source AS lineage, lang || ' ' || source AS feature_organism, {GENBANK} AS seq FROM {{documents}}""")
def _(t):
    path = new_path(t.spark, "genbank")
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), ALPHABET, BASES)
    record = genbank.genbank_record(
        F.concat(F.lit("AB"), "doc_id"), F.concat_ws(" ", "lang", "source"), F.col("doc_id"), F.array(F.lit("Text"), F.col("lang"), F.col("source")), seq
    )
    t.documents.select(record.alias("value")).write.text(path)
    refs = genbank.read_genbank(t.spark, path)
    return refs.select(
        "accession", "version", "length", "organism", "taxon_id", F.array_join("lineage", ";").alias("lineage"),
        F.col("features")[0]["qualifiers"]["organism"].alias("feature_organism"), "seq",
    )


@query("s5_references_as_fasta", f"""SELECT 'AB' || doc_id || '|' || doc_id || '|' || lang || '_' || source AS id, {GENBANK} AS seq FROM {{documents}} WHERE {GENBANK} <> ''""")
def _(t):
    path = new_path(t.spark, "references")
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), ALPHABET, BASES)
    refs = t.documents.select(F.concat(F.lit("AB"), "doc_id").alias("accession"), F.col("doc_id").alias("taxon_id"), F.concat_ws(" ", "lang", "source").alias("organism"), seq.alias("seq"))
    fasta.write_fasta(genbank.to_fasta(refs.where("seq <> ''")), path)
    return fasta.read_fasta(t.spark, path).select("id", "seq")


@query("s6_fasta", L + " SELECT CAST(read_id AS VARCHAR) AS id, seq FROM reads")
def _(t):
    path = new_path(t.spark, "fasta")
    fasta.write_fasta(reads(t).select(F.col("read_id").cast("string").alias("id"), "seq"), path)
    return fasta.read_fasta(t.spark, path).select("id", "seq")


@query("s7_fastq", L + " SELECT CAST(read_id AS VARCHAR) AS read_id, seq, array_to_string(qual, ',') AS qual FROM reads")
def _(t):
    path = new_path(t.spark, "fastq")
    fasta.write_fastq(reads(t), path)
    found = fasta.read_fastq(t.spark, path)
    return found.select("read_id", "seq", F.array_join(F.col("qual").cast("array<string>"), ",").alias("qual"))


@query("s8_biom", f"{RAWC} SELECT taxon AS otu, sample, reads, CASE WHEN taxon = 'unassigned' THEN NULL ELSE 'root;' || taxon END AS taxonomy FROM counts")
def _(t):
    path = new_path(t.spark, "biom")
    taxonomy = F.when(F.col("taxon") != "unassigned", F.array(F.lit("root"), F.col("taxon")))
    biom.write_biom(stored(raw(t).select(F.col("taxon").alias("otu"), "sample", "reads", taxonomy.alias("taxonomy")), "cells"), path)
    return biom.read_biom(t.spark, path).select("otu", "sample", "reads", F.array_join("taxonomy", ";").alias("taxonomy"))


@query("s9_wide_text_table", """SELECT n_name || ', state' AS "Assignment", """ + ", ".join(f"COUNT(c_custkey) FILTER (WHERE c_mktsegment = '{s}') AS \"{s}\"" for s in SEGMENTS)
       + """, 'root;' || n_regionkey AS taxonomy FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey GROUP BY n_name, n_regionkey""")
def _(t):
    path = new_path(t.spark, "tsv")
    per = t.nation.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey"))
    lineage = F.array(F.lit("root"), F.col("n_regionkey").cast("string")).alias("taxonomy")
    rows = per.select(F.concat("n_name", F.lit(", state")).alias("otu"), F.col("c_mktsegment").alias("sample"), F.lit(1).cast("bigint").alias("reads"), lineage)
    biom.write_tsv(rows, path, SEGMENTS)
    return tables.read_table(t.spark, path, "Assignment STRING, " + ", ".join(f"{s} BIGINT" for s in SEGMENTS) + ", taxonomy STRING", sep="\t")


PATHS = """SELECT 'raw_reads/' || c_name || '-12S_R' || m || '.fastq.gz' AS path, c_custkey, m FROM {customer} CROSS JOIN (SELECT unnest([1, 2]) AS m)
WHERE NOT (c_custkey % 9 = 4 AND m = 2)"""


@query("s10_manifest", f"""WITH p AS ({PATHS}) SELECT replace(replace(split_part(path, '/', 2), '_R1.fastq.gz', ''), '_R2.fastq.gz', '') AS sample, 'fastq' AS format,
MAX(path) FILTER (WHERE m = 1) AS file1, MAX(path) FILTER (WHERE m = 2) AS file2, 18 AS clip_fwd, 18 AS clip_rev FROM p GROUP BY 1""")
def _(t):
    mate = F.explode(F.when(F.col("c_custkey") % 9 == 4, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))))
    files = t.customer.select("c_name", mate.alias("m")).select(F.concat(F.lit("raw_reads/"), "c_name", F.lit("-12S_R"), "m", F.lit(".fastq.gz")).alias("path"))
    return manifest.paired_manifest(files)


@query("s10_sequence_manifest", """SELECT c_name || '-nc' AS sample, 'fasta' AS format, 'out/' || c_name || '/' || c_name || '-nonchimeras.fasta' AS file1 FROM {customer} WHERE c_custkey % 10 <> 3""")
def _(t):
    name = F.when(F.col("c_custkey") % 10 == 3, "GLOBAL").otherwise(F.col("c_name"))
    files = t.customer.select(F.explode(F.array(*[F.concat(F.lit("out/"), name, F.lit("/"), name, F.lit(end)) for end in ("-nonchimeras.fasta", ".log")])).alias("path"))
    return manifest.sequence_manifest(files)


@query("s10_archive_files", """SELECT o_orderkey::VARCHAR AS "SampleID", o_orderstatus AS "SRA_accession", o_orderkey || '-5-LOW_' || m || '.fastq.gz' AS file
FROM {orders} CROSS JOIN (SELECT unnest([1, 2]) AS m) WHERE o_orderpriority = '5-LOW'""")
def _(t):
    acc = t.orders.select(F.col("o_orderkey").cast("string").alias("SampleID"), F.col("o_orderpriority").alias("marker"), F.col("o_orderstatus").alias("SRA_accession"))
    return manifest.archive_files(acc, "5-LOW")
