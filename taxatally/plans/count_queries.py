"""Queries over count tables: import, correction, thresholds, reshaping, joins, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxatally import fixed_values as fv
from taxatally.functions import ids
from taxatally.functions.numeric import label, presence, ratio, to_count, zero_filled
from taxatally.operators import compare, counts as ct, describe, glm, reshape, thresholds as th
from taxatally.plans.cleaning import compare_threshold_options, taxa_surviving_thresholds
from taxatally.plans.registry import Tables, query
from taxatally.plans.views import IDS, LINES, RAW, SURVEYS, raw_lines, study_ids
from taxatally.session import small_table, stored

NEG, POS = "(07|57)$", "(13|63)$"
CONTROL = "blue anvil"
RENAMED = [
    ("hot anvil", "blue anvil"),
    ("cold ring", "blue ring"),
    ("hot ring", "blue ring"),
    ("red rod", "blue rod"),
]


def values(rows) -> str:
    """SQL text of a VALUES list."""
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


def counted(t: Tables) -> DataFrame:
    return ct.merge_assignments(t.sql(LINES))


def raw(t: Tables) -> DataFrame:
    """Merged raw table with study ids and spaced names."""
    return ct.merge_assignments(raw_lines(t).withColumn("taxon", ids.spaced("taxon")))


COUNTS = f"WITH counts AS (SELECT sample, taxon, CAST(SUM(reads) AS BIGINT) AS reads FROM ({LINES}) GROUP BY 1, 2)"
RAWC = (
    "WITH counts AS (SELECT sample, replace(taxon, '_', ' ') AS taxon, CAST(SUM(reads) AS BIGINT) AS reads "
    f"FROM ({RAW}) GROUP BY 1, 2)"
)
FREQ = (
    COUNTS
    + """, freq AS (SELECT sample, taxon, reads, CAST(reads AS DOUBLE) / SUM(reads) OVER (PARTITION BY sample) AS freq,
    CASE WHEN regexp_matches(sample, '(07|57)$') THEN 'negative'
         WHEN regexp_matches(sample, '(13|63)$') THEN 'positive' ELSE 'biological' END AS role FROM counts),
  bio AS (SELECT * FROM freq WHERE role = 'biological'), pos AS (SELECT * FROM freq WHERE role = 'positive')"""
)


def shares(t: Tables) -> DataFrame:
    """Frequencies with the role of each sample, computed once and read by both branches."""
    return stored(ct.proportions(counted(t)).withColumn("role", ids.sample_role("sample", NEG, POS)), "freq")


def biological(freq: DataFrame) -> DataFrame:
    return freq.where("role = 'biological'")


def positive(freq: DataFrame) -> DataFrame:
    return freq.where("role = 'positive'")


# ---------------------------------------------------------------- scalar work
@query("p1_clean_names", """
SELECT DISTINCT c_name || '-nc.blast' AS raw_name, c_name AS sample, replace(c_mktsegment, 'U', ' ') AS segment FROM {customer}""")
def _(t):
    df = t.customer.select(F.concat("c_name", F.lit("-nc.blast")).alias("raw_name"), F.translate("c_mktsegment", "U", "_").alias("s"))
    return df.select("raw_name", ids.strip_suffix("raw_name", "-nc.blast").alias("sample"), ids.spaced("s").alias("segment")).distinct()


@query("p2_sample_roles", f"""
SELECT sample, CASE WHEN regexp_matches(sample, 'CB|FB|EB|Negative') THEN 'negative'
  WHEN sample LIKE '%Positive%' THEN 'positive' ELSE 'biological' END AS role, COUNT(*) AS n FROM ({IDS}) GROUP BY 1, 2""")
def _(t):
    return study_ids(t).withColumn("role", ids.sample_role("sample")).groupBy("sample", "role").agg(F.count("*").alias("n"))


@query("p3_control_types", f"""
SELECT sample, CASE WHEN contains(sample, 'CB') THEN 'Field' WHEN contains(sample, 'FB') THEN 'Filtration'
  WHEN contains(sample, 'EB') THEN 'Extraction' WHEN contains(sample, 'Negative') THEN 'PCR' ELSE 'Other' END AS control_type,
  COUNT(*) AS n FROM ({IDS}) GROUP BY 1, 2""")
def _(t):
    return study_ids(t).withColumn("control_type", ids.control_type("sample")).groupBy("sample", "control_type").agg(F.count("*").alias("n"))


@query("p4_vertebrate_filter", """
SELECT p_type, p_brand, p_name, COUNT(*) AS n FROM {part} WHERE p_type IN ('PROMO', 'SMALL') OR contains(p_brand, 'Brand#1')
GROUP BY 1, 2, 3""")
def _(t):
    df = t.part.withColumn("lineage", F.array("p_type", "p_brand", "p_name"))
    return ct.keep_lineage(df, "lineage", "PROMO|SMALL|Brand#1").groupBy("p_type", "p_brand", "p_name").agg(F.count("*").alias("n"))


@query("p5_exclude_spurious", f"""{RAWC} SELECT * FROM counts WHERE taxon NOT IN
('Pinicola enucleator', 'Schoeniclus rusticus', 'Atherina boyeri', 'Bos mutus', 'Chordata environmental sample', 'Pan', 'Sardina pilchardus')""")
def _(t):
    return ct.exclude_spurious(raw(t))


@query("p6_species_level", f"""{RAWC} SELECT * FROM counts WHERE contains(taxon, ' ') OR contains(taxon, 'Anas')
OR contains(taxon, 'Emberiza') OR contains(taxon, 'Larus')""")
def _(t):
    return ct.species_level(raw(t))


@query("p7_exclude_listed", f"""{RAWC} SELECT * FROM counts WHERE taxon NOT IN ('Homo sapiens', 'Maylandia zebra', 'Cyprinidae')""")
def _(t):
    listed = small_table(t.spark, "taxon string", [["Homo sapiens"], ["Maylandia zebra"], ["Cyprinidae"]])
    return ct.exclude(raw(t), listed, "taxon")


@query("p8_experiment_subsets", f"""
SELECT CASE WHEN contains(sample, 'HWP') OR contains(sample, 'WWT') THEN 'captive' ELSE 'wild' END AS experiment,
  CASE WHEN contains(sample, 'THL') THEN 1 ELSE 0 END AS time_course, COUNT(DISTINCT sample) AS samples FROM ({IDS})
WHERE NOT regexp_matches(sample, 'CB|FB|EB|Negative|Positive') GROUP BY 1, 2""")
def _(t):
    df = study_ids(t).where(ids.sample_role("sample") == "biological")
    return df.groupBy(ids.experiment("sample").alias("experiment"), ids.is_time_course("sample").cast("int").alias("time_course")).agg(
        F.count_distinct("sample").alias("samples")
    )


@query("p9_target_species", f"""{RAWC} SELECT * FROM counts WHERE regexp_matches(taxon,
'Lutra|Arvicola|Castor|Lynx|Erinaceus|Meles|Cervus|Sciurus vulgaris|Martes')""")
def _(t):
    return ct.matching(raw(t), "taxon", fv.TARGET_PATTERN)


PARTS = """, parts AS (SELECT *, string_split_regex(regexp_replace(regexp_replace(regexp_replace(
    replace(sample, 'POOL', 'T01'), 'HWP|WWT', '', 'g'), '-D0?[1-3]', '', 'g'), '-Round0[1-4]-', '', 'g'), '[^A-Za-z0-9]+') AS tok
  FROM counts WHERE contains(sample, 'HWP') OR contains(sample, 'WWT')),
tidy AS (SELECT sample, replace(sample, 'POOL', 'T01') AS id, taxon AS species, reads, replace(tok[1], 'ZOO', 'BEAV') AS enclosure,
  replace(replace(replace(regexp_replace(regexp_replace(tok[2], 'P0([1-6])', 'STR0\\1'), 'T0([1-6])', 'DIR0\\1'),
    '1IND', 'QUAR1'), '4IND', 'QUAR2'), 'BEAV', 'ZOO') AS sample_no FROM parts),
housed(enclosure, housed_species) AS (VALUES ('OTT', 'Lutra lutra'), ('WV', 'Arvicola amphibius'), ('BEAV', 'Castor fiber'),
  ('BAD', 'Meles meles'), ('DEER', 'Cervus elaphus'), ('HH', 'Erinaceus europaeus'), ('LYNX', 'Lynx lynx'),
  ('PM', 'Martes martes'), ('SQ', 'Sciurus vulgaris'))"""


def captive(t: Tables) -> DataFrame:
    from taxatally.plans.captive import parse_captive

    return parse_captive(ct.matching(raw(t), "sample", fv.CAPTIVE_PATTERN))


@query("p10_mask_non_target", f"""{RAWC}{PARTS} SELECT t.sample, t.species, t.enclosure,
CASE WHEN t.sample = 'HWP-Round01-SQ-BATH' OR h.housed_species = t.species THEN t.reads ELSE 0 END AS reads
FROM tidy t LEFT JOIN housed h ON t.enclosure = h.enclosure""")
def _(t):
    from taxatally.plans.captive import mask_non_target

    return mask_non_target(captive(t), "reads").select("sample", "species", "enclosure", "reads")


@query("p11_target_rows", f"""{RAWC}{PARTS} SELECT t.sample, t.species, t.enclosure, t.reads FROM tidy t JOIN housed h
ON t.enclosure = h.enclosure AND t.species = h.housed_species
UNION ALL SELECT sample, species, 'BAD', reads FROM tidy WHERE sample = 'HWP-Round01-SQ-BATH' AND species = 'Meles meles'""")
def _(t):
    from taxatally.plans.captive import target_rows

    return target_rows(captive(t)).select("sample", "species", "enclosure", "reads")


@query("p12_sample_types", f"""SELECT sample, CASE WHEN contains(sample, 'P0') THEN 'Stratified'
WHEN contains(replace(sample, 'POOL', 'T01'), 'T0') THEN 'Directed' ELSE 'Other' END AS sample_type, COUNT(*) AS n
FROM ({IDS}) WHERE regexp_matches(sample, 'HWP|WWT') GROUP BY 1, 2""")
def _(t):
    df = ct.matching(study_ids(t), "sample", fv.CAPTIVE_PATTERN)
    kind = ids.first_match(ids.captive_id("sample"), fv.SAMPLE_TYPES, "Other")
    return df.groupBy("sample", kind.alias("sample_type")).agg(F.count("*").alias("n"))


@query("p13_traits", f"""{RAWC} SELECT sample, taxon, reads,
CASE WHEN taxon IN ('Arvicola amphibius', 'Castor fiber', 'Neomys fodiens', 'Rattus norvegicus', 'Lutra lutra', 'Neovison vison') THEN 'Semi-aquatic'
  WHEN taxon IN ('Pipistrellus pipistrellus', 'Sciurus carolinensis', 'Sciurus vulgaris') THEN 'Arboreal' ELSE 'Ground-dwelling' END AS lifestyle,
CASE WHEN taxon IN ('Anas', 'Strix aluco', 'Larus') THEN 'Bird' WHEN taxon IN ('Salmo trutta', 'Anguilla anguilla') THEN 'Fish'
  WHEN taxon IN ('Rana temporaria', 'Bufo bufo') THEN 'Amphibian' ELSE 'Mammal' END AS vertebrate_group FROM counts""")
def _(t):
    return raw(t).select(
        "sample", "taxon", "reads", ids.species_lifestyle("taxon").alias("lifestyle"), ids.vertebrate_group("taxon").alias("vertebrate_group")
    )


@query("p14_captive_ids", f"""{RAWC}{PARTS} SELECT sample, id, enclosure, sample_no,
CASE WHEN enclosure IN ('OTT', 'WV', 'BEAV') THEN 'Semi-aquatic' WHEN enclosure IN ('BAD', 'DEER', 'HH', 'LYNX') THEN 'Ground-dwelling'
  WHEN enclosure IN ('PM', 'SQ') THEN 'Arboreal' ELSE 'Other' END AS lifestyle, CAST(SUM(reads) AS BIGINT) AS reads
FROM tidy GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    return captive(t).groupBy("sample", "id", "enclosure", "sample_no", "lifestyle").agg(F.sum("reads").alias("reads"))


WILD = """, wild AS (SELECT sample, taxon, reads, CASE WHEN contains(sample, 'BAM') THEN 'Bamff Estate'
    WHEN contains(sample, 'TM') THEN 'Thorne Moors' ELSE 'Tophill Low Nature Reserve' END AS site,
  CASE WHEN contains(sample, '01-') AND NOT regexp_matches(sample, '(BAM|TM|THL)02') THEN 'Pond 1' ELSE 'Pond 2' END AS pond,
  right(sample, 2) AS replicate FROM counts WHERE regexp_matches(sample, '^(D0[1-5]-THL0[12]-|BAM0[12]-|TM0[12]-)'))"""


def wild(t: Tables) -> DataFrame:
    df = raw(t).where((ids.experiment("sample") == "wild") & (ids.sample_role("sample") == "biological"))
    return df.select("*", ids.wild_parts("sample").alias("parts")).select("sample", "taxon", "reads", "parts.*")


@query("p15_wild_ids", f"{RAWC}{WILD} SELECT * FROM wild")
def _(t):
    return wild(t)


@query("pipeline_site_occupancy", f"""{RAWC}{WILD}, shares AS (SELECT *, reads / SUM(reads) OVER (PARTITION BY sample) AS freq FROM wild),
means AS (SELECT taxon AS species, site, pond, replicate, AVG(freq) AS freq FROM shares WHERE freq > 0 AND taxon IN ('Arvicola amphibius', 'Neomys fodiens', 'Rattus norvegicus',
  'Castor fiber', 'Sorex araneus', 'Myodes glareolus', 'Oryctolagus cuniculus', 'Capreolus capreolus', 'Cervus elaphus', 'Canis lupus familiaris', 'Sus scrofa domesticus',
  'Ovis aries', 'Bos taurus', 'Pipistrellus pipistrellus', 'Sciurus carolinensis') GROUP BY ALL),
ponds AS (SELECT site, pond, species, CAST(MAX(freq) > 0 AS INT) AS occupancy FROM means GROUP BY ALL),
occupied AS (SELECT * FROM ponds UNION ALL SELECT site, 'Site', species, MAX(occupancy) FROM ponds GROUP BY ALL)
SELECT *, CASE WHEN species IN ('Arvicola amphibius', 'Neomys fodiens', 'Rattus norvegicus', 'Castor fiber', 'Lutra lutra', 'Neovison vison') THEN 'Semi-aquatic'
  WHEN species IN ('Pipistrellus pipistrellus', 'Sciurus carolinensis', 'Sciurus vulgaris') THEN 'Arboreal' ELSE 'Ground-dwelling' END AS lifestyle FROM occupied""")
def _(t):
    """Raw counts to the mammals present at ponds and sites."""
    from taxatally.plans.wild import occupancy

    rows = raw(t).where((ids.experiment("sample") == "wild") & (ids.sample_role("sample") == "biological"))
    return occupancy(ct.proportions(rows))


@query("p16_time_course_ids", f"""{RAWC} SELECT sample, sample[1:3] AS day, sample[5:9] AS pond, sample[11:12] AS replicate,
CAST(SUM(reads) AS BIGINT) AS reads FROM counts WHERE regexp_matches(sample, '^D0[1-5]-THL') GROUP BY ALL""")
def _(t):
    df = raw(t).where(ids.is_time_course("sample") & (ids.sample_role("sample") == "biological"))
    parts = df.select("sample", "reads", ids.time_course_parts("sample").alias("p")).select("sample", "p.*", "reads")
    return parts.groupBy("sample", "day", "pond", "replicate").agg(F.sum("reads").alias("reads"))


BEHAVIOURS = ["Drinking", "Swimming", "Immersed", "Sniffing", "Urinating", "None", "Defecating", "Feeding", "Walking",
              "Standing", "Resting", "Grooming", "Gnawing", "Running", "Scratching", "Vocalising"]
BEHAVIOUR_SQL = "CASE event_id % 16 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BEHAVIOURS)) + " END"


@query("p17_behaviour_types", f"""SELECT behaviour, CASE WHEN behaviour IN ('Drinking', 'Swimming', 'Immersed', 'Sniffing', 'Urinating')
THEN 'Water contact' WHEN behaviour IN ('Gnawing', 'Running', 'Scratching', 'Vocalising') THEN 'NA' ELSE 'No water contact' END AS behaviour_type,
COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM (SELECT {BEHAVIOUR_SQL} AS behaviour, value FROM {{events}}) GROUP BY 1, 2""")
def _(t):
    df = t.sql(f"SELECT {BEHAVIOUR_SQL} AS behaviour, value FROM {{events}}")
    return df.groupBy("behaviour", ids.behaviour_type("behaviour").alias("behaviour_type")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query("p18_text_counts", """SELECT event_id, text_value, CAST(ROUND(TRY_CAST(text_value AS DOUBLE)) AS BIGINT) AS reads
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' ELSE props[7:length(props) - 1] END AS text_value FROM {events})""")
def _(t):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.expr("substring(props, 7, length(props) - 7)"))
    return t.events.select("event_id", text.alias("text_value")).select("event_id", "text_value", to_count("text_value").alias("reads"))


@query("p19_zero_fill", """SELECT user_id, ROUND(COALESCE(SUM(value) FILTER (WHERE event_type = 'click') /
NULLIF(COUNT(*) FILTER (WHERE event_type = 'error'), 0), 0), 6) AS per_error,
ROUND(COALESCE(SUM(value) FILTER (WHERE value > 450), 0), 6) AS high FROM {events} GROUP BY 1""")
def _(t):
    return t.events.groupBy("user_id").agg(
        F.round(ratio(F.sum(F.when(F.col("event_type") == "click", F.col("value"))), F.count_if(F.col("event_type") == "error")), 6).alias("per_error"),
        F.round(zero_filled(F.sum(F.when(F.col("value") > 450, F.col("value")))), 6).alias("high"),
    )


@query("p20_detections_only", f"{COUNTS} SELECT sample, taxon, reads - 25 AS surplus FROM counts WHERE reads > 25")
def _(t):
    from taxatally.functions.numeric import detections

    return detections(counted(t).select("sample", "taxon", (F.col("reads") - 25).alias("surplus")), "surplus")


@query("p21_presence", f"{COUNTS} SELECT sample, taxon, CAST(reads > 25 AS INT) AS present FROM counts")
def _(t):
    return counted(t).select("sample", "taxon", presence(F.col("reads") - 25).alias("present"))


@query("p22_labels", f"""{FREQ} SELECT sample, taxon, CAST(ROUND(CAST(CAST(freq AS VARCHAR) AS DECIMAL(30, 20)), 4) AS DOUBLE) AS label4,
CAST(ROUND(CAST(CAST(freq AS VARCHAR) AS DECIMAL(30, 20)), 3) AS DOUBLE) AS label3 FROM freq""")
def _(t):
    f = ct.proportions(counted(t))
    return f.select("sample", "taxon", label("freq", 4).alias("label4"), label("freq", 3).alias("label3"))


@query("p23_ordered_levels", """SELECT event_type, level, reverse_level, COUNT(*) AS n FROM {events} JOIN
(VALUES ('view', 1, 4), ('click', 2, 3), ('purchase', 3, 2), ('refund', 4, 1)) v(name, level, reverse_level) ON event_type = name GROUP BY 1, 2, 3""")
def _(t):
    levels = ["view", "click", "purchase", "refund"]
    df = reshape.with_level(t.events, "event_type", levels)
    df = reshape.with_level(df, "event_type", levels, "reverse_level", reverse=True)
    return df.groupBy("event_type", "level", "reverse_level").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- reshape
NAMES64 = [f"{a} {n}" for a in ["blue", "cold", "hot", "large", "new", "old", "red", "small"]
           for n in ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]]


@query("r1_melt_wide", """SELECT n_name, c_mktsegment AS segment, COUNT(c_custkey) AS customers FROM {nation}
JOIN {customer} ON n_nationkey = c_nationkey GROUP BY 1, 2
UNION ALL SELECT n_name, segment, 0 FROM {nation} CROSS JOIN (SELECT DISTINCT c_mktsegment AS segment FROM {customer}) s
WHERE NOT EXISTS (SELECT 1 FROM {customer} WHERE c_nationkey = n_nationkey AND c_mktsegment = segment)
AND EXISTS (SELECT 1 FROM {customer} WHERE c_nationkey = n_nationkey)""")
def _(t):
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    per = t.nation.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey")).withColumn("one", F.lit(1))
    return reshape.melt(reshape.spread(per, "n_name", "c_mktsegment", segments, "one"), ["n_name"], "segment", "customers")


@query("r2_sample_by_taxon", COUNTS + " SELECT sample, " + ", ".join(
    f"CAST(COALESCE(SUM(reads) FILTER (WHERE taxon = '{n}'), 0) AS BIGINT) AS \"{n}\"" for n in NAMES64) + " FROM counts GROUP BY 1")
def _(t):
    return reshape.spread(t.sql(LINES), "sample", "taxon", NAMES64)


@query("r3_ordered_report", """SELECT n_name, level, ROUND(COALESCE(SUM(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) AS "F",
ROUND(COALESCE(SUM(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0), 2) AS "O", ROUND(COALESCE(SUM(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0), 2) AS "P"
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
JOIN (VALUES ('1-URGENT', 3), ('2-HIGH', 2), ('3-MEDIUM', 1)) v(name, level) ON o_orderpriority = name GROUP BY 1, 2""")
def _(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    df = reshape.with_level(df, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], reverse=True)
    wide = reshape.spread(df, ["n_name", "level"], "o_orderstatus", ["F", "O", "P"], "o_totalprice")
    return wide.select("n_name", "level", *[F.round(c, 2).alias(c) for c in "FOP"])


@query("r4_prediction_grid", """SELECT flag, kind, ROUND(low + (high - low) * i / 499, 6) AS quantity
FROM (SELECT DISTINCT l_returnflag AS flag FROM {lineitem}) CROSS JOIN (SELECT DISTINCT p_type AS kind FROM {part})
CROSS JOIN (SELECT MIN(l_quantity) AS low, MAX(l_quantity) AS high FROM {lineitem}) CROSS JOIN (SELECT unnest(range(500)) AS i)""")
def _(t):
    ends = t.lineitem.agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    levels = {name: list(glm.factor(df.select(F.col(c).alias(name)), name).levels) for name, df, c in (("flag", t.lineitem, "l_returnflag"), ("kind", t.part, "p_type"))}
    grid = reshape.prediction_grid(t.spark, levels, {"quantity": (ends.select("low").scalar(), ends.select("high").scalar())})
    return grid.withColumn("quantity", F.round("quantity", 6))


# ---------------------------------------------------------------- joins
@query("j1_sample_metadata", f"""{COUNTS} SELECT sample, taxon, reads, c_mktsegment AS location, c_nationkey AS volume
FROM counts JOIN {{customer}} ON sample = c_name WHERE c_acctbal > 0""")
def _(t):
    from taxatally.plans.captive import join_metadata

    meta = t.customer.where("c_acctbal > 0").select(F.col("c_name").alias("sample"), F.col("c_mktsegment").alias("location"), F.col("c_nationkey").alias("volume"))
    return join_metadata(counted(t), meta)


@query("j2_behaviour_join", f"""{RAWC}{PARTS}, log AS (SELECT i.sample, {BEHAVIOUR_SQL} AS behaviour, event_id FROM {{events}} JOIN ({IDS}) i
  ON user_id = c_custkey WHERE regexp_matches(i.sample, 'HWP|WWT')),
placed AS (SELECT *, CASE WHEN contains(sample, 'HWP') THEN 'HWP' ELSE 'WWT' END AS location FROM tidy),
targets AS (SELECT t.id, t.location, t.enclosure, t.sample_no, t.species, t.reads FROM placed t JOIN housed h ON t.enclosure = h.enclosure AND t.species = h.housed_species
  UNION ALL SELECT id, location, 'BAD', sample_no, species, reads FROM placed WHERE sample = 'HWP-Round01-SQ-BATH' AND species = 'Meles meles'),
log_ids AS (SELECT DISTINCT sample, id, location, enclosure, sample_no FROM placed)
SELECT r.id, r.location, r.enclosure, r.sample_no, r.species, r.reads, l.behaviour, l.event_id FROM targets r JOIN log_ids p ON r.id = p.id AND r.location = p.location
AND r.enclosure = p.enclosure AND r.sample_no = p.sample_no JOIN log l ON l.sample = p.sample""")
def _(t):
    from taxatally.plans.captive import join_behaviour, parse_captive, target_rows

    log = t.sql(f"SELECT sample, {BEHAVIOUR_SQL} AS behaviour, event_id FROM {{events}} JOIN {{ids}} ON user_id = c_custkey", ids=study_ids(t))
    log = parse_captive(ct.matching(log, "sample", fv.CAPTIVE_PATTERN))
    keys = ["id", "location", "enclosure", "sample_no"]
    return join_behaviour(target_rows(captive(t)).select(*keys, "species", "reads"), log.select(*keys, "behaviour", "event_id"))


@query("j3_totals_join", f"""{COUNTS} SELECT sample, taxon, reads, total, ROUND(CAST(reads AS DOUBLE) / total, 9) AS freq FROM counts
JOIN (SELECT sample, CAST(SUM(reads) AS BIGINT) AS total FROM ({LINES}) GROUP BY 1) USING (sample)""")
def _(t):
    return ct.proportions(counted(t), ct.sample_totals(t.sql(LINES))).withColumn("freq", F.round("freq", 9))


@query("j4_correct_names", f"""{RAWC}, s(taxon, accepted) AS (VALUES {values(fv.SYNONYMS)})
SELECT sample, COALESCE(accepted, counts.taxon) AS taxon, CAST(SUM(reads) AS BIGINT) AS reads FROM counts LEFT JOIN s ON counts.taxon = s.taxon GROUP BY 1, 2""")
def _(t):
    return ct.correct_names(raw_lines(t).withColumn("taxon", ids.spaced("taxon")))


@query("j5_join_by_key", f"""{COUNTS} SELECT sample, counts.taxon, reads, size FROM counts JOIN
(SELECT p_name AS taxon, SUM(CAST(p_size AS BIGINT))::BIGINT AS size FROM {{part}} GROUP BY 1) p ON p.taxon = counts.taxon""")
def _(t):
    sizes = t.part.groupBy(F.col("p_name").alias("taxon")).agg(F.sum(F.col("p_size").cast("bigint")).alias("size"))
    return counted(t).join(sizes, "taxon").select("sample", "taxon", "reads", "size")


@query("j7_not_expected", f"""SELECT site, pond, species, method, present, COUNT(*) AS n FROM ({SURVEYS}) WHERE (site, species) NOT IN
(SELECT * FROM (VALUES {values(fv.NOT_EXPECTED)})) AND NOT (site = 'Thorne Moors' AND species = 'Arvicola amphibius' AND pond = 'Pond 1') GROUP BY ALL""")
def _(t):
    df = t.sql(SURVEYS).groupBy("site", "pond", "species", "method", "present").agg(F.count("*").alias("n"))
    return compare.drop_not_expected(df)


@query("j9_unresolved_ids", """SELECT p_brand AS accession, CAST(NULL AS BIGINT) AS taxon_id, 'missing' AS status, 1 AS n FROM {part} p WHERE NOT EXISTS
(SELECT 1 FROM {supplier} WHERE 'Brand#' || s_suppkey = p_brand AND s_acctbal > 2000) GROUP BY 1
UNION ALL SELECT p_brand, s_suppkey, 'resolved', COUNT(*) FROM {part} JOIN {supplier} ON 'Brand#' || s_suppkey = p_brand WHERE s_acctbal > 2000 GROUP BY 1, 2""")
def _(t):
    records = t.part.select(F.col("p_brand").alias("accession"))
    lookup = t.supplier.where("s_acctbal > 2000").select(F.concat(F.lit("Brand#"), F.col("s_suppkey")).alias("accession"), F.col("s_suppkey").alias("taxon_id"))
    resolved, missing = ct.resolve_ids(records, lookup, "accession")
    found = resolved.groupBy("accession", "taxon_id").agg(F.count("*").alias("n")).withColumn("status", F.lit("resolved"))
    lost = missing.select("accession", F.lit(None).cast("bigint").alias("taxon_id"), F.lit(1).cast("bigint").alias("n"), F.lit("missing").alias("status"))
    return ct.bind_rows(found, lost).select("accession", "taxon_id", "status", "n")


# ---------------------------------------------------------------- sets
@query("u1_bind_rows", """SELECT c_name AS name, c_acctbal AS balance FROM {customer} UNION ALL SELECT s_name, s_acctbal FROM {supplier}""")
def _(t):
    return ct.bind_rows(
        t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")),
        t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name")),
    )


@query("u2_bind_ragged", """SELECT c_name AS name, c_custkey AS customer_no, 0 AS supplier_no, c_acctbal AS balance FROM {customer}
UNION ALL SELECT s_name, 0, s_suppkey, s_acctbal FROM {supplier}""")
def _(t):
    return ct.bind_ragged(
        t.customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("customer_no"), F.col("c_acctbal").alias("balance")),
        t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("supplier_no"), F.col("s_acctbal").alias("balance")),
    )


@query("u3_used_levels", f"SELECT DISTINCT taxon FROM ({RAW})")
def _(t):
    return reshape.used_levels(raw_lines(t), "taxon")


@query("u4_total_rows", f"{COUNTS} SELECT * FROM counts UNION ALL SELECT sample, 'Total', CAST(SUM(reads) AS BIGINT) FROM counts GROUP BY 1")
def _(t):
    return ct.with_total_rows(t.sql(LINES))


# ---------------------------------------------------------------- aggregation and thresholds
@query("a1_merge_assignments", f"{COUNTS} SELECT * FROM counts")
def _(t):
    return counted(t)


@query("a2_sample_totals", f"SELECT sample, CAST(SUM(reads) AS BIGINT) AS total FROM ({LINES}) GROUP BY 1")
def _(t):
    return ct.sample_totals(t.sql(LINES))


@query("a3_proportional_reads", f"""{RAWC}, raw_total AS (SELECT sample, SUM(reads) AS total FROM counts GROUP BY 1),
kept AS (SELECT * FROM counts WHERE contains(taxon, ' ') AND taxon <> 'Homo sapiens')
SELECT k.sample, k.taxon, k.reads, ROUND(CAST(k.reads AS DOUBLE) / r.total, 9) AS of_raw,
ROUND(CAST(k.reads AS DOUBLE) / SUM(k.reads) OVER (PARTITION BY k.sample), 9) AS of_refined FROM kept k JOIN raw_total r ON k.sample = r.sample""")
def _(t):
    full = raw(t)
    kept = full.where("contains(taxon, ' ') AND taxon <> 'Homo sapiens'")
    both = ct.proportions(ct.proportions(kept, ct.sample_totals(full), "of_raw").drop("total"), ct.sample_totals(kept), "of_refined")
    return both.select("sample", "taxon", "reads", F.round("of_raw", 9).alias("of_raw"), F.round("of_refined", 9).alias("of_refined"))


@query("a4_max_frequency", f"{FREQ} SELECT taxon, ROUND(MAX(freq), 9) AS threshold FROM pos GROUP BY 1")
def _(t):
    freq = ct.proportions(counted(t).where(ids.sample_role("sample", NEG, POS) == "positive"))
    return th.max_frequency(freq).withColumn("threshold", F.round("threshold", 9))


@query("a5_global_thresholds", f"""{FREQ} SELECT 'control species' AS option, ROUND(MAX(freq), 9) AS threshold FROM bio WHERE taxon = 'blue anvil'
UNION ALL SELECT 'other taxa', ROUND(MAX(freq), 9) FROM pos WHERE taxon NOT IN ('blue anvil', 'red rod')""")
def _(t):
    f = shares(t)
    one = th.control_species_maximum(biological(f), CONTROL).withColumn("option", F.lit("control species"))
    two = th.control_contaminant_maximum(positive(f), CONTROL, "red rod").withColumn("option", F.lit("other taxa"))
    return ct.bind_rows(one, two).select("option", F.round("threshold", 9).alias("threshold"))


@query("a6_apply_global_threshold", f"""{FREQ} SELECT sample, taxon, reads, CASE WHEN freq > (SELECT MAX(freq) FROM pos WHERE taxon <> 'blue anvil')
THEN reads ELSE 0 END AS kept FROM bio""")
def _(t):
    f = shares(t)
    limit = th.control_contaminant_maximum(positive(f), CONTROL)
    return th.apply_global_threshold(biological(f), limit).select("sample", "taxon", "reads", "kept")


LIMITS = ", limits AS (SELECT taxon, CASE WHEN taxon = 'blue anvil' THEN 0 ELSE MAX(freq) END AS t FROM pos GROUP BY 1)"


@query("a7_taxon_thresholds", f"""{FREQ}{LIMITS} SELECT sample, bio.taxon, reads, CASE WHEN freq > COALESCE(t, 0) THEN reads ELSE 0 END AS kept
FROM bio LEFT JOIN limits ON bio.taxon = limits.taxon""")
def _(t):
    f = shares(t)
    return th.apply_taxon_thresholds(biological(f), th.taxon_thresholds(positive(f), CONTROL)).select("sample", "taxon", "reads", "kept")


@query("a8_shares_to_reads", f"{COUNTS} SELECT sample, taxon, reads FROM counts")
def _(t):
    return ct.reads_from_share(ct.proportions(counted(t)).drop("reads")).select("sample", "taxon", "reads")


@query("a9_retention", f"""{FREQ}{LIMITS} SELECT 'taxon-specific' AS type, sample, COUNT(*) FILTER (WHERE reads > 0) AS before,
COUNT(*) FILTER (WHERE freq > COALESCE(t, 0) AND reads > 0) AS after,
ROUND(CAST(after AS DOUBLE) / before * 100, 6) AS retained FROM bio LEFT JOIN limits ON bio.taxon = limits.taxon GROUP BY 2""")
def _(t):
    f = shares(t)
    kept = th.apply_taxon_thresholds(biological(f), th.taxon_thresholds(positive(f), CONTROL))
    return th.retention(kept, {"taxon-specific": "kept"}).withColumn("retained", F.round("retained", 6))


@query("a10_threshold_summary", f"""{FREQ}{LIMITS}, one AS (SELECT MAX(freq) AS t1 FROM bio WHERE taxon = 'blue anvil'),
two AS (SELECT MAX(freq) AS t2 FROM pos WHERE taxon <> 'blue anvil'),
kept AS (SELECT sample, COUNT(*) AS n, COUNT(*) FILTER (WHERE freq > t1) AS k1, COUNT(*) FILTER (WHERE freq > t2) AS k2,
  COUNT(*) FILTER (WHERE freq > COALESCE(t, 0)) AS k3 FROM bio LEFT JOIN limits ON bio.taxon = limits.taxon CROSS JOIN one CROSS JOIN two WHERE reads > 0 GROUP BY 1)
SELECT 'control species' AS type, ROUND(MIN(100.0::DOUBLE * k1 / n), 6) AS lowest, ROUND(MAX(100.0::DOUBLE * k1 / n), 6) AS highest, ROUND(AVG(100.0::DOUBLE * k1 / n) FILTER (WHERE k1 > 0), 6) AS mean_retained FROM kept
UNION ALL SELECT 'other taxa', ROUND(MIN(100.0::DOUBLE * k2 / n), 6), ROUND(MAX(100.0::DOUBLE * k2 / n), 6), ROUND(AVG(100.0::DOUBLE * k2 / n), 6) FROM kept
UNION ALL SELECT 'taxon-specific', ROUND(MIN(100.0::DOUBLE * k3 / n), 6), ROUND(MAX(100.0::DOUBLE * k3 / n), 6), ROUND(AVG(100.0::DOUBLE * k3 / n), 6) FROM kept""")
def _(t):
    f = shares(t)
    s = compare_threshold_options(biological(f), positive(f), CONTROL)
    return s.select("type", *[F.round(c, 6).alias(c) for c in ("lowest", "highest", "mean_retained")])


@query("a11_contamination_profile", f"""{RAWC} SELECT sample, CASE WHEN contains(sample, 'CB') THEN 'Field' WHEN contains(sample, 'FB') THEN 'Filtration'
WHEN contains(sample, 'EB') THEN 'Extraction' ELSE 'PCR' END AS control_type, taxon, reads,
ROUND(CAST(reads AS DOUBLE) / SUM(reads) OVER (PARTITION BY sample), 9) AS freq FROM counts WHERE regexp_matches(sample, 'CB|FB|EB|Negative')""")
def _(t):
    controls = raw(t).where(ids.sample_role("sample") == "negative")
    return th.contamination_profile(controls).withColumn("freq", F.round("freq", 9))


WILD_SHARE = WILD + ", shares AS (SELECT *, CAST(reads AS DOUBLE) / SUM(reads) OVER (PARTITION BY sample) AS freq FROM wild)"


def wild_shares(t: Tables) -> DataFrame:
    return ct.proportions(wild(t)).drop("total")


@query("a12_mean_over_detections", f"""{RAWC}{WILD_SHARE} SELECT taxon, site, pond, replicate, ROUND(AVG(freq), 9) AS freq FROM shares WHERE freq > 0 GROUP BY 1, 2, 3, 4""")
def _(t):
    return compare.mean_over_detections(wild_shares(t), ["taxon", "site", "pond", "replicate"]).withColumn("freq", F.round("freq", 9))


@query("a13_pond_presence", f"SELECT site, pond, species, method, MAX(present) AS seen FROM ({SURVEYS}) GROUP BY 1, 2, 3, 4")
def _(t):
    return compare.pond_presence(t.sql(SURVEYS), ["site", "pond", "species", "method"], "present", "seen")


@query("a14_site_rows", f"""SELECT species, site, pond, MAX(present) AS present FROM ({SURVEYS}) GROUP BY 1, 2, 3
UNION ALL SELECT species, site, 'Site', MAX(present) FROM ({SURVEYS}) GROUP BY 1, 2""")
def _(t):
    return compare.with_site_rows(t.sql(SURVEYS), ["species", "site", "pond"])


@query("a15_compare_methods", f"""WITH s AS (SELECT * FROM ({SURVEYS})),
edna AS (SELECT site, pond, species, MAX(present) AS present FROM s WHERE method = 'view' GROUP BY 1, 2, 3
  UNION ALL SELECT site, 'Site', species, MAX(present) FROM s WHERE method = 'view' GROUP BY 1, 3),
survey AS (SELECT site, pond, species, 'Camera traps' AS method, present FROM s WHERE method = 'click'
  UNION ALL SELECT site, pond, species, 'Field signs', present FROM s WHERE method = 'error' AND species <> 'Bos taurus'
  UNION ALL SELECT site, pond, species, 'Cumulative survey data', present FROM s WHERE method = 'signup'
  UNION ALL SELECT site, pond, species, 'eDNA', present FROM edna),
keys AS (SELECT DISTINCT site, pond, species FROM survey),
m(method) AS (VALUES ('Cumulative survey data'), ('Field signs'), ('Camera traps'), ('eDNA'))
SELECT site, pond, species, CASE WHEN species IN ('Castor fiber', 'Arvicola amphibius', 'Lutra lutra', 'Neovison vison') THEN 'Semi-aquatic'
    WHEN species = 'Sciurus vulgaris' THEN 'Arboreal' ELSE 'Ground-dwelling' END AS lifestyle, method,
  CAST(COALESCE((SELECT MAX(present) FROM survey v WHERE v.site = k.site AND v.pond = k.pond AND v.species = k.species AND v.method = m.method), 0) AS INT) AS occupancy
FROM keys k CROSS JOIN m WHERE (site, species) NOT IN (SELECT * FROM (VALUES {values(fv.NOT_EXPECTED)}))
AND NOT (site = 'Thorne Moors' AND species = 'Arvicola amphibius' AND pond = 'Pond 1')""")
def _(t):
    from taxatally.plans.wild import method_comparison

    s = t.sql(SURVEYS)
    return method_comparison(
        edna=s.where("method = 'view'"),
        historical=s.where("method = 'signup'"),
        field=s.where("method = 'error' AND species <> 'Bos taurus'"),
        camera=s.where("method = 'click'"),
    )


@query("a16_nonempty_taxa", f"""{COUNTS}, d AS (SELECT sample, taxon, CASE WHEN taxon LIKE '%rod' THEN 0 ELSE reads END AS reads FROM counts)
SELECT * FROM d WHERE taxon IN (SELECT taxon FROM d GROUP BY 1 HAVING MAX(reads) > 0)""")
def _(t):
    d = counted(t).withColumn("reads", F.when(F.col("taxon").endswith("rod"), 0).otherwise(F.col("reads")))
    return ct.nonempty_taxa(d)


@query("surviving_taxa", f"""{COUNTS.replace('counts AS', 'lines AS')}, s(taxon, accepted) AS (VALUES {values(RENAMED)}),
counts AS (SELECT sample, COALESCE(accepted, lines.taxon) AS taxon, CAST(SUM(reads) AS BIGINT) AS reads FROM lines LEFT JOIN s ON lines.taxon = s.taxon GROUP BY 1, 2)"""
+ FREQ[len(COUNTS):] + LIMITS + """ SELECT sample, bio.taxon, reads, ROUND(freq, 9) AS freq FROM bio LEFT JOIN limits ON bio.taxon = limits.taxon
WHERE freq > COALESCE(t, 0)""")
def surviving_taxa(t):
    synonyms = small_table(t.spark, "taxon string, accepted string", RENAMED)
    out = taxa_surviving_thresholds(t.sql(LINES), synonyms, CONTROL, NEG, POS)
    return out.select("sample", "taxon", "reads", F.round("freq", 9).alias("freq"))
