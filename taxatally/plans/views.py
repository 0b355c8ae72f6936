"""Views that present the given tables as count tables, samples, reads and model frames.

The texts run unchanged on Spark and on DuckDB, so a query and its check start from the
same input; everything after that is computed separately.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from taxatally.plans.registry import Tables
from taxatally.session import stored


def pick(expr: str, names: list[str]) -> str:
    """CASE text that turns ``expr`` (0, 1, …) into one of the names."""
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE {expr} {whens} END"


# One row per order line: customer = sample, part name = taxon, quantity = reads.
LINES = """
SELECT c_name AS sample, p_name AS taxon, CAST(l_quantity AS BIGINT) AS reads
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey
"""

# Sample ids in the study's grammar, one per customer.
_M = "CAST(FLOOR(c_custkey / CAST(20 AS DOUBLE)) AS BIGINT)"
_ENC = pick(
    f"({_M} + c_custkey) % 10",
    ["LYNX", "ZOO", "DEER", "PM", "SQ", "WV", "HH", "OTT", "BAD", "BEAV"],
)
_NO = pick(
    f"{_M} % 17",
    ["P01", "P02", "P03", "P04", "P05", "P06", "T01", "T02", "T03", "T04", "T05", "T06",
     "POOL", "1IND", "4IND", "BATH", "BEAV"],
)
IDS = f"""
SELECT c_custkey, CASE c_custkey % 20
  WHEN 0 THEN 'THL0' || (1 + {_M} % 2) || '-D0' || (1 + {_M} % 5) || '-CB'
  WHEN 1 THEN 'THL-D0' || (1 + {_M} % 5) || '-FB-Round0' || (1 + {_M} % 4)
  WHEN 2 THEN 'EB-Round0' || (1 + {_M} % 6)
  WHEN 3 THEN 'L' || (1 + {_M} % 9) || '-Negative-0' || (1 + {_M} % 8)
  WHEN 4 THEN 'L' || (1 + {_M} % 9) || '-Positive-0' || (1 + {_M} % 8)
  WHEN 5 THEN 'BAM0' || (1 + {_M} % 2) || '-0' || (1 + {_M} % 7)
  WHEN 6 THEN 'TM0' || (1 + {_M} % 2) || '-0' || (1 + {_M} % 7)
  WHEN 7 THEN 'D0' || (1 + {_M} % 5) || '-THL0' || (1 + {_M} % 2) || '-0' || (1 + {_M} % 9)
  WHEN 8 THEN 'D0' || (1 + {_M} % 5) || '-THL0' || (1 + ({_M} + 1) % 2) || '-0' || (1 + {_M} % 7)
  WHEN 9 THEN 'HWP-Round01-SQ-BATH'
  WHEN 10 THEN 'WWT-D' || (1 + {_M} % 3) || '-Round0' || (1 + {_M} % 4) || '-' || {_ENC} || '-' || {_NO}
  WHEN 11 THEN 'WWT-D0' || (1 + {_M} % 3) || '-Round0' || (1 + {_M} % 4) || '-' || {_ENC} || '-' || {_NO}
  WHEN 12 THEN 'WWT-D0' || (1 + {_M} % 3) || '-Round02-' || {_ENC} || '-E1-' || {_NO}
  ELSE 'HWP-Round0' || (1 + {_M} % 4) || '-' || {_ENC} || '-' || {_NO}
END AS sample FROM {{customer}}
"""

# Taxon names of the study, one per part, with names that need each kind of correction.
NAMES = [
    "Lutra_lutra", "Arvicola_amphibius", "Castor_fiber", "Meles_meles", "Cervus_elaphus",
    "Erinaceus_europaeus", "Lynx_lynx", "Martes_martes", "Sciurus_vulgaris", "Castor", "Bos",
    "Cichlidae", "Haplochromis_burtoni", "Maylandia_zebra", "Canis_lupus", "Anas", "Anas_carolinensis",
    "Pan", "Bos_mutus", "unassigned", "Homo_sapiens", "Rattus_norvegicus", "Rana_temporaria",
    "Salmo_trutta", "Strix", "Cyprinidae", "Chordata_environmental_sample", "Pipistrellus_pipistrellus",
    "Daphnia_pulex",
]
SPECIES = f"SELECT p_partkey, {pick(f'p_partkey % {len(NAMES)}', NAMES)} AS raw_taxon FROM {{part}}"

# Line-level reads with study ids and raw names, as imported.
RAW = f"""
SELECT i.sample AS sample, s.raw_taxon AS taxon, CAST(l_quantity AS BIGINT) AS reads
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
JOIN ({IDS}) i ON o_custkey = i.c_custkey JOIN ({SPECIES}) s ON l_partkey = s.p_partkey
"""



def study_ids(t: Tables) -> DataFrame:
    """The ids as a stored column, as they would arrive in a sample table."""
    return stored(t.sql(IDS), "ids")


def raw_lines(t: Tables) -> DataFrame:
    """``RAW`` on top of the stored ids."""
    return t.sql(RAW.replace(f"({IDS})", "{ids}"), ids=study_ids(t))


# Surveys of eleven species at two ponds of three sites, by method.
_SITE = pick("user_id % 3", ["Bamff Estate", "Thorne Moors", "Tophill Low Nature Reserve"])
_POND = pick("CAST(FLOOR(user_id / CAST(3 AS DOUBLE)) AS BIGINT) % 2", ["Pond 1", "Pond 2"])
_SPEC = pick(
    "user_id % 11",
    ["Castor fiber", "Arvicola amphibius", "Lutra lutra", "Meles meles", "Sciurus vulgaris", "Bos taurus",
     "Cervus elaphus", "Vulpes vulpes", "Sus scrofa", "Neovison vison", "Muntiacus reevesi"],
)
SURVEYS = f"""
SELECT {_SITE} AS site, {_POND} AS pond, {_SPEC} AS species, event_type AS method,
  CASE WHEN value > 150 THEN 1 ELSE 0 END AS present FROM {{events}}
"""

# Model frame: a response in [0, 1], two factors, two numbers, two random levels.
FRAME = """
SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS row_id,
  least(greatest(l_discount * 10, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS y,
  l_returnflag AS flag, p_type AS kind, l_quantity AS quantity, l_tax AS tax,
  n_name AS nation, r_name AS region
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""
