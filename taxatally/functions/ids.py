"""Everything a sample id says: control role, experiment, enclosure, site, pond, day.

All functions are column expressions, so id parsing runs inside the scan stage and a
filter on a parsed value needs no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxatally import fixed_values as fv


def sample_role(
    sample: str,
    negative: str = fv.NEGATIVE_PATTERN,
    positive: str = fv.POSITIVE_PATTERN,
    ignore_case: bool = False,
) -> Column:
    """``negative``, ``positive`` or ``biological``."""
    flag = "(?i)" if ignore_case else ""
    return (
        F.when(F.col(sample).rlike(flag + negative), "negative")
        .when(F.col(sample).rlike(flag + positive), "positive")
        .otherwise("biological")
    )


def first_match(sample: Column | str, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """Label of the first rule whose pattern occurs in the value."""
    col = F.col(sample) if isinstance(sample, str) else sample
    (pattern, name), *rest = rules
    chain = F.when(col.rlike(pattern), name)
    for pattern, name in rest:
        chain = chain.when(col.rlike(pattern), name)
    return chain.otherwise(otherwise)


def control_type(sample: str) -> Column:
    """Kind of negative control, tested in order."""
    return first_match(sample, fv.CONTROL_TYPES, "Other")


def sample_type(sample: str) -> Column:
    """Sampling strategy of a captive sample."""
    return first_match(sample, fv.SAMPLE_TYPES, "Other")


def experiment(sample: str) -> Column:
    """``captive`` for animal-park samples, otherwise ``wild``."""
    return F.when(F.col(sample).rlike(fv.CAPTIVE_PATTERN), "captive").otherwise("wild")


def is_time_course(sample: str) -> Column:
    return F.col(sample).rlike(fv.TIME_COURSE_PATTERN)


def strip_suffix(name: Column | str, suffix: str) -> Column:
    """Remove a literal tool suffix from the end of a name."""
    col = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(col, "\\Q" + suffix + "\\E$", "")


def spaced(name: Column | str) -> Column:
    """Underscores to spaces."""
    col = F.col(name) if isinstance(name, str) else name
    return F.translate(col, "_", " ")


def captive_id(sample: str) -> Column:
    """Captive id with the pooled sample renamed to the first directed one."""
    return F.regexp_replace(sample, "POOL", "T01")


def captive_parts(sample: str) -> Column:
    """Struct ``(enclosure, sample_no)`` of a captive id.

    Park, filtration day and round are taken out; of the remaining tokens the first two
    are the enclosure and the sample number, which are then relabelled.
    """
    bare = reduce(
        lambda col, pattern: F.regexp_replace(col, pattern, ""),
        ["HWP|WWT", "-D0?[1-3]", "-Round0[1-4]-"],
        captive_id(sample),
    )
    tokens = F.split(bare, "[^A-Za-z0-9]+")
    enclosure = F.regexp_replace(F.get(tokens, F.lit(0)), "ZOO", "BEAV")
    number = reduce(
        lambda col, rule: F.regexp_replace(col, rule[0], rule[1]),
        [*fv.SAMPLE_NUMBER_LABELS, ("BEAV", "ZOO")],
        F.get(tokens, F.lit(1)),
    )
    location = F.regexp_extract(F.col(sample) if isinstance(sample, str) else sample, "(HWP|WWT)", 1)
    return F.struct(enclosure.alias("enclosure"), number.alias("sample_no"), location.alias("location"))


def enclosure_lifestyle(enclosure: Column | str) -> Column:
    """Lifestyle of the species an enclosure houses."""
    col = F.col(enclosure) if isinstance(enclosure, str) else enclosure
    names = {life: [e for e, _, l in fv.ENCLOSURES if l == life] for life in fv.LIFESTYLE_LEVELS}
    return (
        F.when(col.isin(names["Semi-aquatic"]), "Semi-aquatic")
        .when(col.isin(names["Ground-dwelling"]), "Ground-dwelling")
        .when(col.isin(names["Arboreal"]), "Arboreal")
        .otherwise("Other")
    )


def species_lifestyle(species: Column | str) -> Column:
    """Lifestyle of a wild or surveyed mammal."""
    col = F.col(species) if isinstance(species, str) else species
    return (
        F.when(col.isin(fv.SEMI_AQUATIC), "Semi-aquatic")
        .when(col.isin(fv.ARBOREAL), "Arboreal")
        .otherwise("Ground-dwelling")
    )


def vertebrate_group(taxon: Column | str) -> Column:
    """Vertebrate group of a wild taxon; what is in no other list is a mammal."""
    col = F.col(taxon) if isinstance(taxon, str) else taxon
    return (
        F.when(col.isin(fv.BIRDS), "Bird")
        .when(col.isin(fv.FISH), "Fish")
        .when(col.isin(fv.AMPHIBIANS), "Amphibian")
        .otherwise("Mammal")
    )


def wild_parts(sample: str) -> Column:
    """Struct ``(site, pond, replicate)`` of a wild id; the day is averaged over later."""
    site = first_match(sample, fv.SITES, fv.OTHER_SITE)
    tokens = F.split(F.regexp_replace(sample, "D0[1-5]-", ""), "[^A-Za-z0-9]+")
    pond = F.regexp_replace(F.get(tokens, F.lit(0)), "BAM|TM|THL", "")
    pond = F.regexp_replace(F.regexp_replace(pond, "01", "Pond 1"), "02", "Pond 2")
    return F.struct(
        site.alias("site"), pond.alias("pond"), F.get(tokens, F.lit(1)).alias("replicate")
    )


def time_course_parts(sample: str) -> Column:
    """Struct ``(day, pond, replicate)`` of a time-course id."""
    tokens = F.split(F.col(sample), "[^A-Za-z0-9]+")
    return F.struct(
        F.get(tokens, F.lit(0)).alias("day"),
        F.get(tokens, F.lit(1)).alias("pond"),
        F.get(tokens, F.lit(2)).alias("replicate"),
    )


def behaviour_type(behaviour: str) -> Column:
    """Contact class of a behaviour; what is in neither class is the text ``NA``."""
    return first_match(
        behaviour,
        [
            ("|".join(fv.WATER_CONTACT), "Water contact"),
            ("|".join(fv.NO_WATER_CONTACT), "No water contact"),
        ],
        "NA",
    )


def level_index(value: Column | str, levels: list[str]) -> Column:
    """Position of a value in an explicit level order, from 1; NULL when not a level."""
    col = F.col(value) if isinstance(value, str) else value
    position = F.array_position(F.array(*[F.lit(x) for x in levels]), col)
    return F.nullif(position, F.lit(0)).cast("int")
