"""From raw reads to a table of sequences by sample.

Reads are rows ``(sample, read_id, mate, seq, qual)``. Everything up to pairing works row
by row inside the scan stage; pairing shuffles on sample and read id, so a sample with a
large share of all reads is spread evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxatally import fixed_values as fv
from taxatally.functions.sequences import clip_start, letters, once, reverse_complement, trim_window


def clip_primers(reads: DataFrame, bases: Column | int = fv.PRIMER_BASES) -> DataFrame:
    """Take the primer off the start of each read; the length may come from a manifest column."""
    seq, qual = clip_start("seq", "qual", bases)
    return reads.withColumns({"seq": seq, "qual": qual})


def trim_reads(
    reads: DataFrame,
    quality: int = fv.TRIM_QUALITY,
    crop: int = fv.READ_CROP,
    shortest: int = fv.TRIM_MIN_LENGTH,
    window: int = 5,
) -> DataFrame:
    """Crop, quality-trim both ends and drop reads that end up too short.

    Reads already too short are dropped first: trimming only removes bases.
    """
    rows = reads.where(F.length("seq") >= shortest).select("*", once(trim_window("qual", quality, crop, window)).alias("_keep"))
    rows = rows.where(F.col("_keep.bases") >= shortest)
    return rows.withColumns(
        {
            "seq": F.substring(F.col("seq"), F.col("_keep.first"), F.col("_keep.bases")),
            "qual": F.slice("qual", F.col("_keep.first"), F.col("_keep.bases")),
        }
    ).drop("_keep")


def pair_mates(reads: DataFrame) -> DataFrame:
    """One row per read id with both mates and its state: ``pair``, ``orphan_1``, ``orphan_2``."""
    keys = ["sample", "read_id"]
    one, two = (
        reads.where(F.col("mate") == m).select(*keys, F.col("seq").alias(f"seq{m}"), F.col("qual").alias(f"qual{m}"))
        for m in (1, 2)
    )
    state = (
        F.when(F.col("seq2").isNull(), "orphan_1").when(F.col("seq1").isNull(), "orphan_2").otherwise("pair")
    )
    return one.join(two, keys, "full").withColumn("state", state)


def best_overlap(shortest: int = 10, mismatch_share: float = 0.25) -> Column:
    """Overlap of mate 1's end with mate 2's reversed start that disagrees least; 0 for none.

    Works on columns ``x`` and ``y``, both reads in the same direction, and ``a`` and ``b``,
    their letters. Among overlaps with the same share of mismatches the longest wins. An
    overlap without any mismatch cannot be beaten, so these are looked for first, by
    comparing text; letters are only compared where there is none.
    """
    size_a, longest = F.size("a"), F.least(F.size("a"), F.size("b"))
    down = F.sequence(longest, F.lit(shortest), F.lit(-1))
    exact = F.get(F.filter(down, lambda n: F.substring("x", size_a - n + 1, n) == F.substring("y", F.lit(1), n)), F.lit(0))

    def judged(n: Column) -> Column:
        tail, head = F.slice("a", size_a - n + 1, n), F.slice("b", F.lit(1), n)
        differ = F.zip_with(tail, head, lambda x, y: ((x != y) & (x != "N") & (y != "N")).cast("int"))
        wrong = F.aggregate(differ, F.lit(0), lambda t, d: t + d)
        return F.struct((wrong / n).alias("share"), (-n).alias("minus"))

    options = F.filter(F.transform(down, judged), lambda o: o["share"] <= mismatch_share)
    found = F.coalesce(exact, -F.array_min(options)["minus"], F.lit(0))
    return F.when(longest >= shortest, found).otherwise(F.lit(0))


def merge_pairs(pairs: DataFrame, shortest: int = 10, mismatch_share: float = 0.25, forward_only: bool = True) -> DataFrame:
    """Merge overlapping mates to ``(sample, read_id, seq, qual, merged)``.

    Where mates disagree the base of higher quality stands. With ``forward_only`` pairs
    that do not overlap keep mate 1, as do its orphans; orphans of mate 2 are dropped.
    """
    keys = ["sample", "read_id"]
    turned = reverse_complement("seq2")
    both = F.struct(
        F.col("seq1").alias("x"),
        turned.alias("y"),
        letters("seq1").alias("a"),
        letters(turned).alias("b"),
        F.col("qual1").alias("qa"),
        F.reverse("qual2").alias("qb"),
    )
    rows = pairs.where(F.col("seq1").isNotNull()).select(*keys, once(both).alias("_r")).select(*keys, "_r.*")
    n = F.when(F.col("b").isNotNull(), best_overlap(shortest, mismatch_share)).otherwise(F.lit(0))
    rows = rows.select("*", once(n).alias("n"))
    lead = F.size("a") - F.col("n")
    places = F.sequence(F.lit(0), F.col("n") - 1)
    base = F.transform(
        places, lambda i: F.when(F.get("qb", i) > F.get("qa", lead + i), F.get("b", i)).otherwise(F.get("a", lead + i))
    )
    value = F.transform(places, lambda i: F.greatest(F.get("qa", lead + i), F.get("qb", i)))
    seq = F.concat(F.substring(F.col("x"), F.lit(1), lead), F.array_join(base, ""), F.substring(F.col("y"), F.col("n") + 1, F.length("y")))
    qual = F.concat(F.slice("qa", F.lit(1), lead), value, F.slice("qb", F.col("n") + 1, F.size("qb")))
    merged = F.col("n") > 0
    out = rows.select(
        *keys,
        F.when(merged, seq).otherwise(F.col("x")).alias("seq"),
        F.when(merged, qual).otherwise(F.col("qa")).alias("qual"),
        merged.cast("int").alias("merged"),
    )
    return out if forward_only else out.where("merged = 1")


def filter_length(reads: DataFrame, length: int = fv.LENGTH_FILTER, tolerance: float = 0.1) -> DataFrame:
    """Sequences within a share of the expected length."""
    return reads.where(F.length("seq").between(round(length * (1 - tolerance)), round(length * (1 + tolerance))))


def clusters(reads: DataFrame) -> DataFrame:
    """Identical sequences of a sample with their number of reads."""
    return reads.groupBy("sample", "seq").agg(F.count("*").alias("reads"))


def dereplicate(reads: DataFrame, least: int = fv.MIN_CLUSTER_READS) -> DataFrame:
    """Clusters with enough reads, named by a digest of their sequence.

    The name depends on the sequence alone, so the same sequence has the same name in
    every sample and every run.
    """
    return clusters(reads).where(F.col("reads") >= least).withColumn("otu", F.sha2("seq", 256))


def otu_table(kept: DataFrame) -> DataFrame:
    """Reads per sequence name and sample."""
    return kept.groupBy("otu", "sample").agg(F.sum("reads").alias("reads"))


def otu_sequences(kept: DataFrame) -> DataFrame:
    """Each sequence name with its sequence, once."""
    return kept.groupBy("otu").agg(F.first("seq").alias("seq"))


def funnel(
    raw: DataFrame, pairs: DataFrame, merged: DataFrame, least: int = fv.MIN_CLUSTER_READS
) -> DataFrame:
    """Read numbers per sample, one column per stage: raw reads, pairs of trimmed mates, merged reads.

    Each stage is first reduced to one row per sample; these short tables are stacked and
    added up together. Samples that lose all reads keep their row. The last columns are
    NULL for samples that reach no cluster.
    """
    groups = clusters(merged)
    enough = F.col("reads") >= least
    stages = [
        raw.groupBy("sample").agg(F.count("*").alias("total")),
        pairs.groupBy("sample").agg(
            F.sum(F.when(F.col("state") == "pair", 2).otherwise(0)).alias("trimmed_pe"),
            F.count_if(F.col("state") != "pair").alias("trimmed_orphans"),
        ),
        merged.groupBy("sample").agg(F.count("*").alias("merged")),
        groups.groupBy("sample").agg(
            F.count("*").alias("clusters_total"),
            F.count_if(enough).alias("clusters_above"),
            F.sum(F.when(enough, F.col("reads")).otherwise(0)).alias("queries"),
        ),
    ]
    stacked = stages[0]
    for stage in stages[1:]:
        stacked = stacked.unionByName(stage, allowMissingColumns=True)
    names = ["total", "trimmed_pe", "trimmed_orphans", "merged", "clusters_total", "clusters_above", "queries"]
    sums = stacked.groupBy("sample").agg(*[F.sum(c).alias(c) for c in names])
    zero = {c: F.coalesce(c, F.lit(0)) for c in names[:4]}
    return sums.withColumns(zero).withColumn("trimmed_total", F.col("trimmed_pe") + F.col("trimmed_orphans"))
