"""Mixing sources to target weights by Pareto order sampling.

Each document has an expected number of copies. Its whole part is taken for certain. For the rest, documents are
ranked by random odds divided by inclusion odds, and the first ones are taken until the source's remaining words
are reached: a sample of fixed size, counted in words, with unequal inclusion probabilities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceshift.llm.common import SPACE, text_of, unit_hash, written
from paceshift.operators.numbering import running_total
from paceshift.operators.reuse import join_small

#: Ranks are found through this many cells a level; the rank in one cell of the last level is exact.
CELLS = 4096
UNIT = float(1 << 52)


def words_in(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE, -1))).cast("long")


def source_targets(docs: DataFrame, weights: Sequence[int], cap: float) -> DataFrame:
    """(source, source_size, target): the whole size shared by weight, no target above cap times its source.

    A target is min(cap * size, level * weight) with one level for all. Sorted by cap * size / weight, the capped
    sources come first, so the level follows from running sums over one row per source. These are made by ranges, so a table with a source for each host is not gathered.
    """
    sums = written(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    order = running_total(sums, ["source"], F.lit(1), "order")
    given = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("order") % len(weights) + 1).cast("int"))
    sums = order.withColumn("weight", given).withColumn("most", F.col("source_size") * F.lit(cap))
    sums = sums.withColumn("ratio", F.col("most") / F.col("weight")).drop("order")
    by_ratio = ["ratio", "weight", "source"]
    sums = running_total(running_total(sums, by_ratio, F.col("source_size"), "size_before"), by_ratio, F.col("weight"), "weight_before")
    sums = written(sums)
    size, weight = sums.agg(F.sum("source_size"), F.sum("weight")).first()
    if size is None:
        return sums.select("source", "source_size", F.col("most").alias("target"))
    level = (F.lit(size) - F.lit(cap) * F.col("size_before")) / (F.lit(weight) - F.col("weight_before"))
    # The first source that is not capped sets the level of all later ones; of those with one ratio it has the highest level.
    fits = sums.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("most"))
    first = fits.agg(F.min(F.struct("ratio", (-F.col("level")).alias("less")))["less"]).first()[0]
    target = F.col("most") if first is None else F.least("most", F.lit(-first) * F.col("weight"))
    return sums.select("source", "source_size", target.alias("target"))


def copy_levels(docs: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """targets with level, so that documents of a source with min(cap, level * weight) copies each reach its target. One row for each weight of a source is ordered."""
    sums = docs.where("weight > 0").groupBy(F.col("source").alias("s"), "weight").agg(F.sum("size").alias("n"))
    sums = sums.join(targets, F.col("source").eqNullSafe(F.col("s"))).withColumn("mass", F.col("weight") * F.col("n"))
    heavy = Window.partitionBy("source").orderBy(F.desc("weight"))
    before, after = heavy.rowsBetween(Window.unboundedPreceding, -1), heavy.rowsBetween(0, Window.unboundedFollowing)
    rest = F.sum("mass").over(after)
    level = F.when(rest > 0, (F.col("target") - F.lit(cap) * F.coalesce(F.sum("n").over(before), F.lit(0))) / rest)
    sums = sums.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= cap * (1 + 1e-12), F.struct((-F.col("weight")).alias("w"), F.col("level").alias("level")))
    found = sums.groupBy(F.col("source").alias("s")).agg(F.min(fits)["level"].alias("level"))
    return targets.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """One row for each row of docs (doc_id, source, size; optional weight and tie): doc_id, size, source_size, target,
    copies and taken = copies * size.

    weights go to the sources by code point, null last, repeating. weight (null or absent: 1) makes a document's
    expected copies larger or smaller, in proportion and up to cap; it is rounded to a 64th of an octave, and without
    a positive weight nothing is taken. Null sizes count as 0. A source without
    words has target 0, and nothing is taken from it. Rows with the same doc_id and tie (a hash of the text) share their random number, so rows
    without an id are spread by their texts; of
    rows that agree in all columns it does not matter which one is taken. Reruns agree, on any partitioning.

    No source is sorted or gathered: words per cell of the ranking come from a map-side combined sum, the cell at
    which the sample ends is opened into finer cells, and only what is left in one of those is put in order.
    """
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in docs.columns else F.lit(1.0)
    weight = F.when(F.isnan(weight) | (weight <= 0), F.lit(0.0)).otherwise(F.pow(F.lit(2.0), F.round(F.log2(weight) * 64) / 64))
    random = unit_hash(F.col("doc_id"), *([F.col("tie")] if "tie" in docs.columns else []), seed=seed)
    docs = docs.select("doc_id", "source", F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")).alias("size"), weight.alias("weight"), random.alias("random"))
    docs = written(docs)
    targets = source_targets(docs, weights, cap)
    targets = written(copy_levels(docs, targets, cap))
    ranked = join_small(docs, targets, ["source"], F.col("doc_id"))
    ranked = ranked.withColumn("expected", F.coalesce(F.least(F.lit(cap), F.col("level") * F.col("weight")), F.lit(0.0)))
    ranked = ranked.withColumn("copies", F.floor("expected").cast("long")).withColumn("part", F.col("expected") - F.col("copies"))
    u = (F.col("random") + 0.5) / UNIT
    odds = u / (1 - u) * (1 - F.col("part")) / F.col("part")
    ranked = ranked.withColumn("rank", F.when(F.col("part") > 0, odds / (1 + odds)))
    ranked = ranked.withColumn("cell1", F.least(F.floor(F.col("rank") * CELLS), F.lit(CELLS - 1)).cast("int"))
    ranked = ranked.withColumn("cell2", F.floor((F.col("rank") * CELLS - F.col("cell1")) * CELLS).cast("int"))
    whole = ranked.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("certain"))
    room = whole.select("source", (F.col("target") - F.col("certain")).alias("room"))

    def ends(rows: DataFrame, room: DataFrame, cell: str) -> DataFrame:
        """(source, end, room): the first cell at whose end the room is passed, and the room left at its start."""
        sums = rows.where("rank IS NOT NULL").groupBy("source", cell).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy(cell))
        sums = sums.withColumn("upto", upto).join(room.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        over = F.when(F.col("upto") > F.col("room"), F.struct(F.col(cell).alias("cell"), (F.col("room") - F.col("upto") + F.col("n")).alias("room")))
        return sums.groupBy("source").agg(F.min(over).alias("x")).select("source", F.col("x.cell").alias(f"end_{cell}"), F.col("x.room").alias(f"room_{cell}"))

    first = written(ends(ranked, room, "cell1"))
    ranked = join_small(ranked, first, ["source"], F.col("doc_id"), "left")
    opened = ranked.where("cell1 = end_cell1")
    second = written(ends(opened, first.select("source", F.col("room_cell1").alias("room")), "cell2"))
    ranked = join_small(ranked, second, ["source"], F.col("doc_id"), "left")

    at_end = F.coalesce((F.col("cell1") == F.col("end_cell1")) & (F.col("cell2") == F.col("end_cell2")), F.lit(False))
    sampled = F.col("rank").isNotNull() & (
        F.col("end_cell1").isNull()
        | (F.col("cell1") < F.col("end_cell1"))
        | ((F.col("cell1") == F.col("end_cell1")) & (F.col("end_cell2").isNull() | (F.col("cell2") < F.col("end_cell2"))))
    )
    clear = ranked.where(~at_end).withColumn("copies", F.col("copies") + sampled.cast("long"))
    inside = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = ranked.where(at_end).withColumn("upto", F.sum("size").over(inside))
    # A document is taken if its middle is within the room, so that the sum ends at most half a document away.
    last = last.withColumn("copies", F.col("copies") + (F.col("upto") - F.col("size") / 2 <= F.col("room_cell2")).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")]
    return clear.select(*columns).union(last.select(*columns))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, weight, tie) of documents; size counts words.

    A document weighs as much as its number of words has digits: of two documents of one source, one with thousands of words is expected
    to be taken up to twice as often as one with tens.
    """
    size = words_in(F.col("text"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"))
    return sized.withColumn("weight", F.length(F.col("size").cast("string")))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws('|', 'mix', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT AS random
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::BIGINT AS most,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s
), t AS (
  SELECT source, source_size, least(most, weight * (SELECT level FROM l WHERE level * weight <= most ORDER BY most / weight, weight, source NULLS LAST LIMIT 1)) AS target FROM l
), w AS (  -- the documents' own weights, rounded to a 64th of an octave
  SELECT *, pow(2.0::DOUBLE, round(log2(length(size::VARCHAR)::DOUBLE) * 64) / 64) AS own FROM d
), c AS (  -- words of a source by weight
  SELECT w.source, own, sum(size)::BIGINT AS n, any_value(target) AS target FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source GROUP BY w.source, own
), v AS (
  SELECT *, (target - 3.0::DOUBLE * coalesce(sum(n) OVER (PARTITION BY source ORDER BY own DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(own * n) OVER (PARTITION BY source ORDER BY own DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level
  FROM c
), k AS (
  SELECT source, arg_max(level, own) AS level FROM v WHERE level * own <= 3.0::DOUBLE * (1 + 1e-12) GROUP BY source
), e AS (
  SELECT w.*, source_size, target, least(3.0::DOUBLE, coalesce(level * own, 0.0)) AS expected
  FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON w.source IS NOT DISTINCT FROM k.source
), o AS (  -- random odds over inclusion odds
  SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS part, (random + 0.5) / 4503599627370496.0::DOUBLE AS u FROM e
), r AS (
  SELECT *, CASE WHEN part > 0 THEN u / (1 - u) * (1 - part) / part END AS odds, target - sum(whole * size) OVER (PARTITION BY source) AS room FROM o
), p AS (
  SELECT *, sum(size) OVER (PARTITION BY source, odds IS NULL ORDER BY odds / (1 + odds), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r
)
SELECT doc_id, size, source_size, target, (whole + (odds IS NOT NULL AND upto - size / 2.0 <= room)::BIGINT) * size AS taken FROM p
"""
