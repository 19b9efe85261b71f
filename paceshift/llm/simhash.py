"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius by permuted block tables.

A term is a word and the word that follows it. Its 64-bit hash votes for or against each bit of the fingerprint, with a weight that
grows with the term's letters, as long words carry more. Votes are counted in one aggregation: a sum of hash bits
taken two at a time, 32 bits apart, holds two counters of 31 bits, enough for any text; of rows that agree in everything only one votes. All of it is in SQL functions.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceshift.llm.common import SPACE, parts_for, tasks, text_of, written
from paceshift.operators.reuse import join_small

BITS, HALF = 64, 32
#: Fingerprints are cut in BLOCKS blocks. Within RADIUS at least BLOCKS - RADIUS of them agree.
BLOCKS, RADIUS = 6, 3
#: Documents are put in order in ranges of about so many bytes; beyond RANGES ranges these grow.
RANGE_BYTES, RANGES = 64 << 20, 4096


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row for each value of keys: keys, fingerprint (long), n_rows (how many rows have these keys). Equal texts have equal fingerprints; no words give 0."""
    words = F.split(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), SPACE, -1)
    pairs = rows.select(*keys, words.alias("__w")).select(*keys, F.explode(F.arrays_zip(F.col("__w").alias("a"), F.slice("__w", 2, 1 << 30).alias("b"))).alias("t"))
    a, b = F.col("t.a"), F.coalesce("t.b", F.lit(""))
    weight = F.when(a == "", F.lit(0)).otherwise(F.least(F.lit(4), 1 + F.floor((F.length(a) + F.length(b)) / 6))).cast("long")
    terms = pairs.select(*keys, F.xxhash64(a, b).alias("__h"), weight.alias("__n"), F.col("t.b").isNull().alias("__last"))  # each text has one last word
    two = F.lit((1 << HALF) + 1)
    sums = [F.sum(F.shiftrightunsigned("__h", j).bitwiseAND(two) * F.col("__n")).alias(f"__s{j}") for j in range(HALF)]
    votes = terms.groupBy(*keys).agg(F.sum("__n").alias("__all"), F.count_if("__last").alias("n_rows"), *sums)
    low = (1 << 31) - 1
    bit = [
        F.when((F.shiftrightunsigned(f"__s{j % HALF}", HALF * (j // HALF)).bitwiseAND(F.lit(low))) * 2 > F.col("__all"), F.shiftleft(F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))
        for j in range(BITS)
    ]
    return votes.select(*keys, reduce(lambda x, y: x.bitwiseOR(y), bit).alias("fingerprint"), "n_rows")


def within(prints: DataFrame, others: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All (fingerprint, other, distance) with fingerprint from prints, other from others, at most radius bits apart.

    Both hold distinct fingerprints (long). Each table keeps blocks - radius of the blocks, so any pair within the
    radius meets in some table; it is reported in the first one only.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("long").alias("m")) for t, m in enumerate(masks)]))
    left = prints.select("fingerprint", tables.alias("x")).select("fingerprint", F.col("x.t").alias("t"), F.col("fingerprint").bitwiseAND(F.col("x.m")).alias("key"))
    right = others.select(F.col("fingerprint").alias("other"), tables.alias("x")).select("other", F.col("x.t").alias("u"), F.col("other").bitwiseAND(F.col("x.m")).alias("other_key"))
    differ = F.col("fingerprint").bitwiseXOR(F.col("other"))
    earlier = reduce(lambda x, y: x | y, [(F.col("t") > t) & (differ.bitwiseAND(F.lit(m).cast("long")) == 0) for t, m in enumerate(masks)])
    pairs = left.join(right, (F.col("t") == F.col("u")) & (F.col("key") == F.col("other_key")) & (F.bit_count(differ) <= radius) & ~earlier)
    return pairs.select("fingerprint", "other", F.bit_count(differ).alias("distance"))


def bucket_of(rows: DataFrame, column: str, n: int) -> Column:
    """Number of the range of column (whole numbers) that a row is in, of about n ranges with as many rows. Null is in the first.

    The cuts are in groups, so that a row is compared with about 2 sqrt(n) of them.
    """
    found = rows.select(F.percentile_approx(column, F.array(*[F.lit(i / n) for i in range(1, n)]), 20 * n).alias("c")).first()["c"] if n > 1 else None
    cuts = sorted(set(found or []))
    if not cuts:
        return F.lit(0)
    side = int(len(cuts) ** 0.5) + 1
    groups = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    value = F.col(column)
    passed = F.size(F.filter(F.array(*[F.lit(g[-1]) for g in groups]), lambda c: c <= value))
    sizes = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
    inside = F.coalesce(F.size(F.filter(F.get(sizes, passed), lambda c: c <= value)), F.lit(0))
    return F.when(value.isNull(), F.lit(0)).otherwise(passed * side + F.greatest(inside, F.lit(0)))


def with_next(rows: DataFrame, order: list[str], take: list[str], n: int, before: tuple[str, ...] = ()) -> DataFrame:
    """rows with next_<c> for c in take: the values of the row that follows by order (its first column a whole number, null first); after the last comes the first.

    last_<c> for c in before are the values of the row ahead, if that has the same first column, and may be null else. Each range of the first column is ordered by itself; the first row of a range also goes to the end of the range before.
    """
    ranged = rows.withColumn("__b", bucket_of(rows, order[0], n))
    firsts = ranged.groupBy("__b").agg(F.min(F.struct(*order, *take)).alias("__f"))  # one row for each range
    firsts = written(firsts)
    round_ = Window.orderBy("__b")
    wraps = firsts.select("__b").select(F.col("__b").alias("__own"), F.coalesce(F.lag("__b").over(round_), F.max("__b").over(Window.partitionBy())).alias("__to"))
    ends = firsts.join(F.broadcast(wraps), F.col("__b") == F.col("__own")).select(F.col("__to").alias("__b"), "__f.*", F.lit(True).alias("__end"))  # no more rows than ranges
    both = ranged.withColumn("__end", F.lit(False)).unionByName(ends, allowMissingColumns=True)
    following = Window.partitionBy("__b").orderBy("__end", *[F.col(c).asc_nulls_first() for c in order])
    found = [F.lead(c).over(following).alias(f"next_{c}") for c in take] + [F.lag(c).over(following).alias(f"last_{c}") for c in before]
    return both.select("*", *found).where(~F.col("__end")).drop("__b", "__end")


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_text(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def fingerprint_edits(docs: DataFrame, every: int = 50, radius: int = RADIUS) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within.

    The edited text has its last quarter replaced by the start of the next document's text. n_within is for ids
    that every divides (else null): how many other rows of docs have a fingerprint within radius. Rows with the
    same id follow one another by a hash of their text; rows that agree in id, text and next text are counted, and come out as often.
    """
    least = 2 * tasks(docs.sparkSession)
    n = min(max(least, RANGES), parts_for(docs, F.octet_length("text"), RANGE_BYTES, max(2, least)))
    rows = docs.withColumn("mark", F.xxhash64("text")).withColumn("own", F.col("doc_id"))
    rows = with_next(rows, ["doc_id", "mark"], ["text", "own"], n, ("text", "own"))
    # Of rows that agree in id and text, the last one is followed by another row, the others by their equal; of these only the first votes.
    rows = rows.withColumn("is_last", ~(F.col("own").eqNullSafe(F.col("next_own")) & F.col("text").eqNullSafe(F.col("next_text"))))
    rows = rows.withColumn("votes", F.col("is_last") | ~(F.col("own").eqNullSafe(F.col("last_own")) & F.col("text").eqNullSafe(F.col("last_text"))))
    length = F.length("text")
    quarter = F.floor(length / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), length - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = rows.select("doc_id", "mark", "is_last", "votes", length.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["doc_id", "mark", "is_last", "n_chars", "edited_sha256", "is_edited"]
    each = F.explode(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("body")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("body"))))
    bodies = rows.select(*keys[:5], "votes", each.alias("e")).select(*keys[:5], "e.is_edited", F.when(F.col("votes"), F.col("e.body")).otherwise(F.lit("")).alias("body"))
    prints = fingerprints(bodies, keys, "body")
    one = prints.groupBy(*keys[:5]).agg(F.max(F.when(~F.col("is_edited"), F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("is_edited"), F.col("fingerprint"))).alias("edited"), F.max("n_rows").alias("n_rows"))
    one = written(with_next(written(one), ["doc_id", "mark", "is_last"], ["fingerprint"], n))

    held = written(one.groupBy("fingerprint").agg(F.sum("n_rows").alias("n")))
    asked = one.where(F.col("doc_id") % every == 0).select("fingerprint").distinct()
    near = within(asked, held.select("fingerprint"), radius).join(held.select(F.col("fingerprint").alias("other"), "n"), "other")
    near = written(near.groupBy("fingerprint").agg(F.sum("n").alias("n")))
    out = join_small(one, near, ["fingerprint"], F.xxhash64("doc_id", "mark"), "left")
    # Two steps, so that no array grows with the copies of a row.
    out = out.withColumn("some", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_rows") - 1) / 4096))))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(4096).cast("long"), F.col("n_rows") - F.col("some") * 4096))))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fingerprint")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.when(F.col("doc_id") % every == 0, F.col("n") - 1).alias("n_within"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(text_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
