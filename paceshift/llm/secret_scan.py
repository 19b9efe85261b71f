"""Secrets in texts: three fixed patterns, and a battery of randomness tests for what no pattern names.

A candidate is a long run of base-64 characters. Its encoding is inferred (digits, hex, base 32, letters, letters and digits, base 64),
and three tests ask whether its characters look like independent uniform draws from that alphabet: chi-squared
for uniformity, the number of runs above and below the middle, and serial correlation. Fisher's method combines
the three p values. Words pass such tests too when they are short, so candidates of letters alone serve as the
known negatives: the share of them, up to the candidate's length, that look at least as random is the
candidate's p value, and a step-up procedure in each class of length keeps the share of false discoveries down.
Each different string counts once, however many copies it has, and all its copies share its fate. Where too few
negatives are known to tell anything, letters drawn by their shares in English text are added to them.
All of it is in SQL functions.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceshift.llm.common import text_of, written

#: Kind, pattern, group whose length counts, least length. Fixed values, as the query defines them.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # a run is one match, so shorter ones need not be found first
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ORDER = [*KINDS, "random"]
#: Alphabets in the order in which they are tried: name, its characters as a pattern, as a list, and whether it is letters alone.
LOWER = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = [
    ("digits", r"^[0-9]+$", "0123456789"),
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("hex", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower", r"^[a-z]+$", LOWER),
    ("letters", r"^[A-Za-z]+$", LOWER.upper() + LOWER),
    ("base32", r"^[A-Z2-7]+$", LOWER.upper() + "234567"),
    ("alnum", r"^[A-Za-z0-9]+$", LOWER.upper() + LOWER + "0123456789"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", LOWER.upper() + LOWER + "0123456789+/"),
    ("base64url", r"", LOWER.upper() + LOWER + "0123456789-_+/="),
]
#: Share of false discoveries, cells of the combined p value, length classes to an octave.
FALSE_SHARE, CELLS, PER_OCTAVE = 0.05, 1000, 4
#: Drawn negatives of a class with too few known ones, their greatest length (longer text looks less random), shares of a to z in a thousand.
DRAWN, DRAWN_LENGTH = 1000, 256
SHARES = [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1]


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic in z and z^3 (error below 2e-4)."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def randomness(body: Column) -> Column:
    """Combined p value of the three tests; near 0 for what is not random."""
    letters = reduce(lambda rest, a: F.when(body.rlike(a[1]) if a[1] else F.lit(True), F.lit(a[2])).otherwise(rest), reversed(ALPHABETS), F.lit(""))
    characters = F.filter(F.split(body, "", -1), lambda c: c != "")
    symbols = F.filter(F.transform(characters, lambda c: F.instr(letters, c) - 1), lambda v: v >= 0)
    found = F.struct(symbols.alias("v"), F.length(letters).cast("double").alias("k"))

    def tests(x: Column) -> Column:
        v, k = x["v"], x["k"]
        n = F.size(v).cast("double")
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda a, s: a + F.pow(F.size(F.filter(v, lambda w: w == s)).cast("double"), 2.0))
        ratio = (k / n * squares - n) / (k - 1)
        uniform = tail((F.cbrt(ratio) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1))))
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        high = F.size(F.filter(v, lambda s: s * 2 >= k)).cast("double")
        runs = F.size(F.filter(pairs, lambda p: (p["a"] * 2 >= k) != (p["b"] * 2 >= k))) + 1.0
        mean = 2 * high * (n - high) / n + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.05)))
        two = lambda z: F.least(F.lit(1.0), 2 * tail(F.abs(z)))
        middle = F.aggregate(v, F.lit(0.0), lambda a, s: a + s) / n
        power = F.aggregate(v, F.lit(0.0), lambda a, s: a + (s - middle) * (s - middle))
        lagged = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - middle) * (p["b"] - middle))
        serial = F.when(power > 0, two((lagged / power + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-6))
        half = -(F.log(uniform) + F.log(two((runs - mean) / spread)) + F.log(serial))
        return F.exp(-half) * (1 + half + half * half / 2)

    return F.element_at(F.transform(F.array(found), tests), 1)


def matches(docs: DataFrame, kinds: dict[str, tuple[str, int, int]], describe: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, mark, kind, start, end, about): matches in code points, leftmost and not overlapping within a kind.

    about is what describe makes of the match, where the text is read and before anything is shuffled (else null).

    mark tells texts of the same doc_id apart. Pieces between matches and matches alternate, so running sums of
    their lengths over a text's matches give the places.
    """
    some = reduce(lambda a, b: a | b, [F.col("text").rlike(p) for p, _, _ in kinds.values()])
    per_kind = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(least).alias("least"),
            F.arrays_zip(
                F.split("text", pattern, -1).alias("piece"),
                F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("match"),
                F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("counted"),
            ).alias("found"),
        )
        for kind, (pattern, group, least) in kinds.items()
    ]
    rows = docs.where(some).select("doc_id", F.xxhash64("text").alias("mark"), F.explode(F.array(*per_kind)).alias("k"))
    rows = rows.select("doc_id", "mark", "k.kind", "k.least", F.posexplode("k.found").alias("at", "x")).where("x.match IS NOT NULL")
    rows = rows.select("doc_id", "mark", "kind", "at", F.length("x.piece").alias("before"), F.length("x.match").alias("n"),
                       (F.length("x.counted") >= F.col("least")).alias("kept"), (describe(F.col("x.match")) if describe else F.lit(None).cast("string")).alias("about"))
    rows = rows.dropDuplicates(["doc_id", "mark", "kind", "at"])  # rows that repeat in full
    upto = Window.partitionBy("doc_id", "mark", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("before") + F.col("n")).over(upto)).where("kept")
    return rows.select("doc_id", "mark", "kind", (F.col("end") - F.col("n")).alias("start"), "end", "about")


def discoveries(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """Candidates that stay (doc_id, mark, kind random, start, end)."""
    about = lambda body: F.struct(randomness(body).alias("p"), body.rlike("^[A-Za-z]+$").alias("word"), F.xxhash64(body).alias("own"))
    found = matches(docs, {"random": (CANDIDATE, 0, 16)}, about).select("doc_id", "mark", "start", "end", "about.*")
    scored = found.withColumn("size", F.floor(F.log2(F.col("end") - F.col("start")) * PER_OCTAVE).cast("int"))
    scored = written(scored.select("doc_id", "mark", "start", "end", "size", cell_of(F.col("p")).alias("cell"), "word", "own"))
    # At most CELLS rows for each class of length, and texts of up to a gigabyte have 4 * 30 such classes. Copies of a string count once.
    cells = scored.select("size", "cell", "word", "own").distinct().groupBy("size", "cell", "word").agg(F.count("*").alias("n")).collect()
    cells = [(r["size"], r["cell"], r["word"], r["n"]) for r in cells]
    drawn = drawn_negatives(docs.sparkSession, poor_classes(cells, false_share))
    least = least_cells(cells, false_share, drawn)
    if not least:
        return scored.where("false").select("doc_id", "mark", F.lit("random").alias("kind"), "start", "end")
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("size"))
    kept = scored.where(~F.col("word") & (F.col("cell") >= limit))
    return kept.select("doc_id", "mark", F.lit("random").alias("kind"), "start", "end")


def cell_of(p: Column) -> Column:
    return F.least(F.floor(p * CELLS), F.lit(CELLS - 1)).cast("int")


def poor_classes(cells: list[tuple[int, int, bool, int]], false_share: float) -> list[int]:
    """Classes with candidates in which even no negative among the known ones would not be enough for a discovery."""
    known = lambda size: sum(n for s, _, word, n in cells if word and s <= size)
    return [size for size in sorted({c[0] for c in cells if not c[2]}) if (1 + known(size)) * false_share < 1]


def drawn_negatives(spark: SparkSession, sizes: list[int]) -> dict[int, list[int]]:
    """By class of length, how many of DRAWN strings of its least length fall in each cell. Letters are independent, by their shares in English text."""
    if not sizes:
        return {}
    rows = []
    for size in sizes:
        draw, length = random.Random(size), min(DRAWN_LENGTH, math.ceil(2 ** (size / PER_OCTAVE)))
        rows += [(size, "".join(draw.choices(LOWER, SHARES, k=length))) for _ in range(DRAWN)]
    found = spark.createDataFrame(rows, "size int, body string").select("size", cell_of(randomness(F.col("body"))).alias("cell"))
    drawn = {size: [0] * CELLS for size in sizes}
    for r in found.groupBy("size", "cell").agg(F.count("*").alias("n")).collect():
        drawn[r["size"]][r["cell"]] = r["n"]
    return drawn


def least_cells(cells: list[tuple[int, int, bool, int]], false_share: float, drawn: dict[int, list[int]] | None = None) -> dict[int, int]:
    """By class of length, the lowest cell that is a discovery (step-up procedure). cells: (class, cell, is a word, different strings).

    Known negatives of a class are the words of that length or shorter: a test has less power on short text, so
    they look more random than longer ones would. drawn has further ones of a class by cell. Without any, nothing is claimed.
    """
    words, least = [0] * CELLS, {}
    for size in sorted({c[0] for c in cells}):
        others = [0] * CELLS
        for s, cell, word, n in cells:
            if s == size:
                (words if word else others)[cell] += n
        null = [a + b for a, b in zip(words, (drawn or {}).get(size, [0] * CELLS), strict=True)]
        total, m, negatives, found = sum(null), sum(others), 0, 0
        for cell in reversed(range(CELLS)):
            negatives, found = negatives + null[cell], found + others[cell]
            if found and (1 + negatives) / (1 + total) * m <= false_share * found:
                least[size] = cell
    return least


def find_secrets(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """(doc_id, mark, kind, start, end) of docs (doc_id, text): spans of the patterns and of random strings.

    Null and empty texts have none. mark is a hash of the text. Rows that repeat in full are found once.
    """
    base = matches(docs, KINDS).select("doc_id", "mark", "kind", "start", "end")
    return base.unionByName(discoveries(docs, false_share))


def scan(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    place = reduce(lambda rest, k: F.when(F.col("kind") == k, F.lit(ORDER.index(k))).otherwise(rest), ORDER, F.lit(-1))
    spans = find_secrets(docs, false_share).select(F.col("doc_id").alias("id"), "mark", F.struct("start", place.alias("place"), F.concat_ws(":", "kind", "start", "end").alias("span")).alias("s"))
    each = spans.groupBy("id", "mark").agg(F.array_sort(F.collect_list("s")).alias("s"))  # of one text
    base = F.filter("s", lambda x: x["place"] < len(KINDS))
    is_kind = lambda k: lambda x: x["place"] == ORDER.index(k)
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda x: x["span"]))
    counts = [F.size(F.filter("s", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    each = each.select("id", "mark", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("own"))
    out = rows.join(each, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("mark")), "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
                      F.coalesce("base_sha256", none).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", false_share: float = FALSE_SHARE) -> DataFrame:
    """docs (doc_id, text, others) with each secret in text replaced by mask; spans that touch or overlap become one."""
    found = find_secrets(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), false_share)
    order = Window.partitionBy("doc_id", "mark").orderBy("start", "end", "kind")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    found = found.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.groupBy("doc_id", "mark", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    found = found.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    rows = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__mark")), "left")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("__spans", lambda s: s["end"]))
    ends = F.concat(F.transform("__spans", lambda s: s["start"]), F.array(F.length("text").cast("long")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.substring(F.col("text"), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.array_join(pieces, mask))
    return rows.withColumn("text", text).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(text_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
