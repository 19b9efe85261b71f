"""Near-duplicate vectors by lattice hashing: random projections decoded to points of the E8 lattice.

In each of several tables a unit vector is projected to BLOCKS random spaces of eight dimensions, scaled, and
decoded to the nearest E8 points; together they are its cell. Vectors in one cell are compared in full, and
each vector also looks into the cells behind the nearest walls of its own (probing).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceshift.llm.common import components, tasks, written
from paceshift.llm.shingles import mix

COSINE = 0.9
TABLES, BLOCKS, PROBES, SCALE = 12, 2, 6, 2.0
#: Members of a cell that are compared with each other in one step.
BLOCK_ROWS = 1024


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [tuple(s if k == i else t if k == j else 0.0 for k in range(8)) for i, j in combinations(range(8), 2) for s, t in product((1.0, -1.0), repeat=2)]
    halves = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


def nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of an even sum (the lattice D8)."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    rows = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    near[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is D8 and D8 moved by one half in all coordinates."""
    a, b = nearest_even(x), nearest_even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def projection(width: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([width, table])
    return random.standard_normal((width, 8 * BLOCKS)), random.random(8 * BLOCKS)


def cell_keys(points: np.ndarray, width: int, table: int) -> np.ndarray:
    key = np.full(len(points), width * 1000 + table, np.uint64)
    for column in (2 * points).astype(np.int64).astype(np.uint64).T:
        key = mix(key * np.uint64(3) + column)
    return key.view(np.int64)


def cells(units: np.ndarray, table: int, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each row, cells to probe: one column for each)."""
    matrix, moved = projection(units.shape[1], table)
    x = units @ matrix / SCALE + moved
    home = np.concatenate([decode(x[:, 8 * b : 8 * b + 8]) for b in range(BLOCKS)], axis=1)
    roots = neighbours()
    nearer = np.concatenate([(x - home)[:, 8 * b : 8 * b + 8] @ roots.T for b in range(BLOCKS)], axis=1)  # larger: less far behind the wall
    best = np.argpartition(-nearer, probes, axis=1)[:, :probes]
    steps = np.zeros((len(roots) * BLOCKS, 8 * BLOCKS))
    for b in range(BLOCKS):
        steps[b * len(roots) : (b + 1) * len(roots), 8 * b : 8 * b + 8] = roots
    keys = [cell_keys(home + steps[best[:, p]], units.shape[1], table) for p in range(probes)]
    return cell_keys(home, units.shape[1], table), np.stack(keys, axis=1) if keys else np.zeros((len(units), 0), np.int64)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id, homes (home cell by table), probes (all probed cells)."""
    for batch in batches:
        sizes = batch["vector"].map(len)
        for _, part in batch.groupby(sizes):
            for start in range(0, len(part), 2048):
                some = part.iloc[start : start + 2048]
                units = unit_rows(np.array(some["vector"].tolist(), dtype=float))
                made = [cells(units, t) for t in range(TABLES)]
                homes, probed = np.stack([m[0] for m in made], axis=1), np.concatenate([m[1] for m in made], axis=1)
                yield pd.DataFrame({"id": some["id"].to_numpy(), "homes": homes.tolist(), "probes": probed.tolist()})


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each one's component: labels follow links and each other until nothing changes."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(cosine: float):
    """Rows come by (key, step). Yields, for each member of a step: id, links found here first (by weight), an id it is linked with, and pairs
    that only probing finds (other, else null)."""

    def one(part: pd.DataFrame) -> list[tuple]:
        if len(part) < 2:
            return []
        part = part.sort_values("id", kind="stable")
        ids, left, home = part["id"].to_numpy(), part["side"].to_numpy(), part["is_home"].to_numpy()
        weights = part["n"].to_numpy()
        units = unit_rows(np.array(part["vector"].tolist(), dtype=float))
        homes = np.array(part["homes"].tolist(), dtype=np.int64)
        out: list[tuple] = []
        total, a_all, b_all = np.zeros(len(ids), np.int64), [], []
        table = int(part["t"].iloc[0])
        for start in range(0, len(ids), 512):
            rows = np.arange(start, min(start + 512, len(ids)))
            # Sides 0 and 1 are two blocks of a large cell, which meet; side 2 is within one block.
            meet = (left[rows, None] != left[None, :]) | (left[rows, None] == 2)
            near = (units[rows] @ units.T >= cosine - 1e-12) & meet & (np.arange(len(ids))[None, :] > rows[:, None]) & (home[rows, None] | home[None, :]) & (ids[rows, None] != ids[None, :])
            a, b = np.nonzero(near)
            a = rows[a]
            if not len(a):
                continue
            exact = np.einsum("ij,ij->i", units[a], units[b])
            a, b = a[exact >= cosine], b[exact >= cosine]
            same = homes[a] == homes[b]
            first = np.where(same.any(axis=1), same.argmax(axis=1), -1)
            here = (first == table) & home[a] & home[b]
            np.add.at(total, a[here], weights[b[here]])
            np.add.at(total, b[here], weights[a[here]])
            a_all.append(a[here])
            b_all.append(b[here])
            for i, j in zip(a[first < 0].tolist(), b[first < 0].tolist(), strict=True):
                out.append((ids[i], 0, ids[i], ids[j]))
        if a_all:
            root = roots_of(len(ids), np.concatenate(a_all), np.concatenate(b_all))
            out += [(ids[i], int(total[i]), ids[root[i]], None) for i in np.flatnonzero(total).tolist()]
        return out

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            found = [x for _, part in rows.groupby(["t", "key", "step"], sort=False) for x in one(part)]
            return pd.DataFrame(found, columns=["id", "found", "root", "other"]).astype({"other": "Int64"})

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = rows[["t", "key", "step"]].iloc[-1]
            open_ = ((rows["t"] == last["t"]) & (rows["key"] == last["key"]) & (rows["step"] == last["step"])).to_numpy()
            held = rows[open_]
            if (~open_).any():
                yield done(rows[~open_])
        if held is not None:
            yield done(held)

    return each


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row for each row of vectors (id, vector): id, n_links, component_id, kept.

    Cosines are computed in double precision. A vector that is null, empty or zero, or has null or non-finite
    components, links with nothing. Of rows with one id, the smallest vector counts, and all get its result; rows without an id link with nothing.
    Copies of a vector are one, with a weight. A cell with many members is compared block by block, each pair of
    blocks in a step of its own, so no cell is gathered in one task and none is cut. A pair is counted in the
    first table in which both are at home in one cell; only pairs that nothing but probing finds are written as
    pairs. Vectors of different lengths never link.
    """
    spark = vectors.sparkSession
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    usable = rows.where(F.col("id").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))
    single = usable.groupBy("id").agg(F.min("vector").alias("vector"))
    same = written(single.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    member = single.select(F.col("id").alias("member"), "vector").join(same.select("id", "vector", "n"), "vector").select("member", "id", "n")

    placed = written(same.select("id", "vector").mapInPandas(place, "id long, homes array<long>, probes array<long>"))
    at_home = placed.select("id", F.posexplode("homes").alias("t", "key")).withColumn("is_home", F.lit(True))
    probing = placed.select("id", F.posexplode("probes").alias("p", "key")).select("id", F.floor(F.col("p") / PROBES).cast("int").alias("t"), "key").withColumn("is_home", F.lit(False))
    looks = at_home.union(probing)
    full = looks.groupBy("t", "key").agg(F.sum(F.col("is_home").cast("int")).alias("at_home"), F.count("*").alias("members")).where("at_home > 0 AND members > 1")
    full = full.select("t", "key", F.ceil(F.col("members") / BLOCK_ROWS).cast("int").alias("blocks"))
    looks = looks.join(full, ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Step (i, j), i <= j, compares block i with block j; a row takes part in each step of its block.
    steps = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(
            (F.least("block", o).cast("long") * (1 << 31) + F.greatest("block", o)).alias("step"),
            F.when(F.col("block") == o, F.lit(2)).when(F.col("block") < o, F.lit(0)).otherwise(F.lit(1)).alias("side"),
        ),
    )
    looks = looks.select("id", "t", "key", "is_home", F.explode(steps).alias("s")).select("id", "t", "key", "is_home", "s.step", "s.side")
    data = same.join(placed.select("id", "homes"), "id")
    work = looks.join(data, "id").repartition(tasks(spark) * 2, "t", "key", "step").sortWithinPartitions("t", "key", "step")
    found = written(work.mapInPandas(compare(cosine), "id long, found long, root long, other long"))

    probed = written(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct())
    weights = same.select(F.col("id").alias("w_id"), "n")
    both = probed.union(probed.select("b", "a")).join(weights, F.col("b") == F.col("w_id")).select(F.col("a").alias("id"), F.col("n").alias("found"))
    counts = found.where("other IS NULL").select("id", "found").union(both).groupBy("id").agg(F.sum("found").alias("found"))
    links = found.where("other IS NULL AND root <> id").select(F.col("root").alias("a"), F.col("id").alias("b")).union(probed)
    label = components(same, links.distinct())
    out = member.join(counts, "id", "left").join(label, "id", "left").select("member", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    out = rows.select("id").join(out, F.col("id") == F.col("member"), "left")
    out = out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return near_vectors(rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))).withColumnRenamed("id", "vec_id")
