"""Exact copies, by an extendible-hash index on shared files.

The key of a text is 64 bits of a cryptographic hash, so keys are spread evenly whatever the texts are. The first bits name an
owner task, which processes the texts of its range of keys; the next bits go through the owner's directory to a bucket. A bucket that
holds too many bytes is split by one more bit, and where it already uses all bits of the directory, the directory doubles. Texts
whose keys agree stand in one chain, where bytes are compared. The buckets are written to the shared folder, and rows find there which row of their text stays.

Texts are combined before they move: a map task names each of its different texts once, in runs of bounded size. Texts that
very many runs name are first combined in groups of those runs, so that no owner receives more than a bounded number of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceshift.llm.common import parts_for, stored, tasks, text_of
from paceshift.operators.reuse import shared_folder

#: A text is compared without these. Fixed values, as the query defines them.
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of different texts, and rows, in one run of a map task.
RUN_BYTES, RUN_ROWS = 32 << 20, 1 << 16
#: Bytes of texts in the range of keys of one owner, and in a bucket.
OWNER_BYTES, BUCKET_BYTES = 32 << 20, 1 << 20
#: Runs that may name a text (of any length that an owner can hold so often) before their copies are combined in groups.
HEAVY = 256

ENTRY = "run long, no long, key long, sha256 binary, text binary, n_bytes long, copies long, best_size long, best_id long, best_run long, best_nth long"
RUN_SCHEMA = f"entry boolean, nth long, doc_id long, {ENTRY}"
SETTLED = f"{ENTRY}, to_run long, to_no long, bucket string, chain int"
BITS = (1 << 64) - 1


class Record:
    """A text in the index, with the rows that it stands for."""

    __slots__ = ("best", "chain", "copies", "first", "key", "text")

    def __init__(self, key: int, text: bytes, chain: int, first: int):
        self.key, self.text, self.chain, self.first, self.copies, self.best = key, text, chain, first, 0, None


class Bucket:
    """Chains of records by key, for all keys that share the first depth bits after the owner's."""

    def __init__(self, depth: int, prefix: int):
        self.depth, self.prefix, self.bytes, self.chains = depth, prefix, 0, {}

    def find_or_add(self, key: int, text: bytes, place: int) -> tuple[Record, bool]:
        chain = self.chains.setdefault(key, [])
        for record in chain:
            if record.text == text:
                return record, False
        chain.append(Record(key, text, len(chain), place))
        self.bytes += len(text) + 64
        return chain[-1], True


class Directory:
    """Extendible hashing: 2^depth entries, each a bucket that all entries with its prefix share. Keys have 64 bits, of which the first are the owner's."""

    def __init__(self, owner_bits: int = 0, bucket_bytes: int = BUCKET_BYTES):
        self.owner_bits, self.bucket_bytes = owner_bits, bucket_bytes
        self.depth, self.entries = 0, [Bucket(0, 0)]

    def place(self, key: int, depth: int) -> int:
        return ((key << self.owner_bits) & BITS) >> (64 - depth) if depth else 0

    def find_or_add(self, key: int, text: bytes, place: int) -> Record:
        bucket = self.entries[self.place(key, self.depth)]
        record, new = bucket.find_or_add(key, text, place)
        # One chain cannot be split; it stays in a bucket of its own, however large.
        while new and bucket.bytes > self.bucket_bytes and len(bucket.chains) > 1 and bucket.depth < 64 - self.owner_bits:
            bucket = self.split(bucket, key)
        return record

    def split(self, bucket: Bucket, key: int) -> Bucket:
        """Deal the bucket's chains to two by their next bit. Returns the one that key is in."""
        if bucket.depth == self.depth:
            self.entries = [b for b in self.entries for _ in range(2)]
            self.depth += 1
        halves = [Bucket(bucket.depth + 1, 2 * bucket.prefix + bit) for bit in (0, 1)]
        for k, chain in bucket.chains.items():
            half = halves[self.place(k, bucket.depth + 1) & 1]
            half.chains[k] = chain
            half.bytes += sum(len(r.text) + 64 for r in chain)
        wide = 1 << (self.depth - bucket.depth - 1)
        for bit, half in enumerate(halves):
            low = (2 * bucket.prefix + bit) * wide
            self.entries[low : low + wide] = [half] * wide
        return halves[self.place(key, bucket.depth + 1) & 1]

    def name(self, key: int) -> str:
        """The bits that lead to the bucket of a key, after the owner's."""
        bucket = self.entries[self.place(key, self.depth)]
        return format(bucket.prefix, f"0{bucket.depth}b") if bucket.depth else ""


def rank(size: int, doc_id: int | None, run: int, nth: int) -> tuple:
    """Of equal texts the row with the smallest rank stays: most code points, then smallest id (none last), then the first as read."""
    return -size, doc_id is None, doc_id or 0, run, nth


def named_runs(run_bytes: int, run_rows: int, key_bits: int):
    """Each row as a member of a run, and each different text of a run as one entry."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 24
        found: dict[bytes, list] = {}
        members: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns: dict[str, list] = {c.split()[0]: [] for c in RUN_SCHEMA.split(", ")}
            for nth, (no, doc_id) in enumerate(members):
                for c, v in (("entry", False), ("nth", nth), ("doc_id", doc_id), ("run", run), ("no", no)):
                    columns[c].append(v)
            for text, (no, copies, best) in found.items():
                sha = hashlib.sha256(text).digest()
                key = int.from_bytes(sha[:8], "big") >> (64 - key_bits) << (64 - key_bits)
                row = {"entry": True, "run": run, "no": no, "key": key - (1 << 64) if key >> 63 else key, "sha256": sha, "text": text, "n_bytes": len(text) + 64}
                row |= {"copies": copies, "best_size": -best[0], "best_id": None if best[1] else best[2], "best_run": run, "best_nth": best[4]}
                for c, v in row.items():
                    columns[c].append(v)
            rows = len(columns["entry"])
            kinds = {"entry": pa.bool_(), "sha256": pa.binary(), "text": pa.binary()}
            arrays = [pa.array([None] * (rows - len(v)) + v if c not in ("nth", "doc_id") else v + [None] * (rows - len(v)), kinds.get(c, pa.int64())) for c, v in columns.items()]
            return pa.RecordBatch.from_arrays(arrays, list(columns))

        for batch in batches:
            ids, sizes, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, (doc_id, size) in enumerate(zip(ids, sizes, strict=True)):
                text = raws[i].as_py().translate(None, BLANKS)
                best = rank(size, doc_id, run, len(members))
                entry = found.get(text)
                if entry is None:
                    entry = found[text] = [len(found), 0, best]
                    held += len(text)
                entry[1] += 1
                entry[2] = min(entry[2], best)
                members.append((entry[0], doc_id))
                if held >= run_bytes or len(members) >= run_rows:
                    yield flush()
                    run, held = run + 1, 0
                    found.clear()
                    members.clear()
        if members:
            yield flush()

    return each


def settle(owner_bits: int, bucket_bytes: int):
    """Index the entries of one group. Each entry learns which entry stands for its text; that one has the sum of copies and the best row."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["run", "no"], ignore_index=True)
        directory = Directory(owner_bits, bucket_bytes)
        keys = [k & BITS for k in rows["key"].tolist()]
        ids = [None if pd.isna(x) else int(x) for x in rows["best_id"]]
        records = []
        for i, (key, text, copies, size, run, nth) in enumerate(zip(keys, rows["text"], rows["copies"], rows["best_size"], rows["best_run"], rows["best_nth"], strict=True)):
            record = directory.find_or_add(key, text, i)
            best = rank(size, ids[i], run, nth)
            record.copies += copies
            record.best = best if record.best is None else min(record.best, best)
            records.append(record)
        first = [r.first for r in records]
        own = [r.first == i for i, r in enumerate(records)]
        out = rows.assign(
            text=[t if mine else None for t, mine in zip(rows["text"], own, strict=True)], copies=[r.copies for r in records], best_size=[-r.best[0] for r in records],
            best_id=pd.array([None if r.best[1] else r.best[2] for r in records], "Int64"), best_run=[r.best[3] for r in records], best_nth=[r.best[4] for r in records],
            to_run=rows["run"].to_numpy()[first], to_no=rows["no"].to_numpy()[first], bucket=[directory.name(k) for k in keys], chain=[r.chain for r in records],
        )
        return out[[c.split()[0] for c in SETTLED.split(", ")]]

    return each


def exact_copies(
    docs: DataFrame, run_bytes: int = RUN_BYTES, run_rows: int = RUN_ROWS, owner_bytes: int = OWNER_BYTES, bucket_bytes: int = BUCKET_BYTES, heavy: int = HEAVY, key_bits: int = 64
) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, and sha256 (binary) of the text without white space.

    Texts that are equal without ASCII white space are a group; null texts are empty, and empty texts a group. One row of each group stays: the one with the most code
    points, then the smallest id, no id last. Of rows that tie in all of that, the first as read stays. keep_id is null where only rows without an id are in
    the group. Fewer key_bits make keys agree, which tests use. Runs jobs when called.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    given = text_of(docs).select("doc_id", F.length("text").cast("long"), F.col("text").cast("binary"))
    runs = stored(given.mapInArrow(named_runs(run_bytes, run_rows, key_bits), RUN_SCHEMA), f"{folder}/runs")
    level = runs.where("entry").drop("entry", "nth", "doc_id")
    forwards: list[DataFrame] = []
    while True:
        counted = level.groupBy("key", "sha256").agg(F.count("*").alias("n"), F.max("n_bytes").alias("each"))
        crowded = counted.where((F.col("n") > heavy) | (F.col("n") > 2) & (F.col("n") * F.col("each") > 2 * owner_bytes))
        crowded = stored(crowded, f"{folder}/crowded{len(forwards)}")
        if crowded.isEmpty():
            break
        together = F.least(F.lit(max(2, heavy // 2)), F.greatest(F.lit(2), F.floor(F.lit(owner_bytes) / F.col("each"))))
        group = F.pmod(F.xxhash64("run", "no"), F.ceil(F.col("n") / together)).alias("group")
        mixed = level.join(crowded, ["key", "sha256"]).select(level["*"], group).groupBy("key", "sha256", "group").applyInPandas(settle(0, bucket_bytes), SETTLED)
        mixed = stored(mixed, f"{folder}/combined{len(forwards)}")
        mine = (F.col("to_run") == F.col("run")) & (F.col("to_no") == F.col("no"))
        forwards.append(mixed.where(~mine).select("run", "no", "to_run", "to_no"))
        level = level.join(crowded, ["key", "sha256"], "left_anti").unionByName(mixed.where(mine).drop("to_run", "to_no", "bucket", "chain"))
    parts = parts_for(level, F.col("n_bytes"), owner_bytes, 4 * tasks(spark))
    owner_bits = parts.bit_length()
    owned = level.withColumn("owner", F.shiftrightunsigned("key", 64 - owner_bits)).repartition(max(2 * tasks(spark), parts // 8), "owner")
    index = stored(owned.groupBy("owner").applyInPandas(settle(owner_bits, bucket_bytes), SETTLED), f"{folder}/index")
    answer = ["copies", "best_id", "best_run", "best_nth", "sha256"]
    answers = index.select("run", "no", *answer)
    for forward in reversed(forwards):
        found = answers.select(F.col("run").alias("to_run"), F.col("no").alias("to_no"), *answer)
        answers = answers.unionByName(forward.join(found, ["to_run", "to_no"]).select("run", "no", *answer))
    rows = runs.where("NOT entry").select("run", "no", "nth", "doc_id").join(answers, ["run", "no"])
    kept = (F.col("run") == F.col("best_run")) & (F.col("nth") == F.col("best_nth"))
    return rows.select("doc_id", F.col("best_id").alias("keep_id"), F.col("copies").alias("group_size"), kept.alias("kept"), "sha256")


def query(spark, sf_dir: str) -> DataFrame:
    out = exact_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


ORACLE = """
    WITH plain AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm FROM documents),
         ranked AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST, text) AS place FROM plain)
    SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY place) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
           place = 1 AS kept, sha256(norm) AS text_sha256
    FROM ranked"""
