"""Exact deduplication by an extendible-hash index on shared files (operator 9).

The key of a text is its 64-bit hash. The directory maps the key's leading bits
to buckets: it starts with one bucket, an overfull bucket splits on its next
bit, and the directory doubles whenever a bucket needs more bits than it has.
Entries are one row for each distinct text and reading task (copies inside a
task are combined before they move), so a text that holds a third of all rows
is at most one entry a task. Each owner task takes a contiguous key range
(whole buckets), chains the entries whose keys collide and tells them apart by
comparing bytes, and writes its part of the index to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.shared import Scratch, sheltered

#: A bucket with more text than this is overfull.
BUCKET_BYTES = 8_000_000
#: The directory has at most 2 ** MAX_DEPTH slots, so the driver's share of the index is bounded. From half a terabyte of
#: distinct text on buckets grow beyond BUCKET_BYTES; owners read them sorted and one key at a time, so only their time grows.
MAX_DEPTH = 16
#: Text that a reading task holds back to combine copies.
HELD_BYTES = 24_000_000

_ENTRY = "owner int, bucket int, key long, text binary, keep_id long, copies long"
_INDEX = "bucket int, key long, chain int, text_sha256 string, keep_id long, group_size long"


class Directory:
    """Slots (leading bits of a key) -> buckets -> owners of contiguous key ranges."""

    def __init__(self, histogram: dict[int, int], max_depth: int = MAX_DEPTH, bucket_bytes: int = BUCKET_BYTES):
        """histogram: bytes by the leading ``max_depth`` bits of the keys."""
        sizes = np.zeros(1 << max_depth, dtype=np.int64)
        for slot, n in histogram.items():
            sizes[slot] = n
        below = np.concatenate([[0], np.cumsum(sizes)])
        self.depth, self.buckets = 0, []  # buckets: (first slot at max_depth, local depth, bytes)
        todo = [(0, 0)]
        while todo:
            first, local = todo.pop()
            width = 1 << (max_depth - local)
            held = int(below[first + width] - below[first])
            if held > bucket_bytes and local < max_depth:  # overfull: split on the next bit
                self.depth = max(self.depth, local + 1)  # the directory doubles if it has to
                todo += [(first + width // 2, local + 1), (first, local + 1)]
            else:
                self.buckets.append((first, local, held))
        self.slots = np.zeros(1 << self.depth, dtype=np.int32)
        for b, (first, local, _) in enumerate(self.buckets):
            at = first >> (max_depth - self.depth)
            self.slots[at : at + (1 << (self.depth - local))] = b
        owners, held = [], 0
        for _, _, n in self.buckets:  # buckets are in key order; small neighbours share an owner
            if not owners or held + n > bucket_bytes:
                owners.append(owners[-1] + 1 if owners else 0)
                held = 0
            else:
                owners.append(owners[-1])
            held += n
        self.owners = np.array(owners, dtype=np.int32)

    def bucket_of(self, keys: np.ndarray) -> np.ndarray:
        lead = keys.astype(np.int64).view(np.uint64) >> np.uint64(64 - self.depth) if self.depth else np.zeros(len(keys), dtype=np.uint64)
        return self.slots[lead.astype(np.int64)]


def _combine(directory: Directory):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[list]] = {}
        size = 0

        def emit() -> pd.DataFrame:
            rows = [(k, *e) for k, chain in held.items() for e in chain]
            out = pd.DataFrame(rows, columns=["key", "text", "keep_id", "copies"])
            out["bucket"] = directory.bucket_of(out["key"].to_numpy(np.int64))
            out["owner"] = directory.owners[out["bucket"]]
            out["keep_id"] = out["keep_id"].astype("Int64")
            return out[["owner", "bucket", "key", "text", "keep_id", "copies"]]

        for batch in batches:
            ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).tolist()
            for key, doc_id, text in zip(batch["key"].tolist(), ids, batch["text"].tolist(), strict=True):
                doc_id = None if doc_id is None else int(doc_id)
                chain = held.setdefault(key, [])
                for e in chain:
                    if e[0] == text:
                        e[1] = doc_id if e[1] is None else e[1] if doc_id is None else max(e[1], doc_id)
                        e[2] += 1
                        break
                else:
                    chain.append([text, doc_id, 1])
                    size += len(text) + 100
                if size >= HELD_BYTES:
                    yield emit()
                    held, size = {}, 0
        if held:
            yield emit()

    return run


def chain_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of entries sorted by key: one row for each distinct text, with its place in its key's chain."""
    import hashlib

    columns = [c.split()[0] for c in _INDEX.split(", ")]
    last, chain, done = None, [], []

    def close() -> None:
        done.extend((b, last, i, hashlib.sha256(t).hexdigest(), keep, n) for i, (b, t, keep, n) in enumerate(chain))

    def emit() -> pd.DataFrame:
        out = pd.DataFrame(done, columns=columns)
        done.clear()
        out["keep_id"] = out["keep_id"].astype("Int64")
        return out

    for batch in batches:
        keeps = batch["keep_id"].astype(object).where(batch["keep_id"].notna(), None).tolist()
        for bucket, key, text, keep, n in zip(batch["bucket"].tolist(), batch["key"].tolist(), batch["text"].tolist(), keeps, batch["copies"].tolist(), strict=True):
            keep = None if keep is None else int(keep)
            if key != last:
                close()
                last, chain = key, []
            for e in chain:
                if e[1] == text:
                    e[2] = keep if e[2] is None else e[2] if keep is None else max(e[2], keep)
                    e[3] += n
                    break
            else:
                chain.append([bucket, text, keep, n])
        if len(done) > 5000:
            yield emit()
    close()
    if done:
        yield emit()


def build_index(docs: DataFrame, scratch: Scratch, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index over all rows of ``docs``, written to the shared folder: ``_INDEX``."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))
    distinct = keyed.groupBy("key").agg(F.max(F.octet_length("text")).alias("n"))
    slot = F.shiftrightunsigned("key", 64 - max_depth).alias("slot")
    histogram = {r["slot"]: r["n"] for r in distinct.groupBy(slot).agg(F.sum("n").alias("n")).collect()}  # at most 2 ** max_depth rows
    directory = Directory(histogram, max_depth, bucket_bytes)
    entries = keyed.mapInPandas(_combine(directory), _ENTRY)
    owned = entries.repartitionById(int(directory.owners[-1]) + 1, F.col("owner")).sortWithinPartitions("key")
    return scratch.keep(owned.mapInPandas(chain_entries, _INDEX), "index")


def dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are not read).

    doc_id, keep_id (largest doc_id of the equal texts), group_size, kept,
    text_sha256. Null text counts as empty; texts are compared without any
    change. Repeated rows with one doc_id are all counted in group_size and all
    say kept if theirs is the largest id (``keep_rows`` leaves one of them). A
    null doc_id is never kept while its group has another. Texts of any length
    are hashed and compared whole. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    index = build_index(docs, scratch, bucket_bytes, max_depth)
    text = F.coalesce("text", F.lit(""))
    members = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("text_sha256"))
    found = members.join(index.select("key", "text_sha256", "keep_id", "group_size"), ["key", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns.

    The row with the largest doc_id stays; of rows that repeat id and text one
    does; a null id stays only where no copy has one. Null and empty texts are
    equal. Texts of any length are compared whole. An empty table gives an empty
    result. No column is touched, whatever its name.
    """
    docs, named = sheltered(docs)
    index = build_index(docs, Scratch(docs.sparkSession, "exact-dedup"))
    text = F.coalesce("text", F.lit(""))
    marked = docs.withColumns({"__key": F.xxhash64(text), "__sha": F.sha2(text, 256)})
    stay = index.select(F.col("key").alias("__key"), F.col("text_sha256").alias("__sha"), F.col("keep_id").alias("__keep"))
    same = (F.col("m.__key") == F.col("s.__key")) & (F.col("m.__sha") == F.col("s.__sha")) & F.col("m.doc_id").cast("long").eqNullSafe(F.col("s.__keep"))
    return named(marked.alias("m").join(stay.alias("s"), same, "left_semi").dropDuplicates(["__key", "__sha"]))
