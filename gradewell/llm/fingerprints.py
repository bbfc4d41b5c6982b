"""Fingerprints of texts by a randomised edit embedding (operator 11).

A walk goes over a text's characters and writes one character a step: at each
step a bit that all texts share, chosen by the step and the character, says
whether the walk stays or goes on to the next character. Two walks over texts
that differ by an edit fall into step again soon after it, so edit distance
becomes Hamming distance of what is written. Of that, fixed places are sampled,
as many in each octave of steps, and each gives one hashed bit; weighted by the
octaves' extent, the sampled bits estimate the Hamming distance of the whole at
any length. ``similar_documents`` draws bands of such bits, and verifies all
pairs of a band's bucket on their whole fingerprints.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.bytehash import mix
from gradewell.llm.components import components
from gradewell.llm.embeddings import crossing, forest
from gradewell.llm.shared import Scratch

#: The shared bits repeat after so many steps, and characters share them by classes.
PERIOD, CLASSES = 4096, 256
#: Steps of the first octave, bits sampled of each, and the most octaves (a text of 2 ** 32 characters).
FIRST, SAMPLES, OCTAVES = 8, 128, 32
#: Characters that are walked over at a time; with fewer texts than NARROW left, walks go one by one.
BATCH_CHARS, NARROW = 4_000_000, 48
#: Characters that are turned into classes at a time.
PIECE_CHARS = 1_000_000
#: Text that a task of the ordered documents reads, in bytes.
PARTITION_BYTES = 32_000_000
#: Bits of a band, the chance that a pair just similar enough shares none, and the rows of a tile's side.
BAND_BITS, MISS, TILE = 14, 1e-4, 1024

_STEP, _BIT, _BAND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
_PRINT_SQL = "doc_id long, n_chars long, steps long, bits binary"
_REPORT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_REPORT_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
REPORT = [name for name, _ in _REPORT]


@cache
def stays() -> np.ndarray:
    """For each class and step: for how many steps a walk that comes to such a character stays there."""
    ones = mix(np.arange(CLASSES * PERIOD, dtype=np.uint64) * _STEP + _STEP).reshape(CLASSES, PERIOD) >> np.uint64(63) == 1
    at = np.where(np.concatenate([ones, ones], axis=1), np.arange(2 * PERIOD), 2 * PERIOD)
    following = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
    return (following - np.arange(PERIOD) + 1).astype(np.uint8)


@cache
def _stays_of_class() -> list[bytes]:
    return [row.tobytes() for row in stays()]


@cache
def places() -> np.ndarray:
    """The sampled steps of each octave, ascending: (octave, sample)."""
    k = np.arange(SAMPLES, dtype=np.float64)
    within = (mix(np.arange(OCTAVES * SAMPLES, dtype=np.uint64) * _BIT + _STEP) >> np.uint64(11)).astype(np.float64).reshape(OCTAVES, SAMPLES) / 2.0**53
    low = np.array([0, *(FIRST << k for k in range(OCTAVES - 1))], dtype=np.int64)
    size = np.array([FIRST, *(FIRST << k for k in range(OCTAVES - 1))], dtype=np.int64)
    return low[:, None] + np.floor((k + within) * size[:, None] / SAMPLES).astype(np.int64)


@cache
def _bit_of() -> np.ndarray:
    """The bit that a sample gives for a character's class; the last class is the end of the text."""
    return (mix(np.arange(OCTAVES * SAMPLES * (CLASSES + 1), dtype=np.uint64) * _BIT + _BIT) & np.uint64(1)).astype(np.uint8).reshape(OCTAVES * SAMPLES, CLASSES + 1)


def classes(text: str) -> np.ndarray:
    """The class of each code point, a piece of the text at a time; those below 256 have classes of their own."""
    out = []
    for at in range(0, len(text), PIECE_CHARS):
        points = np.frombuffer(text[at : at + PIECE_CHARS].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        out.append(((points ^ (points >> 8) * 157) & 255).astype(np.uint8))
    return np.concatenate([*out, np.zeros(0, np.uint8)])


def walk(texts: list[np.ndarray], steps: list[int] | None = None) -> list[np.ndarray]:
    """For how many steps a walk stays at each character, for each text; a walk begins at step 0 or where ``steps`` says."""
    if not texts:
        return []
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    read = np.concatenate([*texts, np.zeros(0, np.uint8)])
    out, table = np.zeros(len(read), dtype=np.uint8), stays().reshape(-1)
    order = np.argsort(-lengths, kind="stable")
    at, step = (ends - lengths)[order], (np.zeros(len(texts), np.int64) if steps is None else np.array(steps, dtype=np.int64) % PERIOD)[order]
    sorted_lengths = lengths[order]
    alive, done = int(np.count_nonzero(sorted_lengths)), 0
    while alive >= NARROW:
        until = int(sorted_lengths[alive - 1])  # the shortest that is left
        a, j = at[:alive], step[:alive]
        for _ in range(done, until):
            stay = table[read[a].astype(np.int64) * PERIOD + j]
            out[a] = stay
            j += stay
            j &= PERIOD - 1
            a += 1
        done = until
        alive = int(np.count_nonzero(sorted_lengths > done))
    rows = _stays_of_class()
    for k in range(alive):
        j, stayed = int(step[k]), bytearray()
        begin, end = int(at[k]), int(ends[order[k]])
        for c in read[begin:end].tobytes():
            s = rows[c][j]
            stayed.append(s)
            j = (j + s) & (PERIOD - 1)
        out[begin:end] = np.frombuffer(stayed, dtype=np.uint8)
    return np.split(out, ends[:-1])


def octaves(steps: int) -> int:
    """How many octaves so many steps reach into."""
    return 0 if not steps else max(1, math.ceil(math.log2(steps / FIRST)) + 1)


def sample(written: np.ndarray) -> bytes:
    """The sampled bits of what a walk has written (classes)."""
    n = octaves(len(written))
    if not n:
        return b""
    at = places()[:n].reshape(-1)
    inside = np.searchsorted(at, len(written))  # octaves follow each other and samples ascend
    found = np.full(len(at), CLASSES, dtype=np.int64)
    found[:inside] = written[at[:inside]]
    return np.packbits(_bit_of()[np.arange(len(at)), found]).tobytes()


def fingerprint(steps: int, bits: bytes) -> str:
    """Steps of the walk, and the sampled bits in hexadecimal."""
    return f"{steps}:{bits.hex()}"


def parse(text: str) -> tuple[int, bytes]:
    steps, bits = text.split(":")
    return int(steps), bytes.fromhex(bits)


class Prints:
    """Fingerprints side by side: bits (row, octave, two words), which of them count, and what extent each octave has."""

    def __init__(self, found: list[tuple[int, bytes]], width: int):
        self.steps = np.array([s for s, _ in found], dtype=np.int64)
        size = SAMPLES // 8
        data = b"".join(b.ljust(width * size, b"\0")[: width * size] for _, b in found)
        self.bits = np.frombuffer(data, dtype=np.uint64).reshape(len(found), width, 2)
        self.has = np.array([len(b) // size for _, b in found], dtype=np.int64)[:, None] > np.arange(width)
        low = np.array([0, *(FIRST << k for k in range(width - 1))][:width], dtype=np.int64)
        high = np.array([FIRST << k for k in range(width)], dtype=np.int64)
        self.extent = np.clip(np.minimum(self.steps[:, None], high) - low, 0, None)
        counted = np.packbits(places()[None, :width] < self.steps[:, None, None], axis=2)
        self.mask = np.ascontiguousarray(counted).view(np.uint64).reshape(len(found), width, 2)

    def likeness(self, rows: np.ndarray | int, other: Prints, columns: np.ndarray) -> np.ndarray:
        """Of rows here and rows there: 1 for equal bits, about 0 for bits that agree by chance."""
        mask = self.mask[rows] | other.mask[columns]
        counted = np.bitwise_count(mask).sum(axis=2, dtype=np.int64)
        differ = np.bitwise_count((self.bits[rows] ^ other.bits[columns]) & mask).sum(axis=2, dtype=np.int64)
        weight = np.maximum(self.extent[rows], other.extent[columns]) * (counted > 0)
        agree = np.where(self.has[rows] & other.has[columns], 1 - 2 * differ / np.maximum(counted, 1), 0.0)
        total = weight.sum(axis=1)
        return np.where(total > 0, np.clip((weight * agree).sum(axis=1) / np.maximum(total, 1), 0, 1), 1.0)


def likenesses(a: list[tuple[int, bytes]], b: list[tuple[int, bytes]]) -> list[float]:
    """The likeness of each fingerprint of ``a`` to that of ``b`` at its place."""
    if not a:
        return []
    width = max(1, *(octaves(s) for s, _ in [*a, *b]))
    at = np.arange(len(a))
    return Prints(a, width).likeness(at, Prints(b, width), at).tolist()


def prints_of(texts: list[str]) -> list[tuple[int, bytes]]:
    read = [classes(t) for t in texts]
    written = (np.repeat(c, s) for c, s in zip(read, walk(read), strict=True))
    return [(len(w), sample(w)) for w in written]


def edited_prints(texts: list[str], following: list[str]) -> list[tuple]:
    """Rows of the report (without ids): each text, its edited text, and the text that follows.

    The edited text begins like the text, so its walk goes on from there.
    """
    read = [classes(t) for t in texts]
    cuts = [len(t) // 3 for t in texts]
    tails = [classes(f[:k]) for f, k in zip(following, cuts, strict=True)]
    stayed = walk(read)
    heads = [int(s[: len(s) - k].sum(dtype=np.int64)) for s, k in zip(stayed, cuts, strict=True)]
    own, edited = [], []
    for c, s, head, tail, tail_stayed in zip(read, stayed, heads, tails, walk(tails, heads), strict=True):
        written = np.repeat(c, s)
        own.append((len(written), sample(written)))
        written = np.concatenate([written[:head], np.repeat(tail, tail_stayed)])
        edited.append((len(written), sample(written)))
    # the texts that follow are the next of these, but for the last
    after = [*own[1:], *prints_of(following[-1:])]
    digests = [hashlib.sha256((t[: len(t) - k] + f[:k]).encode("utf-8", "surrogatepass")).hexdigest() for t, k, f in zip(texts, cuts, following, strict=True)]
    near = zip(likenesses(own, edited), likenesses(own, after), strict=True)
    return [(len(t), d, fingerprint(*x), fingerprint(*y), e, n) for t, d, x, y, (e, n) in zip(texts, digests, own, edited, near, strict=True)]


def _fingerprint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        size = batch["text"].str.len().cumsum() // BATCH_CHARS
        for _, part in batch.groupby(size.to_numpy(), sort=False):
            texts = part["text"].tolist()
            rows = [(len(t), steps, bits) for t, (steps, bits) in zip(texts, prints_of(texts), strict=True)]
            out = pd.DataFrame(rows, columns=["n_chars", "steps", "bits"])
            out.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
            yield out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, steps and bits of each row's whole text; ``fingerprint`` writes the two as one string.

    Null texts are empty ones, whose walk has no steps and no bits. Equal texts
    have equal fingerprints. Texts of any length are walked over whole.
    """
    return _texts(docs).mapInPandas(_fingerprint, _PRINT_SQL)


_ENDS = pa.schema([*_REPORT, ("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string())])
_WHOLE, _HEAD, _TAIL = 0, 1, 2


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of the rows of an ordered partition that another one follows there; and its first and its last row."""
    part, first = TaskContext.get().partitionId(), True
    ids: list[int | None] = []
    texts: list[str] = []

    def report(upto: int) -> pa.RecordBatch:
        found = edited_prints(texts[:upto], texts[1 : upto + 1])
        rows = [(doc, *x, _WHOLE, part, None) for doc, x in zip(ids[:upto], found, strict=True)]
        del ids[:upto], texts[:upto]
        return _columns(rows, _ENDS)

    def end(kind: int) -> pa.RecordBatch:
        return _columns([(ids[-1], *[None] * (len(_REPORT) - 1), kind, part, texts[-1])], _ENDS)

    size = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc)
            texts.append(text)
            if first:
                yield end(_HEAD)
                first = False
            size += len(text)
            if size >= BATCH_CHARS and len(texts) > 1:
                yield report(len(texts) - 1)
                size = len(texts[0])
    if texts:
        if len(texts) > 1:
            yield report(len(texts) - 1)
        yield end(_TAIL)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text, following in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            yield _columns([(doc, *edited_prints([text], [following])[0])], pa.schema(_REPORT))


def edited_report(docs: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are not read), see ``REPORT``.

    Documents follow each other by descending doc_id, a null one last, equal ones
    by their text; after the last comes the first, and a single one follows
    itself. The edited text has its last third (of code points, rounded down)
    replaced by the first as many of the document that follows, or all it has.
    near_edited and near_next are the likeness of the document's fingerprint to
    the edited text's and to the following document's: 1 for equal texts, near 0
    for texts that have nothing in common.

    Null texts are empty; empty texts are edited to empty ones. Texts of any
    length are walked over whole. Repeated rows are reported each. An empty
    table gives an empty result.

    Texts move once, to tasks of consecutive ids; only each task's first and
    last row are kept as texts, to be joined with their neighbours. Rows that
    share one id are read by one task, as ids are supposed to name documents.
    """
    rows = _texts(docs)
    scratch = Scratch(docs.sparkSession, "fingerprints")
    partitions = max(2, round((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / partition_bytes))
    order = F.col("doc_id").desc_nulls_last()
    ends_sql = f"{_REPORT_SQL}, kind int, part int, text string"
    found = scratch.keep(rows.repartitionByRange(partitions, order).sortWithinPartitions(order, "text").mapInArrow(_in_order, ends_sql), "found")
    parts = sorted(r["part"] for r in found.where(F.col("kind") == _HEAD).select("part").collect())  # at most one number a partition
    following = docs.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next int")
    heads = found.where(F.col("kind") == _HEAD).select(F.col("part").alias("next"), F.col("text").alias("following"))
    tails = found.where(F.col("kind") == _TAIL).select("part", "doc_id", "text").join(following, "part").join(heads, "next")
    across = tails.select("doc_id", "text", "following").mapInArrow(_across, _REPORT_SQL)
    return found.where(F.col("kind") == _WHOLE).select(*REPORT).union(across)


# --- documents with similar fingerprints


def band_count(least: float, bits: int = BAND_BITS) -> int:
    """Bands of which a pair with the least likeness shares none with a chance of MISS at most: its bits agree with (1 + likeness) / 2."""
    return math.ceil(math.log(MISS) / math.log(1 - ((1 + least) / 2) ** bits))


@cache
def band_places(level: int, ratio: float, bands: int, bits: int) -> np.ndarray:
    """The sampled bits of each band for texts of a size level: octaves by their extent, and any sample of an octave."""
    steps = ratio ** (level + 0.5)
    n = max(1, octaves(int(steps)))
    extent = [min(FIRST << k, steps) - (FIRST << k >> 1 if k else 0) for k in range(n)]
    u = (mix((np.arange(bands * bits * 2, dtype=np.uint64) + np.uint64(level << 20)) * _BAND + _STEP) >> np.uint64(11)).astype(np.float64).reshape(2, bands, bits) / 2.0**53
    octave = np.minimum(np.searchsorted(np.cumsum(extent) / sum(extent), u[0], side="right"), n - 1)
    return octave * SAMPLES + (u[1] * SAMPLES).astype(np.int64)


def _deal(least: float, bits: int):
    ratio, bands = 1 / max(0.3, least - 0.1), band_count(least, bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            keys = []
            for steps, data in zip(batch["steps"], batch["bits"], strict=True):
                own = np.unpackbits(np.frombuffer(data, dtype=np.uint8))
                level, found = math.floor(math.log(steps, ratio)), []
                # texts of neighbouring levels meet in the level that both are dealt to
                for x in (level, level + 1):
                    at = band_places(x, ratio, bands, bits)
                    value = np.where(at < len(own), own[np.minimum(at, len(own) - 1)], 0) @ powers
                    found.append(((x * bands + np.arange(bands)) << bits) + value)
                keys.append(np.concatenate(found))
            yield batch.assign(keys=keys)

    return run


def _tile(least: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(key[1]), int(key[2])
        rows = rows.sort_values("doc")
        left = rows[rows["block"] == ti]
        right = left if ti == tj else rows[rows["block"] == tj]
        links: list[tuple[int, int]] = []
        if len(left) and len(right):
            width = max(octaves(int(s)) for s in rows["steps"])
            a, b = (Prints(list(zip(x["steps"], x["bits"], strict=True)), width) for x in (left, right))
            every = np.arange(len(right))
            found = np.stack([a.likeness(np.full(len(right), i), b, every) >= least for i in range(len(left))])
            if ti == tj:
                np.fill_diagonal(found, False)
            names = left["doc"].tolist(), right["doc"].tolist()
            links = [(names[0][x], names[1][y]) for x, y in (forest(found) if ti == tj else crossing(found))]
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def similar_documents(docs: DataFrame, least: float = 0.8, bits: int = BAND_BITS, tile: int = TILE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, component_id (smallest doc_id reachable by links, itself included), kept.

    Documents are linked when their fingerprints have a likeness of ``least``
    (at least 0.5) or more. Equal fingerprints are one node. Each node is dealt
    to the bands of its size level and of the next; all pairs of a bucket are
    verified on whole fingerprints, in tiles of at most ``tile`` rows a side,
    which report a spanning forest. A pair whose likeness is just ``least`` is
    missed with a chance of MISS, closer ones more rarely.

    Null and empty texts link with nothing, nor do rows without an id, whose
    component_id is null and which aren't kept. Of different texts under one id
    each counts. Repeated rows are reported each. An empty table gives an empty
    result. Texts of any length are walked over whole.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    found = scratch.keep(fingerprints(docs), "prints")
    usable = found.where("doc_id IS NOT NULL AND steps > 0")
    nodes = scratch.keep(usable.groupBy("steps", "bits").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("last")), "nodes")
    dealt = scratch.keep(nodes.select("doc", "steps", "bits").mapInPandas(_deal(least, bits), "doc long, steps long, bits binary, keys array<long>"), "dealt")
    placed = dealt.select("doc", "steps", "bits", F.explode("keys").alias("key"))
    sizes = dealt.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / tile).cast("int").alias("blocks"))
    placed = placed.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("steps", "bits"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"ti": F.least("block", "other"), "tj": F.greatest("block", "other")})
    links = placed.select("key", "ti", "tj", "block", "doc", "steps", "bits").groupBy("key", "ti", "tj").applyInPandas(_tile(least), "a long, b long")
    # equal fingerprints link all their ids, each to the smallest
    same = usable.join(nodes.where("doc < last").select("steps", "bits", "doc"), ["steps", "bits"]).where("doc_id <> doc").select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))
    classes_of = components(scratch.keep(links.union(same), "links"), scratch, "components")
    out = found.select("doc_id", "n_chars").join(classes_of.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_chars", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
