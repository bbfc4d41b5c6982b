"""How the sources of a language differ in the terms they use (operator 12).

Tasks count the terms of their documents by group (language and source). The
counts are put in the order of language and term; each run of that order is a
chunk with a dictionary of its own, the sorted array of the terms that are kept.
A term's id is its place there, found by ``searchsorted``, and a group's counts
are a dense vector, made by ``bincount``. As chunks follow each other in UTF-8
order, (chunk, place) is an order-preserving id of the whole vocabulary: ties are
broken by it, and sums over all terms are sums over chunks. No task holds the
vocabulary, and no group's vector is longer than a chunk.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradewell.llm.shared import Scratch
from gradewell.llm.terms import LETTERS, term_lists

#: A language keeps the terms that so many of its documents hold.
LEAST_DOCS = 10
#: Ranks of a group's terms that are reported.
TERMS = 10
#: Distinct terms that a counting task holds before it hands them on.
HELD_TERMS = 400_000
#: Rows (group, term) of the counts that a task of chunks reads, and that one round of chunks is made of.
PARTITION_ROWS, ROUND_ROWS = 1_000_000, 200_000
#: Numbers in a chunk's matrix of groups and terms.
CELLS = 4_000_000
SCALE = 1_000_000_000

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("n", pa.int64())])
_CHUNKS = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("terms", pa.list_(pa.binary())), ("sources", pa.list_(pa.string())), ("sums", pa.list_(pa.int64())), ("counts", pa.binary())])
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("term", pa.binary()), ("chunk", pa.int64()), ("place", pa.int32()), ("value", pa.int64())])
_COUNTS_SQL = "lang string, source string, term binary, docs long, n long"
_CHUNKS_SQL = "lang string, chunk long, terms array<binary>, sources array<string>, sums array<long>, counts binary"
_FOUND_SQL = "lang string, source string, other string, term binary, chunk long, place int, value long"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a term, and its occurrences, by group."""
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
    occurrences: dict[tuple[str, str], Counter] = defaultdict(Counter)
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in docs.items():
            of = occurrences[lang, source]
            n = len(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.array([of[t] for t in counts], pa.int64())], schema=_COUNTS)
        docs.clear()
        occurrences.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            own, all_of = docs[lang, source], occurrences[lang, source]
            before, seen = len(own), set()
            for terms in term_lists(text, LETTERS):
                all_of.update(terms)
                seen.update(terms)
            own.update(seen)
            held += len(own) - before
            if held >= HELD_TERMS:
                yield from flush()
                held = 0
    yield from flush()


def dictionary_chunks(lang: str, terms: np.ndarray, sources: np.ndarray, docs: np.ndarray, n: np.ndarray, least: int, cells: int = CELLS) -> Iterator[tuple[list, list, list, bytes]]:
    """Of a language's rows in the order of their terms, all rows of each: chunks (kept terms, sources, their sums, counts of each source and term)."""
    new = np.ones(len(terms), dtype=bool)
    new[1:] = terms[1:] != terms[:-1]
    first = np.flatnonzero(new)
    dictionary = terms[first[np.add.reduceat(docs, first) >= least]]
    if not len(dictionary):
        return
    ids = np.minimum(np.searchsorted(dictionary, terms), len(dictionary) - 1)
    kept = np.flatnonzero(dictionary[ids] == terms)
    ids, n = ids[kept], n[kept]
    names, group = np.unique(sources[kept], return_inverse=True)
    width = max(1, cells // len(names))
    for at in range(0, len(dictionary), width):
        w = min(width, len(dictionary) - at)
        low, high = np.searchsorted(ids, [at, at + w])
        # sums of counts are exact below 2 ** 53
        counts = np.bincount(group[low:high] * w + ids[low:high] - at, weights=n[low:high], minlength=len(names) * w).astype("<i8").reshape(len(names), w)
        full = np.flatnonzero(counts.any(axis=1))
        yield dictionary[at : at + w].tolist(), names[full].tolist(), counts[full].sum(axis=1).tolist(), counts[full].tobytes()


def _chunks(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[list] = [[] for _ in _COUNTS]

        def chunks(upto: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            langs = np.array(held[0][:upto], dtype=object)
            edges = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), upto]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                sources, terms = (np.array(held[k][a:b], dtype=object) for k in (1, 2))
                docs, n = (np.array(held[k][a:b], dtype=np.int64) for k in (3, 4))
                for chunk in dictionary_chunks(langs[a], terms, sources, docs, n, least):
                    yield _batch([(langs[a], number, *chunk)], _CHUNKS)
                    number += 1
            for column in held:
                del column[:upto]

        for batch in batches:
            for k, column in enumerate(held):
                column.extend(batch.column(k).to_pylist())
            if len(held[0]) >= ROUND_ROWS:
                # the rows of the last term may go on in the next batch
                end, last = len(held[0]) - 1, (held[0][-1], held[2][-1])
                while end and (held[0][end - 1], held[2][end - 1]) == last:
                    end -= 1
                if end:
                    yield from chunks(end)
        if held[0]:
            yield from chunks(len(held[0]))

    return run


def share(counts: np.ndarray, totals: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), exact for totals below 9 * 10 ** 15: three digits a step."""
    rest, out = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // totals
        rest %= totals
    return out + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / (p + q)); shares are at most about 10 ** 9, so squares fit."""
    return (p - q) ** 2 // (p + q)


def _compare(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch(compare_chunk(row, top), _FOUND)

    return run


def compare_chunk(row: dict, top: int, cells: int = CELLS) -> list[tuple]:
    """Rows ``_FOUND`` of one chunk: sums for pairs of sources, and each source's best terms."""
    lang, names = row["lang"], [g["source"] for g in row["groups"]]
    at = {s: k for k, s in enumerate(names)}
    width = len(row["terms"])
    present = np.array([at[s] for s in row["sources"]], dtype=np.int64)
    given = np.frombuffer(row["counts"], dtype="<i8").reshape(len(present), width)
    sums = np.array([g["n"] for g in row["groups"]], dtype=np.int64)
    totals = (sums + 2 * row["kept"])[:, None]
    pairs = np.zeros((len(names), len(names)), dtype=np.int64)
    best: list[list[tuple]] = [[] for _ in names]
    step = max(1, cells // len(names))
    for a in range(0, width, step):
        some = given[:, a : a + step]
        counts = np.zeros((len(names), some.shape[1]), dtype=np.int64)
        counts[present] = some
        p, q = share(counts, totals), share(some.sum(axis=0), int(sums.sum()) + 2 * row["kept"])
        for k in range(len(names)):
            pairs[k, k + 1 :] += difference(p[k], p[k + 1 :]).sum(axis=1)
            own = np.flatnonzero((counts[k] > 0) & (p[k] > q))
            if len(own):
                value = difference(p[k][own], q[own])
                order = np.lexsort((own, -value))[:top]
                best[k] = sorted([*best[k], *zip((-value[order]).tolist(), (own[order] + a).tolist(), strict=True)])[:top]
    out = [(lang, names[i], names[j], None, None, None, int(pairs[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))]
    return out + [(lang, names[k], None, row["terms"][place], row["chunk"], place, -value) for k, found in enumerate(best) for value, place in found]


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TERMS) -> DataFrame:
    """How far the sources of each language are from each other, and the terms that mark each.

    Of ``docs`` (text, lang, source; other columns are not read): lang, source,
    part, item, value, rank. Part ``pair`` has a row for every other source of
    the language, part ``term`` the source's ``top`` terms that it uses more
    than the language does; ranks go by descending value, then by the item in
    UTF-8 order. A term's share of a group (or of a language) is
    1 + floor(10 ** 9 * (its occurrences + 2) / (all kept ones + 2 * kept terms)),
    two shares differ by floor((p - q) ** 2 / (p + q)), and a pair's value sums
    that over all terms of the language that ``least_docs`` documents hold.

    Null text, lang and source are empty strings: a group and a language like
    others. Groups without terms have pairs and no terms; a language that keeps
    no term gives pairs of value 0. Texts of any length are read whole, a piece
    at a time. Repeated rows are documents of their own, ids are not read. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))
    counts = docs.select(lang, source, F.col("text").cast("binary").alias("text")).mapInArrow(_count, _COUNTS_SQL)
    counts = scratch.keep(counts.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")), "counts")
    partitions = max(2, -(-counts.count() // PARTITION_ROWS))
    ordered = counts.repartitionByRange(partitions, "lang", "term").sortWithinPartitions("lang", "term", "source")
    chunks = scratch.keep(ordered.mapInArrow(_chunks(least_docs), _CHUNKS_SQL), "chunks")
    sums = chunks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("n"))
    kept = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    groups = scratch.keep(docs.select(lang, source).distinct().join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "groups")
    of_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups")).join(kept, "lang")
    # a language may have most chunks: they are dealt by a salt, and its row of groups goes to every salt
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_lang = of_lang.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    placed = chunks.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")).join(of_lang, ["lang", "salt"])
    found = scratch.keep(placed.select("lang", "chunk", "terms", "sources", "counts", "groups", "kept").mapInArrow(_compare(top), _FOUND_SQL), "found")
    values = found.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    values = values.union(values.select("lang", "other", "source", "value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("other")), "lang").where("source <> other").join(values, ["lang", "source", "other"], "left")
    by_pair, by_term = (Window.partitionBy("lang", "source").orderBy(F.desc("value"), *more) for more in (["item"], ["chunk", "place"]))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0)).alias("value")).withColumn("rank", F.row_number().over(by_pair))
    terms = found.where("term is not null").withColumn("rank", F.row_number().over(by_term)).where(F.col("rank") <= top)
    return pairs.union(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank"))
