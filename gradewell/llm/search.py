"""Ranked lexical search of a set of queries over all documents (operator 13).

Tasks cut their documents into shards, each with the postings of the terms that
any query holds, and write them. Document frequencies are summed over shards;
then each task goes through its shards query by query with MaxScore: terms are
taken in order of the most that they can add to a score. While the terms that
remain could lift a document over the score to beat, they are essential and
their postings are read whole; the others' are only probed for documents that
can still qualify. The score to beat is the least of the best that the task has
found in earlier shards, or what enough documents of this shard have already. A
task hands on its best documents of each query alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradewell.llm.shared import Scratch
from gradewell.llm.terms import LETTERS_AND_DIGITS, term_lists

TOP = 10
#: Text of a shard, in bytes; a document is in one shard.
SHARD_BYTES = 8_000_000
#: Text of queries that are searched together, in bytes; each such block is a pass over the documents.
QUERY_BYTES = 2_000_000
#: How much of the length term depends on the document's length, in percent. Fixed value.
SLOPE = 90
SCALE = 1_000_000_000

_SHARDS = pa.schema([
    ("docs", pa.int64()), ("words", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()),
    ("terms", pa.list_(pa.int32())), ("holders", pa.list_(pa.int64())), ("places", pa.binary()), ("times", pa.binary()),
])
_SHARDS_SQL = "docs long, words long, doc_ids array<long>, lengths binary, terms array<int>, holders array<long>, places binary, times binary"
_HITS = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


@dataclass
class Shard:
    """Postings by term: places of documents, ascending, what the term adds to their scores, and the most it adds."""

    doc_ids: list[int | None]
    postings: dict[int, tuple[np.ndarray, np.ndarray, int]]


def query_terms(text: bytes | None) -> set[bytes]:
    return {t for terms in term_lists(text, LETTERS_AND_DIGITS) for t in terms}


def _index(vocabulary: dict[bytes, int], shard_bytes: int):
    """Shards of a task's documents, with the postings of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = words = size = 0
        ids: list[int | None] = []
        lengths: list[int] = []
        found: list[tuple[list[int], list[int]]] = []

        def shard() -> pa.RecordBatch:
            nonlocal docs, words, size
            place = np.repeat(np.arange(len(ids), dtype=np.int32), [len(t) for t, _ in found])
            term, times = (np.array([x for pair in found for x in pair[k]], dtype=np.int64) for k in (0, 1))
            order = np.argsort(term, kind="stable")
            terms, holders = np.unique(term, return_counts=True)
            row = [docs, words, list(ids), np.array(lengths, dtype="<i8").tobytes(), terms.tolist(), holders.tolist(), place[order].astype("<i4").tobytes(), times[order].astype("<i8").tobytes()]
            docs = words = size = 0
            for x in (ids, lengths, found):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, _SHARDS, strict=True)], schema=_SHARDS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts: Counter = Counter()
                for terms in term_lists(text, LETTERS_AND_DIGITS):
                    counts.update(terms)
                if not counts:
                    continue
                n = counts.total()
                own = [(vocabulary[t], c) for t, c in counts.items() if t in vocabulary]
                docs, words, size = docs + 1, words + n, size + len(text)
                if own:
                    ids.append(doc_id)
                    lengths.append(n)
                    found.append(([t for t, _ in own], [c for _, c in own]))
                if size >= shard_bytes:
                    yield shard()
        if docs:
            yield shard()

    return run


def weight(docs: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holders + 1)))


def open_shard(row: dict, weights: dict[int, int], docs: int, words: int) -> Shard:
    """The postings of a shard with what each adds to a score."""
    lengths = np.frombuffer(row["lengths"], dtype="<i8")
    different, which = np.unique(lengths, return_inverse=True)
    # lengths times documents may pass 64 bits at scale
    m = np.array([100 - SLOPE + SLOPE * n * docs // words for n in different.tolist()], dtype=np.int64)[which]
    places, times = np.frombuffer(row["places"], dtype="<i4"), np.frombuffer(row["times"], dtype="<i8")
    adds = SCALE * times // (1000 * times + 8 * m[places])
    postings, at = {}, 0
    for term, n in zip(row["terms"], row["holders"], strict=True):
        add = adds[at : at + n] * weights[term]
        postings[term] = (places[at : at + n], add, int(add.max()))
        at += n
    return Shard(row["doc_ids"], postings)


def best_of_shard(shard: Shard, terms: list[int], beat: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all documents of a shard that are among its ``top`` and have at least ``beat``; perhaps of a few more."""
    lists = sorted((shard.postings[t] for t in terms if t in shard.postings), key=lambda p: -p[2])
    rest = [0, *np.cumsum([p[2] for p in reversed(lists)]).tolist()][::-1]  # what the lists from this one on can add
    scores = np.zeros(len(shard.doc_ids), dtype=np.int64)
    k = 0
    while k < len(lists) and rest[k] >= beat:  # essential
        scores[lists[k][0]] += lists[k][1]
        k += 1
        if rest[k] and len(scores) >= top:  # partial scores only grow
            beat = max(beat, int(np.partition(scores, -top)[-top]))
    places = np.flatnonzero(scores)
    scores = scores[places]
    for (holders, adds, _), more in zip(lists[k:], rest[k:], strict=False):  # not essential
        may = scores + more >= beat
        places, scores = places[may], scores[may]
        if not len(places):
            break
        at = np.minimum(np.searchsorted(holders, places), len(holders) - 1)
        scores = scores + np.where(holders[at] == places, adds[at], 0)
    may = scores >= max(beat, 1)
    return places[may], scores[may]


def _search(items: list[list[int]], weights: dict[int, int], docs: int, words: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each query the best so far: (score descending, doc_id ascending, nulls last)
        held: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        for batch in batches:
            for row in batch.to_pylist():
                shard = open_shard(row, weights, docs, words)
                for k, terms in enumerate(items):
                    beat = -held[k][-1][0] if len(held[k]) == top else 1
                    places, scores = best_of_shard(shard, terms, beat, top)
                    if len(places):
                        own = [(-s, shard.doc_ids[p] is None, shard.doc_ids[p] or 0) for p, s in zip(places.tolist(), scores.tolist(), strict=True)]
                        held[k] = sorted(held[k] + own)[:top]
        rows = [(k, None if null else doc, -score) for k, found in enumerate(held) for score, null, doc in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), _HITS, strict=True)], schema=_HITS)

    return run


def _search_block(rows: DataFrame, block: DataFrame, scratch: Scratch, name: str, top: int, shard_bytes: int) -> DataFrame | None:
    spark = rows.sparkSession
    of_item: dict[int | None, set[bytes]] = {}
    for item_id, text in block.collect():
        of_item.setdefault(item_id, set()).update(query_terms(bytes(text)))
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*of_item.values())))}
    shards = scratch.keep(rows.mapInArrow(_index(vocabulary, shard_bytes), _SHARDS_SQL), name)
    docs, words = shards.agg(F.sum("docs"), F.sum("words")).first()
    if not docs:
        return None
    holders = shards.select(F.explode(F.arrays_zip("terms", "holders")).alias("x")).groupBy("x.terms").agg(F.sum("x.holders").alias("n"))
    weights = {t: weight(docs, n) for t, n in holders.collect()}  # at most the queries' terms
    names = list(of_item)
    items = [sorted(vocabulary[t] for t in of_item[i]) for i in names]
    hits = shards.select("doc_ids", "lengths", "terms", "holders", "places", "times").mapInArrow(_search(items, weights, docs, words, top), "item int, doc_id long, score long")
    known = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")
    return hits.join(F.broadcast(known), "item").select("item_id", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``top`` documents of ``docs`` (doc_id, text) for each query of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Terms are runs of letters, digits and all beyond ASCII in whole texts, A-Z
    lower-cased. With N documents that have a term, L terms in all, n in a
    document and tf there, df documents that hold the term: a term weighs
    floor(1000 * ln((2 N + 2) / (2 df + 1))), m = 10 + floor(90 n N / L), and a
    score sums weight * floor(10 ** 9 tf / (1000 tf + 8 m)) over the query's
    distinct terms. Scores above 0 are ranked from 1, highest first, equal ones
    by ascending doc_id, a null doc_id last.

    Null and empty texts and texts without a term are no documents, and queries
    of that kind find nothing. Repeated rows of ``docs`` are documents of their
    own. Texts that share an item_id (null too) are one query with the terms of
    all. Texts of any length are read whole, a piece at a time. Empty tables
    give an empty result. Other columns are not read.

    Queries go to all tasks, in blocks of about ``query_bytes`` of text; more
    than one block means more than one pass over the documents.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // query_bytes))
    found = []
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else asked
        found.append(_search_block(rows, block, scratch, f"shards-{k}", top, shard_bytes))
    found = [f for f in found if f is not None] or [spark.createDataFrame([], "item_id long, doc_id long, score long")]
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return reduce(DataFrame.union, found).withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
