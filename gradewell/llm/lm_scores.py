"""Stupid-backoff language-model scores (operator 8).

Documents are dealt over batches by a hash of their content. Each batch is
exploded to its distinct n-grams of all sizes with their counts; those are
partitioned by the n-gram's hash, summed to the count table, and joined to the
exploded n-grams again, by the n-gram. What was joined goes back to its batch,
where the counts of a document's n-grams are looked up and its scores summed.
Every document is scored against the counts of all other documents: its own
occurrences are taken off, else every n-gram would have been seen. A frequent
n-gram is one entry a batch, so no key makes a large partition; an n-gram of one
batch only isn't sent back, because its batch knows its count.

Entries travel in blocks, one for each batch and partition of the count table:
sorted hashes and counts, compressed. Where that would be too many blocks they
travel as rows, and the count table and its join are Spark's own; either way the
results are the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.bytehash import mix, words

BACKOFF = 0.4
#: The longest n-gram.
ORDER = 2
#: Text of a batch, in bytes, and n-grams of a partition of the count table (by an estimate of one for PLACE_BYTES of text and size).
BATCH_BYTES = 8_000_000
PARTITION_ROWS = 2_000_000
PLACE_BYTES = 8
#: More blocks than this would hold few n-grams each; rows take their place.
MOST_BLOCKS = 4_000_000
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

GRAMS = "gram long, size int, batch long, n long"
BLOCKS = "part int, batch long, grams binary, counts binary"
SCORES = "doc_id long, n_words long, log_score double, mean_log_score double"


def grams_of(texts: list[str | None], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The text of each word place; and for each size the n-grams' 64-bit hashes and the places of their last words."""
    h, at = words(texts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(at))
    inside = np.arange(len(h)) - at[:-1][text_of]  # places before this one in its text
    whole, found = mix(h), []
    for size in range(1, order + 1):
        if size > 1:
            whole = np.concatenate([whole[:0], mix(whole[:-1] * _C1 + h[size - 1 :] * _C2 + np.uint64(size))]) if len(h) >= size else whole[:0]
        places = np.arange(size - 1, size - 1 + len(whole))
        real = inside[places] >= size - 1
        found.append((whole[real], places[real]))
    return text_of, found


def _texts(docs: pd.DataFrame) -> list[str | None]:
    return [None if pd.isna(t) else t for t in docs["text"]]


def _explode(order: int):
    def run(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        text_of, found = grams_of(_texts(docs), order)
        # the empty n-gram counts all words
        parts = [pd.DataFrame({"gram": [0], "size": [0], "n": [len(text_of)]})]
        for size, (grams, _) in enumerate(found, 1):
            one, n = np.unique(grams, return_counts=True)
            parts.append(pd.DataFrame({"gram": one.view(np.int64), "size": size, "n": n}))
        out = pd.concat(parts)
        out["batch"] = key[0]
        return out[["gram", "size", "batch", "n"]]

    return run


def backoff_scores(texts: list[str | None], order: int, grams: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed log scores of each text, against the counts of all other texts.

    ``grams`` (sorted) and ``totals`` are the counts of n-grams that other
    batches hold as well; the others' are those of these texts.
    """
    text_of, found = grams_of(texts, order)

    def total_of(own: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not len(grams):
            return n
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        return np.where(grams[at] == own, totals[at], n)

    corpus = float(total_of(np.zeros(1, dtype=np.int64), np.array([len(text_of)]))[0])
    n = np.bincount(text_of, minlength=len(texts))
    rest = (corpus - n)[text_of]
    counts = []  # of each size: how often other texts have the n-gram that ends at a place; 0 where there is none
    for k, (keys, places) in enumerate(found):
        found[k] = (None, places)  # hashes are needed once
        one, which, held = np.unique(keys, return_inverse=True, return_counts=True)
        total = total_of(one.view(np.int64), held).astype(np.float64)
        _, mine, own = np.unique(text_of[places] * np.int64(len(one) + 1) + which, return_inverse=True, return_counts=True)
        count = np.zeros(len(text_of))
        count[places] = total[which] - own[mine]
        counts.append(count)
        del keys, one, which, held, total, mine, own
    score = np.where(counts[0] > 0, np.log(np.maximum(counts[0], 1)) - np.log(np.maximum(rest, 1)), -np.log(rest + 1))
    for size in range(2, order + 1):
        places = found[size - 1][1]
        seen = counts[size - 1][places] > 0
        score[places] += np.log(BACKOFF)
        at = places[seen]
        score[at] = np.log(counts[size - 1][at]) - np.log(np.maximum(counts[size - 2][at - 1], 1))
    return n, np.bincount(text_of, weights=score, minlength=len(texts))


def exploded(placed: DataFrame, order: int, partitions: int) -> DataFrame:
    """Rows ``GRAMS`` of documents with their batch, partitioned by the n-gram's hash."""
    # the join's own conditions, so that it adds none and all its readers share this exchange
    return placed.groupBy("batch").applyInPandas(_explode(order), GRAMS).where("gram IS NOT NULL AND n IS NOT NULL").repartition(partitions, "gram")


def count_table(grams: DataFrame) -> DataFrame:
    """gram, size, total, first and last batch; the empty n-gram (gram 0, size 0) counts all words."""
    return grams.groupBy("gram").agg(F.max("size").alias("size"), F.sum("n").alias("total"), F.min("batch").alias("first"), F.max("batch").alias("last"))


def _row_answers(placed: DataFrame, order: int, partitions: int) -> DataFrame:
    """batch, and each of its n-grams that other batches hold with its total."""
    grams = exploded(placed, order, partitions)
    known = count_table(grams).where("first < last").select("gram", F.col("size").alias("known_size"), "total")
    # all columns are read on both sides of the join, so that both read one exchange
    return grams.join(known, "gram").where("total > n").select("gram", F.greatest("size", "known_size").alias("size"), "batch", "total")


def pack(x: np.ndarray) -> bytes:
    """Bytes of one significance together, then zstandard: sorted differences and small counts take few bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def pack_grams(sorted_grams: np.ndarray) -> bytes:
    return pack(np.diff(sorted_grams, prepend=np.uint64(0)))


def unpack_grams(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64))


def _blocks(order: int, partitions: int):
    def run(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        rows = _explode(order)(key, docs)
        grams, n = rows["gram"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy()
        at = np.argsort(grams)
        grams, n = grams[at], n[at].astype(np.uint64)
        # leading bits make partitions of sorted n-grams
        edges = np.searchsorted((grams >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32), np.arange(partitions + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(edges))
        parts = [(int(p), int(key[0]), pack_grams(grams[edges[p] : edges[p + 1]]), pack(n[edges[p] : edges[p + 1]])) for p in full]
        return pd.DataFrame(parts, columns=["part", "batch", "grams", "counts"])

    return run


def count_partition(blocks: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One partition of the count table: its n-grams, their totals, and how many blocks hold each."""
    grams, which = np.unique(np.concatenate(blocks), return_inverse=True)
    held = np.concatenate(counts)
    total = np.zeros(len(grams), dtype=np.uint64)
    np.add.at(total, which, held)
    return grams, total, np.bincount(which, minlength=len(grams))


def _joined(blocks: pd.DataFrame) -> pd.DataFrame:
    """The count table's partition joined to the blocks that it was summed from."""
    own = [unpack_grams(b) for b in blocks["grams"]]
    grams, totals, times = count_partition(own, [unpack(b, np.uint64) for b in blocks["counts"]])
    rows = []
    for part, batch, mine in zip(blocks["part"], blocks["batch"], own, strict=True):
        at = np.searchsorted(grams, mine)
        at = at[times[at] > 1]
        if len(at):
            rows.append((part, batch, pack_grams(grams[at]), pack(totals[at])))
    return pd.DataFrame(rows, columns=["part", "batch", "grams", "counts"])


def _block_answers(placed: DataFrame, order: int, partitions: int) -> DataFrame:
    """The same as ``_row_answers``, in blocks."""
    blocks = placed.groupBy("batch").applyInPandas(_blocks(order, partitions), BLOCKS)
    return blocks.repartition(max(partitions, 2), "part").groupBy("part").applyInPandas(_joined, BLOCKS)


def _score(order: int):
    columns = [c.split()[0] for c in SCORES.split(", ")]

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame([], columns=columns)
        if "grams" in answers:
            grams = np.concatenate([np.zeros(0, np.uint64), *map(unpack_grams, answers["grams"])]).view(np.int64)
            totals = np.concatenate([np.zeros(0, np.uint64), *(unpack(b, np.uint64) for b in answers["counts"])]).view(np.int64)
        else:
            grams, totals = answers["gram"].to_numpy(np.int64), answers["total"].to_numpy(np.int64)
        at = np.argsort(grams)
        n, score = backoff_scores(_texts(docs), order, grams[at], totals[at])
        out = pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64").to_numpy(), "n_words": n, "log_score": score})
        out["mean_log_score"] = np.divide(score, n, out=np.zeros(len(n)), where=n > 0)
        return out[columns]

    return run


def score_documents(docs: DataFrame, order: int = ORDER, batch_bytes: int = BATCH_BYTES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are not read): ``SCORES``.

    Words are lower-cased (A-Z) runs of anything but space and 09-0D. A word
    scores c(its n-gram) / c(the n-gram's first words) for the longest n-gram of
    at most ``order`` words, ending at it, that occurs in another document; each
    shorter size than the longest there is room for costs a factor of 0.4. A word
    alone scores its share of the other documents' words; an unknown word counts
    as one among the other documents' words and itself. log_score sums natural
    logarithms; mean_log_score is zero for texts without words. Null, empty and
    blank texts have none. Texts of any length are read whole. Repeated rows
    count as documents of their own (those equal in id and text share a batch).
    An empty table gives an empty result.

    Both passes read the same exchange of texts, and a document's batch follows
    from its id and text alone, so the passes agree in any case. An n-gram is
    known by a hash of 64 bits.
    """
    text = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (text == "").alias("blank"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-total // batch_bytes))
    partitions = max(1, -(-total * order // (PLACE_BYTES * PARTITION_ROWS)))
    placed = rows.where("not blank").select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("batch")).repartition(max(batches, 2), "batch")
    answers = (_block_answers if batches * partitions <= most_blocks else _row_answers)(placed, order, partitions)
    scored = placed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(_score(order), SCORES)
    return scored.union(rows.where("blank").select("doc_id", F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0)))
