"""Cost-balanced packing of token sequences (operator 2)."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.bytehash import mix
from gradewell.llm.tokens import encoder

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
CAPACITY = 4096
#: Text bytes that one packing group should hold; a group is one task's unit of work.
GROUP_BYTES = 8_000_000
#: Text bytes that are encoded at a time.
BATCH_BYTES = 4_000_000
#: A sequence of n tokens costs n + QUADRATIC * n * n: projections plus attention.
QUADRATIC = 1 / 2048

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODED = "g long, digest long, at long, doc_id long, ids binary"
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def cost(length: np.ndarray | float) -> np.ndarray | float:
    return length + QUADRATIC * length * length


def capacities(total: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences, and the rest as powers of two, which need no padding."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(lengths: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, length, bin) that fill the bins exactly.

    Descending documents each go to the bin of lowest cost that has room for
    them; when none has, the document is cut and fills the bin with most room.
    Ties: the earlier document and the earlier bin.
    """
    left, spent = np.array(room, dtype=np.int64), np.zeros(len(room))
    out = []
    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        at, rest = 0, lengths[doc]
        while rest:
            open_bins = np.flatnonzero(left >= rest)
            to = int(open_bins[np.argmin(spent[open_bins])]) if len(open_bins) else int(np.argmax(left))
            n = min(rest, int(left[to]))
            out.append((doc, at, n, to))
            left[to] -= n
            spent[to] += cost(n)
            at += n
            rest -= n
    return out


def group_of(doc_id: np.ndarray, digest: np.ndarray, at: np.ndarray, groups: int) -> np.ndarray:
    """A packing group for each row, from what the row holds alone: id, digest of its ids, number among its equals."""
    h = mix(doc_id.astype(np.int64).view(np.uint64) + _C1)
    h = mix(h * _C1 + digest.astype(np.int64).view(np.uint64))
    h = mix(h * _C2 + at.astype(np.int64).view(np.uint64))
    return (h % np.uint64(groups)).astype(np.int64)


def pack_group(key: tuple, docs: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """All pieces of one packing group, in sequences of its own."""
    docs = docs.sort_values(["doc_id", "digest", "at"], kind="stable")
    ids = [np.frombuffer(x, dtype="<u2") for x in docs["ids"]]
    names = docs["doc_id"].tolist()
    pieces, short, base = [], [], 0  # pieces: document, start, length, sequence
    for d, x in enumerate(ids):
        full = len(x) // capacity
        pieces += [(d, k * capacity, capacity, base + k) for k in range(full)]
        base += full
        short.append(len(x) - full * capacity)
    room = capacities(sum(short), capacity)
    pieces += [(d, len(ids[d]) - short[d] + at, n, base + to) for d, at, n, to in assign(short, room)]
    pieces.sort(key=lambda p: (p[3], p[0], p[1]))
    rows, last, offset = [], -1, 0
    for d, at, n, s in pieces:
        offset = offset if s == last else 0
        rows.append((names[d], at, n, zlib.crc32(ids[d][at : at + n].astype("<u4").tobytes()), len(ids[d]), (int(key[0]) << 32) + s, offset))
        last, offset = s, offset + n
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Pack ``docs`` (doc_id, text; other columns are not read) into sequences.

    One row for each piece (see ``PIECES``). Null and empty texts are one token,
    the end id. Repeated rows are packed once each; a null doc_id is kept as
    null. An empty table gives an empty result. Texts of any length are encoded
    whole; a document of more than ``capacity`` tokens fills sequences of its
    own and its rest is placed like a short document.

    Rows are dealt over groups of about ``group_bytes`` of text by a hash of id,
    content and number among equal rows of a task, so that no key makes a large
    group, and so that a group doesn't depend on the order in which rows arrive;
    the number of groups grows with the corpus and each is packed by itself, its
    sequences all full but for a tail of at most twelve that are powers of two.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, round(total / group_bytes))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, end = encoder(vocabulary_path), np.array([END_ID], dtype="<u2").tobytes()
        equal: Counter = Counter()

        def some(held: list[tuple]) -> pd.DataFrame:
            ids = [x + end for x in e.encode_many([t for _, t in held])]
            digests, at = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in ids], []
            for (doc_id, _), digest in zip(held, digests, strict=True):
                at.append(equal[doc_id, digest])
                equal[doc_id, digest] += 1
            out = pd.DataFrame({"digest": np.array(digests, dtype=np.int64), "at": np.array(at, dtype=np.int64), "doc_id": pd.array([d for d, _ in held], dtype="Int64"), "ids": ids})
            out.insert(0, "g", group_of(out["doc_id"].fillna(-1).to_numpy(np.int64), out["digest"].to_numpy(), out["at"].to_numpy(), groups))
            return out

        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].array, batch["text"].array, strict=True):
                text = None if pd.isna(text) else text
                held.append((None if pd.isna(doc_id) else int(doc_id), text))
                size += len(text or "")
                if size >= BATCH_BYTES:
                    yield some(held)
                    held, size = [], 0
        if held:
            yield some(held)

    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(encode, _ENCODED)
    # as many partitions as groups: what a task reads doesn't grow with the corpus
    return encoded.repartition(max(2, groups), "g").groupBy("g").applyInPandas(lambda key, part: pack_group(key, part, capacity), PIECES)
