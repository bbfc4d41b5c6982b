"""Near-duplicate documents by b-bit MinHash (operator 3).

A document's set is its distinct word shingles. Documents with one and the same
set are one node. Each node has 128 minima; bands of them make candidates, and
the low four bits of all minima, packed as bit planes in eight longs, estimate
the similarity by bit counts, corrected for chance collisions of the low bits.
Candidates whose estimate is not far below the threshold are confirmed on full
sets. Links are sought in two passes that never list all pairs of a group:
first each node against the best of its buckets' leaders, then, in buckets that
still hold several components, the pairs across components: tiles of signatures
find the candidates, and only those are confirmed on sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.bytehash import mix, words
from gradewell.llm.components import components
from gradewell.llm.shared import Scratch, sheltered

MINIMA, BITS = 128, 4
#: A pair at the threshold shares no band with this probability at most.
MISS = 5e-5
#: A pair at the threshold has this many standard deviations of the estimate to spare before it is passed over.
SPARE = 4.5
#: Texts that are hashed at a time, in characters.
BATCH_CHARS = 2_000_000
#: Rows of a bucket, and shingles of their sets, on one side of a tile; more are dealt over tiles.
TILE, TILE_SHINGLES = 768, 2_000_000
#: Rows on one side of a tile in which a cluster of candidates is confirmed.
CLUSTER = 4096
#: Members that are confirmed against one leader in one group.
MEMBERS = 400

_rng = np.random.default_rng(20_240_817)
_A = _rng.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: One odd factor for each word of a shingle.
_FACTORS = np.arange(1, 129, 2, dtype=np.uint64) * _C1

_SIGNED = "doc_id long, n_shingles long, set_id binary, sig array<long>, bands array<long>"


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; a shorter text is one shingle."""
    h, at = words(texts)
    out = []
    grams = h[:0]
    if len(h) >= width:
        grams = np.zeros(len(h) - width + 1, dtype=np.uint64)
        for k in range(width):
            grams += h[k : len(h) - width + 1 + k] * _FACTORS[k]
        grams = mix(grams)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([reduce(lambda x, y: mix(x * _C2 + y), h[a:b][:, None], np.array([b - a], dtype=np.uint64))[0]])))
        else:
            out.append(h[:0])
    return out


def minima(s: np.ndarray) -> np.ndarray:
    """The least image of a set under each of the hash functions."""
    x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i : i + 2048, None] * _A + _B).min(axis=0), out=low)
    return low


def bands_and_rows(threshold: float) -> tuple[int, int]:
    """Bands of the most rows that reach MISS at the threshold; below 0.08 single minima, which miss more."""
    for rows in range(MINIMA, 0, -1):
        if (1 - threshold**rows) ** (MINIMA // rows) <= MISS:
            return MINIMA // rows, rows
    return MINIMA, 1


def signature(low: np.ndarray, bands: int = 21, rows: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of the low bits (two longs for each of four bits) and the bands' hashes."""
    kept = low ^ (low >> np.uint32(16))
    planes = [np.packbits((kept >> np.uint32(k) & np.uint32(1)).astype(np.uint8)) for k in range(BITS)]
    cut = low[: bands * rows].reshape(bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64) * _C2
    for k in range(rows):
        h = mix(h * _C1 + cut[:, k])
    return np.concatenate(planes).view(np.int64), h.view(np.int64)


def least_estimate(threshold: float) -> float:
    """The estimate below which a candidate is passed over."""
    chance = 1 / (1 << BITS)
    share = threshold + (1 - threshold) * chance
    return threshold - SPARE * (share * (1 - share) / MINIMA) ** 0.5 / (1 - chance)


def most_mismatches(threshold: float) -> int:
    """The same as a count of differing minima: collision-corrected similarity is (1 - m / 128 - 1/16) / (1 - 1/16)."""
    chance = 1 / (1 << BITS)
    return int(MINIMA * (1 - least_estimate(threshold)) * (1 - chance))


def mismatches(a: Column, b: Column) -> Column:
    """Of two columns of bit planes: how many minima differ in their low bits."""
    halves = []
    for half in range(2):
        differ = [F.element_at(a, 2 * k + half + 1).bitwiseXOR(F.element_at(b, 2 * k + half + 1)) for k in range(BITS)]
        halves.append(F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), differ)))
    return halves[0] + halves[1]


def _batches(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The same rows, cut so that a part has about BATCH_CHARS of text."""
    for batch in batches:
        size = batch["text"].str.len().fillna(0).astype(np.int64).cumsum() // BATCH_CHARS
        for _, part in batch[columns].groupby(size.to_numpy(), sort=False):
            yield part


def _sign(width: int, bands: int, rows_each: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _batches(batches, ["doc_id", "text"]):
            rows = []
            for s in shingle_sets([None if pd.isna(t) else t for t in part["text"]], width):
                if len(s):
                    planes, hashes = signature(minima(s), bands, rows_each)
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), planes, hashes))
                else:
                    rows.append((0, None, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_id", "sig", "bands"])
            out.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
            yield out

    return run


def with_sets(roles: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``roles`` (doc and others) with each document's full set, as bytes.

    Texts move by document id at every size of the input: whether one side would
    fit a broadcast is not left to chance.
    """
    kept = roles.columns
    schema = ", ".join(f"{n} {t}" for n, t in roles.dtypes) + ", words binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _batches(batches, [*kept, "text"]):
            out = part[kept].copy()
            out["words"] = [s.tobytes() for s in shingle_sets([None if pd.isna(t) else t for t in part["text"]], width)]
            yield out

    named = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").hint("merge")
    return roles.join(named, "doc").select(*kept, "text").mapInPandas(run, schema)


def _confirm(percent: int):
    """Rows sorted by (leader, salt, member): the leader's set comes first, the members are held against it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, own = None, None
        for batch in batches:
            links = []
            for leader, salt, member, doc, data in batch[["leader", "salt", "member", "doc", "words"]].itertuples(index=False):
                s = np.frombuffer(data, dtype=np.uint64)
                if not member:
                    group, own = (leader, salt), s
                elif group == (leader, salt) and len(s) and similar(own, s, percent):
                    links.append((leader, doc))
            yield pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b): those whose full sets are similar enough.

    A document's text moves once for each pair of which it is the member; a
    leader of many members is copied to groups of MEMBERS.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), F.lit(1).alias("member"), F.col("b").alias("doc"))
    leaders = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("a").alias("doc"))
    roles = members.union(leaders).withColumnRenamed("a", "leader")
    sets = with_sets(roles, docs, width)
    return sets.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member").mapInPandas(_confirm(percent), "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets that aren't empty."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Whole groups of rows that are sorted by ``keys``."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        values = batch[keys].to_numpy()
        edges = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(values[a].tolist())
            if held and key != last:
                yield last, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.iloc[a:b])
            last = key
    if held:
        yield last, pd.concat(held) if len(held) > 1 else held[0]


def mismatch_counts(sig: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    """Minima of row ``x`` whose low bits differ from those of ``others``."""
    differ = np.zeros((len(others), 2), dtype=np.uint64)  # numpy counts the bits of a signed number's magnitude
    for k in range(BITS):
        differ |= sig[others, k] ^ sig[x, k]
    return np.bitwise_count(differ).sum(axis=1)


def _sides(rows: pd.DataFrame, ti: int, tj: int) -> tuple[np.ndarray, np.ndarray]:
    left = np.flatnonzero(rows["block"].to_numpy() == ti)
    return left, left if ti == tj else np.flatnonzero(rows["block"].to_numpy() == tj)


def _near(rows: pd.DataFrame, ti: int, tj: int, limit: int, local: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a tile and those of the other side with another label whose signature is near, nearest first.

    A pair counts in the first band that both share; ``band`` 0 has none before it.
    """
    left, right = _sides(rows, ti, tj)
    sig = np.stack(rows["sig"].tolist()).astype(np.int64).view(np.uint64).reshape(-1, BITS, 2)
    band = int(rows["band"].iat[0])
    bands = np.stack(rows["bands"].tolist())[:, :band] if band else None
    for at, x in enumerate(left.tolist()):
        others = right[at + 1 :] if ti == tj else right
        others = others[local[others] != local[x]]
        if not len(others):
            continue
        m = mismatch_counts(sig, x, others)
        near = m <= limit
        if bands is not None:
            near &= ~(bands[others] == bands[x]).any(axis=1)
        if near.any():
            yield x, others[near][np.argsort(m[near], kind="stable")]


def tile_candidates(rows: pd.DataFrame, ti: int, tj: int, limit: int) -> list[tuple[int, int]]:
    """A spanning forest of the candidate pairs across components in one tile of a bucket, from signatures alone."""
    docs = rows["doc"].tolist()
    _, component = np.unique(rows["component"].to_numpy(), return_inverse=True)
    joined, out = np.arange(len(docs)), []
    for x, near in _near(rows, ti, tj, limit, component):
        # one edge to each tree that the near rows are in
        for label in np.unique(joined[near]).tolist():
            if label != joined[x]:
                y = int(near[joined[near] == label][0])
                out.append((docs[x], docs[y]))
                joined[joined == label] = joined[x]
    return out


def tile_links(rows: pd.DataFrame, ti: int, tj: int, limit: int, percent: int) -> list[tuple[int, int]]:
    """Confirmed links between different components in one tile.

    Components that a link joins are one from then on, so their other pairs are
    not compared.
    """
    docs = rows["doc"].tolist()
    _, local = np.unique(rows["component"].to_numpy(), return_inverse=True)
    sets = [np.frombuffer(w, dtype=np.uint64) for w in rows["words"]]
    links = []
    for x, near in _near(rows, ti, tj, limit, local):
        for y in near.tolist():
            if local[x] != local[y] and similar(sets[x], sets[y], percent):
                links.append((docs[x], docs[y]))
                local[local == local[y]] = local[x]
    return links


def _candidates(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (key, ti, tj), rows in _runs(batches, ["key", "ti", "tj"]):
            edges = tile_candidates(rows, ti, tj, limit)
            if edges:
                yield pd.DataFrame([(key, ti, tj, a, b) for a, b in edges], columns=["key", "ti", "tj", "a", "b"])

    return run


def _tiles(limit: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, _, ti, tj), rows in _runs(batches, ["bucket", "key", "ti", "tj"]):
            links = tile_links(rows, ti, tj, limit, percent)
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return run


def _blocks(rows: DataFrame, n: Column, shingles: Column, most: int) -> DataFrame:
    """``rows`` dealt over tiles: a copy for each tile (ti, tj) that has the row's block on a side."""
    blocks = F.ceil(F.greatest(n / most, shingles / TILE_SHINGLES)).cast("int")
    blocks = F.least(blocks, n).cast("int")  # one row may have more shingles than a tile's side
    dealt = rows.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("doc"), blocks).cast("int")})
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"ti": F.least("block", "other"), "tj": F.greatest("block", "other")})


def across_components(placed: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch, width: int, percent: int, tile: int) -> DataFrame:
    """Confirmed links (a, b) across components in buckets that hold several.

    Tiles of signatures come first and give a forest of the candidates, so
    documents without one are done with and no text has moved. Candidates that
    hang together are a cluster. A cluster that fits two tiles' sides is
    confirmed by itself, wherever its pairs met, and its texts are copied twice
    at most; a larger one in the tiles in which its candidates met.
    """
    limit = most_mismatches(percent / 100)
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    dealt = _blocks(placed.join(several, "key"), F.col("n"), F.col("shingles"), tile)
    dealt = dealt.select("key", "ti", "tj", "block", "doc", "component").join(nodes.select("doc", "sig", "bands"), "doc")
    dealt = dealt.withColumn("band", F.array_position("bands", F.col("key")).cast("int") - 1).repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj", "doc")
    edges = scratch.keep(dealt.mapInPandas(_candidates(limit), "key long, ti int, tj int, a long, b long"), "candidates")
    clusters = components(edges.select("a", "b"), scratch, "clusters").withColumnsRenamed({"node": "doc", "component": "cluster"})
    own = nodes.select("doc", "n_shingles", "sig", "bands").join(placed.select("doc", "component").distinct(), "doc")
    members = scratch.keep(clusters.join(own, "doc"), "members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    fits = (F.col("n") <= 2 * CLUSTER) & (F.col("shingles") <= 2 * TILE_SHINGLES)
    sized = members.join(sizes.withColumn("fits", fits), "cluster")
    small = _blocks(sized.where("fits"), F.col("n"), F.col("shingles"), CLUSTER).select(F.lit(False).alias("bucket"), F.col("cluster").alias("key"), "ti", "tj", "block", F.lit(0).alias("band"), "doc", "component", "sig", "bands")
    met = edges.select("key", "ti", "tj", F.explode(F.array("a", "b")).alias("doc")).distinct()
    large = met.join(sized.where("NOT fits").select("doc", "component", "sig", "bands"), "doc").join(placed.select("key", "doc", "n", "shingles"), ["key", "doc"])
    blocks = F.least(F.ceil(F.greatest(F.col("n") / tile, F.col("shingles") / TILE_SHINGLES)), F.col("n")).cast("int")
    large = large.select(F.lit(True).alias("bucket"), "key", "ti", "tj", F.pmod(F.xxhash64("doc"), blocks).cast("int").alias("block"), (F.array_position("bands", F.col("key")).cast("int") - 1).alias("band"), "doc", "component", "sig", "bands")
    keys = ["bucket", "key", "ti", "tj"]
    tiles = with_sets(small.unionByName(large), texts, width).repartition(*keys).sortWithinPartitions(*keys, "doc")
    return scratch.keep(tiles.mapInPandas(_tiles(limit, percent), "a long, b long"), "second")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, tile: int = TILE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are not read).

    doc_id, n_shingles (size of the set of distinct ``width``-word shingles, of
    words in lower case; a shorter text is one shingle), component_id (smallest
    doc_id reachable by links, itself included), kept. Documents are linked when
    100 * intersection >= ``percent`` * union. Texts without words and null ones
    have an empty set and link with nothing; so do rows with a null doc_id,
    whose component_id is null and which aren't kept. Repeated rows are counted
    as one document and reported each. An empty table gives an empty result.

    Bands follow ``percent`` so that a pair at the threshold is missed with
    probability MISS at most: 21 of 6 minima at 85, 25 of 5 at 80.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    limit = most_mismatches(percent / 100)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.keep(texts.mapInPandas(_sign(width, *bands_and_rows(percent / 100)), _SIGNED), "signed")
    usable = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    nodes = scratch.keep(usable.groupBy("set_id").agg(F.min(F.struct("doc_id", "sig", "bands", "n_shingles")).alias("x")).select("set_id", F.col("x.doc_id").alias("doc"), "x.sig", "x.bands", "x.n_shingles"), "nodes")
    rows = nodes.select("doc", "n_shingles", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.min("doc").alias("leader"), F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).where("n > 1")
    in_buckets = scratch.keep(rows.select("key", "doc").join(sizes, "key"), "buckets")
    # first pass: each node and the most similar leader of its buckets
    sig_of = nodes.select(F.col("doc").alias("leader"), F.col("sig").alias("leader_sig"))
    pairs = in_buckets.where("doc <> leader").select("doc", "leader").distinct()
    pairs = pairs.join(nodes.select("doc", "sig"), "doc").join(sig_of, "leader").withColumn("m", mismatches(F.col("sig"), F.col("leader_sig"))).where(F.col("m") <= limit)
    best = pairs.groupBy("doc").agg(F.min(F.struct("m", "leader")).alias("x")).select(F.col("x.leader").alias("a"), F.col("doc").alias("b"))
    first = scratch.keep(confirm(scratch.keep(best, "best"), texts, width, percent), "first")
    found = components(first, scratch, "pass1")
    # second pass: pairs across components, only in buckets that hold several
    placed = in_buckets.select("key", "doc", "n", "shingles").join(found.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    placed = scratch.keep(placed, "placed")
    second = across_components(placed, nodes, texts, scratch, width, percent, tile)
    found = components(first.union(second), scratch, "pass2")
    scratch.drop("best", "buckets", "placed", "candidates", "members")
    classes = nodes.select("set_id", "doc").join(found.select(F.col("node").alias("doc"), "component"), "doc", "left").select("set_id", F.coalesce("component", "doc").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near-duplicates, and all others, with all their columns.

    Links name documents by id, so rows without one, and each of several texts
    that share an id, stay, and near copies of these may; repeated rows of an id
    count once. Null, empty and blank texts link with nothing and stay. Texts of
    any length are compared whole. An empty table gives an empty result. No
    column is touched, whatever its name.
    """
    docs, original = sheltered(docs)
    own, content = F.col("doc_id").cast("long"), F.xxhash64("text", F.col("text").isNull())
    stay = near_duplicates(docs, width, percent).where("kept").select(F.col("doc_id").alias("__id"))
    several = docs.where(own.isNotNull()).groupBy(own.alias("__id")).agg(F.min(content).alias("low"), F.max(content).alias("high")).where("low < high").select("__id")
    named = docs.join(stay.union(several).distinct(), own == F.col("__id"), "left_semi")
    named = named.withColumn("__content", content).dropDuplicates(["doc_id", "__content"]).drop("__content")
    return original(named.union(docs.where(own.isNull())))
