"""Near-duplicate vectors by quantised tile products (operator 1).

Vectors that are equal are one node with a weight. Nodes are packed into blocks,
and every two blocks of all are compared as a tile, whatever their number, so no
link is missed at any size. Vectors are quantised to int8, one matrix product
gives all their dot products, and the length of each vector's own quantisation
error bounds how far a product can be off. Only pairs that may be above the
threshold and aren't surely so are computed again in double precision. A tile
needs to report no pair: it gives each node's number of links and a spanning
forest. Blocks are read where they lie, none is copied for its tiles.

A caller that asks for it (``exact_rows``) gets buckets instead beyond a number of
nodes: random hyperplanes deal nodes into buckets of a few thousand, in as many
tables as it takes for a pair at the threshold to meet with a stated probability.
A pair then counts in the first table in which it meets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.components import components
from gradewell.llm.shared import Scratch

#: Where buckets are asked for: up to so many distinct vectors all pairs are compared all the same.
EXACT_ROWS = 65_536
#: Rows of a block of all pairs at most, of small tables at least, and how many blocks small tables are cut into.
PACK_ROWS, LEAST_PACK, PACKS = 8192, 1024, 16
#: Bytes of a block's vectors; of very long ones, LEAST_PACK / 4 rows.
PACK_BYTES = 4_000_000
#: Rows and columns of a product that are looked through at once: they stay in a core's cache.
PIECE_ROWS, PIECE_COLUMNS = 512, 1024
#: Rows that an average bucket holds beyond, and the most rows of a tile's side.
BUCKET_ROWS = 2048
BLOCK_ROWS = 16_384
#: Bytes of vectors that a task of tiles reads on average; where tiles are fewer, one tile.
TASK_BYTES = 64_000_000
#: The chance that a pair just at the threshold meets in no table.
MISS = 1e-4
#: Half a unit of single precision: what rounding adds to a number at most, as a share of it.
ROUNDING = 2.0**-24

_NODE = "doc long, vec_key binary, vec binary, dim int"


def tables_and_bits(rows: int, threshold: float, exact_rows: int = EXACT_ROWS) -> tuple[int, int]:
    """Tables and hyperplanes a table, for so many rows; one table without hyperplanes compares all pairs."""
    if rows <= exact_rows:
        return 1, 0
    bits = max(1, min(30, round(math.log2(max(rows, 2) / BUCKET_ROWS))))
    alike = 1 - math.acos(threshold) / math.pi
    return math.ceil(math.log(MISS) / math.log(1 - alike**bits)), bits


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows: int8 values, step, length of the quantised row, length of its error."""
    step = np.abs(u).max(axis=1) / 127
    q = np.rint(u / step[:, None])
    back = q * step[:, None]
    return q.astype(np.int8), step, np.linalg.norm(back, axis=1), np.linalg.norm(u - back, axis=1)


def slack(a: np.ndarray, b: np.ndarray, dimensions: int) -> float:
    """What single precision adds to the error of a product of quantised rows of these lengths, in any order of its sum.

    A term is rounded when the right side is scaled and when it is multiplied,
    and with each of the sums; the terms' magnitudes add up to the product of
    the lengths at most. Sums in double precision are off by far less.
    """
    return (dimensions + 4) * ROUNDING * float(a.max(initial=0.0)) * float(b.max(initial=0.0))


def links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """Which unit rows of ``a`` and ``b`` have a product of at least ``threshold``; and how many pairs were computed again."""
    (qa, sa, na, ea), (qb, sb, nb, eb) = quantise(a), quantise(b)
    found, again = np.zeros((len(a), len(b)), dtype=bool), 0
    kind, coarse = np.float32, slack(na, nb, a.shape[1])
    right = (qb * sb[:, None]).astype(kind).T
    pieces = [(j, np.ascontiguousarray(right[:, j : j + PIECE_COLUMNS])) for j in range(0, len(b), PIECE_COLUMNS)]
    # a row's products below the one and above the other are no link and a link, whatever the other vector's error
    most = na * eb.max() + ea * nb.max() + ea * eb.max() + coarse
    low, high = (((threshold + side * most) / sa).astype(kind) for side in (-1, 1))
    for i in range(0, len(a), PIECE_ROWS):
        part = qa[i : i + PIECE_ROWS].astype(kind)
        for j, piece in pieces:
            product = part @ piece
            hot = np.flatnonzero(product.max(axis=1) >= low[i : i + PIECE_ROWS])
            if not len(hot):
                continue
            product, of = product[hot], hot + i
            maybe = product >= low[of, None]
            sure = np.zeros_like(maybe)
            if 8 * np.count_nonzero(maybe) > maybe.size:  # a dense group: most pairs are settled at once
                np.greater_equal(product, high[of, None], out=sure)
                maybe &= ~sure
            p, q = np.nonzero(maybe)
            x, y = of[p], q + j
            near = product[p, q].astype(np.float64) * sa[x]
            bound = na[x] * eb[y] + ea[x] * nb[y] + ea[x] * eb[y] + coarse
            link = near - bound >= threshold
            unsure = np.flatnonzero((near + bound >= threshold) & ~link)
            for k in range(0, len(unsure), 200_000):
                some = unsure[k : k + 200_000]
                link[some] = np.einsum("ij,ij->i", a[x[some]], b[y[some]]) >= threshold
            again += len(unsure)
            sure[p, q] = link
            found[of, j : j + PIECE_COLUMNS] = sure
    return found, again


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    waiting, out = np.ones(len(near), dtype=bool), []
    for root in range(len(near)):
        if not waiting[root]:
            continue
        waiting[root] = False
        todo = [root]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(near[x] & waiting)
            waiting[new] = False
            out += [(x, y) for y in new.tolist()]
            todo += new.tolist()
    return out


def crossing(found: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of the links between rows and columns."""
    rows, columns, out = found.any(axis=1), np.ones(found.shape[1], dtype=bool), []
    for root in np.flatnonzero(rows).tolist():
        todo = [root] if rows[root] else []
        rows[root] = False
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(found[x] & columns).tolist():
                columns[y] = False
                out.append((x, y))
                more = np.flatnonzero(found[:, y] & rows)
                rows[more] = False
                out += [(z, y) for z in more.tolist()]
                todo += more.tolist()
    return out


def _sums(found: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of what each row and each column is linked with."""
    of_row, of_column = np.zeros(len(rows), dtype=np.int64), np.zeros(len(columns), dtype=np.int64)
    x, y = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
    for k in range(0, len(x), 512):
        part = found[np.ix_(x[k : k + 512], y)].astype(np.float64)  # sums of counts are exact up to 2 ** 53
        of_row[x[k : k + 512]] = np.rint(part @ columns[y])
        of_column[y] += np.rint(rows[x[k : k + 512]] @ part).astype(np.int64)
    return of_row, of_column


def _unit(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(kind: str):
    """Rows with a vector that can be compared."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, v in zip(batch["doc"], batch["embedding"], strict=True):
                if pd.isna(doc) or v is None:
                    continue
                x = np.array([np.nan if c is None else c for c in v] if getattr(v, "dtype", None) == object else v, dtype=kind)
                if len(x) and np.isfinite(x).all() and x.any():
                    data = (x + 0.0).tobytes()  # no negative zeros
                    rows.append((int(doc), hashlib.blake2b(data, digest_size=16).digest(), data, len(x)))
            yield pd.DataFrame(rows, columns=["doc", "vec_key", "vec", "dim"])

    return run


def _deal(kind: str, tables: int, bits: int):
    """Each node's bucket in each table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim", sort=False):
                planes = np.random.default_rng(dim).standard_normal((dim, tables * bits))
                side = (_unit(part["vec"].tolist(), kind) @ planes >= 0).reshape(len(part), tables, bits)
                ids = (side << np.arange(bits)).sum(axis=2).astype("<i4")
                yield pd.DataFrame({"doc": part["doc"], "weight": part["weight"], "vec": part["vec"], "dim": part["dim"], "ids": [x.tobytes() for x in ids], "buckets": list(ids.astype(np.int32))})

    return run


def _report(found: np.ndarray, a: np.ndarray, b: np.ndarray, weights: tuple[np.ndarray, np.ndarray], same: bool) -> list[tuple]:
    """Of a tile's links: the number of each node, and edges of a spanning forest."""
    if not found.any():
        return []
    count, other = _sums(found, *weights)
    out = [(d, None, n) for d, n in zip(a.tolist(), count.tolist(), strict=True) if n]
    if same:
        return out + [(int(a[x]), int(b[y]), 0) for x, y in forest(found)]
    out += [(d, None, n) for d, n in zip(b.tolist(), other.tolist(), strict=True) if n]
    return out + [(int(a[x]), int(b[y]), 0) for x, y in crossing(found)]


def _met(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["a", "b", "links"]).astype({"a": np.int64, "b": "Int64", "links": np.int64})


_MET = "a long, b long, links long"


def _tile(kind: str, threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        number, ti, tj = int(key[1]), key[3], key[4]
        rows = rows.sort_values("doc")
        left = rows[rows["block"] == ti]
        right = left if ti == tj else rows[rows["block"] == tj]
        if not len(left) or not len(right):
            return _met([])
        found, _ = links(_unit(left["vec"].tolist(), kind), _unit(right["vec"].tolist(), kind), threshold)
        if ti == tj:
            np.fill_diagonal(found, False)
        if number:
            ids = [np.frombuffer(b"".join(x["ids"]), dtype="<i4").reshape(len(x), -1)[:, :number] for x in (left, right)]
            for k in range(len(found)):  # met in an earlier table
                q = np.flatnonzero(found[k])
                found[k, q] = ~(ids[0][k] == ids[1][q]).any(axis=1)
        return _met(_report(found, left["doc"].to_numpy(), right["doc"].to_numpy(), (left["weight"].to_numpy(), right["weight"].to_numpy()), ti == tj))

    return run


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A block as one row."""
    rows = rows.sort_values("doc")
    return pd.DataFrame({"number": [key[0]], "docs": [rows["doc"].to_numpy("<i8").tobytes()], "weights": [rows["weight"].to_numpy("<i8").tobytes()], "vecs": [b"".join(rows["vec"])]})


def _compare(kind: str, threshold: float):
    """The links of two packed blocks."""

    def block(docs: bytes, weights: bytes, vecs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(docs, dtype="<i8")
        size = len(vecs) // len(ids)
        return ids, np.frombuffer(weights, dtype="<i8"), _unit([vecs[k : k + size] for k in range(0, len(vecs), size)], kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples(index=False):
                same = x.number == x.number2
                a, wa, u = block(x.docs, x.weights, x.vecs)
                b, wb, v = (a, wa, u) if same else block(x.docs2, x.weights2, x.vecs2)
                found, _ = links(u, v, threshold)
                if same:
                    np.fill_diagonal(found, False)
                yield _met(_report(found, a, b, (wa, wb), same))

    return run


def _all_pairs(nodes: DataFrame, many: int, side: int, kind: str, threshold: float, scratch: Scratch) -> DataFrame:
    """What every two blocks of vectors of one length have in common, themselves too."""
    of_length = F.col("dim").cast("long") * 2**32
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count("*") / side).cast("int").alias("blocks"))
    placed = nodes.join(F.broadcast(sizes), "dim").select((of_length + F.pmod(F.xxhash64("doc"), F.col("blocks"))).alias("number"), "doc", "weight", "vec")
    packed = placed.repartition(max(1, -(-many // side)), "number").groupBy("number").applyInPandas(_pack, "number long, docs binary, weights binary, vecs binary")
    blocks = scratch.keep(packed, "blocks")
    others = blocks.toDF(*[f"{c}2" for c in blocks.columns])
    apart = F.col("number2") - F.col("number")
    one_length = F.shiftright("number", 32) - F.shiftright("number2", 32) == 0
    # of two blocks either is the left one in turn, so that tasks have as many tiles
    once = (apart == 0) | ((apart > 0) & (apart % 2 == 0)) | ((apart < 0) & (apart % 2 != 0))
    # each task reads its two parts of the table; nothing is shuffled
    return blocks.join(others.hint("shuffle_replicate_nl"), one_length & once).mapInPandas(_compare(kind, threshold), _MET)


def _bucketed(nodes: DataFrame, many: int, width: float, tables: int, bits: int, block_rows: int, kind: str, threshold: float, scratch: Scratch) -> DataFrame:
    """What the tiles of all buckets report."""
    partitions = max(2, min(tables * 2**bits, max(512, int(many * tables * (width + 64) / TASK_BYTES))))
    dealt = nodes.select("doc", "weight", "vec", "dim")
    dealt = scratch.keep(dealt.mapInPandas(_deal(kind, tables, bits), "doc long, weight long, vec binary, dim int, ids binary, buckets array<int>"), "dealt")
    placed = dealt.select("doc", "weight", "vec", "dim", "ids", F.posexplode("buckets").alias("number", "bucket"))
    sizes = dealt.select("dim", F.posexplode("buckets").alias("number", "bucket")).groupBy("dim", "number", "bucket").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    placed = placed.join(sizes, ["dim", "number", "bucket"]).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"ti": F.least("block", "other"), "tj": F.greatest("block", "other")})
    keys = ["dim", "number", "bucket", "ti", "tj"]
    placed = placed.select(*keys, "doc", "weight", "vec", "ids", "block").repartition(partitions, *keys)
    return placed.groupBy(*keys).applyInPandas(_tile(kind, threshold), _MET)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, block_rows: int = BLOCK_ROWS, exact_rows: float = math.inf) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding; other columns are not read).

    vec_id, n_links (other vec_ids with a cosine of at least ``threshold``, in
    double precision), component_id (smallest vec_id reachable by links), kept.
    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, and vectors of different lengths don't link; a null
    vec_id links with nothing, has a null component_id and isn't kept. Repeated
    rows count once and are reported each; of different vectors under one id
    the one with most links gives n_links, and the least component counts. An empty table gives an empty result.

    No reported link is below the threshold and none is missed, at any size: all
    pairs are compared, the square of the distinct vectors. Only a caller who
    gives ``exact_rows`` has buckets instead beyond so many distinct vectors: a
    pair at the threshold then is missed with probability ``MISS`` at most, a
    closer one more rarely.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    named = vectors.select(F.col("vec_id").cast("long").alias("doc"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    usable = scratch.keep(named.mapInPandas(_usable(kind), _NODE), "usable")
    # vectors move once, ids by themselves
    one = usable.groupBy("vec_key").agg(F.min(F.struct("doc", "vec", "dim")).alias("x"))
    weights = usable.select("vec_key", "doc").distinct().groupBy("vec_key").agg(F.count("*").alias("weight"))
    nodes = scratch.keep(one.join(weights, "vec_key").select("vec_key", "x.doc", "x.vec", "x.dim", "weight"), "nodes")
    many, width = nodes.agg(F.count("*"), F.avg(F.octet_length("vec"))).first()
    tables, bits = tables_and_bits(many, threshold, exact_rows)
    if bits:
        tiled = _bucketed(nodes, many, width or 0, tables, bits, block_rows, kind, threshold, scratch)
    else:  # how blocks are cut has no part in the result
        side = min(block_rows, PACK_ROWS, max(LEAST_PACK, -(-many // PACKS)), max(LEAST_PACK // 4, int(PACK_BYTES / (width or 1))))
        tiled = _all_pairs(nodes, many, side, kind, threshold, scratch)
    met = scratch.keep(tiled, "met")
    counts = met.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    found = components(met.where("b is not null").select("a", "b"), scratch, "components")
    of_node = nodes.select("vec_key", "doc", "weight").join(counts.withColumnRenamed("a", "doc"), "doc", "left").join(found.withColumnRenamed("node", "doc"), "doc", "left")
    of_node = of_node.select("vec_key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "doc").alias("component"))
    of_vector = usable.select("doc", "vec_key").distinct().join(of_node, "vec_key").groupBy("doc").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    scratch.drop("dealt", "blocks")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(of_vector.withColumnRenamed("doc", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
