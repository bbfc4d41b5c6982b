"""Likeness of texts by vectors (OP-072, 134, 137 to 13B): each distinct text is looked up once.

Vectors are a table (text, vector), whatever they were made by. Where one of two
texts has no vector, their token sets are compared instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.vector import LEAST_NORM, norm
from gradewell.sources.files import kept

#: Digits to which a cosine is settled before it is compared.
DIGITS = 9
#: Rows on a side of a tile of pairs; and left rows of small groups that one task compares.
TILE, TASK_ROWS = 2048, 100_000
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def usable(vector: Column) -> Column:
    """Whether ``unit`` gives a vector: true or false, never null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def unit(vector: Column) -> Column:
    """A vector of length one in doubles; zeros for one of next to no length; null if it is null, empty or has a component that is null or not finite."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = norm(v)
    return F.when((F.size(v) == 0) | bad, None).when(length < LEAST_NORM, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: x / length))


def tokens(text: str | None) -> frozenset[str]:
    return frozenset(_SPACE.split((text or "").lower())) - {""}


def token_likeness(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / max(len(a | b), 1)


def likeness(texts: tuple[list, list], vectors: tuple[list, list]) -> np.ndarray:
    """Of each left text to each right one: settled cosines, 0 for vectors of different lengths; token sets where one has no vector, 0 for empty texts."""
    out = np.zeros((len(texts[0]), len(texts[1])))
    sizes = [np.array([-1 if v is None else len(v) for v in side]) for side in vectors]
    for size in set(sizes[0].tolist()) - {-1}:
        rows, columns = (np.flatnonzero(s == size) for s in sizes)
        if len(columns):
            a, b = (np.stack([side[i] for i in at]) for side, at in zip(vectors, (rows, columns), strict=True))
            out[np.ix_(rows, columns)] = np.round(a @ b.T, DIGITS)
    missing = [np.flatnonzero(s == -1) for s in sizes]
    if len(missing[0]) or len(missing[1]):
        words = [[tokens(t) for t in side] for side in texts]
        for i in range(len(out)):
            for j in range(out.shape[1]) if sizes[0][i] == -1 else missing[1].tolist():
                out[i, j] = token_likeness(words[0][i], words[1][j])
    empty = [np.array([not t for t in side], dtype=bool) for side in texts]
    out[empty[0]] = 0
    out[:, empty[1]] = 0
    return out


def _vectors(column: pd.Series) -> list:
    return [None if v is None else np.asarray(v, dtype=np.float64) for v in column]


def _tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    out: list[tuple] = []
    if len(left) and len(right):
        groups = dict(iter(right.sort_values("id", kind="stable").groupby("g", sort=False)))
        for g, own in left.groupby("g", sort=False):
            other = groups.get(g)
            if other is not None:
                sims = likeness((own["text"].tolist(), other["text"].tolist()), (_vectors(own["vector"]), _vectors(other["vector"])))
                best = sims.argmax(axis=1)  # the first of equals
                out += zip(own["id"].tolist(), other["id"].to_numpy()[best].tolist(), sims[np.arange(len(own)), best].tolist(), strict=True)
    return pd.DataFrame(out, columns=["id", "match", "sim"])


def semantic_join(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """For each row of ``left`` the likest row of ``right`` with the same keys, if alike enough: id, match, sim.

    Both have the keys, ``id`` (long), ``text`` and ``vector`` (see ``unit``). Of
    equally like rows the smaller id. Ids of ``left`` must differ. Null keys are
    a key like others; null and empty texts are like nothing.

    Pairs of a key meet in tiles of at most TILE rows a side, so a key may hold
    any share of the rows, and small keys share a task. A tile hands on one row
    for each of its left rows.
    """
    g = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    sides = [rows.select(g.alias("g"), F.col("id").cast("long").alias("id"), "text", "vector") for rows in (left, right)]
    sizes = sides[0].groupBy("g").agg(F.ceil(F.count("*") / TILE).cast("int").alias("lbs")).join(sides[1].groupBy("g").agg(F.ceil(F.count("*") / TILE).cast("int").alias("rbs")), "g")
    homes = max(1, -(-left.count() // TASK_ROWS), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large = (F.col("lbs") > 1) | (F.col("rbs") > 1)
    sizes = sizes.withColumn("home", F.when(large, F.xxhash64("g")).otherwise(F.pmod(F.xxhash64("g"), F.lit(homes))))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        placed = rows.join(sizes, "g").withColumns({own[:2]: F.pmod(F.xxhash64("id"), F.col(own)).cast("int"), other[:2]: F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
        return placed.toDF(*placed.columns).groupBy("home", "lb", "rb")  # columns of its own: both sides come from ``sizes``

    met = dealt(sides[0], "lbs", "rbs").cogroup(dealt(sides[1], "rbs", "lbs")).applyInPandas(_tile, "id long, match long, sim double")
    best = met.groupBy("id").agg(F.min(F.struct((-F.col("sim")).alias("far"), "match")).alias("x"))
    return best.where(-F.col("x.far") >= least).select("id", "x.match", (-F.col("x.far")).alias("sim"))


KNOWN = "text string, vector array<double>, severe struct<sim: double, place: int>, minor struct<sim: double, place: int>, output struct<sim: double, place: int>, concept struct<sim: double, place: int>"


def with_known(records: DataFrame, ids: list[str], texts: Column, vectors: DataFrame, phrases: dict[str, tuple[str, ...]]) -> DataFrame:
    """``records`` with ``known``: for each of a record's ``texts`` (array) its vector and the nearest phrase of each kind.

    ``ids`` name a record. ``vectors`` are (text, vector). Each distinct text is
    held against the phrases once, a batch of texts in one product. ``phrases``
    has a bounded tuple for each kind (severe, minor, output, concept); what the
    vectors know of them goes to all tasks.
    """
    spark = records.sparkSession
    units = vectors.where("text IS NOT NULL").groupBy("text").agg(F.min(unit(F.col("vector"))).alias("vector"))
    every = sorted({p for of_kind in phrases.values() for p in of_kind})
    found = spark.createDataFrame([(p,) for p in every], "text string").join(units, "text").collect()
    vector_of = {r["text"]: None if r["vector"] is None else np.array(r["vector"]) for r in found}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["text", "vector"]].copy()
            own = batch["text"].tolist(), _vectors(batch["vector"])
            for kind in ("severe", "minor", "output", "concept"):
                sims = likeness((own[0], list(phrases[kind])), (own[1], [vector_of.get(p) for p in phrases[kind]]))
                best = sims.argmax(axis=1)
                out[kind] = [{"sim": float(sims[i, k]), "place": int(k)} for i, k in enumerate(best.tolist())]
            yield out

    each = records.select(*ids, F.explode(F.array_distinct(F.array_compact(texts))).alias("text"))
    known = each.select("text").distinct().join(units, "text", "left").select("text", "vector").mapInPandas(run, KNOWN)
    entry = F.struct("text", F.struct("vector", "severe", "minor", "output", "concept"))
    of_record = each.join(known, "text").groupBy(*ids).agg(F.map_from_entries(F.collect_list(entry)).alias("known"))
    named = of_record.withColumnsRenamed({i: f"__{i}" for i in ids})
    on = reduce(Column.__and__, [F.col(i).eqNullSafe(F.col(f"__{i}")) for i in ids])
    return records.join(named, on, "left").drop(*[f"__{i}" for i in ids])


def mean_likeness(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, n, mean: the mean cosine of all pairs of different rows of a group, without a pair (OP-09M).

    Unit vectors that are summed have the squared length of all their products,
    so the mean is (|sum|^2 - sum of |u|^2) / (n (n - 1)). Sums are made where the
    rows are, so a group may hold any share of them. Rows whose vector isn't
    usable (see ``unit``) are left out; one of no length has a cosine of 0 with
    all, and so have vectors of different lengths. The mean of fewer than two
    rows is null. Null keys are a group like others.
    """
    units = rows.select(*keys, unit(F.col(vector)).alias("u")).where("u IS NOT NULL")
    whole = units.groupBy(*keys).agg(F.count("*").alias("n"))
    places = units.select(*keys, F.size("u").alias("dim"), F.posexplode("u").alias("place", "x"))
    sums = places.groupBy(*keys, "dim", "place").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("own"))
    pairs = sums.groupBy(*keys).agg((F.sum(F.col("s") * F.col("s")) - F.sum("own")).alias("pairs"))
    named = pairs.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))
    n = F.col("n").cast("double")
    return whole.join(named, on).select(*keys, "n", F.when(n > 1, F.col("pairs") / (n * (n - 1))).alias("mean"))


#: Rows on a side of a tile of a matrix, all of whose pairs are results; and pairs that leave a tile at once.
MATRIX_TILE, MATRIX_PIECE = 2048, 131_072
#: The same row by row: rows on a side of a tile, left and right rows that leave it at once, and rows of the result for each task.
ROWS_TILE, ROWS_LEFT, ROWS_RIGHT, ROWS_TASK = 4096, 1024, 128, 2 * 8192**2
#: Settings with which a matrix is stored at its least: the dictionary has room for every number of six digits from -1 to 1.
STORED_MATRIX = {"parquet.dictionary.page.size": str(16 << 20), "spark.sql.parquet.compression.codec": "zstd"}


def pairwise(rows: DataFrame, keys: list[str], ident: str, vector: str, by_row: bool = False) -> DataFrame:
    """keys, a, b, sim: the cosine of every two different rows of a group, both ways (OP-132).

    ``ident`` (long) names a row. A group is dealt over blocks, and each pair of
    blocks is a tile: the matrix is computed in halves of tiles and mirrored, and
    no task sees a group. Tasks are as many as the result fills tiles. A tile's
    pairs leave it piece by piece in the order of their cosines, each beside its
    mirror image: the cosines, which are most of a stored result, then lie in
    runs that compress. Rows without a usable vector have none.

    ``by_row`` gives the same pairs in another order: one row with up to 128
    others, then these with it. Ids and mirror images then repeat what stands
    shortly before, and a cosine may be stored by its place among the distinct
    ones, if a writer's dictionary has room for them (``STORED_MATRIX``).
    """
    named = rows.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("__g"), *[F.col(k).alias(f"__k_{k}") for k in keys], F.col(ident).cast("long").alias("id"), F.col(vector).alias("v")).where(usable(F.col("v")))
    sizes = kept(named.groupBy(F.col("__g").alias("of")).agg(F.count("*").cast("double").alias("n")))
    pairs = sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    side, of_task = (ROWS_TILE, ROWS_TASK) if by_row else (MATRIX_TILE, 2 * MATRIX_TILE**2)
    tasks = max(int(pairs / of_task), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # groups of more than one block are so few that they can go to all tasks; vectors move by tile only, never by group
    large = sizes.where(F.col("n") > side).select("of", F.ceil(F.col("n") / side).cast("int").alias("blocks"))
    placed = named.join(F.broadcast(large), F.col("__g") == F.col("of"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"ti": F.least("block", "other"), "tj": F.greatest("block", "other")})
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*keys).schema}
    piece, most_left, most_right = MATRIX_PIECE, ROWS_LEFT, ROWS_RIGHT

    def run_by_row(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, (ti, tj) = pd.concat(batches, ignore_index=True), key[-2:]
        left = tile[tile["block"] == ti].sort_values("id")
        right = left if ti == tj else tile[tile["block"] == tj].sort_values("id")
        ids, vectors = [x["id"].to_numpy() for x in (left, right)], [_vectors(x["v"]) for x in (left, right)]
        own = tile.iloc[:1]
        for q in range(0, len(right), most_right):
            to = min(q + most_right, len(right))
            for p in range(0, to if ti == tj else len(left), most_left):
                x, y = np.broadcast_arrays(ids[0][p : p + most_left, None], ids[1][q:to])
                sims = likeness((["x"] * len(x), ["x"] * len(y[0])), (vectors[0][p : p + most_left], vectors[1][q:to]))
                half = np.arange(p, p + len(x))[:, None] < np.arange(q, to) if ti == tj else np.ones(sims.shape, dtype=bool)
                a, b, sim = (np.stack(both, axis=1)[np.stack((half, half), axis=1)] for both in ((x, y), (y, x), (sims, sims)))
                of_group = {n: own[f"__k_{n}"].repeat(len(a)).reset_index(drop=True) for n in keys}
                yield pd.DataFrame({**of_group, "a": a, "b": b, "sim": sim})

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, (ti, tj) = pd.concat(batches, ignore_index=True), key[-2:]
        left = tile[tile["block"] == ti].sort_values("id")
        right = left if ti == tj else tile[tile["block"] == tj].sort_values("id")
        texts = [["x"] * len(side) for side in (left, right)]
        sims = likeness((texts[0], texts[1]), (_vectors(left["v"]), _vectors(right["v"])))
        half = np.flatnonzero(np.triu(np.ones(sims.shape, dtype=bool), 1)) if ti == tj else np.arange(sims.size)
        half = half[np.argsort(sims.ravel()[half])]
        ids = left["id"].to_numpy(), right["id"].to_numpy()
        own = tile.iloc[:1]
        for k in range(0, len(half), piece):
            x, y = np.divmod(half[k : k + piece], len(right))
            a, b = ids[0][x], ids[1][y]
            of_group = {n: own[f"__k_{n}"].repeat(2 * len(x)).reset_index(drop=True) for n in keys}
            yield pd.DataFrame({**of_group, "a": np.column_stack([a, b]).ravel(), "b": np.column_stack([b, a]).ravel(), "sim": sims[x, y].repeat(2)})

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "a long", "b long", "sim double"])
    # ranges of a hash hold as many rows each, where hashed tiles would fall together by chance
    dealt = F.xxhash64("__g", "ti", "tj").alias("place"), "__g", "ti", "tj", "block", "id", "v", *[f"__k_{k}" for k in keys]
    tiles = placed.select(*dealt).repartitionByRange(tasks, "place").withColumn("v", unit(F.col("v")))
    return tiles.groupBy("place", "__g", "ti", "tj").applyInPandas(run_by_row if by_row else run, schema)
