"""Order statistics of groups of any size, and the first n rows of an order for any n.

No group is sorted, buffered or gathered. A value becomes a 64-bit key that keeps
its order; a pass counts the keys of each group by their next 16 bits and goes on
in the bin that holds the rank that is sought. Bins are counted where the rows
are, so a group of all rows is as good as many, and a pass hands on at most 2**16
numbers for each rank. Four passes pin any rank, and integers of a small range
take one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gradewell.operators.ranks import running, same_keys
from gradewell.sources.files import kept

#: Bits of a pass.
DIGIT = 16
#: Rows at the end of the first n that are sorted at once.
BOUNDARY_ROWS = 10_000
_LEAST = -(2**63)


def double_bits(value: Column) -> Column:
    """The bits of a double's magnitude as a long, by exact arithmetic: powers of two scale without rounding."""
    v = F.abs(value.cast("double"))
    near = F.greatest(F.least(F.floor(F.log2(v)), F.lit(1023)), F.lit(-1022)).cast("double")
    m = v / F.pow(F.lit(2.0), near)  # the logarithm may be off by one beside a power of two
    exponent = near + F.when((m >= 2) & (near < 1023), 1).when((m < 1) & (near > -1022), -1).otherwise(0)
    fraction = ((v / F.pow(F.lit(2.0), exponent)) * F.lit(2.0**52)).cast("long")
    normal = (exponent.cast("long") + 1022) * F.lit(2**52) + fraction
    # below 2 ** -1022 the exponent stays and the fraction has no leading one: the same sum
    return F.when(F.isnan(value), F.lit(0x7FF8 << 48)).when(v == float("inf"), F.lit(0x7FF << 52)).when(v == 0, F.lit(0)).otherwise(normal)


def order_key(value: Column, kind: T.DataType) -> Column:
    """A long that orders like the value: numbers, dates, timestamps, booleans; NaN is the greatest, as in Spark."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        bits = double_bits(value)
        return F.when((value < 0) & ~F.isnan(value), -bits).otherwise(bits)
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (value * F.lit(10**kind.scale).cast("decimal(20,0)")).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(value.cast("timestamp"))
    if isinstance(kind, T.IntegralType | T.BooleanType):
        return value.cast("long")
    raise ValueError(f"values of type {kind.simpleString()} have no 64-bit key")


def hash_key(digest: Column) -> Column:
    """A long that orders like a hexadecimal digest does by its first 16 digits."""
    return F.conv(F.left(digest, F.lit(16)), 16, -10).cast("long").bitwiseXOR(F.lit(_LEAST))


def _shifts(low: int, high: int) -> list[int]:
    """How far keys are shifted in each pass, so that the passes see all bits in which keys differ."""
    bits = max(1, ((low - _LEAST) ^ (high - _LEAST)).bit_length())
    return [max(bits - DIGIT * (k + 1), 0) for k in range(-(-bits // DIGIT))]


def _prefix(key: Column, shift: int) -> Column:
    return F.shiftrightunsigned(key.bitwiseXOR(F.lit(_LEAST)), shift)


def select_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, n (values that aren't null), low, high, and for each name the value at a rank of the group.

    ``ranks`` gives ranks from 0 as functions of n. Nulls are left out, a group
    without values has nulls, and a null key is a group like others. Ties are
    values like others. ``rows`` are read once; what is kept of them is keys and
    value. An empty table gives an empty result.
    """
    kind = rows.schema[value].dataType
    thin = kept(rows.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], F.col(value).alias("__v")))
    groups = [f"__g{i}" for i in range(len(keys))]
    keyed = thin.withColumn("__k", order_key(F.col("__v"), kind))
    whole = kept(keyed.groupBy(*groups).agg(F.count("__v").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.min("__k").alias("__first"), F.max("__k").alias("__last")))
    low, high = whole.agg(F.min("__first"), F.max("__last")).first()
    sought = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("__n")).cast("long").alias("rank")) for name, rank in ranks.items()]))
    targets = whole.where("__n > 0").select(*groups, sought.alias("__x")).select(*groups, "__x.name", F.col("__x.rank").alias("rank"), F.lit(0).cast("long").alias("parent"))
    parent_of, found = F.lit(0).cast("long"), targets.withColumn("value", F.lit(None).cast(kind))
    for shift in _shifts(low, high) if low is not None else []:
        counted = keyed.where("__v IS NOT NULL").withColumns({"parent": parent_of, "prefix": _prefix(F.col("__k"), shift)})
        wanted = targets.select(*[F.col(g).alias(f"{g}w") for g in groups], F.col("parent").alias("wanted")).distinct()
        counted = counted.join(wanted, reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"{g}w")) for g in groups], F.col("parent") == F.col("wanted")), "left_semi")
        bins = counted.groupBy(*groups, "parent", "prefix").agg(F.count("*").alias("in_bin"), F.min("__v").alias("value"))
        # at most 2 ** 16 bins for each rank
        until = F.sum("in_bin").over(Window.partitionBy(*groups, "parent").orderBy("prefix"))
        bins = bins.withColumn("until", until).select(*[F.col(g).alias(f"{g}b") for g in groups], F.col("parent").alias("of"), "prefix", "in_bin", "until", "value")
        hit = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"{g}b")) for g in groups], F.col("parent") == F.col("of"))
        before = F.col("until") - F.col("in_bin")
        met = targets.join(bins, hit).where((F.col("rank") >= before) & (F.col("rank") < F.col("until")))
        found = kept(met.select(*groups, "name", (F.col("rank") - before).alias("rank"), F.col("prefix").alias("parent"), "value"))
        targets, parent_of = found.drop("value"), _prefix(F.col("__k"), shift)
    values = found.groupBy(*groups).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks])
    out = whole.join(values.withColumnsRenamed({g: f"{g}r" for g in groups}), same_keys(groups, "", "r"), "left")
    return out.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col("__n").alias("n"), F.col("__low").alias("low"), F.col("__high").alias("high"), *ranks)


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """keys, n, and for each name the quantile, interpolated between the two nearest ranks; nulls as in ``select_ranks``."""

    def at(n: Column, q: float) -> Column:
        return (n - 1).cast("double") * F.lit(q)

    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, q in wanted.items():
        ranks[f"__lower_{name}"] = lambda n, q=q: F.floor(at(n, q))
        ranks[f"__upper_{name}"] = lambda n, q=q: F.ceil(at(n, q))
    found = select_ranks(rows, keys, value, ranks)

    def between(name: str, q: float) -> Column:
        lower, upper = (F.col(f"__{side}_{name}").cast("double") for side in ("lower", "upper"))
        share = at(F.col("n"), q) - F.floor(at(F.col("n"), q))
        return F.when(lower == upper, lower).otherwise(lower + (upper - lower) * share)

    return found.select(*keys, "n", *[between(name, q).alias(name) for name, q in wanted.items()])


def first_n(rows: DataFrame, n: int, key: Column, *order: Column | str) -> DataFrame:
    """The first ``n`` rows by a 64-bit key (``order_key``, ``hash_key``) and then by ``order``, for any n.

    Passes over the key's histogram find the bin in which the n-th row lies. The
    rows before it are a filter; of its own rows the first ones are taken at once
    if they are few, and by their place in a distributed order if they aren't
    (very many rows of one key). Rows with a null key are left out. All columns
    of ``rows`` are kept; ``bitwise_not`` of a key gives the descending order.
    """
    if n <= 0:
        return rows.limit(0)
    keyed = rows.withColumn("__k", key).where("__k IS NOT NULL")
    total, low, high = keyed.agg(F.count("*"), F.min("__k"), F.max("__k")).first()
    if n >= total:
        return keyed.drop("__k")
    left, chosen, pinned = n, 0, None
    for shift in _shifts(low, high):
        counted = keyed if pinned is None else keyed.where(_prefix(F.col("__k"), pinned[1]) == pinned[0])
        bins = counted.groupBy(_prefix(F.col("__k"), shift).alias("prefix")).agg(F.count("*").alias("c")).withColumn("until", F.sum("c").over(Window.orderBy("prefix")))
        hit = bins.where(F.col("until") >= left).orderBy("prefix").first()  # of at most 2 ** 16 bins
        left, chosen, pinned = left - (hit["until"] - hit["c"]), hit["c"], (hit["prefix"], shift)
        if chosen == left or chosen <= BOUNDARY_ROWS:
            break
    bin_no, shift = pinned
    ours = _prefix(F.col("__k"), shift)
    if shift == 0:  # compared as signed keys: the whole key is the prefix
        before = F.col("__k") < F.lit(bin_no).bitwiseXOR(F.lit(_LEAST))
    else:
        before = ours < bin_no
    if chosen == left:
        return keyed.where(before | (ours == bin_no)).drop("__k")
    last = keyed.where(ours == bin_no)
    if chosen <= BOUNDARY_ROWS:
        last = last.orderBy("__k", *order).limit(left)
    else:
        last = running(last, [], ["__k", *order]).where(F.col("place") < left).drop("place", "size")
    return keyed.where(before).unionByName(last).drop("__k")
