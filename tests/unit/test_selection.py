"""Selection, places and running sums over groups of any size."""

import datetime
import decimal
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.operators import asof, selection
from gradewell.operators.pairing import cross_author_pairs, seeded
from gradewell.operators.ranks import running
from gradewell.operators.selection import first_n, hash_key, order_key, quantiles, select_ranks


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bits_are_the_doubles(spark):
    r = random.Random(1)
    powers = [2.0**k for k in range(-1074, 1024, 7)] + [2.0**k for k in (-1074, -1073, -1023, -1022, -1021, -52, -1, 0, 1, 52, 53, 1022, 1023)]
    values = [0.0, -0.0, math.inf, math.nan, 1.7976931348623157e308, 5e-324, 0.1, 1 / 3, *powers]
    values += [f(p) for p in powers for f in (lambda p: math.nextafter(p, 0), lambda p: math.nextafter(p, math.inf))]
    values += [r.uniform(0, 10.0 ** r.randint(-300, 300)) for _ in range(2000)]
    values += [-v for v in values if v and not math.isnan(v)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_key(F.col("v"), spark.createDataFrame([], "v double").schema["v"].dataType).alias("k")).collect()
    for row in rows:
        bits = int(np.array([abs(row["v"])]).view(np.int64)[0])
        assert row["k"] == (-bits if row["v"] < 0 else bits)


@pytest.mark.parametrize(("kind", "values"), [
    ("int", [5, -3, 0, 2**31 - 1, -(2**31)]), ("bigint", [0, 2**63 - 1, -(2**63), -1]), ("float", [0.5, -2.0, 1e-40, math.inf]), ("boolean", [True, False]),
    ("decimal(18,3)", [decimal.Decimal("1.005"), decimal.Decimal("-99999999999999.999"), decimal.Decimal(0)]),
    ("date", [datetime.date(1969, 1, 1), datetime.date(2024, 2, 29)]), ("timestamp_ntz", [datetime.datetime(1960, 5, 5, 1, 2, 3, 4), datetime.datetime(2030, 1, 1)]),
])
def test_keys_keep_the_order(spark, kind, values):
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    keys = {r["v"]: r["k"] for r in rows.select("v", order_key(F.col("v"), rows.schema["v"].dataType).alias("k")).collect()}
    assert sorted(keys, key=keys.get) == sorted(keys)


def test_keys_of_other_types_are_refused(spark):
    with pytest.raises(ValueError, match="string"):
        order_key(F.col("v"), spark.createDataFrame([], "v string").schema["v"].dataType)


def brute_quantile(values, q):
    values = sorted(values)
    at = (len(values) - 1) * q
    return values[math.floor(at)] + (values[math.ceil(at)] - values[math.floor(at)]) * (at - math.floor(at))


@pytest.mark.parametrize("groups", [1, 7])
def test_quantiles_of_groups(spark, groups):
    r = random.Random(groups)
    kinds = [lambda: r.uniform(-1, 1), lambda: r.choice([1.5, 2.5]), lambda: 10.0 ** r.randint(-200, 200) * r.choice([1, -1]), lambda: float(r.randint(0, 9))]
    rows = [(None if k % groups == 3 else f"g{k % groups}", k % 2, r.choice(kinds)() if r.random() < 0.95 else None) for k in range(4000)]
    rows += [("empty", 0, None), ("one", 0, 7.25), ("same", 1, 3.0), ("same", 1, 3.0)]
    by = defaultdict(list)
    for a, b, v in rows:
        by[a, b] += [] if v is None else [v]
    frame = spark.createDataFrame(rows, "a string, b int, v double")
    wanted = {"q1": 0.01, "med": 0.5, "p95": 0.95, "top": 1.0}
    got = quantiles(frame, ["a", "b"], "v", wanted).collect()
    assert len(got) == len(by)
    for row in got:
        values = by[row["a"], row["b"]]
        assert row["n"] == len(values)
        for name, q in wanted.items():
            assert row[name] is None if not values else math.isclose(row[name], brute_quantile(values, q), rel_tol=1e-12, abs_tol=1e-300)


def test_ranks_of_whole_table_and_types(spark):
    r = random.Random(5)
    values = [r.randint(-(2**62), 2**62) for _ in range(3000)] + [2**63 - 1, -(2**63)]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    (row,) = select_ranks(frame, [], "v", {"first": lambda n: n * 0, "mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1}).collect()
    values.sort()
    assert tuple(row) == (len(values), values[0], values[-1], values[0], values[len(values) // 2], values[-1])
    assert select_ranks(frame.limit(0).withColumn("k", F.lit(1)), ["k"], "v", {"mid": lambda n: n}).isEmpty()
    (nan,) = select_ranks(spark.createDataFrame([(1.0,), (math.nan,), (math.inf,)], "v double"), [], "v", {"a": lambda n: n - 2, "b": lambda n: n - 1}).collect()
    assert nan["a"] == math.inf and math.isnan(nan["b"])


def test_no_pass_holds_a_group(spark):
    frame = spark.range(50_000).select((F.col("id") % 2).alias("g"), F.sqrt("id").alias("v"))
    plan = quantiles(frame, ["g"], "v", {"med": 0.5})._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 1500, 2999, 3000, 5000])
def test_first_n(spark, monkeypatch, many_partitions, n):
    monkeypatch.setattr(selection, "BOUNDARY_ROWS", 5)
    # a key that holds a third of the rows
    rows = [(k if k % 3 else 777, k) for k in range(3000)]
    frame = spark.createDataFrame([*rows, (None, None)], "a long, b long")
    want = sorted(sorted((seed(a), a, b) for a, b in rows)[:n])
    got = first_n(frame.where("a IS NOT NULL"), n, hash_key(seeded(3, "a")), "a", "b").collect()
    assert sorted((seed(r["a"]), r["a"], r["b"]) for r in got) == want
    down = first_n(frame, n, F.bitwise_not(order_key(F.col("b"), frame.schema["b"].dataType))).collect()
    assert sorted(r["b"] for r in down) == sorted(sorted((b for _, b in rows), reverse=True)[:n])


def seed(a):
    import hashlib

    return hashlib.md5(f"3|{a}".encode()).hexdigest()


def test_places_and_sums_of_a_group_over_many_partitions(spark, many_partitions):
    r = random.Random(4)
    rows = [("hot" if k % 10 else None, r.randint(0, 10**6) * 10_000 + k, r.randint(0, 9)) for k in range(4000)]
    frame = spark.createDataFrame(rows, "g string, o long, v int")
    found = running(frame, ["g"], ["o"], {"s": "v"})
    got = {x["o"]: (x["g"], x["place"], x["size"], x["s"], x["s_total"]) for x in found.collect()}
    for g in ("hot", None):
        own, total = sorted((o, v) for h, o, v in rows if h == g), 0
        for place, (o, v) in enumerate(own):
            total += v
            assert got[o] == (g, place, len(own), total, sum(v for _, v in own))
    # windows are over a partition's part of a group, or over one row for each partition, in the order of partitions
    specs = re.findall(r"windowspecdefinition\(([^(]*)", found._jdf.queryExecution().toString())
    assert specs and all("__r_part" in x for x in specs)
    parts = frame.repartitionByRange("g", "o").where("g = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert parts > 1
    assert sorted(x["place"] for x in running(frame, [], ["o"]).collect()) == list(range(4000))
    assert running(frame.limit(0), ["g"], ["o"]).isEmpty()
    with pytest.raises(ValueError, match="place"):
        running(frame.withColumn("place", F.lit(1)), ["g"], ["o"])


def test_cross_author_pairs_of_one_key(spark, many_partitions):
    r = random.Random(8)
    failing = [("p", f"u{r.randint(0, 9)}", k) for k in range(150)]
    passing = [("p", f"u{r.randint(0, 9)}", 1000 + k) for k in range(120)]
    made = cross_author_pairs(spark.createDataFrame(failing, "p string, u string, fail long"), spark.createDataFrame(passing, "p string, u string, ok long"), ["p"], "u", 15, 7, "fail", "ok").collect()
    pairs = [(f, o) for _, u, f in sorted(failing, key=lambda x: x[2]) for _, w, o in sorted(passing, key=lambda x: (x[1], x[2])) if u != w]
    import hashlib

    first, step = int(hashlib.md5(b"7|p").hexdigest()[:8], 16) % len(pairs), len(pairs) // 15
    assert sorted((x["fail"], x["ok"]) for x in made) == sorted(pairs[(first + k * step) % len(pairs)] for k in range(15))


def brute_nearest(targets, candidates, key, preferred=None):
    out = []
    for t in targets:
        same = [c for c in candidates if key(c) == key(t) and c["v"] is not None]
        if preferred and t[preferred] is not None:
            same = [c for c in same if c[preferred] == t[preferred]] or same
        if t["v"] is not None and same:
            best = min(same, key=lambda c: (abs(c["v"] - t["v"]), c["name"]))
            out.append((t["t"], best["name"], abs(best["v"] - t["v"])))
    return sorted(out)


def test_nearest_value(spark, many_partitions):
    r = random.Random(2)
    some = lambda: r.choice([None, *range(-20, 60)])
    users = ["hot"] * 6 + ["a", "b", "c", None]
    candidates = [{"u": r.choice(users), "lang": r.choice(["x", "y", None]), "v": some(), "name": k} for k in range(300)] + [{"u": "far", "lang": "x", "v": 5, "name": 900}]
    targets = [{"u": r.choice([*users, "nobody", "far"]), "lang": r.choice(["x", "y", "z", None]), "v": some(), "t": k} for k in range(400)]
    c, t = spark.createDataFrame(candidates, "u string, lang string, v int, name long"), spark.createDataFrame(targets, "u string, lang string, v int, t long")
    got = asof.nearest(t, c, ["u"], "v", "t", "name")
    assert sorted(map(tuple, got.collect())) == brute_nearest(targets, candidates, lambda x: x["u"])
    plan = got._jdf.queryExecution().toString()
    # windows are over a partition's part of a key, or in the order of partitions
    assert all("__part" in x for x in re.findall(r"windowspecdefinition\(([^(]*)", plan)) and "CartesianProduct" not in plan
    got = asof.nearest_preferred(t, c, ["u"], "lang", "v", "t", "name")
    assert sorted(map(tuple, got.collect())) == brute_nearest(targets, candidates, lambda x: x["u"], "lang")
    assert asof.nearest(t, c.limit(0), ["u"], "v", "t", "name").isEmpty() and asof.nearest(t.limit(0), c, ["u"], "v", "t", "name").isEmpty()
