"""Likeness by vectors: joins, alignment, gaps; nearest vectors of odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.operators import gaps, nearest, semantic
from gradewell.plans import catalog
from gradewell.session import with_settings

SEGMENT = "struct<matches_problem: boolean, text: string, algorithm: string, data_structures: array<string>, key_operations: array<string>, potential_issues: array<string>>"


def words(a, b):
    x, y = ({w for w in (t or "").lower().split(" ") if w} for t in (a, b))
    return len(x & y) / max(len(x | y), 1)


def like(a, b, vectors):
    if not a or not b:
        return 0.0
    v, w = (vectors.get(x) for x in (a, b))
    if v is None or w is None:
        return words(a, b)
    if len(v) != len(w):
        return 0.0
    n = np.linalg.norm(v) * np.linalg.norm(w)
    return 0.0 if n < 1e-9 else round(float(np.dot(v, w) / n), 9)


def some_vectors(r, names):
    out = {}
    for k, name in enumerate(names):
        out[name] = [r.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(3 if k % 10 else 2)] if k % 4 else None
    out["zero"] = [0.0, 0.0, 0.0]
    return out


def test_units(spark):
    rows = [[3.0, 4.0], [0.0, 0.0], [], None, [1.0, None], [math.nan, 1.0], [math.inf, 1.0]]
    got = [r["u"] for r in spark.createDataFrame([(v,) for v in rows], "v array<double>").select(semantic.unit(F.col("v")).alias("u")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0], None, None, None, None, None]


@pytest.mark.parametrize("tile", [2048, 3])
def test_semantic_join(spark, monkeypatch, tile):
    monkeypatch.setattr(semantic, "TILE", tile)
    r = random.Random(tile)
    names = [f"{r.choice('abc')} {r.choice('xyz')} w{k}" for k in range(30)]
    vectors = some_vectors(r, names)
    rows = lambda n, first: [(r.choice(["hot"] * 5 + ["k", None]), first + k, r.choice([*names, "zero", "", None, "other text"])) for k in range(n)]
    left, right = rows(60, 0), rows(80, 1000) + [("lonely", 5000, "a")]
    as_frame = lambda x: spark.createDataFrame([(g, i, t, vectors.get(t)) for g, i, t in x], "g string, id long, text string, vector array<double>").withColumn("vector", semantic.unit(F.col("vector")))
    for least in (0.0, 0.5):
        want = []
        for g, i, t in left:
            best = max(((like(t, u, vectors), -j) for h, j, u in right if h == g), default=None)
            if best and best[0] >= least:
                want.append((i, -best[1], best[0]))
        got = [tuple(x) for x in semantic.semantic_join(as_frame(left), as_frame(right), ["g"], least).collect()]
        assert sorted((i, j, round(s, 8)) for i, j, s in got) == sorted((i, j, round(s, 8)) for i, j, s in want)


def test_known_texts_and_gaps(spark):
    r = random.Random(3)
    phrases = gaps.Phrases(severe=("bad result", "zero"), minor=("small thing",), output=("output wrong",), concepts=(("c1", ("first idea", "zero")), ("c2", ("second idea",))))
    names = ["sort it", "read it", "print it", "sum it", "small thing", "bad result", "output wrong", "first idea", "second idea", "Heap", "set of pairs", "bfs", "walk graph"]
    vectors = {n: [r.uniform(-1, 1) for _ in range(3)] if k % 5 else None for k, n in enumerate(names)} | {"zero": [0.0, 0.0, 0.0]}
    pick = lambda n: [r.choice([*names, "new words", "zero"]) for _ in range(n)]

    def record():
        return (r.random() < 0.9, "t", r.choice(["bfs", "walk graph", " Greedy ", "parcurgere bfs"]), pick(r.randint(0, 3)), pick(r.randint(0, 4)), pick(r.randint(0, 3)))

    rows = [(k, record(), record()) for k in range(60)]
    frame = spark.createDataFrame(rows, f"id long, a {SEGMENT}, b {SEGMENT}")
    table = spark.createDataFrame([(t, v) for t, v in vectors.items()], "text string, vector array<double>")
    known = semantic.with_known(frame, ["id"], gaps.compared_texts(F.col("a"), F.col("b")), table, phrases.by_kind())
    got = {x["id"]: x["g"] for x in known.select("id", gaps.gap(F.col("a"), F.col("b"), F.lit(0.9), phrases, F.col("known")).alias("g")).collect()}
    best = lambda t, pool: max(((like(t, p, vectors), -i) for i, p in enumerate(pool)), default=(0.0, 1))
    levels = set()
    for k, a, b in rows:
        g = got[k]
        names_of = [x[2].strip().lower() for x in (a, b)]
        canonical = ["bfs" if n in ("bfs", "parcurgere bfs") else n for n in names_of]
        level = "intent" if not a[0] else "function" if canonical[0] != canonical[1] and like(*names_of, vectors) < gaps.ALGORITHM_MATCH else "implementation"
        assert g["gap_level"] == level
        levels.add(level)
        if level == "implementation":
            sims = [best(o, b[4]) for o in a[4]]
            if a[4] and b[4]:
                off = [i for i, s in enumerate(sims) if s[0] < gaps.OPERATION_MATCH]
                used = {-s[1] for s in sims if s[0] >= gaps.OPERATION_MATCH}
                assert g["diverges_at_step"] == (off[0] if off else -1) and g["missing_steps"] == [o for j, o in enumerate(b[4]) if j not in used]
                assert g["match_scores"] == pytest.approx([round(s[0], 3) for s in sims], abs=1.1e-3)
            issues = [(best(i, phrases.severe)[0] - 0.3 * best(i, phrases.minor)[0], -n, i) for n, i in enumerate(a[5])]
            top = max((round(s, 7), n, i) for s, n, i in issues)[2] if issues else ""
            assert g["primary_issue"] == top
            assert g["output_issue"] == any(best(i, phrases.output)[0] >= gaps.OUTPUT_MATCH for i in a[5])
            near = best(top, phrases.by_kind()["concept"])
            if near[0] >= gaps.CONCEPT_MATCH:
                assert g["missing_concept"] == ("c1", "c1", "c2")[-near[1]]
    assert levels == {"intent", "function", "implementation"}


def test_records_without_texts(spark):
    frame = spark.createDataFrame([(1, (True, None, None, None, None, None), (True, None, None, None, None, None))], f"id long, a {SEGMENT}, b {SEGMENT}")
    none = spark.createDataFrame([], "text string, vector array<double>")
    known = semantic.with_known(frame, ["id"], gaps.compared_texts(F.col("a"), F.col("b")), none, gaps.Phrases().by_kind())
    assert known.columns == [*frame.columns, "known"] and known.first()["known"] is None
    assert semantic.with_known(frame.limit(0), ["id"], gaps.compared_texts(F.col("a"), F.col("b")), none, gaps.Phrases().by_kind()).isEmpty()


def test_nearest_vectors_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [None, 1.0]), (5, None), (6, []), (7, [math.nan, 1.0]), (8, [0.0, 1.0]), (9, [2.0, 0.0, 0.1]), (10, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, nearest.top_k(vectors, vectors, 1).collect()))
    assert got == [(1, 2), (2, 1), (3, 9), (8, 2), (9, 3), (10, 1)]
    assert nearest.top_k(vectors.limit(0), vectors, 1).isEmpty()


@pytest.mark.parametrize("tile", [1024, 4])
def test_means_and_matrices_of_groups(spark, monkeypatch, tile):
    monkeypatch.setattr(semantic, "MATRIX_TILE", tile)
    r = random.Random(6)
    rows = [(r.choice(["hot"] * 4 + ["k", None]), r.choice([1, 2]), k, [r.uniform(-1, 1) for _ in range(3 if k % 6 else 2)]) for k in range(70)]
    rows += [("hot", 1, 100, [0.0, 0.0, 0.0]), ("hot", 1, 101, None), ("hot", 1, 102, [None, 1.0, 1.0]), ("one", 1, 103, [1.0, 1.0, 1.0]), ("none", 1, 104, [math.nan])]
    frame = spark.createDataFrame(rows, "g string, h int, i long, v array<double>")
    vectors = {i: v for _, _, i, v in rows if v is not None and None not in v and not any(map(math.isnan, v))}
    pairs = {(g, h, i, j): like(f"{i}", f"{j}", {f"{i}": vectors[i], f"{j}": vectors[j]}) for g, h, i, _ in rows for g2, h2, j, _ in rows if (g, h) == (g2, h2) and i != j and i in vectors and j in vectors}
    got = {(x["g"], x["h"], x["a"], x["b"]): x["sim"] for x in semantic.pairwise(frame, ["g", "h"], "i", "v").collect()}
    assert got.keys() == pairs.keys() and all(abs(got[k] - pairs[k]) < 2e-9 for k in pairs)
    means = {(x["g"], x["h"]): (x["n"], x["mean"]) for x in semantic.mean_likeness(frame, ["g", "h"], "v").collect()}
    assert means[("one", 1)] == (1, None) and ("none", 1) not in means
    for key in {(g, h) for g, h, _, _ in pairs}:
        own = [s for (g, h, _, _), s in pairs.items() if (g, h) == key]
        assert means[key][1] == pytest.approx(sum(own) / len(own), abs=1e-7) and means[key][0] * (means[key][0] - 1) == len(own)
    assert semantic.pairwise(frame.limit(0), ["g", "h"], "i", "v").isEmpty() and semantic.mean_likeness(frame.limit(0), ["g"], "v").isEmpty()


def test_tiles_of_one_group_are_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(semantic, "MATRIX_TILE", 4)
    r = random.Random(8)
    frame = spark.createDataFrame([("hot", k, [r.uniform(-1, 1) for _ in range(3)]) for k in range(64)], "g string, i long, v array<double>").repartition(4)
    for most in ("10m", "-1"):  # also where tables aren't small enough to be sent to all tasks
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            rows = [x["count"] for x in semantic.pairwise(frame, ["g"], "i", "v").groupBy(F.spark_partition_id()).count().collect()]
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert sum(rows) == 64 * 63 and max(rows) < 64 * 63 / 4


@pytest.mark.parametrize("piece", [131_072, 7])
def test_a_matrix_lies_in_the_order_of_its_cosines(spark, monkeypatch, piece):
    monkeypatch.setattr(semantic, "MATRIX_PIECE", piece)
    r = random.Random(9)
    frame = spark.createDataFrame([("g", k, [r.uniform(-1, 1) for _ in range(3)]) for k in range(40)], "g string, i long, v array<double>")
    got = [tuple(x) for x in semantic.pairwise(frame, ["g"], "i", "v").collect()]
    assert [x[3] for x in got] == sorted(x[3] for x in got)
    assert all((a, b, s) == (y, x, t) for (_, a, b, s), (_, x, y, t) in zip(got[::2], got[1::2], strict=True))
    assert {x[1:3] for x in got} == {(a, b) for a in range(40) for b in range(40) if a != b} and len(got) == 40 * 39


@pytest.mark.parametrize("tile", [4096, 5])
def test_a_matrix_by_rows_has_the_same_pairs(spark, monkeypatch, tile):
    for name, n in {"ROWS_TILE": tile, "ROWS_LEFT": tile - 2, "ROWS_RIGHT": 3, "ROWS_TASK": tile**2}.items():
        monkeypatch.setattr(semantic, name, n)
    r = random.Random(10)
    rows = [(r.choice(["hot"] * 4 + ["k", None]), k, [r.uniform(-1, 1) for _ in range(3 if k % 6 else 2)]) for k in range(70)]
    rows += [("hot", 100, [0.0, 0.0, 0.0]), ("hot", 101, None), ("hot", 102, [None, 1.0, 1.0]), ("one", 103, [1.0, 1.0, 1.0]), ("none", 104, [math.nan])]
    frame = spark.createDataFrame(rows, "g string, i long, v array<double>")
    want, got = (sorted(semantic.pairwise(frame, ["g"], "i", "v", by_row).collect(), key=str) for by_row in (False, True))
    assert got and [x[:3] for x in got] == [x[:3] for x in want] and all(abs(x[3] - y[3]) < 2e-9 for x, y in zip(got, want, strict=True))
    assert semantic.pairwise(frame.limit(0), ["g"], "i", "v", by_row=True).isEmpty()


def test_a_stored_matrix_is_small(spark, tmp_path):
    r = np.random.default_rng(11)
    spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(r.normal(size=(1500, 64)))], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = spark.conf.getAll
    catalog.queries()["op_132_pairwise_matrix"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert spark.conf.getAll == before
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1500 * 1499
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 3.5 * 1500 * 1499


def test_settings_beside_a_session(spark):
    other = with_settings(spark, {"spark.sql.shuffle.partitions": "77", "parquet.dictionary.page.size": "2000000"})
    assert other.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert other.conf.get("parquet.dictionary.page.size") == "2000000" and spark.conf.get("parquet.dictionary.page.size", None) is None
