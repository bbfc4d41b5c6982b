"""Columns on small literal rows, with values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from gradewell.functions import classify as C
from gradewell.functions import statements as S
from gradewell.functions import text as T
from gradewell.functions import vector as V


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in TYPES.items() if k in values)) if values else spark.range(1)
    return rows.select(column.alias("v")).first()["v"]


TYPES = {"s": "string", "x": "double", "n": "long", "a": "array<string>"}


@pytest.mark.parametrize(("n", "name"), [(200, "tiny"), (201, "small"), (5000, "small"), (5001, "medium"), (200_000, "medium"), (200_001, "large"), (5_000_001, "stress")])
def test_size_class(spark, n, name):
    assert one(spark, C.size_class(F.col("n")), n=n) == name


@pytest.mark.parametrize(
    ("points", "issue", "loose", "strict", "report"),
    [
        (100.0, "WA", "OK", "OK", "OK"),
        (99.9995, "WA", "OK", "OK", "WA"),
        (50.0, "time limit exceeded", "CE", "TLE", "CE"),
        (50.0, "TLE", "TLE", "TLE", "TLE"),
        (50.0, "segmentation fault", "RE", "RE", "RE"),
        (50.0, "wa, compile", "CE", "CE", "WA"),
        (0.0, "", "WA", "WA", "WA"),
    ],
)
def test_verdicts(spark, points, issue, loose, strict, report):
    row = spark.createDataFrame([(points, [issue])], "p double, i array<string>").select(C.verdict(F.col("p"), F.col("i")), C.verdict_strict(F.col("p"), F.col("i")), C.verdict_report(F.col("p"), F.col("i"))).first()
    assert tuple(row) == (loose, strict, report)


def test_verdict_without_issues(spark):
    assert one(spark, C.verdict(F.lit(10.0), F.lit(None).cast("array<string>"))) == "WA"


def test_solution_file(spark):
    assert tuple(one(spark, C.solution_file(F.col("s")), s="anon_1_57.1.java")) == ("anon_1", 57.1, "java")
    assert one(spark, C.solution_file(F.col("s")), s="notes.txt") is None
    assert one(spark, C.score_in_name(F.col("s"), 50.0), s="none.cpp") == 50.0


def test_submitted_at(spark):
    assert one(spark, C.submitted_at(F.col("s")), s="x_2023.04.05__06.07.08.zip") == datetime.datetime(2023, 4, 5, 6, 7, 8)
    assert one(spark, C.submitted_at(F.col("s")), s="x_2023.14.05__06.07.08.zip") is None
    assert one(spark, C.submitted_at(F.col("s")), s="x") is None


def test_leading_integer(spark):
    assert one(spark, C.leading_integer(F.col("s")), s=" -7 x") == -7
    assert one(spark, C.leading_integer(F.col("s")), s="abc") is None


def test_code_lines(spark):
    source = "int a;\r\n\n  // note\n/* x */\n b  =\t1; \n done */\n"
    assert one(spark, T.code_lines(F.col("s")), s=source) == ["int a;", "b = 1;"]
    assert one(spark, T.loc(F.col("s")), s=source) == 3


def test_counts(spark):
    s = "Ștefan vede două case... Bine! a_1"
    assert one(spark, T.word_count(F.col("s")), s=s) == 6
    assert one(spark, T.sentence_count(F.col("s")), s=s) == 2
    assert one(spark, T.closing_marks(F.col("s")), s=s) == 4
    assert one(spark, T.sentence_count(F.col("s")), s="") == 1


def test_repair_and_fences(spark):
    assert one(spark, T.repair_diacritics(F.col("s")), s="ˆın s , i t,  a˘ ") == "în și ță "
    assert one(spark, T.strip_fences(F.col("s")), s='```json\n{"a": 1}\n```') == '{"a": 1}'


def test_cap_text(spark):
    assert one(spark, T.cap_text(F.col("s"), 10), s="abcdefghijk") == "abcdefg..."
    assert one(spark, T.cap_text(F.col("s"), 10), s="abcdefghij") == "abcdefghij"


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    v = row.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("z"))).first()
    assert v[0] == pytest.approx(0.96) and v[1] == 0.0


def test_longest_chunks(spark):
    text = "intro sum and more\nSum is long here and goes on\nmax"
    rows = [(1, text), (2, ""), (3, None), (4, "summary maxsum sum_1"), (5, "MAX a.b SUM a.b xx max.sum c++"), (6, "sum one sum two"), (7, "fără SUMă, sum-ă")]
    docs = spark.createDataFrame(rows, "id long, text string")
    chunks = lambda names: {(r["id"], r["name"]): r["chunk"] for r in S.longest_chunks(docs, ["id"], names).collect()}
    assert chunks(["sum", "max", ""]) == {(1, "sum"): "Sum is long here and goes on\n", (1, "max"): "max", (5, "max"): "MAX a.b ", (5, "sum"): "SUM a.b xx ", (6, "sum"): "sum one ", (7, "sum"): "sum-ă"}
    assert chunks(["a.b", "c++"])[(5, "a.b")] == "a.b xx max.sum " and chunks(["a.b", "c++"])[(5, "c++")] == "c++"
    assert chunks([]) == chunks([""]) == {}
