"""Operators on small frames; properties of splits, resumption and trimming."""

import difflib
import hashlib
import io
import json
import math
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from gradewell.functions import statements
from gradewell.operators import annotate, contracts, gaps, nearest, pairing, providers, references, rubric, tfidf
from gradewell.operators.diffs import diff_lines, difference, matching_blocks, summary, template_hints
from gradewell.operators.splits import grouped_split
from gradewell.operators.tfidf import similarities
from gradewell.plans import checks
from gradewell.sources import archives, files


def test_split_is_disjoint_and_sized(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("p"), (F.col("id") % 60).alias("g"), "id")
    out = grouped_split(rows, "p", "g", 0.8, 0.1, 23)
    assert out.count() == 3000
    groups = out.select("p", "g", "split").distinct()
    assert groups.groupBy("p", "g").count().where("count > 1").isEmpty()
    assert {(r["split"], r["count"]) for r in groups.groupBy("p", "split").count().collect()} == {("train", 16), ("val", 2), ("test", 2)}


def test_small_stratum_trains(spark):
    rows = spark.createDataFrame([("a", None)], "p string, g string")
    assert grouped_split(rows, "p", "g", 0.8, 0.1, 1).first()["split"] == "train"


def test_resume_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    assert pairing.not_done(rows, rows, ["k", "v"]).isEmpty()
    assert pairing.not_done(rows, rows.limit(0), ["k"]).count() == 3
    assert sorted(r["v"] or "" for r in pairing.upsert(rows, rows.where("k = 1").withColumn("v", F.lit("z")), ["k"]).collect()) == ["", "c", "z"]


def test_cross_pairs_by_brute_force(spark):
    """Evenly spaced pairs of other authors, chosen from all; hot keys and authors without others among them."""
    fails = [("hot", k % 7, k) for k in range(60)] + [("few", 1, 100), ("few", 2, 101), ("own", 5, 200)]
    passes = [("hot", k % 5, 1000 + k) for k in range(40)] + [("few", 1, 1100), ("own", 5, 1200), ("none", 1, 1300)]
    a = spark.createDataFrame(fails, "p string, author int, f long")
    b = spark.createDataFrame(passes, "p string, author int, o long")
    want = []
    for key in {p for p, _, _ in fails}:
        pairs = [(key, f, o) for p, x, f in sorted(fails) for q, y, o in sorted(passes) if p == q == key and x != y]
        pairs.sort(key=lambda r: (r[1], next(y for _, y, o in passes if o == r[2]), r[2]))
        if pairs:
            first, step = int(hashlib.md5(f"7|{key}".encode()).hexdigest()[:8], 16) % len(pairs), max(1, len(pairs) // 15)
            want += [pairs[(first + k * step) % len(pairs)] for k in range(min(15, len(pairs)))]
    got = [tuple(r) for r in pairing.cross_author_pairs(a, b, ["p"], "author", 15, 7, "f", "o").collect()]
    assert sorted(got) == sorted(want) and len(set(got)) == len(got) == 16


def test_nearest_by_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x = {k: r.standard_normal(6).round(1) for k in range(90)} | {90: np.zeros(6)}
    x[50] = x[3].copy()
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in x.items()] + [(99, None)], "vec_id long, embedding array<double>")
    unit = {k: v / max(np.linalg.norm(v), 1e-9) for k, v in x.items()}
    nearest.VECTOR_BLOCK, nearest.QUERY_BLOCK = 20, 5
    got = sorted(map(tuple, nearest.top_k(rows, rows.where("vec_id % 3 = 0"), 4).collect()))
    nearest.VECTOR_BLOCK, nearest.QUERY_BLOCK = 16_384, 1024
    want = [(q, k) for q in x if q % 3 == 0 for k in sorted((k for k in x if k != q), key=lambda k: (-round(float(unit[q] @ unit[k]), 9), k))[:4]]
    assert got == sorted(want)


def test_byte_cut_by_brute_force(spark):
    texts = ["aé中🙂" * 3, "", "plain ascii", "é" * 9]
    for most in range(1, 14):
        got = [r["v"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(files.safe_text(F.encode("t", "UTF-8"), most).alias("v")).collect()]
        # what is left of a cut character is one or more replacement marks
        assert [g.rstrip("\ufffd") for g in got] == [t.encode()[:most].decode("utf-8", "ignore") for t in texts]


def test_writers_leave_nothing_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "DOCUMENT_ROWS", 5)
    files.write_document(spark.range(5), f"file://{tmp_path}/d")
    assert files.read_document(spark, f"file://{tmp_path}/d", "id long").count() == 5
    with pytest.raises(ValueError):
        files.write_document(spark.range(6), f"file://{tmp_path}/e")
    with pytest.raises(ValueError):
        files.markdown(spark.range(6), 5)
    assert files.markdown(spark.range(2)).split("\n")[1:] == ["| --- |", "| 0 |", "| 1 |"]


def test_template_outputs():
    class Encoding:
        ids = [1, 2]

    assert providers.template_ids([1, 2]) == providers.template_ids({"input_ids": [[1, 2]]}) == providers.template_ids({"input_ids": [1, 2]}) == providers.template_ids([Encoding()]) == [1, 2]
    with pytest.raises(TypeError):
        providers.template_ids(7)
    assert providers.json_object('```json\n{"a": 1}\n```') == {"a": 1} == providers.json_object('so {"a": 1} it is') and providers.json_object("[1]") is None


def test_tfidf_of_equal_and_foreign_texts(spark):
    texts = spark.createDataFrame([(1, "0", "alpha beta"), (1, "1", "nothing shared"), (1, "2", ""), (1, "statement", "alpha beta"), (1, "solution", "")], "grp long, doc string, text string")
    got = {r["doc"]: (r["sim_statement"], r["sim_solution"]) for r in similarities(texts, ["statement", "solution"]).collect()}
    assert got["0"][0] == pytest.approx(1.0)
    assert got["1"] == (0.0, 0.0) and got["2"] == (0.0, 0.0)


@pytest.mark.parametrize("query", [checks.tfidf, checks.similarity_caps, checks.rubric_report, checks.trim_and_retry, checks.metric_backfill])
def test_tasks_of_terms_stay_small(spark, tmp_path, monkeypatch, query):
    """Four times the text is four times the tasks, moved once; terms are sorted at most twice and what is kept of a text isn't sorted with them."""
    monkeypatch.setattr(tfidf, "TASK_CHARS", 1000, raising=False)
    turns = [("user", "what is asked for here"), ("system", "the words of a solution"), ("assistant", GOOD), ("assistant", GOOD + " More words.")]
    tasks = []
    for copies in (50, 200):
        rows = [(k, i, role, text) for k in range(copies) for i, (role, text) in enumerate(turns)]
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/{copies}/conversations.parquet")
        found = query(spark, f"{tmp_path}/{copies}")
        plan = found._jdf.queryExecution().executedPlan().toString()
        branches = 2 if query is checks.metric_backfill else 1
        assert plan.count("Exchange hashpartitioning") == branches and plan.count("REPARTITION_BY_NUM") == branches
        tasks.append(found.rdd.getNumPartitions())
    assert 3.5 * tasks[0] <= tasks[1] <= 4.5 * tasks[0] and tasks[0] > 4


def test_similarities_of_groups_with_several_keys(spark):
    """Groups that several columns name, terms beyond the most that are kept, and what is kept of texts that are null or alike."""
    texts = [("a", 1, "0", "x1 x2 x1 x3", [1]), ("a", 1, "s", "x1 x2", None), ("a", 2, "0", "x1 x2", [2]), ("a", 2, "s", "y1 y2", None), (None, 1, "0", None, [3]), (None, 1, "s", "x1", None)]
    rows = spark.createDataFrame(texts, "k string, j int, doc string, text string, own array<int>")
    found = similarities(rows, ["s"], keep=("own",), groups=("k", "j")).collect()
    assert sorted((x["k"] or "", x["j"], x["doc"], x["own"]) for x in found if x["doc"] == "0") == [("", 1, "0", [3]), ("a", 1, "0", [1]), ("a", 2, "0", [2])] and len(found) == 6
    sims = {(x["k"], x["j"], x["doc"]): x["sim_s"] for x in found}
    idf = math.log(3 / 2) + 1
    long, short = [2.0, 1.0, idf, 1.0, idf, idf], [1.0, 1.0, 1.0]  # x1, x2, x3, x1 x2, x2 x1, x1 x3; the short one's are x1, x2, x1 x2
    assert sims["a", 1, "0"] == pytest.approx(4.0 / math.hypot(*long) / math.hypot(*short)) and sims["a", 1, "s"] == pytest.approx(1.0)
    assert sims["a", 2, "0"] == 0.0 and sims[None, 1, "0"] == 0.0
    first = similarities(rows.where("j = 1 AND k IS NOT NULL"), ["s"], max_features=1, groups=("k", "j")).collect()
    assert {x["doc"]: x["sim_s"] for x in first} == {"0": pytest.approx(1.0), "s": pytest.approx(1.0)}


SETS = "set_id long, hints array<string>, statement string, solution string"
GOOD = "Think about the order of the items."


def test_rubric(spark):
    rows = [
        (1, [GOOD], "statement words", "code words"),
        (2, [], "s", "c"),
        (3, [GOOD] * 5, "s", "c"),
        (4, ["too short"], "s", "c"),
        (5, ["Use for (i = 0; i < n) here please now"], "s", "c"),
        (6, ["same text as the statement"], "same text as the statement", "c"),
    ]
    got = {r["set_id"]: (r["passed"], r["violations"]) for r in rubric.validate(spark.createDataFrame(rows, SETS)).collect()}
    assert got[1] == (True, [])
    assert got[2] == (False, ["too_few_hints: 0 < 1"])
    assert got[3][1][0] == "too_many_hints: 5 > 4"
    assert got[4][1] == ["too_short_words:2"]
    assert r"code_token_match:\b(for|while|if|switch)\s*\([^)]*\)" in got[5][1] and r"code_token_match:\b[a-zA-Z_]\w*\s*=\s*[^=]" in got[5][1]
    assert got[6][1] == ["hint0_too_close_to_statement:1.00>0.55"]


def test_retry_keeps_the_longest_prefix_in_order(spark):
    first = "sort the pairs before you merge any of them"
    rows = [(1, [first, "some other words that are not shared"], "zzz", "sort the pairs of values that come first then add many more terms here"), (2, ["x"], "s", "c"), (3, [], "s", "c")]
    got = {r["set_id"]: (r["passed"], r["n_hints"]) for r in rubric.validate_with_retry(spark.createDataFrame(rows, SETS)).collect()}
    assert got[1] == (True, 1)
    assert got[2] == (False, 1) and got[3] == (False, 0)


def test_order_tolerance(spark):
    rows = spark.createDataFrame([([0.5, 0.46],), ([0.5, 0.44],), ([],)], "s array<double>")
    assert [r[0] for r in rows.select(rubric.order_violations(F.col("s"))).collect()] == [[], ["order_inversion_at_1: 0.44 < 0.50"], []]


def test_two_decimals_are_those_of_the_exact_number(spark):
    r = random.Random(7)
    values = [k / 1000 for k in range(0, 3000, 5)] + [k / 8 for k in range(24)] + [r.random() * 3 for _ in range(500)] + [math.nextafter(k / 1000, side) for k in range(5, 2000, 10) for side in (0, 9)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", rubric.shown(F.col("v")).alias("s")).collect()
    assert all(x["s"] == f"{x['v']:.2f}" for x in rows)


def test_differences_hold_few_rows_at_a_time(spark):
    """Row by row, not thousands of rows' lines in a batch of columns; and the same results."""
    r = random.Random(5)
    pairs = [([r.choice("abcdef") for _ in range(r.randrange(9))], [r.choice("abcdef") for _ in range(r.randrange(9))]) for _ in range(300)] + [(None, ["a"]), (["a"], None), (None, None)]
    found = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", diff_lines("a", "b").alias("d"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    rows = found.collect()
    assert len(rows) == len(pairs) and all(tuple(x["d"]) == difference(x["a"] or [], x["b"] or []) for x in rows)


def test_a_set_is_judged_at_most_four_times(spark):
    rows = [(1, ["h"] * 500, "s", "c"), (2, [], "s", "c"), (3, ["h"], "s", "c"), (4, ["h"] * 4, "s", "c")]
    sets = spark.createDataFrame(rows, SETS)
    got = rubric.prefixes(sets).groupBy("set_id").agg(F.sort_array(F.collect_list("k")).alias("k")).collect()
    assert {r["set_id"]: r["k"] for r in got} == {1: [500], 2: [1], 3: [1], 4: [1, 2, 3, 4]}
    many = [(k, [f"some hint of number {i} and words" for i in range(500)], "s", "c") for k in range(2)]
    found = rubric.validate_with_retry(spark.createDataFrame(many, SETS)).collect()
    assert all(r["n_hints"] == 500 and "too_many_hints: 500 > 4" in r["violations"] for r in found)


def test_messages_of_records(spark):
    one = spark.createDataFrame([("it's", 7, ["a"], '{"b": 1, "z": 2, "y": 3}')], "t string, n int, l array<string>, d string")
    checks = contracts.violations(contracts.in_domain(F.col("t"), ("a", "b"), "x"), contracts.in_range(F.col("n"), 1, 5, "a/n"), contracts.has_length(F.col("t"), 5, 9, "t"), contracts.has_items(F.col("l"), 2, 3, "l"), contracts.matches(F.col("t"), "^[a-z]+$", "t"))
    assert one.select(checks).first()[0] == ["x: \"it's\" is not one of ['a', 'b']", "a/n: 7 is greater than the maximum of 5", "t: \"it's\" is too short", "l: ['a'] is too short", "t: \"it's\" does not match '^[a-z]+$'"]
    assert one.select(contracts.key_violations(F.col("d"), ("a", "b"), ("a", "b"))).first()[0] == [": 'a' is a required property", ": Additional properties are not allowed ('y', 'z' were unexpected)"]


def test_messages_of_segments(spark):
    good = {"intent": {"text": "t", "matches_problem": True, "confidence": "high"}, "function": {"algorithm": "a", "data_structures": [], "complexity": "n", "confidence": "low"}, "implementation": {"key_operations": [], "potential_issues": [], "confidence": "medium"}}
    docs = [good, {k: v for k, v in good.items() if k != "function"}, good | {"intent": {"text": 1, "matches_problem": None, "confidence": True}}, good | {"implementation": {"key_operations": {}, "potential_issues": 1.5, "confidence": "it's"}}]
    rows = spark.createDataFrame([(json.dumps(d),) for d in docs], "d string")
    assert [r[0] for r in rows.select(contracts.segment_violations(F.col("d"))).collect()] == [
        [],
        ["missing section: function", "invalid confidence in function: ''"],
        ["wrong type: intent.text (got int, expected str)", "wrong type: intent.matches_problem (got NoneType, expected bool)", "wrong type: intent.confidence (got bool, expected str)", "invalid confidence in intent: True"],
        ["wrong type: implementation.key_operations (got dict, expected list)", "wrong type: implementation.potential_issues (got float, expected list)", "invalid confidence in implementation: \"it's\""],
    ]


def test_robust_json(spark):
    raw = ['{"a":1}', 'x\n```json\n{"a":1}\n```', 'so {"a":1} ok', "none", '{"a":'  "} x", None]
    found, error = contracts.robust_json(F.col("raw"))
    got = [tuple(r) for r in spark.createDataFrame([(r,) for r in raw], "raw string").select(found, error).collect()]
    assert [g[0] for g in got] == ['{"a":1}'] * 3 + [None] * 3
    assert got[3][1] == "no JSON found in output" and got[4][1] == "json parse failed"


def test_key_violations(spark):
    rows = spark.createDataFrame([('{"a":1,"z":2}',), ("{}",), (None,)], "d string")
    got = [r[0] for r in rows.select(contracts.key_violations(F.col("d"), ("a", "b"), ("a", "b"))).collect()]
    a, b = ": 'a' is a required property", ": 'b' is a required property"
    assert got == [[b, ": Additional properties are not allowed ('z' was unexpected)"], [a, b], [a, b]]


SEGMENT = "struct<matches_problem: boolean, text: string, algorithm: string, data_structures: array<string>, key_operations: array<string>, potential_issues: array<string>>"


def test_gap_levels(spark):
    ok = (True, "t", "greedy", ["heap", "list"], ["read the input", "sort by size"], ["variabilă nefolosită", "depășire de tip întreg (overflow)"])
    rows = [
        ((False, *ok[1:]), ok),
        ((True, "t", "dp", *ok[3:]), ok),
        ((True, "t", "greedy_sort", ["queue"], ["do nothing at all", "read the input"], ok[5]), ok),
        (ok, ok),
    ]
    got = [r["g"] for r in spark.createDataFrame(rows, f"a {SEGMENT}, b {SEGMENT}").select(gaps.gap(F.col("a"), F.col("b"), F.lit(0.9)).alias("g")).collect()]
    assert [g["gap_level"] for g in got] == ["intent", "function", "implementation", "implementation"]
    assert [g["hint_level"] for g in got] == ["macro", "structural", "specific", "specific"]
    assert got[1]["missing_concept"] == "algoritm_gresit:dp_vs_greedy"
    assert got[2]["diverges_at_step"] == 0 and got[2]["missing_steps"] == ["sort by size"]
    assert tuple(got[2]["structure_divergence"]) == (["heap"], ["queue"])
    assert got[3]["diverges_at_step"] == -1 and got[3]["structure_divergence"] is None
    assert got[3]["primary_issue"] == "depășire de tip întreg (overflow)" and got[3]["missing_concept"] == "integer_overflow"


def test_gap_text(spark):
    side = (True, "t", "greedy", ["ArrayList", "heap"], ["citește", "sortează lista", "afișează suma", "a", "b"], ["cod redundant", "rezultatul afișat este incorect"])
    other = (True, "t", "Greedy_Sort", ["set ordonat"], ["x 1", "x 2", "x 3", "x 4", "x 5", "x 6"], [])
    g = gaps.gap(F.col("a"), F.col("b"), F.lit(0.99))
    text = spark.createDataFrame([(side, other)], f"a {SEGMENT}, b {SEGMENT}").select(gaps.gap_text(g).alias("t")).first()["t"]
    assert text.split("\n") == [
        "── ANALIZA DIFERENȚEI ──", "Nivel gap:              implementation", "Concept lipsă:          wrong_initial_step", "Nivel hint:             very_specific", "Similaritate cod:       high", "",
        "Abordare parțială:      citește → sortează lista → afișează suma (+ 2 mai multe)", "Abordare corectă (100p):x 1 → x 2 → x 3 (+ 3 mai multe)", "Problemă principală:    rezultatul afișat este incorect", "Divergență la pasul:    1",
        "Pași lipsă din parțială:", "  - x 1", "  - x 2", "  - x 3", "  - x 4", "  - (+ 2 alți pași)", "Logica ieșirii:         de asemenea incorectă", "Structuri de date lipsă:['set ordonat']", "Structuri de date în plus:['heap']", "── SFÂRȘIT ANALIZĂ ──",
    ]


def test_differences(spark):
    assert difference(["a"], ["a"])[:2] == (0, 0)
    n = difference(["int x;", "x = 1;"], ["int x;", "for (;;)", "while (x)", "x = 1;"])
    assert n[0] == 2 and n[4] == ["for", "while"] and n[5] == []
    row = spark.createDataFrame([(["a"], ["a", "while x"]), (None, None)], "a array<string>, b array<string>").select(diff_lines("a", "b").alias("d")).select(summary(F.col("d")))
    assert [r[0] for r in row.collect()] == ["+1/-0 linii; structuri în plus: while", "+0/-0 linii"]


def slow_blocks(a, b, i0, i1, j0, j1):
    """The definition: of all common blocks of an area the longest, the first in a, the first in b; then both sides."""
    every = [(-n, i, j) for i in range(i0, i1) for j in range(j0, j1) for n in range(1, min(i1 - i, j1 - j) + 1) if a[i : i + n] == b[j : j + n]]
    if not every:
        return []
    n, i, j = min(every)
    return slow_blocks(a, b, i0, i, j0, j) + [(i, j, -n)] + slow_blocks(a, b, i - n, i1, j - n, j1)


def test_differences_are_those_of_the_longest_blocks():
    r = random.Random(12)
    for k in range(400):
        a = [r.choice("abcde"[: 2 + k % 4]) for _ in range(r.randint(0, 12))]
        b = [r.choice("abcde"[: 2 + k % 4]) for _ in range(r.randint(0, 12))] if k % 2 else [x for x in a if r.random() < 0.8]
        want = slow_blocks(a, b, 0, len(a), 0, len(b))
        got = matching_blocks(a, b)
        assert [(i + k, j + k) for i, j, n in got for k in range(n)] == [(i + k, j + k) for i, j, n in want for k in range(n)]
        library = difflib.SequenceMatcher(None, a, b, autojunk=False)
        d = difference(a, b)
        codes = [c for c in library.get_opcodes() if c[0] != "equal"]
        assert d[2] == [b[c[3] : c[4]] for c in codes if c[4] > c[3]] and d[3] == [a[c[1] : c[2]] for c in codes if c[2] > c[1]]
        assert d[6] == "\n".join(difflib.unified_diff(a, b, lineterm="", n=2)) and d[7] == library.ratio()


def test_differences_of_long_texts():
    r = random.Random(3)
    a = [f"line {r.randint(0, 4000)}" for _ in range(8000)]
    b = [x for x in a if r.random() < 0.95] + ["x"]
    n_added, n_removed, *_, excerpt, ratio = difference(a, b)
    assert len(b) - n_added == len(a) - n_removed and ratio > 0.9 and excerpt.endswith("\n... [truncated]")
    same = difference(["}"] * 2000, ["}"] * 1500)
    assert same[:2] == (0, 500)


def test_template_hints_name_operations(spark):
    rows = spark.createDataFrame([(["a"], ["a", "q.push(x);", "sort(v); Sort(w);", "élong push"], "graphs"), (["x", "for"], ["y"], None)], "a array<string>, b array<string>, c string")
    got = rows.select("c", diff_lines("a", "b").alias("d")).select(template_hints(F.col("d"), F.col("c"), F.lit("hard")).alias("h")).collect()
    assert [(h["level"], h["text"]) for h in got[0]["h"]] == [
        ("macro", "Soluția ta diferă de o variantă corectă pe aproximativ 3 linii semnificative; concentrează-te pe ideea cheie a problemei (graphs, dificultate hard)."),
        ("specific", "Verifică zona în care apar operațiile cu push, sort, Sort; acolo este localizată cea mai consistentă diferență."),
    ]
    assert [h["text"] for h in got[1]["h"]][1:] == ["Ca să te apropii de soluția corectă, renunță la structuri: for.", "Verifică partea finală a logicii principale: există un bloc consistent care lipsește din varianta ta."]


def test_chat_isolates_errors(spark):
    rows = spark.range(40).select("id", F.lit("s").alias("s"), F.col("id").cast("string").alias("u"))
    good, bad = providers.route(providers.chat(rows, "s", "u", lambda: providers.EchoChat(fail_every=3), pause=0))
    assert good.count() + bad.count() == 40 and bad.count() > 0
    assert bad.where("error IS NULL OR attempts <> 3").isEmpty()


def test_training_rows(spark):
    rows = spark.createDataFrame([(1, "a b c", "d e"), (2, "", "")], "sample_id long, prompt string, target string")
    got = {r["sample_id"]: r for r in providers.training_rows(rows, providers.HashTokenizer, 4).collect()}
    assert got[1]["labels"][:2] == [-100, -100] and len(got[1]["labels"]) == 4 and got[1]["labels"][2:] == got[1]["input_ids"][2:]
    assert got[1]["attention_mask"] == [1] * 4 and got[2]["input_ids"] == []


def test_nested_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("p1/input/1.in", "5 1")
        z.writestr("p2/big.in", "x" * 9000)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("tests.zip", inner.getvalue())
        z.writestr("readme.txt", "hi")
    got = archives.read_archives(spark, f"file://{tmp_path}", wanted=r"\.in$", most=8000).collect()
    assert [(r["inner"], r["member"], r["size"], bytes(r["payload"])) for r in got] == [("tests.zip", "p1/input/1.in", 3, b"5 1")]
    spark.dataSource.register(archives.NestedZipSource)
    assert spark.read.format("nested_zip").option("path", f"{tmp_path}/*.zip").load().count() == 3
    assert [r["pid"] for r in archives.test_ids(archives.read_archives(spark, f"file://{tmp_path}")).collect()] == ["p1", "p2"]


def test_lines_and_folders(spark, tmp_path):
    path = f"file://{tmp_path}/lines"
    assert files.write_lines(spark.range(5), path) == 5
    assert files.write_lines(spark.range(2), path, append=True) == 2
    assert files.read_lines(spark, path, "id long").count() == 7
    assert files.read_optional(spark, f"file://{tmp_path}/none", "id long").isEmpty()
    folder = tmp_path / "sol" / "2024_sum"
    folder.mkdir(parents=True)
    (folder / "anon_1_40.cpp").write_text("int x;")
    (folder / "bad.cpp").write_text("int y;")
    assert [tuple(r) for r in files.read_solutions(spark, f"file://{tmp_path}/sol").collect()] == [("2024", "sum", "anon_1", 40.0, "cpp", "int x;")]


STATEMENT = """Cuprins
1 problema 1: Suma . . . . 2
1.1 Enunț . . . . 2

1 problema 1 (30p): Suma
1.1 Enunț
Se citește din sum.in un șir de numere.
Problema 2 – Drumuri
2.1 Enunt
Fișierul path.in conține un graf; vezi și sum.out.

3Bonus
3.1 Enunț
Doar pentru curioși: bonus.cpp.
4 problema 4:
fără titlu de enunț
"""


HEADERS = [re.compile(h, re.IGNORECASE) for h in statements.HEADERS]


def slow_starts(text, low, high):
    found = set()
    for header in HEADERS:
        for m in header.finditer(text[low:high]):
            window = text[low + m.end() : low + m.end() + 500]
            if re.search(rf"{m[1]}\.1\s+Enun", window, re.IGNORECASE) and re.search(statements.BODY, window, re.IGNORECASE) and not re.search(statements.DOTTED, window):
                found.add((low + m.start(), int(m[1])))
    return sorted(found)


def slow_section(text, name):
    starts = [s for s, _ in slow_starts(text, 0, len(text))]
    hint = re.compile(rf"\b{re.escape(name.lower())}\.(?:in|out|c|cpp|java)\b", re.IGNORECASE)
    chunks = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=False)]
    return next((c.strip() for c in chunks if hint.search(c)), None) or None


def slow_anchor(text, name):
    m = re.search(rf"\b{re.escape(name.lower())}\.(?:in|out)\b", text, re.IGNORECASE)
    if not m:
        return None
    anchor, low = m.start(), max(0, m.start() - 12_000)
    starts = [s for s, _ in slow_starts(text, low, anchor)] + [low + h.start() for h in re.finditer(r"(?:^|\n)\d+\.1\s+Enun", text[low:anchor], re.IGNORECASE | re.MULTILINE)]
    if not starts:
        return text[max(0, anchor - 2000) : anchor + 4000].strip() or None
    nexts = [re.compile(r"\n" + h, re.IGNORECASE).search(text, anchor + 80) for h in statements.HEADERS]
    return text[max(starts) : min((n.start() for n in nexts if n), default=min(len(text), max(starts) + 8000))].strip() or None


def statement_texts():
    r = random.Random(21)
    pieces = ["1 problema 1 (30p): Suma\n", "\n1.1 Enunț\n", "Problema 2 – Drumuri", "\n2.1 Enunt\n", "\n3Bonus\n", "13Bonus", "\n3.1 ENUNȚ\nÎn 🙂 text ", "1.1 Enunț . . . . 4\n", "22 problema 2: x\n2.1 Enunț\nceva ", "Fișierul sum.in ", " PATH.out", "vezi sum.cpp; ", "\n\n5.1 Enunt ", "problema 1", "\n", "🙂" * 40, "text simplu " * 30, "\u00a0 ", "4 problema 4 (a) :\n4.1 Enunț\nbla ", "12 problema 12:\n12.1 Enunț\n\nx"]
    out = ["".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(150)]
    plain = "x" * 3000 + " vezi tree.in " + "y" * 5000
    below = "a\n2.1 Enunt\n" + "b " * 3000 + "tree.out " + "c" * 200 + "\n3Bonus\nrest"
    far = "\n7.1 Enunt\n" + "z" * 13_000 + " tree.in " + "w" * 9000
    return [STATEMENT, "", plain, below, below[: below.index("\n3Bonus")] + "d" * 9000, far, far + "\nProblema 2 – x", *out]


def test_sections_and_chunks(spark):
    texts = statement_texts()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "id long, text string")
    got = sorted(map(tuple, statements.with_sections(docs, "id").collect()))
    assert got == [(k, s, n) for k, t in enumerate(texts) for s, n in slow_starts(t, 0, len(t))] and len(got) > 50
    assert [n for k, _, n in got if k == 0] == [1, 2, 3]
    names = ["sum", "PATH", "bonus", "none", "tree"]
    named = docs.crossJoin(spark.createDataFrame([(n,) for n in names], "n string"))
    found = {(r["id"], r["n"]): (r["s"], r["a"]) for r in named.select("id", "n", statements.chunk_in_sections(F.col("text"), F.col("n")).alias("s"), statements.chunk_at_anchor(F.col("text"), F.col("n")).alias("a")).collect()}
    for k, t in enumerate(texts):
        for n in names:
            assert found[k, n] == (slow_section(t, n), slow_anchor(t, n)), (k, n)
    assert all(found[-1, n] == (None, None) for n in names)
    assert sum(s is not None for s, _ in found.values()) > 40 and sum(a is not None for _, a in found.values()) > 60


def test_cascade_of_chunks(spark):
    rows = [(STATEMENT, "path"), ("tree.in " + "z" * 10, "tree"), ("a Tree b tree " + "z" * 5000, "tree"), ("trees", "tree"), (None, "x"), ("t", None)]
    got = [r["c"] for r in spark.createDataFrame(rows, "t string, n string").select(statements.cascade(F.col("t"), F.col("n")).alias("c")).collect()]
    assert got[0].startswith("Problema 2") and got[1] == "tree.in " + "z" * 10 and got[2] == ("tree " + "z" * 3995) and got[3:] == [None] * 3


def test_ids_against_a_dimension(spark):
    rows = [(1, ["a", "z", "a", None, "y's"], "a"), (2, ["a", "b"], "q"), (3, [], "a"), (4, None, None), (5, ["a", "a"], "b"), (None, ["x"], "x"), (7, ["b", "q"], "q")]
    frame = spark.createDataFrame(rows, "id long, c array<string>, p string")
    dim = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string")
    got = {r["id"]: (r["known"], r["unknown"]) for r in references.checked_ids(frame, ["id"], F.col("c"), dim, "k").collect()}
    assert got == {1: (["a", "a"], ["z", None, "y's"]), 2: (["a", "b"], []), 3: ([], []), 4: ([], []), 5: (["a", "a"], []), None: ([], ["x"]), 7: (["b"], ["q"])}
    errors = {r["id"]: r["error"] for r in references.concept_errors(frame, ["id"], F.col("c"), F.col("p"), dim, "k").collect()}
    assert errors == {1: "unknown concept ids: ['z', None, \"y's\"]", 2: "unknown primary_concept: q", 3: "missing concepts", 4: "missing concepts", 5: None, None: "unknown concept ids: ['x']", 7: "unknown concept ids: ['q']"}
    assert references.concept_errors(frame.limit(0), ["id"], F.col("c"), F.col("p"), dim, "k").isEmpty()
    assert references.checked_ids(frame, ["id"], F.col("c"), dim.limit(0), "k").where("size(known) > 0").isEmpty()


def test_rows_in_the_fixed_layout(spark):
    rows = spark.createDataFrame([("p", [("macro", "t")], None, ["bad"], 1), (None, [], "cpp", None, 2), (None, None, "cpp", None, 3), ("q", [("macro", "t")], "java", [], 4)], "problem_id string, generated_hints array<struct<level: string, text: string>>, language string, hint_validation_errors array<string>, other int")
    got = annotate.hint_rows(rows).collect()
    assert len(got[0].asDict()) == 13
    assert [(r["problem_id"], r["anon_id"], r["language"], r["verdict"], r["validator_passed"], r["validator_violations"], r["source"]) for r in got] == [("p", "", "unknown", "WA", False, ["bad"], "segments_silver_diff"), ("q", "", "java", "WA", True, [], "segments_silver_diff")]
