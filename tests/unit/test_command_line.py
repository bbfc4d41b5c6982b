"""Commands on small files, in one session."""

import json

import pytest

from gradewell.__main__ import main, parser


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return f"file://{path}"


def test_pairs_resume(spark, tmp_path, capsys):
    attempts = lines(tmp_path / "a.jsonl", [{"problem": "p", "language": "cpp", "author": f"u{k % 4}", "file": f"f{k}", "score": 100.0 if k % 2 else 40.0} for k in range(12)])
    out = f"file://{tmp_path}/pairs"
    for expected in ("pairs: 15", "pairs: 0"):
        main(["pairs", attempts, "--out", out, "--problems", "p, q"], spark)
        assert expected in capsys.readouterr().out
    assert spark.read.json(out).distinct().count() == 15


def test_validate_split_gap_similarity_chat(spark, tmp_path):
    read = lambda name: [r.asDict(True) for r in spark.read.json(f"file://{tmp_path}/{name}").collect()]
    out = lambda name: f"file://{tmp_path}/{name}"
    main(["validate", lines(tmp_path / "s.jsonl", [{"set_id": "a", "hints": ["Think about the order of the steps."], "statement": "sort numbers", "solution": "x"}, {"set_id": "b", "hints": [], "statement": "", "solution": ""}]), "--out", out("v")], spark)
    assert {r["set_id"]: r["passed"] for r in read("v")} == {"a": True, "b": False}
    main(["split", lines(tmp_path / "t.jsonl", [{"problem": "p", "author": f"u{k % 10}", "n": k} for k in range(40)]), "--out", out("t")], spark)
    assert {r["split"] for r in read("t")} == {"train", "val", "test"} and len(read("t")) == 40
    side = {"matches_problem": True, "text": "t", "algorithm": "dp", "data_structures": [], "key_operations": ["a"], "potential_issues": []}
    main(["gap", lines(tmp_path / "g.jsonl", [{"id": "1", "partial": side, "passing": side | {"algorithm": "bfs"}, "similarity": 0.5}]), "--out", out("g")], spark)
    assert read("g")[0]["gap_level"] == "function" and "dp_vs_bfs" in read("g")[0]["prompt"]
    main(["similarity", lines(tmp_path / "r.jsonl", [{"problem_id": "p", "embedding_similarity": x} for x in (0.5, 0.9, 0.85)]), "--out", out("r")], spark)
    assert read("r") == [{"problem_id": "p", "n": 3, "n_reached": 2, "mean": 0.75}]
    main(["chat", lines(tmp_path / "c.jsonl", [{"id": "1", "system": "s", "user": "u"}, {"id": "2", "system": "s", "user": "v"}]), "--limit", "1", "--out", out("c")], spark)
    assert len(read("c")) == 1 and "hints" in read("c")[0]["answer"]
    (tmp_path / "d.jsonl").write_text('{"hints": []}\n')
    main(["documents", f"file://{tmp_path}/d.jsonl", "--out", out("d")], spark)
    assert read("d")[0]["violations"] == ["'gap_codes' lipsă", "lista 'hints' este goală"]


def test_pairs_keep_the_budget_over_runs(spark, tmp_path, capsys):
    out = f"file://{tmp_path}/pairs"
    for n in (6, 40):
        attempts = lines(tmp_path / "a.jsonl", [{"problem": "p", "language": "cpp", "author": f"u{k % 4}", "file": f"f{k:03d}", "score": 100.0 if k % 2 else 40.0} for k in range(n)])
        main(["pairs", attempts, "--out", out, "--max-pairs-per-problem", "10"], spark)
    assert spark.read.json(out).distinct().count() == 10


def test_filter_assemble_and_sample(spark, tmp_path, capsys):
    read = lambda name: [r.asDict(True) for r in spark.read.json(f"file://{tmp_path}/{name}").collect()]
    out = lambda name: f"file://{tmp_path}/{name}"
    rows = lines(tmp_path / "rows.jsonl", [{"problem_id": f"p{k % 3}", "n": k} for k in range(9)])
    problems = lines(tmp_path / "p.jsonl", [{"problem_id": "p0", "n_solutions": 30, "languages": ["cpp"]}, {"problem_id": "p1", "n_solutions": 29, "languages": ["java"]}, {"problem_id": "p2", "n_solutions": 99, "languages": ["cpp", "java"]}, {"problem_id": "p9", "n_solutions": None, "languages": None}])
    main(["filter", rows, problems, "--out", out("kept"), "--decisions", out("d")], spark)
    assert "kept 2/4 problems; 6/9 rows" in capsys.readouterr().out
    assert {r["problem_id"] for r in read("kept")} == {"p0", "p2"}
    assert {r["problem_id"]: (r["n_feedback"], r["kept"], r.get("reason"), r["language_dominant"]) for r in read("d")} == {"p0": (3, True, None, "cpp"), "p1": (3, False, "<30 solutions on disk", "java"), "p2": (3, True, None, "mixed"), "p9": (0, False, "<30 solutions on disk", "mixed")}

    hint = lambda source, k: {"problem_id": f"p{k % 2}", "anon_id": f"a{k % 20}", "submission_name": f"{source}{k}", "hints": ["h"] if k % 10 else [], "validator_passed": k % 7 > 0, "source": source}
    silver, boot = (lines(tmp_path / f"{s}.jsonl", [hint(s, k) for k in range(n)]) for s, n in (("s", 200), ("b", 60)))
    valid = {s: sum(1 for k in range(n) if k % 10 and k % 7) for s, n in (("s", 200), ("b", 60))}
    main(["assemble", silver, "--bootstrap", boot, "--out", out("all")], spark)
    every = {s: read(f"all/{s}") for s in ("train", "val", "test")}
    assert sum(map(len, every.values())) == sum(valid.values())
    authors = [{(r["problem_id"], r["anon_id"]) for r in found} for found in every.values()]
    assert not authors[0] & authors[1] and not authors[0] & authors[2] and not authors[1] & authors[2]
    assert sum(r["train"] for r in read("all/stats")) == len(every["train"])
    main(["assemble", silver, "--bootstrap", boot, "--no-use-all", "--silver-ratio", "0.3", "--out", out("some")], spark)
    some = [r for s in ("train", "val", "test") for r in read(f"some/{s}")]
    total = min(valid["s"] / 0.3, valid["b"] / 0.7)
    assert sum(r["source"] == "s" for r in some) == int(total * 0.3 + 1e-9) and sum(r["source"] == "b" for r in some) == int(total * 0.7 + 1e-9)

    attempts = lines(tmp_path / "at.jsonl", [{"problem": "ab"[k % 2], "author": f"u{k}", "file": f"f{k:03d}", "score": 100.0 if k % 5 == 0 else 10.0} for k in range(100)])
    main(["sample", attempts, "--per-problem", "7", "--out", out("sample")], spark)
    chosen = read("sample")
    assert len(chosen) == 14 and all(r["score"] < 99 for r in chosen)
    main(["sample", attempts, "--per-problem", "7", "--limit", "3", "--out", out("few")], spark)
    assert {r["file"] for r in read("few")} < {r["file"] for r in chosen} and len(read("few")) == 3


def test_segments_diff_layout_and_store(spark, tmp_path, capsys):
    read = lambda name: [r.asDict(True) for r in spark.read.json(f"file://{tmp_path}/{name}").collect()]
    out = lambda name: f"file://{tmp_path}/{name}"
    good = {"intent": {"text": "t", "matches_problem": True, "confidence": "high"}, "function": {"algorithm": "bfs", "data_structures": [], "complexity": "n", "confidence": "low"}, "implementation": {"key_operations": [], "potential_issues": [], "confidence": "medium"}}
    records = lines(tmp_path / "seg.jsonl", [{"problem": "p", "file": "f1", "segments": json.dumps(good)}, {"problem": "p", "file": "f2", "segments": "{}"}])
    main(["segments", records, "--out", out("seg")], spark)
    assert {r["file"]: len(r["errors"]) for r in read("seg")} == {"f1": 0, "f2": 6}
    main(["segments", records, "--report", "--out", out("rep")], spark)
    assert "Schema pass rate:     50%" in read("rep")[0]["report"]
    main(["diff", lines(tmp_path / "d.jsonl", [{"id": "1", "failing": "int x;\n", "passing": "int x;\nwhile (x) x--;\n"}]), "--out", out("diff")], spark)
    assert read("diff")[0]["summary"] == "+1/-0 linii; structuri în plus: while" and read("diff")[0]["hints"][0]["level"] == "macro"
    rows = lines(tmp_path / "l.jsonl", [{"problem_id": f"p{k}", "generated_hints": [{"level": "macro", "text": "t"}] if k else []} for k in range(3)])
    main(["layout", rows, "--out", out("layout")], spark)
    assert "rows: 2" in capsys.readouterr().out
    for expected in ("version 1: 2 rows", "version 2: 2 rows"):
        main(["store", out("layout"), out("table"), "--buckets", "4"], spark)
        assert expected in capsys.readouterr().out


def test_queries_and_arguments(spark, capsys):
    main(["queries", "--filter", "op_102"], spark)
    assert capsys.readouterr().out.split() == ["op_102_trim_and_retry"]
    with pytest.raises(SystemExit):
        parser().parse_args(["nothing"])
