"""Command line: ``python -m gradewell COMMAND``; tables are JSON lines or Parquet in any store that Spark reads."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions.text import code_lines
from gradewell.operators import annotate, assembly, diffs, gaps, pairing, providers, rubric, splits
from gradewell.operators.annotate import hint_document_violations
from gradewell.operators.contracts import segment_violations
from gradewell.operators.tfidf import spread
from gradewell.plans import catalog
from gradewell.session import build_session
from gradewell.sources import archives, files
from gradewell.sources.bucketed import BucketTable

SEGMENTS = "matches_problem boolean, text string, algorithm string, data_structures array<string>, key_operations array<string>, potential_issues array<string>"


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return files.read_lines(spark, path, schema) if schema else spark.read.json(path)


def _write(df: DataFrame, path: str | None, append: bool = False) -> int:
    if path is None:
        df.show(50, truncate=80)
        return 0
    return files.write_lines(df, path, append)


def _chosen(df: DataFrame, column: str, wanted: str | None) -> DataFrame:
    """Rows whose column is one of a comma-separated list; all without one."""
    return df if not wanted else df.where(F.col(column).isin([x.strip() for x in wanted.split(",")]))


def queries(spark: SparkSession, a: argparse.Namespace) -> None:
    for name in sorted(catalog.queries()):
        if a.filter in name:
            print(name, "" if name in catalog.oracle_sql() else "(no SQL)")


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    _write(catalog.queries()[a.name](spark, a.tables), a.out)


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(a.archives)
    if a.force or not files.exists(spark, f"{a.out}/_SUCCESS"):
        archives.members_of(found, wanted=a.members, most=a.max_size, payload=a.with_payloads).write.mode("overwrite").parquet(a.out)


def pairs(spark: SparkSession, a: argparse.Namespace) -> None:
    """Attempts (problem, language, author, file, score) -> failing with passing files of other authors."""
    rows = _chosen(_chosen(_read(spark, a.attempts), "problem", a.problems), "language", a.languages)
    keys, ok = ["problem", "language"], F.col("score") >= 99.999
    made = pairing.cross_author_pairs(rows.where(~ok).select(*keys, "author", F.col("file").alias("failing")), rows.where(ok).select(*keys, "author", F.col("file").alias("passing")), keys, "author", a.max_pairs_per_problem, a.seed, "failing", "passing")
    resume = not a.no_resume and a.out and files.exists(spark, a.out)
    if resume:
        done = _read(spark, a.out)
        had = done.groupBy("problem").agg(F.count("*").alias("had"))
        made = pairing.not_done(made, done, [*keys, "failing", "passing"]).join(had, "problem", "left")
        # what earlier runs left of a problem's budget; the new pairs of a problem are at most the cap for each language
        made = pairing.top_by(made, ["problem"], a.max_pairs_per_problem - F.coalesce("had", F.lit(0)), "language", "failing", "passing").drop("had")
    print("pairs:", _write(made, a.out, append=bool(resume)))


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Hint sets (set_id, hints, statement, solution) -> the rubric's report."""
    sets = _read(spark, a.sets, "set_id string, hints array<string>, statement string, solution string")
    chars = F.length(F.concat_ws(" ", "hints", "statement", "solution")) * (rubric.MAX_HINTS if a.trim else 1)
    sets = spread(sets, ["set_id"], chars)
    _write((rubric.validate_with_retry if a.trim else rubric.validate)(sets), a.out)


def documents(spark: SparkSession, a: argparse.Namespace) -> None:
    """Hint documents, a JSON object a line -> what is wrong with each."""
    rows = spark.read.text(a.documents)
    _write(rows.select("value", hint_document_violations(F.col("value")).alias("violations")), a.out)


def gap(spark: SparkSession, a: argparse.Namespace) -> None:
    """Pairs of segment records (id, partial, passing, similarity) -> gaps and their texts."""
    rows = _read(spark, a.pairs, f"id string, partial struct<{SEGMENTS}>, passing struct<{SEGMENTS}>, similarity double")
    made = rows.select("id", gaps.gap(F.col("partial"), F.col("passing"), F.coalesce("similarity", F.lit(0.0))).alias("gap"))
    _write(made.select("id", "gap.*", gaps.gap_text(F.col("gap")).alias("prompt")), a.out)


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    """Samples (problem, author, ...) -> the same with train, val or test, authors whole."""
    _write(splits.grouped_split(_read(spark, a.samples), "problem", "author", a.train_frac, a.val_frac, a.seed), a.out)


def similarity(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rows with ``embedding_similarity`` -> how many reach the threshold, by problem."""
    rows = _read(spark, a.rows)
    reached = F.col("embedding_similarity") >= a.threshold
    _write(rows.groupBy("problem_id").agg(F.count("*").alias("n"), F.count_if(reached).alias("n_reached"), F.round(F.avg("embedding_similarity"), 4).alias("mean")), a.out)


def chat(spark: SparkSession, a: argparse.Namespace) -> None:
    """Prompts (id, system, user) -> answers of the stand-in, with errors as data; a real model is one more provider."""
    rows = _read(spark, a.prompts, "id string, system string, user string")
    rows = rows.limit(a.limit) if a.limit else rows
    _write(providers.chat(rows, "system", "user", providers.EchoChat, pause=0), a.out)


def filter_problems(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rows (problem_id, ...) and problems (problem_id, n_solutions, languages) -> the rows of problems with enough solutions."""
    rows, problems = _read(spark, a.rows), _read(spark, a.problems, "problem_id string, n_solutions long, languages array<string>")
    decisions = files.kept(assembly.problem_decisions(rows, problems, a.min_solutions))
    n, kept = decisions.agg(F.count("*"), F.count_if("kept")).first()
    print(f"kept {kept}/{n} problems; {_write(assembly.rows_of_kept(rows, decisions), a.out)}/{rows.count()} rows")
    if a.decisions:
        _write(decisions, a.decisions)


def assemble(spark: SparkSession, a: argparse.Namespace) -> None:
    """Hint rows of one or two sources -> samples with train, val or test, and counts by problem."""
    silver, bootstrap = _read(spark, a.silver), None if a.bootstrap is None else _read(spark, a.bootstrap)
    mixed = files.kept(assembly.assembled(silver, bootstrap, a.silver_ratio if a.no_use_all else None, a.train_frac, a.val_frac, a.seed, a.key))
    for name in assembly.SPLITS:
        print(f"{name}:", _write(mixed.where(F.col("split") == name).drop("split"), None if a.out is None else f"{a.out}/{name}"))
    _write(assembly.split_counts(mixed, "problem_id"), None if a.out is None else f"{a.out}/stats")


def sample(spark: SparkSession, a: argparse.Namespace) -> None:
    """Attempts (problem, author, file, score) -> failing ones to ask a model about, so many of each problem."""
    rows = _chosen(_read(spark, a.attempts), "problem", a.problems).where("score < 99.999")
    some = assembly.sampled(rows, "problem", a.per_problem, a.seed, "file")
    _write(some.orderBy("problem", "file").limit(a.limit) if a.limit else some, a.out)


def segments(spark: SparkSession, a: argparse.Namespace) -> None:
    """Segment records (problem, file, segments as JSON text) -> what is wrong with each, or the report of each problem."""
    rows = _read(spark, a.records, "problem string, file string, segments string, matches boolean")
    errors = segment_violations(F.col("segments"))
    if not a.report:
        _write(rows.select("problem", "file", errors.alias("errors")), a.out)
        return
    checked = rows.select("problem", "file", (F.size(errors) == 0).alias("passed"), F.get_json_object("segments", "$.function.algorithm").alias("algorithm"), (F.get_json_object("segments", "$.intent.matches_problem") == "false").alias("mismatch"))
    from gradewell.operators.prompts import consistency_report

    _write(consistency_report(checked, "problem").select("problem", "report"), a.out)


def diff(spark: SparkSession, a: argparse.Namespace) -> None:
    """Pairs of programs (id, failing, passing) -> lines that differ, structure, excerpt and hints without a model."""
    rows = _read(spark, a.pairs, "id string, failing string, passing string, concept string, difficulty string")
    found = rows.select("id", "concept", "difficulty", diffs.diff_lines(code_lines(F.col("failing")), code_lines(F.col("passing"))).alias("d"))
    _write(found.select("id", "d.*", diffs.summary(F.col("d")).alias("summary"), diffs.template_hints(F.col("d"), F.col("concept"), F.col("difficulty")).alias("hints")), a.out)


def layout(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rows with generated_hints -> the thirteen columns of hint rows."""
    print("rows:", _write(annotate.hint_rows(_read(spark, a.rows)), a.out))


def store(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rows -> a stored table in which they take the place of those with the same keys."""
    done = BucketTable(spark, a.table, a.keys.split(","), a.buckets).upsert(_read(spark, a.rows))
    print(f"version {done.version}: {done.rows} rows in {len(done.buckets)} buckets")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gradewell", description=__doc__)
    p.add_argument("--master", default=None)
    commands = p.add_subparsers(dest="command", required=True)

    def add(function, *positional: str, **options) -> None:
        c = commands.add_parser(function.__name__.removesuffix("_problems"), help=function.__doc__)
        c.set_defaults(function=function)
        for name in positional:
            c.add_argument(name)
        for name, default in options.items():
            flag = "--" + name.replace("_", "-")
            if isinstance(default, bool):
                c.add_argument(flag, action="store_true")
            else:
                c.add_argument(flag, default=default, type=type(default) if default is not None else str)

    add(queries, filter="")
    add(run, "name", tables="/root/testdata/sf0.01", out=None)
    add(extract, "archives", "out", members=".*", max_size=1 << 40, with_payloads=False, force=False)
    add(pairs, "attempts", problems=None, languages=None, max_pairs_per_problem=15, seed=7, out=None, no_resume=False)
    add(validate, "sets", out=None, trim=False)
    add(documents, "documents", out=None)
    add(gap, "pairs", out=None)
    add(split, "samples", train_frac=0.8, val_frac=0.1, seed=23, out=None)
    add(similarity, "rows", threshold=0.85, out=None)
    add(chat, "prompts", limit=0, out=None)
    add(filter_problems, "rows", "problems", min_solutions=assembly.MIN_SOLUTIONS, out=None, decisions=None)
    add(assemble, "silver", bootstrap=None, silver_ratio=0.3, no_use_all=False, train_frac=0.8, val_frac=0.1, seed=23, key="submission_name", out=None)
    add(sample, "attempts", per_problem=15, seed=11, problems=None, limit=0, out=None)
    add(segments, "records", report=False, out=None)
    add(diff, "pairs", out=None)
    add(layout, "rows", out=None)
    add(store, "rows", "table", keys="problem_id", buckets=64)
    return p


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    a.function(spark or build_session(a.master), a)


if __name__ == "__main__":
    main()
