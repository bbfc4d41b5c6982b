"""Rule-based checks of hint texts (OP-096 to 103); violations are data, not errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.text import sentence_count, word_count
from gradewell.operators.tfidf import similarities

#: The patterns of what gives code away in a hint. A violation names the pattern.
CODE_SIGNS = (
    r"\{[^}]{0,40}\}",
    r";\s*\n",
    r"\b(for|while|if|switch)\s*\([^)]*\)",
    r"\breturn\s+[a-zA-Z0-9_]+\s*[;,]",
    r"==|!=|<=|>=|->|::|=>|\+\+|--",
    r"\bvoid\s+\w+\s*\(",
    r"\bint\s+\w+\s*\[",
    r"#\s*include\b|System\.out\.|printf|scanf",
    r"std::|java\.|new\s+\w+\s*\(",
    r"\b\w+\.[a-z][a-zA-Z]+\s*\([^)]*\)",
    r"\b[a-zA-Z_]\w*\s*=\s*[^=]",
)
MAX_SEMICOLONS = 3
MAX_WORDS, MIN_WORDS, MAX_SENTENCES = 60, 4, 3
MIN_HINTS, MAX_HINTS = 1, 4
MAX_SIMILARITY, ORDER_TOLERANCE = 0.55, 0.05


def scripts_word(pattern: str) -> str:
    """A pattern whose ``\\w`` is a letter, digit or underscore of any script; the engine's own is ASCII."""
    return pattern.replace(r"\w", r"[\p{L}\p{N}_]")


def count_violations(n: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(n < MIN_HINTS, F.concat(F.lit("too_few_hints: "), n.cast("string"), F.lit(f" < {MIN_HINTS}"))),
            F.when(n > MAX_HINTS, F.concat(F.lit("too_many_hints: "), n.cast("string"), F.lit(f" > {MAX_HINTS}"))),
        )
    )


def code_violations(text: Column) -> Column:
    found = [F.when(text.rlike(scripts_word(p)), F.lit(f"code_token_match:{p}")) for p in CODE_SIGNS]
    semicolons = F.length(text) - F.length(F.replace(text, F.lit(";"), F.lit("")))
    return F.array_compact(F.array(*found, F.when(semicolons > MAX_SEMICOLONS, F.lit("code_token_match:too_many_semicolons"))))


def length_violations(text: Column) -> Column:
    words, sentences = word_count(text), sentence_count(text)
    return F.array_compact(
        F.array(
            F.when(words > MAX_WORDS, F.concat(F.lit("too_long_words:"), words.cast("string"), F.lit(f">{MAX_WORDS}"))),
            F.when(sentences > MAX_SENTENCES, F.concat(F.lit("too_long_sentences:"), sentences.cast("string"), F.lit(f">{MAX_SENTENCES}"))),
            F.when(words < MIN_WORDS, F.concat(F.lit("too_short_words:"), words.cast("string"))),
        )
    )


def shown(x: Column) -> Column:
    """Two decimals, as messages have them: the nearest to the number's exact value, of two the even one.

    The engine's own format rounds the number's shortest decimal form, which
    differs where that ends in a 5. There the exact thousandths tell: the error
    of ``x * 1000``, by splitting x into halves whose products are exact.
    """
    product, whole = x * 1000, F.rint(x * 1000)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    past = (product - whole) + ((high * 1000 - product) + (x - high) * 1000)
    tie = (F.abs(product - whole) < 1e-9) & (whole % 10 == 5)
    up = (past > 0) | ((past == 0) & (F.floor(whole / 10) % 2 == 1))
    return F.when(tie, F.format_string("%.2f", (whole + F.when(up, 5).otherwise(-5)) / 1000)).otherwise(F.format_string("%.2f", x))


def order_violations(sims: Column) -> Column:
    """Hints whose similarity falls below the one before by more than the tolerance, by position."""
    n = F.greatest(F.size(sims) - 1, F.lit(0))
    steps = F.zip_with(F.slice(sims, F.lit(1), n), F.slice(sims, F.lit(2), n), lambda a, b: F.when(b + ORDER_TOLERANCE < a, F.concat(F.lit(": "), shown(b), F.lit(" < "), shown(a))))
    return F.array_compact(F.transform(steps, lambda says, i: F.concat(F.lit("order_inversion_at_"), (i + 1).cast("string"), says)))


def closeness_violations(sims: Column, name: str, most: float = MAX_SIMILARITY) -> Column:
    """Hints that are too close to the statement or to the solution, by position."""
    return F.array_compact(F.transform(sims, lambda s, i: F.when(s > most, F.concat(F.lit("hint"), i.cast("string"), F.lit(f"_too_close_to_{name}:"), shown(s), F.lit(f">{most}")))))


def validate(sets: DataFrame, ids: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """``sets`` (set_id, hints array of texts, statement, solution) -> set_id, passed, violations, per_hint, metrics.

    Violations are those of the set (count, closeness to statement and solution,
    order) and then those of each hint, which ``per_hint`` has by hint.

    Text checks run on each hint; similarities are fitted on the texts of one
    set. Sets without hints have a count violation and zero metrics. Sets that
    are partitioned by their id aren't moved, others once. ``ids`` name a set.
    """
    doc = lambda name, pos, text: F.struct(name.alias("doc"), pos.alias("pos"), text.alias("text"))
    anchors = F.array(*[doc(F.lit(c), F.lit(None).cast("int"), F.col(c)) for c in ("statement", "solution")])
    texts = sets.select(*ids, F.inline(F.concat(anchors, F.transform("hints", lambda h, i: doc(i.cast("string"), i, h)))))
    own = F.when(F.col("pos").isNotNull(), F.concat(code_violations(F.col("text")), length_violations(F.col("text"))))
    texts = texts.select(*ids, "doc", "text", "pos", own.alias("own"), word_count(F.col("text")).alias("words"))
    each = similarities(texts, ["statement", "solution"], keep=("pos", "own", "words"), groups=ids)
    hint = F.when(F.col("pos").isNotNull(), F.struct("pos", "own", "sim_statement", "sim_solution", "words"))
    found = each.groupBy(*ids).agg(F.array_sort(F.collect_list(hint)).alias("h"))
    of = lambda c: F.transform("h", lambda x: x[c])
    n, order = F.size("h").cast("long"), order_violations(of("sim_solution"))
    whole = F.concat(count_violations(n), closeness_violations(of("sim_statement"), "statement"), closeness_violations(of("sim_solution"), "solution"), order)
    out = found.select(*ids, n.alias("n_hints"), F.concat(whole, F.flatten(of("own"))).alias("violations"), of("own").alias("per_hint"), F.size(order).alias("n_order"), *[F.coalesce(x, F.lit(0.0)).alias(c) for c, x in (("max_sim_to_statement", F.array_max(of("sim_statement"))), ("max_sim_to_solution", F.array_max(of("sim_solution"))), ("avg_words_per_hint", F.when(n > 0, F.aggregate(of("words"), F.lit(0).cast("long"), lambda a, x: a + x) / n)))])
    return out.select(*ids, (F.size("violations") == 0).alias("passed"), "violations", "per_hint", ((F.size("violations") > 0) & (F.size("violations") == F.col("n_order"))).alias("only_order"), "n_hints", "max_sim_to_statement", "max_sim_to_solution", "avg_words_per_hint")


def prefixes(sets: DataFrame) -> DataFrame:
    """Each set with the lengths ``k`` that a trim may come to: all of its own up to MAX_HINTS.

    More hints than that are a violation of their own, so such a set is final
    as it is and isn't trimmed: no set is judged more than MAX_HINTS times.
    """
    n = F.size("hints")
    return sets.withColumn("k", F.explode(F.when(n > MAX_HINTS, F.array(n)).otherwise(F.sequence(F.greatest(n, F.lit(1)), F.lit(1)))))


def validate_with_retry(sets: DataFrame) -> DataFrame:
    """Trim the last hint while only the order is violated: of all prefixes the longest that passes, or fails otherwise, or is one hint."""
    each = prefixes(sets).select("set_id", "k", F.slice("hints", F.lit(1), F.col("k")).alias("hints"), "statement", "solution")
    final = validate(each, ("set_id", "k")).where(F.col("passed") | ~F.col("only_order") | (F.col("k") == 1))
    best = final.groupBy("set_id").agg(F.max(F.struct("k", "passed", "violations", "n_hints")).alias("x"))
    return best.select("set_id", "x.passed", "x.violations", "x.n_hints")
