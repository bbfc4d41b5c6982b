"""Gap queries (OP-134, 135, 137 to 13B, 13D, 12P) on segment records made from the benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions import vector as V
from gradewell.operators import gaps as G
from gradewell.operators import semantic as S
from gradewell.plans.catalog import register
from gradewell.session import table

#: What the records are made of besides the texts: names of algorithms and data structures, and every phrase that is known.
NAMES = ("greedy", "greedy_sort", "bfs", "parcurgere bfs", "programare dinamica", "sortare dupa cost", "sortare dupa cost si pret", "dijkstra", "drumuri minime", "memoization", "sortare topologică")
STRUCTURES = ("ArrayList", "heap", "priority queue", "tablou de int", "heap binar", "coada priority queue", "set ordonat de perechi", "set de perechi")
ISSUES = (*G.SEVERE, *G.MINOR, *G.OUTPUT, *(p for anchors in G.CONCEPTS.values() for p in anchors), "altceva cu totul")
_ITEM = "item_id"


def _pick(values: tuple[str, ...], factor: int = 1, shift: int = 0):
    return F.element_at(F.array(*map(F.lit, values)), ((F.col(_ITEM) * factor + shift) % len(values) + 1).cast("int"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole benchmark text as a segment record, three words an operation, beside the next text's, which repeats one of its operations."""
    words = F.split("text", " ")
    ops = F.transform(F.sequence(F.lit(1), F.size(words), F.lit(3)), lambda i: F.array_join(F.slice(words, i, F.lit(3)), " "))
    record = F.struct(
        (F.col(_ITEM) % 6 != 0).alias("matches_problem"),
        F.col("text"),
        F.element_at(F.array(*map(F.lit, NAMES)), (F.floor(F.col(_ITEM) / 4) % len(NAMES) + 1).cast("int")).alias("algorithm"),
        F.array(_pick(STRUCTURES), _pick(STRUCTURES, 5, 3), words[0]).alias("data_structures"),
        F.when(F.col(_ITEM) % 7 == 3, F.slice(ops, 1, 1)).otherwise(ops).alias("key_operations"),
        F.when(F.col(_ITEM) % 9 == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("comentariu lipsă"), _pick(ISSUES), F.concat_ws(" ", _pick(ISSUES, 7, 5), words[0]))).alias("potential_issues"),
    )
    rows = table(spark, sf_dir, "benchmark").select(_ITEM, record.alias("partial"))
    other = rows.select((F.col(_ITEM) - 1).alias(_ITEM), F.col("partial").alias("other"))
    steps = F.concat(F.slice("partial.key_operations", 1, 1), F.col("other.key_operations"), F.when(F.col(_ITEM) % 7 == 3, F.array(F.lit("pas nou"))).otherwise(F.array().cast("array<string>")))
    return rows.join(other, _ITEM).select(_ITEM, "partial", F.col("other").withField("key_operations", steps).alias("passing"))


# --- the same in SQL: records, similarities of token sets, and what is read off them


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(_literal, values)) + "]"


def _picked(values: tuple[str, ...], factor: int = 1, shift: int = 0) -> str:
    return f"{_values(values)}[((item_id * {factor} + {shift}) % {len(values)})::INT + 1]"


def _tokens(x: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({x}), '\s+'), lambda tk: tk <> ''))"


def _alike(a: str, b: str) -> str:
    both = f"len(list_intersect({_tokens(a)}, {_tokens(b)}))"
    return f"(CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.0::DOUBLE ELSE {both}::DOUBLE / greatest(len({_tokens(a)}) + len({_tokens(b)}) - {both}, 1) END)"


def _rows(values: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join(f"({k}, {_literal(v)})" for k, v in enumerate(values)) + ")"


_KNOWN = "CASE " + " ".join(f"WHEN {{x}} IN ({', '.join(map(_literal, names))}) THEN {_literal(canonical)}" for canonical, names in G.ALGORITHMS.items()) + " ELSE {x} END"
_CONCEPT_NAMES = tuple(name for name, anchors in G.CONCEPTS.items() for _ in anchors)
_CONCEPT_PHRASES = tuple(p for anchors in G.CONCEPTS.values() for p in anchors)
GAPS_SQL = f"""
WITH w AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark),
o AS (SELECT *, list_transform(range(1, len(w) + 1, 3), lambda k: array_to_string(w[k:k + 2], ' ')) AS ops FROM w),
seg AS (SELECT item_id, item_id % 6 <> 0 AS m, text AS t, {_values(NAMES)}[(item_id // 4 % {len(NAMES)})::INT + 1] AS alg, [{_picked(STRUCTURES)}, {_picked(STRUCTURES, 5, 3)}, w[1]] AS ds,
  CASE WHEN item_id % 7 = 3 THEN ops[1:1] ELSE ops END AS ops,
  CASE WHEN item_id % 9 = 4 THEN [] ELSE ['comentariu lipsă', {_picked(ISSUES)}, {_picked(ISSUES, 7, 5)} || ' ' || w[1]] END AS iss FROM o),
pair AS (SELECT p.*, r.t AS r_t, r.alg AS r_alg, r.ds AS r_ds, p.ops[1:1] || r.ops || CASE WHEN p.item_id % 7 = 3 THEN ['pas nou'] ELSE [] END AS r_ops FROM seg p JOIN seg r ON r.item_id = p.item_id + 1),
issue AS (SELECT item_id, i, iss[i] AS x FROM (SELECT item_id, iss, unnest(range(1, len(iss) + 1)) AS i FROM pair)),
hi AS (SELECT item_id, i, max({_alike("x", "a.v")}) AS s FROM issue, {_rows(G.SEVERE)} a(k, v) GROUP BY ALL),
lo AS (SELECT item_id, i, max({_alike("x", "a.v")}) AS s FROM issue, {_rows(G.MINOR)} a(k, v) GROUP BY ALL),
out AS (SELECT item_id, max({_alike("x", "a.v")}) >= {G.OUTPUT_MATCH} AS flag FROM issue, {_rows(G.OUTPUT)} a(k, v) GROUP BY ALL),
critical AS (SELECT item_id, first(x ORDER BY hi.s - {G.MINOR_WEIGHT} * lo.s DESC, i) AS x FROM issue JOIN hi USING (item_id, i) JOIN lo USING (item_id, i) GROUP BY item_id),
near AS (SELECT item_id, first([a.s, a.k] ORDER BY a.s DESC, a.k) AS best FROM (SELECT item_id, k::DOUBLE AS k, {_alike("x", "v")} AS s FROM critical, {_rows(_CONCEPT_PHRASES)} a(k, v)) a GROUP BY item_id),
step AS (SELECT item_id, i, j, {_alike("ops[i]", "r_ops[j]")} AS s FROM (SELECT *, unnest(range(1, len(r_ops) + 1)) AS j FROM (SELECT *, unnest(range(1, len(ops) + 1)) AS i FROM pair))),
matched AS (SELECT item_id, i, max(s) AS s, first(j ORDER BY s DESC, j) AS j FROM step GROUP BY item_id, i),
al AS (SELECT item_id, coalesce(min(i) FILTER (s < {G.OPERATION_MATCH}), 0)::INT - 1 AS diverge, coalesce(list(j) FILTER (s >= {G.OPERATION_MATCH}), []) AS used, sum(round(s, 3)) AS scores FROM matched GROUP BY item_id),
named AS (SELECT *, list_filter(list_transform(ds, lambda d: trim(d)), lambda d: d <> '' AND lower(d) NOT IN ({', '.join(map(_literal, G.GENERIC_STRUCTURES))})) AS a,
  list_filter(list_transform(r_ds, lambda d: trim(d)), lambda d: d <> '' AND lower(d) NOT IN ({', '.join(map(_literal, G.GENERIC_STRUCTURES))})) AS b FROM pair),
extra AS (SELECT item_id, i, any_value(a[i]) AS x FROM (SELECT *, unnest(range(1, len(b) + 1)) AS j FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM named)) GROUP BY item_id, i HAVING max({_alike("a[i]", "b[j]")}) < {G.STRUCTURE_MATCH}),
lacking AS (SELECT item_id, j, any_value(b[j]) AS x FROM (SELECT *, unnest(range(1, len(b) + 1)) AS j FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM named)) GROUP BY item_id, j HAVING max({_alike("a[i]", "b[j]")}) < {G.STRUCTURE_MATCH}),
g AS (SELECT p.*, {_KNOWN.format(x="p.alg")} AS canonical,
  {_KNOWN.format(x="p.alg")} <> {_KNOWN.format(x="p.r_alg")} AND {_alike("p.alg", "p.r_alg")} < {G.ALGORITHM_MATCH} AS differ,
  coalesce(c.x, '') AS issue, CASE WHEN n.best[1] >= {G.CONCEPT_MATCH} THEN {_values(_CONCEPT_NAMES)}[n.best[2]::INT + 1] WHEN al.diverge = 0 THEN 'wrong_initial_step' WHEN abs(len(p.ops) - len(p.r_ops)) > 2 THEN 'missing_algorithmic_steps' ELSE 'implementation_logic_error' END AS concept,
  al.diverge, al.scores, list_filter(p.r_ops, lambda x, k: NOT list_contains(al.used, k)) AS missing_steps, coalesce(o.flag, false) AS output_issue,
  (SELECT list(x ORDER BY j) FROM lacking l WHERE l.item_id = p.item_id) AS missing, (SELECT list(x ORDER BY i) FROM extra e WHERE e.item_id = p.item_id) AS extra
  FROM pair p JOIN al ON al.item_id = p.item_id LEFT JOIN critical c ON c.item_id = p.item_id LEFT JOIN near n ON n.item_id = p.item_id LEFT JOIN out o ON o.item_id = p.item_id)
"""


@register(
    "op_134_anchor_similarity",
    r"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS w FROM conversations), a AS (SELECT list_distinct(string_split(x, ' ')) AS a FROM (VALUES ('the of and'), ('de la que'), ('in to a')) v(x))
    SELECT conv_id, turn, round(max(len(list_intersect(w, a)) / greatest(len(w) + len(a) - len(list_intersect(w, a)), 1)), 6) + 0.0 AS v FROM t, a GROUP BY ALL""",
)
def anchor_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", V.settled(G.max_to_anchors(F.col("text"), ("the of and", "de la que", "in to a"))).alias("v"))


@register("op_135_critical_issue", GAPS_SQL + "SELECT item_id, issue FROM g")
def critical_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select(_ITEM, G.critical_issue(F.col("partial.potential_issues")).alias("issue"))


@register("op_137_operation_alignment", GAPS_SQL + "SELECT item_id, diverge AS diverge_at, array_to_string(missing_steps, '|') AS missing, round(scores, 3) AS scores FROM g")
def operation_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).select(_ITEM, G.align_operations(F.col("partial.key_operations"), F.col("passing.key_operations")).alias("a"))
    return rows.select(_ITEM, "a.diverge_at", F.array_join("a.missing", "|").alias("missing"), F.round(F.aggregate("a.scores", F.lit(0.0), lambda s, x: s + x), 3).alias("scores"))


@register("op_138_algorithms", GAPS_SQL + "SELECT item_id, canonical, differ FROM g")
def algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select(_ITEM, G.canonical_algorithm(F.col("partial.algorithm")).alias("canonical"), G.algorithms_differ(F.col("partial.algorithm"), F.col("passing.algorithm")).alias("differ"))


@register("op_139_structures", GAPS_SQL + "SELECT item_id, array_to_string(coalesce(missing, []), '|') AS missing, array_to_string(coalesce(extra, []), '|') AS extra FROM g")
def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).select(_ITEM, G.structure_divergence(F.col("partial.data_structures"), F.col("passing.data_structures")).alias("d"))
    return rows.select(_ITEM, *[F.coalesce(F.array_join(f"d.{c}", "|"), F.lit("")).alias(c) for c in ("missing", "extra")])


@register("op_13a_output_issue", GAPS_SQL + "SELECT item_id, output_issue FROM g")
def output_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select(_ITEM, G.has_output_issue(F.col("partial.potential_issues")).alias("output_issue"))


@register("op_13b_missing_concept", GAPS_SQL + "SELECT item_id, concept FROM g")
def missing_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = G.align_operations(F.col("partial.key_operations"), F.col("passing.key_operations"))
    rows = segments(spark, sf_dir).select(_ITEM, G.critical_issue(F.col("partial.potential_issues")).alias("issue"), aligned.alias("aligned"))
    return rows.select(_ITEM, G.missing_concept(F.col("issue"), F.col("aligned")).alias("concept"))


def _by_level(intent: str, function: str, implementation: str) -> str:
    return f"CASE WHEN NOT m THEN {intent} WHEN differ THEN {function} ELSE {implementation} END"


def _chain(x: str) -> str:
    return f"array_to_string({x}[1:3], ' → ') || CASE WHEN len({x}) > 3 THEN ' (+ ' || (len({x}) - 3) || ' mai multe)' ELSE '' END"


_GAP_COLUMNS_SQL = (
    GAPS_SQL
    + f""", h AS (SELECT item_id, {_by_level("'intent'", "'function'", "'implementation'")} AS gap_level,
  {_by_level("'problem_understanding'", "'algoritm_gresit:' || alg || '_vs_' || r_alg", "concept")} AS missing_concept,
  {_by_level("t", "'folosește ' || alg", _chain("ops"))} AS evidence_partial, {_by_level("r_t", "'ar trebui să folosească ' || r_alg", _chain("r_ops"))} AS evidence_passing,
  {_by_level("'Studentul rezolvă o altă problemă'", "issue", "issue")} AS primary_issue, {_by_level("NULL", "NULL", "diverge")} AS diverges_at_step, {_by_level("NULL", "NULL", "missing_steps")} AS steps,
  {_by_level("NULL", "missing", "missing")} AS missing, {_by_level("NULL", "extra", "extra")} AS extra,
  {_by_level("'macro'", "'structural'", "'specific'")} AS hint_level, {_by_level("NULL", "NULL", "output_issue")} AS output_issue FROM g)
"""
)


@register("op_13d_gap_objects", _GAP_COLUMNS_SQL + "SELECT item_id, gap_level, missing_concept, evidence_partial, evidence_passing, primary_issue, diverges_at_step, hint_level, output_issue FROM h")
def gap_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = segments(spark, sf_dir).select(_ITEM, G.gap(F.col("partial"), F.col("passing"), F.lit(0.9)).alias("g"))
    return g.select(_ITEM, "g.gap_level", "g.missing_concept", "g.evidence_partial", "g.evidence_passing", "g.primary_issue", "g.diverges_at_step", "g.hint_level", "g.output_issue")


@register(
    "op_12p_gap_text",
    _GAP_COLUMNS_SQL
    + """SELECT item_id, concat_ws(chr(10), '── ANALIZA DIFERENȚEI ──', 'Nivel gap:              ' || gap_level, 'Concept lipsă:          ' || missing_concept, 'Nivel hint:             ' || hint_level, 'Similaritate cod:       medium', '',
    'Abordare parțială:      ' || evidence_partial, 'Abordare corectă (100p):' || evidence_passing, CASE WHEN primary_issue <> '' THEN 'Problemă principală:    ' || primary_issue END,
    CASE WHEN diverges_at_step >= 0 THEN 'Divergență la pasul:    ' || (diverges_at_step + 1) END,
    CASE WHEN len(steps) > 0 THEN 'Pași lipsă din parțială:' || array_to_string(list_transform(steps[1:4], lambda s: chr(10) || '  - ' || s), '') || CASE WHEN len(steps) > 4 THEN chr(10) || '  - (+ ' || (len(steps) - 4) || ' alți pași)' ELSE '' END END,
    CASE WHEN output_issue THEN 'Logica ieșirii:         de asemenea incorectă' END, 'Structuri de date lipsă:[''' || array_to_string(missing, ''', ''') || ''']', 'Structuri de date în plus:[''' || array_to_string(extra, ''', ''') || ''']', '── SFÂRȘIT ANALIZĂ ──') AS text FROM h""",
)
def gap_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = segments(spark, sf_dir).select(_ITEM, G.gap(F.col("partial"), F.col("passing"), F.lit(0.9)).alias("g"))
    return g.select(_ITEM, G.gap_text(F.col("g")).alias("text"))


# --- the same with vectors: texts that name vectors of the embeddings table


def named_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text, vector: ``v<id>`` for each vector but every 11th, and every phrase for the vector of its place."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    phrases = spark.createDataFrame(list(enumerate(dict.fromkeys(p for of_kind in G.Phrases().by_kind().values() for p in of_kind))), "vec_id long, text string")
    return rows.where("vec_id % 11 <> 5").select(F.concat(F.lit("v"), "vec_id").alias("text"), "vector").unionByName(rows.join(F.broadcast(phrases), "vec_id").select("text", "vector"))


def _name(k: int, factor: int = 1):
    return F.concat(F.lit("v"), (F.col("vec_id") * factor + k).cast("string"))


def vector_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector two segment records whose texts are names of vectors near it."""

    def record(shift: int, ops: list):
        return F.struct((F.col("vec_id") % 9 != 0).alias("matches_problem"), _name(shift).alias("text"), _name(3 * shift).alias("algorithm"), F.array(_name(1), _name(shift + 6)).alias("data_structures"), F.array(*ops).alias("key_operations"), F.array(_name(0), _name(2, 2), F.lit("altceva cu totul")).alias("potential_issues"))

    partial, passing = record(0, [_name(0), _name(1), F.concat(F.lit("read "), _name(2))]), record(1, [_name(2), F.concat(F.lit("read "), _name(3)), _name(0, 2), _name(7)])
    return table(spark, sf_dir, "embeddings").select("vec_id", partial.alias("partial"), passing.alias("passing"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_segments(spark, sf_dir)
    return S.with_known(rows, ["vec_id"], G.compared_texts(F.col("partial"), F.col("passing")), named_vectors(spark, sf_dir), G.Phrases().by_kind())


_UNITS_SQL = "units AS (SELECT vec_id, label, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) AS u FROM (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings))"


@register(
    "op_072_semantic_join",
    f"""WITH {_UNITS_SQL}, s AS (SELECT q.vec_id AS id, r.vec_id AS match, round(list_dot_product(q.u, r.u), 9) AS sim FROM units q JOIN units r ON r.label = q.label AND r.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
    SELECT id, match, round(sim, 6) + 0.0 AS sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, match) AS k FROM s) WHERE k = 1 AND sim >= 0.25""",
)
def semantic_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector of the query set the likest other one of its label, if its cosine is large enough."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.concat(F.lit("v"), "vec_id").alias("text"), S.unit(F.col("embedding")).alias("vector"))
    # the query vectors are not among what they are joined with, but for others of the set
    asked = rows.where("id % 50 = 0")
    others = S.semantic_join(asked, rows.where("id % 50 <> 0"), ["label"], 0.25)
    rest = asked.select("label", F.col("id").alias("other"), F.col("text").alias("other_text"), F.col("vector").alias("other_vector"))
    each = asked.join(rest, "label").where("id <> other")
    among = each.select("id", F.col("other").alias("match"), F.round(V.dot(F.col("vector"), F.col("other_vector")), S.DIGITS).alias("sim")).where("sim >= 0.25")
    best = others.unionByName(among).groupBy("id").agg(F.min(F.struct((-F.col("sim")).alias("far"), "match")).alias("x"))
    return best.select("id", "x.match", V.settled(-F.col("x.far")).alias("sim"))


@register(
    "op_137_vector_alignment",
    f"""WITH {_UNITS_SQL}, named AS (SELECT 'v' || vec_id AS t, u FROM units WHERE vec_id % 11 <> 5),
    rec AS (SELECT vec_id, ['v' || vec_id, 'v' || (vec_id + 1), 'read v' || (vec_id + 2)] AS a, ['v' || (vec_id + 2), 'read v' || (vec_id + 3), 'v' || (2 * vec_id), 'v' || (vec_id + 7)] AS b FROM embeddings),
    p AS (SELECT vec_id, unnest(a) AS x, unnest(range(1, 4)) AS i FROM rec), q AS (SELECT vec_id, unnest(b) AS y, unnest(range(1, 5)) AS j FROM rec),
    s AS (SELECT p.vec_id, i, j, CASE WHEN v.u IS NOT NULL AND w.u IS NOT NULL THEN round(list_dot_product(v.u, w.u), 9) ELSE {_alike("x", "y")} END AS sim FROM p JOIN q USING (vec_id) LEFT JOIN named v ON v.t = x LEFT JOIN named w ON w.t = y),
    best AS (SELECT vec_id, i, max(sim) AS sim, first(j ORDER BY sim DESC, j) AS j FROM s GROUP BY vec_id, i),
    al AS (SELECT vec_id, coalesce(min(i) FILTER (sim < {G.OPERATION_MATCH}), 0)::INT - 1 AS diverge_at, coalesce(list(j) FILTER (sim >= {G.OPERATION_MATCH}), []) AS used, round(sum(round(sim, 3)), 3) + 0.0 AS scores FROM best GROUP BY vec_id)
    SELECT vec_id, diverge_at, array_to_string(list_filter(b, lambda y, k: NOT list_contains(used, k)), '|') AS missing, scores FROM al JOIN rec USING (vec_id)""",
)
def vector_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps aligned by the cosines of their vectors; by their words where a step has none."""
    rows = _known(spark, sf_dir).select("vec_id", G.align_operations(F.col("partial.key_operations"), F.col("passing.key_operations"), F.col("known")).alias("a"))
    return rows.select("vec_id", "a.diverge_at", F.array_join("a.missing", "|").alias("missing"), V.settled(F.aggregate("a.scores", F.lit(0.0), lambda s, x: s + x), 3).alias("scores"))


_PHRASES_SQL = "(VALUES " + ", ".join(f"({kind!r}, {k}, {_literal(p)})" for kind, of_kind in G.Phrases().by_kind().items() for k, p in enumerate(of_kind)) + ")"
_DISTINCT_SQL = "(VALUES " + ", ".join(f"({k}, {_literal(p)})" for k, p in enumerate(dict.fromkeys(p for of_kind in G.Phrases().by_kind().values() for p in of_kind))) + ")"


@register(
    "op_13a_vector_issues",
    f"""WITH {_UNITS_SQL}, named AS (SELECT 'v' || vec_id AS t, u FROM units WHERE vec_id % 11 <> 5),
    phrase AS (SELECT kind, k, p, u FROM {_PHRASES_SQL} x(kind, k, p) LEFT JOIN (SELECT p, u FROM {_DISTINCT_SQL} d(vec_id, p) JOIN units USING (vec_id)) USING (p)),
    issue AS (SELECT vec_id, unnest(['v' || vec_id, 'v' || (2 * vec_id + 2), 'altceva cu totul']) AS x, unnest([1, 2, 3]) AS i FROM embeddings),
    known AS (SELECT p AS t, u FROM phrase WHERE u IS NOT NULL UNION SELECT t, u FROM named),
    s AS (SELECT vec_id, i, x, kind, max(CASE WHEN v.u IS NOT NULL AND phrase.u IS NOT NULL THEN round(list_dot_product(v.u, phrase.u), 9) ELSE {_alike("x", "p")} END) AS sim
      FROM issue LEFT JOIN known v ON v.t = x CROSS JOIN phrase GROUP BY ALL),
    hi AS (SELECT vec_id, i, x, max(sim) FILTER (kind = 'severe') - {G.MINOR_WEIGHT} * max(sim) FILTER (kind = 'minor') AS severity FROM s GROUP BY ALL)
    SELECT vec_id, first(x ORDER BY severity DESC, i) AS issue, (SELECT max(sim) FROM s WHERE s.vec_id = hi.vec_id AND kind = 'output') >= {G.OUTPUT_MATCH} AS output_issue FROM hi GROUP BY vec_id""",
)
def vector_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The critical issue, and whether one is about the output, by cosines to the phrases."""
    issues = F.col("partial.potential_issues")
    return _known(spark, sf_dir).select("vec_id", G.critical_issue(issues, known=F.col("known")).alias("issue"), G.has_output_issue(issues, known=F.col("known")).alias("output_issue"))


@register("op_13d_vector_gaps")
def vector_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap records of which every comparison is one of vectors."""
    g = _known(spark, sf_dir).select("vec_id", G.gap(F.col("partial"), F.col("passing"), F.lit(0.9), known=F.col("known")).alias("g"))
    return g.select("vec_id", "g.gap_level", "g.missing_concept", "g.primary_issue", "g.diverges_at_step", "g.hint_level", "g.output_issue")
