"""Schema and referential checks that return violations as data (OP-090 to 095, 13F)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Allowed values of annotation and hint records.
DIFFICULTIES = ("easy", "medium", "hard", "very_hard")
LEVELS = ("macro", "structural", "specific", "very_specific")
CONFIDENCES = ("high", "medium", "low")
#: Section, field and type of a segment record.
SEGMENT_FIELDS = (
    ("intent", "text", "string"), ("intent", "matches_problem", "boolean"), ("intent", "confidence", "string"),
    ("function", "algorithm", "string"), ("function", "data_structures", "array"), ("function", "complexity", "string"), ("function", "confidence", "string"),
    ("implementation", "key_operations", "array"), ("implementation", "potential_issues", "array"), ("implementation", "confidence", "string"),
)


#: Python's names of JSON types, as Spark's variants name them.
_TYPE_NAMES = (("string", "str"), ("boolean", "bool"), ("array", "list"), ("object", "dict"), ("bigint", "int"), ("double", "float"), ("decimal", "float"), ("float", "float"), ("void", "NoneType"))


def quoted(text: Column) -> Column:
    """A text as Python shows it: in single quotes, or in double ones if it holds single ones only."""
    plain = text
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(shown))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


# messages are "<path>: <what>", in fixed words


def in_domain(value: Column, domain: tuple[str, ...], path: str) -> Column:
    """A message if a value that is there isn't in its domain."""
    return F.when(value.isNotNull() & ~value.isin(*domain), F.concat(F.lit(f"{path}: "), quoted(value), F.lit(f" is not one of {list(domain)!r}")))


def in_range(value: Column, low: float, high: float, path: str) -> Column:
    shown = F.concat(F.lit(f"{path}: "), value.cast("string"))
    return F.when(value < low, F.concat(shown, F.lit(f" is less than the minimum of {low}"))).when(value > high, F.concat(shown, F.lit(f" is greater than the maximum of {high}")))


def has_length(text: Column, low: int, high: int, path: str) -> Column:
    shown = F.concat(F.lit(f"{path}: "), quoted(text))
    return F.when(F.char_length(text) < low, F.concat(shown, F.lit(" is too short"))).when(F.char_length(text) > high, F.concat(shown, F.lit(" is too long")))


def has_items(items: Column, low: int, high: int, path: str) -> Column:
    shown = F.concat(F.lit(f"{path}: ["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))
    return F.when(F.size(items) < low, F.concat(shown, F.lit(" is too short"))).when(F.size(items) > high, F.concat(shown, F.lit(" is too long")))


def matches(text: Column, pattern: str, path: str) -> Column:
    return F.when(text.isNotNull() & ~text.rlike(pattern), F.concat(F.lit(f"{path}: "), quoted(text), F.lit(f" does not match {pattern!r}")))


def violations(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def keys_of(document: Column) -> Column:
    return F.json_object_keys(document)


def key_violations(document: Column, required: tuple[str, ...], allowed: tuple[str, ...], path: str = "") -> Column:
    """Missing keys of a JSON document, in the order in which they are required, and its unknown ones, by name, in one message."""
    keys = F.coalesce(keys_of(document), F.array().cast("array<string>"))
    missing = F.transform(F.array_except(F.array(*map(F.lit, required)), keys), lambda k: F.concat(F.lit(f"{path}: "), quoted(k), F.lit(" is a required property")))
    extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, allowed))))
    verb = F.when(F.size(extra) == 1, "was").otherwise("were")
    unknown = F.concat(F.lit(f"{path}: Additional properties are not allowed ("), F.array_join(F.transform(extra, quoted), ", "), F.lit(" "), verb, F.lit(" unexpected)"))
    return F.concat(missing, F.when(F.size(extra) > 0, F.array(unknown)).otherwise(F.array().cast("array<string>")))


def _type_name(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind.startswith(k), F.lit(name)) for k, name in _TYPE_NAMES], kind)


def segment_violations(document: Column) -> Column:
    """Presence, types and confidence domain of a segment record given as JSON text, in fixed words: sections and fields first, then confidences."""
    v = F.try_parse_json(document)
    names = dict(_TYPE_NAMES)
    at = lambda path: F.try_variant_get(v, f"$.{path}", "variant")
    checks, confidences = [], []
    for section in dict.fromkeys(name for name, _, _ in SEGMENT_FIELDS):
        missing = at(section).isNull()
        checks.append(F.when(missing, F.lit(f"missing section: {section}")))
        for _, field, kind in (x for x in SEGMENT_FIELDS if x[0] == section):
            value = at(f"{section}.{field}")
            found = F.lower(F.schema_of_variant(value))
            wrong = F.concat(F.lit(f"wrong type: {section}.{field} (got "), _type_name(found), F.lit(f", expected {names[kind]})"))
            checks.append(F.when(~missing, F.when(value.isNull(), F.lit(f"missing field: {section}.{field}")).when(~found.startswith(kind), wrong)))
        value, text = at(f"{section}.confidence"), F.try_variant_get(v, f"$.{section}.confidence", "string")
        kind = F.lower(F.schema_of_variant(value))
        shown = F.when(value.isNull(), "''").when(kind == "void", "None").when(kind == "boolean", F.initcap(text)).when(kind.startswith("string"), quoted(text)).otherwise(text)
        good = kind.startswith("string") & text.isin(*CONFIDENCES)
        confidences.append(F.when(~F.coalesce(good, F.lit(False)), F.concat(F.lit(f"invalid confidence in {section}: "), F.coalesce(shown, F.lit("''")))))
    return violations(*checks, *confidences)


def unknown_ids(ids: Column, known: Column) -> Column:
    """Ids that a dimension doesn't know."""
    return F.array_sort(F.array_except(ids, known))


def robust_json(raw: Column) -> tuple[Column, Column]:
    """JSON text found in a model's answer, and why there is none.

    The whole answer, else the inside of a fenced block, else what the outermost
    braces hold; the first that parses.
    """
    fenced = F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))
    found = F.coalesce(*[F.when(F.try_parse_json(c).isNotNull(), c) for c in (raw, fenced, braces)])
    error = F.when(found.isNotNull(), F.lit("")).when(braces.isNull(), F.lit("no JSON found in output")).otherwise(F.lit("json parse failed"))
    return found, error


def truncation_warnings(prompt: Column, output: Column, context: Column, budget: Column) -> Column:
    """What the token counts of a call say about its being cut, in fixed words."""
    n = lambda x: x.cast("string")
    left = context - budget
    cut = F.concat(F.lit("prompt="), n(prompt), F.lit("tok > num_ctx("), n(context), F.lit(") − num_predict("), n(budget), F.lit(")="), n(left), F.lit("tok → prompt truncated by Ollama"))
    full = F.concat(F.lit("output="), n(output), F.lit("tok hit num_predict cap ("), n(budget), F.lit(") → JSON likely truncated"))
    return violations(F.when((context != 0) & (prompt != 0) & (prompt > left), cut), F.when((budget != 0) & (output != 0) & (output >= budget), full))
