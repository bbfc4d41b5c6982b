"""Parts of a long text that belong to one name (OP-12D to 12I), as column expressions.

Matches of a pattern are found by splitting a text where it matches ahead, so
places are counted in characters and no text leaves the engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The three headers of a task, whose first group is its number.
HEADERS = (
    r"(\d+)\s+problema\s+\1\s*(?:\([^)]*\))?\s*:",
    r"Problema\s+(\d+)\s*[–\-]",
    r"(?<!\d)(\d+)Bonus",
)
#: The heading that follows a task's header, its dotted form in a table of contents, and files that name a task.
HEADING, DOTTED, FILES, ANCHOR_FILES = "Enun", r"Enun[^\n]*\. \.", ("in", "out", "c", "cpp", "java"), ("in", "out")
#: Characters read for the heading, before an anchor and from a start; around an anchor without a start; past an
#: anchor before the next header counts; from a second mention.
HEADING_WITHIN, LOOK_BACK, MOST, BEFORE, AFTER, PAST, MENTION = 500, 12_000, 8_000, 2_000, 4_000, 80, 4_000
#: Fixed value: what shows that a heading has a body.
BODY = HEADING + r"[^\n]*\s+[A-Za-zăâîșțĂÂÎȘȚ]"

#: Any case, and classes of all scripts.
_ANY = "(?iU)"
#: A letter, digit or underscore of any script.
_WORD_CHAR = r"[\p{L}\p{N}_]"


def longest_chunks(docs: DataFrame, keys: list[str], names: list[str], text: str = "text") -> DataFrame:
    """keys, name, chunk: each name's longest chunk of a text, from a mention of it as a word to the next mention of any name.

    Of equally long chunks the first. Names are found in any case and reported
    as given; empty ones are none, and of names that differ in case alone the
    last counts. Null and empty texts have no chunks.
    """
    known = {n.lower(): n for n in names if n}
    if not known:
        return docs.limit(0).select(*keys, F.lit("").alias("name"), F.lit("").alias("chunk"))
    one = "(?:" + "|".join(re.escape(n) for n in sorted(known, key=len, reverse=True)) + ")"
    parts = F.split(text, rf"(?iu)(?<!{_WORD_CHAR})(?={one}(?!{_WORD_CHAR}))")
    each = docs.select(*keys, F.posexplode(parts).alias("__at", "__part"))
    found = each.withColumn("__name", F.lower(F.regexp_extract("__part", rf"(?iu)^({one})(?!{_WORD_CHAR})", 1))).where("__name <> ''")
    longest = found.groupBy(*keys, "__name").agg(F.max(F.struct(F.length("__part").alias("n"), (-F.col("__at")).alias("at"), F.col("__part").alias("part"))).alias("x"))
    given = F.create_map(*[F.lit(v) for pair in known.items() for v in pair])
    return longest.select(*keys, F.element_at(given, F.col("__name")).alias("name"), "x.part").withColumnRenamed("part", "chunk")


def stripped(text: Column) -> Column:
    """Without white space at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"(?U)\A\s+|\s+\z", ""), F.lit(""))


def matches(text: Column, pattern: str) -> Column:
    """(start, found) of each place at which the pattern matches, by place."""
    parts = F.split(text, f"{_ANY}(?={pattern})", -1)
    whole = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, found: string>>").alias("all")),
        lambda s, part: F.struct((s["at"] + F.length(part)).alias("at"), F.concat(s["all"], F.array(F.struct(s["at"].alias("start"), F.regexp_extract(part, rf"{_ANY}\A(?:{pattern})", 0).alias("found")))).alias("all")),
        lambda s: s["all"],
    )
    # the first part need not begin with a match
    return F.filter(whole, lambda m: m["found"] != "")


def task_starts(text: Column, low: Column, high: Column) -> Column:
    """(start, number) of headers inside text[low:high] whose heading follows and isn't an entry of a table of contents, by place, each once."""
    inside = F.substring(text, low + 1, high - low)
    found = [F.transform(matches(inside, header), _headed(text, low, header)) for header in HEADERS]
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*found))))


def _headed(text: Column, low: Column, header: str) -> Callable[[Column], Column]:
    """Of a match of a header its start and number; null if no heading with a body follows."""

    def check(m: Column) -> Column:
        number = F.regexp_extract(m["found"], f"{_ANY}{header}", 1)
        window = F.substring(text, m["start"] + F.length(m["found"]) + low + 1, F.lit(HEADING_WITHIN))
        heads = F.regexp_like(window, F.concat(F.lit(_ANY), number, F.lit(rf"\.1\s+{HEADING}"))) & F.regexp_like(window, F.lit(_ANY + BODY)) & ~F.regexp_like(window, F.lit("(?U)" + DOTTED))
        return F.when(heads, F.struct((m["start"] + low).cast("long").alias("start"), number.cast("long").alias("number")))

    return check


def _mentions(name: Column, kinds: tuple[str, ...]) -> Column:
    """The pattern of a name's files."""
    return F.concat(F.lit(_ANY + r"\b\Q"), F.lower(name), F.lit(rf"\E\.(?:{'|'.join(kinds)})\b"))


def with_sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each task of each text: key, start (from 0), number."""
    starts = task_starts(F.col(text), F.lit(0), F.length(text))
    return docs.select(key, F.inline(starts))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunk_in_sections(text: Column, name: Column) -> Column:
    """The first task that mentions a file of the name; null if there is none."""
    whole = F.struct(F.length(text).cast("long").alias("end"), F.transform(task_starts(text, F.lit(0), F.length(text)), lambda s: s["start"]).alias("starts"))

    def first_of(w: Column) -> Column:
        ends = F.concat(F.slice(w["starts"], 2, F.greatest(F.size(w["starts"]) - 1, F.lit(0))), F.array(w["end"]))
        spans = F.zip_with(w["starts"], ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        named = F.filter(spans, lambda p: p["a"].isNotNull() & F.regexp_like(_cut(text, p["a"], p["b"]), _mentions(name, FILES)))
        return _let(F.get(named, F.lit(0)), lambda p: stripped(_cut(text, p["a"], p["b"])))

    return _let(whole, first_of)


def _cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end]"""
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def chunk_at_anchor(text: Column, name: Column) -> Column:
    """The text around the first mention of the name's input or output file: from the last start before it to the next header."""
    before = F.split(text, _mentions(name, ANCHOR_FILES), 2)
    found = F.when(F.size(before) > 1, F.length(before[0]))

    def around(anchor: Column) -> Column:
        low = F.greatest(F.lit(0), anchor - LOOK_BACK)
        numbered = F.transform(matches(_cut(text, low, anchor), rf"(?:\A|\n)\d+\.1\s+{HEADING}"), lambda m: (m["start"] + low).cast("long"))
        last = F.array_max(F.concat(F.transform(task_starts(text, low, anchor), lambda s: s["start"]), numbered))
        return _let(last, lambda start: stripped(F.when(start.isNull(), _cut(text, F.greatest(F.lit(0), anchor - BEFORE), anchor + AFTER)).otherwise(_from(anchor, start))))

    def _from(anchor: Column, start: Column) -> Column:
        rest = F.substring(text, anchor + PAST + 1, F.length(text))
        places = F.transform(F.array(*[F.split(rest, rf"{_ANY}\n{header}", 2) for header in HEADERS]), lambda p: F.when(F.size(p) > 1, (anchor + PAST + F.length(F.get(p, F.lit(0)))).cast("long")))
        end = F.coalesce(F.array_min(F.array_compact(places)), F.least(F.length(text).cast("long"), start + MOST))
        return _let(end, lambda e: _cut(text, start, e))

    return _let(found, lambda anchor: F.when(anchor.isNotNull(), around(anchor)))


def second_mention(text: Column, name: Column, chars: int = MENTION) -> Column:
    """A fixed length from the second mention of the name as a word, or from the first if there is one only."""
    pattern = F.concat(F.lit(r"(?iU)\b\Q"), name, F.lit(r"\E\b"))
    before = F.split(text, pattern, 3)
    at = F.length(before[0]) + F.when(F.size(before) > 2, F.length(name) + F.length(F.get(before, F.lit(1)))).otherwise(F.lit(0)) + 1
    return F.when(F.size(before) > 1, F.regexp_replace(F.substring(text, at, F.lit(chars)), r"^\s+|\s+$", ""))


def cascade(text: Column, name: Column) -> Column:
    """By task, else around the file's mention, else from the second mention; null if there is no mention."""
    return F.coalesce(chunk_in_sections(text, name), chunk_at_anchor(text, name), second_mention(text, name))
