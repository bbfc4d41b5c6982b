"""Column builders for text and code measures (OP-120 to 12Q)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of letters, digits and underscores of any script; engines' own ``\w`` is ASCII.
WORD = r"[\p{L}\p{N}_]+"
IDENTIFIER = r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"
ELLIPSIS = "..."


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sentence_count(text: Column) -> Column:
    """Runs of closing punctuation, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]+"))).cast("long")


def whitespace_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def closing_marks(text: Column) -> Column:
    """Every closing mark counts, one at least."""
    return F.greatest(F.lit(1), F.length(text) - F.length(F.translate(text, ".!?", ""))).cast("long")


def lines(text: Column) -> Column:
    """Lines without their ends; a text that ends a line has no empty last one."""
    parts = F.split(text, r"\r\n|\n|\r")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def loc(text: Column) -> Column:
    """Lines of code: neither blank nor beginning like a comment."""
    return F.size(F.filter(F.transform(lines(text), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: (x != "") & ~x.rlike(r"^(//|/\*|\*)"))).cast("long")


def code_lines(text: Column) -> Column:
    """Normalised code lines: comment-only and blank lines go (also lines that end a block comment), white space collapses."""
    stripped = F.transform(lines(text), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(stripped, lambda x: (x != "") & ~x.rlike(r"^(//|/\*|\*)") & ~x.rlike(r"\*/$"))
    return F.transform(kept, lambda x: F.regexp_replace(x, r"\s+", " "))


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def truncate(text: Column, limit: int, marker: str = ELLIPSIS) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))).otherwise(text)


def cap_text(text: Column, limit: int = 400) -> Column:
    """At most ``limit`` characters; a longer text ends in dots."""
    cut = F.regexp_replace(F.left(text, F.lit(limit - len(ELLIPSIS))), r"\s+$", "")
    return F.when(F.length(text) > limit, F.concat(cut, F.lit(ELLIPSIS))).otherwise(text)


def strip_fences(text: Column) -> Column:
    """The inside of a fenced block that is the whole text."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")


#: Broken glyph sequences of text taken from PDFs and what they stand for, in order.
DIACRITICS = (
    (r"a˘(?![\p{L}\p{N}_])", "ă"), ("˘a", "ă"), ("A˘", "Ă"), ("˘A", "Ă"), ("ˆı", "î"), ("ˆI", "Î"), ("ˆa", "â"), ("ˆA", "Â"),
    (r"(?<![\p{L}\p{N}_])s\s*,\s*", "ș"), (r"(?<![\p{L}\p{N}_])S\s*,\s*", "Ș"), (r"(?<![\p{L}\p{N}_])t\s*,\s*", "ț"), (r"(?<![\p{L}\p{N}_])T\s*,\s*", "Ț"),
    ("s,", "ș"), ("t,", "ț"), ("S,", "Ș"), ("T,", "Ț"), (" {2,}", " "),
)


def repair_diacritics(text: Column) -> Column:
    for broken, whole in DIACRITICS:
        text = F.regexp_replace(text, broken, whole)
    return text


def numbers_masked(text: Column) -> Column:
    """An issue text with its numbers masked, so that texts of one kind are equal."""
    return F.lower(F.trim(F.regexp_replace(text, r"-?\d+", "<N>")))


def bullets(items: Column, mark: str = "- ") -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(mark), x)), "\n")


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


#: The text for no items, what joins items, and what tells how many more there are.
NO_ITEMS, ARROW, MORE = "nicio operație extrasă", " → ", (" (+ ", " mai multe)")


def chain_summary(items: Column, shown: int = 3) -> Column:
    """The first few items joined by arrows, and how many more there are."""
    more = F.concat(F.lit(MORE[0]), (F.size(items) - shown).cast("string"), F.lit(MORE[1]))
    return F.when(F.size(items) == 0, NO_ITEMS).otherwise(F.concat(F.array_join(F.slice(items, 1, shown), ARROW), F.when(F.size(items) > shown, more).otherwise(F.lit(""))))


def content_key(text: Column) -> Column:
    return F.left(F.sha1(F.encode(text, "UTF-8")), F.lit(16))
