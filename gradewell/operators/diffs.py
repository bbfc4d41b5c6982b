"""Line differences of two texts (OP-127 to 129, 12A).

The longest block of lines that both texts share is found, then the longest on
either side of it, and so on; what lies between blocks was removed or added.
Lines are compared by numbers, and a search holds one row of run lengths.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

#: Words of C++ and Java that show a program's structure.
STRUCTURAL = frozenset(
    "for while do if else switch case break continue return goto struct class namespace using static const constexpr void int long double char bool "
    "vector map unordered_map set unordered_set queue priority_queue stack deque pair tuple string "
    "ArrayList HashMap HashSet TreeMap TreeSet PriorityQueue Stack Queue LinkedList BufferedReader PrintWriter".split()
)
EXCERPT, TOP, CONTEXT = 4000, 8, 2
#: What ends an excerpt that was cut, and the words of a summary.
CUT = "\n... [truncated]"
COUNTS, MORE, LESS = "+%d/-%d linii", "structuri în plus: ", "structuri eliminate: "
#: Fixed value: a word of a program.
_TOKEN = re.compile(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b")
_TEXTS = ArrayType(StringType())
DIFF = StructType(
    [
        StructField("n_added", LongType()),
        StructField("n_removed", LongType()),
        StructField("added_blocks", ArrayType(_TEXTS)),
        StructField("removed_blocks", ArrayType(_TEXTS)),
        StructField("structural_added", _TEXTS),
        StructField("structural_removed", _TEXTS),
        StructField("excerpt", StringType()),
        StructField("ratio", DoubleType()),
    ]
)
#: (first and last + 1 of the old lines, the same of the new ones)
Area = tuple[int, int, int, int]


def _longest(old: list[int], where: dict[int, list[int]], area: Area) -> tuple[int, int, int]:
    """Start in the old and in the new lines and length of the longest common block in an area; of equals the first in old, then in new."""
    i0, i1, j0, j1 = area
    best, runs = (i0, j0, 0), {}
    for i in range(i0, i1):
        ending = {}  # length of the common run that ends at this old line and a new one
        for j in where.get(old[i], ()):
            if j < j0:
                continue
            if j >= j1:
                break
            n = ending[j] = runs.get(j - 1, 0) + 1
            if n > best[2]:
                best = (i - n + 1, j - n + 1, n)
        runs = ending
    return best


def matching_blocks(old: list[str], new: list[str]) -> list[tuple[int, int, int]]:
    """(start in old, start in new, lines) of the common blocks, in order; neighbours are one block."""
    number: dict[str, int] = {}
    a, b = ([number.setdefault(line, len(number)) for line in lines] for lines in (old, new))
    where: dict[int, list[int]] = defaultdict(list)
    for j, line in enumerate(b):
        where[line].append(j)
    found, open_areas = [], [(0, len(a), 0, len(b))]
    while open_areas:
        i0, i1, j0, j1 = area = open_areas.pop()
        i, j, n = _longest(a, where, area)
        if n:
            found.append((i, j, n))
            open_areas += [x for x in ((i0, i, j0, j), (i + n, i1, j + n, j1)) if x[0] < x[1] and x[2] < x[3]]
    blocks: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if blocks and (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]) == (i, j):
            i, j, n = *blocks[-1][:2], blocks.pop()[2] + n
        blocks.append((i, j, n))
    return blocks


def changes(blocks: list[tuple[int, int, int]], n_old: int, n_new: int) -> list[Area]:
    """What lies between the blocks."""
    ends = [(0, 0), *((i + n, j + n) for i, j, n in blocks)]
    starts = [*((i, j) for i, j, _ in blocks), (n_old, n_new)]
    return [(i0, i1, j0, j1) for (i0, j0), (i1, j1) in zip(ends, starts, strict=True) if i0 < i1 or j0 < j1]


def _span(first: int, end: int) -> str:
    """Lines of a hunk as unified differences write them: from 1; an empty span names the line before it."""
    n = end - first
    return f"{first + 1}" if n == 1 else f"{first + (n > 0)},{n}"


def unified(old: list[str], new: list[str], changed: list[Area], context: int = CONTEXT) -> Iterator[str]:
    """Lines of a unified difference; changes that are near each other share a hunk."""
    hunks: list[list[Area]] = []
    for c in changed:
        if hunks and c[0] - hunks[-1][-1][1] <= 2 * context:
            hunks[-1].append(c)
        else:
            hunks.append([c])
    if hunks:
        yield from ("--- ", "+++ ")
    for hunk in hunks:
        before = min(context, hunk[0][0], hunk[0][2])
        after = min(context, len(old) - hunk[-1][1])
        first, end = hunk[0][0] - before, hunk[-1][1] + after
        yield f"@@ -{_span(first, end)} +{_span(hunk[0][2] - before, hunk[-1][3] + after)} @@"
        at = first
        for i0, i1, j0, j1 in hunk:
            yield from (" " + x for x in old[at:i0])
            yield from ("-" + x for x in old[i0:i1])
            yield from ("+" + x for x in new[j0:j1])
            at = i1
        yield from (" " + x for x in old[at:end])


def _more(a: Counter, b: Counter) -> list[str]:
    """Structural words that ``b`` has more often, the largest difference first."""
    rise = {w: n - a[w] for w, n in b.items() if w in STRUCTURAL and n > a[w]}
    return [w for w, _ in Counter(rise).most_common(TOP)]  # of equals the first seen


def difference(old: list[str], new: list[str]) -> tuple:
    """Of normalised lines: what a reader wants to know about the change."""
    blocks = matching_blocks(old, new)
    changed = changes(blocks, len(old), len(new))
    added = [new[c[2] : c[3]] for c in changed if c[3] > c[2]]
    removed = [old[c[0] : c[1]] for c in changed if c[1] > c[0]]
    before, after = (Counter(t for line in lines for t in _TOKEN.findall(line)) for lines in (old, new))
    excerpt = "\n".join(unified(old, new, changed))
    lines = len(old) + len(new)
    ratio = 2.0 * sum(n for *_, n in blocks) / lines if lines else 1.0
    return sum(map(len, added)), sum(map(len, removed)), added, removed, _more(before, after), _more(after, before), excerpt if len(excerpt) <= EXCERPT else excerpt[:EXCERPT] + CUT, ratio


@F.udf(DIFF, useArrow=False)
def diff_lines(old: list[str] | None, new: list[str] | None) -> tuple:
    """Struct of the difference of two arrays of normalised lines (see functions.text.code_lines).

    Row by row: a task holds a hundred rows' lines at a time, where a batch of
    columns would hold thousands, each line an object of its own.
    """
    return difference(old or [], new or [])


def summary(d: Column) -> Column:
    """Counts and the first structural words."""

    def some(name: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(name), F.array_join(F.slice(items, 1, 5), ", ")))

    return F.concat_ws("; ", F.format_string(COUNTS, d["n_added"], d["n_removed"]), some(MORE, d["structural_added"]), some(LESS, d["structural_removed"]))


#: The texts of hints without a model, what stands for an unknown concept and difficulty, and the operations that a hint names.
MACRO = "Soluția ta diferă de o variantă corectă pe aproximativ %d linii semnificative; concentrează-te pe ideea cheie a problemei (%s, dificultate %s)."
STRUCTURE, BRING_IN, DO_WITHOUT = "Ca să te apropii de soluția corectă, ", "introduce structuri: ", "renunță la structuri: "
WHERE, WHERE_END = "Verifică zona în care apar operațiile cu ", "; acolo este localizată cea mai consistentă diferență."
MISSING = "Verifică partea finală a logicii principale: există un bloc consistent care lipsește din varianta ta."
CONCEPT, DIFFICULTY = "concept central", "medium"
OPERATIONS = "for while if else swap sort vector queue stack set map memset fill push pop insert".split()


def template_hints(d: Column, concept: Column, difficulty: Column) -> Column:
    """Hints that need no model: the size of the change, its structure, and the operations of its longest added block."""
    macro = F.format_string(MACRO, d["n_added"] + d["n_removed"], F.coalesce(concept, F.lit(CONCEPT)), F.coalesce(difficulty, F.lit(DIFFICULTY)))

    def some(name: str, items: Column, k: int) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(name), F.array_join(F.slice(items, 1, k), ", ")))

    structure = F.concat_ws("; ", some(BRING_IN, d["structural_added"], 4), some(DO_WITHOUT, d["structural_removed"], 4))
    structural = F.when(structure != "", F.concat(F.lit(STRUCTURE), structure, F.lit(".")))
    most = F.array_max(F.transform(d["added_blocks"], F.size))
    longest = F.element_at(F.filter(d["added_blocks"], lambda x: F.size(x) == most), 1)
    words = F.flatten(F.transform(longest, lambda x: F.regexp_extract_all(x, F.lit(r"(?U)\b[a-zA-Z_][a-zA-Z0-9_]+\b"), F.lit(0))))
    named = F.slice(F.array_distinct(F.filter(words, lambda w: F.lower(w).isin(OPERATIONS))), 1, 3)
    where = F.when(F.size(named) > 0, F.concat(F.lit(WHERE), F.array_join(named, ", "), F.lit(WHERE_END))).otherwise(F.lit(MISSING))
    specific = F.when(F.size(d["added_blocks"]) > 0, where)
    kinds = F.array(*[F.when(t.isNotNull(), F.struct(F.lit(level).alias("level"), t.alias("text"))) for level, t in (("macro", macro), ("structural", structural), ("specific", specific))])
    return F.array_compact(kinds)


def template_row(d: Column, concept: Column, difficulty: Column, similarity: Column, **meta: Column) -> Column:
    """A hint set without a model: where it comes from (``meta``), its hints, and the fields that every set has."""
    none = F.array().cast("array<string>")
    fields = meta | {
        "verdict": F.lit("WA"),
        "issues": none,
        "concepts_targeted": F.when(F.coalesce(concept, F.lit("")) != "", F.array(concept)).otherwise(none),
        "hints": template_hints(d, concept, difficulty),
        "source": F.lit("silver_diff"),
        "validator_passed": F.lit(True),
        "validator_violations": none,
        "embedding_similarity": F.round(similarity, 4),
    }
    return F.struct(*[c.alias(k) for k, c in fields.items()])
