"""Operators 11, 12 and 13."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.llm import catalog, divergence, fingerprints, search
from gradewell.llm.terms import LETTERS, LETTERS_AND_DIGITS, term_lists

from .data import EXTRA, HAVE_TABLES, ODD, SF, edited, frame, prose

SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}, term string, value int, rank int, chunk int, item string, other int"
_EXTRA = (1, 2, 3, 4, "w", 5, 6, 7, "t", 1, 1, 1, "i", 1)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# --- terms


@pytest.mark.parametrize(("table", "pattern"), [(LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), (LETTERS_AND_DIGITS, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")])
def test_terms_are_the_matches(table, pattern):
    r = random.Random(4)
    letters = "aZ09_ \t\n\x00\x1c\x7f\x85\xa0éÉ中🙂'-@[`{~"
    for text in [t for _, t in ODD if t] + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(500)]:
        want = [m.encode() for m in re.findall(pattern, lower(text))]
        for piece in (7, 10**6):
            assert [t for terms in term_lists(text.encode(), table, piece) for t in terms] == want


# --- source divergence


def brute_divergence(rows, least=10):
    docs = [(lower(t or ""), g or "", s or "") for t, g, s in rows]
    terms = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t), g, s) for t, g, s in docs]
    out = []
    for lang in {g for _, g, _ in terms}:
        df = Counter(w for ws, g, _ in terms if g == lang for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= least)
        sources = sorted({s for _, g, s in terms if g == lang})
        counts = {s: Counter(w for ws, g, x in terms if (g, x) == (lang, s) for w in ws) for s in sources}

        def shares(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}

        p, q = {s: shares(counts[s]) for s in sources}, shares(sum(counts.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in sources if o != s]
            marks = [(w, f(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, top in (("pair", pairs, 10**9), ("term", marks, 10)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1)]
    return out


def divergence_rows():
    r = random.Random(9)
    rows = [(t, g, s) for k, (_, t) in enumerate(ODD * 4) for g, s in [(("en", None, "")[k % 3], ("a", "b", None)[k % 2])]]
    for k in range(240):
        lang, source = ("en", "en", "en", "zh", None)[k % 5], "abcdeé"[k % 6] if k % 7 else None
        words = [r.choice(["the", "The", "ünï", "中文", "zz", "a1b", f"w{'xyz'[k % 3]}", chr(97 + k % 6) * 2, chr(0xE000 + k % 4), "🙂"]) for _ in range(r.randint(0, 40))]
        rows.append((" ".join(words), lang, source))
    return [*rows, ("lonely words", "xx", "q"), ("", "yy", "q"), ("other words", "xx", "r")]


def divergence_frame(spark, rows):
    return spark.createDataFrame([(k % 50, t, g, s, 0, *_EXTRA) for k, (t, g, s) in enumerate(rows)], SCHEMA)


def test_divergence_is_the_brute_force(spark, monkeypatch):
    rows = divergence_rows()
    columns = ["lang", "source", "part", "item", "value", "rank"]
    want = sorted(brute_divergence(rows))
    for held, round_rows, partition in ((400_000, 200_000, 1_000_000), (20, 30, 40)):
        for name, value in (("HELD_TERMS", held), ("ROUND_ROWS", round_rows), ("PARTITION_ROWS", partition)):
            monkeypatch.setattr(divergence, name, value)
        got = divergence.source_divergence(divergence_frame(spark, rows))
        assert got.columns == columns
        assert sorted(map(tuple, got.collect())) == want
    assert any(x[2] == "pair" and x[4] == 0 for x in want) and any(x[0] == "" for x in want)


def test_divergence_chunks_and_ties():
    # in chunks of every width, the same sums and the same best terms
    r = random.Random(2)
    terms = sorted(f"t{k:03d}".encode() for k in range(60))
    flat = [(t, s, r.randint(1, 3), r.randint(1, 9)) for t in terms for s in "abc" if r.random() < 0.7]
    columns = [np.array([x[0] for x in flat], dtype=object), np.array([x[1] for x in flat], dtype=object), *(np.array([x[k] for x in flat], dtype=np.int64) for k in (2, 3))]
    found = []
    for cells in (3, 50, 10**6):
        chunks = list(divergence.dictionary_chunks("en", *columns, least=4, cells=cells))
        kept = sum(len(c[0]) for c in chunks)
        sums = Counter()
        for _, sources, own, _ in chunks:
            sums.update(dict(zip(sources, own, strict=True)))
        groups = [{"source": s, "n": sums[s]} for s in "abcd"]
        out = [x for k, c in enumerate(chunks) for x in divergence.compare_chunk({"lang": "en", "chunk": k, "terms": c[0], "sources": c[1], "counts": c[3], "groups": groups, "kept": kept}, 10, cells)]
        pairs = Counter()
        for _, a, b, _, _, _, v in (x for x in out if x[2]):
            pairs[a, b] += v
        best = {s: sorted((-x[6], x[3]) for x in out if x[1] == s and x[3])[:10] for s in "abcd"}
        found.append((kept, pairs, best))
    assert found[0] == found[1] == found[2] and not found[0][2]["d"]


def test_share_is_exact_for_large_counts():
    r = random.Random(3)
    for _ in range(300):
        total = r.randint(2, 9 * 10**15)
        count = r.randint(0, total - 2)
        assert divergence.share(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 2) // total


def test_no_documents_to_compare(spark):
    assert divergence.source_divergence(divergence_frame(spark, [])).isEmpty()


# --- ranked search


def brute_search(docs, items, top=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    found = [(d, Counter(cut(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n_docs, words = len(found), sum(c.total() for _, c in found)
    df = Counter(w for _, c in found for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(cut(t))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c in found:
            m = 10 + 90 * c.total() * n_docs // words
            scores.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms if c[w]), d))
        ranked = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:top]
        out += [(i, k, d, s) for k, (s, d) in enumerate(ranked, 1)]
    return out


def search_tables(spark, docs, items):
    return frame(spark, docs), spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, score string")


def searched():
    r = random.Random(6)
    words = [f"w{k}" for k in range(40)] + ["the", "of", "Été", "中文", "42"]
    docs = [*ODD, *((100 + k, " ".join(r.choices(words, [1] * 40 + [60, 40, 5, 5, 5], k=r.randint(1, 60)))) for k in range(400))]
    docs += [(900 + k, "the same text w1 w2") for k in range(30)] + [(7, "the w3")] * 3
    items = [(k, " ".join(r.choices(words, k=r.randint(1, 12)))) for k in range(30)]
    return docs, [*items, (3, "the w5 the"), (None, "w7"), (None, "THE w8"), (50, None), (51, ""), (52, "?!"), (53, "unknown"), (54, "one two ünï x é")]


def test_search_is_the_brute_force(spark):
    docs, items = searched()
    want = sorted(brute_search(docs, items), key=str)
    for shard_bytes, query_bytes in ((8_000_000, 2_000_000), (700, 150)):
        got = search.ranked_search(*search_tables(spark, docs, items), shard_bytes=shard_bytes, query_bytes=query_bytes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_maxscore_probes_less_and_finds_all():
    # a shard of 5,000 documents: what can't qualify is left out, the best are all there
    r = np.random.default_rng(1)
    postings = {}
    for t, n in enumerate((5000, 4000, 300, 40, 12)):
        at = np.sort(r.choice(5000, n, replace=False)).astype("<i4")
        adds = r.integers(1, 50 * (t + 1) ** 3, n)
        postings[t] = (at, adds, int(adds.max()))
    shard = search.Shard(list(range(5000)), postings)
    full = np.zeros(5000, dtype=np.int64)
    for at, adds, _ in postings.values():
        full[at] += adds
    order = np.lexsort((np.arange(5000), -full))[:10]
    for beat in (1, int(full[order[-1]]), int(full[order[4]])):
        places, scores = search.best_of_shard(shard, [0, 1, 2, 3, 4, 9], beat, 10)
        got = dict(zip(places.tolist(), scores.tolist(), strict=True))
        assert all(got[p] == full[p] for p in order.tolist() if full[p] >= beat) and all(full[p] == s for p, s in got.items())
        assert len(got) < 100


def test_nothing_to_search(spark):
    docs, items = searched()
    full_docs, full_items = search_tables(spark, docs, items)
    assert search.ranked_search(full_docs.limit(0), full_items).isEmpty()
    assert search.ranked_search(full_docs, full_items.limit(0)).isEmpty()
    assert search.ranked_search(search_tables(spark, [(1, None), (2, "?")], items)[0], full_items).isEmpty()


# --- fingerprints


def slow_print(text):
    """The walk a step at a time, and its samples."""
    read, i, j, written = fingerprints.classes(text).tolist(), 0, 0, []
    while i < len(read):
        written += [read[i]] * int(fingerprints.stays()[read[i], j])
        j = len(written) % fingerprints.PERIOD
        i += 1
    return len(written), fingerprints.sample(np.array(written, dtype=np.uint8))


def brute_report(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    out = []
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 3
        changed = t[: len(t) - k] + following[:k]
        prints = [slow_print(x) for x in (t, changed, following)]
        near = [fingerprints.likenesses(prints[:1], prints[i : i + 1])[0] for i in (1, 2)]
        out.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.fingerprint(*prints[0]), fingerprints.fingerprint(*prints[1]), *near))
    return out


def test_stays_are_the_shared_bits():
    table = fingerprints.stays()
    assert table.shape == (256, 4096) and table.min() == 1
    assert abs(table.mean() - 2) < 0.02  # a fair coin at each step
    # a walk that stays past a step stays as long as one that comes there
    go_on = table[:, :-1] > 1
    assert (table[:, :-1][go_on] - 1 == table[:, 1:][go_on]).all()


def test_report_is_the_brute_force(spark, monkeypatch):
    rows = [*ODD, (12, "abc"), (13, "abc"), (14, "ab"), *((20 + k, prose(k, 3 + 7 * k)) for k in range(60))]
    want = sorted(brute_report(rows), key=str)
    for partition_bytes, chars, narrow in ((32_000_000, 4_000_000, 48), (20_000, 3_000, 2)):
        monkeypatch.setattr(fingerprints, "BATCH_CHARS", chars)
        monkeypatch.setattr(fingerprints, "NARROW", narrow)
        monkeypatch.setattr(fingerprints, "PIECE_CHARS", chars)
        got = fingerprints.edited_report(frame(spark, rows), partition_bytes)
        assert got.columns == fingerprints.REPORT
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_report_of_few_documents(spark):
    assert fingerprints.edited_report(frame(spark, [])).isEmpty()
    (only,) = fingerprints.edited_report(frame(spark, [(1, "abcdef")])).collect()
    assert only["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and only["near_next"] == 1
    (null,) = fingerprints.edited_report(frame(spark, [(None, None)])).collect()
    assert tuple(null)[:2] == (None, 0) and null["near_edited"] == null["near_next"] == 1


def test_edits_are_near_and_others_far():
    texts = [prose(k, 20 + 10 * k) for k in range(100)]
    own = fingerprints.prints_of(texts)
    assert fingerprints.likenesses(own, own) == [1.0] * 100
    far = fingerprints.likenesses(own[:-1], own[1:])
    few = fingerprints.likenesses(own, fingerprints.prints_of([edited(t, k, 1) for k, t in enumerate(texts)]))
    assert max(far) < 0.4 and np.median(few) > 0.9
    report = fingerprints.edited_prints(texts, texts[1:] + texts[:1])
    assert all(e > n + 0.2 for *_, e, n in report)
    assert [fingerprints.parse(r[2]) for r in report] == own


def test_similar_documents(spark):
    r = random.Random(8)
    texts = []
    for k in range(60):
        t = prose(500 + k, 60 + 20 * k)
        texts += [t, edited(t, k, 1), t + " end"] if k % 3 == 0 else [t]
    rows = [*ODD, *enumerate(texts, 100), *((1000 + k, "of equal texts one stays") for k in range(40))]
    docs = frame(spark, rows).orderBy(F.rand(r.randint(1, 9)))
    want = brute_components(rows, 0.8)
    for tile in (fingerprints.TILE, 5):
        got = fingerprints.similar_documents(docs, tile=tile).collect()
        assert len(got) == len(rows)
        assert {(x["doc_id"], x["component_id"], x["kept"]) for x in got} == {(d, c, c is not None and c == d) for d, c in want}
        assert sum(c != d for d, c in want) > 50
    assert fingerprints.similar_documents(docs.limit(0)).isEmpty()


def brute_components(rows, least):
    prints = [fingerprints.prints_of([t or ""])[0] for _, t in rows]
    width = max(fingerprints.octaves(s) for s, _ in prints)
    every = fingerprints.Prints(prints, width)
    label = {d: d for d, _ in rows}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, (d, _) in enumerate(rows):
        near = every.likeness(np.full(len(rows), i), every, np.arange(len(rows)))
        for j in np.flatnonzero(near >= least).tolist():
            o = rows[j][0]
            if d is not None and o is not None and prints[i][0] and prints[j][0]:
                low, high = sorted((root(d), root(o)))
                label[high] = low
    return [(d, None if d is None else root(d)) for d, _ in rows]


@pytest.mark.skipif(not HAVE_TABLES, reason="needs the test tables")
def test_report_of_the_tables_beside_sql(spark):
    """What SQL can say of operator 11: the edited text's digest, and the order of documents."""
    import duckdb

    found = catalog.queries()["op11_edit_fingerprints"](spark, SF).toPandas().set_index("doc_id")
    want = duckdb.sql(f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM '{SF}/documents.parquet'),
        n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first(t) OVER (ORDER BY doc_id DESC)) AS f FROM d)
        SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 3) || left(f, length(t) // 3)) AS edited_sha256, t FROM n""").df().set_index("doc_id")
    assert len(found) == len(want) and (found[["n_chars", "edited_sha256"]] == want[["n_chars", "edited_sha256"]].loc[found.index]).all().all()
    assert (found["near_edited"] > found["near_next"]).mean() > 0.99
    assert found.groupby(want["t"].loc[found.index])["fingerprint"].nunique().max() == 1
    assert found["fingerprint"].nunique() == want["t"].nunique()


def test_registered():
    assert {"op11_edit_fingerprints", "op12_source_divergence", "op13_ranked_search"} <= set(catalog.queries())
