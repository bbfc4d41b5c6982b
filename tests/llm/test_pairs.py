"""Operators 1, 3 and 9 beside brute force."""

import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradewell.llm import embeddings, exact_dedup, minhash
from gradewell.llm.components import components
from gradewell.llm.shared import Scratch

from .data import ODD, edited, frame, prose


def joined(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x] = low
                    changed = True
    return label


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 180)] + [(1, k) for k in range(2, 60)] + [(300, 299), (299, 300), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    want = joined({x for p in links for x in p}, links)
    assert got == want


def test_components_of_paths_whose_least_id_is_far(spark):
    ids = random.Random(1).sample(range(1000, 2000), 400)
    links = [(k, k + 1) for k in range(10, 160)] + [(160, 1)] + list(zip(ids, ids[1:], strict=False))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == joined({x for p in links for x in p}, links)
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").isEmpty()


# --- vectors


def vector_rows():
    r = np.random.default_rng(3)
    rows = [(k, r.standard_normal(16).tolist()) for k in range(60)]
    for k in range(60, 110):  # near copies at all distances, chains among them
        base = np.array(rows[k - 60 if k < 80 else k - 1][1])
        rows.append((k, (base + r.standard_normal(16) * r.choice([0.05, 0.2, 0.3, 0.35])).tolist()))
    rows += [(200 + k, rows[0][1]) for k in range(5)] + [(210, [2 * x for x in rows[1][1]]), (211, rows[2][1]), (211, rows[2][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [math.nan] * 16), (304, [math.inf] + [1.0] * 15), (305, [None] + [1.0] * 15), (306, [1.0] * 8), (307, [1.0] * 8), (None, rows[0][1])]
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize(("block_rows", "exact_rows"), [(embeddings.BLOCK_ROWS, embeddings.EXACT_ROWS), (7, embeddings.EXACT_ROWS), (7, 0)])
def test_vectors_by_brute_force(spark, kind, block_rows, exact_rows):
    rows = vector_rows()
    got = embeddings.near_duplicates(spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, doc int, weight string"), block_rows=block_rows, exact_rows=exact_rows).collect()
    assert len(got) == len(rows)
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v:
            x = np.array(v, dtype="f4" if kind == "float" else "f8").astype("f8")
            if np.isfinite(x).all() and x.any():
                good[i] = x / np.linalg.norm(x)
    links = [(a, b) for a, b in combinations(sorted(good), 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95]
    label = joined([i for i, _ in rows if i is not None], links)
    for r in got:
        if r["vec_id"] is None:
            assert tuple(r) == (None, 0, None, False)
            continue
        n = sum(r["vec_id"] in p for p in links)
        assert tuple(r) == (r["vec_id"], n, label[r["vec_id"]], label[r["vec_id"]] == r["vec_id"])


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).isEmpty()


def test_quantised_links_are_exact():
    r = np.random.default_rng(1)
    a = r.standard_normal((300, 32))
    b = a + r.standard_normal((300, 32)) * 0.33  # cosines around the threshold
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    found, again = embeddings.links(a, b, 0.95)
    assert (found == (a @ b.T >= 0.95)).all()
    assert 0 < again < 600  # few pairs need full precision
    dense = a[:1] + r.standard_normal((200, 32)) * 0.015  # a group in which nearly all are linked
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    found, again = embeddings.links(dense, dense, 0.95)
    assert (found == (dense @ dense.T >= 0.95)).all() and found.mean() > 0.9 and again < found.size / 4
    q, step, size, error = embeddings.quantise(a)
    assert q.dtype == np.int8 and np.allclose(np.linalg.norm(a - q * step[:, None], axis=1), error)


@pytest.mark.parametrize("d", [64, 200, 1024, 3000])
def test_bounds_hold_at_any_dimension(d):
    """Pairs as near the threshold as doubles allow, with many large terms that cancel: every answer is the double's."""
    r = np.random.default_rng(d)
    a = r.standard_normal((300, d)) * np.where(r.random(d) < 0.5, 1.0, 1e-2)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = r.standard_normal((300, d))
    off -= (off * a).sum(axis=1, keepdims=True) * a
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = 0.95 + np.repeat([-1e-5, -1e-6, -1e-7, 1e-7, 1e-6, 1e-5], 50)
    b = cosine[:, None] * a + np.sqrt(1 - cosine**2)[:, None] * off
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    found, _ = embeddings.links(a, b, 0.95)
    assert (np.diag(found) == (np.einsum("ij,ij->i", a, b) >= 0.95)).all()
    (qa, sa, na, _), (qb, sb, nb, _) = embeddings.quantise(a), embeddings.quantise(b)
    single = (qa.astype(np.float32) @ (qb * sb[:, None]).astype(np.float32).T) * sa[:, None]
    exact = (qa.astype(np.float64) * sa[:, None]) @ (qb * sb[:, None]).T
    assert np.abs(single - exact).max() <= embeddings.slack(na, nb, d)


def test_forests_span_the_links():
    r = np.random.default_rng(5)
    found = r.random((40, 30)) < 0.03
    edges = embeddings.crossing(found)
    assert all(found[x, y] for x, y in edges)
    ids = [("r", k) for k in range(40)] + [("c", k) for k in range(30)]
    order = {x: k for k, x in enumerate(ids)}
    label = lambda pairs: joined(range(70), [(order["r", x], order["c", y]) for x, y in pairs])
    whole = label(zip(*np.nonzero(found), strict=True))
    assert label(edges) == whole and len(edges) == 70 - len(set(whole.values()))
    rows, columns = r.integers(1, 9, 40), r.integers(1, 9, 30)
    assert [x.tolist() for x in embeddings._sums(found, rows, columns)] == [(found @ columns).tolist(), (rows @ found).tolist()]


def test_recall_beyond_the_exact_size(spark):
    """Tables of buckets against all pairs."""
    r = np.random.default_rng(9)
    base = r.standard_normal((400, 32))
    rows = [(k, (base[k % 400] + r.standard_normal(32) * 0.2 * (k // 400)).tolist()) for k in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    every = {x["vec_id"]: x["n_links"] for x in embeddings.near_duplicates(df).collect()}
    some = {x["vec_id"]: x["n_links"] for x in embeddings.near_duplicates(df, exact_rows=0).collect()}
    assert all(some[k] <= n for k, n in every.items()) and sum(some.values()) >= 0.99 * sum(every.values()) > 0


@pytest.mark.parametrize("cut", [{}, {"block_rows": 50}])
def test_no_link_is_missed_at_any_size(spark, monkeypatch, cut):
    """Beyond the size from which buckets were taken, and however blocks are cut: many pairs just above the threshold."""
    of = embeddings.tables_and_bits
    monkeypatch.setattr(embeddings, "tables_and_bits", lambda rows, *more: of(rows + 1_000_000, *more))
    monkeypatch.setattr(embeddings, "MISS", 0.5)
    r = np.random.default_rng(12)
    u = r.standard_normal((300, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = r.standard_normal((300, 32))
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    rows = [(k, x.tolist()) for k, x in enumerate(np.concatenate([u, 0.951 * u + math.sqrt(1 - 0.951**2) * w]))]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **cut).collect()
    assert {(x["vec_id"], x["n_links"], x["component_id"]) for x in found} == {(k, 1, k % 300) for k in range(600)}


def test_recall_with_nine_hyperplanes(spark, monkeypatch):
    """The setting of a million rows: as many planes a table, and tables to match."""
    r = np.random.default_rng(10)
    base = r.standard_normal((60, 32))
    rows = [(k, (base[k % 60] + r.standard_normal(32) * 0.04 * (k // 60)).tolist()) for k in range(420)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    every = {x["vec_id"]: x["n_links"] for x in embeddings.near_duplicates(df).collect()}
    tables, bits = embeddings.tables_and_bits(1_000_000, 0.95)
    assert bits == 9
    monkeypatch.setattr(embeddings, "tables_and_bits", lambda *_: (tables, bits))
    some = {x["vec_id"]: x["n_links"] for x in embeddings.near_duplicates(df).collect()}
    assert all(some[k] <= n for k, n in every.items()) and sum(some.values()) >= 0.999 * sum(every.values()) > 0


def test_tables_reach_the_stated_miss():
    assert embeddings.tables_and_bits(1000, 0.95) == (1, 0)
    for rows in (10, 10_000, 10_000_000, 10**11):
        tables, bits = embeddings.tables_and_bits(rows, 0.95)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables <= embeddings.MISS


# --- near-duplicate documents

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, width=3):
    w = WORD.findall((text or "").encode().translate(LOWER))
    if len(w) >= width:
        return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def near_rows():
    rows = list(ODD)
    for s in range(12):
        base = prose(s, 150)
        rows += [(100 + 10 * s + k, edited(base, k, k)) for k in range(8)]
    hot = prose(99, 200)
    rows += [(1000 + k, edited(hot, k, 1 + k % 6)) for k in range(60)] + [(2000 + k, hot.upper()) for k in range(20)]
    return rows


@pytest.mark.parametrize(("tile", "cluster"), [(minhash.TILE, minhash.CLUSTER), (9, 20), (9, 2)])
def test_near_documents_by_brute_force(spark, monkeypatch, tile, cluster):
    monkeypatch.setattr(minhash, "CLUSTER", cluster)
    rows = near_rows()
    got = minhash.near_duplicates(frame(spark, rows), tile=tile).collect()
    sets = {i: shingles(t) for i, t in rows if i is not None}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    label = joined(sets, links)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) == (None, False)
        else:
            assert tuple(r) == (r["doc_id"], len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])


def test_texts_that_share_a_passage_move_at_most_three_times(spark, monkeypatch):
    """Candidates that aren't links: 200 of 224 words are shared, a similarity below the threshold."""
    shared = prose(77, 200)
    rows = [(k, f"{prose(10_000 + k, 12)} {shared} {prose(20_000 + k, 12)}") for k in range(500)] + [(9000, prose(30_000, 224))]
    moved = []

    def counted(roles, docs, width, own=minhash.with_sets):
        moved.append(roles.groupBy("doc").count().agg(F.max("count")).first()[0] or 0)
        return own(roles, docs, width)

    monkeypatch.setattr(minhash, "with_sets", counted)
    got = minhash.near_duplicates(frame(spark, rows), tile=100).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)
    first, second = moved
    assert 0 < second <= 1 and first + second <= 3  # a leader's copies are those of its groups of members


def test_one_of_each_group_stays(spark):
    rows = [(5, prose(1, 80)), (3, edited(prose(1, 80), 1, 1)), (9, prose(2, 80)), (9, prose(2, 80)), (11, ""), (12, None)]
    docs = frame(spark, rows)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 9, 11, 12]


def test_rows_without_an_id_and_texts_that_share_one_stay(spark):
    rows = [(None, "one two"), (None, None), (9, prose(1, 80)), (9, prose(2, 80)), (9, prose(2, 80)), (9, None), (3, prose(3, 80)), (4, edited(prose(3, 80), 1, 1))]
    kept = minhash.keep_one(frame(spark, rows))
    want = [(None, "one two"), (None, None), (9, prose(1, 80)), (9, prose(2, 80)), (9, None), (3, prose(3, 80))]
    order = lambda r: (r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=order) == sorted(want, key=order)


def test_recall_of_the_pipelines_setting(spark):
    """Pairs on both sides of 0.8 on five-word shingles: every link is found, no other."""
    rows = []
    for s in range(120):
        base = prose(5000 + s, 100)
        rows += [(10 * s, base), (10 * s + 1, edited(base, s, 1 + s % 4))]
    sets = {i: shingles(t, 5) for i, t in rows}
    links = [(10 * s, 10 * s + 1) for s in range(120) if 100 * len(sets[10 * s] & sets[10 * s + 1]) >= 80 * len(sets[10 * s] | sets[10 * s + 1])]
    assert 20 < len(links) < 110
    label = joined(sets, links)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows), 5, 80).collect()}
    assert got == label


def test_bands_reach_the_stated_miss():
    for percent in (50, 70, 80, 85, 95, 100):
        bands, rows = minhash.bands_and_rows(percent / 100)
        assert bands * rows <= minhash.MINIMA and (1 - (percent / 100) ** rows) ** bands <= 5e-5
    assert minhash.bands_and_rows(0.85) == (21, 6) and minhash.bands_and_rows(0.8) == (25, 5)


def test_no_documents_to_compare(spark):
    assert minhash.near_duplicates(frame(spark, [])).isEmpty()
    assert minhash.near_duplicates(frame(spark, [(1, None)])).first()["component_id"] == 1


def test_estimate_follows_similarity():
    base = prose(7, 3000)
    for changes in (0, 50, 200, 800):
        a, b = minhash.shingle_sets([base, edited(base, 1, changes)], 3)
        pa, pb = (minhash.signature(minhash.minima(x))[0].view(np.uint64) for x in (a, b))
        differ = np.zeros(2, dtype=np.uint64)
        for k in range(minhash.BITS):
            differ |= pa[2 * k : 2 * k + 2] ^ pb[2 * k : 2 * k + 2]
        m = int(np.bitwise_count(differ).sum())
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        estimate = (1 - m / minhash.MINIMA - 1 / 16) / (1 - 1 / 16)
        assert abs(estimate - true) < 0.16


# --- equal documents


@pytest.mark.parametrize("bucket_bytes", [exact_dedup.BUCKET_BYTES, 400])
def test_equal_documents_by_brute_force(spark, bucket_bytes):
    rows = [*ODD, (50, "one"), (40, "One"), *((k, "copy") for k in range(100, 160)), *((k, prose(k, 20)) for k in range(200, 240))]
    got = exact_dedup.dedup(frame(spark, rows), bucket_bytes=bucket_bytes, max_depth=8).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    order = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_one_row_of_each_text_stays(spark):
    docs = frame(spark, [*ODD, (50, "one"), (6, "one two")])
    kept = exact_dedup.keep_rows(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in ODD})
    assert exact_dedup.keep_rows(frame(spark, [])).isEmpty() and exact_dedup.dedup(frame(spark, [])).isEmpty()


def test_colliding_keys_are_told_apart_by_bytes():
    rows = pd.DataFrame({"bucket": 0, "key": [5, 5, 5, 6], "text": [b"a", b"b", b"a", b"a"], "keep_id": pd.array([1, 2, 9, None], dtype="Int64"), "copies": [1, 2, 3, 4]})
    out = pd.concat(exact_dedup.chain_entries(iter([rows.iloc[:2], rows.iloc[2:]])))
    assert out[["key", "chain", "group_size"]].to_numpy().tolist() == [[5, 0, 4], [5, 1, 2], [6, 0, 4]]
    assert out["keep_id"].tolist()[:2] == [9, 2] and pd.isna(out["keep_id"].iat[2])


def test_directory_doubles_only_where_it_must():
    d = exact_dedup.Directory({0: 100, 1: 100, 15: 10}, max_depth=4, bucket_bytes=120)
    assert d.depth == 4 and len(d.slots) == 16
    assert len({int(d.slots[0]), int(d.slots[1])}) == 2 and d.slots[8] == d.slots[15]
    keys = np.array([0, 1 << 60, -1], dtype=np.int64)
    assert d.bucket_of(keys).tolist() == [d.slots[0], d.slots[1], d.slots[15]]
    full = exact_dedup.Directory({3: 10_000}, max_depth=4, bucket_bytes=120)  # one key's bytes can't be split
    assert full.depth == 4
    assert (np.diff(d.owners) >= 0).all()
    empty = exact_dedup.Directory({}, max_depth=4)
    assert empty.depth == 0 and empty.bucket_of(keys).tolist() == [0, 0, 0]
