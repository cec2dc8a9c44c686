"""Operators against brute force over sf0.001."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from claimlattice.llm import queries as q
from claimlattice.llm.common import table
from claimlattice.llm.paragraphs import paragraph_spans
from claimlattice.llm.packing import pack
from claimlattice.llm.vectors import near_vectors, top_k

from ..conftest import SF


@pytest.fixture(scope="module")
def docs():
    rows = duckdb.connect().execute(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    return {r[0]: r[1:] for r in rows}


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar(sets, percent):
    index, both = collections.defaultdict(list), collections.Counter()
    for n, s in sets.items():
        for t in s:
            index[t].append(n)
    for ns in index.values():
        both.update((ns[j], ns[i]) for i in range(len(ns)) for j in range(i))
    return [p for p, c in both.items() if 100 * c >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - c)]


def shingle_set(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_op1(spark, sf, docs):
    first, places = {}, []
    for d, (text, *_) in docs.items():
        raw = text.encode()
        for j, (a, b) in enumerate(paragraph_spans(raw)):
            words = tuple(raw[a:b].lower().split())
            if len(words) >= 20:
                places.append((d, j, words))
                first.setdefault(words, (d, j))
    by_place = {p: w for w, p in first.items()}
    sets = {p: {w[i : i + 5] for i in range(len(w) - 4)} for p, w in by_place.items()}
    root = components(by_place, similar(sets, 80))
    gone = collections.defaultdict(list)
    for d, j, words in places:
        if root[first[words]] != (d, j):
            gone[d].append(j)
    got = {r["doc_id"]: r["removed"] for r in q.op1_paragraphs(spark, sf).collect()}
    assert got == {d: gone.get(d, []) for d in docs}


def test_op2(spark, sf, docs):
    sets = {d: shingle_set(t[0], 4) for d, t in docs.items()}
    root = components(sets, similar(sets, 85))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in q.op2_set_join(spark, sf).collect()}
    assert got == {d: (len(s), root[d]) for d, s in sets.items()}


def test_op3_held_out(spark, sf):
    labels = table(spark, sf, "labels")
    even = labels.filter("doc_id % 2 = 0")
    from claimlattice.llm.quality import classify

    scored = classify(spark, table(spark, sf, "documents"), even).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    assert ((scored.score >= 0.5) == (scored.quality == 1)).mean() >= 0.9
    assert scored[scored.quality == 1].keep.mean() >= 0.97


def test_op4(spark, sf):
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(int)
    want = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        want |= {(ids[i], n + 1): (ids[j], s[j]) for n, j in enumerate(order)}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in q.op4_top_k(spark, sf).collect()}
    assert got == want


def test_op5_round_trip(spark, sf, docs):
    rows = q.op5_packing(spark, sf).toPandas()
    sizes = rows.groupby("doc_id").n_tokens.sum().to_dict()
    assert sizes == {d: len((t[0] or "").encode().split()) for d, t in docs.items()}
    for _, p in rows[rows.n_tokens > 0].groupby("doc_id"):
        p = p.sort_values("begin")
        assert (p.begin.to_numpy() == np.concatenate(([0], np.cumsum(p.n_tokens)[:-1]))).all()
    for _, b in rows.dropna(subset=["bin_id"]).groupby("bin_id"):
        b = b.sort_values("offset")
        assert (b.offset.to_numpy() == np.concatenate(([0], np.cumsum(b.n_tokens)[:-1]))).all()
        assert b.n_tokens.sum() == b.bin_fill.iloc[0] <= b.bin_length.iloc[0]
        assert not any(n >= b.bin_fill.iloc[0] for n in (512, 1024, 2048, 4096) if n < b.bin_length.iloc[0])


def test_op5_is_dense(spark, sf):
    many = table(spark, sf, "documents").crossJoin(spark.range(20)).select("doc_id", "text")
    bins = pack(spark, many).dropna(subset=["bin_id"]).dropDuplicates(["bin_id"]).toPandas()
    assert bins.bin_fill.sum() / bins.bin_length.sum() > 0.97


def test_op6(spark, sf, docs):
    seen, want = set(), {}
    for d, (text, *_) in docs.items():
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        spans = int((gone[1:] < gone[:-1]).sum())
        want[d] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in q.op6_suffix_dedup(spark, sf).collect()}
    assert got == want


def test_op7_held_out(spark, sf, docs):
    rows = q.op7_language(spark, sf).toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(rows.doc_id, rows.held_out))
    held = rows[rows.held_out]
    assert np.mean([docs[d][1] == p for d, p in zip(held.doc_id, held.lang_pred)]) >= 0.9
    assert rows.score.between(0, 1).all()


def test_op8(spark, sf, docs):
    rows = q.op8_mixing(spark, sf).toPandas()
    rows["source"] = [docs[d][2] for d in rows.doc_id]
    assert (rows["size"] == [len(docs[d][0].encode().split()) for d in rows.doc_id]).all()
    assert (rows.taken <= 2 * rows["size"]).all() and (rows.taken % rows["size"].clip(lower=1) == 0).all()
    sizes = rows.groupby("source")["size"].sum()
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes.index, key=lambda s: [ord(c) for c in s]))}
    left, goal, free = 1.5 * sizes.sum(), {}, set(sizes.index)
    while free:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] > 2 * sizes[s]}
        if not full:
            goal |= {s: level * weights[s] for s in free}
            break
        goal |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    for s, g in rows.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(goal[s])
        assert abs(g.taken.sum() - goal[s]) <= g["size"].max()
    again = q.op8_mixing(spark, sf).toPandas()
    assert dict(zip(rows.doc_id, rows.taken)) == dict(zip(again.doc_id, again.taken))


def planted(spark, n=600, seed=3):
    """Random unit vectors, near copies of some, and equal ones."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 32))
    for i in range(n // 3, n):
        x[i] = x[rng.integers(0, n // 3)] + (rng.random() < 0.8) * rng.standard_normal(32) * rng.choice([0.05, 0.15, 0.22])
    x = x.astype(np.float32)
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def test_op9_recall_and_precision(spark):
    x, df = planted(spark)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    rows = near_vectors(spark, df).toPandas().set_index("vec_id").sort_index()
    n = near.sum(1)
    assert (rows.n_links.to_numpy() <= n).all() and rows.n_links.sum() >= 0.97 * n.sum() > 0
    root = components(range(len(x)), list(zip(*np.nonzero(near))))
    assert np.mean([root[i] == c for i, c in rows.component_id.items()]) > 0.98
    assert (rows.kept == (rows.component_id == rows.index)).all()


def test_op9_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    from claimlattice.llm import vectors

    monkeypatch.setattr(vectors, "BUCKET", 16)
    rng = np.random.default_rng(0)
    x = (np.ones((150, 8)) + rng.standard_normal((150, 8)) * 0.02).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    rows = near_vectors(spark, df).toPandas()
    assert (rows.n_links == 149).all() and (rows.component_id == 0).all()


def test_op4_with_ties_and_blocks(spark, monkeypatch):
    from claimlattice.llm import vectors

    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (300, 6)) / 256
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    xi = np.floor(256 * x.astype(np.float32).astype(float)).astype(int)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(spark, df).collect()}
    for i in range(0, 300, 50):
        s = xi @ xi[i]
        order = [j for j in np.lexsort((np.arange(300), -s)) if j != i][:5]
        assert [got[i, n + 1] for n in range(5)] == [(j, s[j]) for j in order]


def test_op10_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({q.OP10_SQL})").fetchall())
    assert sorted(tuple(r) for r in q.op10_url_filter(spark, sf).collect()) == want
