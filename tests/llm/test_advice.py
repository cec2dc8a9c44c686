"""What the review of round 1 found missing."""

import numpy as np

from claimlattice.llm.paragraphs import paragraph_spans, without_repeats
from claimlattice.llm.vectors import Lists, top_k

RNG = np.random.default_rng(11)


def words(n):
    return ["".join(chr(97 + c) for c in RNG.integers(0, 26, 6)) for _ in range(n)]


def test_op1_repeated_windows_go(spark):
    """Passages of over 50 words that an earlier text has, whatever the cutter makes of them."""
    shouted = "".join(w.upper() + "!! " for w in words(150)).strip()
    short = "\n".join(" ".join(words(8)) for _ in range(12))
    plain = " ".join(words(400))
    sentences = " ".join(" ".join(words(6)) + "." for _ in range(20))
    repeated = [shouted, short, plain, sentences]
    texts = repeated + repeated
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in without_repeats(spark, df).collect()}
    seen = set()
    for d in range(len(texts)):
        w = out[d].split()
        now = {tuple(w[i : i + 51]) for i in range(len(w) - 50)}
        assert not now & seen, d
        seen |= now
    assert [out[d] for d in range(4)] == repeated and not "".join(out[d] for d in range(4, 8)).strip()
    # Within a line of other words: between own sentences, or in the midst of unpunctuated words.
    own = lambda: " ".join(words(30)) + ". "
    inside = [(0, own() + sentences), (1, own() + sentences + " " + own()), (2, plain), (3, " ".join(words(150)) + " " + plain + " " + " ".join(words(150)))]
    n = {r["doc_id"]: r["words_removed"] for r in without_repeats(spark, spark.createDataFrame(inside, "doc_id long, text string")).collect()}
    assert n[0] == n[2] == 0 and n[1] >= 60 and n[3] >= 250


def test_op1_no_piece_of_a_line_is_too_short():
    for _ in range(50):
        line = " ".join(w + ("." if RNG.random() < 0.3 else "") for w in words(int(RNG.integers(20, 300))))
        text = ("few words\n" + line + "\nand few\nmore").encode()
        spans = paragraph_spans(text)
        assert [w for a, b in spans for w in text[a:b].split()] == text.split()
        assert all(len(text[a:b].split()) >= 20 for a, b in spans[1:])


def test_op1_size_is_that_of_the_set(spark):
    """A phrase said four times and twice: nearly the same set, far from the same number of shingles."""
    phrase = " ".join(words(18))
    rows = [(1, " ".join([phrase] * 2)), (2, " ".join([phrase] * 4)), (3, " ".join(words(60)))]
    out = without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] > 0 for r in out} == {1: False, 2: True, 3: False}


def best_five(ids, x, query):
    """The five best distinct (score, vec_id) for a query."""
    xi = np.floor(256 * x)
    s = xi @ xi[ids.index(query)]
    return sorted({(-int(v), i) for i, v in zip(ids, s) if i != query})[:5]


def test_op4_repeated_rows_cut_no_others(spark):
    """A row repeated ten times, and an id of several vectors, among the queries' ids too."""
    x = RNG.normal(size=(300, 8))
    ids = list(range(300))
    x[7] = 3 * x[0] / np.linalg.norm(x[0]) * np.linalg.norm(x, axis=1).max()
    ids += [7] * 10 + [0] * 8 + [9] * 8
    x = np.vstack([x, np.repeat(x[7:8], 10, 0), x[0] * np.linspace(2, 3, 8)[:, None], x[7] * np.linspace(0.5, 0.9, 8)[:, None]])
    got = Lists(np.array(ids), np.floor(256 * x)).best(0, np.floor(256 * x[0]), 5)
    assert sorted((-s, v) for s, v in got) == best_five(ids, x, 0)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids[:310], x[:310])], "vec_id long, embedding array<double>").coalesce(1)
    rows = sorted((r["rank"], -r["score"], r["vec_id"]) for r in top_k(spark, df).collect() if r["query_id"] == 0)
    assert [r[1:] for r in rows] == best_five(ids[:310], x[:310], 0)


def test_op4_reads_lists_and_resolves_few(sf):
    """On sf0.1 nearly all of the lists are read (64 dimensions prune late), but few rows are resolved."""
    import duckdb

    rows = duckdb.connect().execute("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float))
    lists, queries = Lists(ids, x), np.flatnonzero(ids % 50 == 0)
    for i in queries:
        assert sorted((-s, v) for s, v in lists.best(ids[i], x[i], 5)) == [(s, v) for s, v in best_five(list(ids), x / 256, ids[i])]
    assert lists.resolved <= 64 * len(queries) < 0.05 * len(queries) * len(ids)
    together = Lists(ids, x).best_of(ids[queries], x[queries], 5)
    assert together == [lists.best(ids[i], x[i], 5) for i in queries]
    # Vectors with clear neighbours need less than the whole lists, and what is unread is not touched.
    near = x[:1] + RNG.normal(size=(6, 64))
    few = Lists(np.arange(2006), np.floor(np.vstack([x, near])))
    want = few.best(0, x[0], 5)
    assert few.read < 0.9 * few.values.size
    again = Lists(np.arange(2006), np.floor(np.vstack([x, near])))
    depth = few.depths[-1][3]
    assert depth < 2006 / 2
    # Between the fronts (and but for the far ends, which bound) nothing may count.
    for j in range(64):
        again.sorted[j, depth : 2006 - depth] = np.nan
    assert again.best(0, x[0], 5) == want and again.read == few.read


def test_op4_large_components(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [1e3, -1.0]), (3, [1e18, 0.0]), (50, [-1e12, 5.0])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).collect()}
    f = [[int(np.floor(256 * v)) for v in x] for _, x in rows]
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(f[a], f[b]))))
    assert [got[0, r] for r in (1, 2, 3, 4)] == [(3, dot(0, 3)), (1, dot(0, 1)), (2, dot(0, 2)), (50, dot(0, 4))]
