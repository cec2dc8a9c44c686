"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimlattice.llm.common import Workspace, components
from claimlattice.llm.language import identify, learn
from claimlattice.llm.mixing import mix
from claimlattice.llm.packing import best_fit, pack
from claimlattice.llm.paragraphs import without_repeats
from claimlattice.llm.quality import classify
from claimlattice.llm.set_join import similar_sets
from claimlattice.llm.suffix_dedup import repeated_substrings
from claimlattice.llm.url_filter import filter_urls, rules_frame
from claimlattice.llm.vectors import near_vectors, top_k

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(9)
PASSAGE = " ".join("".join(chr(97 + c) for c in RNG.integers(0, 26, 6)) for _ in range(60))
LONG = " ".join("".join(chr(97 + c) for c in RNG.integers(0, 26, 5)) for _ in range(250_000))


def docs(spark, rows=None):
    rows = rows if rows is not None else [
        (1, PASSAGE, "en", "a", 9), (1, PASSAGE, "en", "a", 9), (2, "own words here\n" + PASSAGE, None, "a", None), (3, None, "en", None, 0), (4, "", "de", "b", 0),
        (5, " \n\t ", "de", None, 3), (6, LONG, "en", "b", 1), (7, LONG, "en", "c", 1), (None, "nobody's text", None, None, None), (8, "x", "fr", "b", 1), (9, "x", "fr", "b", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2)]
    rows = components(Workspace(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in rows} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_paragraphs(spark):
    out = {(r["doc_id"], r["n_removed"], r["text"]) for r in without_repeats(spark, docs(spark).withColumn("removed", F.lit("clash"))).collect()}
    assert (1, 0, PASSAGE) in out and (2, 1, "own words here\n") in out and (3, 0, None) in out and (4, 0, "") in out and (6, 0, LONG) in out
    assert [r for r in out if r[0] == 7][0][1] > 0 and (None, 0, "nobody's text") in out
    assert without_repeats(spark, docs(spark, [])).count() == 0


def test_set_join(spark):
    rows = got(similar_sets(spark, docs(spark).withColumn("node", F.lit(1))), "doc_id", "component_id")
    assert rows == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6), (None, None), (8, 8), (9, 8)], key=str)
    assert similar_sets(spark, docs(spark, [])).count() == 0


def test_set_join_chains_over_long_lists(spark):
    """Each text differs from the next in few words, so only chains link the ends."""
    words = PASSAGE.split() * 2
    rows = []
    for i in range(40):
        w = list(words)
        w[:i] = [f"z{i}q{j}" if j % 9 == 0 else x for j, x in enumerate(w[:i])]
        rows.append((i, " ".join(w), "en", "s", 1))
    sets = {}
    for i, t, *_ in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)}
    parent = list(range(40))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in range(40):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert dict(got(similar_sets(spark, docs(spark, rows)), "doc_id", "component_id")) == {i: find(i) for i in range(40)}


def test_quality_without_both_classes(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = classify(spark, docs(spark), labels).collect()
    assert len(rows) == 11 and all(r["keep"] and r["score"] is None for r in rows)


def test_quality_on_odd_rows(spark):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in (1, 2, 3, 4, 6, 7, 8, 9)], "doc_id long, quality int, toxic int")
    rows = classify(spark, docs(spark).withColumn("score", F.lit("clash")), labels).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert classify(spark, docs(spark, []), labels).count() == 0


def test_top_k(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (50, [-1.0, float("inf")]), (6, [0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    assert got(top_k(spark, df), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 256 * 256 + 128 * 128), (0, 2, 6, 0)]
    assert top_k(spark, df.limit(0)).count() == 0


def test_near_vectors(spark):
    rows = [(3, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [2.0, 1.0]), (2, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [0.0, 0.0]), (7, [-1.0, 0.3]), (None, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("links", F.lit("clash"))
    want = [(3, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (None, 0, None, False)]
    assert got(near_vectors(spark, df), "vec_id", "n_links", "component_id", "kept") == sorted(want, key=str)
    assert near_vectors(spark, df.limit(0)).count() == 0


def test_best_fit():
    bins, offsets, lengths, fill = best_fit([5, 3, 4, 2, 2, 8], [4, 8], 1)
    assert sum(fill) == 24 and all(f <= n for f, n in zip(fill, lengths)) and sorted(lengths) == [8, 8, 8]
    assert best_fit([], [4, 8], 1) == ([], [], [], [])


def test_packing(spark):
    rows = pack(spark, docs(spark).withColumn("bin_id", F.lit("clash")), lengths=(1000, 4000)).toPandas()
    assert rows.n_tokens.sum() == 60 + 60 + 63 + 2 * 250_000 + 2 + 1 + 1 and rows[rows.n_tokens == 0].bin_id.isna().all()
    assert pack(spark, docs(spark, [])).count() == 0


def test_substrings(spark):
    rows = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in repeated_substrings(spark, docs(spark).withColumn("removed", F.lit("clash"))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    n = len(PASSAGE)
    assert (1, n, 0, sha(PASSAGE)) in rows and (2, n + 15, n, sha("own words here\n")) in rows and (3, 0, 0, sha("")) in rows
    assert (6, len(LONG), 0, sha(LONG)) in rows and (7, len(LONG), len(LONG), sha("")) in rows
    assert repeated_substrings(spark, docs(spark, [])).count() == 0


@pytest.mark.parametrize("unit", ["a", "ab", "abc "])
def test_substrings_of_runs(spark, unit):
    """Within a periodic text every window but the first of each phase is a repeat."""
    text = unit * 200
    r = repeated_substrings(spark, docs(spark, [(1, text, "", "", 1)])).first()
    gone = np.zeros(len(text), bool)
    seen = set()
    for i in range(len(text) - 99):
        if text[i : i + 100] in seen:
            gone[i : i + 100] = True
        seen.add(text[i : i + 100])
    assert r["n_removed"] == gone.sum()


def test_language(spark):
    d = learn(docs(spark))
    assert set(d) == {"en", "de", "fr"} and max(map(len, d.values())) <= 1 << 16
    rows = {r["doc_id"]: r for r in identify(docs(spark).withColumn("score", F.lit("clash")), d).collect()}
    assert rows[3]["lang_pred"] == rows[4]["lang_pred"] == rows[5]["lang_pred"] == "und" and rows[1]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in identify(docs(spark), {}).collect()} == {"und"}
    assert learn(docs(spark, [])) == {} and identify(docs(spark, []), d).count() == 0


def test_mixing(spark):
    rows = mix(spark, docs(spark).withColumn("taken", F.lit("clash"))).collect()
    assert len(rows) == 11
    by = {r["source"]: r for r in rows}
    assert by[None]["source_size"] == 2 and by["a"]["source_size"] == 183
    assert all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in rows)
    assert mix(spark, docs(spark, [])).count() == 0
    empty = docs(spark, [(1, None, "", "a", 0), (2, "", "", None, 0)])
    assert got(mix(spark, empty), "doc_id", "target", "taken") == [(1, 0.0, 0), (2, 0.0, 0)]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "https://a.b.example.com/en/", "ftp://notexample.com/en/", "x://net/es/1", "x://net/es", "x://sub.net/fr/#a", "a://b.com", "http://example.com/en/?u=x://y.net/fr/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(4, urls[4])], "page_id int, url string").withColumn("verdict", F.lit("clash"))
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(spark, pages, rules_frame(spark)).collect()}
    assert rows[0] == rows[1] == rows[2] == rows[3] == ("", "", None, "allow")
    assert rows[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and rows[5] == ("a.b.example.com", "/en/", "example.com/en/", "block")
    assert rows[6] == ("notexample.com", "/en/", "com/", "allow") and rows[7] == ("net", "/es/1", "net/es/", "block") and rows[8] == ("net", "/es", None, "allow")
    assert rows[9] == ("sub.net", "/fr/", "net/fr/", "block") and rows[10] == ("b.com", "", None, "allow") and rows[11][2] == "example.com/en/"
    assert filter_urls(spark, pages, rules_frame(spark)).count() == 13
    assert filter_urls(spark, pages.limit(0), rules_frame(spark)).count() == 0
    assert {r["verdict"] for r in filter_urls(spark, pages, rules_frame(spark).limit(0), default="block").collect()} == {"block"}


def test_urls_with_nested_rules(spark):
    rules = [("allow", "x.org", "/"), ("block", "x.org", "/a"), ("allow", "x.org", "/a/b"), ("block", "org", "/a/b/c/d/e"), ("allow", "x.org", "/a"), ("block", "x.org", "/ab")]
    urls = ["h://x.org/", "h://x.org/a", "h://y.x.org/a/b/c", "h://x.org/a/b/c/d/e/f", "h://x.org/ab", "h://x.org/b", "h://org/a/b/c/d/e"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    got = [r["rule"] + r["verdict"] for r in filter_urls(spark, pages, rules_frame(spark, rules)).orderBy("page_id").collect()]
    assert got == ["x.org/allow", "x.org/ablock", "x.org/a/ballow", "org/a/b/c/d/eblock", "x.org/abblock", "x.org/allow", "org/a/b/c/d/eblock"]


def test_pipeline_stages_on_odd_rows(spark, sf, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    frame = docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        if name != "best-fit packing":
            assert frame.columns == corpus_pipeline.COLUMNS, name
    rows = frame.toPandas()
    assert len(rows) and rows.bin_id.isna().sum() == (rows.n_tokens == 0).sum()
    frame = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
    assert frame.count() == 0


def test_quality_stage_scores_odd_rows(spark, tmp_path):
    """With labels of both classes the first stage judges null, empty, long and repeated rows, clashing columns or not."""
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in (1, 2, 3, 4, 6, 7, 8, 9)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    frame = docs(spark).withColumns({c: F.lit("clash") for c in ("keep", "score", "text_score", "meta_score", "removed", "cuts", "node")})
    for _, stage in corpus_pipeline.STAGES[:3]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == corpus_pipeline.COLUMNS
    kept = frame.collect()
    scored = {(r["doc_id"], r["text"]): r["keep"] for r in classify(spark, docs(spark), labels).collect()}
    assert len({k for k in scored if scored[k]}) >= len(kept) > 0
    assert all(any(d == r["doc_id"] and keep for (d, _), keep in scored.items()) for r in kept)


def test_clashing_columns_are_replaced(spark):
    odd = docs(spark).withColumns({c: F.lit("clash") for c in ("lang_pred", "rejected", "held_out", "size", "source_size", "target", "rate", "copies", "cuts", "words_removed", "node", "n_shingles")})
    assert identify(odd, learn(docs(spark))).select("lang_pred").distinct().filter("lang_pred = 'clash'").count() == 0
    mixed = mix(spark, odd)
    assert dict(mixed.dtypes)["size"] == "bigint" and mixed.filter("held_out = 'clash'").count() == 11
    cut = without_repeats(spark, odd)
    assert dict(cut.dtypes)["words_removed"] == "bigint" and cut.count() == 11
    assert similar_sets(spark, odd).count() == 11


def test_quality_with_unspaced_labelled_text(spark):
    """A megabyte without a space, of letters or of marks, leaves all scores finite and the good rows in."""
    rows = [(i, " ".join(f"word{j} of" for j in range(i, i + 40)) + "." if i % 2 else "!!! $$$ " * 30, "en", "a", 9) for i in range(60)]
    rows += [(60, "x" * 1_000_000, "en", "a", 1), (61, "!.," * 300_000, "en", "a", 1)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] + [(60, 1, 0), (61, 0, 0)], "doc_id long, quality int, toxic int")
    scored = {r["doc_id"]: r for r in classify(spark, docs(spark, rows), labels).collect()}
    assert all(np.isfinite([r["text_score"], r["meta_score"], r["score"]]).all() for r in scored.values())
    assert [scored[i]["keep"] for i in range(50, 60)] == [bool(i % 2) for i in range(50, 60)]


def test_url_behind_the_last_character(spark):
    pages = spark.createDataFrame([(1, "http://net/es/\U0010ffffx"), (2, "http://net/et/"), (3, "http://a.net/es/")], "page_id long, url string")
    assert got(filter_urls(spark, pages, rules_frame(spark)), "page_id", "rule") == [(1, "net/es/"), (2, None), (3, "net/es/")]
