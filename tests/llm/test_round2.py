"""Bounds of samples, hot keys, planted passages, and small cases by hand."""

import itertools

import numpy as np
import pytest

from claimlattice.llm import language, quality, set_join
from claimlattice.llm.common import Workspace, table
from claimlattice.llm.hashing import word_hashes
from claimlattice.llm.language import identify, learn
from claimlattice.llm.packing import best_fit, cost
from claimlattice.llm.paragraphs import without_repeats
from claimlattice.llm.quality import classify, train
from claimlattice.llm.set_join import similar_sets
from claimlattice.llm.suffix_dedup import repeated_substrings
from claimlattice.llm.vectors import near_vectors

RNG = np.random.default_rng(21)


def words(n):
    return ["".join(chr(97 + c) for c in RNG.integers(0, 26, 5)) for _ in range(n)]


def test_op1_planted_passages_at_any_place(spark):
    """Passages of 51 to 90 words within lines of own words, no sentence ends, in two documents each."""
    rows, wanted = [], {}
    for i in range(60):
        passage = words(int(RNG.integers(51, 90)))
        for j in (0, 1):
            front, back = words(int(RNG.integers(30, 200))), words(int(RNG.integers(30, 200)))
            rows.append((2 * i + j, " ".join(front + passage + back)))
            wanted[2 * i + j] = front + back if j else front + passage + back
    out = {r["doc_id"]: r for r in without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[2 * i]["n_removed"] == 0 for i in range(60))
    assert np.mean([out[d]["text"].split() == wanted[d] for d in wanted if d % 2]) > 0.95


def test_op1_short_repeats_stay(spark):
    line = " ".join(words(12))
    rows = [(i, " ".join(words(60)) + " " + line + " " + " ".join(words(60))) for i in range(8)]
    assert {r["n_removed"] for r in without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_op2_hot_lists_and_far_members(spark, monkeypatch):
    """Lists that one task meets often; groups in which not all members link with the hub."""
    monkeypatch.setattr(set_join, "HOT", 6)
    monkeypatch.setattr(set_join, "STAR", 5)
    monkeypatch.setattr(set_join, "BLOCK", 8)
    base, rows = words(120), []
    for i in range(40):
        w = list(base)
        for j in RNG.choice(120, 4 if i < 25 else 9, replace=False):
            w[j] = f"z{i}q{j}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in rows}
    parent = list(range(40))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in itertools.combinations(range(40), 2):
        if 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["doc_id"]: r["component_id"] for r in similar_sets(spark, spark.createDataFrame(rows, "doc_id long, text string"), percent=70).collect()}
    assert got == {i: find(i) for i in range(40)} and len(set(got.values())) > 1


def test_op2_members_travel_once(spark, monkeypatch):
    """Near copies that all link with the hub: no text goes anywhere but to the hub."""
    base, rows = words(100), []
    for i in range(300):
        w = list(base)
        w[i % 100] = f"own{i}"
        rows.append((i, " ".join(w)))
    counted = {}
    save = Workspace.save

    def spy(self, df, name, *a, **k):
        out = save(self, df, name, *a, **k)
        if name in ("star-members", "block-members"):
            counted[name] = out.count()
        return out

    monkeypatch.setattr(Workspace, "save", spy)
    got = similar_sets(spark, spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    assert {r["component_id"] for r in got} == {0}
    assert counted["star-members"] <= 1.2 * 300 and "block-members" not in counted


def test_op3_scores_are_the_models(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = train(spark, docs, labels)
    rows = docs.toPandas()
    text = quality.text_features([t.encode() for t in rows.text])
    meta = quality.meta_features(quality.meta_slots(rows.lang, rows.source, rows.n_chars))
    odds = []
    for view, x in zip(model["views"], (text, meta)):
        z = [sum(min(8, max(-8, (v - m) / s)) * w for v, m, s, w in zip(row, view["mean"], view["scale"], view["w"])) + view["w"][-1] for row in x]
        odds.append(np.array(z) * view["line"][0] + view["line"][1])
    want = 1 / (1 + np.exp(-np.clip(odds[0] + odds[1] - model["base"], -30, 30)))
    got = classify(spark, docs, labels).toPandas().set_index("doc_id").score
    assert np.allclose(got[rows.doc_id].to_numpy(), want, atol=1e-9)


def test_op3_co_training_helps_the_weak_view(spark):
    """Bad rows come from one source, which few labels tell: the text view teaches it to the metadata view."""
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        text = " ".join(w.upper() + "!!" for w in words(30)) if bad else ". ".join(words(30))
        rows.append((i, text, "en", f"s{i % 7 if not bad else 9}", len(text)))
        if i < 90:
            labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = classify(spark, docs, known).toPandas()
    assert (out.keep == (out.doc_id % 3 != 0)).all()
    assert out.meta_score[out.doc_id % 3 != 0].min() > out.meta_score[out.doc_id % 3 == 0].max()


@pytest.fixture
def one_id(spark):
    """One doc_id in 20,000 rows, and 40 others."""
    many = spark.range(20_000).selectExpr("7L as doc_id", "concat('ein wort ', id % 3) as text", "'de' as lang", "'s' as source", "11L as n_chars")
    rest = spark.range(100, 140).selectExpr("id as doc_id", "concat('some words ', id) as text", "if(id % 2 = 0, 'en', 'de') as lang", "'s' as source", "id as n_chars")
    return many.union(rest)


def test_samples_are_bounded_by_rows_whatever_repeats(spark, one_id, monkeypatch):

    sizes = []
    cls = type(one_id)
    real = cls.collect
    monkeypatch.setattr(cls, "collect", lambda self: sizes.append(len(rows := real(self))) or rows)
    found = learn(one_id, per_language=30, size=1000)
    assert set(found) == {"de", "en"} and all(0 < len(x) <= 1000 for x in found.values()) and max(sizes) <= 60
    sizes.clear()
    labels = spark.createDataFrame([(7, 1, 0)] + [(i, i % 2, 0) for i in range(100, 140)], "doc_id long, quality int, toxic int")
    assert classify(spark, one_id, labels).count() == 20_040
    assert max(sizes) <= 41


def test_op7_is_the_smallest_by_a_plain_loop(spark, sf):
    import zstandard

    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    found = learn(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in identify(docs, found).collect()}
    for r in docs.filter("doc_id % 5 = 0").collect():
        data = language.normal(r["text"])
        sizes = {}
        for name in sorted(found):
            coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(found[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
            sizes[name] = sum(len(coder.compress(data[i : i + 4096])) for i in range(0, len(data), 4096))
        assert got[r["doc_id"]] == min(sizes, key=lambda n: (sizes[n], n))


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        for i in range(len(rest)):
            yield rest[:i] + [rest[i] + [items[0]]] + rest[i + 1 :]
        yield [[items[0]]] + rest


def test_op5_near_the_best_of_all_packings():
    lengths = (8, 16, 32)
    for _ in range(25):
        sizes = [int(x) for x in RNG.integers(1, 30, 6)]
        _, _, long, fill = best_fit(sizes, lengths, 2, 256)
        best = min(
            sum(cost(next(n for n in lengths if n >= sum(p)), 2, 256) for p in parts) for parts in partitions(sizes) if all(sum(p) <= 32 for p in parts)
        )
        assert sum(fill) == sum(sizes) and sum(cost(n, 2, 256) for n in long) <= 1.25 * best


def test_op5_uses_several_lengths(spark):
    sizes = [int(x) for x in RNG.integers(50, 3000, 800)]
    _, _, long, fill = best_fit(sizes, (512, 1024, 2048, 4096), 64)
    assert len(set(long)) >= 2 and sum(fill) / sum(long) > 0.97
    assert sum(map(cost, long)) < sum(map(cost, best_fit(sizes, (4096,), 64)[2]))


def test_op9_components_of_other_numbers_never_link(spark):
    rows = [(i, [1.0, 0.01 * i]) for i in range(20)] + [(100 + i, [1.0, 0.01 * i, 0.0]) for i in range(5)]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(out[i] == (19, 0) for i in range(20)) and all(out[100 + i] == (4, 100) for i in range(5))


def test_fingerprints_tell_texts_of_two_letters_apart(spark):
    a = b"a"
    for _ in range(11):
        a += a.translate(bytes.maketrans(b"ab", b"ba"))
    b = a.translate(bytes.maketrans(b"ab", b"ba"))
    _, h = word_hashes(np.frombuffer(a + b" " + b + b" " + a.upper(), np.uint8), True)
    assert h[0] == h[2] != h[1]
    rows = [(1, "x" * 60 + a[:64].decode() + "y" * 60), (2, "x" * 60 + b[:64].decode() + "y" * 60)]
    assert [r["n_removed"] for r in repeated_substrings(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0, 0]
