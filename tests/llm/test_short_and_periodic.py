"""Texts and passages that a cutter by word counts or local minima would miss."""

import numpy as np

from claimlattice.llm.hashing import chain, mix, word_hashes
from claimlattice.llm.paragraphs import REACH, units, without_repeats

RNG = np.random.default_rng(31)


def words(n):
    return ["".join(chr(97 + c) for c in RNG.integers(0, 26, 6)) for _ in range(n)]


def kept(spark, rows):
    return {r["doc_id"]: r for r in without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_short_texts_are_compared_whole(spark):
    line, near = words(16), words(19)
    other = near[:-1] + words(1)
    rows = [(i, " ".join(line)) for i in range(5)] + [(5, " ".join(near)), (6, " ".join(other)), (7, "two words"), (8, "Two  words\n"), (9, "x"), (10, "own words"), (11, " \n")]
    # The same words within a longer text are no text of their own.
    rows.append((12, " ".join(words(60) + line + words(60))))
    out = kept(spark, rows)
    assert {d for d, r in out.items() if r["n_removed"]} == {1, 2, 3, 4, 6, 8}
    assert all(not out[d]["text"].strip() and out[d]["removed"] == [] for d in (1, 2, 3, 4, 6, 8))
    assert [tuple(c) for c in out[6]["cuts"]] == [(0, 19)] and out[1]["words_removed"] == 16
    assert all(out[d]["text"] == t for d, t in rows if d in (0, 5, 7, 9, 10, 11, 12))


def test_equal_short_rows_are_one_document(spark):
    out = without_repeats(spark, spark.createDataFrame([(1, "a short text")] * 3, "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in out] == [0, 0, 0]


def test_passages_of_few_alternating_words_go(spark):
    """One word 200 times, three words 70 times, six words 35 times, between own words, in twelve documents each."""
    phrases = [(["na"], 200), (["ho", "he", "hi"], 70), (words(6), 35)]
    rows = [(12 * p + i, " ".join(words(int(RNG.integers(30, 60))) + phrase * times + words(int(RNG.integers(30, 60))))) for p, (phrase, times) in enumerate(phrases) for i in range(12)]
    out = kept(spark, rows)
    for d, text in rows:
        phrase, times = phrases[d // 12]
        n, left = sum(w in phrase for w in text.split()), sum(w in phrase for w in out[d]["text"].split())
        # Own words stay, but for one in a paragraph of six other shingles, of which 6 / 7 are known; of the
        # repetition the first document keeps its begin, the others a few words at most.
        own, stay = ([w for w in t.split() if w not in phrase] for t in (text, out[d]["text"]))
        assert own == stay or (len(phrase) == 6 and len(own) - len(stay) <= 2 and set(stay) < set(own))
        assert n == len(phrase) * times and (0 < left < n / 2 if d % 12 == 0 else left <= REACH), (phrase, d, left)


def test_runs_are_followed_to_their_ends(spark):
    """A passage whose later part has no place to begin a unit (word pairs of rising hashes), over 48 words."""
    vocabulary = words(3000)
    h = word_hashes(np.frombuffer(" ".join(vocabulary).encode(), np.uint8), True)[1]
    path, low = [0], np.uint64(0)
    while True:
        pair = mix(chain(np.repeat(h[path[-1]], len(h)), h))
        pair[pair <= low] = np.iinfo(np.uint64).max
        if pair.min() == np.iinfo(np.uint64).max:
            break
        path.append(int(pair.argmin()))
        low = pair.min()
    rising = [vocabulary[i] for i in path[:150]]
    assert len(rising) == 150 and len(units(h[path[:150]], np.array([0, 150]))[0]) <= 2
    passages, own = (words(60) + rising, rising[::-1] + words(60)), [(words(80), words(80)) for _ in range(2)]
    rows = [(i, " ".join(words(70) + p + words(70))) for i, p in enumerate(passages)]
    rows += [(2 + i, " ".join(own[i][0] + p + own[i][1])) for i, p in enumerate(passages)]
    out = kept(spark, rows)
    assert out[0]["n_removed"] == out[1]["n_removed"] == 0
    assert all(out[2 + i]["text"].split() == own[i][0] + own[i][1] for i in range(2))


def test_units_do_not_depend_on_other_texts():
    texts = [words(90), ["na"] * 100, words(5) + ["ho", "he"] * 40 + words(30), [], ["one"]]
    hashes = [word_hashes(np.frombuffer(" ".join(t).encode(), np.uint8), True)[1] for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
    together = set(units(np.concatenate(hashes), bounds)[0].tolist())
    assert together == {int(b) + int(at) for b, h in zip(bounds, hashes) if len(h) for at in units(h, np.array([0, len(h)]))[0]}
