"""Each stage of the pipeline against brute force on its own input, and run() against the chain."""

import collections

import numpy as np
import pytest

import corpus_pipeline as cp
from claimlattice.llm.common import Workspace, table
from claimlattice.llm.paragraphs import paragraph_spans, without_repeats

from .test_brute import components, shingle_set, similar


@pytest.fixture(scope="module")
def chain(spark, sf):
    """Inputs of all stages and the last one's output, as pandas."""
    ws, frames = Workspace(spark, "test-pipeline"), [table(spark, sf, "documents")]
    for i, (_, stage) in enumerate(cp.STAGES):
        frames.append(ws.save(stage(spark, frames[-1], sf), f"s{i}"))
    return [f.toPandas() for f in frames]


def test_quality_keeps_the_good_and_drops_the_bad(chain, spark, sf):
    labels = table(spark, sf, "labels").toPandas()
    kept = set(chain[1].doc_id)
    assert set(chain[1].columns) == set(cp.COLUMNS) and kept <= set(chain[0].doc_id)
    assert labels[labels.quality == 1].doc_id.isin(kept).mean() > 0.97
    assert labels[labels.quality == 0].doc_id.isin(kept).mean() < 0.1


def test_one_of_each_group_stays(chain):
    sets = {r.doc_id: shingle_set(r.text, 5) for r in chain[1].itertuples()}
    root = components(sets, similar(sets, 80))
    assert sorted(chain[2].doc_id) == sorted({root[d] for d in sets})


def test_repeated_passages_go(chain, spark):
    """Paragraphs by brute force over the same cutting; passages whatever the cutting."""
    before = chain[2].sort_values("doc_id")
    first, places = {}, []
    for r in before.itertuples():
        raw = r.text.encode()
        for j, (a, b) in enumerate(paragraph_spans(raw)):
            words = tuple(raw[a:b].lower().split())
            if len(words) >= 20:
                at = len(raw[:a].split())
                places.append((r.doc_id, j, words, at))
                first.setdefault(words, (r.doc_id, j))
    sets = {p: {w[i : i + 5] for i in range(len(w) - 4)} for w, p in first.items()}
    root = components(sets, similar(sets, 80))
    gone = collections.defaultdict(set)
    for d, j, words, at in places:
        if root[first[words]] != (d, j):
            gone[d].update(range(at, at + len(words)))

    out = {r["doc_id"]: r for r in without_repeats(spark, spark.createDataFrame(before[["doc_id", "text"]])).collect()}
    after = dict(zip(chain[3].doc_id, chain[3].text))
    assert sorted(out) == sorted(after) == sorted(before.doc_id)
    seen20, seen51, repeated, found = set(), set(), 0, 0
    for r in before.itertuples():
        words, low = r.text.encode().split(), r.text.encode().lower().split()
        cut = {i for c in out[r.doc_id]["cuts"] for i in range(c["begin"], c["end"])}
        # The text is what is left, the stage's text is that, and whole paragraphs are among the cuts.
        assert after[r.doc_id] == out[r.doc_id]["text"] and after[r.doc_id].encode().split() == [w for i, w in enumerate(words) if i not in cut]
        assert gone[r.doc_id] <= cut
        # What else goes stands earlier, in runs of 20 words at least.
        w20 = [tuple(low[i : i + 20]) for i in range(len(low) - 19)]
        known = set()
        for i, w in enumerate(w20):
            if w in seen20:
                known.update(range(i, i + 20))
            seen20.add(w)
        assert cut - gone[r.doc_id] <= known
        # Passages of over 50 words that stand earlier go, but for a word or two at their ends.
        w51 = [tuple(low[i : i + 51]) for i in range(len(low) - 50)]
        for i, w in enumerate(w51):
            if w in seen51:
                repeated, found = repeated + 1, found + (len(cut & set(range(i, i + 51))) >= 46)
        seen51.update(w51)
    assert repeated == 0 or found / repeated > 0.95


def test_mix_repeats_whole_documents(chain):
    before = chain[3].set_index("doc_id")
    copies = chain[4].groupby("doc_id").size()
    assert copies.max() <= 2 and set(copies.index) <= set(before.index)
    assert (chain[4].text.to_numpy() == before.text[chain[4].doc_id].to_numpy()).all()
    words = before.text.map(lambda t: len(t.encode().split()))
    taken = (words[copies.index] * copies).groupby(before.source[copies.index]).sum()
    assert taken.sum() == pytest.approx(1.5 * words.sum(), rel=0.03)


def test_packing_holds_every_word(chain):
    rows = chain[5]
    copies = chain[4].groupby("doc_id").size()
    words = chain[4].drop_duplicates("doc_id").set_index("doc_id").text.map(lambda t: len(t.encode().split()))
    assert rows.groupby("doc_id").n_tokens.sum().to_dict() == (words * copies).to_dict()
    bins = rows.dropna(subset=["bin_id"]).groupby("bin_id")
    assert (bins.n_tokens.sum() <= bins.bin_length.first()).all()
    for _, b in bins:
        b = b.sort_values("offset")
        assert (b.offset.to_numpy() == np.concatenate(([0], np.cumsum(b.n_tokens)[:-1]))).all()


def test_run_is_the_chain(chain, spark, sf):
    rows = cp.run(spark, sf).toPandas()
    key = ["doc_id", "piece", "n_tokens"]
    assert rows[key].sort_values(key).values.tolist() == chain[5][key].sort_values(key).values.tolist()
