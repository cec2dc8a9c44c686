"""The logarithmic family on shared storage: batches one by one, and what happens without the levels."""

import hashlib
import os
import shutil

import numpy as np

from claimlattice.llm.suffix_dedup import Family, Index, _with_keys, merge, repeated_substrings

RNG = np.random.default_rng(5)


def words(n):
    return " ".join("".join(chr(97 + c) for c in RNG.integers(0, 26, 5)) for _ in range(n))


def corpus():
    passages = [words(40) for _ in range(6)]
    rows = []
    for i in range(48):
        parts = [words(int(RNG.integers(5, 40)))]
        for p in RNG.choice(6, int(RNG.integers(0, 3)), replace=False):
            cut = int(RNG.integers(0, 60))
            parts += [passages[p][cut:], words(10)]
        rows.append((i, " ".join(parts)))
    return rows


def brute(rows, length=100):
    seen, want = set(), {}
    for d, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(raw[i : i + length])
        want[d] = (int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])).hexdigest())
    return want


def test_batches_one_by_one(spark, tmp_path):
    rows = corpus()
    want, path = brute(rows), str(tmp_path / "index")
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    sizes = []
    for lo in range(0, 48, 12):
        new = rows[lo : lo + 12]
        out = repeated_substrings(spark, frame(new), index=path, earlier=frame(rows[:lo]) if lo else None)
        assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in out.collect()} == {d: want[d] for d, _ in new}
        sizes.append([int(n.split("-")[2]) for n in Index(spark, path, 1).names()])
    # Like-sized levels have merged: each is less than half as large as the one before.
    assert all(2 * b <= a for s in sizes for a, b in zip(s, s[1:])) and len(sizes[-1]) <= 2
    # Without the levels nothing of the last batch's copies of former documents is found.
    shutil.rmtree(os.path.join(path, os.listdir(path)[0]))
    alone = repeated_substrings(spark, frame(rows[36:]), index=path).collect()
    assert sum(r["n_removed"] for r in alone) < sum(want[d][0] for d, _ in rows[36:])


def test_different_texts_of_one_id(spark):
    p = words(40)
    rows = [(1, p), (2, "aaa " + p), (2, "bbb " + p), (2, "bbb " + p)]
    out = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in repeated_substrings(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n, sha = len(p.encode()), lambda t: hashlib.sha256(t.encode()).hexdigest()
    # The space before the passage stands before its copies too, in the second text.
    assert out == {(1, n, 0, sha(p)), (2, n + 4, n, sha("aaa ")), (2, n + 4, n + 1, sha("bbb"))}


def test_merge_keeps_order():
    keys = [np.sort(RNG.integers(0, 2**63, n).astype(np.uint64)) for n in (50, 20, 0, 7)]
    whole = np.zeros(0, np.uint64)
    family = Family()
    for k in keys:
        level = {"both": k, "gram": k, "run": k}
        family.add(level)
        whole = np.sort(np.concatenate([whole, k]))
        assert sum(len(x["both"]) for x in family.levels) == len(whole) and family.known(whole).all()
        assert all((np.diff(x["both"].astype(object)) >= 0).all() for x in family.levels)
    a, b = ({"both": k, "gram": k} for k in keys[:2])
    assert (merge(a, b)["both"] == np.sort(np.concatenate(keys[:2]))).all()
    assert set(_with_keys({"gram": keys[0], "run": keys[0]})) == {"gram", "run", "both"}
