"""Quality classifier by co-training of two views.

One logistic regression sees a text's contents (ratios, and hashed words and
byte trigrams), the other only the metadata (language, source, recorded
length).  Over a few rounds each labels all unlabelled documents that it is
sure of, by calibrated probability, for the other one: a distributed pass
gives the gradients of those documents, whatever their number.  Both views are
calibrated by margins of labelled rows from fits that have not seen them, and
their calibrated log odds are added to score all documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, lean
from .hashing import SPACE, shingles_of, slabs, text_words, texts_of

#: Hashed columns of language and source in the metadata view.
SLOTS = 64
PUNCTUATION = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
#: Hashed columns of words and of byte trigrams in the text view.
GRAMS = 128
N_RATIO = 16 + len(PUNCTUATION)
N_TEXT = N_RATIO + 2 * GRAMS
N_META = 2 * SLOTS + 24
#: Words added to a text's number when shares are taken.
PRIOR = 10
#: Labelled rows are cut into so many folds; ridge of ratios, metadata and hashed columns.
FOLDS = 5
RIDGE, RIDGE_GRAMS = 1.0, 100.0
#: Labelled rows that must bear out a view's certainty before it labels others.
PROOF = 10


def text_features(texts: list[bytes]) -> np.ndarray:
    """One row of shares and ratios for each whole text."""
    out = np.zeros((len(texts), N_TEXT))
    if not texts:
        return out
    _, single, word_at = text_words(texts, True)
    n_words = np.diff(word_at)
    pairs, pair_at = shingles_of(single, word_at[:-1], n_words, 2)
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)[:-1]
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    words = np.bincount(np.repeat(np.arange(len(texts)), n_words) * GRAMS + (single >> np.uint64(57)).astype(np.int64), minlength=len(texts) * GRAMS)
    b = data.astype(np.uint32)
    tri = (((b[:-2] * np.uint32(961) + b[1:-1] * np.uint32(31) + b[2:]) * np.uint32(2654435761)) >> np.uint32(25)).astype(np.int64)
    inside = owner[:-2] == owner[2:]
    tri = np.bincount(owner[:-2][inside] * GRAMS + tri[inside], minlength=len(texts) * GRAMS)
    for block, counts in ((0, words), (1, tri)):
        counts = counts.reshape(len(texts), GRAMS)
        out[:, N_RATIO + block * GRAMS : N_RATIO + (block + 1) * GRAMS] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    for i, text in enumerate(texts):
        raw = np.frombuffer(text, np.uint8)
        # Shares are taken of a little more than there is, so that few words show no extremes.  What is taken
        # by word and has no upper bound is taken by its logarithm: a megabyte without a space outgrows 16 bits.
        n = len(raw) + 6 * PRIOR
        count = np.bincount(raw, minlength=256)
        words = single[word_at[i] : word_at[i + 1]]
        k = len(words) + PRIOR
        _, each = np.unique(words, return_counts=True)
        two = pairs[pair_at[i] : pair_at[i + 1]]
        caps = count[65:91].sum()
        letters = caps + count[97:123].sum() + count[128:].sum() + 5 * PRIOR
        punct = count[PUNCTUATION]
        lines = count[10] + 1
        out[i, :16] = (
            np.log1p(len(words)), np.log1p(n / k), caps / letters, count[48:58].sum() / n, letters / n, count[SPACE].sum() / n,
            np.log1p(punct.sum() / k), (k - len(each)) / k, (len(two) - len(np.unique(two))) / k, ((each.max() - 1) / k) if len(each) else 0,
            np.log1p(k / lines), count[128:].sum() / n, np.log1p((count[46] + count[44]) / k), np.log1p(punct.max()), np.log1p(lines), len(words) == 0,
        )
        out[i, 16:N_RATIO] = np.sqrt(punct / k)
    return out


def meta_slots(langs, sources, sizes) -> np.ndarray:
    """The three columns of the metadata view that are 1: hashed language, hashed source, step of the recorded length."""
    rows = [(zlib.crc32(repr(a).encode()) % SLOTS, SLOTS + zlib.crc32(repr(b).encode()) % SLOTS, 2 * SLOTS + min(23, int(n).bit_length() if n and n > 0 else 0)) for a, b, n in zip(langs, sources, sizes)]
    return np.array(rows, np.uint8).reshape(-1, 3)


def meta_features(slots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(slots), N_META))
    out[np.arange(len(slots))[:, None], slots] = 1
    return out


def scaled(view: dict, x: np.ndarray) -> np.ndarray:
    """Standardised columns and a constant."""
    return np.hstack([np.clip((x - view["mean"]) / view["scale"], -8, 8), np.ones((len(x), 1))])


def chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def newton(z: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: np.ndarray, steps: int, more: np.ndarray | None = None) -> np.ndarray:
    """Newton steps of a ridge logistic regression.

    ``more``: the gradient of further rows that weigh as much in all as those
    of ``z``; their curvature is taken to be that of ``z``.
    """
    for _ in range(steps):
        p = chance(z @ w)
        curve = (z * (p * (1 - p))[:, None]).T @ z
        pull = z.T @ (y - p) - ridge * w
        if more is not None:
            curve, pull = 2 * curve, pull + more
        step = np.linalg.solve(curve + np.diag(ridge) + 1e-9 * np.eye(len(w)), pull)
        w = w + step * min(1, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibrate(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and intercept that turn margins into log odds.

    Labels are smoothed as if one more row of each class stood on the other
    side, so few rows give no certainty.
    """
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    base = float(np.log((n1 + 1) / (n0 + 1)))
    scale = max(float(m.std()), 1e-9)
    w = newton(np.stack([m / scale, np.ones(len(m))], 1), goal, np.array([0.0, base]), np.array([0.05, 1e-6]), 50)
    return (float(w[0] / scale), float(w[1])) if w[0] > 0 else (0.0, base)


class View:
    """One view's models: one for each fold left out and one on all labelled rows, and the calibration of their margins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, ridge: np.ndarray, standardise: bool):
        mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-3)) if standardise else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.form = {"mean": mean, "scale": scale}
        self.z, self.y, self.fold, self.ridge = scaled(self.form, x), y, fold, np.append(ridge, 1e-6)
        self.w = np.zeros((FOLDS + 1, self.z.shape[1]))
        self.step(25)

    def step(self, steps: int, more: np.ndarray | None = None, n=(0, 0)) -> None:
        """``more``: for each class and model the summed gradient of its ``n`` pseudo-labelled rows,
        which weigh as much as the labelled rows of the class."""
        for f in range(FOLDS + 1):
            rows = self.fold != f
            weighed = sum(more[c, f] * (self.y[rows] == c).sum() / n[c] for c in (0, 1) if n[c]) if more is not None else None
            self.w[f] = newton(self.z[rows], self.y[rows], self.w[f], self.ridge, steps, weighed)
        margins = np.einsum("ij,ij->i", self.z, self.w[self.fold])
        self.line = calibrate(margins, self.y)
        self.p = chance(self.line[0] * margins + self.line[1])
        self.loss = -np.log(np.where(self.y == 1, self.p, 1 - self.p)).mean()

    def reliable(self, sure: float) -> tuple[bool, bool]:
        """Whether the view may label rows bad, and good: labelled rows that it is as sure of, unseen, bear it out."""
        chosen = (self.p <= 1 - sure, self.p >= sure)
        return tuple(bool(x.sum() >= PROOF and (self.y[x] == c).mean() >= sure) for c, x in enumerate(chosen))

    def state(self) -> tuple:
        return self.w.copy(), self.line, self.p, self.loss

    def restore(self, state: tuple) -> None:
        self.w, self.line, self.p, self.loss = state

    def odds(self, sure: float = 1.0) -> dict:
        """What scoring needs."""
        return self.form | {"w": self.w[FOLDS], "line": self.line, "labels": self.reliable(sure)}


def log_odds(view: dict, x: np.ndarray) -> np.ndarray:
    a, b = view["line"]
    return a * (scaled(view, x) @ view["w"]) + b


def gradients(judges: list[dict], forms: list[dict], models: list[np.ndarray], sure: float):
    """Per task, view and class: how many pool rows the other view is sure of, and their gradient for each model."""

    @lean
    def run(batches):
        sums = [np.zeros((2, *m.shape)) for m in models]
        counts = np.zeros((2, 2), int)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float16).reshape(len(batch), N_TEXT).astype(float)
            slots = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(batch), 3)
            views = [flat, meta_features(slots)]
            for v in range(2):
                p = chance(log_odds(judges[1 - v], views[1 - v]))
                for c, chosen in enumerate((p <= 1 - sure, p >= sure)):
                    if not judges[1 - v]["labels"][c]:
                        continue
                    z = scaled(forms[v], views[v][chosen])
                    sums[v][c] += (c - chance(z @ models[v].T)).T @ z
                    counts[v, c] += int(chosen.sum())
        yield pa.RecordBatch.from_arrays([pa.array([0, 0, 1, 1], pa.int32()), pa.array([0, 1, 0, 1], pa.int32()), pa.array(counts.reshape(-1)), pa.array([s[c].reshape(-1).tolist() for s in sums for c in (0, 1)], pa.list_(pa.float64()))], names=["view", "label", "n", "sums"])

    return run


def co_train(pool: DataFrame | None, text, slots, y, fold, rounds: int, sure: float, steps: int = 2) -> dict:
    """Both views' models and calibrations, and the log odds that both start from.

    ``pool(text, slots)`` holds the features of all unlabelled documents.  In
    each round each view labels those it is sure of for the other view, whose
    models take ``steps`` steps on labelled and pseudo-labelled rows; both
    kinds weigh alike in each class.  A view labels a class only if at least
    ``PROOF`` labelled rows bear its certainty out, and a round that worsens a
    view's loss on rows it has not seen is taken back.
    """
    x = [text, meta_features(slots)]
    ridges = [np.append(np.full(N_RATIO, RIDGE), np.full(2 * GRAMS, RIDGE_GRAMS)), np.full(N_META, RIDGE)]
    views = [View(x[v], y, fold, ridges[v], v == 0) for v in range(2)]
    for _ in range(rounds if pool is not None else 0):
        judges, before = [v.odds(sure) for v in views], [v.state() for v in views]
        if not any(any(j["labels"]) for j in judges):
            break
        for _ in range(steps):
            task = gradients(judges, [v.form for v in views], [v.w for v in views], sure)
            parts = pool.mapInArrow(task, "view int, label int, n long, sums array<double>")
            # n goes along as one more sum.
            each = parts.select("view", "label", F.posexplode(F.concat("sums", F.array(F.col("n").cast("double")))).alias("i", "x"))
            more = [np.zeros((2, v.w.size + 1)) for v in views]
            for r in each.groupBy("view", "label", "i").agg(F.sum("x").alias("x")).collect():
                more[r["view"]][r["label"], r["i"]] = r["x"]
            for v, m in zip(views, more):
                if m[:, -1].any():
                    v.step(1, m[:, :-1].reshape(2, *v.w.shape), m[:, -1])
        for v, state in zip(views, before):
            if v.loss > state[-1]:
                v.restore(state)
        if all(v.state()[-1] == state[-1] for v, state in zip(views, before)):
            break
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    return {"views": [v.odds() for v in views], "base": base}


def features(batches, at):
    """(text features, metadata slots) of Arrow batches; ``at``: column numbers."""
    for batch in batches:
        texts = texts_of(batch.column(at["text"]))
        x = [text_features(texts[s]) for s in slabs([len(t) for t in texts])]
        columns = [batch.column(at[c]).to_pylist() for c in ("lang", "source", "n_chars")]
        yield batch, np.vstack(x) if x else np.zeros((0, N_TEXT)), meta_slots(*columns)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_labelled: int = 8000, rounds: int = 3, sure: float = 0.97, ws: Workspace | None = None) -> dict | None:
    """Models from the ``most_labelled`` labelled ids with the least hash of doc_id, and all other documents.

    Null labels and ids do not count; of several labels of an id the majority
    does (a tie: good), and of several rows of a labelled id the one of the
    least text.  Labelled ids beyond the sample count as unlabelled.  None if the sample has not both classes.
    """
    ws = ws or Workspace(spark, "quality")
    named = labels.filter("doc_id is not null and quality is not null").select("doc_id", "quality")
    named = named.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    h = F.xxhash64("doc_id", F.lit(3))
    chosen = spark.createDataFrame(named.orderBy(h, "doc_id").limit(most_labelled).collect(), named.schema)
    columns = ["text", "lang", "source", "n_chars"]
    base = docs.filter("doc_id is not null").select("doc_id", *columns)
    known = base.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*columns)).alias("x")).select("doc_id", "quality", "x.*")
    # The sample is bounded, so it may be broadcast, and no text is shuffled.
    pool = base.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").select(*columns)

    def rows(names):
        at = {c: i for i, c in enumerate(names)}

        @lean
        def run(batches):
            for batch, text, slots in features(batches, at):
                cells = [pa.array([r.tobytes() for r in c], pa.binary()) for c in (text.astype(np.float16), slots)]
                yield pa.RecordBatch.from_arrays([*[batch.column(at[c]) for c in names[:-4]], *cells], names=[*names[:-4], "text", "slots"])

        return run

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = known.select("doc_id", "quality", *columns).mapInArrow(rows(["doc_id", "quality", *columns]), f"doc_id {id_type}, quality int, text binary, slots binary").collect()
    found.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"])))
    y = np.array([r["quality"] for r in found], float)
    if not 0 < y.sum() < len(y):
        return None
    text = np.frombuffer(b"".join(r["text"] for r in found), np.float16).reshape(len(found), N_TEXT).astype(float)
    slots = np.frombuffer(b"".join(r["slots"] for r in found), np.uint8).reshape(len(found), 3)
    # Folds with rows of both classes in turn.
    fold = np.zeros(len(y), int)
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % FOLDS
    pool = ws.save(pool.mapInArrow(rows(columns), "text binary, slots binary"), "pool")
    model = co_train(pool, text, slots, y, fold, rounds, sure)
    ws.drop("pool")
    return model


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep_from: float = 0.5, with_text: bool = True, **sample) -> DataFrame:
    """``docs`` (without text, if not ``with_text``) plus ``text_score, meta_score, score, keep``; other columns pass.

    Scores are calibrated probabilities of good quality; ``score`` joins both
    views by adding their log odds, less the prior once.  ``keep``: score is
    at least ``keep_from``.  Null and empty texts are judged as texts of no
    words, very long ones whole; ties at ``keep_from`` stay; an empty table gives
    no row.  Without labels of both classes all scores are null and all rows
    stay.  Clashing columns of ``docs`` are replaced; rows never meet, so
    repeated rows each get the same score.
    """
    added = ["text_score", "meta_score", "score", "keep"]
    names = [c for c in docs.columns if c not in added]
    docs = docs.select(*names)
    out = [c for c in names if with_text or c != "text"]
    model = train(spark, docs, labels, **sample)
    if model is None:
        none = [F.lit(None).cast("double").alias(c) for c in added[:3]]
        return docs.select(*out, *none, F.lit(True).alias("keep"))
    at = {c: i for i, c in enumerate(names)}

    @lean
    def score(batches):
        for batch, text, slots in features(batches, at):
            odds = [log_odds(v, x) for v, x in zip(model["views"], (text, meta_features(slots)))]
            odds.append(odds[0] + odds[1] - model["base"])
            p = [chance(o) for o in odds]
            yield pa.RecordBatch.from_arrays([*[batch.column(at[c]) for c in out], *[pa.array(x) for x in p], pa.array(p[2] >= keep_from)], names=[*out, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*out).schema)
    return docs.mapInArrow(score, f"{fields}, text_score double, meta_score double, score double, keep boolean")
