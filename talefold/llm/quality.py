"""Quality scores by positive-unlabelled learning.

Trusted positives are training rows labelled 1; all documents that are not
training rows are unlabelled web text. A small network over document statistics
minimises the non-negative unbiased risk: prior * E+[loss of 1] plus the
unlabelled loss of 0 less the positives' share of it, where that remainder is
kept from falling below zero by stepping back when it does. The class prior is
estimated from positives and unlabelled rows alone: a network that tells the two apart scores
rows that it didn't learn from, and the share of unlabelled rows above a cutoff, by the share of
positives above it, bounds the prior from above; the cutoff of the least upper
confidence limit is taken (best bin), each half of the rows in turn. No row labelled 0 is used.

The sample bounds POSITIVES and UNLABELLED are parameters; samples are chosen by
a hash of the id from the whole table. Scoring reads every whole text.

Defined cases: null and empty texts have all-zero counts and get the model's
score for these; texts of any length are read as a whole; without positives every score is 0, or 0.5 without labels; without
unlabelled rows it is the share of positives among labels; rows repeat as they come; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import held_out, sample, training
from .scratch import parts
from .shingles import mix, word_hashes

POSITIVES, UNLABELLED = 8_000, 16_000
HIDDEN, STEPS, RATE, DECAY = 12, 300, 0.03, 1e-4
CUTOFF = 0.3
#: Confidence of the prior's limit, and the priors that the risk is minimised for.
DOUBT, LEAST_PRIOR, MOST_PRIOR = 0.1, 0.02, 0.98

#: Bytes by kind: upper case, lower case, digits, blank, line feed, outside ASCII, then single marks and the rest.
KINDS = np.full(256, 6)
KINDS[65:91], KINDS[97:123], KINDS[48:58], KINDS[32], KINDS[10], KINDS[128:] = 0, 1, 2, 3, 4, 5
for _k, _c in enumerate(".,!?|#$%&*<>{}@/:;-_=\"'()"):
    KINDS[ord(_c)] = 7 + _k
N_KINDS = int(KINDS.max()) + 1


def statistics(text: str | None) -> np.ndarray:
    """Counts of a text as ratios and logarithms."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    w = word_hashes(text or "")
    n, m = max(len(raw), 1), max(len(w), 1)
    share = np.bincount(KINDS, np.bincount(raw, minlength=256), N_KINDS) / n
    _, times = np.unique(w, return_counts=True)
    pairs = np.unique(mix(w[1:]) + w[:-1]) if len(w) > 1 else w
    lines = (text or "").split("\n")
    more = [
        np.log1p(len(raw)) / 10,
        np.log1p(len(w)) / 10,
        len(raw) / m / 10,
        len(times) / m,
        (times.max() if len(times) else 0) / m,
        len(pairs) / max(len(w) - 1, 1),
        float((w[1:] == w[:-1]).mean()) if len(w) > 1 else 0.0,
        len(set(lines)) / len(lines),
        np.log1p(m / len(lines)) / 5,
    ]
    return np.concatenate([np.sqrt(share), more]).astype(np.float32)


N_STATISTICS = len(statistics(""))


class Model:
    """A network with one hidden layer, or a constant where there is nothing to learn from.

    With `apart` it tells positives from unlabelled rows, without taking the positives' share out."""

    def __init__(self, positives: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 11, apart: bool = False):
        self.constant = prior
        self.layers: list[np.ndarray] = []
        if not len(positives) or not len(unlabelled) or not 0 < prior < 1:
            return
        both = np.concatenate([positives, unlabelled])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-3
        x = self._scaled(both)
        rng = np.random.default_rng(seed)
        shapes = ((x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), (1,))
        self.layers = [(rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k == 2 else np.zeros(s)).astype(np.float32) for k, s in enumerate(shapes)]
        first, second = ([np.zeros_like(v) for v in self.layers] for _ in range(2))
        p, u, share = len(positives), len(unlabelled), 0.0 if apart else prior
        for step in range(1, STEPS + 1):
            hidden = np.tanh(x @ self.layers[0] + self.layers[1])
            out = np.clip(hidden @ self.layers[2] + self.layers[3], -30, 30)
            as_one = 1 / (1 + np.exp(-out))
            loss0 = np.logaddexp(0, out)  # of calling it 0
            rest = loss0[p:].mean() - share * loss0[:p].mean()
            slope = np.zeros(len(x), np.float32)
            if rest >= 0:
                slope[:p] = prior / p * (as_one[:p] - 1) - share / p * as_one[:p]
                slope[p:] = as_one[p:] / u
            else:  # step back from a negative remainder
                slope[:p] = share / p * as_one[:p]
                slope[p:] = -as_one[p:] / u
            inner = slope[:, None] * self.layers[2] * (1 - hidden**2)
            grads = [x.T @ inner, inner.sum(0), hidden.T @ slope, slope.sum(keepdims=True)]
            for k, g in enumerate(grads):
                g = g + DECAY * self.layers[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                self.layers[k] = (self.layers[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.constant)
        w, b, v, c = self.layers
        return 1 / (1 + np.exp(-np.clip(np.tanh(self._scaled(x) @ w + b) @ v + c, -30, 30).astype(np.float64)))


def estimated_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, within LEAST_PRIOR and MOST_PRIOR."""
    found = []
    for side in (0, 1):
        judge = Model(positives[side::2], unlabelled[side::2], 0.5, apart=True)
        p, u = np.sort(judge(positives[1 - side :: 2])), np.sort(judge(unlabelled[1 - side :: 2]))
        if not len(p) or not len(u):
            continue
        above_p = 1 - np.arange(len(p)) / len(p)
        above_u = 1 - np.searchsorted(u, p) / len(u)
        spread = np.sqrt(np.log(4 / DOUBT) / 2) * (len(u) ** -0.5 + len(p) ** -0.5)
        best = np.argmin((above_u + spread) / above_p)
        found.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(found), LEAST_PRIOR, MOST_PRIOR)) if found else 0.5


def _statistics_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "x": [statistics(t) for t in batch["text"]]})

    return docs.select("label", "text").mapInPandas(run, "label int, x array<float>")


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """docs(doc_id, text); labels(doc_id, quality)."""
    known = training(labels, "quality")
    n, ones = known.agg(F.count("*"), F.sum("label")).first()
    share = (ones or 0) / n if n else 0.5
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    sure = sample(known.where("label = 1").join(ids, "doc_id", "left_semi"), positives)
    web = sample(ids.join(known, "doc_id", "left_anti"), unlabelled)
    chosen = sure.select("doc_id", "label").unionByName(web.select("doc_id", F.lit(0).alias("label")))
    rows = _statistics_of(docs.join(F.broadcast(chosen), "doc_id")).toPandas()
    x = np.array(rows["x"].tolist(), np.float32).reshape(-1, N_STATISTICS)
    one = rows["label"].to_numpy() == 1
    x, web_x = x[one], x[~one]
    return Model(x, web_x, estimated_prior(x, web_x) if len(x) and len(web_x) else share)


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, **sizes: int) -> Model:
    return fit(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), labels, **sizes)


def _scores(model: Model, texts: list[str | None]) -> np.ndarray:
    return model(np.array([statistics(t) for t in texts], np.float32).reshape(-1, N_STATISTICS))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF, **sizes: int) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = _model(docs, labels, id_col, text_col, **sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scores(model, part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF, **sizes: int) -> DataFrame:
    """The rows of docs, with all their columns, that are predicted to be good; the text column is a string."""
    model, at = _model(docs, labels, id_col, text_col, **sizes), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            yield part.filter(pa.array(_scores(model, part.column(at).to_pylist()) >= cutoff, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
