"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick.

Texts are folded first: case, look-alike letters of other scripts, and digits or
signs that stand for letters inside words. The lexicon is learned from training
rows: whole words and word beginnings that occur in far more toxic than other
documents, weighted by their log odds; of a beginning and its continuations,
the longest that explains as many documents stays. Two-word phrases around a
term that occur in other documents alone become exceptions, beside those given;
a hit inside an exception does not count. A text's hits, weighted, are divided
by its words, and a logistic curve fitted on the training rows gives the score.

The bound TRAINING_ROWS on labelled rows is a parameter; the sample is chosen by
a hash of the id. All terms and exceptions that these rows give are kept. Scoring
reads every whole text.

Defined cases: null and empty texts have no hits and get the score of these; texts of
any length are read as a whole, in time that grows with their length and the logarithm of their exceptions;
without labels of both kinds the lexicon is empty and every score is 0; rows
repeat as they come; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import held_out, sample, training
from .scratch import cut

TRAINING_ROWS = 12_000
SHORTEST, LONGEST = 3, 10
LEAST_DOCS, LEAST_WEIGHT = 5, 3.0
CUTOFF = 0.5

#: Cyrillic and Greek letters that look like Latin ones, and what stands for a letter inside words.
LIKE = str.maketrans("аеорсухіјѕԁӏѵһкмтвнοαεικνρτυχ", "aeopcyxijsdlvhkmtbhoaeiknptux")
STANDS = str.maketrans("013457@$", "oieastas")
INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$]+(?=[^\W\d_])|\b[013457@$]+(?=[^\W\d_])|(?<=[^\W\d_])[013457@$]+\b")
WORD = re.compile(r"\w+")


def folded(text: str | None) -> str:
    """Words of the folded text, each with a blank before and after it."""
    low = (text or "").casefold().translate(LIKE)
    low = INSIDE.sub(lambda m: m[0].translate(STANDS), low)
    return f" {' '.join(WORD.findall(low))} "


def features(line: str) -> set[str]:
    """Each word in full, closed by a blank, and its beginnings."""
    out: set[str] = set()
    for w in set(line.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


class Lexicon:
    """score(texts) with weighted terms, exceptions and a fitted curve."""

    def __init__(self, terms: dict[str, float], exceptions: Iterable[str] = (), curve: tuple[float, float] = (0.0, -30.0)):
        self.terms, self.exceptions, self.curve = terms, [folded(x) for x in exceptions], curve
        self.automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def density(self, text: str | None) -> float:
        """Weight of the hits outside exceptions per word."""
        if not self.terms:
            return 0.0
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            exceptions = set(self.exceptions)
            for t in {**self.terms, **dict.fromkeys(self.exceptions, 0.0)}:
                self.automaton.add_word(t, (len(t), self.terms.get(t), t in exceptions))
            self.automaton.make_automaton()
        line = folded(text)
        hits, spared = [], []
        for end, (n, weight, exception) in self.automaton.iter(line):
            if exception:
                spared.append((end - n + 1, end))
            if weight is not None:
                hits.append((end - n + 1, end, weight))
        if spared:
            # Exceptions come by their ends; of those that end no earlier than a hit, the first to begin decides.
            ends = [b for _, b in spared]
            begins = list(accumulate((a for a, _ in reversed(spared)), min))[::-1]
            hits = [h for h in hits if (k := bisect_left(ends, h[1])) == len(ends) or begins[k] > h[0]]
        return sum(h[2] for h in hits) / (line.count(" ") + 1)

    def scores(self, densities: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * np.log1p(1000 * densities) + b, -30, 30)))


def _counts(rows: DataFrame) -> DataFrame:
    """term, docs: in how many texts of rows each feature occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(features(folded(text)))
            if len(seen) > 300_000:
                yield pd.DataFrame({"term": list(seen), "docs": list(seen.values())})
                seen.clear()
        yield pd.DataFrame({"term": list(seen), "docs": list(seen.values())}).astype({"term": object, "docs": "int64"})

    return rows.select("text").mapInPandas(run, "term string, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def _phrases(rows: DataFrame, terms: dict[str, float]) -> DataFrame:
    """phrase, label, docs: two-word phrases with a term in them."""
    lexicon = frozenset(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter[tuple[str, int]] = Counter()
            for text, label in zip(batch["text"], batch["label"], strict=True):
                words = folded(text).split()
                hit = {w: not lexicon.isdisjoint(features(f" {w} ")) for w in set(words)}
                seen.update({(f"{a} {b}", label) for a, b in zip(words, words[1:], strict=False) if hit[a] or hit[b]})
            yield pd.DataFrame([(p, k, n) for (p, k), n in seen.items()], columns=["phrase", "label", "docs"]).astype({"phrase": object, "label": "int32", "docs": "int64"})

    return rows.mapInPandas(run, "phrase string, label int, docs long").groupBy("phrase").agg(
        F.sum(F.when(F.col("label") == 1, F.col("docs")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("docs")).otherwise(0)).alias("other")
    )


def fit(docs: DataFrame, labels: DataFrame, exceptions: Iterable[str] = (), rows: int = TRAINING_ROWS) -> Lexicon:
    """docs(doc_id, text); labels(doc_id, toxic)."""
    known = sample(training(labels, "toxic"), rows)
    learn = cut(docs.join(F.broadcast(known), "doc_id").select("label", "text"))
    toxic, other = learn.where("label = 1"), learn.where("label = 0")
    sizes = dict(learn.groupBy("label").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon({})
    ones = cut(_counts(toxic).where(F.col("docs") >= LEAST_DOCS))
    zeros = _counts(other).select("term", F.col("docs").alias("other"))
    # Documents of the longest continuation by one character.
    longer = ones.groupBy(F.expr("substring(term, 1, length(term) - 1)").alias("term")).agg(F.max("docs").alias("longer"))
    n, m = F.col("docs"), F.coalesce("other", F.lit(0))
    weighed = ones.join(zeros, "term", "left").join(longer, "term", "left").select("term", "docs", m.alias("other"), "longer", (F.log((n + 0.5) / (n1 + 1)) - F.log((m + 0.5) / (n0 + 1))).alias("weight"))
    strong = {r.term: r for r in weighed.where((F.col("weight") >= LEAST_WEIGHT) & (F.coalesce("longer", F.lit(0)) < F.lit(0.9) * n)).collect()}
    kept = list(strong)
    names = set(kept)
    kept = [t for t in kept if not any(t[:k] in names for k in range(SHORTEST + 1, len(t)))]
    terms = {t: strong[t].weight for t in sorted(kept, key=lambda t: (-strong[t].docs * strong[t].weight, t))}
    spared = [r[0] for r in _phrases(learn, terms).where((F.col("toxic") == 0) & (F.col("other") >= LEAST_DOCS)).orderBy(F.desc("other"), "phrase").collect()] if any(strong[t].other for t in terms) else []
    lexicon = Lexicon(terms, [*exceptions, *spared])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "d": [lexicon.density(t) for t in batch["text"]]})

    seen = learn.mapInPandas(measure, "label int, d double").toPandas()  # at most `rows` pairs of numbers
    x, y = np.log1p(1000 * seen["d"].to_numpy()), seen["label"].to_numpy().astype(float)
    a, b = 1.0, -1.0
    for _ in range(50):  # Newton's method with a small penalty
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 0.1 * a, (p - y).sum() + 0.1 * b])
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    lexicon.curve = float(a), float(b)
    return lexicon


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", exceptions: Iterable[str] = (), cutoff: float = CUTOFF, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lexicon = fit(texts, labels, exceptions, rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = np.array([lexicon.density(t) for t in batch["text"]], np.float64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": lexicon.scores(d)})

    scored = texts.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
