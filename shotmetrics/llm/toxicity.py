"""Toxicity by the nearest labelled examples.

Terms that mark the label are chosen from labelled documents by their
likelihood ratio; a text is its TF-IDF vector over them, each term also weighted
by the log of its lift. Its nearest examples
by cosine are found exactly in a block-max inverted index: examples stand in
blocks, each term keeps its greatest weight per block, and blocks are scored in
the order of their bounds until no bound can reach the k-th best. The
neighbours vote with the square of their cosine; the odds of the votes are
calibrated on the examples, each scored without itself.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotmetrics.operators.lineage import checkpointed

from .shared import whole_text

# Bound of the fit: so many labelled documents, by a hash of their id, are the examples.
EXAMPLES = 12_000
# Bound of the model: so many terms at most, by likelihood ratio.
TERMS = 4_096
LEAST_RATIO = 30.0
LEAST_LIFT = 8.0
NEIGHBOURS = 15
BLOCK = 64
PRIOR_VOTES = 0.5

_WORD = re.compile(r"[^\W\d_]+")


# Inflected words share a stem: besides itself a word stands for its first letters, written with a dash.
STEMS = (4, 5, 6)
_REMEMBERED = 100_000


def text_words(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def word_terms(word: str) -> list[str]:
    """The terms a word stands for."""
    return [word, *[word[:n] + "-" for n in STEMS if len(word) > n]]


class Vocabulary:
    """Places of the terms in a vector."""

    def __init__(self, terms: list[str]) -> None:
        self.places = {t: i for i, t in enumerate(terms)}
        self.of_word: dict[str, list[int]] = {}

    def counts(self, text: str) -> dict[int, int]:
        """How often each term of the vocabulary stands in the text, in order of its place."""
        known, found = self.of_word, {}
        for word, n in text_words(text).items():
            places = known.get(word)
            if places is None:
                places = [self.places[t] for t in word_terms(word) if t in self.places]
                if len(known) < _REMEMBERED:
                    known[word] = places
            for at in places:
                found[at] = found.get(at, 0) + n
        return dict(sorted(found.items()))


def training_rows(labels: DataFrame, bound: int = EXAMPLES) -> DataFrame:
    """(doc_id, label) of the examples: rows whose crc32(doc_id) mod 5 is not 0, one per id."""
    known = labels.filter("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    one = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def choose_terms(examples: DataFrame, bound: int = TERMS) -> list[tuple[str, float]]:
    """Terms far more frequent among examples with the label, by log-likelihood ratio, with the log of their lift."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: list[Counter] = [Counter(), Counter()]
            for text, label in zip(frame["text"], frame["label"], strict=True):
                seen[int(label > 0)].update({t for word in text_words(text) for t in word_terms(word)})
            for label, terms in enumerate(seen):
                if not terms:
                    continue
                yield pd.DataFrame({"term": list(terms), "label": label, "n": list(terms.values())})

    sizes = {r["label"]: r["n"] for r in examples.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return []
    counts = examples.select("text", "label").mapInPandas(split, "term string, label int, n bigint").groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).cast("double").alias("a"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).cast("double").alias("b"),
    )

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, b, rate = F.col("a"), F.col("b"), (F.col("a") + F.col("b")) / F.lit(float(pos + neg))
    ratio = 2 * (
        part(a, rate * pos) + part(b, rate * neg) + part(pos - a, (1 - rate) * pos) + part(neg - b, (1 - rate) * neg)
    )
    marked = counts.withColumn("ratio", ratio).filter((F.col("ratio") >= LEAST_RATIO) & (a / pos >= LEAST_LIFT * b / neg))
    lift = F.log((a + 0.5) / (pos + 1) / ((b + 0.5) / (neg + 1))).alias("lift")
    return [(r["term"], r["lift"]) for r in marked.orderBy(F.desc("ratio"), "term").select("term", lift).limit(bound).collect()]


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, dict[int, int]]:
    """Number of documents, and of those with the term at each place, over all documents."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(terms)
        seen: Counter = Counter()
        for frame in frames:
            seen[-1] += len(frame)
            for text in frame["text"]:
                seen.update(vocabulary.counts(text).keys())
        yield pd.DataFrame({"place": list(seen), "n": list(seen.values())})

    rows = docs.select(whole_text().alias("text")).mapInPandas(count, "place int, n bigint")
    got = {r["place"]: r["n"] for r in rows.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    return got.pop(-1, 0), got


class Index:
    """Labelled examples as a block-max inverted index."""

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, examples: list[tuple[int, dict[int, float], int]]) -> None:
        self.vocabulary, self.idf = vocabulary, idf
        # Examples with the same leading term stand together, which keeps the bounds tight.
        order = sorted(range(len(examples)), key=lambda i: (max(examples[i][1], key=lambda t: (examples[i][1][t], -t), default=-1), examples[i][0]))
        self.ids = np.array([examples[i][0] for i in order], np.int64)
        self.labels = np.array([examples[i][2] for i in order], np.float64)
        self.blocks = -(-len(order) // BLOCK)
        self.tops = np.zeros((self.blocks, len(idf)))
        postings: dict[int, list[tuple[int, float]]] = {}
        for at, i in enumerate(order):
            for term, weight in examples[i][1].items():
                postings.setdefault(term, []).append((at, weight))
                self.tops[at // BLOCK, term] = max(self.tops[at // BLOCK, term], weight)
        self.postings = {}
        for term, entries in postings.items():
            at = np.array([e[0] for e in entries])
            bounds = np.searchsorted(at // BLOCK, np.arange(self.blocks + 1))
            self.postings[term] = (at % BLOCK, np.array([e[1] for e in entries]), bounds)
        self.prior = (self.labels.sum() + 1) / (len(order) + 2) if order else 0.0
        self.slope, self.shift = 1.0, 0.0
        self.memo: dict[tuple, tuple] = {}

    @staticmethod
    def vector(counts: dict[int, int], idf: np.ndarray) -> dict[int, float]:
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()} if norm else {}

    def nearest(self, query: dict[int, float], k: int = NEIGHBOURS, skip: int = -1) -> list[tuple[float, int]]:
        """The k best (cosine, place) with cosine above 0, exactly; ties go to the lower place."""
        if not query or not self.blocks:
            return []
        terms = np.fromiter(query, int)
        bounds = self.tops[:, terms] @ np.fromiter(query.values(), float)
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] <= 0 or len(best) == k and bounds[block] < -best[-1][0] - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for term, weight in query.items():
                if term in self.postings:
                    at, weights, starts = self.postings[term]
                    span = slice(starts[block], starts[block + 1])
                    scores[at[span]] += weight * weights[span]
            hits = np.flatnonzero(scores > 0)
            found = [(-scores[i], int(block) * BLOCK + int(i)) for i in hits if int(block) * BLOCK + int(i) != skip]
            best = sorted(best + found)[:k]
        return [(-s, at) for s, at in best]

    def odds(self, near: list[tuple[float, int]]) -> float:
        """Log odds of the votes, each the square of its cosine, beside a few votes at the prior."""
        votes = np.array([s * s for s, _ in near])
        marks = self.labels[[at for _, at in near]] if near else np.empty(0)
        yes = float((votes * marks).sum()) + PRIOR_VOTES * self.prior
        no = float((votes * (1 - marks)).sum()) + PRIOR_VOTES * (1 - self.prior)
        return math.log(max(yes, 1e-9) / max(no, 1e-9))

    def calibrate(self, vectors: list[dict[int, float]]) -> None:
        """Fit the slope and shift of the odds on the examples, each without its own vote."""
        if not len(self.ids) or self.labels.min() == self.labels.max():
            return
        where = {int(d): at for at, d in enumerate(self.ids)}
        x = np.array([self.odds(self.nearest(v, skip=where[d])) for d, v in vectors])
        y = np.array([self.labels[where[d]] for d, _ in vectors])
        pos, neg = y.sum(), len(y) - y.sum()
        goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        design, beta = np.column_stack([x, np.ones_like(x)]), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            slope = design.T @ (p - goal) + 1e-3 * (beta - [1.0, 0.0])
            curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            move = np.linalg.solve(curve, slope)
            beta = beta - move
            if abs(move).max() < 1e-9:
                break
        if beta[0] > 0:
            self.slope, self.shift = map(float, beta)

    def score(self, text: str) -> tuple[float, list[int], list[float]]:
        """Score, and the evidence: ids and cosines of the neighbours."""
        counts = self.vocabulary.counts(text)
        key = tuple(counts.items())
        if key not in self.memo:
            near = self.nearest(self.vector(counts, self.idf))
            value = 0.0 if not self.blocks else 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.odds(near) + self.shift))))
            if len(self.memo) > 10_000:
                self.memo.clear()
            self.memo[key] = (value, [int(self.ids[at]) for _, at in near], [s for s, _ in near])
        return self.memo[key]


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS) -> Index:
    """The index of at most `examples` labelled documents over at most `terms` terms.

    Null texts read as empty. Of several rows sharing a doc_id the greatest
    text and the greatest label are used, so repeated rows count once; labels
    without a document add nothing. Term frequencies are counted over all rows.
    """
    chosen = F.broadcast(training_rows(labels, examples).withColumnRenamed("doc_id", "example_id"))
    texts = docs.select("doc_id", whole_text().alias("text"))
    # One text per id: of several rows with one id the greatest.
    held = texts.join(chosen, F.col("doc_id") == F.col("example_id")).groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
    held = checkpointed(held)
    marked = choose_terms(held, terms)
    chosen_terms = [t for t, _ in marked]
    total, seen = document_frequencies(docs, chosen_terms) if chosen_terms else (0, {})
    idf = np.array([lift * math.log(1 + total / (1 + seen.get(i, 0))) for i, (_, lift) in enumerate(marked)])

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(chosen_terms)
        for frame in frames:
            found = [vocabulary.counts(t) for t in frame["text"]]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "label": frame["label"],
                "term": [list(c) for c in found], "n": [list(c.values()) for c in found],
            })

    rows = held.mapInPandas(weigh, "doc_id bigint, label int, term array<int>, n array<int>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    vectors = [(r["doc_id"], Index.vector(dict(zip(r["term"], r["n"], strict=True)), idf)) for r in rows]
    index = Index(Vocabulary(chosen_terms), idf, [(d, v, int(r["label"] > 0)) for (d, v), r in zip(vectors, rows, strict=True)])
    index.calibrate(vectors)
    return index


def scored(spark: SparkSession, docs: DataFrame, index: Index) -> DataFrame:
    """Per row: doc_id, score, predicted and the evidence (neighbour ids and cosines).

    The score depends on the text alone, so equal texts have equal scores; null
    and empty texts score as texts without marked terms. Without labelled rows
    every score is 0. Rows are scored where they lie.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(index))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pickle.loads(sent.value)
        for frame in frames:
            found = [model.score(text) for text in frame["text"]]
            values = [f[0] for f in found]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64"), "score": values, "predicted": [int(v >= 0.5) for v in values],
                "neighbours": [f[1] for f in found], "cosines": [f[2] for f in found],
            })

    schema = "doc_id bigint, score double, predicted int, neighbours array<bigint>, cosines array<double>"
    return docs.select("doc_id", whole_text().alias("text")).mapInPandas(run, schema)


def accepted(spark: SparkSession, docs: DataFrame, index: Index, limit: float = 0.5) -> DataFrame:
    """The documents that score below the limit, with all their columns; nothing is shuffled.

    Null and empty texts are scored as the empty text. Every row is scored on
    its own, so repeated rows are kept or dropped alike; a score equal to the
    limit drops the row. An empty table gives an empty one.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(index))

    def below(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = pickle.loads(sent.value)
        for batch in texts:
            yield pd.Series([model.score(text)[0] < limit for text in batch], dtype=bool)

    return docs.filter(F.pandas_udf(below, "boolean")(whole_text()))
