"""Nearest labelled examples against brute-force cosine, and held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from shotmetrics.llm import toxicity

from .helpers import frame

LABELS = "doc_id bigint, quality int, toxic int, text string"
BAD = ["grumf", "snarkel", "blorf", "wuzzock"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ala", "omo", "ine", "uru", "ete")]
    texts, marks = [], []
    for _ in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.15
        for _ in range(rng.randint(1, 4) * bad):
            text.insert(rng.randrange(len(text)), rng.choice(BAD) + rng.choice(["", "ig", "ast", "###"]))
        texts.append(" ".join(text))
        marks.append(int(bad))
    texts += ["", None]
    labels = spark.createDataFrame([(i, 1, m, "clash") for i, m in enumerate(marks)] + [(None, 1, 1, ""), (5000, 0, 1, ""), (3, 1, None, "")], LABELS)
    docs = frame(spark, texts)
    return texts, marks, docs, labels, toxicity.fit(docs, labels)


def test_held_out_accuracy(spark, corpus):
    texts, marks, docs, labels, index = corpus
    rows = {r.doc_id: r for r in toxicity.scored(spark, docs, index).collect()}
    assert len(rows) == len(texts)
    held = [i for i in range(len(marks)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([rows[i].predicted == marks[i] for i in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert rows[900].score == rows[901].score < 0.5
    kept = toxicity.accepted(spark, docs, index)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in rows.items() if not r.predicted}


def test_labels_of_the_held_out_fifth_are_not_read(spark, corpus):
    _, marks, _, labels, _ = corpus
    ids = {r.doc_id for r in toxicity.training_rows(labels).collect()}
    assert ids == {i for i in [*range(len(marks)), 5000] if zlib.crc32(str(i).encode()) % 5 != 0}
    assert toxicity.training_rows(labels, 10).count() == 10


def test_nearest_is_exact(corpus):
    texts, _, _, _, index = corpus
    vectors = {}
    for term, (at, weights, starts) in index.postings.items():
        for block in range(index.blocks):
            for i, w in zip(at[starts[block] : starts[block + 1]], weights[starts[block] : starts[block + 1]], strict=True):
                vectors.setdefault(block * toxicity.BLOCK + int(i), {})[term] = w
    asked = 0
    for text in texts:
        query = index.vector(index.vocabulary.counts(text or ""), index.idf)
        every = sorted(((-sum(w * v.get(t, 0) for t, w in query.items()), at) for at, v in vectors.items()))
        want = [-s for s, _ in every if s < 0][: toxicity.NEIGHBOURS]
        got = index.nearest(query)
        assert np.allclose([s for s, _ in got], want)
        asked += bool(want)
    assert asked > 100
    assert all(math.isclose(sum(w * w for w in v.values()), 1) for v in vectors.values())


def test_without_labels_or_documents(spark, corpus):
    texts, _, docs, labels, index = corpus
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.scored(spark, docs, none).collect()} == {0.0}
    one_class = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert all(r.score < 0.5 for r in toxicity.scored(spark, docs, one_class).collect())
    assert toxicity.scored(spark, docs.limit(0), index).count() == 0
    twice = frame(spark, [texts[0], texts[0], None], [1, None, 1])
    rows = toxicity.scored(spark, twice, index).collect()
    assert len({r.score for r in rows if r.score != rows[2].score}) <= 1 and len(rows) == 3
