"""Repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

from shotmetrics.llm import catalog, repeats

from .helpers import frame


def brute_force(texts, width):
    """doc -> (words, removed, kept) for texts by id."""
    first = {}
    split = {d: (t or "").encode().split() for d, t in texts.items()}
    for d in sorted(texts):
        for i in range(len(split[d]) - width + 1):
            first.setdefault(tuple(split[d][i : i + width]), d)
    out = {}
    for d, words in split.items():
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < d:
                gone.update(range(i, i + width))
        out[d] = len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    return out


def test_of_the_table(spark, small_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    want = brute_force(texts, 13)
    rows = catalog.QUERIES["op10_repeats"](spark, small_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, removed, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest()), r.doc_id
    assert sum(r.n_removed for r in rows) > 100


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_repeats(spark, seed, monkeypatch):
    # Few words and many shared passages make every case of order and overlap.
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(4, 30))) for _ in range(12)]
    texts = {}
    for d in rng.sample(range(1000), 80):
        parts = [rng.choice([rng.choice(passages), " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))]) for _ in range(rng.randint(1, 9))]
        texts[d] = "\n".join(parts)
    texts[1001], texts[1002], texts[1003] = "", None, "a " * 400
    monkeypatch.setattr(repeats, "ASKED_PER_COPY", 20)
    docs = frame(spark, list(texts.values()), list(texts))
    for width in (6, 13):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.without_repeats(docs, width).collect()}
        assert got == brute_force(texts, width)


def test_edge_rows(spark):
    assert repeats.without_repeats(frame(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(20))
    docs = frame(spark, [long, long, long, "x " + long, None], [3, 3, None, 5, 6])
    got = sorted(((r.doc_id, r.n_removed, r.n_words) for r in repeats.without_repeats(docs).collect()), key=str)
    assert got == [(3, 0, 20), (3, 0, 20), (5, 20, 21), (6, 0, 0), (None, 0, 20)]


def test_automaton_statistics():
    rng = random.Random(6)
    for _ in range(60):
        stretches = [(rng.randrange(10), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 30))]) for _ in range(6)]
        automaton = repeats.SuffixAutomaton()
        for doc, words in stretches:
            automaton.add(doc, words)
        automaton.finish()
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
        for width in (1, 2, 4):
            want = [
                i for i in range(len(words) - width + 1)
                if any(doc < 5 and words[i : i + width] == s[j : j + width] for doc, s in stretches for j in range(len(s) - width + 1))
            ]
            assert automaton.matched(5, words, width) == want


def test_matches_of_reference(spark):
    reference = frame(spark, ["one two three four five six", None, "seven eight nine"])
    docs = frame(spark, ["zero one two three four ten", "two three", None, "seven eight nine"])
    got = sorted(map(tuple, repeats.matches_of_reference(spark, docs, reference, 3).collect()))
    assert got == [(0, 1, 2), (3, 0, 0)]
    assert repeats.matches_of_reference(spark, docs, reference.limit(0), 3).count() == 0
