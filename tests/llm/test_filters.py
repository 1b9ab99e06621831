"""Near duplicates, components, decontamination and mixing against brute force in Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from shotmetrics.llm import catalog, decontamination, mixing, near_dedup
from shotmetrics.llm.components import components

from .helpers import frame


def shingle_set(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def linked_components(texts, width):
    sets = {d: shingle_set(t, width) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), find(d)) for d in texts}


def test_near_duplicates_of_the_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = linked_components(texts, 2)
    got = {r.doc_id: r for r in catalog.QUERIES["op2_near_dedup"](spark, small_dir).collect()}
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = {r.doc_id for r in near_dedup.without_near_duplicates(docs).collect()}
    assert kept == {d for d, (_, c) in linked_components(texts, 5).items() if c == d}


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = ["", None, "solo", "Solo", "x y", "y x", "x y x y"]
    for _ in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    want = linked_components(dict(enumerate(texts)), 2)
    got = near_dedup.near_duplicates(frame(spark, texts), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicate_edge_rows(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    rows = near_dedup.near_duplicates(frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "q"], [4, 4, None, 9])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in rows), key=str) == [(4, 4, True), (4, 4, True), (9, 9, True), (None, None, True)]
    two = near_dedup.near_duplicates(frame(spark, ["a b c", "x y z", "a b c", "x y z"], [1, 1, 2, 3])).collect()
    assert {(r.doc_id, r.component_id) for r in two} == {(1, 1), (2, 1), (3, 1)}


def test_sketch_fills_and_estimates():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 150, 5000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        full = near_dedup.sketch(a)
        assert (full != np.uint64(2**64 - 1)).all()
        assert (near_dedup.sketch(a[::-1]) == full).all()
    common = rng.integers(0, 2**63, 800).astype(np.uint64)
    agree = []
    for _ in range(30):
        own = rng.integers(0, 2**63, 200).astype(np.uint64)
        agree.append((near_dedup.sketch(np.concatenate([common, own[:100]])) == near_dedup.sketch(np.concatenate([common, own[100:]]))).mean())
    assert abs(np.mean(agree) - 0.8) < 0.03


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, b) for b in range(101, 140)] + [(7, 7), (3, 2)]
    pairs += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    import collections

    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    want = {}
    for start in sorted(near):
        if start not in want:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = start
                    todo += near[x]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in want.items() if near[k] - {k}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != t)))
        row = new
    best = min(row)
    return best, row.index(best)


def test_bit_parallel_distance():
    rng = random.Random(4)
    for _ in range(300):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert decontamination.search(pattern, text) == distance_in(pattern, text)


def damaged(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        i = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[i] = "#"
        elif kind == 1:
            chars.insert(i, "#")
        else:
            del chars[i]
    return "".join(chars)


def test_decontamination_against_brute_force(spark, small_dir):
    items = spark.read.parquet(f"{small_dir}/benchmark.parquet").limit(6).collect()
    rng = random.Random(9)
    texts = ["", None, "nothing to see here " * 50, "x" * 5000]
    for item in items:
        for edits in (0, 3, len(item.text) // 20, len(item.text) // 20 + 1, len(item.text) // 8):
            texts.append("Some lead in. " + damaged(rng, item.text, edits).upper().replace(" ", "\n") + " And more.")
    bench = spark.createDataFrame([(r.item_id, r.text, "clash") for r in items] + [(90, None, ""), (91, "", "")], "item_id bigint, text string, doc_id string")
    docs = frame(spark, texts)
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(spark, docs, bench).collect()}
    want = {}
    for d, text in enumerate(texts):
        for item in items:
            pattern = decontamination.folded(item.text)
            best, _ = distance_in(pattern, decontamination.folded(text or ""))
            if best <= int(len(pattern) * decontamination.ERROR_SHARE):
                want[d, item.item_id] = best
    assert {k: r.distance for k, r in got.items()} == want
    for (d, i), r in got.items():
        part = decontamination.folded(texts[d])[r.start : r.end]
        assert distance_in(decontamination.folded(next(x.text for x in items if x.item_id == i)), part)[0] == r.distance
    kept = decontamination.decontaminated(spark, docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontamination.contaminated(spark, frame(spark, []), bench).count() == 0
    assert decontamination.decontaminated(spark, docs, bench.limit(0)).count() == len(texts)


def shared_out(budget, kids):
    """Integer water filling: kids are (name, cap, weight)."""
    out, rest, todo = {}, budget, sorted(kids, key=lambda k: (k[1] / k[2], k[0]))
    heft = sum(k[2] for k in kids)
    while todo and todo[0][1] * heft <= rest * todo[0][2]:
        name, cap, weight = todo.pop(0)
        out[name], rest, heft = cap, rest - cap, heft - weight
    for name, cap, weight in todo:
        out[name] = min(cap, rest * weight // heft)
    return out


def test_mix_against_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = docs.collect()
    levels = {"language": "lang", "origin": "source"}
    weights = {"en": 1, "fr": 6, "*/src0": 5, "fr/src1": 3}
    tokens, leaves = {}, {}
    for r in rows:
        tokens[r.doc_id] = len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w])
        leaves.setdefault((r.lang, r.source), []).append(r.doc_id)
    total = sum(tokens.values())
    caps = {k: 2 * sum(tokens[d] for d in v) for k, v in leaves.items()}
    langs = sorted({k[0] for k in leaves})
    top = shared_out(total * 9 // 10, [(x, sum(c for k, c in caps.items() if k[0] == x), weights.get(x, 1)) for x in langs])
    want, quota = set(), {}
    for lang in langs:
        kids = [(s, caps[x, s], weights.get(f"{x}/{s}", weights.get(f"*/{s}", 1))) for x, s in caps if x == lang]
        for origin, part in shared_out(top[lang], kids).items():
            mine = leaves[lang, origin]
            one = sum(tokens[d] for d in mine)
            for epoch in (0, 1):
                reach, reached = min(one, part - epoch * one), 0
                for d in sorted(mine, key=lambda d: hashlib.md5(f"17:{epoch}:{d}".encode()).hexdigest()):
                    reached += tokens[d]
                    if reached <= reach and (reach > 0 or epoch == 0):
                        want.add((d, epoch, lang, origin, part))
    got = mixing.mix(docs, levels, weights, budget=(9, 10), epochs=2, seed=17).collect()
    assert {(r.row.doc_id, r.epoch, r.language, r.origin, r.quota) for r in got} == want and len(got) == len(want)
    assert sum(r.n_tokens for r in got) <= total * 9 // 10
    assert {e for _, e, *_ in want} == {0, 1}


def test_mix_edge_rows(spark):
    levels = {"language": "lang", "origin": "source"}
    assert mixing.mix(frame(spark, []), levels, {}).count() == 0
    got = mixing.mix(frame(spark, ["a b", None, "", "c d"], [1, None, 2, 1]), levels, {}, budget=(1, 1), epochs=1).collect()
    assert sorted(str(r.row.doc_id) for r in got) == ["1", "1", "2", "None"]
    assert got[0].language == ""


@pytest.mark.parametrize("cells", [((10, 1), (100, 1), (100, 2)), ((0, 3), (5, 1)), ((7, 7),)])
def test_budget_split(spark, cells):
    nodes = spark.createDataFrame([(f"n{i}", c, w, 60) for i, (c, w) in enumerate(cells)], "name string, cap bigint, weight bigint, budget bigint")
    got = {r["name"]: r["share"] for r in mixing.split_budget(nodes, [F.lit(0)], "name").collect()}
    assert got == shared_out(60, [(f"n{i}", c, w) for i, (c, w) in enumerate(cells)])
