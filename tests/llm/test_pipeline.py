"""The stages in a row, each against brute force on what it was given."""

from __future__ import annotations

import hashlib
import re

import corpus_pipeline
from shotmetrics.llm import catalog, decontamination, toxicity

from .test_filters import distance_in, linked_components, shared_out


def test_stages_and_run(spark, small_dir, tmp_path):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    given, kept = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, small_dir)
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert set(kept[name]) <= set(given[name])

    index = toxicity.fit(spark.read.parquet(f"{small_dir}/documents.parquet"), spark.read.parquet(f"{small_dir}/labels.parquet"))
    assert set(kept["toxicity"]) == {d for d, r in given["toxicity"].items() if index.score(r.text or "")[0] < 0.5}
    marked = {r.doc_id for r in spark.read.parquet(f"{small_dir}/labels.parquet").filter("toxic = 0").collect()}
    assert len(marked & set(kept["toxicity"])) >= 0.98 * len(marked)

    groups = linked_components({d: r.text for d, r in given["near_dedup"].items()}, 5)
    assert set(kept["near_dedup"]) == {d for d, (_, c) in groups.items() if c == d}

    items = [decontamination.folded(r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    gone = set(given["decontamination"]) - set(kept["decontamination"])
    for d, r in given["decontamination"].items():
        text = decontamination.folded(r.text or "")
        if d in gone:
            assert any(distance_in(i, text)[0] <= len(i) // 20 for i in items)
        else:
            assert not any(i in text for i in items)

    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in given["mixing"].items()}
    assert sum(words[d] for d in kept["mixing"]) <= sum(words.values()) * 3 // 4
    leaves = {}
    for d, r in given["mixing"].items():
        family = "forum" if hashlib.md5(r.source.encode()).hexdigest()[0] < "8" else "press"
        leaves.setdefault((family, r.lang, r.source), []).append(d)
    caps = {k: sum(words[d] for d in v) for k, v in leaves.items()}

    def weight(path):
        stars = "/".join(["*"] * (len(path) - 1) + [path[-1]])
        return catalog.WEIGHTS.get("/".join(path), catalog.WEIGHTS.get(stars, 1))

    quota = {(): sum(caps.values()) * 3 // 4}
    for depth in range(3):
        for parent in [p for p in quota if len(p) == depth]:
            kids = {k[: depth + 1] for k in caps if k[:depth] == parent}
            shares = shared_out(quota[parent], [(k, sum(c for leaf, c in caps.items() if leaf[: depth + 1] == k), weight(k)) for k in kids])
            quota |= shares
    want = set()
    for leaf, ids in leaves.items():
        reached = 0
        for d in sorted(ids, key=lambda d: hashlib.md5(f"17:0:{d}".encode()).hexdigest()):
            reached += words[d]
            if reached <= quota[leaf]:
                want.add(d)
    assert set(kept["mixing"]) == want

    sizes = {}
    for r in kept["sharding"].values():
        sizes.setdefault(r.shard, []).append(r.slot)
    assert set(kept["sharding"]) == set(given["sharding"])
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1

    whole = {r.doc_id: (r.shard, r.slot, r.text) for r in corpus_pipeline.run(spark, small_dir).collect()}
    assert whole == {d: (r.shard, r.slot, r.text) for d, r in kept["sharding"].items()}
