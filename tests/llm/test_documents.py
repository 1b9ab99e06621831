"""Fingerprints, personal data, token files and shards against brute force in Python."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shotmetrics.llm import catalog, fingerprints, privacy, sharding, token_files

from .helpers import frame

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "",
    None,
    "one",
    "a@b.c_d@e.f mail x.y@z-1.org, 300.1.1.1 and 10.0.0.255 or 1.2.3.4.5.6.7.8",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112; +1 (377) 555-0271 then +12",
    "4111111111111111\n4111 1111 1111 1111 5",
    "  two  spaces\n \n and\ttabs  ",
    "para one is here\n\npara two is there\npara one is here",
    "para two is there\npara one is here\npara one is here",
    "x" * 30_000,
    "9" * 30_000,
    "1.2." * 4_000,
    "it's the dog's day \U0001f600 <|endoftext|> end\x1c of\x85 it",
]


@pytest.fixture(scope="module")
def small(spark, small_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]


# The base patterns as the result contract states them.
CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in CONTRACT.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p[-400:]) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check_personal(rows, texts):
    assert len(rows) == len(texts)
    for row in rows:
        want = base_spans(texts[row.doc_id])
        digest = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row.base_sha256 == hashlib.sha256(digest.encode()).hexdigest(), (row.doc_id, want)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for x, _, _ in want) for k in CONTRACT]
        assert row.spans.startswith(digest)


def test_personal_data_base_spans(spark, small, small_dir):
    check_personal(catalog.QUERIES["op7_personal_data"](spark, small_dir).collect(), dict(small))
    found = privacy.span_digest(privacy.personal_data(frame(spark, HARD)))
    check_personal(found.collect(), dict(enumerate(HARD)))
    assert privacy.personal_data(frame(spark, [])).count() == 0


def test_disclosing_terms(spark):
    texts = [f"filler{i} words stand here Zorblatt writes to ann@host{i // 2}.org daily" for i in range(6)]
    texts += ["words stand here and writes daily about nothing"] * 6
    docs = frame(spark, texts)
    found = privacy.personal_data(docs)
    # Brute force: documents holding the term, the entity, and the term near the entity.
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[0].terms is None  # every near word stands by three entities, so it discloses none
    named = [t.replace("Zorblatt", "Zorblatt" if i // 2 == 1 else "Someone") for i, t in enumerate(texts)]
    docs = frame(spark, named)
    found = privacy.personal_data(docs)
    rows = {r.doc_id: r for r in found.collect()}
    assert [named[2][t.start : t.end] for t in rows[2].terms] == ["Zorblatt"]
    assert rows[0].terms is None and rows[8].terms is None
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs, found).collect()}
    assert clean[2] == "filler2 words stand here  writes to [EMAIL] daily"
    assert clean[8] == named[8]


def test_copies_prove_nothing(spark):
    texts = ["Zorblatt writes to ann@host.org"] * 5 + ["other"]
    assert all(r.terms is None for r in privacy.personal_data(frame(spark, texts)).collect())


def test_terms_of_a_single_text(spark):
    far = "words stand here " * 20
    texts = [f"Zorblatt came {far}and wrote to ann@host.org"] + [f"{far}came and wrote to nobody {i}"  for i in range(40)]
    docs = frame(spark, [*texts, texts[0]])
    found = privacy.personal_data(docs)
    rows = {r.doc_id: r for r in found.collect()}
    assert all([(t.start, t.end, t.action) for t in rows[d].terms] == [(0, 8, "remove")] for d in (0, 41))
    assert all(rows[d].terms is None for d in range(1, 41))


def edited(texts):
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        text, after = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        cut = len(text) // 3
        yield d, text[: len(text) - cut] + after[:cut], after


@pytest.mark.parametrize("hard", [False, True])
def test_edit_likeness(spark, small, small_dir, hard):
    texts = dict(enumerate(HARD)) if hard else dict(small)
    docs = frame(spark, HARD) if hard else spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = {r.doc_id: r for r in fingerprints.edit_likeness(docs).collect()}
    assert len(rows) == len(texts)
    for d, text, after in edited(texts):
        row = rows[d]
        assert row.n_chars == len(texts[d] or "")
        assert row.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        assert (row.fingerprint == row.edited_fingerprint) == (row.near_edited == 1.0)
    by_text = {}
    for d, row in rows.items():
        by_text.setdefault(row.fingerprint, set()).add("\n".join(sorted(p for p in re.split(r"[\n\r]+", texts[d] or "") if p)))
    assert all(len(v) == 1 for v in by_text.values())
    if not hard:
        closer = np.mean([r.near_edited > r.near_next for r in rows.values()])
        assert closer > 0.97


def test_fingerprint_is_homomorphic(spark):
    texts = ["a b c d e\nf g", "h i j\nk", "k\nf g\nh i j\na b c d e", "h i j"]
    rows = {r.doc_id: r for r in fingerprints.fingerprints(frame(spark, texts)).collect()}
    both = spark.createDataFrame([(rows[0].vector, rows[1].vector, rows[2].vector, rows[3].vector)], "a array<bigint>, b array<bigint>, c array<bigint>, d array<bigint>")
    plus = both.select(fingerprints.combine(both.a, both.b).alias("v"), fingerprints.combine(both.c, both.a, -1).alias("w")).first()
    assert plus.v == rows[2].vector
    assert plus.w == rows[1].vector
    assert fingerprints.fingerprints(frame(spark, [])).count() == 0
    assert fingerprints.edit_likeness(frame(spark, [])).count() == 0


def test_likeness_of_a_word_put_in_front(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(["new", *words]), " ".join(words[:200] + words[201:]), " ".join(f"v{i}" for i in range(400))]
    rows = {r.doc_id: r.vector for r in fingerprints.fingerprints(frame(spark, texts)).collect()}
    assert rows[0][-1] == 397 and rows[1][-1] == 398
    pairs = spark.createDataFrame([(d, rows[0], rows[d]) for d in (1, 2, 3)], "d int, a array<bigint>, b array<bigint>")
    near = {r.d: r.near for r in pairs.select("d", fingerprints.likeness(pairs.a, pairs.b).alias("near")).collect()}
    assert near[1] > 0.9 and near[2] > 0.9 and near[3] < 0.5


def test_repeated_and_null_ids(spark):
    docs = frame(spark, ["a b c", "a b c", None, "z y x"], [1, 1, 2, None])
    rows = fingerprints.edit_likeness(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 1), (False, 1), (False, 2), (True, 0)]
    assert privacy.personal_data(docs).count() == 4
    assert sharding.uniform_shards(docs, 3).count() == 4


@pytest.mark.parametrize("hard", [False, True])
def test_token_files(spark, small, small_dir, tmp_path, hard):
    texts = dict(enumerate(HARD)) if hard else dict(small)
    docs = frame(spark, HARD) if hard else spark.read.parquet(f"{small_dir}/documents.parquet")
    tokenizer = Tokenizer.from_file(TOKENIZER)
    folder = str(tmp_path / "files")
    token_files.write_token_files(docs, folder, TOKENIZER)
    rows = {r.doc_id: r for r in token_files.read_documents(spark, folder).collect()}
    ids = {r.doc_id: r.ids for r in token_files.token_ids(spark, folder).collect()}
    start = 0
    for d in sorted(texts):
        want = [*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 2]
        assert ids[d] == want, d
        assert (rows[d].start, rows[d].n_tokens) == (start, len(want))
        assert rows[d].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)


def test_added_tokens_as_the_library_reads_them():
    texts = ["foo <|endoftext|> bar", "a<|endoftext|>b c", "foo bar", "<|endoftext|>", "it is <| endoftext|> x"]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [21943, 220, 50256, 2318]
    encoder = token_files.WordEncoder(TOKENIZER, "<u2")
    for _ in range(2):
        assert [np.frombuffer(b, "<u2").tolist() for b in encoder.encode(pa.array(texts))] == want


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write_token_files(frame(spark, []), str(tmp_path / "none"), TOKENIZER)
    assert token_files.read_documents(spark, str(tmp_path / "none")).count() == 0
    token_files.write_token_files(frame(spark, ["a", "b b", "a"], [1, None, 1]), str(tmp_path / "ties"), TOKENIZER)
    rows = token_files.read_documents(spark, str(tmp_path / "ties")).collect()
    assert sorted((r.doc_id is not None, r.start) for r in rows) == [(False, 0), (True, 3), (True, 5)]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000])
def test_elias_fano_round_trip(n):
    rng = np.random.default_rng(n)
    ends = np.cumsum(rng.integers(1, 3000, n))
    width, low, high, samples = token_files.elias_fano(ends, int(ends[-1]))
    assert (token_files.select_values(width, low, high, samples, np.arange(n)) == ends).all()
    some = rng.integers(0, n, 10)
    assert (token_files.select_values(width, low, high, samples, some) == ends[some]).all()
    assert len(low) + len(high) <= n * (2 + np.log2(ends[-1] / n + 1)) / 8 + 8


def test_shards(spark, small, small_dir):
    rows = catalog.QUERIES["op9_shards"](spark, small_dir).collect()
    texts = dict(small)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes = [0] * 16
    slots = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        sizes[r.shard] += 1
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = catalog.QUERIES["op9_shards"](spark, small_dir).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_shards_edge_cases(spark):
    assert sharding.uniform_shards(frame(spark, []), 4).count() == 0
    three = sharding.uniform_shards(frame(spark, ["a", None, "b"]), 16)
    assert three.columns.count("shard") == 1 and three.count() == 3
    ties = sharding.uniform_shards(frame(spark, ["a"] * 40, [5] * 40), 4).collect()
    assert sorted((r.shard, r.slot) for r in ties) == [(s, i) for s in range(4) for i in range(10)]


def test_communication_matrix_is_exact_and_unbiased():
    blocks, shards = [30, 50, 20], [25, 25, 50]
    total = np.zeros((3, 3))
    for seed in range(400):
        m = np.array(sharding.communication_matrix(blocks, shards, seed))
        assert (m.sum(0) == shards).all() and (m.sum(1) == blocks).all()
        total += m
    assert np.allclose(total / 400, np.outer(blocks, shards) / 100, atol=0.6)
    from math import comb
    import random

    rng = random.Random(3)
    drawn = np.bincount([sharding.hypergeometric(rng, 8, 12, 6) for _ in range(6000)], minlength=7) / 6000
    assert np.allclose(drawn, [comb(8, k) * comb(12, 6 - k) / comb(20, 6) for k in range(7)], atol=0.025)


def test_sanitised_keeps_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, "mail me at someone@example.org now", "k", "c", 3), (2, None, None, None, 4), (3, "nothing here", "x", "y", 5)],
        "doc_id long, text string, text_key string, cuts string, _row int",
    )
    found = privacy.personal_data(docs)
    out = {r.doc_id: r for r in privacy.sanitised(docs, found).collect()}
    assert out[1].text == "mail me at [EMAIL] now" and (out[1].text_key, out[1].cuts, out[1]._row) == ("k", "c", 3)
    assert out[2].text is None and out[3].text == "nothing here"
    assert privacy.sanitised(docs, found).columns == docs.columns
