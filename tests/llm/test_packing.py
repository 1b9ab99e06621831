from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from shotmetrics.llm import packing

from .helpers import frame

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _check_plan(counts, capacity):
    patterns = packing.plan(counts, capacity)
    used = defaultdict(int)
    for times, contents in patterns:
        assert times > 0 and sum(x * k for x, k in contents) <= capacity
        for x, k in contents:
            used[x] += times * k
    assert dict(used) == {x: n for x, n in counts.items() if n}
    return patterns


def one_by_one_best_fit(lengths, capacity):
    """Best fit decreasing, piece by piece: the room of each sequence."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            i = min(fits, key=lambda i: (rooms[i], i))
            rooms[i] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


def test_plan_holds_every_piece_once():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([16, 37, 100])
        counts = defaultdict(int)
        for _ in range(rng.randint(0, 12)):
            counts[rng.randint(1, capacity)] += rng.randint(1, 9)
        _check_plan(dict(counts), capacity)


def test_exact_complements_fill_and_best_fit_equals_piecewise():
    assert packing.plan({60: 3, 40: 3}, 100) == [(3, ((60, 1), (40, 1)))]
    assert packing.plan({50: 2, 30: 1, 20: 1}, 100)[0] == (1, ((50, 2),))
    assert packing.plan({70: 1, 10: 3}, 100) == [(1, ((70, 1), (10, 3)))]
    rng = random.Random(9)
    for _ in range(200):
        capacity = rng.choice([20, 50])
        rest = np.zeros(capacity + 1, np.int64)
        for _ in range(rng.randint(1, 6)):
            rest[rng.randint(1, capacity)] += rng.randint(1, 7)
        groups = packing._best_fit(rest, capacity)
        rooms = sorted(capacity - sum(x * k for x, k in contents) for times, contents in groups for _ in range(times))
        lengths = [x for x in range(capacity + 1) for _ in range(int(rest[x]))]
        assert rooms == one_by_one_best_fit(lengths, capacity)


def test_dense_histogram_is_near_the_bound():
    rng = random.Random(3)
    counts = {x: rng.randint(1, 50) for x in range(1, 4097)}
    patterns = _check_plan(counts, 4096)
    total = sum(x * n for x, n in counts.items())
    assert sum(t for t, _ in patterns) <= 1.05 * total / 4096


def test_packed_documents(spark):
    long_text = " ".join(f"w{i}" for i in range(5000))
    texts = ["Hello there.", None, "", long_text, "Hello there.", "a b c " * 700, "x"]
    ids = [5, 6, 7, 8, 5, None, 9]
    docs = frame(spark, texts, ids)
    rows = packing.packed(docs, TOKENIZER, capacity=512, end_id=1).collect()
    tok = Tokenizer.from_file(TOKENIZER)
    want = defaultdict(list)
    for d, t in zip(ids, texts, strict=True):
        all_ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for j, s in enumerate(range(0, len(all_ids), 512)):
            want[d].append((j, s, len(all_ids[s : s + 512]), zlib.crc32(all_ids[s : s + 512].tobytes())))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for placed in by_sequence.values():
        placed.sort()
        at = 0
        for offset, length in placed:
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 512) + 1


def test_empty_table(spark):
    assert packing.packed(frame(spark, []), TOKENIZER).count() == 0


def test_words_are_asked_once_and_give_the_ids_of_whole_texts(spark, small_dir, monkeypatch):
    texts = [r.text or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("text").limit(300).collect()]
    texts += ["", "it's the dog's day \U0001f600 <|endoftext|> end\x1c of\x85 it", "e ́x ΣΑΣ İ 'S'll x'd ﬀ Ⅷ",
              "<|endof <|endoftext|>tail<|startoftext|>x |> <|", "\t\n 12 3.4.5\r\n\x0b\x0cx\x1fy z", "x" * 30_000, "H\u0331x. HÉ, É;; É×, ×. ’, a!,b .,a a.b.c",
              "It'S, THE 'LL! \u212a A <|a.endoftext|>. <|EndofText|>!", "<|startoftext|"]
    encoder = packing.WordIds(TOKENIZER)
    assert encoder.apart
    plain = Tokenizer.from_file(TOKENIZER)
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    asked = []
    ask = encoder.asked
    monkeypatch.setattr(encoder, "asked", lambda new: asked.extend(new) or ask(new))
    raw = [t.encode() for t in texts]
    assert encoder(raw[:100]) + encoder(raw[100:]) + encoder(raw[-7:]) == want + want[-7:]
    assert len(asked) == len(set(asked)) == len({w for t in raw for w in encoder.words(t)})
    monkeypatch.setattr(packing, "KEPT_BYTES", 0)
    fresh = packing.WordIds(TOKENIZER)
    assert fresh(raw[:100]) + fresh(raw[100:]) == want and not fresh.known
    # A tokenizer whose pieces hold spaces gets whole texts.
    other = packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.apart
    byte_level = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert other(raw) == [np.array(byte_level.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
