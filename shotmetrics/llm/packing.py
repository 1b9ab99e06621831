"""Packing of token pieces into fixed-size sequences: exact complements first, then best fit.

A document's ids (its text by the tokenizer, then the end id) are cut into
pieces of at most `capacity` ids; only documents longer than that are cut,
and only the last piece is shorter. Which sequence a piece goes to depends on
its length alone, so the plan is made over the counts of pieces per length,
a table of at most `capacity` rows whatever the size of the corpus:

1. Exact complements. Lengths are taken from the largest down; for a length L
   the gap `capacity - L` is looked up as one length, a pair of lengths or a
   triple of lengths whose sum is the gap (singles by the count table, pairs
   by complement lookups in it, triples through a table of which pair sums
   exist at all, each found candidate verified against the counts). A found
   combination is taken as many times as the counts allow at once, each time
   filling a sequence exactly.
2. Best fit, decreasing. What found no exact complement goes, longest first,
   into the open sequence with the least room that still holds it, else into
   a new one. Open sequences with equal contents are kept as one group with a
   count, and a run of equal pieces is placed a whole group at a time, which
   is what placing them one by one would do.

The plan is a list of patterns (which lengths, how many of each, how many
sequences). Pieces are numbered within their length by salted buckets (a hot
length is spread over all tasks) and joined to the pattern rows that cover
their number; that table is bounded by the plan, not the corpus, and is
broadcast only under a checked row count.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotmetrics.operators.lineage import checkpointed

from .shared import parallel_parts, whole_text

# Fixed values of the result contract: sequence size and the id ending each document.
CAPACITY = 4096
END_ID = 1
# Texts encoded together in one call, by their UTF-8 bytes.
BATCH_BYTES = 4 << 20
# New words are no longer kept once the kept words and their ids hold this many bytes; they are then asked each batch.
KEPT_BYTES = 48 << 20
# Normalizer and pattern of a tokenizer whose pieces never hold or look across white space.
_APART_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_APART_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Pattern rows above this are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 200_000
PIECES = "doc_id long, row_id long, piece int, start long, length long, ids_crc32 long"
# A stop mark after a-z, A-Z or a letter of U+00C0 to U+00FF.
_STOP = re.compile(rb"[.,;:!?](?:(?<=[A-Za-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")


def _words_apart(spec: dict) -> bool:
    """Whether the words between ASCII white space can be encoded each on its own.

    Known for one form of tokenizer: white space becomes a space, which no
    piece holds and no alternative of the pattern looks at; composing and
    lower-casing characters do not reach over it.
    """
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [n["type"] for n in steps] == _APART_NORMALIZER
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [p["type"] for p in splits] == ["Split", "ByteLevel"]
        and (splits[0]["pattern"], splits[0]["behavior"], splits[0]["invert"]) == ({"Regex": _APART_PATTERN}, "Removed", True)
        and not splits[1]["use_regex"]
        and not splits[1]["add_prefix_space"]
        and not spec.get("truncation")
        and not spec.get("padding")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]] for t in spec["added_tokens"])
    )


class WordIds:
    """Ids of whole texts as little-endian uint32 bytes, the tokenizer asked once for each word.

    The ids of a text are those of its words, one after another, where
    `_words_apart` holds; other tokenizers get the whole texts. New words are asked as one text, with an added token between them
    that marks where a word's ids end; words that hold an added token are asked
    on their own.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.apart = _words_apart(spec)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.added_bytes = [token.lower().encode() for token in self.added]
        self.known: dict[bytes, bytes] = {}
        self.known_bytes = 0

    def words(self, text: bytes) -> list[bytes]:
        """The text in words that have its ids, with as few spellings of a word as is safe.

        A-Z are lower-cased first, unless a mark that could compose with them or
        an added token stands in the text, and a stop mark after a Latin letter
        begins a word, as it begins a piece.
        """
        lower = text.lower()
        if b"\xcc" not in text and b"\xcd" not in text and not any(token in lower for token in self.added_bytes):
            text = lower
        return _STOP.sub(rb" \g<0>", text).split()

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def asked(self, new: list[bytes]) -> list[bytes]:
        words = [w.decode() for w in new]
        text = " ".join(words)
        if not self.added or any(token in text for token in self.added):
            return self.whole(words)
        mark = self.added[-1]
        ids = np.array(self.tokenizer.encode_batch_fast([mark.join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == self.tokenizer.token_to_id(mark))
        if len(ends) != len(words) - 1:
            return self.whole(words)
        raw = ids.tobytes()
        return [raw[4 * x : 4 * y] for x, y in zip([0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)], strict=True)]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not self.apart:
            return self.whole([t.decode() for t in texts])
        split = [self.words(t) for t in texts]
        table = {w: self.known.get(w) for w in set().union(*split)}
        new = [w for w, ids in table.items() if ids is None]
        if new:
            fresh = dict(zip(new, self.asked(new), strict=True))
            table.update(fresh)
            if self.known_bytes < KEPT_BYTES:
                self.known.update(fresh)
                # Python's own overhead of two short bytes objects and their place is about 150 bytes.
                self.known_bytes += sum(len(w) + len(ids) + 150 for w, ids in fresh.items())
        return [b"".join(map(table.__getitem__, words)) for words in split]


def _word_ids(path: str) -> WordIds:
    import sys
    import types

    cache = sys.modules.setdefault("_llm_cache_packing", types.SimpleNamespace())
    if getattr(cache, "path", None) != path:
        cache.path, cache.encoder = path, WordIds(path)
    return cache.encoder


def cut(raw: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece of one document's little-endian uint32 ids."""
    parts = [(s, raw[4 * s : 4 * (s + capacity)]) for s in range(0, len(raw) // 4, capacity)]
    return [(s, len(part) // 4, zlib.crc32(part)) for s, part in parts]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, row_id (the document row), piece, start, length, ids_crc32.

    A null text is empty and gives the end id alone; rows with equal doc_ids
    stay apart by row_id. Texts go to the tokenizer in calls of at most
    BATCH_BYTES, so a batch of long texts does not hold all their ids at once.
    """
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("row_id", F.monotonically_increasing_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _word_ids(tokenizer)
        end_bytes = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, ids_col, rows_col = batch["text"].cast(pa.binary()).to_pylist(), batch["doc_id"].to_pylist(), batch["row_id"].to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_BYTES):
                    size += len(texts[end])
                    end += 1
                out = {k: [] for k in ("doc_id", "row_id", "piece", "start", "length", "ids_crc32")}
                for i, found in zip(range(at, end), encoder(texts[at:end]), strict=True):
                    for j, (start, length, crc) in enumerate(cut(found + end_bytes, capacity)):
                        for k, v in zip(out, (ids_col[i], rows_col[i], j, start, length, crc), strict=True):
                            out[k].append(v)
                yield pa.RecordBatch.from_pydict(
                    out,
                    pa.schema([("doc_id", pa.int64()), ("row_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                               ("length", pa.int64()), ("ids_crc32", pa.int64())]),
                )
                at = end

    return rows.mapInArrow(encode, PIECES)


def _merged(lengths: list[int]) -> tuple[tuple[int, int], ...]:
    """A bin's contents as (length, count), longest first."""
    out: dict[int, int] = {}
    for x in sorted(lengths, reverse=True):
        out[x] = out.get(x, 0) + 1
    return tuple(out.items())


def _complement(c: np.ndarray, anchor: int, capacity: int) -> tuple[int, ...] | None:
    """Lengths of one, two or three available pieces that fill the anchor's gap exactly, or None."""
    g = capacity - anchor

    def have(combo: tuple[int, ...]) -> bool:
        need: dict[int, int] = {anchor: 1}
        for x in combo:
            need[x] = need.get(x, 0) + 1
        return all(c[x] >= k for x, k in need.items())

    if g <= 0:
        return None
    if have((g,)):
        return (g,)
    # Pairs a <= b, the most even first; the complement of a is looked up, not searched.
    a = np.arange(g // 2, 0, -1)
    b = g - a
    ok = (c[a] >= 1 + (a == b) + (a == anchor)) & (c[b] >= 1 + (a == b) + (b == anchor))
    if ok.any():
        i = int(np.argmax(ok))
        return (int(a[i]), int(b[i]))
    # Triples a <= b <= d: the pair sums that exist at all, then exact checks.
    present = (c > 0).astype(np.float64)
    size = 2 * len(c)
    pair_sums = np.fft.irfft(np.fft.rfft(present, size) ** 2, size) > 0.5
    for x in range(g // 3, 0, -1):
        if not c[x] or not pair_sums[g - x]:
            continue
        b = np.arange(x, (g - x) // 2 + 1)
        d = g - x - b
        need_b = 1 + (b == x) + (b == d) + (b == anchor)
        need_d = 1 + (d == x) + (d == b) + (d == anchor)
        ok = (c[b] >= need_b) & (c[d] >= need_d) & (c[x] >= 1 + (b == x) + (d == x) + (x == anchor))
        if ok.any():
            i = int(np.argmax(ok))
            return (x, int(b[i]), int(d[i]))
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns (number of sequences, ((length, pieces of it in each), ...)) that hold every counted piece once."""
    c = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        c[int(length)] += int(n)
    patterns: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    if c[capacity]:
        patterns.append((int(c[capacity]), ((capacity, 1),)))
        c[capacity] = 0
    rest = np.zeros_like(c)
    for anchor in range(capacity - 1, 0, -1):
        while c[anchor]:
            combo = _complement(c, anchor, capacity)
            if combo is None:
                rest[anchor], c[anchor] = c[anchor], 0
                break
            contents = _merged([anchor, *combo])
            times = min(int(c[x]) // k for x, k in contents)
            for x, k in contents:
                c[x] -= times * k
            patterns.append((times, contents))
    return patterns + _best_fit(rest, capacity)


def _best_fit(rest: np.ndarray, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best fit, decreasing, over counts; open sequences with equal contents form one group."""
    groups: list[list] = []  # [sequences, contents, room]
    open_by_room: list[tuple[int, int]] = []  # (room, group number), sorted
    for length in range(capacity, 0, -1):
        k = int(rest[length])
        while k:
            at = bisect.bisect_left(open_by_room, (length, -1))
            if at == len(open_by_room):
                each = capacity // length
                full, part = divmod(k, each)
                for times, m in ((full, each), (1 if part else 0, part)):
                    if times:
                        groups.append([times, ((length, m),), capacity - m * length])
                        bisect.insort(open_by_room, (capacity - m * length, len(groups) - 1))
                break
            room, g = open_by_room[at]
            times, contents, _ = groups[g]
            each = room // length
            whole = min(times, k // each)
            moved = [(whole, each)] if whole else []
            if k - whole * each and times > whole:
                moved.append((1, k - whole * each))
            for n, m in moved:
                groups.append([n, (*contents, (length, m)), room - m * length])
                bisect.insort(open_by_room, (room - m * length, len(groups) - 1))
                groups[g][0] -= n
                k -= n * m
            if groups[g][0] == 0:
                open_by_room.remove((room, g))
    return [(n, contents) for n, contents, _ in groups if n]


def plan_rows(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last + 1, per sequence, first sequence, offset) for the numbers of pieces of each length."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for times, contents in patterns:
        offset = 0
        for length, each in contents:
            first = taken.get(length, 0)
            taken[length] = first + times * each
            out.append((length, first, first + times * each, each, sequence, offset))
            offset += length * each
        sequence += times
    return out


def numbered(spark: SparkSession, cut_pieces: DataFrame) -> DataFrame:
    """The pieces with `number`: 0, 1, ... within their length, by (doc_id, row_id, piece).

    Pieces are spread over salted buckets; counts per (length, bucket) give
    each bucket its first number, and a window numbers the rows of one
    bucket. A length holding most pieces is thus split over all buckets.
    """
    buckets = 4 * parallel_parts(spark)
    salted = cut_pieces.withColumn("bucket", F.pmod(F.xxhash64("row_id", "piece"), F.lit(buckets)))
    sizes = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    firsts = sizes.withColumn(
        "first", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ).select("length", "bucket", F.coalesce("first", F.lit(0)).alias("first"))
    # At most capacity x buckets rows.
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "row_id", "piece")
    return (
        salted.join(F.broadcast(firsts), ["length", "bucket"])
        .withColumn("number", F.col("first") + F.row_number().over(within) - 1)
        .drop("bucket", "first")
    )


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0 in its sequence).

    The pieces are written once to the shared checkpoint folder; only the
    count per length (at most `capacity` rows) reaches the driver. An empty
    table gives no rows; equal or null doc_ids and equal texts are packed as
    separate documents.
    """
    spark = docs.sparkSession
    cut_pieces = checkpointed(pieces(docs, tokenizer, capacity, end_id))
    counts = {r.length: r.n for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan_rows(plan(counts, capacity))
    schema = "length long, first long, last long, each long, sequence long, offset long"
    table = spark.createDataFrame(rows, schema)
    table = F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table
    p, t = numbered(spark, cut_pieces).alias("p"), table.alias("t")
    placed = p.join(t, (F.col("p.length") == F.col("t.length")) & (F.col("p.number") >= F.col("t.first")) & (F.col("p.number") < F.col("t.last")))
    return placed.select(
        F.col("p.doc_id").alias("doc_id"),
        F.col("p.piece").alias("piece"),
        F.col("p.start").alias("start"),
        F.col("p.length").alias("length"),
        F.col("p.ids_crc32").alias("ids_crc32"),
        F.expr("t.sequence + (p.number - t.first) div t.each").cast("bigint").alias("sequence_id"),
        F.expr("t.offset + ((p.number - t.first) % t.each) * p.length").cast("bigint").alias("offset"),
    )
