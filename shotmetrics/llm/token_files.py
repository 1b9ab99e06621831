"""Token ids in segment files with Elias-Fano document boundaries.

A segment is one row of a Parquet file: the concatenated ids of up to
SEGMENT_IDS ids or more for one long document, and where its documents end.
Ends rise, so they are stored as an Elias-Fano sequence: the low bits of each
end packed side by side, the high bits as a unary bit vector, and every
SAMPLE-th one's place, from which select() finds a document's end without a
table of 64-bit offsets. Spark's own writer commits the files, so lost tasks
are run again without leaving parts behind.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import parallel_parts, whole_text

END_ID = 2
SEGMENT_IDS = 1 << 18
SAMPLE = 64
# New words are no longer kept once the kept words and their ids hold this many bytes; they are then asked each time.
CACHED_BYTES = 24 << 20
# Texts are encoded together up to this many UTF-8 bytes (a longer text alone).
ENCODED_BYTES = 4 << 20
# Fixed value: how the byte-level vocabulary writes a space.
_SPACE = "\u0120"
SEGMENT_SCHEMA = (
    "part int, segment int, n_docs int, n_ids bigint, id_bytes int, low_bits int, "
    "doc_ids array<bigint>, low binary, high binary, samples binary, ids binary"
)

_SEGMENT_NAMES = [field.split()[0] for field in SEGMENT_SCHEMA.split(", ")]
_SEGMENT_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4]


def elias_fano(ends: np.ndarray, top: int) -> tuple[int, bytes, bytes, bytes]:
    """Low bit width, low bits, high bits and select samples of a rising sequence of values up to top."""
    n = len(ends)
    width = max(0, int(top // max(n, 1)).bit_length() - 1)
    values = ends.astype(np.uint64)
    low = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    pack = lambda bits: np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return width, pack(low), pack(high), ones[::SAMPLE].astype("<u4").tobytes()


def select_values(width: int, low: bytes, high: bytes, samples: bytes, places: np.ndarray) -> np.ndarray:
    """The values at the places of an Elias-Fano sequence, each found from its nearest sample."""
    bits = np.unpackbits(np.frombuffer(high, np.uint8), bitorder="little")
    starts = np.frombuffer(samples, "<u4").astype(np.int64)
    out = np.empty(len(places), np.int64)
    lows = np.unpackbits(np.frombuffer(low, np.uint8), bitorder="little")
    scale = 1 << np.arange(width, dtype=np.int64)
    for block in np.unique(places // SAMPLE):
        stop = starts[block + 1] if block + 1 < len(starts) else len(bits)
        ones = starts[block] + np.flatnonzero(bits[starts[block] : stop])
        mine = np.flatnonzero(places // SAMPLE == block)
        at = places[mine]
        upper = ones[at - block * SAMPLE] - at
        lower = lows[at[:, None] * width + np.arange(width)].astype(np.int64) @ scale if width else 0
        out[mine] = (upper << width) + lower
    return out


def _worker_cache(name: str) -> types.SimpleNamespace:
    """A place that lives as long as the Python worker."""
    return sys.modules.setdefault(f"_llm_cache_{name}", types.SimpleNamespace())


class WordEncoder:
    """Encodes texts with the tokenizer, asking it only once for each word.

    The byte-level pattern always starts a new piece at a space that a visible
    character follows, and merges stay inside pieces; so ids of the words
    between single spaces, each with its space, join to the ids of the text.
    New words are asked together, as one text: each starts with the only one
    of its ids that holds a space. Texts with other white space beside a space,
    or none, and texts that hold an added token are given to the tokenizer whole.
    """

    def __init__(self, path: str, id_type: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.id_type = np.dtype(id_type)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(_SPACE)]] = True
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.id_type).tobytes() for e in found]

    def words(self, new: list[str]) -> list[bytes]:
        """Ids of the words, each as after a space; no word is empty or begins with white space."""
        if not new:
            return []
        text = " " + " ".join(new)
        if any(token in text for token in self.added):
            return self.whole([" " + w for w in new])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.id_type)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(new):
            return self.whole([" " + w for w in new])
        raw, cuts = ids.tobytes(), [*(starts * self.id_type.itemsize).tolist(), len(ids) * self.id_type.itemsize]
        return [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        parts = pc.split_pattern(texts, " ")
        ends = parts.offsets.to_numpy().tolist()
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        table = list(map(self.known.get, words))
        new = [w for w, ids in zip(words, table, strict=True) if ids is None and w and not w[0].isspace()]
        fresh = dict(zip(new, self.words(new), strict=True))
        if self.known_bytes < CACHED_BYTES:
            self.known.update(fresh)
            # Python's own overhead of a short string and a bytes object is about a hundred bytes.
            self.known_bytes += sum(len(w) + len(ids) + 100 for w, ids in fresh.items())
        # What is left None is empty or begins with white space: such texts are encoded whole.
        table = [fresh.get(w) if ids is None else ids for w, ids in zip(words, table, strict=True)]
        pieces = list(map(table.__getitem__, coded.indices.to_numpy().tolist()))
        heads = self.whole([words[i] for i in coded.indices.take(parts.offsets[:-1]).to_pylist()])
        out: list[bytes | None] = []
        for head, x, y in zip(heads, ends, ends[1:], strict=False):
            rest = pieces[x + 1 : y]
            out.append(None if None in rest else head + b"".join(rest))
        for token in self.added:
            for i in np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)).tolist():
                out[i] = None
        odd = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(odd, self.whole(texts.take(pa.array(odd, pa.int64())).to_pylist()), strict=True):
            out[i] = ids
        return out


def _encoder(path: str, id_type: str) -> WordEncoder:
    cache = _worker_cache("encoders")
    if (path, id_type) not in vars(cache).setdefault("made", {}):
        cache.made[path, id_type] = WordEncoder(path, id_type)
    return cache.made[path, id_type]


def _segment(part: int, number: int, doc_ids: list, blobs: list[bytes], id_bytes: int) -> pa.RecordBatch:
    ends = np.cumsum([len(b) // id_bytes for b in blobs])
    width, low, high, samples = elias_fano(ends, int(ends[-1]))
    row = [part, number, len(blobs), int(ends[-1]), id_bytes, width, doc_ids, low, high, samples, b"".join(blobs)]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _SEGMENT_TYPES, strict=True)], _SEGMENT_NAMES)


def token_segments(docs: DataFrame, tokenizer: str, id_bytes: int = 2, end_id: int = END_ID) -> DataFrame:
    """One row per segment, in ascending doc_id over (part, segment).

    Documents are dealt into ranges of doc_id; a null id comes first, rows with
    equal ids follow each other in order of their text. A null text has the end
    id alone. id_bytes is 2 for vocabularies up to 65,536 ids, else 4.
    """
    id_type = {2: "<u2", 4: "<u4"}[id_bytes]
    parts = parallel_parts(docs.sparkSession)
    # Ranges of (doc_id, text): rows with one id, or none, can fill several tasks.
    rows = docs.select("doc_id", whole_text().alias("text")).repartitionByRange(parts, "doc_id", "text")
    rows = rows.withColumn("part", F.spark_partition_id()).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, id_type)
        end = np.array([end_id], id_type).tobytes()
        number, held, part, doc_ids, blobs = 0, 0, 0, [], []
        for whole_batch in batches:
            ends = np.cumsum(pc.binary_length(whole_batch["text"]).to_numpy(zero_copy_only=False))
            cuts, at = [], 0
            while at < whole_batch.num_rows:
                base = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, base + ENCODED_BYTES, side="right")))
                cuts.append((at, stop))
                at = stop
            for at, stop in cuts:
                batch = whole_batch.slice(at, stop - at)
                part = batch["part"][0].as_py()
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"]), strict=True):
                    doc_ids.append(doc_id)
                    blobs.append(ids + end)
                    held += len(ids) // id_bytes + 1
                    if held >= SEGMENT_IDS:
                        yield _segment(part, number, doc_ids, blobs, id_bytes)
                        number, held, doc_ids, blobs = number + 1, 0, [], []
        if blobs:
            yield _segment(part, number, doc_ids, blobs, id_bytes)

    return rows.mapInArrow(write, SEGMENT_SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_bytes: int = 2, end_id: int = END_ID) -> None:
    """Write the segments of the documents to a new folder."""
    token_segments(docs, tokenizer, id_bytes, end_id).write.mode("errorifexists").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each document of the files: doc_id, start, n_tokens and ids_crc32, and its place (part, segment, at).

    start counts the ids of all documents before it over all files: totals of
    parts are summed in one small window, those of segments within their part.
    """
    segments = spark.read.parquet(path)
    sums = segments.select("part", "segment", "n_ids")
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before_segment = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    by_part = sums.groupBy("part").agg(F.sum("n_ids").alias("ids")).select(
        "part", F.coalesce(F.sum("ids").over(before_part), F.lit(0)).alias("base")
    )
    starts = (
        sums.withColumn("within", F.coalesce(F.sum("n_ids").over(before_segment), F.lit(0)))
        .join(by_part, "part")
        .select("part", "segment", (F.col("base") + F.col("within")).alias("base"))
    )

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ends = select_values(row.low_bits, row.low, row.high, row.samples, np.arange(row.n_docs))
                ids = np.frombuffer(row.ids, f"<u{row.id_bytes}").astype("<u4")
                begins = np.concatenate([[0], ends[:-1]])
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
                yield pd.DataFrame({
                    "part": row.part, "segment": row.segment, "at": np.arange(row.n_docs), "doc_id": pd.array(row.doc_ids, "Int64"),
                    "offset": begins, "n_tokens": ends - begins, "ids_crc32": sums,
                })

    schema = "part int, segment int, at int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"
    found = segments.mapInPandas(read, schema)
    return found.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "part", "segment", "at"
    )


def token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document, read back through select()."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ends = select_values(row.low_bits, row.low, row.high, row.samples, np.arange(row.n_docs))
                ids = np.frombuffer(row.ids, f"<u{row.id_bytes}").astype(np.int32)
                yield pd.DataFrame({"doc_id": pd.array(row.doc_ids, "Int64"), "ids": np.split(ids, ends[:-1])})

    return spark.read.parquet(path).mapInPandas(read, "doc_id bigint, ids array<int>")
