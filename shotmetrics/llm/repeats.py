"""Repeated passages: suffix automata of reference shards, documents streamed for matching statistics.

A window of WIDTH words is repeated when its words also start in a document
with a smaller id. Each window is represented by the least hash among the
K-word pieces in it, so equal windows have equal representatives and a document
has few of them. For each representative the document with the least id is the
reference. References are dealt into shards; a shard's task builds one suffix
automaton over the words of its references, whose states know the least document
they stand in, and streams the stretches of the other documents that share
representatives with them. A reference that many documents ask for is copied to
several shards. Windows their reference does not hold are settled among
themselves by a digest of their words, since a smaller document that holds
such a window has it unsettled too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotmetrics.operators.lineage import checkpointed

from .near_dedup import mixed
from .shared import parallel_parts, whole_text

WIDTH = 13
PIECE_WORDS = 5
# Representatives that one copy of a reference serves, and that one shard holds on average.
ASKED_PER_COPY = 4_000
ASKED_PER_SHARD = 20_000
# Words of a broadcast automaton.
REFERENCE_WORDS = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Representatives:
    """For each window of a text's words the hash that represents it."""

    def __init__(self, width: int) -> None:
        self.width, self.piece = width, min(PIECE_WORDS, width)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(words) < self.width:
            return np.empty(0, np.int64)
        codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        pieces = np.zeros(len(words) - self.piece + 1, np.uint64)
        for i in range(self.piece):
            pieces = mixed(pieces * _STEP + codes[i : i + len(pieces)])
        # Least of so many neighbours: spans double until one more overlapping pair covers them.
        span, wanted = 1, self.width - self.piece + 1
        while span < wanted:
            step = min(span, wanted - span)
            pieces = np.minimum(pieces[:-step], pieces[step:])
            span += step
        return pieces.view(np.int64)


class SuffixAutomaton:
    """All word sequences of the references, each with the least document it stands in."""

    def __init__(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 63]

    def add(self, doc: int, words: list[bytes]) -> None:
        """One more stretch; stretches of several documents do not run into each other."""
        codes, follow, link, length, least = self.codes, self.next, self.link, self.length, self.least
        last = 0
        for word in words:
            code = codes.setdefault(word, len(codes))
            at = follow[last].get(code)
            if at is not None and length[at] == length[last] + 1:
                last = at
                least[last] = min(least[last], doc)
                continue
            state = len(length)
            split_only = at is not None
            if not split_only:
                follow.append({})
                link.append(0)
                length.append(length[last] + 1)
                least.append(doc)
            p = last
            while p >= 0 and code not in follow[p]:
                follow[p][code] = state
                p = link[p]
            if p >= 0:
                q = follow[p][code]
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    clone = len(length)
                    follow.append(dict(follow[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    least.append(least[q])
                    link[q] = clone
                    while p >= 0 and follow[p].get(code) == q:
                        follow[p][code] = clone
                        p = link[p]
                    if split_only:
                        state = clone
                        least[clone] = min(least[clone], doc)
                    else:
                        link[state] = clone
            last = state

    def finish(self) -> SuffixAutomaton:
        """Hand the least documents down to the shorter sequences."""
        link, least = self.link, self.least
        # Longest first; the root, the only empty sequence, is left out.
        for state in np.argsort(self.length)[:0:-1].tolist():
            up = link[state]
            if least[state] < least[up]:
                least[up] = least[state]
        return self

    def matched(self, doc: int, words: list[bytes], width: int) -> list[int]:
        """Starts of the windows that stand in a reference of a smaller document."""
        follow, link, length, least = self.next, self.link, self.length, self.least
        state, size, out, codes = 0, 0, [], self.codes
        for at, word in enumerate(words):
            code = codes.get(word)
            if code is None:
                state = size = 0
                continue
            while state and code not in follow[state]:
                state = link[state]
                size = length[state]
            state = follow[state].get(code, 0)
            size = size + 1 if state else 0
            if size >= width:
                while length[link[state]] >= width:
                    state = link[state]
                    size = length[state]
                if least[state] < doc:
                    out.append(at + 1 - width)
        return out


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Rising numbers as stretches (first, last)."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, breaks + 1]].tolist(), starts[np.r_[breaks, len(starts) - 1]].tolist(), strict=True))


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text that tells rows sharing an id apart, and the text compressed for the shuffle."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3)
        for frame in frames:
            packed = [packer.compress(t.encode()) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "text_key": frame["text_key"], "packed": packed})

    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInPandas(pack, "doc_id bigint, text_key bigint, packed binary")


def _unpacked(packed: bytes) -> list[bytes]:
    """The words of a compressed text."""
    return zstandard.ZstdDecompressor().decompress(packed).split()


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_key, spans): stretches (first, last) of starts of repeated windows, counted in words.

    Rows without a repeated window are not listed; null ids are never compared.
    text_key, a hash of the text, tells rows that share an id apart; they count
    as one document. Null, empty and short texts have no windows. An empty table
    gives an empty result, and other columns are ignored.
    """
    spark = docs.sparkSession

    def represent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Representatives(width)
        for frame in frames:
            marks = [np.unique(find(t.encode().split())) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "marks": marks})

    known = docs.filter("doc_id is not null").select("doc_id", whole_text().alias("text"))
    marks = known.mapInPandas(represent, "doc_id bigint, marks array<bigint>").select("doc_id", F.explode("marks").alias("mark"))
    # Dealt out once for both the least document and the join with it; the rows are two numbers.
    # The filter is what the join would infer, and makes both plans the same.
    marks = marks.filter("mark is not null and doc_id is not null").repartition(parallel_parts(spark), "mark")
    firsts = marks.groupBy("mark").agg(F.min("doc_id").alias("first"))
    asked = checkpointed(marks.join(firsts, "mark").filter("doc_id > first").select("doc_id", "first", "mark"))

    load = asked.groupBy("first").agg(F.count("*").alias("n"))
    load = load.select("first", "n", F.ceil(F.col("n") / ASKED_PER_COPY).cast("int").alias("copies"))
    load = checkpointed(load)
    total = load.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shards = max(parallel_parts(spark), -(-total // ASKED_PER_SHARD))

    wanted = asked.join(load, "first").select("doc_id", F.struct("mark", "first", "copies").alias("ask"))
    held = asked.select(F.col("first").alias("doc_id"), "mark").distinct().join(load, F.col("doc_id") == F.col("first"))
    held = held.select("doc_id", F.struct("mark", "first", "copies").alias("ask"))
    asks = wanted.union(held).groupBy("doc_id").agg(F.collect_list("ask").alias("asks"))
    asks = asks.select("doc_id", F.col("asks.mark").alias("marks"), F.col("asks.first").alias("firsts"), F.col("asks.copies").alias("copies"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Representatives(width)
        for frame in frames:
            out = []
            for doc, text_key, packed, asked_marks, firsts, copy_counts in frame.itertuples(index=False):
                words = _unpacked(packed)
                marks = find(words)
                order = np.argsort(asked_marks, kind="stable")
                asked_marks, firsts, copy_counts = asked_marks[order], firsts[order], copy_counts[order]
                place = np.minimum(np.searchsorted(asked_marks, marks), len(order) - 1)
                hit = np.flatnonzero(asked_marks[place] == marks)
                first = firsts[place[hit]]
                by_first = np.argsort(first, kind="stable")
                each, starts = np.unique(first[by_first], return_index=True)
                for f, mine in zip(each.tolist(), np.split(hit[by_first], starts[1:]), strict=False):
                    copies = int(copy_counts[place[mine[0]]])
                    for a, b in _runs(mine):
                        stretch = b" ".join(words[a : b + width])
                        where = range(copies) if f == doc else [(doc + a) % copies]
                        out += [(xxhash.xxh64_intdigest(f"{f}:{c}") % shards, f, doc, text_key, a, stretch) for c in where]
            yield pd.DataFrame(out, columns=["shard", "first", "doc_id", "text_key", "at", "words"])

    schema = "shard bigint, first bigint, doc_id bigint, text_key bigint, at int, words binary"
    held_texts = _packed(docs).join(asks, "doc_id").select("doc_id", "text_key", "packed", "marks", "firsts", "copies")
    stretches = held_texts.mapInPandas(cut, schema)

    def stream(frame: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton()
        reference = frame["first"] == frame["doc_id"]
        for doc, words in frame.loc[reference, ["doc_id", "words"]].drop_duplicates().itertuples(index=False):
            automaton.add(doc, words.split())
        automaton.finish()
        out = []
        for doc, text_key, at, words in frame.loc[~reference, ["doc_id", "text_key", "at", "words"]].itertuples(index=False):
            parts = words.split()
            found = automaton.matched(doc, parts, width)
            out += [(doc, text_key, at + a, at + b, None) for a, b in _runs(np.array(found, int))]
            open_windows = set(range(len(parts) - width + 1)).difference(found)
            out += [(doc, text_key, at + i, at + i, hashlib.blake2b(b" ".join(parts[i : i + width]), digest_size=16).digest()) for i in sorted(open_windows)]
        return pd.DataFrame(out, columns=["doc_id", "text_key", "first", "last", "digest"])

    settled = checkpointed(
        stretches.groupBy("shard").applyInPandas(stream, "doc_id bigint, text_key bigint, first int, last int, digest binary")
    )
    unsettled = settled.filter("digest is not null")
    least = unsettled.groupBy("digest").agg(F.min("doc_id").alias("least"))
    later = unsettled.join(least, "digest").filter("doc_id > least")
    columns = ["doc_id", "text_key", F.struct("first", "last").alias("span")]
    spans = settled.filter("digest is null").select(*columns).union(later.select(*columns))
    return spans.groupBy("doc_id", "text_key").agg(F.collect_list("span").alias("spans"))


def _covered(n: int, firsts: np.ndarray, lasts: np.ndarray, width: int) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, firsts, 1)
    np.add.at(edges, np.minimum(n, lasts + width), -1)
    return np.cumsum(edges[:-1]) > 0


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept, the words outside repeated windows joined by one space.

    A null text has no words (n_words 0, kept empty). Every input row gives
    one output row; rows with equal doc_id and text get equal results.
    """
    found = repeated_windows(docs, width).withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"})
    rows = _packed(docs)
    both = rows.join(found, (rows["doc_id"] == found["hit_id"]) & (rows["text_key"] == found["hit_key"]), "left")

    def drop(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            totals, removed, kept = [], [], []
            for packed, firsts, lasts in frame[["packed", "firsts", "lasts"]].itertuples(index=False):
                words = _unpacked(packed)
                totals.append(len(words))
                if firsts is not None:
                    gone = _covered(len(words), firsts, lasts, width)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(totals[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_words": totals, "n_removed": removed, "kept": kept})

    # The row's id is only handed through, so it may be null.
    return both.select("packed", F.col("spans.first").alias("firsts"), F.col("spans.last").alias("lasts"), "doc_id").mapInPandas(drop, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def matches_of_reference(spark: SparkSession, docs: DataFrame, reference: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, first, last): stretches of window starts whose words stand in a reference text.

    The reference is read in blocks of REFERENCE_WORDS words, or one longer
    text; each block is broadcast, made an automaton in every task, and all
    documents stream through it. Null texts on either side read as empty; an
    empty reference gives no rows.
    """

    def blocks() -> Iterator[list[str]]:
        block, held = [], 0
        for row in reference.select(whole_text().alias("text")).toLocalIterator():
            block.append(row.text)
            held += len(row.text.split())
            if held >= REFERENCE_WORDS:
                yield block
                block, held = [], 0
        if block:
            yield block

    schema = "doc_id bigint, first int, last int"
    out = spark.createDataFrame([], schema)
    for block in blocks():
        sent = spark.sparkContext.broadcast(block)

        def stream(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            automaton = SuffixAutomaton()
            for text in sent.value:
                automaton.add(0, text.encode().split())
            automaton.finish()
            for frame in frames:
                found = [(i, a, b) for i, text in enumerate(frame["text"]) for a, b in _runs(np.array(automaton.matched(1, text.encode().split(), width), int))]
                table = pd.DataFrame(found, columns=["at", "first", "last"])
                table.insert(0, "doc_id", frame["doc_id"].astype("Int64").iloc[table.pop("at").astype(int)].array)
                yield table

        out = out.union(docs.select("doc_id", whole_text().alias("text")).mapInPandas(stream, schema))
    return out
