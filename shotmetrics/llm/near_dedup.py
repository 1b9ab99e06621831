"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is its set of word shingles. Its sketch has T bins. In round i every
shingle is hashed to a bin and a value, and a bin keeps the least value of the
first round that reaches it; after T rounds the bins still empty are served
one by one by all shingles, so every bin fills, and two sketches agree in a bin
with the probability of the sets' similarity, with sharper concentration than
independent draws. Bands of bins name buckets; documents that share a bucket are
candidates, which are confirmed on their full sets.

Equal sets are one class from the start. Inside a bucket members are first
compared with one leader each, so a bucket of many copies never meets all its
pairs. Groups that still hold several components are compared whole, in bounded
chunks and by matrix products, and give only the links that join components; so
no pair of a bucket is left uncompared between two components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotmetrics.operators.lineage import checkpointed

from .components import components
from .shared import whole_text

BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
PERCENT = 80
# Documents of a chunk in the last comparison, and columns of its matrices.
CHUNK = 256
_COLUMNS = 2048

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z are folded."""

    def __init__(self, width: int) -> None:
        self.width = width

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        span = min(self.width, len(words))
        total = np.zeros(len(words) - span + 1, np.uint64)
        for i in range(span):
            total = mixed(total * _GOLDEN + codes[i : len(codes) - span + 1 + i] + np.uint64(i + 1))
        return np.unique(total)


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The filled bins of a non-empty set: round in the high bits, least hash below."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(bins, empty)
    done, step = 0, max(1, -(-6 * bins // len(items)))
    while done < bins:
        rounds = np.arange(done, min(bins, done + step), dtype=np.uint64)
        hashes = mixed(items[None, :] + mixed(rounds + np.uint64(1))[:, None] * _GOLDEN)
        values = (rounds[:, None] << np.uint64(52)) | (hashes >> np.uint64(12))
        spots = (mixed(hashes) % np.uint64(bins)).astype(np.int64)
        fresh = np.full(bins, empty)
        np.minimum.at(fresh, spots.ravel(), values.ravel())
        out = np.where(out == empty, fresh, out)
        done += len(rounds)
        if not (out == empty).any():
            return out
    for spot in np.flatnonzero(out == empty):
        turn = np.uint64(bins + spot)
        hashes = mixed(items + mixed(np.array([turn + np.uint64(1)], np.uint64)) * _GOLDEN)
        out[spot] = (turn << np.uint64(52)) | (hashes.min() >> np.uint64(12))
    return out


def bucket_keys(filled: np.ndarray, bands: int = BANDS) -> np.ndarray:
    total = np.arange(1, bands + 1, dtype=np.uint64)
    for column in filled.reshape(bands, -1).T:
        total = mixed(total * _GOLDEN + column)
    return total.view(np.int64)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, n_shingles, set_key (null for an empty set) and its bucket keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(width)
        for frame in frames:
            sizes, digests, keys = [], [], []
            for text in frame["text"]:
                items = shingles(text)
                sizes.append(len(items))
                digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                keys.append(bucket_keys(sketch(items)) if len(items) else None)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_shingles": sizes, "set_key": digests, "keys": keys})

    rows = docs.select("doc_id", whole_text().alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, n_shingles bigint, set_key binary, keys array<bigint>")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those with 100 * common >= percent * all shingles of both."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(width)
        last, items = None, None
        for frame in frames:
            keep = []
            for a, text_a, text_b in zip(frame["a"], frame["text_a"], frame["text_b"], strict=True):
                if (a, text_a) != last:
                    last, items = (a, text_a), shingles(text_a)
                other = shingles(text_b)
                common = len(np.intersect1d(items, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(items) + len(other) - common) > 0)
            yield frame.loc[np.array(keep, bool), ["a", "b"]]

    second = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "text_a", "b", "text_b").mapInPandas(run, "a bigint, b bigint")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def _linking(sets: list[np.ndarray], parts: np.ndarray, first: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of places whose sets link two parts: enough of them to join what can be joined.

    Shared shingles are counted for all pairs at once, as a product of 0-1
    matrices. Where `first` tells two sides apart only pairs across are asked.
    """
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values, codes, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[codes] > 1
    column = np.cumsum(seen > 1)[codes[shared]] - 1
    owner = owner[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, [begin, begin + _COLUMNS])
        block = np.zeros((len(sets), _COLUMNS), np.float32)
        block[owner[lo:hi], column[lo:hi] - begin] = 1
        common += block @ block.T
    either = size[:, None] + size[None, :] - common
    linked = (100 * common.astype(np.int64) >= percent * either.astype(np.int64)) & (parts[:, None] != parts[None, :])
    if first.any() and not first.all():
        linked &= first[:, None] != first[None, :]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        x, y = find(int(parts[i])), find(int(parts[j]))
        if x != y:
            root[x] = y
            out.append((int(i), int(j)))
    return out


def _compared(groups: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between the components of each group (leader, id, component, n).

    A group is cut into chunks of about CHUNK documents by a hash, and each pair
    of chunks is one bounded group of its own, which compares all its documents.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        shingles = Shingler(width)
        frame = frame.drop_duplicates(["id", "text"])
        sets = [shingles(t) for t in frame["text"]]
        first = (frame["chunk"] == frame["low"]).to_numpy()
        ids = frame["id"].to_numpy()
        pairs = _linking(sets, frame["component"].to_numpy(), first, percent)
        return pd.DataFrame([(ids[i], ids[j]) for i, j in pairs], columns=["a", "b"])

    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    cut = groups.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    cut = cut.select("leader", "id", "component", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    return cut.join(texts, "id").groupBy("leader", "low", "high").applyInPandas(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable over links) and kept.

    Links hold between documents whose sets of shingles of `width` words have
    100 * common >= percent * union; a text with fewer words is one shingle.
    Empty and null texts are linked with nothing. Rows sharing a doc_id are one
    document: it is linked where any of its texts is. A null doc_id is linked
    with nothing and has no component; it is kept. Empty tables give empty
    results; other columns are ignored. With 40 bands of 5 bins a pair at the
    threshold misses every bucket once in ten million.
    """
    rows = checkpointed(sketched(docs, width))
    sets = rows.filter("doc_id is not null and set_key is not null")
    classes = checkpointed(sets.groupBy("set_key").agg(F.min("doc_id").alias("id")))
    # Keys come from the class's least document, so copies of a set are bucketed once.
    owners = sets.join(classes, "set_key").filter("doc_id = id").dropDuplicates(["set_key"])
    buckets = owners.select("id", F.explode("keys").alias("key"))
    leaders = buckets.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader < last")
    # Documents of one bucket have one leader, so groups by leader hold every candidate pair.
    members = checkpointed(buckets.join(leaders, "key").select("leader", "id").distinct())

    wanted = members.select("id").distinct()
    texts = docs.select(F.col("doc_id").alias("id"), whole_text().alias("text")).join(wanted, "id", "left_semi")
    texts = checkpointed(texts)
    asked = _ordered(members.select(F.col("leader").alias("a"), F.col("id").alias("b")))
    linked = checkpointed(components(checkpointed(confirmed(asked, texts, width, percent))))

    busy = members
    before = members.groupBy("leader").count().agg(F.coalesce(F.sum(F.expr("count * (count - 1) / 2")), F.lit(0.0))).first()[0]
    while True:
        placed = busy.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
        split = placed.groupBy("leader").agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.count("*").alias("n"),
            F.min_by(F.struct("id", "component"), F.xxhash64("leader", "id")).alias("head"),
        )
        placed = checkpointed(placed.join(split.filter("low < high and n > 2"), "leader"))
        parts = placed.groupBy("leader", "component").agg(F.count("*").alias("part"), F.first("n").alias("n"))
        left = parts.agg(F.coalesce(F.sum(F.expr("part * (n - part)")), F.lit(0)).alias("n")).first()["n"] / 2
        if not left:
            break
        # Another leader as long as that joins most; then all that are still apart.
        last = left > before / 2
        if last:
            found = _compared(placed.select("leader", "id", "component", "n"), texts, width, percent)
        else:
            other = placed.filter("component <> head.component").select(F.col("head.id").alias("a"), F.col("id").alias("b"))
            found = confirmed(_ordered(other), texts, width, percent)
        joined = linked.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found)
        linked = checkpointed(components(joined))
        if last:
            break
        before, busy = left, placed.select("leader", "id")

    in_class = classes.join(linked, "id", "left").select("set_key", F.coalesce("component", "id").alias("class_component"))
    if rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        in_class = _joined_by_id(sets, in_class)
    out = rows.drop("keys").join(in_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component, (F.coalesce(component == F.col("doc_id"), F.lit(True))).alias("kept"))


def _joined_by_id(sets: DataFrame, in_class: DataFrame) -> DataFrame:
    """Components joined further where one doc_id has texts in several of them."""
    held = sets.select("doc_id", "set_key").distinct().join(in_class, "set_key")
    further = checkpointed(components(held.select(F.col("doc_id").alias("a"), F.col("class_component").alias("b"))))
    root = further.select(F.col("id").alias("class_component"), "component")
    return in_class.join(root, "class_component", "left").select(
        "set_key", F.coalesce("component", "class_component").alias("class_component")
    )


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents that are the least of their component; copies of a row with one doc_id all stay."""
    dropped = near_duplicates(docs, width, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")
