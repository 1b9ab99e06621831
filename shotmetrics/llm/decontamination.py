"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

An item of m characters may differ from its trace in a document by e edits, a
fixed share of m. Cut into e + 1 pieces, at least one piece must stand there
unchanged, so exact piece hits find every candidate; the text around a hit is
then searched for the whole item with Myers' bit-parallel distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import whole_text

ERROR_SHARE = 0.05
BLOCK_CHARS = 1 << 24
HIT_SCHEMA = "item_id bigint, start int, end int, distance int"
_SPACES = dict.fromkeys([*range(9, 14), *range(28, 33), 0x85, 0xA0], " ")


def folded(text: str) -> str:
    """Lower case with plain spaces, character for character."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_SPACES)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item cut into errors + 1 pieces of even length, with their offsets."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def search(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and where the first such part ends."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    up, down, score = full, 0, len(pattern)
    best, at = score, 0
    for j, c in enumerate(text):
        same = masks.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        along = same | down
        right = down | ~(across | up) & full
        left = up & across
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = right << 1, left << 1
        up = (left | ~(along | right)) & full
        down = right & along & full
        if score < best:
            best, at = score, j + 1
    return best, at


class ItemIndex:
    """Exact search for the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], error_share: float) -> None:
        self.items = [(item_id, folded(text)) for item_id, text in items]
        self.errors = [int(len(text) * error_share) for _, text in self.items]
        wanted: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(self.items):
            for offset, piece in pieces(text, self.errors[n]):
                wanted.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in wanted.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) of the best trace in each stretch of piece hits."""
        text = folded(text)
        spots: dict[int, list[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for n, offset in places:
                spots.setdefault(n, []).append(end + 1 - length - offset)
        out = []
        for n, starts in spots.items():
            item_id, item = self.items[n]
            errors, length = self.errors[n], len(item)
            low = high = None
            for start in [*sorted(set(starts)), None]:
                if low is not None and (start is None or start - errors > high):
                    out += self._verified(item_id, item, errors, text, low, high)
                    low = None
                if start is not None:
                    low = max(0, start - errors) if low is None else low
                    high = start + length + errors
        return out

    @staticmethod
    def _verified(item_id: int, item: str, errors: int, text: str, low: int, high: int) -> list[tuple[int, int, int, int]]:
        found = text.find(item, low, high)
        if found >= 0:
            return [(item_id, found, found + len(item), 0)]
        distance, end = search(item, text[low:high])
        if distance > errors:
            return []
        _, back = search(item[::-1], text[low : low + end][::-1])
        return [(item_id, low + end - back, low + end, distance)]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items with text, in blocks of at most BLOCK_CHARS characters (or one longer item)."""
    block: list[tuple[int, str]] = []
    held = 0
    for row in benchmark.select("item_id", F.col("text").alias("text")).filter(F.length("text") > 0).toLocalIterator():
        if block and held + len(row.text) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((row.item_id, row.text))
        held += len(row.text)
    if block:
        yield block


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE) -> DataFrame:
    """One row per trace of an item in a document: doc_id, item_id, start, end, distance.

    Offsets are code points of the text, the end exclusive. Null and empty
    texts and items match nothing; items shorter than 1 / error_share must
    match exactly but for case and white space. Repeated documents and items
    each give their rows. The benchmark is broadcast in blocks of bounded size
    and each block is one pass over the documents, which are not shuffled.
    """
    schema = f"doc_id bigint, {HIT_SCHEMA}"
    rows = docs.select("doc_id", whole_text().alias("text"))
    out = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def find(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = ItemIndex(sent.value, error_share)
            for frame in frames:
                ids = frame["doc_id"].astype("Int64")
                found = [(i, *hit) for i, text in enumerate(frame["text"]) for hit in index.hits(text)]
                table = pd.DataFrame(found, columns=["at", "item_id", "start", "end", "distance"])
                table.insert(0, "doc_id", ids.iloc[table.pop("at").astype(int)].array)
                yield table

        out = out.union(rows.mapInPandas(find, schema))
    return out


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE) -> DataFrame:
    """The documents without those that hold a trace of an item; nothing is shuffled.

    Null texts read as empty and are kept; repeated rows are judged alike; an
    empty benchmark keeps every row. All columns come back as given.
    """
    for block in item_blocks(benchmark):
        docs = docs.filter(_clean(spark.sparkContext.broadcast(block), error_share)(whole_text()))
    return docs


def _clean(sent: Broadcast, error_share: float):
    """A column function: no item of the block has a trace in the text."""

    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = ItemIndex(sent.value, error_share)
        for batch in texts:
            yield pd.Series([not index.hits(text) for text in batch], dtype=bool)

    return F.pandas_udf(clean, "boolean")
