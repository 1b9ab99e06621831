"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs. Each paragraph is hashed to a wide
vector; a document's fingerprint is the sum of its paragraphs' vectors modulo
powers of two. Equal multisets of paragraphs have equal sums in any order, and
a paragraph is added or taken away by adding or subtracting its vector.

The vector has two parts. Eight lanes modulo 2**32 identify the paragraph.
Sixty lanes modulo 2**31 count random bits of the paragraph's pieces, every run
of four words in it, so the distance of two sums estimates how many pieces
differ and a word put in or taken out changes four at most. The last lane counts
the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotmetrics.operators.lineage import checkpointed

from .shared import WORD_PATTERN, bound, parallel_parts, whole_text

# Fixed values of the fingerprint's form.
PIECE_WORDS = 4
ID_HASHES = 4
ID_BITS = 32
BIT_WORDS = 30
LANE_BITS = 31
LANES_PER_WORD = 2

ID_LANES = 2 * ID_HASHES
BIT_LANES = LANES_PER_WORD * BIT_WORDS
_ID_MASK = (1 << ID_BITS) - 1
_LANE_MASK = (1 << LANE_BITS) - 1
_ONE_PER_LANE = sum(1 << LANE_BITS * j for j in range(LANES_PER_WORD))
_WORD_MASK = (1 << LANE_BITS * LANES_PER_WORD) - 1


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"[\n\r]+"), lambda p: F.length(p) > 0)


def _total(items: Column, value, mask: int) -> Column:
    """Sum of value(item) modulo mask + 1; no partial sum overflows."""
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda s, x: (s + value(x)).bitwiseAND(F.lit(mask)))


def windows(words: Column) -> Column:
    """Hashes of every PIECE_WORDS words in a row, or of all words if there are fewer; none without words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - PIECE_WORDS + 1, F.lit(1)))
    found = F.transform(starts, lambda i: F.xxhash64(F.lit(ID_HASHES), F.array_join(F.slice(words, i, PIECE_WORDS), " ")))
    return F.when(F.size(words) > 0, found).otherwise(F.array().cast("array<bigint>"))


def hashed(text: Column) -> Column:
    """Hashes of a text: per paragraph an array of identity hashes, and the piece hashes."""
    ids = F.transform(paragraphs(text), lambda p: F.array(*[F.xxhash64(F.lit(i), p) for i in range(ID_HASHES)]))
    pieces = F.flatten(F.transform(paragraphs(text), lambda p: bound(F.regexp_extract_all(p, F.lit(WORD_PATTERN), F.lit(0)), windows)))
    return F.struct(ids.alias("ids"), pieces.alias("pieces"))


def summed(hashes: Column) -> Column:
    """The fingerprint vector, an array of lanes, from the hashes of a text."""
    ids, pieces = hashes["ids"], hashes["pieces"]
    lanes = []
    for i in range(ID_HASHES):
        lanes.append(_total(ids, lambda h, i=i: h[i].bitwiseAND(F.lit(_ID_MASK)), _ID_MASK))
        lanes.append(_total(ids, lambda h, i=i: F.shiftrightunsigned(h[i], ID_BITS), _ID_MASK))
    words = [
        _total(pieces, lambda h, i=i: F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_ONE_PER_LANE)), _WORD_MASK)
        for i in range(BIT_WORDS)
    ]
    counters = F.flatten(
        F.transform(
            F.array(*words),
            lambda w: F.array(*[F.shiftrightunsigned(w, LANE_BITS * j).bitwiseAND(F.lit(_LANE_MASK)) for j in range(LANES_PER_WORD)]),
        )
    )
    return F.concat(F.array(*lanes), counters, F.array(F.size(pieces).cast("bigint")))


def with_vector(frame: DataFrame, text: str, out: str) -> DataFrame:
    """The frame with the fingerprint vector of a text column."""
    return frame.withColumn(out, hashed(F.col(text))).withColumn(out, summed(F.col(out)))


def fingerprint_text(vector: Column) -> Column:
    """The vector as lower-case hex, eight digits per lane."""
    return F.concat_ws("", F.transform(vector, lambda lane: F.lower(F.lpad(F.hex(lane), 8, "0"))))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of two multisets together (1), or of a without b's paragraphs (-1)."""

    def modulus(i: Column) -> Column:
        counter = (i >= ID_LANES) & (i < ID_LANES + BIT_LANES)
        return F.when(counter, F.lit(1 << LANE_BITS)).otherwise(F.lit(1 << ID_BITS))

    both = F.zip_with(a, b, lambda x, y: x + sign * y)
    return F.transform(both, lambda x, i: F.pmod(x, modulus(i)))


def likeness(a: Column, b: Column) -> Column:
    """Twice the estimated common pieces over all pieces, 0 to 1; 1 for equal vectors."""

    def centred(v: Column) -> Column:
        count = F.element_at(v, ID_LANES + BIT_LANES + 1)
        return F.transform(F.slice(v, ID_LANES + 1, BIT_LANES), lambda c: (2 * c - count).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    x, y = centred(a), centred(b)
    norms = dot(x, x) + dot(y, y)
    ratio = F.when(norms > 0, 2 * dot(x, y) / norms).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, the vector and its hex form.

    A null text is the empty text, whose vector is zero; white-space paragraphs
    count as paragraphs without pieces. Repeated rows give repeated results, an
    empty table an empty one, and other columns are ignored.
    """
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
    return with_vector(rows, "text", "vector").select(
        "doc_id", "n_chars", "vector", fingerprint_text(F.col("vector")).alias("fingerprint")
    )


def _key() -> Column:
    """The doc_id, null as the least long."""
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("bigint"))


def next_documents(docs: DataFrame) -> DataFrame:
    """Pairs (key, n_chars, next_key) in descending doc_id, the last followed by the first.

    The key is the doc_id; null ids stand last. Of rows sharing an id one is
    counted. Ids are ordered in ranges, each in a task of its own; a range's
    last id takes the next range's first, from a table of one row per range.
    """
    parts = parallel_parts(docs.sparkSession)
    slim = docs.groupBy(_key().alias("key")).agg(F.max(F.length(whole_text())).cast("bigint").alias("n_chars"))
    ranged = checkpointed(slim.repartitionByRange(parts, F.desc("key")).withColumn("part", F.spark_partition_id()))
    chained = ranged.withColumn("next_key", F.lead("key").over(Window.partitionBy("part").orderBy(F.desc("key"))))
    order = Window.orderBy("part")
    heads = ranged.groupBy("part").agg(F.max("key").alias("head"))
    following = heads.select(
        "part", F.coalesce(F.lead("head").over(order), F.max("head").over(Window.partitionBy(F.lit(0)))).alias("after")
    )
    return chained.join(F.broadcast(following), "part").select(
        "key", "n_chars", F.coalesce("next_key", "after").alias("next_key")
    )


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    The edited text has its last third replaced by the start of the next
    document. Empty and null texts have the zero vector; a lone document is its
    own next. Each of several rows with one doc_id is kept, and the greatest of
    their texts is what the document before it is given.

    The vector of a text is summed once, where the text is read, for both its
    own row and the document before it. Texts and vectors are shuffled once, by
    id, for both joins; the given starts, a third of the text at most, and the
    next documents' vectors once more.
    """
    keyed = with_vector(docs.select(_key().alias("key"), whole_text().alias("text")), "text", "vector")
    givers = keyed
    if docs.groupBy(_key()).count().filter("count > 1").limit(1).count():
        givers = keyed.groupBy("key").agg(F.max(F.struct("text", "vector")).alias("given")).select("key", "given.*")
    pairs = next_documents(docs).select(F.col("key").alias("taker"), "n_chars", "next_key")
    given = givers.join(pairs, F.col("key") == F.col("next_key"))
    starts = given.select(
        "taker", F.substr("text", F.lit(1), F.floor(F.col("n_chars") / 3).cast("int")).alias("start"), F.col("vector").alias("vector_next")
    )
    rows = keyed.join(starts, F.col("key") == F.col("taker")).withColumn("n_chars", F.length("text").cast("bigint"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    kept_part = F.substr("text", F.lit(1), (F.col("n_chars") - cut).cast("int"))
    texts = rows.withColumn("edited", F.concat(kept_part, F.substr("start", F.lit(1), cut)))
    out = with_vector(texts, "edited", "vector_edited")
    return out.select(
        F.nullif("key", F.lit(-(1 << 63)).cast("bigint")).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("vector")).alias("fingerprint"),
        fingerprint_text(F.col("vector_edited")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("vector_edited")).alias("near_edited"),
        likeness(F.col("vector"), F.col("vector_next")).alias("near_next"),
    )
