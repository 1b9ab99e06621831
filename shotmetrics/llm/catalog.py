"""The registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotmetrics.operators.lineage import ensure_checkpoint_dir

from . import clustering, decontamination, extraction, fingerprints, mixing, near_dedup, packing, privacy, repair, repeats, sharding, token_files, toxicity
from .shared import table, whole_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED = 17


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, where every executor can write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


_WORDS_SQL = "[^\\x20\\x09-\\x0D]+"

ORACLES["op2_near_dedup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS_SQL}') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
s AS (SELECT DISTINCT doc_id, CASE WHEN n = 1 THEN word ELSE word || ' ' || after END AS shingle FROM (
    SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM t) WHERE n = 1 OR i < n),
z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
sz AS (SELECT doc_id, shingle, size FROM s JOIN z USING (doc_id)),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, x.size + y.size AS sizes, count(*) AS common FROM sz x JOIN sz y
    ON x.shingle = y.shingle AND x.doc_id < y.doc_id AND 5 * least(x.size, y.size) >= 4 * greatest(x.size, y.size) GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * common >= 80 * (sizes - common)),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, k.b FROM reach r JOIN links k ON r.b = k.a)
SELECT doc_id, coalesce(size, 0) AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept
FROM reach JOIN documents ON a = doc_id LEFT JOIN z USING (doc_id) GROUP BY doc_id, size"""


# The tree of the mixed corpus: families of sources, languages, sources. Weights are parts within a parent.
_FAMILY = "CASE WHEN substr(md5(source), 1, 1) < '8' THEN 'forum' ELSE 'press' END"
LEVELS = {"family": _FAMILY, "language": "lang", "origin": "source"}
WEIGHTS = {"forum": 2, "press": 3, "*/en": 5, "*/de": 3, "*/fr": 3, "press/es": 2, "*/*/src0": 2}


@query
def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), LEVELS, WEIGHTS, budget=(3, 4), epochs=2, seed=SEED)
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "epoch", *LEVELS, "n_tokens", "quota")


_TREE = list(LEVELS)


def _level_sql(i: int) -> str:
    """One level of the tree: the children's caps, weights and shares of their parent's budget."""
    here, parent = ", ".join(_TREE[: i + 1]), ", ".join(_TREE[:i])
    path = " || '/' || ".join(_TREE[: i + 1])
    stars = "".join("*/" for _ in range(i))
    weight = " ".join(f"WHEN {path} = '{k}' THEN {v}" for k, v in WEIGHTS.items() if k.count("/") == i and "*" not in k)
    weight += " " + " ".join(f"WHEN '{stars}' || {_TREE[i]} = '{k}' THEN {v}" for k, v in WEIGHTS.items() if k.count("/") == i and "*" in k)
    weight = f"CASE {weight} ELSE 1 END" if weight.strip() else "1"
    by = f"PARTITION BY {parent}" if i else ""
    join = f"JOIN b{i} USING ({parent})" if i else "CROSS JOIN b0"
    before = f"({by} ORDER BY cap / weight, {_TREE[i]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
n{i} AS (SELECT {here}, sum(cap)::HUGEINT AS cap, ({weight})::HUGEINT AS weight FROM leaves GROUP BY {here}),
m{i} AS (SELECT n{i}.*, budget, cap * (sum(weight) OVER ({by}) - coalesce(sum(weight) OVER {before}, 0))
    <= (budget - coalesce(sum(cap) OVER {before}, 0)) * weight AS filled FROM n{i} {join}),
b{i + 1} AS (SELECT {here}, CASE WHEN filled THEN cap ELSE least(cap,
    ((budget - coalesce(sum(cap) FILTER (filled) OVER ({by}), 0)) * weight) // nullif(sum(weight) FILTER (NOT filled) OVER ({by}), 0)) END AS budget FROM m{i})"""


ORACLES["op3_mix"] = f"""
WITH d AS (SELECT doc_id, {_FAMILY} AS family,
    coalesce(lang, '') AS language, coalesce(source, '') AS origin,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT family, language, origin, sum(n_tokens)::HUGEINT AS tokens, 2 * sum(n_tokens)::HUGEINT AS cap FROM d GROUP BY ALL),
b0 AS (SELECT least(sum(tokens) * 3 // 4, sum(cap)) AS budget FROM leaves),{",".join(_level_sql(i) for i in range(len(_TREE)))},
q AS (SELECT leaves.*, budget AS quota FROM b{len(_TREE)} JOIN leaves USING ({", ".join(_TREE)})),
e AS (SELECT doc_id, epoch, family, language, origin, n_tokens, quota, least(tokens, quota - epoch * tokens) AS reach,
    sum(n_tokens) OVER (PARTITION BY family, language, origin, epoch ORDER BY md5('{SEED}:' || epoch || ':' || doc_id), doc_id) AS reached
    FROM d JOIN q USING (family, language, origin) CROSS JOIN (VALUES (0), (1)) t(epoch))
SELECT doc_id, epoch::INT AS epoch, family, language, origin, n_tokens::BIGINT AS n_tokens, quota::BIGINT AS quota
FROM e WHERE reached <= reach AND (reach > 0 OR epoch = 0)"""


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(table(spark, sf_dir, "documents"))


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.span_digest(privacy.personal_data(table(spark, sf_dir, "documents")))


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(whole_text()) + 1).cast("bigint").alias("size"),
        F.crc32(whole_text()).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    return sharding.uniform_shards(docs, shards=16, seed=SEED).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out")
    return toxicity.scored(spark, docs, index).select("doc_id", held_out, "score", "predicted", "neighbours", "cosines")


@query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op10_repeats"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS_SQL}') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
s AS (SELECT *, CASE WHEN i + 12 <= n THEN string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS stretch FROM t),
f AS (SELECT *, CASE WHEN stretch IS NOT NULL AND min(doc_id) OVER (PARTITION BY stretch) < doc_id THEN 1 ELSE 0 END AS again FROM s),
c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""


@query
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = extraction.extracted(spark, pages, extraction.fit(pages))
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)


def _centroids_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Lloyd's rounds unrolled: a{r} assigns with c{r}, c{r+1} takes floor means, empty clusters keep theirs."""
    dist = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    parts = [
        """v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
        f"""c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1)::INT AS cid, v AS c
    FROM v QUALIFY cid < {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS (SELECT rid, vec_id, v, arg_min(cid, {dist} * 64 + cid) AS cid, min({dist}) AS d FROM v, c{r} GROUP BY ALL)"""
        )
        if r < rounds:
            parts.append(
                f"""s{r} AS (SELECT cid, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL),
m{r} AS (SELECT cid, list(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END ORDER BY i)::BIGINT[] AS c FROM s{r} GROUP BY cid),
c{r + 1} AS (SELECT * FROM m{r} UNION ALL SELECT * FROM c{r} WHERE cid NOT IN (SELECT cid FROM m{r}))"""
            )
    body = ",\n".join(parts)
    return f"""WITH {body}
SELECT vec_id, cid AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cid))::BIGINT AS cluster_inertia,
    (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cid)"""


ORACLES["op12_centroids"] = _centroids_sql()


@query
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)
