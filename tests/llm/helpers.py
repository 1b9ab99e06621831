"""Small frames of the documents table."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key string, shard int"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "src0", 3, "clash", None, 7) for i, t in zip(ids, texts, strict=True)], SCHEMA)
