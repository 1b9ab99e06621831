from __future__ import annotations

from shotmetrics.llm import fingerprints

from .helpers import frame


def test_a_text_is_summed_once_for_its_own_and_the_row_before(spark, monkeypatch):
    summed = []
    plain = fingerprints.with_vector
    monkeypatch.setattr(fingerprints, "with_vector", lambda df, text, out: summed.append(text) or plain(df, text, out))
    texts = {5: "a b c d e f\ng h", 4: "", 3: None, 2: "x y z x y z w", 1: "a b c d e f\ng h i"}
    rows = {r.doc_id: r for r in fingerprints.edit_likeness(frame(spark, list(texts.values()), list(texts))).collect()}
    assert sorted(summed) == ["edited", "text"]  # the text twice before
    monkeypatch.undo()
    own = fingerprints.fingerprints(frame(spark, list(texts.values()), list(texts))).collect()
    assert {r.doc_id: r.fingerprint for r in own} == {d: r.fingerprint for d, r in rows.items()}
    vectors = {r.doc_id: r.vector for r in own}
    pairs = spark.createDataFrame([(5, vectors[5], vectors[4]), (2, vectors[2], vectors[1]), (1, vectors[1], vectors[5])], "d long, a array<bigint>, b array<bigint>")
    near = {r.d: r.near for r in pairs.select("d", fingerprints.likeness(pairs.a, pairs.b).alias("near")).collect()}
    assert near == {d: rows[d].near_next for d in near}
