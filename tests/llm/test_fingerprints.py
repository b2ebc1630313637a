import hashlib

from tramline.llm.fingerprints import SIGNATURE, fingerprint_documents, fingerprint_edits, fingerprint_text, likeness, op4_fingerprints, text_of

SF = "/root/testdata/sf0.001"


def check(rows, docs):
    """docs: (id, text) ascending, unique."""
    docs = [(k, t or "") for k, t in docs]
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    for i, (k, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, other, nxt = map(fingerprint_text, (t, edited, after))
        r = got[k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (text_of(own), text_of(other))
        assert (r["near_edited"], r["near_next"]) == (likeness(own, other), likeness(own, nxt))


def test_documents(spark):
    check(op4_fingerprints(spark, SF).collect(), sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()))


def test_edges(spark):
    kind = "doc_id long, text string, fingerprint string"
    docs = [(0, None), (1, ""), (2, "ab" * 50_000), (3, "é🙂" * 999), (7, "same text"), (9, "same text"), (-4, "first")]
    check(fingerprint_edits(spark.createDataFrame([(*d, "x") for d in docs], kind)).collect(), sorted(docs))
    check(fingerprint_edits(spark.createDataFrame([(5, "alone", "x")], kind)).collect(), [(5, "alone")])
    assert fingerprint_edits(spark.createDataFrame([], kind)).count() == 0
    odd = fingerprint_edits(spark.createDataFrame([(1, "a", "")] * 3 + [(None, "b", ""), (None, None, "")], kind))
    assert odd.count() == 5
    assert fingerprint_documents(spark.createDataFrame([(*d, "x") for d in docs], kind)).count() == len(docs)


def test_likeness_is_that_of_phrase_sets():
    assert likeness(fingerprint_text(""), fingerprint_text("")) == 1 and likeness(fingerprint_text(""), fingerprint_text("a")) == 0
    a, b = fingerprint_text("abcd"), fingerprint_text("abxy")
    assert len(a) == 4 <= SIGNATURE and likeness(a, b) == 2 / 6
