from tramline.llm.licenses import TEMPLATES, scan_licenses


def test_licenses(spark):
    mit = TEMPLATES["MIT"]
    docs = [(1, "x y z " + mit, "MIT"), (2, mit[: len(mit) // 3], "c"), (3, None, "c"), (4, "", "c"), (5, TEMPLATES["MIT-statement"], "c"), (5, TEMPLATES["MIT-statement"], "c")]
    out = scan_licenses(spark.createDataFrame(docs, "doc_id long, text string, license string")).collect()
    assert sorted((r["doc_id"], r["license"], r["first_word"]) for r in out) == [(1, "MIT", 3), (5, "MIT-statement", 0), (5, "MIT-statement", 0)]
