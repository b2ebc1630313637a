import hashlib

import numpy as np
import public_tokenizers
import sentencepiece

from tramline.llm.pieces import encode_documents, encoding_digests, op9_pieces, pieces_for

FILE = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
EDGES = {1: None, 2: "", 3: "  a   b  ", 4: "naïve ﬁ ½ 漢字　🙂​\x00x́", 5: "<s> </s> <unk> ▁a", 6: "ab " * 20_000, 7: "\n\t\r\n", 8: "x" * 5000}


def check(rows, texts):
    p = sentencepiece.SentencePieceProcessor(model_file=FILE)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = p.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids), r["doc_id"]
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(p.decode(ids).encode()).hexdigest()


def test_documents(spark):
    check(op9_pieces(spark, SF).collect(), {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})


def test_edges(spark):
    df = spark.createDataFrame([(k, t, 0) for k, t in EDGES.items()], "doc_id long, text string, n_tokens int")
    check(encoding_digests(df, FILE).collect(), EDGES)
    assert encoding_digests(spark.createDataFrame([], df.schema), FILE).count() == 0
    assert encode_documents(df, FILE).count() == len(EDGES)


def test_compiled_map(tmp_path):
    """A model with a character map, squeezed spaces and byte fallback, against the library."""
    words = "the café naïve office fine half whole street water light stone river".split()
    lines = [" ".join(words[(i * k + k) % len(words)] for k in range(1, 9)) for i in range(200)]
    prefix = f"{tmp_path}/small"
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(lines), model_prefix=prefix, vocab_size=340, model_type="bpe", byte_fallback=True, normalization_rule_name="nmt_nfkc", hard_vocab_limit=False, minloglevel=2)
    made, library = pieces_for(f"{prefix}.model"), sentencepiece.SentencePieceProcessor(model_file=f"{prefix}.model")
    assert made.normalizer.map.units and not made.plain
    for text in ["the café", "  a   b  ", "naïve ﬁne oﬃce ½ ①", "漢字　🙂 ｶﾞ x", "é Å \t\n the", "", "Ｆｕｌｌ ㍿ ™"]:
        ids, ends = made.encode(text)
        inner = library.encode(text)
        assert ids == [library.bos_id(), *inner, library.eos_id()], text
        assert made.normalizer(text)[0] == library.normalize(text).replace(" ", "▁"), text
        assert len(ends) == len(inner) and (not inner or ends[-1] == len(text.encode())), text
