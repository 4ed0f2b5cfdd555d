import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from claimweave.llm import token_counts as tc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "a", " a", "a  b", "a\nb", "\n", "a \n b ", "▁a ▁", "<s>x</s>", "\t\r\n", "é ß 東京 👍🏽", "a　b\xa0c", "\0x y\0", "x" * 5000, "- " * 3000]


def test_same_as_library(spark, make_docs, odd_rows):
    model = SentencePieceProcessor(model_file=MODEL)
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(ODD)]
    expected = sorted((str(r[0]), len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in rows)
    for frequent in (0, 5, 1000):
        found = tc.token_counts(make_docs(rows), MODEL, limit=50, frequent=frequent).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in found) == expected
        assert all(r.over_limit == (r.n_tokens > 50) for r in found)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf('sf0.001')}/documents.parquet")
    model = SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = tc.token_counts(docs, MODEL).collect()
    assert len(found) == len(texts) and all(r.n_tokens == len(model.encode(texts[r.doc_id])) for r in found)


def test_full_cache_starts_again(monkeypatch):
    monkeypatch.setattr(tc, "CACHE_ENTRIES", 3)
    model = SentencePieceProcessor(model_file=MODEL)
    lengths = tc._Lengths(model)
    text = "one two three four five one two three"
    assert tc.count_text(text, {}, lengths) == len(model.encode(text)) and len(lengths) <= 3


def test_table_keeps_lengths():
    lengths = [(" the", 1), ("\n", 1), (" long", 300), (" a\0b", 2), (" é", 2)]
    assert tc.unpack_table(tc.pack_table(lengths)) == {" the": 1, "\n": 1, " é": 2}
    assert tc.unpack_table(tc.pack_table([])) == {}


def test_empty_table(make_docs):
    assert tc.token_counts(make_docs([]), MODEL).collect() == []


@pytest.mark.parametrize("text", ODD)
def test_pretokens_cover_the_text(text):
    assert "".join(tc.pretokens(text)) == (" " + text if text else "")
