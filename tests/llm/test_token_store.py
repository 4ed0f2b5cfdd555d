import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from claimweave.llm import token_store as ts

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700), st.integers(0, 100_000))
def test_elias_fano_round_trip(steps, extra):
    values = np.cumsum(steps).tolist()
    coded = ts.EliasFano.encode(values, (values[-1] if values else 0) + extra)
    coded = ts.EliasFano(coded.n, coded.low_bits, coded.lower, coded.upper.tobytes(), coded.samples.tobytes())
    assert coded.all().tolist() == values
    assert [coded.select(i) for i in range(0, len(values), 7)] == values[::7]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(100, 900, 10_000))
    coded = ts.EliasFano.encode(ends, int(ends[-1]))
    assert 8 * (len(coded.lower) + len(coded.upper) + len(coded.samples.tobytes())) < len(ends) * (2 + np.log2(500) + 1)


def library_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_encoder_is_the_library():
    encoder, library, chance = ts._Encoder(PATH), Tokenizer.from_file(PATH), random.Random(4)
    alphabet = "abzÀéßñÿĀ東ﬁ İΣς0١9.,;:!?'’-_<>|endoftextstart \n\t\x0b\x0c\x1c\x85\xa0　́…ªµº€"
    assert encoder.by_word and encoder.written
    for i in range(4000):
        text = "".join(chance.choice(alphabet) for _ in range(chance.randint(0, 30)))
        text += chance.choice(["", "<|endoftext|>", "<|startoftext|>x", " I'll", "'s"]) if i % 3 == 0 else ""
        expected = np.array(library.encode(text, add_special_tokens=False).ids, encoder.dtype).tobytes()
        assert encoder.encode([text.encode()]) == [expected], text


def test_full_cache(monkeypatch):
    monkeypatch.setattr(ts, "CACHE_ENTRIES", 4)
    encoder = ts._Encoder(PATH)
    text = "one two three, four five! six seven one two"
    assert np.frombuffer(encoder.encode([text.encode()])[0], encoder.dtype).tolist() == library_ids(text) and len(encoder.words) <= 5


def test_store_round_trip(spark, make_docs, odd_rows, tmp_path):
    for number, block_ids in enumerate((1, 40, 1 << 20)):
        path = str(tmp_path / str(number))
        ts.write_token_store(make_docs(odd_rows), path, PATH, end_id=2, block_ids=block_ids)
        stored = ts.read_token_store(spark, path)
        rows = sorted(stored.collect(), key=lambda r: r.start)
        ids = sorted(((r[0] is not None, r[0] or 0), r[0]) for r in odd_rows)
        assert [r.doc_id for r in rows] == [i for _, i in ids]
        start = 0
        for r in rows:
            assert r.start == start and r.n_tokens * r.id_bytes == len(r.ids)
            start += r.n_tokens
        found = [(r.doc_id, tuple(np.frombuffer(r.ids, f"<u{r.id_bytes}").tolist())) for r in rows]
        assert sorted(found, key=str) == sorted(((r[0], (*library_ids(r[1]), 2)) for r in odd_rows), key=str)
        sums = {r.start: r.ids_crc32 for r in ts.ids_crc32(stored).collect()}
        assert all(sums[r.start] == zlib.crc32(np.frombuffer(r.ids, f"<u{r.id_bytes}").astype("<u4").tobytes()) for r in rows)


def test_empty_table(spark, make_docs, tmp_path):
    ts.write_token_store(make_docs([]), str(tmp_path / "none"), PATH, end_id=2)
    assert ts.ids_crc32(ts.read_token_store(spark, str(tmp_path / "none"))).collect() == []


def test_digests_are_made_where_blocks_are_read(spark, make_docs, odd_rows, tmp_path):
    path = str(tmp_path / "store")
    ts.write_token_store(make_docs(odd_rows), path, public_tokenizers.path("word_bpe_49k.json"), 2, block_ids=50)
    digests = ts.read_digests(spark, path)
    assert digests._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert digests.dtypes == ts.ids_crc32(ts.read_token_store(spark, path)).dtypes
    found, apart = (sorted(map(str, rows.collect())) for rows in (digests, ts.ids_crc32(ts.read_token_store(spark, path))))
    assert found == apart and len(found) == len(odd_rows)
    ids = {r.start: bytes(r.ids) for r in ts.read_token_store(spark, path).collect()}
    size = ts._encoder(public_tokenizers.path("word_bpe_49k.json")).dtype
    assert all(r.ids_crc32 == zlib.crc32(np.frombuffer(ids[r.start], size).astype("<u4")) for r in digests.collect())
