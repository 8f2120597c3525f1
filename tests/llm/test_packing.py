import zlib

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import packing, token_store, word_codes


def encode(texts, end):
    tok = Tokenizer.from_file(word_codes.tokenizer_path())
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]


def check_pack(rows, docs, capacity=packing.CAPACITY):
    """Every piece of every document once, right digests, sequences gapless and full enough."""
    want = sorted(
        ((d, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes()))
         for (d, _), ids in zip(docs, encode([t for _, t in docs], 0)) for k, at in enumerate(range(0, len(ids), capacity))),
        key=str,
    )
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in rows)


def test_odd_documents(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    check_pack(packing.pack_documents(odd_docs).collect(), docs)
    assert packing.pack_documents(no_docs).collect() == []


def test_table_and_fill(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.op1_best_fit_packing(spark, sf).collect()
    n, ids = check_pack(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= 1.1 * ids / packing.CAPACITY + 4


def test_packer_is_best_fit_and_bounded():
    p = packing.BestFitPacker(10, open_bins=2)
    assert [p.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert p.open == 0
    p = packing.BestFitPacker(10, open_bins=2)
    assert [p.place(n)[0] for n in (8, 7, 6)] == [0, 1, 2]  # 8, the fullest, closed
    assert p.place(2) == (1, 7)


def test_sequences_hold_the_ids(odd_docs):
    rows = packing.sequences(odd_docs).collect()
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(x for r in rows for x in r.ids) == sorted(int(x) for ids in encode([t for _, t in docs], 0) for x in ids)


def test_word_encoder_equals_the_library():
    import pyarrow as pa

    enc, plain = word_codes.WordEncoder(word_codes.tokenizer_path()), Tokenizer.from_file(word_codes.tokenizer_path())
    texts = ["hello <|endoftext|> world", "<|startoftext|>", "a<|endoftext|><|endoftext|>É", "<|ENDOFTEXT|> <|endoftext|", "", "a♡b ♡ x", "İstanbul É.,x", "don't I'LL <|endoftext|> 12ab.", "̸ ≮ z\u0085y é.", "ΣΑΣ. ß, 漢字, a" * 3, "x" * 500, "ét. ÉT,", None]
    for _ in range(2):
        ids, at = enc.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_other_files_are_left_to_the_library():
    import public_tokenizers
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, plain = word_codes.WordEncoder(path), Tokenizer.from_file(path)
    assert not enc.by_words and word_codes.WordEncoder(word_codes.tokenizer_path()).by_words
    texts = ["Hello  world", "", None, "a<|endoftext|>b", " \n x"]
    ids, at = enc.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_rows_of_one_id_are_dealt_out(spark, tmp_path):
    """A third of all rows without an id, and one id for another third."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    target = f"file://{tmp_path}/hot"
    token_store.write_store(docs, target)
    got = sorted(token_store.read_store(spark, target).collect(), key=lambda r: r.start)
    want = {d: sorted(len(x) for (e, _), x in zip(rows, encode([t for _, t in rows], 2)) if e == d) for d, _ in rows}
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert {d: sorted(r.n_tokens for r in got if r.doc_id == d) for d in want} == want


def test_slices_of_a_batch():
    import pyarrow as pa

    enc = word_codes.WordEncoder(word_codes.tokenizer_path())
    texts = pa.array([f"Wort {i} ÄB x" for i in range(40)])
    ids, at = enc.encode(texts.slice(17, 9))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [enc._ids(f"Wort {i} ÄB x") for i in range(17, 26)]


def test_store_round_trip(spark, odd_docs, no_docs, tmp_path):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    target = f"file://{tmp_path}/store"
    token_store.write_store(odd_docs, target)
    rows = sorted(token_store.read_store(spark, target, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    want = sorted((str(d), ids.tolist(), zlib.crc32(ids.tobytes())) for (d, _), ids in zip(docs, encode([t for _, t in docs], 2)))
    assert sorted((str(r.doc_id), r.ids, r.ids_crc32) for r in rows) == want
    blocks = spark.read.parquet(f"{target}/blocks")
    assert token_store.holding(blocks, 10**9).count() == 0 and token_store.holding(blocks, 8).count() > 0
    plan = token_store.holding(blocks, 8)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(first_doc), IsNotNull(last_doc)" in plan  # what follows is cut in the plan's text
    assert [x.tolist() for x in token_store.read_document(spark, target, 8)] == [encode(["one two"], 2)[0].tolist()]
    token_store.write_store(no_docs, f"{target}-empty")
    assert token_store.read_store(spark, f"{target}-empty").collect() == []


def test_block_refuses_another_dictionary():
    import pytest

    data = token_store.encode_block([1], [np.array([5, 6], "<u4")], b"")
    assert token_store.Block(data, b"").ids(0).tolist() == [5, 6]
    with pytest.raises(ValueError):
        token_store.Block(data, b"x" * 300)
