import hashlib
import itertools
import random

import numpy as np
import pytest
from tokenizers import Tokenizer as Library

from tessera.llm import bpe_transducer as bpe
from tessera.llm.word_codes import tokenizer_path


@pytest.fixture(scope="module")
def library():
    t = Library.from_file(tokenizer_path())
    t.no_truncation(), t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(tokenizer_path())


def of(encoder, text):
    return np.frombuffer(b"".join(encoder.encode(text)), np.uint32).tolist()


ODD = [
    "", " ", "a", "it's we'll I'D '' 'sss !'s '", "<|endoftext|>", "x<|startoftext|>'s<|endoftext|><|endoftext|", "<|endoftext|", "İstanbul ΑΣ ſ ß ǅ",
    "é e ́ ́e ộ ̈́ ạ̀̕ 각 ᅡ", "१२ ٣ Ⅷ ½ ² 12345", "a\x1cb \x1d \x85c\xa0d e　f​g﻿\x00",
    "漢字かな交じり文" * 50, "😀👩‍👩‍👧‍👦🇩🇪", "क़ড় Ω יִ \U0001d15e", "#$%^&*()_+" * 9, "don't-stop.it's", "ำຳ ไทยภาษา", "\U0010ffff͸",
]


def test_odd_texts_equal_the_library(encoder, library):
    for text in ODD:
        assert of(encoder, text) == library.encode(text, add_special_tokens=False).ids, text


def test_random_texts_equal_the_library(encoder, library):
    rng = random.Random(5)
    letters = ["abcdefghijklmnopqrstuvwxyz", "thean in er", "ABé ñÖ'.,!", "0123456789 ", "̣́e o", "漢字語 、", "\n\t \xa0 ", "<|endoftext|>", "각", "😀‍️"]
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(letters)) if rng.random() < 0.97 else rng.choice(["<|endoftext|>", "'s", "'ll", " "]) for _ in range(rng.choice([3, 20, 200])))
        assert of(encoder, text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_character_has_the_librarys_form(encoder, library):
    """All characters of the first planes, each beside letters and marks."""
    for start in range(0, 0x20000, 256):
        text = " ".join(f"a{c}̣{c}1" for c in map(chr, range(start, start + 256)) if not 0xD800 <= ord(c) < 0xE000)
        assert of(encoder, text) == library.encode(text, add_special_tokens=False).ids, hex(start)


def test_blocks_do_not_change_ids(encoder, library, monkeypatch):
    """Any block size, also through words that are longer than all windows."""
    rng = random.Random(6)
    long_word = "".join(rng.choice("theaninerorqzx") for _ in range(30_000))
    texts = [*ODD, long_word, "漢字" * 4000, "'" * 3000 + "s", "e" + "̣́" * 2000 + "x", ("ab'll" * 3 + "<|endoftext|>") * 300, "a" * 20_000, "!?" * 9000 + "1" * 3000]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        for size in (1, 7, 1000) if len(text) < 5000 else (997,):
            stream = bpe.Stream(encoder.t)
            got = [i for at in range(0, len(text), size) for i in stream.feed(text[at : at + size])] + stream.finish()
            assert got == want, (size, text[:50])
            assert len(stream.transducer.held) == 0
    monkeypatch.setattr(bpe, "SLICE", 300)
    monkeypatch.setattr(bpe, "LONG", 40)
    monkeypatch.setattr(bpe, "BLOCK", 64)
    small = bpe.Encoder(tokenizer_path())
    for text in [*texts, " ".join(texts), long_word[:900] + " x " + long_word[:399] + "\x1c " + long_word[:41]]:
        assert of(small, text) == library.encode(text, add_special_tokens=False).ids, text[:50]


def test_memory_is_constant(encoder):
    """The transducer never holds more than its window, whatever the word."""
    machine, most, out = bpe.Transducer(encoder.t.merges), 0, 0
    symbols = [encoder.t.inner[b] for b in b"inthereanderation" * 2000]
    for at in range(0, len(symbols), 50):
        out += len(machine.feed(symbols[at : at + 50]))
        most = max(most, len(machine.held))
    assert most <= bpe.WINDOW * encoder.t.merges.lookahead + 51 and out > 1000


def test_lookahead_is_sufficient():
    """Against all continuations, for random small merge lists: no token that ends the
    lookahead before the end of a text is changed by what follows; and some list needs
    nearly as much as is computed."""
    rng, tight = random.Random(7), 0
    for _ in range(60):
        tokens, rules = ["a", "b", "c"], []
        while len(rules) < rng.choice([3, 6, 9]):
            left, right = rng.choice(tokens), rng.choice(tokens)
            if left + right not in tokens and len(left + right) <= 5:
                tokens.append(left + right)
                rules.append((tokens.index(left), tokens.index(right), len(tokens) - 1))
        merges = bpe.Merges(rules, {0: 1, 1: 1, 2: 1})
        ahead, need = merges.lookahead, 0
        for text in ([rng.randrange(3) for _ in range(9)] for _ in range(25)):
            alone = np.cumsum([merges.size[t] for t in merges.merge(text)]).tolist()
            for more in itertools.chain.from_iterable(itertools.product(range(3), repeat=k) for k in range(1, 6)):
                other = set(np.cumsum([merges.size[t] for t in merges.merge(text + list(more))]).tolist())
                first = next((e for e in alone if e not in other), 9)
                start = max([0, *(e for e in alone if e < first)])
                need = max(need, 9 - start if first <= 9 and first not in other else 0)
                assert all(e in other for e in alone if e <= 9 - ahead), (rules, text, more)
        tight += need >= ahead
    assert tight > 10


def test_lists_out_of_order_are_refused():
    for rules in ([(0, 1, 2), (0, 0, 3), (3, 1, 2)], [(2, 1, 3), (0, 1, 2)]):
        with pytest.raises(ValueError):
            bpe.sufficient_lookahead(rules, {0: 1, 1: 1})


def test_both_ways_of_merging_agree(encoder):
    rng = random.Random(8)
    for _ in range(300):
        symbols = [encoder.t.inner[b] for b in "".join(rng.choice(["th", "e", "an", "in", "er", "on", "q"]) for _ in range(19)).encode()]
        assert encoder.t.merges.merge(symbols) == encoder.t.merges._merge_many(symbols)


def test_decoding_in_parts(encoder, library):
    rng = random.Random(9)
    for text in ODD:
        ids = library.encode(text, add_special_tokens=False).ids + [rng.randrange(49408) for _ in range(50)]
        for size in (1, 3, 1000):
            machine = bpe.Decoder(encoder.t)
            got = "".join(machine.feed(ids[at : at + size]) for at in range(0, len(ids), size)) + machine.finish()
            assert got == library.decode(ids, skip_special_tokens=False)
    # the words themselves: characters that are cut between ids come back whole
    machine = bpe.Decoder(encoder.t, readable=True)
    ids = of(encoder, "Ein 漢字 😀 łódź")
    assert "".join(machine.feed([i]) for i in ids) + machine.finish() == "ein 漢字 😀 łódź "
    machine.begin()
    assert machine.feed([encoder.t.inner[0xE6]]) == "" and machine.feed([encoder.t.inner[0x41]]) == "�A"
    assert library.decode([1, 10**6, 2]) == (machine := bpe.Decoder(encoder.t)).feed([1, 10**6, 2]) + machine.finish()


def plain(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((str(doc_id), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out)


def test_whole_table(spark, sf, library):
    got = bpe.op12_bpe_transducer(spark, sf).collect()
    want = plain(library, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_odd_documents(spark, odd_docs, no_docs, library, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = bpe.digests(odd_docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == plain(library, rows)
    encoded = bpe.encode(odd_docs)
    ids = {(str(r.doc_id), tuple(r.ids)) for r in encoded.collect()}
    assert ids == {(str(d), tuple(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows}
    back = {(str(r.doc_id), r.text) for r in bpe.decode(encoded).collect()}
    assert back == {(d, library.decode(list(i), skip_special_tokens=False)) for d, i in ids}
    assert bpe.digests(no_docs).collect() == [] and bpe.encode(no_docs).collect() == []
    odd_ids = spark.createDataFrame([(1, None), (2, []), (3, [1, None, 10**6, -1, 2])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode(odd_ids).orderBy("doc_id").collect()] == ["", "", library.decode([1, 2])]


def test_digests_of_small_parts(encoder, library):
    hashes = bpe._Digests(encoder.t)
    small = lambda text: (ids[at : at + 12] for ids in encoder.encode(text) for at in range(0, len(ids), 12))
    assert sorted((str(k), *hashes.of(small(text))) for k, text in enumerate(ODD)) == plain(library, list(enumerate(ODD)))
