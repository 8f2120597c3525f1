"""Exact, batched encoding with a `tokenizers` file whose pre-tokenizer drops white space.

Such a tokenizer never merges across white space, so the ids of a text are the ids of
its white-space separated words, one after the other. A batch is therefore split and
dictionary-encoded by Arrow, each distinct stem (a word without its last marks, in lower
case) is encoded once, and the ids of all texts are gathered with numpy. The word memo is
bounded and kept between tasks of one Python worker.

The ids are those of the library with the file as it is. It cuts a text at its added tokens
before anything else, so texts that contain one are left to the library whole; and so is
every text if the file's normalizer, pre-tokenizer or model is not of the known kind.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_FILE = "word_bpe_49k.json"
MEMO_WORDS = 400_000  # entries kept between batches; beyond it the memo starts anew
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
# fixed values: the parts of a file that the splitting by words is right for
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
KNOWN_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
KNOWN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
_ENCODERS: dict[str, "WordEncoder"] = {}


def large_strings(texts: pa.Array) -> pa.Array:
    """Strings with 64-bit offsets from 0 on, null as empty. (A slice is copied first:
    string kernels go wrong on a cast slice, whose offsets start elsewhere.)"""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    return pc.fill_null(texts.cast(pa.large_string()), "")


def tokenizer_path(name: str = DEFAULT_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "WordEncoder":
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class WordEncoder:
    SEPARATOR = "♡"  # a word of its own, of one id, between the words of one call

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        self.by_words = (
            parts["normalizer"] == KNOWN_NORMALIZER
            and parts["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [KNOWN_SPLIT, KNOWN_BYTES]}
            and {k: v for k, v in parts["model"].items() if k not in ("vocab", "merges")} == KNOWN_MODEL
            and parts["post_processor"] is parts["truncation"] is parts["padding"] is None
            and not any(t["normalized"] or t["single_word"] for t in parts["added_tokens"])
        )
        self.added = "|".join(re.escape(t["content"]) for t in parts["added_tokens"])
        self.mark = self._ids(self.SEPARATOR)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}  # word -> its row in starts
        self.starts = array("q", [0])
        self.pool = array("I")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _put(self, word: str, ids) -> None:
        self.memo[word] = len(self.starts) - 1
        self.pool.extend(ids)
        self.starts.append(len(self.pool))

    def _encode_new(self, words: list[str]) -> None:
        """Encode words that the memo lacks, many to a call, told apart by the mark."""
        plain, odd = [], []
        for w in words:
            (odd if self.SEPARATOR in w or len(w) > 200 or len(self.mark) != 1 else plain).append(w)
        joined = [f" {self.SEPARATOR} ".join(plain[i : i + 512]) for i in range(0, len(plain), 512)]
        encoded = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        for i in range(0, len(plain), 512):
            part = plain[i : i + 512]
            ids = encoded[i // 512].ids
            if ids.count(self.mark[0]) != len(part) - 1:  # some word makes the mark's id
                odd.extend(part)
                continue
            at = 0
            for w in part[:-1]:
                end = ids.index(self.mark[0], at)
                self._put(w, ids[at:end])
                at = end + 1
            self._put(part[-1], ids[at:])
        for w in odd:
            self._put(w, self._ids(w))

    def _rows(self, words: pa.Array) -> np.ndarray:
        """The memo's row of each word; words that it lacks are encoded."""
        known = words.to_pylist()
        rows = list(map(self.memo.get, known))
        if None in rows:
            self._encode_new([w for w, r in zip(known, rows) if r is None])
            rows = list(map(self.memo.get, known))
        return np.array(rows, np.int64)

    @staticmethod
    def _split(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words as stems and last marks. Latin letters are lower-cased by the tokenizer in
        any case, and marks (but the apostrophe) after letters are a run of their own, so
        both can be encoded apart; any other word is all stem."""
        stems = pc.ascii_rtrim(words, characters=MARKS)
        plain = pc.match_substring_regex(stems, f"^[{LATIN}]+$")
        marks = pc.replace_substring_regex(words, f"^[{LATIN}]+", "")
        return pc.if_else(plain, pc.ascii_lower(stems), words), pc.if_else(plain, marks, "")

    @staticmethod
    def _gather(starts: np.ndarray, pool: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all rows one after the other, end of each row)."""
        firsts = starts[rows]
        n = starts[rows + 1] - firsts
        ends = np.cumsum(n)
        return pool[np.repeat(firsts - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts (null: empty) in one array, and the n+1 offsets of the texts."""
        texts = large_strings(texts)
        if len(texts) == 0:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        whole = pc.match_substring_regex(texts, self.added) if self.by_words and self.added else pa.array([not self.by_words] * len(texts))
        at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if not len(at):
            return self._by_words(texts)
        ids, offsets = self._by_words(pc.if_else(whole, "", texts))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.take(pa.array(at)).to_pylist(), add_special_tokens=False)]
        sizes = np.diff(offsets)
        sizes[at] = list(map(len, found))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(ends[-1]), np.uint32)
        own = np.zeros(len(texts), bool)
        own[at] = True
        out[np.repeat(~own, sizes)] = ids
        for i, x in zip(at, found):
            out[ends[i] : ends[i + 1]] = x
        return out, ends

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        parts = [part.dictionary_encode() for part in self._split(coded.dictionary)]
        rows = [self._rows(x.dictionary)[x.indices.to_numpy(zero_copy_only=False)] for x in parts]
        # the distinct words of this call, then all of its words
        starts, pool = np.frombuffer(self.starts, np.int64), np.frombuffer(self.pool, np.uint32)
        own, ends = self._gather(starts, pool, np.stack(rows, 1).reshape(-1))
        ids, ends = self._gather(np.concatenate([[0], ends[1::2]]), own, coded.indices.to_numpy(zero_copy_only=False))
        return ids, np.concatenate([[0], ends])[bounds - bounds[0]]
