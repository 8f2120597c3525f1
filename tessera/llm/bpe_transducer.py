"""Byte-pair encoding by a transducer with bounded lookahead, and decoding by a state machine.

**Lookahead.** What follows a text can only move a token boundary in it through a chain of
merges. Let two continuations of a text be encoded side by side, and look at the first place
from which their tokens differ. It moves left when a merge (s, x) takes the equal token s
before it together with a token x that only one side has; then it lies before s. A next
merge (s', x') has a right part x' that begins with s: x' is s, or s is a left part of a
left part ... of x', used up by a rule not earlier than (s, x). Ranks rise along the chain, so
the longest chain, counted in symbols of the parts s, follows from one pass over the merges in their order:

    reach(s, x) = |s| + max(0, before[x], inside[x])

where ``before[x]`` is the largest reach of an earlier rule with left part x, and
``inside[t]``, for t made of (a, b), the larger of ``inside[a]`` and ``before[a]`` at that
rule. The largest reach is the list's sufficient lookahead (145 symbols for the given file):
a token that ends so far before the end of what has been read is never changed.

**Transducer.** It holds a few lookaheads of symbols, merges them by rank, emits the stable
tokens and goes on at the boundary behind them, where encoding may start anew. Before it
stand machines that cut out added tokens, normalize and find the ends of words, also in
blocks; what a character is and its normal form are asked of the file's own normalizer and
pre-tokenizer. Runs without white space of up to ``LONG`` characters are remembered, in a
memo of bounded size; longer ones, and words of any length, go through in blocks.

**Decoding.** The bytes of each id, as the file's decoder puts them together, go through an
incremental UTF-8 machine, so an id that ends inside a character waits for the next.

Memory does not grow with a text's length beyond the text itself, but for a run of combining
marks, whose canonical order depends on all of it. Defined cases: a null or empty text has no
ids and decodes to nothing; repeated rows and null doc_ids stay; added tokens in a text are
one id, as in the library; ids that the file lacks are left out in decoding; an empty table
gives no rows; other columns are ignored. A file of another kind, or a merge list in which
a token has two rules or is used before it is made, is refused.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.word_codes import KNOWN_BYTES, KNOWN_MODEL, KNOWN_NORMALIZER, KNOWN_SPLIT, tokenizer_path
from tessera.session import ship

SLICE = 1 << 16  # characters of a text that are split at once
LONG = 1 << 10  # longer runs are not remembered
BLOCK = 1 << 12  # characters of a long run that are fed at once
MEMO_RUNS, MEMO_WORDS = 400_000, 400_000  # entries kept between batches; beyond it a memo starts anew
WINDOW = 8  # lookaheads of symbols that the transducer merges at once
NONE = 1 << 60

# fixed values: the white space of the file's patterns, the marks of its contractions
SPACE = re.compile("[ \t\n\v\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
NOT_SPACE = "\x1c\x1d\x1e\x1f"  # which str.split() takes for space
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
KIND_RUNS = re.compile("L+|N|O+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)]


def sufficient_lookahead(rules: list[tuple[int, int, int]], sizes: dict[int, int]) -> int:
    """Of rules (left, right, made) in rank order; ``sizes``: symbols of the first tokens."""
    size, made_at = dict(sizes), set(sizes)
    before: dict[int, int] = {}
    inside: dict[int, int] = {}
    longest = 0
    for left, right, made in rules:
        if made in made_at or left not in made_at or right not in made_at:
            raise ValueError("a token has two rules or is used before it is made")
        made_at.add(made)
        size[made] = size[left] + size[right]
        reach = size[left] + max(0, before.get(right, 0), inside.get(right, 0))
        before[left] = max(before.get(left, 0), reach)
        inside[made] = max(inside.get(left, 0), before[left])
        longest = max(longest, reach)
    return longest


class Merges:
    """A merge list: ranks of pairs, what they make, and its sufficient lookahead."""

    def __init__(self, rules: list[tuple[int, int, int]], sizes: dict[int, int]):
        self.width = 1 + max([*sizes, *(made for *_, made in rules)])
        self.rank = {left * self.width + right: k for k, (left, right, _) in enumerate(rules)}
        self.made = [made for *_, made in rules]
        self.size = dict(sizes)
        self.lookahead = sufficient_lookahead(rules, sizes)
        for left, right, made in rules:
            self.size[made] = self.size[left] + self.size[right]

    def merge(self, symbols: list[int]) -> list[int]:
        """Tokens of symbols: the pair of least rank first, the leftmost of equals."""
        if len(symbols) > 40:
            return self._merge_many(symbols)
        out, width, rank = list(symbols), self.width, self.rank.get
        ranks = [rank(a * width + b, NONE) for a, b in zip(out, out[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            out[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(out[i - 1] * width + out[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(out[i] * width + out[i + 1], NONE)
        return out

    def _merge_many(self, symbols: list[int]) -> list[int]:
        out, width, rank = list(symbols), self.width, self.rank.get
        n = len(out)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(out[i] * width + out[i + 1], NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if out[i] < 0 or j >= n or rank(out[i] * width + out[j], NONE) != r:
                continue  # one of the two has been merged meanwhile
            out[i], out[j] = self.made[r], -1
            after[i] = k = after[j]
            if k < n:
                prior[k] = i
                if (r := rank(out[i] * width + out[k], NONE)) < NONE:
                    heapq.heappush(heap, (r, i))
            if (h := prior[i]) >= 0 and (r := rank(out[h] * width + out[i], NONE)) < NONE:
                heapq.heappush(heap, (r, h))
        return [x for x in out if x >= 0]


class Transducer:
    """Takes the symbols of one word bit by bit and emits tokens once they are stable."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, []

    def feed(self, symbols: list[int]) -> list[int]:
        out, ahead = [], self.merges.lookahead
        window = WINDOW * ahead + 1
        for at in range(0, len(symbols), window):
            self.held += symbols[at : at + window]
            if len(self.held) < window:
                continue
            end, stable = 0, len(self.held) - ahead
            for token in self.merges.merge(self.held):
                if end + self.merges.size[token] > stable:
                    break
                end += self.merges.size[token]
                out.append(token)
            self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.merge(self.held), []
        return out


class Table(dict):
    """A function of one character, asked once for each."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, c: str):
        found = self[c] = self.of(c)
        return found


class Tokenizer:
    """What the file says: merges, added tokens, kinds of characters, normal forms."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.no_truncation(), self.library.no_padding()
        parts = json.loads(self.library.to_str())
        if (
            parts["normalizer"] != KNOWN_NORMALIZER
            or parts["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": [KNOWN_SPLIT, KNOWN_BYTES]}
            or {k: v for k, v in parts["model"].items() if k not in ("vocab", "merges")} != KNOWN_MODEL
            or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in parts["added_tokens"])
            or (parts["decoder"] or KNOWN_BYTES)["type"] != "ByteLevel"
        ):
            raise ValueError(f"{path}: not a tokenizer of the known kind")
        self.joined = parts["decoder"] is None  # then tokens are joined by a space
        self.vocab = vocab = parts["model"]["vocab"]
        self.suffix = parts["model"]["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in parts["model"]["merges"]]
        self.letters = byte_letters()
        self.inner, self.last = [vocab[c] for c in self.letters], [vocab[c + self.suffix] for c in self.letters]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dict.fromkeys([*self.inner, *self.last], 1))
        self.added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.cuts = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.longest_added = max(map(len, self.added), default=1)
        self.kind = Table(self._kind).__getitem__
        self.may_join = Table(self._may_join).__getitem__
        self.form = Table(self._form).__getitem__

    def _kind(self, c: str) -> str:
        """L, N, O or S: letter, number, other, space, as the file's pattern has it."""
        parts = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s))
        return "S" if not parts(c) else "L" if parts("a" + c) == 1 else "N" if parts(c + c) == 2 else "O"

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        try:  # characters that do not depend on what stands before them, one by one
            return "".join(map(self.form, text))
        except LookupError:
            return self.library.normalizer.normalize_str(text)

    def _form(self, c: str) -> str:
        if self.may_join(c):
            raise LookupError(c)
        return self.library.normalizer.normalize_str(c)

    def _may_join(self, c: str) -> bool:
        """Whether a character's normal form may depend on what stands before it."""
        first = unicodedata.normalize("NFD", c)[0]
        return any(unicodedata.combining(x) or x in _seconds() or unicodedata.category(x) == "Cn" for x in (c, first))


@lru_cache(maxsize=1)
def _seconds() -> frozenset[str]:
    """Characters that may be put together with the one before them."""
    found = set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    for c in map(chr, range(0x110000)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<":
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


class Stream:
    """Text in, in blocks of any size; ids out once they are stable."""

    def __init__(self, tokenizer: Tokenizer):
        self.t, self.transducer = tokenizer, Transducer(tokenizer.merges)
        self.raw = self.unformed = self.formed = ""
        self.open = ""  # the kind of the word that is not ended yet
        self.byte: int | None = None  # its last byte so far, which may be its last at all

    def feed(self, text: str, final: bool = False) -> list[int]:
        self.raw += text
        out, at = [], 0
        for m in self.t.cuts.finditer(self.raw):
            out += self._form(self.raw[at : m.start()], True)
            out.append(self.t.added[m.group()])
            at = m.end()
        keep = len(self.raw) if final else max(at, len(self.raw) - self.t.longest_added + 1)
        out += self._form(self.raw[at:keep], final)
        self.raw = self.raw[keep:]
        return out

    def finish(self) -> list[int]:
        return self.feed("", True)

    def _form(self, text: str, final: bool) -> list[int]:
        self.unformed += text
        cut = len(self.unformed)
        if not final:
            cut -= 1
            while cut > 0 and self.t.may_join(self.unformed[cut]):
                cut -= 1
        ready, self.unformed = self.unformed[: max(0, cut)], self.unformed[max(0, cut) :]
        return self._words(self.t.normal(ready), final)

    def _words(self, text: str, final: bool) -> list[int]:
        text, kind = self.formed + text, self.t.kind
        out, at, n = [], 0, len(text)
        while at < n:
            now = kind(text[at])
            if self.open != "O" and text[at] == "'":
                if n - at < 3 and not final:
                    break  # a contraction may follow
                if found := next((c for c in CONTRACTIONS if text.startswith(c, at)), None):
                    out += self._end() + self._put(found) + self._end()
                    at += len(found)
                    continue
            if now != self.open:
                out += self._end()
                self.open = "" if now == "S" else now
            stop = at + 1
            if now == "N":  # a word of one character
                out += self._put(text[at]) + self._end()
            elif now != "S":
                while stop < n and kind(text[stop]) == now:
                    stop += 1
                out += self._put(text[at:stop])
            at = stop
        self.formed = text[at:]
        return out + self._end() if final else out

    def _put(self, piece: str) -> list[int]:
        data = piece.encode()
        symbols = [self.t.inner[b] for b in data[:-1]]
        if self.byte is not None:
            symbols.insert(0, self.t.inner[self.byte])
        self.byte = data[-1]
        return self.transducer.feed(symbols)

    def _end(self) -> list[int]:
        self.open = ""
        if self.byte is None:
            return []
        out = self.transducer.feed([self.t.last[self.byte]])
        self.byte = None
        return out + self.transducer.finish()


class Encoder:
    """Encodes texts; remembers runs and words that it has met."""

    def __init__(self, path: str):
        self.t = Tokenizer(path)
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if (found := self.words.get(word)) is None:
            data, machine = word.encode(), Transducer(self.t.merges)
            ids = machine.feed([self.t.inner[b] for b in data[:-1]] + [self.t.last[data[-1]]]) + machine.finish()
            found = self.words[word] = array("I", ids).tobytes()
        return found

    def _run(self, run: str) -> bytes:
        if len(run) <= LONG and not self.t.cuts.search(run):
            text = self.t.normal(run)
            if text.isascii():
                return b"".join(map(self._word, ASCII_WORDS.findall(text)))
            if "'" not in text:
                kinds = "".join(map(self.t.kind, text))
                return b"".join([self._word(text[m.start() : m.end()]) for m in KIND_RUNS.finditer(kinds)])
        stream = Stream(self.t)
        parts = [stream.feed(run[at : at + BLOCK]) for at in range(0, len(run), BLOCK)]
        return b"".join(array("I", p).tobytes() for p in (*parts, stream.finish()))

    def _slice(self, text: str) -> bytes:
        runs = SPACE.split(text) if any(c in text for c in NOT_SPACE) else text.split()
        found = list(map(self.runs.get, runs))
        if None in found:
            for k, have in enumerate(found):
                if have is None:
                    found[k] = ids = self._run(runs[k])
                    if len(runs[k]) <= LONG:
                        self.runs[runs[k]] = ids
        return b"".join(found)

    def encode(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text as unsigned 32-bit integers, in parts."""
        for memo, most in ((self.runs, MEMO_RUNS), (self.words, MEMO_WORDS)):
            if len(memo) > most:
                memo.clear()
        at, n = 0, len(text or "")
        while at < n:
            near = SPACE.search(text, at + SLICE, at + SLICE + LONG)
            if near or n - at <= SLICE + LONG:
                end = near.start() if near else n
                yield self._slice(text[at:end])
                at = end
                continue
            stream = Stream(self.t)  # up to the next space, wherever it is
            stop, end = at + SLICE, None
            while end is None:
                for a in range(at, stop, BLOCK):
                    yield array("I", stream.feed(text[a : min(a + BLOCK, stop)])).tobytes()
                at = stop
                near = SPACE.search(text, at, at + BLOCK)
                end = near.start() if near else n if n - at <= BLOCK else None
                stop = at + BLOCK if end is None else end
            yield array("I", stream.feed(text[at:end], True)).tobytes()
            at = end


class Decoder:
    """Bytes of ids to text, in parts; the state is an unfinished character.

    ``readable``: bytes of the words themselves, with a space where a word ends, instead of
    what the library's decode returns for the file."""

    def __init__(self, tokenizer: Tokenizer, readable: bool = False):
        byte_of = {c: b for b, c in enumerate(tokenizer.letters)}
        names = {i: t for t, i in (tokenizer.vocab | tokenizer.added).items()}
        self.first = b" " if tokenizer.joined and not readable else b""

        def data(token: str) -> bytes:
            if readable and token not in tokenizer.added:
                word, end = (token[: -len(tokenizer.suffix)], b" ") if token.endswith(tokenizer.suffix) and len(token) > len(tokenizer.suffix) else (token, b"")
                return bytes(byte_of[c] for c in word) + end
            if tokenizer.joined or readable or not all(c in byte_of for c in token):
                return self.first + token.encode()
            return bytes(byte_of[c] for c in token)

        self.table = [data(names[i]) if i in names else b"" for i in range(max(names) + 1)]
        self.begin()

    def begin(self) -> None:
        self.machine, self.started = codecs.getincrementaldecoder("utf-8")("replace"), not self.first

    def feed(self, ids: list[int]) -> str:
        try:
            data = b"".join(map(self.table.__getitem__, ids)) if min(ids, default=0) >= 0 else None
        except IndexError:
            data = None
        if data is None:  # some are not in the file
            data = b"".join([self.table[i] for i in ids if 0 <= i < len(self.table)])
        if not self.started and data:
            data, self.started = data[len(self.first) :], True
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder of a file, with what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _texts(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every text."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            ids = [np.frombuffer(b"".join(own.encode(t.as_py())), np.uint32) for t in batch.column("text")]
            offsets = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, readable: bool = False) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids); null ids decode to nothing."""
    ship(encoded.sparkSession)
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Decoder(encoder(path).t, readable)
        for batch in batches:
            out = []
            for row in batch.column("ids"):
                machine.begin()
                ids = [x for x in row.as_py() or () if x is not None]
                out.append("".join([machine.feed(ids[at : at + SLICE]) for at in range(0, len(ids), SLICE)] + [machine.finish()]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids")).mapInArrow(run, "doc_id long, text string")


class _Digests:
    """Hashes of the ids of one text after the other, and of what they decode to."""

    def __init__(self, tokenizer: Tokenizer):
        self.decoder = Decoder(tokenizer)
        self.decimals = [b"%d" % i for i in range(len(self.decoder.table))]

    def of(self, parts: Iterator[bytes]) -> tuple[int, str, str]:
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
        self.decoder.begin()
        for part in parts:
            ids = np.frombuffer(part, np.uint32).tolist()
            if ids:
                of_ids.update((b" " if n else b"") + b" ".join(map(self.decimals.__getitem__, ids)))
                of_text.update(self.decoder.feed(ids).encode())
                n += len(ids)
        of_text.update(self.decoder.finish().encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, which is encoded and
    decoded in parts."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        hashes = _Digests(own.t)
        for batch in batches:
            found = [hashes.of(own.encode(text.as_py())) for text in batch.column("text")]
            n, of_ids, of_text = zip(*found) if found else ((), (), ())
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_bpe_transducer(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
