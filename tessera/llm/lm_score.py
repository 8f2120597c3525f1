"""Language-model scores by a weighted backoff automaton.

The model is a smoothed trigram model (``ORDER`` words) over all training documents. As an
automaton: the root state has an arc for every known word and one for all unknown ones.
Every word, and every pair of words, that goes on in a training document is a state, with
an arc for each word that followed it and a failure arc to the state of one word less. One
left-to-right traversal carries the state: where the state has an arc for the next word it
is taken; otherwise the failure arc's weight is paid and its target is asked.

    root:    P(w) = (c(w) - D) / N for known words, P(unknown) = D V / N,
             D = n1 / (n1 + 2 n2) by the words seen once and twice
    state h: P(w | h) = (c(h w) + M P(w | h')) / (c(h) + M) on an arc, h' being h without
             its first word; failure weight M / (c(h) + M)

so each state is a distribution. All counts are exact and cover all training documents.

Neither the words nor the n-grams of a corpus fit into one task, and they are not broadcast.
Documents are packed into blocks of bounded size; a long document is cut into pieces, each
with the words before it, which give the state that the traversal goes on from. A block needs the part of the
automaton that its own texts can reach. For each order it sends its distinct n-grams, as
sorted 64-bit hashes, delta-coded, with its own training counts, to the tasks that hold
their range of hashes. A range adds up what the blocks sent and answers every block in the
order of its request, so an answer is a list of numbers without keys. The block then builds
its states and arcs and traverses its texts. A block sends nothing to a range of which it
has no n-gram, so there are never more rows than (block, n-gram) pairs; the bytes follow
the input in proportion.

Defined cases: a null or empty text is the end token alone; held-out documents are scored
but not learned from; a null doc_id is learned from as if its remainder were not 0; repeated
rows are learned and scored once each; with no training tokens every probability is that
of the unknown word (1); an empty table gives an empty result. N-grams are told apart by
64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import mix64, word_hashes
from tessera.session import materialize, ship

ORDER = 3
BLOCK_CHARS = 6 << 20  # of text in a block, about
PIECE_CHARS = 16 << 10  # of text in a piece of a document, about
CHUNK_CHARS = 1 << 20  # of text that is hashed at once, about
RANGE_KEYS = 1 << 20  # n-grams that a range receives, about
M = (50.0, 50.0)  # weight of the next lower order, in states of one and of two words
HELD_OUT_OF = 10
END = 0x9AE16A3B2F90404F  # hash of the end token
START = 0xC3A5C85C97CB3127  # hash of the state before the first token
PAD = 0xB492B66FBE98F273  # what stands before it

_SPACE = re.compile("[ \t-\r]")


def pieces(text: str, size: int) -> Iterator[str]:
    """A text cut at white space into pieces of about ``size`` characters."""
    at = 0
    while len(text) - at > size:
        cut = _SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all texts, words of each text). Only A-Z are lowered,
    only ASCII white space splits."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts, _, (hashes,) = word_hashes(b" ".join(raw))
    bounds = np.cumsum([len(x) + 1 for x in raw])
    return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, times of each)."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def pack_numbers(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpack_numbers(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def pack_counts(x: np.ndarray) -> bytes:
    """Whole numbers as byte planes, without the planes that are empty."""
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T
    width = int(x.max()).bit_length() // 8 + 1 if len(x) else 1
    return bytes([min(width, 8)]) + pack_numbers(planes[: min(width, 8)])


def unpack_counts(data: bytes) -> np.ndarray:
    planes = unpack_numbers(data[1:], np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").reshape(-1).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as byte planes of their differences: few bytes each."""
    return pack_counts(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_counts(data).astype(np.uint64), dtype=np.uint64)


_BLOCK = "block long, rows array<long>, doc_ids array<long>, learned array<boolean>, sizes array<long>, vocabulary binary, tokens binary"


class _Chunk:
    """Pieces of documents whose words have been hashed: for each piece the row number, the
    doc_id, whether it is learned from, and whether its document begins with it."""

    def __init__(self, pieces: list[tuple], texts: list[str]):
        self.rows, self.ids, self.learned, self.begins, last = zip(*pieces)
        words, sizes = words_of(texts)
        # the end token is put behind the last word of each document
        self.tokens = np.insert(words, np.cumsum(sizes)[np.array(last)], np.uint64(END))
        self.sizes = sizes + np.array(last)


def _pack_block(number: int, chunks: list[_Chunk], order: int, before: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """A block of whole chunks, each piece with the order - 1 tokens before it, and the last
    tokens, for a piece that goes on in the next block."""
    context = order - 1
    words = np.concatenate([c.tokens for c in chunks])
    join = lambda name: [x for c in chunks for x in getattr(c, name)]
    sizes = np.array(join("sizes"), np.int64)
    # documents begin after pads and the start; other pieces after the tokens before them
    head = np.array([PAD] * (context - 1) + [START], np.uint64)
    parts, at = [], 0
    for n, fresh in zip(sizes.tolist(), join("begins")):
        lead = head if fresh else before
        parts += [lead, words[at : at + n]]
        at += n
        before = words[at - context : at] if n >= context else np.concatenate([lead, words[at - n : at]])[n:]
    words = np.concatenate(parts)
    order_of = np.argsort(words)
    new = np.concatenate([[True], np.diff(words[order_of]) != 0])
    tokens = np.empty(len(words), np.int64)
    tokens[order_of] = np.cumsum(new) - 1
    row = {
        "block": pa.array([number], pa.int64()),
        "rows": pa.array([join("rows")], pa.list_(pa.int64())),
        "doc_ids": pa.array([join("ids")], pa.list_(pa.int64())),
        "learned": pa.array([join("learned")], pa.list_(pa.bool_())),
        "sizes": pa.array([sizes + context], pa.list_(pa.int64())),
        "vocabulary": pa.array([pack_keys(words[order_of[new]])], pa.binary()),
        "tokens": pa.array([pack_counts(tokens)], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(row), before


def _blocks(order: int, block_chars: int, piece_chars: int):
    """Pieces of documents packed into blocks; pieces of one document have its row number.
    Tokens are places in the block's sorted vocabulary of word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: list[_Chunk] = []
        held: list[tuple] = []
        texts: list[str] = []
        number = size = waiting = 0
        before = np.empty(0, np.uint64)
        for batch in batches:
            for row, doc_id, ok, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "learned", "text"))):
                # a partition's row numbers are its own: so are its block numbers
                base = row >> 33 << 33
                parts = list(pieces(text or "", piece_chars))
                for k, part in enumerate(parts):
                    if size + waiting and size + waiting + len(part) + 16 > block_chars:
                        chunks.append(_Chunk(held, texts))
                        out, before = _pack_block(base + number, chunks, order, before)
                        yield out
                        number, size, waiting = number + 1, 0, 0
                        chunks, held, texts = [], [], []
                    elif waiting > CHUNK_CHARS:
                        chunks.append(_Chunk(held, texts))
                        size, waiting = size + waiting, 0
                        held, texts = [], []
                    held.append((row, doc_id, ok, k == 0, k == len(parts) - 1))
                    texts.append(part)
                    waiting += len(part) + 16
        if held:
            chunks.append(_Chunk(held, texts))
            yield _pack_block(base + number, chunks, order, before)[0]

    return run


class Block:
    """The tokens of a block's pieces, and its n-grams of each order."""

    def __init__(self, row: dict, order: int):
        self.order = order
        self.vocabulary = unpack_keys(row["vocabulary"])
        self.tokens = unpack_counts(row["tokens"])
        self.words = self.vocabulary[self.tokens]
        self.sizes = np.array(row["sizes"], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.learned = np.array(row["learned"], bool)
        place = np.arange(len(self.tokens)) - np.repeat(self.firsts, self.sizes)
        pads = np.add.reduceat((self.words == np.uint64(PAD)).astype(np.int64), self.firsts)
        start = (self.words == np.uint64(START)) & (place == order - 2)
        self.scored = place >= order - 1  # the tokens before a piece are scored elsewhere
        self.depth = place + 1 - np.repeat(pads, self.sizes)  # tokens from the document's start on, up to this one
        # what is counted here: scored tokens, and the start of documents as a state's word
        learned = np.repeat(self.learned, self.sizes)
        self.counted = {n: (self.scored | start if n == 1 else self.scored & (self.depth >= n)) & learned for n in range(1, order + 1)}

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n-gram that ends at each token (to be used where depth >= n)."""
        keys = self.words
        for k in range(1, n):
            before = np.zeros_like(keys)
            before[k:] = self.words[:-k]
            keys = mix64(before * np.uint64(0x9E3779B97F4A7C15) + keys * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k))
        return keys

    def request(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct n-grams, own training count of each)."""
        if n == 1:
            return self.vocabulary, np.bincount(self.tokens[self.counted[1]], minlength=len(self.vocabulary))
        keys = self.grams(n)
        distinct, counts = runs(keys[self.counted[n]])
        every, _ = runs(keys[self.depth >= n])
        out = np.zeros(len(every), np.int64)
        out[np.searchsorted(every, distinct)] = counts
        return every, out

    def places(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the n-gram that ends at each token, -1 where there is none; a token at
        which each n-gram ends). Numbers are places in the request."""
        at = np.flatnonzero(self.depth >= n)
        if n == 1:
            some = np.empty(len(self.vocabulary), np.int64)
            some[self.tokens] = np.arange(len(self.tokens))
            return self.tokens, some
        keys = self.grams(n)[at]
        order = np.argsort(keys)
        keys = keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
        number = np.full(len(self.tokens), -1, np.int64)
        number[at[order]] = np.cumsum(new) - 1
        return number, at[order[new]]


def _ask(n: int, order: int, bits: int):
    """What a block asks for: (range, block, keys, counts) for each range it has n-grams of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, counts = Block(row, order).request(n)
                number = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
                for lo in range(0, len(cuts) - 1, 64):
                    spans = list(zip(cuts[lo : lo + 64].tolist(), cuts[lo + 1 : lo + 65].tolist()))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "range": pa.array([int(number[a]) for a, _ in spans], pa.int64()),
                            "block": pa.array([row["block"]] * len(spans), pa.int64()),
                            "keys": pa.array([pack_keys(keys[a:b]) for a, b in spans], pa.binary()),
                            "counts": pa.array([pack_counts(counts[a:b]) for a, b in spans], pa.binary()),
                        }
                    )

    return run


_ANSWER = "n int, `range` long, block long, counts binary, tokens long, distinct_words long, once long, twice long"


def _answer(n: int):
    """All requests of one range: the sums over the blocks, in each request's order. The
    first row also has the range's figures: tokens, distinct words, seen once, seen twice."""

    def run(key: tuple, frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = key[0].as_py()
        blocks, keys, counts = [], [], []
        for batch in frames:
            for row in batch.select(["block", "keys", "counts"]).to_pylist():
                blocks.append(row["block"])
                keys.append(unpack_keys(row["keys"]))
                counts.append(unpack_counts(row["counts"]))
        cuts = np.concatenate([[0], np.cumsum(list(map(len, keys)))])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        keys.clear()
        total = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)  # exact below 2**53
        own = total if n > 1 else total[(distinct != np.uint64(START)) & (distinct != np.uint64(PAD))]
        figures = [int(own.sum()), int((own > 0).sum()), int((own == 1).sum()), int((own == 2).sum())]
        for at in range(0, len(blocks), 256):
            some = range(at, min(at + 256, len(blocks)))
            out = {
                "n": pa.array([n] * len(some), pa.int32()),
                "range": pa.array([number] * len(some), pa.int64()),
                "block": pa.array([blocks[i] for i in some], pa.int64()),
                "counts": pa.array([pack_counts(total[place[cuts[i] : cuts[i + 1]]]) for i in some], pa.binary()),
            }
            for name, value in zip(("tokens", "distinct_words", "once", "twice"), figures):
                out[name] = pa.array([value if i == 0 else 0 for i in some], pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    return run


class Root:
    """The root state: unigram figures of the training documents."""

    def __init__(self, tokens: int, distinct: int, once: int, twice: int):
        self.n, self.v = tokens, distinct
        self.discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def p(self, c: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(c))
        return np.where(c > 0, (c - self.discount) / self.n, self.discount * self.v / self.n)


class Automaton:
    """States with failure arcs and weighted arcs.

    ``grams[n]`` (n from 2 on) has arrays (history, suffix, count) of n-grams: the numbers of
    the (n-1)-grams without the last and without the first word, and the training count.
    ``counts`` are those of the single words, whose numbers are their places; the start's is
    among them. State 0 is the root. A state is an n-gram that was seen, as a history. Arc a
    of order n leads from state ``source[n][a]``, by the last word of n-gram a, with the log10
    weight ``weight[n][a]``, to ``target[n][a]``; an n-gram that was not seen is no arc (source
    -1). The root has an arc for every word.
    """

    def __init__(self, root: Root, counts: np.ndarray, grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], m: tuple[float, ...]):
        self.order = max(grams, default=1)
        p, seen = root.p(counts), counts > 0
        number = np.where(seen, np.cumsum(seen), 0)  # each word's state; the root where it has none
        self.source, self.target, self.weight = {1: np.zeros(len(counts), np.int64)}, {1: number}, {1: np.log10(p)}
        fail, total, orders = [np.zeros(1 + int(seen.sum()), np.int64)], [np.ones(1), counts[seen].astype(float)], [np.zeros(1, np.int8), np.ones(int(seen.sum()), np.int8)]
        states = 1 + int(seen.sum())
        below, own = p, number  # P(word | history) and state of the n-grams of the order below
        held = counts
        for n in range(2, self.order + 1):
            history, suffix, count = grams[n]
            seen = count > 0
            prob = (count + m[n - 2] * below[suffix]) / (held[history] + m[n - 2])
            self.source[n] = np.where(seen, own[history], -1)
            if n < self.order:
                number = np.where(seen, states - 1 + np.cumsum(seen), 0)
                self.target[n] = number
                fail.append(own[suffix[seen]])
                total.append(count[seen].astype(float))
                orders.append(np.full(int(seen.sum()), n, np.int8))
                states += int(seen.sum())
            else:
                number = None
                self.target[n] = own[suffix]  # the longest history that is a state
            self.weight[n] = np.log10(np.where(seen, prob, 1.0))
            below, own, held = prob, number, count
        self.fail = np.concatenate(fail)
        self.orders = np.concatenate(orders)
        prior = np.array([1.0, *m])[self.orders]
        self.fail_weight = np.log10(prior / (np.concatenate(total) + prior))
        self.fail_weight[0] = 0.0

    def step(self, state: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 weight) from each state on its next word. ``grams[n - 1]`` are the
        numbers of the n-grams that the word ends: of these, one can be the state's arc. A
        state without an arc pays for its failure arc, and that state is asked."""
        weight, target = np.zeros(len(state)), np.empty(len(state), np.int64)
        todo, now = np.arange(len(state)), state
        for n in range(self.order, 0, -1):  # states of n - 1 words; they fail to shorter ones
            if n > 1:
                here = self.orders[now] == n - 1
                arc = grams[n - 1][todo]
                hit = here & (arc >= 0) & (self.source[n][arc] == now)
                fails = here & ~hit
                weight[todo[fails]] += self.fail_weight[now[fails]]
                now = np.where(fails, self.fail[now], now)
                done, arc = todo[hit], arc[hit]
                todo, now = todo[~hit], now[~hit]
            else:
                done, arc = todo, grams[0][todo]
            weight[done] += self.weight[n][arc]
            target[done] = self.target[n][arc]
        return target, weight

    def traverse(self, places: list[np.ndarray], firsts: np.ndarray, sizes: np.ndarray, skip: int) -> np.ndarray:
        """Sum of the weights over each sequence of tokens from its token ``skip`` on (those
        before it only lead to a state). All sequences are traversed side by side, from left
        to right, each with its own state. ``places[n - 1]`` has the number of the n-gram
        that ends at each token."""
        by_size = np.argsort(-sizes, kind="stable")
        firsts, sizes = firsts[by_size], sizes[by_size]
        total, state, active = np.zeros(len(sizes)), np.zeros(len(sizes), np.int64), len(sizes)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            while active and sizes[active - 1] <= t:
                active -= 1
            at = firsts[:active] + t
            state, weight = self.step(state[:active], [x[at] for x in places])
            if t >= skip:
                total[:active] += weight
        out = np.empty(len(sizes))
        out[by_size] = total
        return out


def block_automaton(block: Block, root: Root, counts: dict[int, np.ndarray], m: tuple[float, ...]) -> tuple[Automaton, list[np.ndarray]]:
    """The part of the automaton that a block's texts can reach, and the number of the n-gram
    of each order that ends at each token. ``counts[n]`` are the training counts."""
    places, grams = [block.places(1)[0]], {}
    for n in range(2, block.order + 1):
        number, some = block.places(n)
        grams[n] = (places[-1][some - 1], places[-1][some], counts[n])
        places.append(number)
    return Automaton(root, counts[1], grams, m), places


def _score(root: Root, order: int, m: tuple[float, ...]):
    def run(key: tuple, frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, answers = None, {n: [] for n in range(1, order + 1)}
        for batch in frames:
            for x in batch.to_pylist():
                if x["n"] == 0:
                    row = x
                else:
                    answers[x["n"]].append((x["range"], x["counts"]))
        block, counts = Block(row, order), {}
        for n, got in answers.items():
            counts[n] = np.concatenate([np.empty(0, np.int64), *(unpack_counts(c) for _, c in sorted(got))])
        automaton, places = block_automaton(block, root, counts, m)
        score = automaton.traverse(places, block.firsts, block.sizes, order - 1)
        c = np.where(block.scored, counts[1][block.tokens], 0)
        base = np.where(block.scored, root.base(c), 0.0)
        add = lambda x: np.add.reduceat(x, block.firsts)
        yield pa.RecordBatch.from_pydict(
            {
                "row": pa.array(row["rows"], pa.int64()),
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "held_out": pa.array(~block.learned),
                "n_tokens": pa.array(block.sizes - (order - 1)),
                "n_known": pa.array(add((c > 0).astype(np.int64))),
                "base_score": pa.array(add(base)),
                "score": pa.array(score),
            }
        )

    return run


def _range_bits(grams: int, range_keys: int) -> int:
    """Ranges in proportion to the corpus."""
    return max(0, grams // range_keys).bit_length()


def score(
    docs: DataFrame, m: tuple[float, ...] = M, order: int = ORDER, block_chars: int = BLOCK_CHARS, piece_chars: int = PIECE_CHARS, range_keys: int = RANGE_KEYS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    ship(docs.sparkSession)
    learned = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_OF != 0, F.lit(True))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), learned.alias("learned"), F.col("text").cast("string")
    )
    blocks = materialize(rows.mapInArrow(_blocks(order, block_chars, piece_chars), _BLOCK), "lm-blocks")
    # a token makes at most one n-gram of an order, and the words of a block repeat
    n_tokens = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    figures, answers = None, None
    for n in range(1, order + 1):
        bits = _range_bits(n_tokens // 4 if n == 1 else n_tokens, range_keys)
        asked = blocks.mapInArrow(_ask(n, order, bits), "`range` long, block long, keys binary, counts binary")
        got = materialize(asked.groupBy("range").applyInArrow(_answer(n), _ANSWER), f"lm-answers-{n}")
        if n == 1:
            figures = got.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct_words", "once", "twice"))).first()
        part = got.select("block", "n", "range", "counts")
        answers = part if answers is None else answers.union(part)
    own = [c for c in blocks.columns if c != "block"]
    parts = blocks.withColumns({"n": F.lit(0), "range": F.lit(0).cast("long"), "counts": F.lit(None).cast("binary")}).unionByName(answers, allowMissingColumns=True)
    root = Root(*map(int, figures))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = parts.select("block", "n", "range", "counts", *own).groupBy("block").applyInArrow(_score(root, order, m), schema)
    # a document of several pieces is put together
    whole = scored.groupBy("row").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "held_out")), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))
    )
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(root.n).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
