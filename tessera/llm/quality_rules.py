"""Quality rules as a short-circuit cascade.

Each rule rejects or passes a document. On a bounded sample the cascade measures what a
rule costs and how much it rejects, orders the rules by rejection per cost, and then stops
at the first rule that rejects. The order changes the work, never the verdict: a document
is kept exactly if no rule rejects it.

Words are runs of anything but ASCII white space. Defined cases: a null text has no words
and fails the base rule; the last line counts with or without a line end; repeated rows
get a verdict each; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import hash_sample
from tessera.session import ship

SAMPLE_DOCS = 400  # whole documents that costs and selectivities are estimated on
SAMPLE_CHARS = 1 << 16  # of which no document has more
LONG_WORDS = 100_000  # in a longer text windows are compared as numbers, not as tuples
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"


class TextFacts:
    """Facts of one text, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, SPACE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        if len(w) > LONG_WORDS:
            return _repeat_words(w)
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        times = Counter(windows)
        n = end = 0  # words before `end` are counted
        for i, window in enumerate(windows):
            if times[window] > 1:
                n += i + 3 - max(i, end)
                end = i + 3
        return n

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words

    @cached_property
    def letters(self) -> tuple[int, int]:
        """(upper-case, other) ASCII letters."""
        upper = len(self.raw) - len(self.raw.translate(None, bytes(range(65, 91))))
        return upper, len(self.raw) - len(self.raw.translate(None, bytes(range(97, 123))))

    @cached_property
    def n_bare_words(self) -> int:
        """Words of punctuation and symbols alone."""
        marks = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
        return sum(not x.strip(marks) for x in self.words)


def _repeat_words(words: list[bytes]) -> int:
    """``n_repeat_words`` of a long text: the windows are sorted as triples of word numbers."""
    import numpy as np

    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    order = np.lexsort((c, b, a))
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1]) & (c[order][1:] == c[order][:-1])
    again = np.zeros(len(order), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(again)] |= again
    return int(hit.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[TextFacts], bool]


DEFAULT_RULES = (
    Rule("base", lambda t: t.base_failed),
    Rule("symbols", lambda t: 10 * t.n_symbols > 2 * t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 14 * t.n_words),
    Rule("duplicate_lines", lambda t: 10 * t.n_dup_lines > 3 * len(t.lines)),
    Rule("upper_case", lambda t: t.letters[0] > t.letters[1]),
    Rule("bare_words", lambda t: 10 * t.n_bare_words > 3 * t.n_words),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    cost: float  # seconds a document
    rejected: float  # share of the sample


def order_rules(texts: list[str | None], rules: tuple[Rule, ...]) -> tuple[tuple[Rule, ...], list[Estimate]]:
    """Rules by rejection per cost, highest first (ties: as given), and the estimates."""
    estimates = []
    for rule in rules:
        facts = [TextFacts(x) for x in texts]  # anew: no rule profits from another's facts
        began = time.perf_counter()
        rejected = sum(rule.rejects(x) for x in facts)
        cost = (time.perf_counter() - began) / max(1, len(texts))
        estimates.append(Estimate(rule.name, max(cost, 1e-9), rejected / max(1, len(texts))))
    ranked = sorted(range(len(rules)), key=lambda i: -estimates[i].rejected / estimates[i].cost)
    return tuple(rules[i] for i in ranked), [estimates[i] for i in ranked]


def sample_texts(docs: DataFrame, n: int = SAMPLE_DOCS) -> list[str | None]:
    """A bounded sample of whole texts, none of them very long, the same for the same rows."""
    short = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    return [r.text for r in hash_sample(short, n, ties=(F.length("text"),)).collect()]


def first_rejection(facts: TextFacts, rules: tuple[Rule, ...]) -> str | None:
    return next((r.name for r in rules if r.rejects(facts)), None)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, sample_docs: int = SAMPLE_DOCS, stats: bool = False) -> DataFrame:
    """doc_id, kept, rejected_by (the rule at which the cascade stopped; as the order is
    measured, another rule that rejects too may be named in another run), and with ``stats``
    the base facts of every document."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered, _ = order_rules(sample_texts(docs, sample_docs), rules)
    facts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if stats else []
    schema = "doc_id long, kept boolean, rejected_by string" + "".join(f", {x} long" for x in facts) + ", base_failed boolean" * stats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for value in batch.column("text"):
                t = TextFacts(value.as_py())
                by = first_rejection(t, ordered)
                out.append((by is None, by, *(getattr(t, x) for x in facts), *([t.base_failed] * stats)))
            names = ["kept", "rejected_by", *facts, *["base_failed"] * stats]
            kinds = [pa.bool_(), pa.string(), *[pa.int64()] * len(facts), *[pa.bool_()] * stats]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *names]
            )

    return docs.mapInArrow(run, schema)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects."""
    ship(docs.sparkSession)
    ordered, _ = order_rules(sample_texts(docs, sample_docs), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([first_rejection(TextFacts(v.as_py()), ordered) is None for v in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, stats=True).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
