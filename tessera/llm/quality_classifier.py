"""Quality classifier by co-training two views.

One classifier sees the text's content: which words and beginnings of words it has, and
statistics of words (how long, how many different ones, shares of marks, symbols, digits and capitals). The
other sees the page's metadata: source, language, length and how its lines are laid out, and
pairs of these, but no word. No feature is in both. Starting from
labelled documents, in every round each classifier names the unlabelled documents that it
is most sure of, and these pseudo-labels join the other classifier's training set. All
unlabelled documents are scored in every round, and the most confident ones of all are
taken. At the end each view is calibrated on labelled documents that it was not fitted on,
and the calibrated views are combined by a logistic regression on a third part of the
labelled documents. Every document is then scored from its whole text.

A document counts as good if its label says quality and does not say toxic.

Features are hashed to 2**``BITS`` numbers a view in a map over all documents and written once,
as sorted arrays of numbers; the rounds read that table. What reaches the driver is the
features of at most ``LABELLED`` labelled documents (smallest hash of doc_id) and of
4 ``PER_ROUND`` pseudo-labelled ones a round; a document has at most 2**``BITS`` features a view.

Defined cases: a null text has no words; a very long text is read whole, one at a time; a null source or language is a value of its own;
labels without a quality are ignored, and of several labels for one document the worst
holds; of several rows with a labelled doc_id the one with the least hash of its features
is learned from; pseudo-labels go to distinct contents, so copies count once; with no labels
of both kinds every document is kept with a null score; repeated rows are scored once each;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import hash_sample
from tessera.llm.words import SPACE, word_hashes
from tessera.session import materialize, ship

LABELLED = 4000
ROUNDS, PER_ROUND, SURE = 3, 50, 0.97
PSEUDO_WEIGHT = 0.25  # of a pseudo-label beside a label
BITS = 20  # of the features of a view; those of the metadata view follow those of the text view
NUMBERS = 2 << BITS
L1 = 1e-3  # gradient of the mean loss that a feature must exceed
MIN_DOCS = 5  # documents fitted on that must have a word for it to count
THRESHOLD = 0.5
MIX_RIDGE = 0.005  # how strongly the mix is drawn to the sum of the views

EDGES = b".,;:!?\"'()[]{}%&#$*|<>"  # these end a word as white space does
BEGINNINGS = (4, 6)  # bytes
CHUNK_BYTES = 1 << 20  # of texts that are hashed at once, about
_UPPER, _SYMBOLS, _MARKS, _DIGITS = (bytes(x) for x in (range(65, 91), b"#*$%&|<>", b"!?", b"0123456789"))

#: statistics of the words and of the page's layout, with the edges of their bins; no statistic is in both views
WORDING = {
    "words": (5, 20, 50, 200, 1000),
    "word_length": (2, 3, 5, 7, 9, 12),
    "distinct_words": (0.1, 0.3, 0.5, 0.7, 0.9),
    "symbols": (0.01, 0.05, 0.1, 0.2, 0.5),
    "marks": (0.01, 0.05, 0.2, 0.5),
    "upper": (0.02, 0.06, 0.15, 0.4),
    "digits": (0.01, 0.05, 0.2),
}
LAYOUT = {
    "n_chars": (50, 200, 1000, 4000, 16000),
    "lines": (2, 5, 20, 100),
    "line_chars": (10, 30, 60, 120, 300, 1000),
    "distinct_lines": (0.3, 0.5, 0.7, 0.9),
    "ends": (0.1, 0.3, 0.6, 0.9),
    "blank_lines": (0.01, 0.1, 0.3),
}


def _number(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data) >> (64 - BITS)


@lru_cache(65536)
def _named(*names: str) -> int:
    return _number("\t".join(names).encode("utf-8", "surrogatepass"))


def _bin(name: str, value: float) -> str:
    return f"{name}:{bisect_right((WORDING.get(name) or LAYOUT[name]), value)}"


def _view(numbers: np.ndarray, more: list[int]) -> np.ndarray:
    x = np.sort(np.concatenate([numbers, np.array(more, np.int32)]))
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def features_of(rows: Iterable[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted numbers of the features of both views of (text, source, lang, n_chars)."""
    held: list[tuple] = []
    size = 0
    for text, source, lang, n_chars in rows:
        raw = (text or "").encode("utf-8", "surrogatepass")
        held.append((raw, source, lang, n_chars))
        size += len(raw)
        if size > CHUNK_BYTES:
            yield from _features(held)
            held, size = [], 0
    yield from _features(held)


def _features(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    starts, _, (whole, *parts) = word_hashes(b" ".join(r[0] for r in rows), EDGES + SPACE, BEGINNINGS)
    bounds = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(r[0]) + 1 for r in rows]))])
    numbers = np.stack([x >> np.uint64(64 - BITS) for x in (whole, *parts)], 1).astype(np.int32)
    for (raw, source, lang, n_chars), a, b in zip(rows, bounds[:-1].tolist(), bounds[1:].tolist()):
        lines = [x for x in map(bytes.strip, raw.split(b"\n")) if x]
        words, own = b - a, np.sort(whole[a:b])
        n, size = max(1, words), max(1, len(raw))
        distinct = 1 + int((own[1:] != own[:-1]).sum()) if words else 0
        count = lambda of: len(raw) - len(raw.translate(None, of))  # noqa: B023, E731
        letters = len(raw) - count(SPACE)
        wording = {
            "words": words,
            "word_length": letters / n,
            "distinct_words": distinct / n,
            "symbols": count(_SYMBOLS) / n,
            "marks": count(_MARKS) / n,
            "upper": count(_UPPER) / size,
            "digits": count(_DIGITS) / size,
        }
        layout = {
            "n_chars": -1 if n_chars is None else n_chars,
            "lines": len(lines),
            "line_chars": sum(map(len, lines)) / max(1, len(lines)),
            "distinct_lines": len(set(lines)) / max(1, len(lines)),
            "ends": sum(x.endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)),
            "blank_lines": (raw.count(b"\n") + 1 - len(lines)) / (raw.count(b"\n") + 1),
        }
        page = [f"source={source}" if source is not None else "source", f"lang={lang}" if lang is not None else "lang", *(_bin(k, v) for k, v in layout.items())]
        pairs = [_named("meta", a, b) for k, a in enumerate(page) for b in page[k + 1 :]]
        yield _view(numbers[a:b].reshape(-1), [_named("text", _bin(k, v)) for k, v in wording.items()]), _view(np.empty(0, np.int32), [(1 << BITS) + x for x in (*(_named("meta", x) for x in page), *pairs)])


def features(text: str | None, source: str | None, lang: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    return next(features_of([(text, source, lang, n_chars)]))


class Linear:
    """Logistic regression over sets of numbered features."""

    def __init__(self, sets: list[np.ndarray], y: np.ndarray, weight: np.ndarray, min_docs: int, rounds: int = 150, l1: float = L1):
        cols = np.concatenate(sets) if sets else np.empty(0, np.int32)
        rows = np.repeat(np.arange(len(sets)), list(map(len, sets)))
        times = np.bincount(cols, minlength=NUMBERS)
        keep = times[cols] >= min_docs
        used, cols = np.unique(cols[keep], return_inverse=True)
        rows, n, k = rows[keep], len(sets), len(used)
        # both kinds weigh the same in all
        weight = weight * np.where(y > 0, 0.5 / max(1e-9, weight[y > 0].sum()), 0.5 / max(1e-9, weight[y <= 0].sum()))
        w, b, g2, gb2 = np.zeros(k), 0.0, np.full(k, 1e-8), 1e-8
        for _ in range(rounds):  # adaptive gradient descent
            z = np.bincount(rows, w[cols], n) + b
            slope = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
            grad = np.bincount(cols, slope[rows], k)
            g2 += grad * grad
            gb2 += slope.sum() ** 2
            w -= 0.3 * grad / np.sqrt(g2)
            w = np.sign(w) * np.maximum(0, np.abs(w) - 0.3 * l1 / np.sqrt(g2))  # words without a say get none
            b -= 0.3 * slope.sum() / math.sqrt(gb2)
        self.weights = np.zeros(NUMBERS, np.float32)
        self.weights[used] = w
        self.bias = float(b)

    def margin(self, numbers: np.ndarray) -> float:
        return self.bias + float(self.weights[numbers].sum(dtype=np.float64))


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray | float = 0.0, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (last: constant) of a small logistic regression by Newton's method; they are
    drawn to ``prior``."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z / len(z) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (p - y) / len(z) + ridge * (w - prior))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _combined(x: np.ndarray, y: np.ndarray, ridge: float | None = None) -> np.ndarray:
    """A logistic regression on the logits of the calibrated views, drawn to their plain sum,
    which is right for views that are independent given the label. No weight is negative: a view
    may be left out, but more confidence in it never counts against a document."""
    ridge = MIX_RIDGE if ridge is None else ridge
    use = [0, 1]
    while True:
        own = _logistic(x[:, use], y, np.array([1.0] * len(use) + [0.0]), ridge)
        if not use or (own[:-1] >= 0).all():
            break
        use.remove(use[int(own[:-1].argmin())])
    w = np.zeros(3)
    w[[*use, 2]] = own
    return w


def _p(m: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, m))))


def folds(y: np.ndarray) -> list[np.ndarray]:
    """Places of the labelled documents to fit on, to calibrate on and to combine on (six
    eighths, one, and one; in order of their hash). A part without both kinds is
    replaced by all."""
    at = np.arange(len(y))
    parts = [at[at % 8 < 6], at[at % 8 == 6], at[at % 8 == 7]]
    return [p if len(set(y[p])) > 1 else at for p in parts]


class CoTraining:
    """The state of co-training: both views, their training sets and calibrations."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray):
        self.labelled, self.y = sets, y
        self.fit_on, self.calibrate_on, self.combine_on = folds(y)
        self.sets = [[sets[i][k] for i in self.fit_on] for k in (0, 1)]
        self.ys = [list(y[self.fit_on]), list(y[self.fit_on])]
        self.pseudo = [0, 0]  # labels that each view was given by the other
        self.views: list[Linear | None] = [None, None]
        self.mix = np.zeros(3)

    def fit(self) -> None:
        for k, min_docs in ((0, MIN_DOCS), (1, 1)):
            weight = np.where(np.arange(len(self.sets[k])) < len(self.fit_on), 1.0, PSEUDO_WEIGHT)
            self.views[k] = Linear(self.sets[k], np.array(self.ys[k]), weight, min_docs)
        y = self.y[self.calibrate_on]
        self.scales = [_logistic(np.array([[self.views[k].margin(self.labelled[i][k])] for i in self.calibrate_on]), y) for k in (0, 1)]

    def learn(self, named: list[tuple[tuple[np.ndarray, np.ndarray], dict[int, float]]]) -> None:
        """Add pseudo-labels: (features of both views, {view: its label}) for each document.
        Where the views disagree none is added."""
        for sets, votes in named:
            if len(set(votes.values())) == 1:
                for k, v in votes.items():
                    self.sets[1 - k].append(sets[1 - k])
                    self.ys[1 - k].append(v)
                    self.pseudo[1 - k] += 1

    def combine(self) -> "CoTraining":
        both = np.array([[self.logit(k, self.labelled[i][k]) for k in (0, 1)] for i in self.combine_on])
        self.mix = _combined(both, self.y[self.combine_on])
        return self

    def logit(self, k: int, numbers: np.ndarray) -> float:
        a, b = self.scales[k]
        return max(-12.0, min(12.0, a * self.views[k].margin(numbers) + b))

    def model(self) -> "Model":
        return Model([(v.weights, v.bias) for v in self.views], [tuple(map(float, s)) for s in self.scales], tuple(map(float, self.mix)))


class Model:
    """What scoring needs: weights, calibrations and how the views combine."""

    def __init__(self, views: list, scales: list, mix: tuple):
        # few weights are not 0: only those travel
        self.views = [(np.flatnonzero(w).astype(np.int32), w[np.flatnonzero(w)], b) for w, b in views]
        self.scales, self.mix = scales, mix
        self._dense: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"_dense": None}

    def logits(self, sets: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
        if self._dense is None:
            self._dense = []
            for at, w, b in self.views:
                dense = np.zeros(NUMBERS, np.float32)
                dense[at] = w
                self._dense.append((dense, b))
        out = []
        for (dense, b), (a, c), numbers in zip(self._dense, self.scales, sets):
            m = b + float(dense[numbers].sum(dtype=np.float64))
            out.append(max(-12.0, min(12.0, a * m + c)))
        return out[0], out[1]

    def score(self, sets: tuple[np.ndarray, np.ndarray]) -> tuple[float, float, float]:
        """(combined, text view, metadata view), each a probability."""
        a, b = self.logits(sets)
        return _p(self.mix[0] * a + self.mix[1] * b + self.mix[2]), _p(a), _p(b)


_COLUMNS = ("text", "source", "lang", "n_chars")


def _features_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return features_of(zip(*(batch.column(c).to_pylist() for c in _COLUMNS)))


def _table(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the features), text_view and meta_view for every row, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [(a.tobytes(), b.tobytes()) for a, b in _features_of(batch)]
            ties = np.array([xxhash.xxh3_64_intdigest(a + b"|" + b) for a, b in sets], np.uint64).view(np.int64)
            cols = [batch.column("doc_id"), pa.array(ties), *(pa.array([s[k] for s in sets], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tie", "text_view", "meta_view"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))
    return materialize(own.mapInArrow(run, "doc_id long, tie long, text_view binary, meta_view binary"), "quality-features")


def _read(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.text_view, np.int32), np.frombuffer(row.meta_view, np.int32)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in zip(batch.column("text_view"), batch.column("meta_view")):
        yield np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(b.as_buffer(), np.int32)


def _surest(table: DataFrame, told: DataFrame, model: Model, known: set[int], per_round: int, sure: float) -> dict[int, dict[int, float]]:
    """tie -> {view: label} of the unlabelled contents that each view is most sure of, at
    most ``per_round`` of each kind and view, out of all that are sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(_p(a), _p(b)) for a, b in map(model.logits, _sets(batch))]
            p = np.array(found, float).reshape(-1, 2)
            far = np.maximum(p, 1 - p).max(1) >= sure if len(p) else np.zeros(0, bool)
            keep = pa.array(far & np.array([t not in known for t in batch.column("tie").to_pylist()], bool))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(p[:, 0]), pa.array(p[:, 1])], names=["doc_id", "tie", "p0", "p1"]).filter(keep)

    scored = table.mapInArrow(run, "doc_id long, tie long, p0 double, p1 double")
    free = scored.join(told.select("doc_id"), "doc_id", "left_anti")
    # the rows of one content are equal but for their id
    free = materialize(free.groupBy("tie").agg(F.max("p0").alias("p0"), F.max("p1").alias("p1")), "quality-sure")
    out: dict[int, dict[int, float]] = {}
    for k in (0, 1):
        p = F.col(f"p{k}")
        for label, some, order in ((1.0, p >= sure, p.desc()), (0.0, p <= 1 - sure, p.asc())):
            for r in free.where(some).orderBy(order, "tie").limit(per_round).collect():
                out.setdefault(r.tie, {})[k] = label
    return out


def _told(labels: DataFrame) -> DataFrame:
    """doc_id, y: one row for each labelled document."""
    told = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    good = F.when((F.col("quality") > 0) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1.0).otherwise(0.0)
    return told.agg(F.min(good).alias("y"))


def _fit(table: DataFrame, labels: DataFrame, labelled: int, rounds: int, per_round: int, sure: float) -> CoTraining | None:
    told = _told(labels)
    spark = table.sparkSession
    ids = table.select("doc_id").where("doc_id is not null").distinct()
    known = {r.doc_id: r.y for r in hash_sample(told.join(ids, "doc_id", "left_semi"), labelled).collect()}
    if len(set(known.values())) < 2:
        return None
    rank = {d: k for k, d in enumerate(known)}
    some = F.broadcast(spark.createDataFrame([(i,) for i in known], "doc_id long"))  # at most ``labelled`` ids
    one = table.join(some, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("text_view", "meta_view"), F.struct("tie", "text_view")).alias("own"))
    rows = sorted(one.collect(), key=lambda r: rank[r.doc_id])
    state = CoTraining([_read(r.own) for r in rows], np.array([known[r.doc_id] for r in rows]))
    seen: set[int] = set()
    for _ in range(rounds):
        state.fit()
        named = _surest(table, told, state.model(), seen, per_round, sure)
        if not named:
            return state.combine()
        seen |= named.keys()
        some = F.broadcast(spark.createDataFrame([(i,) for i in named], "tie long"))  # at most 4 * per_round
        rows = table.join(some, "tie", "left_semi").groupBy("tie").agg(F.min(F.struct("text_view", "meta_view")).alias("own")).collect()
        state.learn([(_read(r.own), named[r.tie]) for r in sorted(rows, key=lambda r: r.tie)])
    state.fit()
    return state.combine()


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND, sure: float = SURE) -> CoTraining | None:
    """The trained views, or None where the labels do not have both kinds."""
    ship(docs.sparkSession)
    return _fit(_table(docs), labels, labelled, rounds, per_round, sure)


def score(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND, sure: float = SURE) -> DataFrame:
    """doc_id, score, text_score, meta_score, kept for every row of ``docs``."""
    ship(docs.sparkSession)
    table = _table(docs)
    state = _fit(table, labels, labelled, rounds, per_round, sure)
    model = state.model() if state else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(None, None, None) if model is None else model.score(s) for s in _sets(batch)]
            cols = list(zip(*found)) or [(), (), ()]
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.float64()) for c in cols)]
            arrays.append(pa.array([p is None or p >= THRESHOLD for p in cols[0]], pa.bool_()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "text_score", "meta_score", "kept"])

    return table.mapInArrow(run, "doc_id long, score double, text_score double, meta_score double, kept boolean")


def keep(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND, sure: float = SURE) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps. (Their features are
    computed again: carrying whole rows through the written features would write every text.)"""
    state = fit(docs, labels, labelled, rounds, per_round, sure)
    if state is None:
        return docs
    model = state.model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(s)[0] >= THRESHOLD for s in _features_of(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
