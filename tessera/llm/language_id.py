"""Language identification by hierarchical discrimination.

Linear support vector machines over hashed letter pairs and triples of a text. The first
level separates language families (one machine for each family against the rest); inside
the predicted family, machines for every pair of its languages vote, and the margins break
ties. A family with one language needs no second level.

The machines are fitted on a bounded sample: at most ``PER_LANGUAGE`` whole labelled texts
of each language (smallest hash of doc_id), from documents outside the held-out third.
Every document is then predicted from its whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every
text if nothing can be learned; a language code of no known family is a family of its own;
repeated rows are predicted once each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import MARGIN, place
from tessera.session import ship

PER_LANGUAGE = 500
SAMPLED, LEAST = 8000, 20  # texts of all languages together, at most; of one, where there are many
FOLDS, HELD_OUT = 3, 1
PAIR_BITS, TRIPLE_BITS = 11, 12
SLICE = 1 << 15  # letters whose features are looked up at once
ROUNDS, L2 = 80, 1e-3
UNKNOWN = "und"

#: ISO 639-1 codes by family
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indo-aryan": "hi ur bn pa mr gu ne si".split(),
    "semitic": "ar he mt am".split(),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

# letters stay (those of UTF-8's other bytes too), all else is a space
_LETTERS = bytes(c if chr(c).isalpha() and c < 128 or c > 127 else 32 for c in range(256)).lower()
SIZE = (1 << PAIR_BITS) + (1 << TRIPLE_BITS)


def family(code: str) -> str:
    return _FAMILY.get(code.lower().split("-")[0], code)


def slices(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of all letter pairs and triples (of UTF-8 bytes) of a text, in slices
    of bounded memory."""
    raw = f" {text.lower()} ".encode("utf-8", "surrogatepass").translate(_LETTERS)
    letters = np.frombuffer(b" ".join(raw.split()).join([b" ", b" "]), np.uint8)
    for at in range(0, len(letters) - 1, SLICE):
        b = letters[at : at + SLICE + 2].astype(np.uint32)
        pairs = (b[:-1] << 8) | b[1:]
        triples = (pairs[:-1] << 8) | b[2:]
        x = (pairs[:SLICE] * np.uint32(2654435761)) >> np.uint32(32 - PAIR_BITS)
        y = (triples * np.uint32(2246822519)) >> np.uint32(32 - TRIPLE_BITS)
        if len(letters) >= 3:
            yield np.concatenate([x, y + np.uint32(1 << PAIR_BITS)]).astype(np.int64)


def features(text: str) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *slices(text)])


def shares(text: str) -> np.ndarray:
    total, n = np.zeros(SIZE), 0
    for found in slices(text):
        total += np.bincount(found, minlength=SIZE)
        n += len(found)
    return (total / max(1, n)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, l2: float = L2) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge loss, classes weighted evenly) by
    accelerated gradient descent; y is +1 or -1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    ahead, before = w.copy(), w.copy()
    z = np.hstack([x, np.ones((len(x), 1), np.float32)])
    v = np.ones(z.shape[1], np.float32)
    for _ in range(10):  # the largest curvature sets the step
        v = z.T @ (weight * (z @ v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (2 * float(v @ (z.T @ (weight * (z @ v)))) + l2)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ ahead))
        grad = -2 * (z.T @ (weight * y * slack)) + l2 * ahead
        w = ahead - step * grad
        ahead = w + k / (k + 3) * (w - before)
        before = w
    return w[:-1], float(w[-1])


class Model:
    """Columns of ``weights``: a machine for each family, then one for each pair."""

    def __init__(self, languages: list[str], x: np.ndarray, labels: list[str]):
        self.languages = languages
        self.families = sorted({family(c) for c in languages})
        self.members = {f: [c for c in languages if family(c) == f] for f in self.families}
        self.pairs = [(f, a, b) for f in self.families for a, b in combinations(self.members[f], 2)]
        self.mean = x.mean(0) if len(x) else np.zeros(SIZE, np.float32)
        self.spread = x.std(0) + 1e-4 if len(x) else np.ones(SIZE, np.float32)
        z = (x - self.mean) / self.spread / np.sqrt(SIZE)
        of, own = np.array([family(c) for c in labels]), np.array(labels)
        machines = []
        if len(self.families) > 1:
            machines += [fit_svm(z, np.where(of == f, 1, -1).astype(np.float32)) for f in self.families]
        for _, a, b in self.pairs:
            some = (own == a) | (own == b)
            machines.append(fit_svm(z[some], np.where(own[some] == a, 1, -1).astype(np.float32)))
        scale = self.spread * np.sqrt(SIZE)
        self.weights = np.stack([w / scale for w, _ in machines], 1).astype(np.float32) if machines else np.zeros((SIZE, 0), np.float32)
        self.bias = np.array([b - float((w / scale) @ self.mean) for w, b in machines])

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for found in slices(text):
            total += self.weights[found].sum(0, dtype=np.float64)
            n += len(found)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        m = self.margins(text)
        squash = lambda x: 1 / (1 + np.exp(-np.clip(2 * x, -50, 50)))
        k = len(self.families) if len(self.families) > 1 else 0
        best = int(np.argmax(m[:k])) if k else 0
        sure = squash(m[best] - max((m[i] for i in range(k) if i != best), default=0)) if k else 1.0
        members = self.members[self.families[best]]
        votes = {c: [0, 0.0, np.inf] for c in members}
        for (f, a, b), margin in zip(self.pairs, m[k:]):
            if f == self.families[best]:
                votes[a if margin >= 0 else b][0] += 1
                votes[a][1] += margin
                votes[b][1] -= margin
                votes[a][2] = min(votes[a][2], margin)
                votes[b][2] = min(votes[b][2], -margin)
        lang = max(members, key=lambda c: (votes[c][0], votes[c][1]))
        if len(members) > 1:
            sure *= squash(votes[lang][2])
        return lang, float(sure)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list:
    """(lang, shares) of whole labelled texts outside the held-out fold, at most so many of
    each language and ``SAMPLED`` of all (``LEAST`` of each where there are more languages than that
    allows). The features are counted by the tasks, so the texts stay where they are: a
    sampled text is ``SIZE`` numbers to the driver, all of them at most some 200 MB."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != HELD_OUT))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    per_language = min(per_language, max(LEAST, SAMPLED // max(1, len(counts))))
    # they have been on the driver already; the documents are not dealt out by language
    sizes = docs.sparkSession.createDataFrame([(r.lang, r.n) for r in counts], "lang string, n long")
    ids = (
        usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
        .join(F.broadcast(sizes), "lang")
        # so what is ordered stays near MARGIN * per_language rows of a language
        .where(place("doc_id") * F.col("n") < MARGIN * per_language)
        .withColumn("at", place("doc_id"))
        .selectExpr("doc_id", "lang", "row_number() over (partition by lang order by at, h, doc_id) as nth")
        .where(F.col("nth") <= per_language)
        .select("doc_id", "lang")
        .distinct()
    )
    # at most per_language ids a language
    some = usable.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shares(v.as_py()).tobytes() for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(found, pa.binary())], names=["doc_id", "lang", "shares"])

    rows = some.mapInArrow(counted, "doc_id long, lang string, shares binary")
    rows = rows.groupBy("doc_id", "lang").agg(F.min("shares").alias("shares")).collect()  # of repeated ids one
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.shares))
    return rows


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    rows = sample(docs, per_language)
    x = np.stack([np.frombuffer(r.shares, np.float32) for r in rows]) if rows else np.zeros((0, SIZE), np.float32)
    return Model(sorted({r.lang for r in rows}), x, [r.lang for r in rows])


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of (doc_id, text, lang)."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = model or fit(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(v.as_py()) for v in batch.column("text")]
            langs, scores = zip(*found) if found else ((), ())
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return predict(spark.read.parquet(f"{sf_dir}/documents.parquet"))
