"""Every stage of the pipeline on its predecessor's rows, and the whole run, against plain versions."""

import math
from collections import Counter

import numpy as np
from test_dedup import Sets, shingles
from test_models import plain_cotraining, plain_features
from test_packing import check_pack
from test_rules_mixing import WORD, plain_facts

from tessera.llm import mixing, quality_classifier
from tessera.llm.sampling import hash_sample


def plain_rules(rows):
    def kept(text):
        n, chars, symbols, dup, _, failed = plain_facts(text)
        text = text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        upper, lower = (sum(a <= c <= z for c in text) for a, z in ("AZ", "az"))
        bare = sum(all(not c.isalnum() and c.isascii() for c in w) for w in words)
        return not (failed or 10 * symbols > 2 * n or not 2 * n <= chars <= 14 * n or 10 * dup > 3 * len(lines) or upper > lower or 10 * bare > 3 * n)

    return [r for r in rows if kept(r.text)]


def plain_verdicts(rows, frame, labels):
    """The classifier's rounds over lists."""
    import xxhash

    q = quality_classifier
    sets = [plain_features(r.text, r.source, r.lang, r.n_chars) for r in rows]
    ties = [int(np.uint64(xxhash.xxh3_64_intdigest(a.tobytes() + b"|" + b.tobytes())).astype(np.int64)) for a, b in sets]
    told = {r.doc_id: r.y for r in q._told(labels).collect()}
    known = {r.doc_id: r.y for r in hash_sample(q._told(labels).join(frame.select("doc_id"), "doc_id", "left_semi"), q.LABELLED).collect()}
    if len(set(known.values())) < 2:
        return rows
    at = {r.doc_id: i for i, r in enumerate(rows)}
    free = {t: i for t, (i, r) in zip(ties, enumerate(rows)) if r.doc_id not in told}
    scores, _ = plain_cotraining(sets, {at[d]: y for d, y in known.items()}, free, q.ROUNDS, q.PER_ROUND, q.SURE)
    return [r for r, s in zip(rows, scores) if s >= q.THRESHOLD]


def plain_groups(rows):
    sets, comp = [shingles(r.text) for r in rows], Sets()
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                comp.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        least[comp.find(i)] = min(r.doc_id, least.get(comp.find(i), r.doc_id))
    return [r for i, r in enumerate(rows) if not sets[i] or least[comp.find(i)] == r.doc_id]


def check_mixed(before, after, frame):
    """Copies of whole documents, as many as the words that the mix takes of each make."""
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.Mixture(frame).taken().collect()}
    copies = Counter(r.doc_id for r in after)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    for r in before:
        words, size = taken[r.doc_id]
        assert (copies[r.doc_id] == 0) if not words else math.floor(words / size) <= copies[r.doc_id] <= math.floor(words / size) + 1


def test_whole_pipeline(spark, sf):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    for name, plain in (("quality_rules", lambda x: plain_rules(x)), ("quality_classifier", lambda x: plain_verdicts(x, frame, labels)), ("minhash_near_dedup", plain_groups)):
        rows = frame.collect()
        after = stages[name](spark, frame, sf)
        assert after.columns == frame.columns
        got = after.collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, plain(rows))), name
        frame = spark.createDataFrame(got, frame.schema)
    rows = frame.collect()
    mixed = stages["source_mixing"](spark, frame, sf).collect()
    check_mixed(rows, mixed, frame)
    packed = stages["best_fit_packing"](spark, spark.createDataFrame(mixed, frame.schema), sf).collect()
    check_pack(packed, [(r.doc_id, r.text) for r in mixed])
    whole = corpus_pipeline.run(spark, sf).collect()
    pieces = lambda x: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in x)
    assert pieces(whole) == pieces(packed)
