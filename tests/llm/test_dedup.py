import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, near_dedup
from tessera.llm.components import connected_components


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = sorted((self.find(x), self.find(y)))
        self.up[y] = x


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(docs):
    """doc_id -> (set size, component) by comparing all rows that share a shingle."""
    sets, by, comp = [shingles(t) for _, t in docs], defaultdict(list), Sets()
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in by[x]:
                shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                comp.join(i, j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[comp.find(i)] = min(d, least.get(comp.find(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(comp.find(i), d) if sets[i] else d)) for i, (d, _) in enumerate(docs))


def got(rows):
    for r in rows:
        assert r.kept == (r.component_id == r.doc_id)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows)


def test_documents_equal_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(near_dedup.op3_minhash_near_dedup(spark, sf).collect()) == brute(docs)


def brute_kept(rows):
    """Rows (doc_id, text) that deduplicate leaves: as (doc_id, text), sorted. Of a group the
    smallest id stays; which of its texts is left open, so texts of one id count as one."""
    sets, comp = [shingles(t) for _, t in rows], Sets()
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                comp.join(i, j)
    out, groups = [], defaultdict(list)
    for i, (d, t) in enumerate(rows):
        if sets[i]:
            groups[comp.find(i)].append((d is None, d or 0, t))
        else:
            out.append(str(d))
    return sorted(out + [str(None if min(g)[0] else min(g)[1]) for g in groups.values()])


def test_odd_documents(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(near_dedup.near_duplicates(odd_docs).collect()) == brute(docs)
    assert near_dedup.near_duplicates(no_docs).collect() == []
    out = near_dedup.deduplicate(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == brute_kept(docs)
    assert near_dedup.deduplicate(no_docs).collect() == []


def test_deduplicate_removes_rows_not_ids(spark):
    words = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    a, b, c, d = (words(k) for k in "abcd")
    near = c + " more"
    rows = [(3, a), (5, a), (5, b), (5, b), (None, a), (None, d), (None, d), (7, near), (7, c), (8, c), (9, None), (9, None), (10, " "), (None, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, `a.b` long").withColumn("__h0", F.lit(1))
    out = near_dedup.deduplicate(df)
    assert out.columns == df.columns
    left = out.collect()
    assert sorted(str(r.doc_id) for r in left) == brute_kept(rows)
    texts = [(r.doc_id, r.text) for r in left]
    assert texts.count((5, b)) == 1 and (5, a) not in texts and (3, a) in texts and texts.count((None, d)) == 1 and (None, a) not in texts
    assert sum(d == 7 for d, _ in texts) == 1 and sum(d == 9 for d, _ in texts) == 2
    assert all(next(x for x in rows if x == (r.doc_id, r.text)) for r in left)


def test_signatures_of_long_unrelated_texts_differ():
    """The circle has room: sets of a million shingles agree nowhere near a whole band."""
    rng = np.random.default_rng(0)
    one, two = (np.unique(rng.integers(0, 1 << 63, 1_000_000).astype(np.uint64) * np.uint64(2)) for _ in range(2))
    assert (near_dedup.signature(one) == near_dedup.signature(two)).sum() <= 2
    both = np.unique(np.concatenate([one, two[:250_000]]))
    share = (near_dedup.signature(one) == near_dedup.signature(both)).mean()
    assert abs(share - 0.8) < 0.15


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    got = []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
        got.append((near_dedup.signature(x[:350]) == near_dedup.signature(x[50:])).mean())
    assert abs(np.mean(got) - 0.75) < 0.03


def test_chain_and_template_groups(spark):
    """A chain whose ends are not similar, many near copies, and a shared passage below the limit."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"t{x}" for x in rng.integers(0, 10**6, n)]
    docs, base = [], word(200)
    chain = list(base)
    for i in range(12):
        docs.append((100 + i, " ".join(chain)))
        chain[i * 12 : i * 12 + 12] = word(12)
    body = word(300)
    for i in range(150):
        own = list(body)
        own[int(rng.integers(0, 300))] = f"x{i}"
        docs.append((1000 + i, " ".join(own)))
    shared = word(60)
    for i in range(150):
        docs.append((5000 + i, " ".join(word(40) + shared + word(50))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(near_dedup.near_duplicates(df).collect()) == brute(docs)


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    comp = Sets()
    for a, b in links:
        if a != b:
            comp.join(a, b)
    rows = connected_components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.node: r.component for r in rows} == {x: comp.find(x) for a, b in links if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_vectors(rows, cosine=0.98):
    ok = [v is not None and label is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v) for _, v, label in rows]
    comp, links = Sets(), [0] * len(rows)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for (_, v, _), k in zip(rows, ok)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                comp.join(i, j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (v, *_) in enumerate(rows):
        if v is not None:
            least[comp.find(i)] = min(v, least.get(comp.find(i), v))
    return sorted((str(r[0]), links[i], str(least.get(comp.find(i)))) for i, r in enumerate(rows))


def got_vectors(rows):
    for r in rows:
        assert r.kept == (r.component_id == r.vec_id)
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in rows)


def test_vectors_equal_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert got_vectors(embedding_dedup.op10_embedding_dedup(spark, sf).collect()) == brute_vectors(rows)


def test_planted_vectors(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for k in range(150):  # near pairs at about the limit
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        noise = rng.normal(size=64) / 8
        for s in (0, 0.12, 0.19, 0.21):
            rows.append((n, [float(x) for x in np.float32(a + s * noise)], k % 2))
            n += 1
    base = rng.normal(size=64)
    for _ in range(600):  # one large group of near copies, over several sub-blocks
        rows.append((n, [float(x) for x in np.float32(base + 0.03 * rng.normal(size=64))], 7))
        n += 1
    rows += [(n + i, [float(x) for x in base], 7) for i in range(5)]  # exact copies
    rows += [(n + 10, None, 7), (n + 11, [0.0] * 64, 7), (n + 12, [float("nan")] * 64, 7), (n + 13, [None] * 64, 7), (n + 14, [float(x) for x in base], None)]
    rows += [(n + 15, [1.0, 0.0], 7), (n + 16, [2.0, 0.01], 7), (n + 17, [], 7), (n + 16, [2.0, 0.01], 7), (None, [1.0, 0.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("x"))
    want, have = brute_vectors(rows), got_vectors(embedding_dedup.link(df).collect())
    missed = [w for w, h in zip(want, have) if w != h]
    assert not missed, (len(missed), missed[:5])
    assert embedding_dedup.link(df.limit(0)).collect() == []


def test_extreme_norms(spark):
    rows = [(i, [x * s, x * s * t], 1) for i, (x, s, t) in enumerate([(1.0, 1e200, 1.0), (1.0, 1e200, 1.0001), (1.0, 1e-200, 1.0), (1.0, 1.0, 1.0), (1.0, 1e200, -1.0), (1.0, 5e-324, 1.0)])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 4: (0, 4), 5: (4, 0)}


def test_recall_on_a_larger_table(spark):
    """All of 10,000 vectors against all, with groups near the limit and one large group."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(9000, 64))
    near = base[:600] + rng.normal(size=(600, 64)) * rng.uniform(0.1, 0.25, (600, 1))
    group = base[700] + 0.1 * rng.normal(size=(400, 64))
    x = np.concatenate([base, near, group]).astype(np.float32)
    label = np.concatenate([np.arange(9000) % 3, np.arange(600) % 3, np.full(400, 700 % 3)])
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    same = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(same, False)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")
    got = np.array([r.n_links for r in sorted(embedding_dedup.link(df).collect(), key=lambda r: r.vec_id)])
    assert (got <= same.sum(1)).all() and got.sum() >= 0.999 * same.sum() > 100_000


def test_a_longer_code_for_larger_tables(monkeypatch):
    """With three blocks, too, a vector passes about as many filters, and near pairs share one."""
    rng = np.random.default_rng(9)
    for largest in (0, 400_000, 10**8):
        alpha, parts, words = embedding_dedup._threshold(64, largest)
        assert (parts == 3) == (largest > 0) and words <= embedding_dedup.MAX_WORDS
        assert words == embedding_dedup.MAX_WORDS or float(words) ** parts >= embedding_dedup.FILTERS * largest  # unlike vectors share no more of them
    a = rng.normal(size=(150, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.normal(size=(150, 64))
    noise -= (noise * a).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    left, right = embedding_dedup.list_decode(a, 400_000), embedding_dedup.list_decode(b, 400_000)
    assert 800 < np.mean(list(map(len, left))) < 3200
    assert sum(bool(np.intersect1d(x, y).size) for x, y in zip(left, right)) >= 149
    # all filters beyond the threshold are found, and no others
    monkeypatch.setattr(embedding_dedup, "MAX_WORDS", 12)
    monkeypatch.setattr(embedding_dedup, "_threshold", lambda dim, largest=0: (0.45, 3, 12))
    embedding_dedup.code.cache_clear()
    alpha, rotation, words, cols, _ = embedding_dedup.code(9, 5)
    for unit, got in zip(a[:20, :9] / np.linalg.norm(a[:20, :9], axis=1, keepdims=True), embedding_dedup.list_decode(a[:20, :9] / np.linalg.norm(a[:20, :9], axis=1, keepdims=True), 5)):
        s = [(unit @ rotation)[c] @ w.T for w, c in zip(words, cols)]
        whole = (s[0][:, None, None] + s[1][None, :, None] + s[2][None, None, :]).ravel()
        assert set(got.tolist()) == set(np.flatnonzero(whole >= alpha).tolist())
    embedding_dedup.code.cache_clear()
