import re
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_facts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def facts_of(rows):
    return sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)


def test_rules_equal_the_plain_version(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality_rules.op7_quality_rules(spark, sf).collect()
    assert facts_of(rows) == sorted((str(r.doc_id), *plain_facts(r.text)) for r in docs.collect())
    assert not any(r.kept and r.base_failed for r in rows)
    odd = quality_rules.judge(odd_docs, stats=True).collect()
    assert facts_of(odd) == sorted((str(r.doc_id), *plain_facts(r.text)) for r in odd_docs.collect())
    assert quality_rules.judge(no_docs).collect() == []
    kept = quality_rules.keep(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in odd if r.kept}


def test_long_texts_and_full_verdicts(spark, sf):
    rng = np.random.default_rng(0)
    for n, v in ((5, 3), (50, 5), (3000, 12), (3000, 5000)):
        text = " ".join(f"w{x}" for x in rng.integers(0, v, n))
        assert quality_rules._repeat_words(text.encode().split()) == plain_facts(text)[4]

    def plain_kept(text):
        n, chars, symbols, dup, _, failed = plain_facts(text)
        text = text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        upper, lower = (len(re.findall(x, text)) for x in ("[A-Z]", "[a-z]"))
        bare = sum(all(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in w) for w in words)
        return not (failed or 10 * symbols > 2 * n or not 2 * n <= chars <= 14 * n or 10 * dup > 3 * len(lines) or upper > lower or 10 * bare > 3 * n)

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = quality_rules.op7_quality_rules(spark, sf).collect()
    assert {r.doc_id: r.kept for r in rows} == {d: plain_kept(t) for d, t in docs.items()}
    assert rows == quality_rules.op7_quality_rules(spark, sf).collect()


def test_mix_of_rows_without_ids_and_odd_columns(spark):
    rows = [(None, f"a b c {i}", "s") for i in range(40)] + [(1, "x y", "t")] * 3 + [(2, None, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, `a.b` int")
    check_mix(mixing.Mixture(docs, block_words=2).taken().collect(), docs.collect())
    assert mixing.resample(docs, block_words=2).columns == docs.columns


def test_order_does_not_change_the_verdict():
    rules = quality_rules.DEFAULT_RULES
    texts = ["a b c " * 40, "word " * 3, " ".join(f"w{i}" for i in range(80)), "X%%% " * 90, None]
    for order in (rules, rules[::-1]):
        got = [quality_rules.first_rejection(quality_rules.TextFacts(t), order) is None for t in texts]
        assert got == [False, False, True, False, False]
    ordered, estimates = quality_rules.order_rules(texts, rules)
    gains = [e.rejected / e.cost for e in estimates]
    assert gains == sorted(gains, reverse=True) and set(ordered) == set(rules)


def check_mix(rows, docs):
    sizes, order = defaultdict(int), set()
    for r in docs:
        sizes[r.source] += len(WORD.findall(r.text or ""))
        order.add(r.source)
    order = sorted(order, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))])))
    assert sorted((str(r.doc_id), len(WORD.findall(r.text or ""))) for r in docs) == sorted((str(r.doc_id), r.size) for r in rows)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    return {s: (taken[s], want[s]) for s in order}


def test_mix(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.op2_mixing(spark, sf).collect()
    for got, want in check_mix(rows, docs.collect()).values():
        assert abs(got - want) <= 2 * mixing.BLOCK_WORDS + 0.02 * want
    again = mixing.op2_mixing(spark, sf).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    odd = mixing.Mixture(odd_docs).taken()
    check_mix(odd.collect(), odd_docs.collect())
    assert mixing.Mixture(no_docs).taken().collect() == []


def test_mixed_texts_are_what_is_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = mixing.Mixture(docs)
    words = Counter()
    for r in plan.texts(docs).collect():
        words[r.source] += len(r.text.split(" "))
    assert words == Counter({r.source: r.n for r in plan.taken().groupBy("source").agg({"taken": "sum"}).toDF("source", "n").collect() if r.n})


def test_resample(spark, sf, odd_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.resample(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(r.text.split())
    plan = mixing.Mixture(docs)
    for s, t, n in zip(plan.sources, plan.targets, plan.sizes):
        assert words[s] <= 3 * n and abs(words[s] - t) < 0.6 * t
    assert mixing.resample(odd_docs).columns == odd_docs.columns


def test_targets_and_permutation():
    assert mixing.targets([10, 10, 0], [5, 2, 1]) == [20 * 5 / 7, 20 * 2 / 7, 0.0]
    assert mixing.targets([1, 99], [5, 2]) == [3.0, 97.0]
    for n in (1, 2, 3, 64, 65, 1000):
        at = np.arange(n)
        assert sorted(mixing.permute(at, np.full(n, n), np.full(n, 12345)).tolist()) == list(range(n))
    counts = mixing.shard_counts([1000, 10, 0, 333], shards=7)
    assert counts.sum(0).tolist() == [1000, 10, 0, 333]
