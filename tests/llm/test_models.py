import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from tessera.llm import language_id, lm_score, quality_classifier
from tessera.llm.sampling import hash_sample
from tessera.llm.words import letters, mix64

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_scores(docs, m=lm_score.M):
    """Trigram scores by dictionaries, for rows (doc_id, text)."""
    toks = lambda t: [*WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")), None]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs]
    one, seen = Counter(), Counter()
    for (_, t), h in zip(docs, held):
        if not h:
            w = ["<s>", *toks(t)]
            one.update(w[1:])
            for k in (2, 3):
                seen.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            seen["<s>",] += 1
            seen.update((x,) for x in w[1:])
    n, v = sum(one.values()), len(one)
    times = Counter(one.values())
    d = min(0.9, max(0.1, times[1] / (times[1] + 2 * times[2]))) if times[1] else 0.5

    def p(w, *h):
        if not h:
            return 1.0 if not n else (one[w] - d) / n if one[w] else d * v / n
        weight = m[len(h) - 1]
        return (seen[*h, w] + weight * p(w, *h[1:])) / (seen[h] + weight) if seen[h] else p(w, *h[1:])

    out = []
    for (i, t), h in zip(docs, held):
        w = toks(t)
        base = sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        path = ["<s>", *w]
        score = sum(math.log10(p(path[k], *path[max(0, k - 2) : k])) for k in range(1, len(path)))
        out.append((str(i), h, len(w), sum(one[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    return sorted(out)


def got_scores(rows):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:5] == y[:5] and all(math.isclose(p, q, rel_tol=1e-9, abs_tol=2e-6) for p, q in zip(x[5:], y[5:])), (x, y)


def test_scores_equal_the_plain_version(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_scores([(r.doc_id, r.text) for r in docs.collect()])
    close(got_scores(lm_score.op5_lm_scoring(spark, sf).collect()), want)
    assert sum(x[6] - x[5] for x in want if x[1]) > 0  # texts that were held out are likelier than by the base
    # many small blocks and ranges, and documents in many pieces
    close(got_scores(lm_score.score(docs.repartition(3), block_chars=20_000, piece_chars=1_500, range_keys=1_000).collect()), want)
    odd = plain_scores([(r.doc_id, r.text) for r in odd_docs.collect()])
    close(got_scores(lm_score.score(odd_docs).collect()), odd)
    close(got_scores(lm_score.score(odd_docs, block_chars=300, piece_chars=7, range_keys=3).collect()), odd)
    assert lm_score.score(no_docs).collect() == []


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = lm_score.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0.0)


def test_pieces_and_packed_numbers():
    text = " one Two  three\nfour\u2003five six"
    for size in (1, 4, 9, 100):
        parts = list(lm_score.pieces(text, size))
        assert "".join(parts) == text and [w for x in parts for w in WORD.findall(x)] == WORD.findall(text)
    words, sizes = lm_score.words_of(["a B a", "", "  ", "b\tA"])
    assert len(set(words.tolist())) == 2 and words[0] == words[2] == words[4] and sizes.tolist() == [3, 0, 0, 2]
    many = [f"{'x' * (i % 3)}{i}é" for i in range(50_000)] + ["y" * n for n in range(1, 9000, 7)]
    words, sizes = lm_score.words_of([" ".join(many), ""])
    assert len(set(words.tolist())) == len(set(many)) and sizes.tolist() == [len(many), 0]
    for x in ([], [0], [5, 255, 256, 0], [2**40, 1]):
        assert lm_score.unpack_counts(lm_score.pack_counts(np.array(x, np.int64))).tolist() == x
    keys = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
    assert lm_score.unpack_keys(lm_score.pack_keys(keys)).tolist() == keys.tolist()


def toy():
    """Words 0..3 are known, 4 stands for any unknown one, 5 is the start. Bigrams: start 0,
    0 1, 1 0, 0 2, and 2 4, which was not seen; trigrams: start 0 1, 0 1 0."""
    root = lm_score.Root(tokens=10, distinct=4, once=2, twice=1)
    grams = {
        2: (np.array([5, 0, 1, 0, 2]), np.array([0, 1, 0, 2, 4]), np.array([2, 3, 2, 1, 0])),
        3: (np.array([0, 1]), np.array([1, 2]), np.array([2, 2])),
    }
    return lm_score.Automaton(root, np.array([5, 3, 1, 1, 0, 2]), grams, (5.0, 2.0))


def test_states_fail_to_shorter_histories_and_are_distributions():
    auto = toy()
    assert len(auto.fail) == 1 + 5 + 4 and (auto.orders[auto.fail[1:]] == auto.orders[1:] - 1).all()
    bigram = {(5, 0): 0, (0, 1): 1, (1, 0): 2, (0, 2): 3, (2, 4): 4}
    trigram = {(5, 0, 1): 0, (0, 1, 0): 1}
    words = np.arange(5)
    root_weight = auto.step(np.zeros(5, np.int64), [words, np.full(5, -1), np.full(5, -1)])[1]
    assert math.isclose((10**root_weight).sum(), 1)
    for h in [(0,), (1,), (5,), (5, 0), (0, 1)]:
        state = auto.target[1][h[0]] if len(h) == 1 else auto.target[2][bigram[h]]
        two = np.array([bigram.get((h[-1], w), -1) for w in words])
        three = np.array([trigram.get((*h, w), -1) if len(h) == 2 else -1 for w in words])
        target, weight = auto.step(np.full(5, state), [words, two, three])
        # texts end in these histories too: a history seen more often than its arcs leaves mass
        assert (10**weight).sum() <= 1 + 1e-9 and (auto.orders[target] <= auto.orders[state] + 1).all()
    full = 10 ** auto.step(np.full(5, auto.target[1][5]), [words, np.array([0, -1, -1, -1, -1]), np.full(5, -1)])[1]
    assert math.isclose(full.sum(), 1)


def test_traversal_carries_the_state():
    auto = toy()
    bigram = {(5, 0): 0, (0, 1): 1, (1, 0): 2, (0, 2): 3, (2, 4): 4}
    trigram = {(5, 0, 1): 0, (0, 1, 0): 1}
    texts = [[5, 0, 1, 0, 2, 4, 1], [5, 0], [5], [5, 4, 0, 1, 0]]
    tokens, sizes = np.concatenate(texts), np.array(list(map(len, texts)))
    two = np.concatenate([[bigram.get((t[i - 1], t[i]), -1) if i else -1 for i in range(len(t))] for t in texts])
    three = np.concatenate([[trigram.get((t[i - 2], t[i - 1], t[i]), -1) if i > 1 else -1 for i in range(len(t))] for t in texts])
    got = auto.traverse([tokens, two, three], np.cumsum(sizes) - sizes, sizes, 1)
    at = 0
    for text, total in zip(texts, got):
        state, want = np.zeros(1, np.int64), 0.0
        for i in range(len(text)):
            state, weight = auto.step(state, [x[at : at + 1] for x in (tokens, two, three)])
            want += weight[0] if i else 0.0
            at += 1
        assert math.isclose(total, want, abs_tol=1e-12)


def test_language_of_held_out_documents(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = language_id.op6_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in language_id.predict(odd_docs).collect()}
    assert len(odd) == len({r.doc_id for r in odd_docs.collect()})
    for d in (5, 6, 7, 14):
        assert (odd[d].lang_pred, odd[d].score) == (("und", 0.0) if d != 14 else (odd[14].lang_pred, odd[14].score))
    assert {r.lang_pred for r in odd.values()} <= {"und", "en", "de", "fr"}
    assert language_id.predict(no_docs).collect() == []


def test_language_hierarchy():
    texts = {"en": "the and with this", "de": "und der nicht schön", "fr": "le une être où", "xx": "zzz qqq"}
    rows = [(c, f"{t} {t}") for c, t in texts.items() for _ in range(5)]
    model = language_id.Model(sorted(texts), np.stack([language_id.shares(t) for _, t in rows]), [c for c, _ in rows])
    assert model.families == ["germanic", "romance", "xx"] and model.pairs == [("germanic", "de", "en")]
    assert [model.predict(t)[0] for t in texts.values()] == list(texts)
    assert model.predict("123 ...") == model.predict(None) == ("und", 0.0)


def plain_features(text, source, lang, n_chars):
    """Numbers of both views, by plain Python."""
    q = quality_classifier
    number = lambda x: xxhash.xxh3_64_intdigest(x) >> (64 - q.BITS)
    raw = (text or "").encode()
    clean = "".join(" " if c in ".,;:!?\"'()[]{}%&#$*|<>" else c.lower() if c.isascii() else c for c in text or "")
    words = [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", clean) if w]
    own = set(words)
    letter, powers = (x.tolist() for x in letters())

    def part(w, n, salt):  # the polynomial of a word's first n bytes, mixed
        x = (sum(letter[c] * powers[i] for i, c in enumerate(w[:n])) + salt) % 2**64
        return int(mix64(np.array([x], np.uint64))[0]) >> (64 - q.BITS)

    numbers = {part(w, len(w), len(w) * 0x9E3779B97F4A7C15) for w in own} | {part(w, k, k) for w in own for k in (4, 6) if len(w) > k}
    lines = [x.strip() for x in raw.split(b"\n") if x.strip()]
    n, size, rows, breaks = max(1, len(words)), max(1, len(raw)), max(1, len(lines)), raw.count(b"\n") + 1
    has = lambda of: sum(chr(b) in of for b in raw)
    wording = {
        "words": len(words), "word_length": sum(map(len, raw.split())) / n, "distinct_words": len(set(words)) / n, "symbols": has("#*$%&|<>") / n,
        "marks": has("!?") / n, "upper": sum(65 <= b <= 90 for b in raw) / size, "digits": sum(48 <= b <= 57 for b in raw) / size,
    }
    layout = {
        "n_chars": -1 if n_chars is None else n_chars, "lines": len(lines), "line_chars": sum(map(len, lines)) / rows, "distinct_lines": len(set(lines)) / rows,
        "ends": sum(x[-1:] in (b".", b"!", b"?") for x in lines) / rows, "blank_lines": (breaks - len(lines)) / breaks,
    }
    binned = lambda of, edges: [f"{k}:{sum(v >= e for e in edges[k])}" for k, v in of.items()]
    page = ["source" if source is None else f"source={source}", "lang" if lang is None else f"lang={lang}", *binned(layout, q.LAYOUT)]
    text = numbers | {number(f"text\t{x}".encode()) for x in binned(wording, q.WORDING)}
    meta = {number("\t".join(("meta", *x)).encode()) for k in (1, 2) for x in itertools.combinations(page, k)}
    return np.array(sorted(text), np.int32), np.array(sorted((1 << q.BITS) + x for x in meta), np.int32)


def plain_newton(x, y, prior, ridge):
    """Penalised logistic regression, a constant last, row by row."""
    w = [0.0] * (len(x[0]) + 1)
    for _ in range(50):
        grad = [ridge * (a - b) for a, b in zip(w, prior)]
        curve = [[ridge * (i == j) for j in range(len(w))] for i in range(len(w))]
        for row, target in zip(x, y):
            z = [*row, 1.0]
            p = 1 / (1 + math.exp(-min(30, max(-30, sum(a * b for a, b in zip(w, z))))))
            for i, a in enumerate(z):
                grad[i] += a * (p - target) / len(x)
                for j, b in enumerate(z):
                    curve[i][j] += a * b * (p * (1 - p) + 1e-9) / len(x)
        step = np.linalg.solve(np.array(curve), np.array(grad))
        w = [a - b for a, b in zip(w, step)]
        if max(map(abs, step)) < 1e-9:
            return w
    return w


class PlainView:
    """Logistic regression with an L1 penalty on a dense matrix."""

    def __init__(self, sets, y, weight, min_docs):
        q = quality_classifier
        times = Counter(f for s in sets for f in s.tolist())
        self.place = {f: i for i, f in enumerate(sorted(f for f, n in times.items() if n >= min_docs))}
        x = np.array([self.row(s) for s in sets])
        y, weight = np.array(y), np.array(weight)
        weight = weight * np.where(y > 0, 0.5 / weight[y > 0].sum(), 0.5 / weight[y <= 0].sum())
        w, b, seen, seen_b = np.zeros(x.shape[1]), 0.0, 1e-8, 1e-8
        for _ in range(150):
            slope = weight * (1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - y)
            grad = x.T @ slope
            seen, seen_b = seen + grad**2, seen_b + slope.sum() ** 2
            w = w - 0.3 * grad / np.sqrt(seen)
            w = np.sign(w) * np.maximum(0, abs(w) - 0.3 * q.L1 / np.sqrt(seen))
            b -= 0.3 * slope.sum() / math.sqrt(seen_b)
        self.w, self.b = w.astype(np.float32).astype(float), b

    def row(self, numbers):
        out = np.zeros(len(self.place))
        out[[self.place[f] for f in numbers.tolist() if f in self.place]] = 1
        return out

    def margin(self, numbers):
        return self.b + float(self.row(numbers) @ self.w)


def plain_cotraining(sets, y, free, rounds, per_round, sure):
    """Scores of all ``sets`` after co-training on those with a label (place -> label, in
    order of their hash); ``free``: tie -> place of unlabelled contents."""
    q = quality_classifier
    at = list(y)
    fit_on, calibrate_on, combine_on = ([p for k, p in enumerate(at) if (k % 8 < 6, k % 8 == 6, k % 8 == 7)[part]] for part in range(3))
    told = [{p: y[p] for p in fit_on} for _ in (0, 1)]  # what each view learns from
    given, seen = [{}, {}], set()
    clip = lambda x: max(-12.0, min(12.0, x))
    for turn in range(rounds + 1):
        views, scales = [], []
        for k in (0, 1):
            own = [*told[k].items(), *given[k].items()]
            views.append(PlainView([sets[p][k] for p, _ in own], [v for _, v in own], [1.0] * len(told[k]) + [q.PSEUDO_WEIGHT] * len(given[k]), q.MIN_DOCS if k == 0 else 1))
            scales.append(plain_newton([[views[k].margin(sets[p][k])] for p in calibrate_on], [y[p] for p in calibrate_on], [0, 0], 1e-3))
        logit = lambda k, p: clip(scales[k][0] * views[k].margin(sets[p][k]) + scales[k][1])  # noqa: B023, E731
        if turn == rounds:
            break
        p = {t: [1 / (1 + math.exp(-logit(k, i))) for k in (0, 1)] for t, i in free.items() if t not in seen}
        named = {}
        for k in (0, 1):
            for label, order in ((1.0, sorted((-v[k], t) for t, v in p.items() if v[k] >= sure)), (0.0, sorted((v[k], t) for t, v in p.items() if v[k] <= 1 - sure))):
                for _, t in order[:per_round]:
                    named.setdefault(t, {})[k] = label
        seen |= named.keys()
        for t in sorted(named):
            if len(set(named[t].values())) == 1:
                for k, v in named[t].items():
                    given[1 - k][free[t]] = v
    both, use = [[logit(0, p), logit(1, p)] for p in combine_on], [0, 1]
    while True:
        mix = plain_newton([[x[k] for k in use] for x in both], [y[p] for p in combine_on], [1.0] * len(use) + [0.0], q.MIX_RIDGE)
        if min(mix[:-1], default=0) >= 0:
            break
        use.remove(use[int(np.argmin(mix[:-1]))])
    score = lambda p: 1 / (1 + math.exp(-(sum(a * logit(k, p) for k, a in zip(use, mix)) + mix[-1])))
    return [score(p) for p in range(len(sets))], [len(g) for g in given]


def plain_classifier(docs, labels, rounds, per_round, sure):
    """Co-training over lists: every round all unlabelled documents are scored and sorted."""
    q = quality_classifier
    sets = [plain_features(r.text, r.source, r.lang, r.n_chars) for r in docs]
    tie = [int(np.uint64(xxhash.xxh3_64_intdigest(a.tobytes() + b"|" + b.tobytes())).astype(np.int64)) for a, b in sets]
    y = {}
    for r in labels:
        if r.doc_id is not None and r.quality is not None:
            y[r.doc_id] = min(y.get(r.doc_id, 1.0), float(r.quality > 0 and not r.toxic))
    return sets, tie, y


def test_classifier_equals_the_plain_version(spark):
    """All is fitted on: no bound of the sample is reached."""
    q, sf = quality_classifier, "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.collect()
    per_round, sure = 15, 0.8
    sets, tie, y = plain_classifier(rows, labels.collect(), 2, per_round, sure)
    told = q._told(labels).join(docs.select("doc_id"), "doc_id", "left_semi")
    ranked = [r.doc_id for r in hash_sample(told, 10_000).collect()]
    place = {r.doc_id: i for i, r in enumerate(rows)}
    free = {tie[i]: i for i, r in enumerate(rows) if r.doc_id not in y}
    want, given = plain_cotraining(sets, {place[d]: y[d] for d in ranked}, free, 2, per_round, sure)
    got = {r.doc_id: r.score for r in q.score(docs.repartition(5), labels, rounds=2, per_round=per_round, sure=sure).collect()}
    assert got.keys() == place.keys() and max(abs(got[d] - want[i]) for d, i in place.items()) < 1e-5
    assert min(given) > 0
    # the views are separate: what the one sees the other does not
    seen = [set(np.concatenate([s[k] for s in sets]).tolist()) for k in (0, 1)]
    assert not seen[0] & seen[1]
    mine = list(q.features_of([(r.text, r.source, r.lang, r.n_chars) for r in rows]))
    assert all((a == b).all() for x, z in zip(mine, sets) for a, b in zip(x, z))


def test_views_teach_each_other_and_reruns_agree(spark):
    q, sf = quality_classifier, "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    state = q.fit(docs, labels, sure=0.8)
    assert min(state.pseudo) > 0 and min(state.mix[:2]) >= 0, (state.pseudo, state.mix)
    again = q.fit(docs.orderBy(q.F.rand(1)).repartition(7), labels.orderBy(q.F.rand(2)), sure=0.8)
    assert state.pseudo == again.pseudo and all((a.weights == b.weights).all() for a, b in zip(state.views, again.views))
    parts = [set(x.tolist()) for x in q.folds(np.arange(48) % 3 > 0)]
    assert len(parts[0]) == 36 and not parts[0] & parts[1] and not parts[1] & parts[2] and set.union(*parts) == set(range(48))


def test_repeated_ids_do_not_change_what_is_learned(spark):
    rows = [(i % 20, ("fine text here " if i % 2 else "spam buy now ") * (5 + i % 7), "a", "en", 10) for i in range(60)]
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    one = quality_classifier.fit(spark.createDataFrame(rows, schema), labels)
    two = quality_classifier.fit(spark.createDataFrame(rows[::-1], schema).repartition(4), labels)
    assert all((a.weights == b.weights).all() for a, b in zip(one.views, two.views))


def test_classifier_on_held_out_labels(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    test = labels.where("doc_id % 5 = 0").collect()
    rows = {r.doc_id: r for r in quality_classifier.score(docs, labels.where("doc_id % 5 <> 0")).collect()}
    assert len(rows) == docs.count()
    state = quality_classifier.fit(docs, labels.where("doc_id % 5 <> 0"))
    assert min(state.pseudo) > 20 and min(state.mix[:2]) >= 0, (state.pseudo, state.mix)
    clean = [rows[r.doc_id].kept for r in test if r.quality and not r.toxic]
    low = [rows[r.doc_id].kept for r in test if not r.quality]
    toxic = [rows[r.doc_id].kept for r in test if r.quality and r.toxic]
    assert np.mean(clean) > 0.98 and np.mean(low) < 0.02 and np.mean(toxic) < 0.06, (np.mean(clean), np.mean(low), np.mean(toxic))
    assert quality_classifier.score(no_docs, labels).collect() == []
    told = spark.createDataFrame([(1, 1, 0), (2, 1, None), (6, 0, 0), (14, 1, 1), (14, 1, 0), (None, 1, 1), (3, None, 1), (10, 1, 0)], "doc_id long, quality int, toxic int")
    scored = quality_classifier.score(odd_docs, told).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r.score <= 1 for r in scored)
    kept = quality_classifier.keep(odd_docs, told)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r.kept for r in scored)
    # nothing to learn from: everything stays
    none = quality_classifier.score(odd_docs, told.limit(0)).collect()
    assert len(none) == odd_docs.count() and all(r.kept and r.score is None for r in none)
