import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kinetrace.llm import ngram_model as lm

DOCS = "doc_id long, text string, uid string, far int, _text int"


@pytest.mark.parametrize("seed", range(4))
def test_elias_fano_and_trie(seed):
    rng = np.random.default_rng(seed)
    values = np.sort(rng.integers(0, rng.choice([5, 1000, 1 << 40]), rng.choice([0, 1, 7, 3000]))).astype(np.uint64)
    header, buffer = lm.EliasFano.pack(values)
    ef = lm.EliasFano.open(header, memoryview(buffer))
    assert (ef.get(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, rng.integers(0, 1 << 41, 500).astype(np.uint64)])
    where = {int(v): k for k, v in reversed(list(enumerate(values.tolist())))}
    assert ef.find(asked).tolist() == [where.get(int(v), -1) for v in asked]
    keys = np.unique(rng.integers(0, 50, 400).astype(np.uint64) << np.uint64(24) | rng.integers(0, 90, 400).astype(np.uint64))
    trie = lm.Trie(lm.Trie.pack(keys))
    assert (trie.keys() == keys).all() and (trie.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 31, 300).astype(np.uint64), keys)
    assert (trie.find(other) == -1).all()


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]


def brute(train, docs, strength, classes):
    """Scores by definition; ``classes`` words have classes of their own."""
    tokens = [words_of(t) for t in train]
    count = Counter(w for t in tokens for w in t)
    total, kinds = sum(count.values()), len(count)
    p = lambda w: (count[w] + 0.5) / (total + 0.5 * (kinds + 1))
    order = Counter(count.values())
    least, held = None, 0
    for n in sorted(order, reverse=True):
        held += order[n]
        if held > classes:
            break
        least = n
    own = {w for w in count if least is not None and count[w] >= least}
    cls = lambda w: w if w in own else None
    share = {w: p(w) for w in own}
    share[None] = 1 - sum(share.values())
    context = Counter(cls(w) for t in tokens for w in t)
    pair = Counter((cls(a), cls(b)) for t in tokens for a, b in zip([t[-1], *t[:-1]], t, strict=True))
    prob = lambda a, b: (pair[cls(a), cls(b)] + strength * share[cls(b)]) / (context[cls(a)] + strength) * p(b) / share[cls(b)]
    out = {}
    for doc, text in docs:
        t = words_of(text)
        out[doc] = (len(t), sum(count[w] > 0 for w in t), total, sum(math.log10(p(w)) for w in t), sum(math.log10(prob(a, b)) for a, b in zip([t[-1], *t[:-1]], t, strict=True)))
    return out, prob, own


def test_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "MOST_CLASSES", 40)
    monkeypatch.setattr(lm, "HEAD", 4)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    monkeypatch.setattr(lm, "RUN_BYTES", 2000)
    rng = random.Random(5)
    vocabulary = [f"W{k}é" for k in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    text = lambda: rng.choice([" ", "\n", "\t "]).join(w for _ in range(rng.choice([1, 5, 60])) for w in [rng.choices(vocabulary, weights)[0]] * rng.choice([1, 1, 2]))
    rows = [(k, text(), "x", 1, 2) for k in range(150)] + [(200, None, None, None, None), (201, "", "", 0, 0), (202, "new " * 20_000, "", 0, 0), (7, "w1é W0É again", "", 0, 0)]
    train = [r for r in rows if r[0] % 5 != 1 and r[0] < 200]
    model = lm.train(spark.createDataFrame(train, DOCS).repartition(3))
    assert model.tries.count() >= 3
    want, prob, own = brute([r[1] for r in train], [(i, r[1]) for i, r in enumerate(rows)], model.strength, 40)
    got = lm.score(spark.createDataFrame(rows, DOCS).repartition(4), model).collect()
    assert len(got) == len(rows)
    by_doc = {}
    for i, r in enumerate(rows):
        by_doc.setdefault(r[0], []).append(want[i])
    for doc, wanted in by_doc.items():
        found = sorted((g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score) for g in got if g.doc_id == doc)
        for f, w in zip(found, sorted(wanted), strict=True):
            assert f[:3] == w[:3] and f[3] == pytest.approx(w[3], abs=1e-6) and f[4] == pytest.approx(w[4], abs=2e-3 * w[0] ** 0.5)
    vocabulary_ = {w for r in train for w in words_of(r[1])} | {"unseen"}
    for a in ("w0é", "never", "\n"):
        assert sum(prob(a, b) for b in vocabulary_) == pytest.approx(1, abs=1e-9)


def test_repeated_rows_no_rows_and_no_training(spark):
    rows = [(1, "a b a", "x", 1, 2), (1, "a b a", "x", 1, 2), (None, "b", "x", 1, 2)]
    docs = spark.createDataFrame(rows, DOCS)
    got = lm.score(docs, lm.train(docs)).collect()
    assert len(got) == 3 and len({(g.base_score, g.score, g.n_known) for g in got if g.doc_id == 1}) == 1
    assert got[0].train_tokens == 10
    nothing = lm.train(docs.filter("false"))
    assert all(g.n_known == 0 and g.base_score == pytest.approx(0) for g in lm.score(docs, nothing).collect())
    assert lm.score(docs.filter("false"), nothing).count() == 0


def test_all_words_keep_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(lm, "SENT_WORDS", 40)
    monkeypatch.setattr(lm, "HEAD", 4)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    monkeypatch.setattr(lm, "RUN_BYTES", 2000)
    rng = random.Random(6)
    vocabulary = [f"W{k}é" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    rows = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 60]))) + " rare then once", "x", 1, 2) for k in range(120)]
    rows += [(200, None, None, None, None), (201, "never then w299é w298é", "", 0, 0), (202, "w250é w251é " * 50, "", 0, 0)]
    train = [r for r in rows if r[0] < 100] + [(300, "w250é w251é w250é w251é", "", 0, 0)]
    model = lm.train(spark.createDataFrame(train, DOCS).repartition(3))
    want, *_ = brute([r[1] for r in train], [(r[0], r[1]) for r in rows], model.strength, 10**9)
    got = {g.doc_id: g for g in lm.score(spark.createDataFrame(rows, DOCS).repartition(4), model).collect()}
    assert len(got) == len(rows)
    for doc, w in want.items():
        g = got[doc]
        assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3] and g.base_score == pytest.approx(w[3], abs=1e-6) and g.score == pytest.approx(w[4], abs=2e-3 * w[0] ** 0.5)


def test_cells_come_back_as_they_were():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 5000):
        keys = rng.integers(0, 1 << 48, n, dtype=np.uint64)
        assert (lm._unpacked_keys(lm._packed_keys(keys)) == keys).all()
        counts = rng.integers(0, 1 << 40, n)  # beyond 32 bits
        assert (lm._unpacked_counts(lm._packed_counts(counts)) == counts).all()
        codes = rng.integers(0, 1 << 64, (n, 2), dtype=np.uint64)
        codes[rng.random((n, 2)) < 0.5] >>= np.uint64(42)  # ids beside hashes
        got = lm._unpacked_codes(lm._packed_codes(codes))
        assert got.shape == codes.shape and (got == codes).all()


def test_tokens_do_not_depend_on_how_many_texts_are_hashed_at_once():
    raws = [b"one two", b"", b"x " * 700_000, b"three", b"y" * 1_500_000, b"four five six"]
    tokens, starts = lm._tokens(raws)
    for k, raw in enumerate(raws):
        own, _ = lm._tokens([raw])
        assert (tokens[starts[k] : starts[k + 1]] == own).all()
