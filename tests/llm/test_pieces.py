import math
from collections import Counter

import numpy as np
import sentencepiece

from kinetrace.llm import pieces as pc

DOCS = "doc_id long, text string, pieces string, decoded int, _key int"
TEXTS = ["Hello  world\nthis is it", "the the the", " lead and trail  ", "", None, "naïve 日本語 ▁ 🙂\t\r\n\x00x", "a" * 50_000, "word " * 20_000, "ŝĵ", "\n\n", "▁"]


def ways(word, sampler):
    """Every segmentation of a word with its weight."""
    if not word:
        return [((), 0.0)]
    out = []
    for k in range(1, len(word) + 1):
        if word[:k] in sampler.pieces:
            i, w = sampler.pieces[word[:k]]
            out += [((i, *rest), w + v) for rest, v in ways(word[k:], sampler)]
    return out


def test_samples_follow_the_posterior():
    sampler = pc.PieceSampler(pc.default_path())
    word = " thing"
    drawn = Counter(np.frombuffer(b, sampler.dtype).tobytes() for b in sampler.encode([word[1:]] * 20_000, np.arange(20_000, dtype=np.uint64)))
    all_ways = ways(word, sampler)
    total = sum(math.exp(w) for _, w in all_ways)
    expected = {np.array(ids, sampler.dtype).tobytes(): math.exp(w) / total for ids, w in all_ways}
    assert set(drawn) <= set(expected) and len(drawn) > 3
    assert all(abs(drawn[k] / 20_000 - p) < 0.02 for k, p in expected.items())
    sharp = pc.PieceSampler(pc.default_path(), 8.0)
    assert len({bytes(b) for b in sharp.encode([word[1:]] * 500, np.arange(500, dtype=np.uint64))}) < len(drawn)


def test_long_and_short_words_are_filtered_alike():
    word = " interoperability日本ñ\tx"
    one, many = pc.PieceSampler(pc.default_path()), pc.PieceSampler(pc.default_path())
    one._learn_long(word)
    many._learn([word])
    assert list(one.start) == list(many.start) and list(one.piece) == list(many.piece)
    assert np.allclose(np.array(one.cumulative), np.array(many.cumulative), atol=1e-9)


def test_round_trip_is_lossless_and_reproducible(spark):
    rows = [(k, t, "x", 1, 2) for k, t in enumerate(TEXTS)] + [(None, "the key is null", None, None, None), (1, "the the the", None, None, None)]
    path = pc.default_path()
    runs = []
    for parts in (1, 5):
        encoded = pc.encode_pieces(spark.createDataFrame(rows, DOCS).repartition(parts), path)
        got = pc.decode_pieces(encoded, path).collect()
        assert len(got) == len(rows) and all(r.decoded == r.text for r in got)
        assert sorted((r.text for r in got)) == sorted(t or "" for _, t, *_ in rows)
        runs.append(sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.pieces)) for r in got))
    assert runs[0] == runs[1]
    fused = pc.encode_and_verify(spark.createDataFrame(rows, DOCS).repartition(3), path).collect()
    assert all(r.lossless for r in fused) and sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.pieces)) for r in fused) == runs[0]
    other = pc.encode_pieces(spark.createDataFrame(rows, DOCS), path, seed=1).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.pieces)) for r in other) != runs[0]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for doc, packed in runs[0]:
        text = "the key is null" if doc == -1 else TEXTS[doc] or ""
        if "▁" not in text and "\x00" not in text:
            assert library.decode(np.frombuffer(packed, "<u2").tolist()) == text
    assert pc.encode_pieces(spark.createDataFrame([], DOCS), path).count() == 0
