import heapq
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kinetrace.llm import packing, token_files, tokens

DOCS = "doc_id long, text string, sequence_id string, _grp int"


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choice(["Hello", "wörld", "it's", "42", "a\tb", "ΣΑΣ", "<|endoftext|>", "日本語", ""]) for _ in range(rng.choice([0, 1, 5, 900, 4000]))), "x", 1) for k in range(n)]
    return [*rows, (n, None, None, None), (n + 1, "", "y", 2), (n + 1, "", "y", 2)]


def true_ids(rows):
    tok = Tokenizer.from_file(tokens.default_path())
    return [(r[0], np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")) for r in rows]


def test_words_give_the_ids_of_whole_texts():
    texts = ["  two  spaces ", "tab\tand\nline", "it's <|endoftext|>x", "é ́x", "", " "]
    tok, lib = tokens.load(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    for text, ids in zip(texts, tok.encode(texts), strict=True):
        assert np.frombuffer(ids, tok.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_words_give_the_ids_of_whole_texts_over_all_of_unicode():
    rng = random.Random(11)
    marks = "İ,.É!ß'’~<|>\u0301\u0307\u0327\u0338\x1c\x85\xa0\u2028\u3000 \n\tÀéªµ½²'s'll0٣日本ΣςǅﬁeW\u030a\u212a\u037e.,"
    wide = [chr(c) for c in range(1, 0x2FFF) if not 0xD800 <= c < 0xE000]
    tok, lib = tokens.WordTokenizer(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    texts = ["BELEDİYESİ, ANKARA", "BİLGİSİ. Yeni", "<|ENDOFTEXT|> <|endoftext|>, x", "a" * 300 + ", " + "b." * 90, "?!. a?!b it's, x's. Don'T!", "\u0958, \ufb1d. İ;"]
    for _ in range(4000):
        pool = rng.choice([marks, "abcÉéÀ.,'!?  \n019-", wide])
        texts.append("".join(rng.choice(pool) for _ in range(rng.randint(1, 40))))
    for _ in range(2):  # from the library, and then as remembered
        wrong = [t for t, ids in zip(texts, tok.encode(texts), strict=True) if np.frombuffer(ids, tok.dtype).tolist() != lib.encode(t, add_special_tokens=False).ids]
        assert not wrong


def test_null_and_large_ids_of_one_batch_stay_as_they_are(spark, tmp_path):
    big = 1152921504606846977
    docs = spark.createDataFrame([(None, "a b", "x", 1), (big, "c d.", "x", 1), (2**53 + 1, None, "x", 1), (None, None, "x", 1), (big, "c d.", "x", 1)], DOCS).coalesce(1)
    got = packing.pack(docs, tokens.default_path()).toPandas().doc_id.tolist()
    assert sorted(str(x) for x in packing.pack(docs, tokens.default_path()).rdd.map(lambda r: r.doc_id).collect()) == sorted(["None", "None", str(big), str(big), str(2**53 + 1)]) and len(got) == 5
    token_files.write_token_files(docs, str(tmp_path / "ids"), tokens.default_path())
    rows = sorted(token_files.read_token_files(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 2**53 + 1, big, big]


def test_one_hot_document_is_dealt_to_all_groups(spark):
    docs = spark.createDataFrame([(None, "one text", "x", 1)] * 4000, DOCS).repartition(4)
    got = packing.pack(docs, tokens.default_path(), group_docs=100).selectExpr("sequence_id >> 32 as grp").groupBy("grp").count().toPandas()
    assert len(got) == 40 and got["count"].max() < 200


def test_every_id_lies_in_one_piece_and_sequences_have_no_padding(spark):
    rows = corpus()
    got = packing.pack(spark.createDataFrame(rows, DOCS), tokens.default_path(), group_docs=10).toPandas()
    truth = dict(true_ids(rows))
    for doc, pieces in got.groupby("doc_id"):
        copies = 2 if doc == 61 else 1
        at, ids = 0, truth[doc]
        for _, p in pieces.drop_duplicates("start").sort_values("start").iterrows():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids) and pieces.length.sum() == copies * len(ids)
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        total = seq.length.sum()
        assert (seq.offset.to_numpy() == np.cumsum(seq.length) - seq.length).all()
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack(spark.createDataFrame([], DOCS), tokens.default_path()).count() == 0


def test_tournament_is_first_fit():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    bins = []
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        for b in bins:
            if sum(lengths[x] for x in b) + lengths[i] <= 100:
                b.append(i)
                break
        else:
            bins.append([i])
    assert [[p[0] for p in b] for b in packing.first_fit_decreasing(lengths, 100)] == bins


def huffman_cost(counts):
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@pytest.mark.parametrize("seed", range(4))
def test_code_lengths_are_optimal_limited_and_decodable(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, 500)
    bits = token_files.code_lengths(counts)
    assert (counts * bits.astype(int)).sum() == huffman_cost(counts)
    steep = np.array([1, 1, *np.cumprod(np.full(30, 2))])
    short = token_files.code_lengths(steep)
    assert short.max() <= 16 and abs(sum(2.0 ** -int(b) for b in short if b) - 1) < 1e-9
    many = np.ones(70_000, np.int64)  # more ids than 16 bits tell apart
    many[:10] = 10_000
    for b in (bits, short, token_files.code_lengths(many)):
        ids = rng.choice(np.flatnonzero(b), 5000)
        payload, marks = token_files.encode_ids(ids, token_files.canonical_codes(b), b)
        more, marks2 = token_files.encode_ids(ids[:300], token_files.canonical_codes(b), b)
        back = token_files.decode_blocks([payload, more], [marks, marks2], [5000, 300], *token_files.decode_table(b))
        assert (back[0] == ids).all() and (back[1] == ids[:300]).all()


def test_token_files_round_trip(spark, tmp_path):
    rows = corpus()
    path = str(tmp_path / "file")
    token_files.write_token_files(spark.createDataFrame(rows, DOCS), path, tokens.default_path())
    got = token_files.read_token_files(spark, path, with_ids=True).toPandas().sort_values("start")
    at = 0
    for (doc, ids), (_, row) in zip(true_ids(rows), got.iterrows(), strict=True):
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        assert list(row.ids) == ids.tolist()
        at += len(ids)
    token_files.write_token_files(spark.createDataFrame([], DOCS), str(tmp_path / "none"), tokens.default_path())
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0
