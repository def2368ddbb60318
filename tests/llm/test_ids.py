from kinetrace.llm import html_extract, minhash, ngram_model, pieces

BIG = 1152921504606846977
ROWS = [(None, "one two three four five six"), (BIG, "seven eight nine ten eleven"), (2**53 + 1, None), (2**53, "and so on and on and on")]


def test_large_ids_beside_a_null_stay_as_they_are(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    want = {r[0] for r in ROWS}
    near = minhash.near_duplicates(docs).collect()
    assert {r.doc_id for r in near} == want and all(r.component_id == r.doc_id for r in near)
    assert {r.doc_id for r in ngram_model.score(docs, ngram_model.train(docs)).collect()} == want
    assert {r.doc_id for r in pieces.encode_pieces(docs, pieces.default_path()).collect()} == want
    alone = {r.doc_id: bytes(r.pieces) for k in ROWS for r in pieces.encode_pieces(spark.createDataFrame([k], "doc_id long, text string"), pieces.default_path()).collect()}
    assert {r.doc_id: bytes(r.pieces) for r in pieces.encode_pieces(docs, pieces.default_path()).collect()} == alone
    pages = docs.selectExpr("doc_id as page_id", "'http://h/' as url", "text as html")
    assert {r.page_id for r in html_extract.extract_main_text(pages).collect()} == want
