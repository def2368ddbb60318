import random
import re

from kinetrace.llm.components import components
from kinetrace.llm.minhash import near_duplicates

DOCS = "doc_id long, text string, n string, rid int"


def brute(rows, width, percent):
    sets = {}
    for doc, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéÀß") for _ in range(4))
    texts = []
    for size in (1, 2, 3, 8, 60, 200):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for _ in range(8):
                own = list(base)
                for _ in range(rng.randint(0, max(1, size // 15))):
                    own[rng.randrange(size)] = word()
                texts.append(rng.choice([" ", "\n", "\t "]).join(own))
    texts += [None, "", " \n", texts[0], texts[0].upper(), " ".join(word() for _ in range(30_000))]
    rng.shuffle(texts)
    return [(k, t, "x", 1) for k, t in enumerate(texts)]


def test_components_match_brute_force(spark):
    rows = corpus()
    for width, percent in ((3, 85), (5, 80)):
        got = near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5), width=width, percent=percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, width, percent)
        assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_repeated_null_and_no_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "z"), (7, "q")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 1), (1, 1), (1, 1), (7, 7)]
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_chains_and_stars_contract(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 7: 7, **{k: 7 for k in range(200, 260)}}


def test_a_pair_among_thousands_of_longer_texts_is_found(spark):
    """Two texts at 0.86, both contained in every one of thousands of texts that are like neither, and a pair among texts of one template."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    licence = [word() for _ in range(120)]
    near = [*licence[:9], *(word() for _ in range(6)), *licence[15:]]
    rows = [" ".join([*(licence if k % 2 else near), *(word() for _ in range(130))]) for k in range(4000)]
    template = [word() for _ in range(70)]
    rows += [" ".join([*template, *(word() for _ in range(30))]) for _ in range(1500)]
    rows += [" ".join(licence), " ".join(near), rows[5000], rows[5000] + " more"]
    rows = [(k, t) for k, t in enumerate(rows)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), width=3, percent=85).collect()}
    assert {d: c for d, c in got.items() if d != c} == {5501: 5500, 5502: 5000, 5503: 5000}


def test_different_texts_with_one_id_are_different_documents(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "a b c d e f"), (3, "q r s t u v"), (None, "a b c d e f"), (9, "z")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [(-1, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (9, 9, True)]
