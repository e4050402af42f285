import random

from tidemark.llm.leakage import LeakIndex, leak_report, leaked_items, words

VOCABULARY = [f"w{i}" for i in range(60)]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, item_id string, n int")


def items(spark, rows):
    return spark.createDataFrame([(i, None, t, "clash") for i, t in rows], "item_id long, suite string, text string, doc_id string")


def brute(documents, tests, n=30):
    runs = {}
    for i, t in tests:
        w = words(t)
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in documents:
        w = words(t)
        for k in range(len(w) - n + 1):
            out |= {(i, d) for i in runs.get(tuple(w[k : k + n]), ())}
    return out


def pairs(df):
    return {(r["item_id"], r["doc_id"]) for r in df.collect()}


def text(rng, n, vocabulary=VOCABULARY):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def test_words():
    assert words("A_b-C9\nd") == [b"a_b", b"c9", b"d"]
    assert words(r"a\nb\tc") == [b"a", b"b", b"c"] and words("// x\\\\ny") == [b"x", b"y"]
    assert words("na\u00efve \u212aelvin") == [b"na", b"ve", b"elvin"] and words(None) == [] and words("") == []


def test_every_run_is_found_and_nothing_else(spark):
    rng = random.Random(2)
    tests = [(i, text(rng, rng.choice([29, 30, 31, 80, 200]))) for i in range(40)]
    tests += [(100, tests[3][1] + " " + text(rng, 40)), (101, tests[3][1]), (102, ""), (103, None), (104, "w1 " * 500)]
    documents = []
    for d in range(200):
        i, t = rng.choice([x for x in tests if x[1]])
        w = t.split()
        n = rng.choice([28, 29, 30, 31, 45, 61, 100])
        k = rng.randrange(max(1, len(w) - n + 1))
        piece = "\n// ".join(" ".join(w[k + j : k + min(j + 7, n)]) for j in range(0, min(n, len(w) - k), 7)).upper()
        documents.append((1000 + d, text(rng, rng.randrange(60), [*VOCABULARY, "zz", "yy"]) + "; " + piece + r"\n" + text(rng, rng.randrange(60), [*VOCABULARY, "xx"])))
    documents += [(2000, None), (2001, ""), (2002, "w1 " * 5000), (2003, text(rng, 20000, [*VOCABULARY, "q"]))]
    documents += [documents[0]] * 2
    want = brute(documents, tests)
    assert 60 < len(want)
    assert pairs(leaked_items(docs(spark, documents), items(spark, tests))) == want


def test_several_indexes_give_the_same(spark):
    rng = random.Random(4)
    tests = [(i, text(rng, 60)) for i in range(30)]
    documents = [(d, tests[d % 30][1]) for d in range(60)]
    assert pairs(leaked_items(docs(spark, documents), items(spark, tests), index_chars=1000)) == brute(documents, tests)


def test_retrieval_prunes_but_keeps_every_holder():
    rng = random.Random(9)
    tests = [(i, text(rng, 70, [f"t{i}_{k}" for k in range(40)] + VOCABULARY[:20])) for i in range(200)]
    index = LeakIndex.build(tests)
    windows = index.passages(" ".join(t for _, t in tests[:50]))
    w, i = index.retrieve(windows)
    assert len(w) < 0.2 * len(windows) * len(tests)
    assert set(index.find(windows)[1].tolist()) == set(range(50))


def test_empty_tables_and_report(spark):
    none_d, none_i = docs(spark, []), items(spark, [])
    some_d, some_i = docs(spark, [(1, "w1 " * 40)]), items(spark, [(1, "w1 " * 40), (2, "w2")])
    for d, i in ((none_d, none_i), (none_d, some_i), (some_d, none_i)):
        assert leaked_items(d, i).count() == 0
    report = leak_report(leaked_items(some_d, some_i), some_i)
    assert {r["item_id"]: r["n_documents"] for r in report.collect()} == {1: 1, 2: 0}


def test_thousands_of_items_in_one_index():
    rng = random.Random(11)
    tests = [(i, text(rng, 60, [f"t{i % 97}_{k}" for k in range(30)] + VOCABULARY)) for i in range(3000)]
    index = LeakIndex.build(tests)
    assert index.n_blocks == 188 and len(index.item) < 3000 * 60
    picked = rng.sample(tests, 40)
    documents = [(k, text(rng, 10) + " " + " ".join(t.split()[5:45]) + " zz " + text(rng, 50)) for k, (_, t) in enumerate(picked)]
    got = set()
    for d, t in documents:
        w = index.passages(t)
        got |= {(i, d) for i in index.find(w)[1].tolist()}
    assert got == brute(documents, tests) and len(got) >= 40
