"""Language identification with thousands of letters: edges only are held, with the same results."""

from __future__ import annotations

import pickle
import random

import numpy as np

from marketspark.llm import language_id


def texts_of(r, letters, n):
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(400)]
    return [" ".join(r.choice(words) for _ in range(60)) for _ in range(n)]


def test_displaced_edges_equal_the_dense_table(monkeypatch):
    r = random.Random(61)
    known = {"aa": texts_of(r, "abcdé", 6), "bb": texts_of(r, "bcdefgßh", 6), "cc": texts_of(r, [chr(0x4E00 + i) for i in range(500)], 6)}
    probes = [t for la in known for t in texts_of(r, "abcdefé", 3) + known[la][:2]] + ["", "123", "xyz 日本", known["cc"][0][:50] + " abc " + known["aa"][0]]
    dense = language_id.CrossParser(known).ready()
    monkeypatch.setattr(language_id, "DENSE_ENTRIES", 0)
    sparse = pickle.loads(pickle.dumps(language_id.CrossParser(known))).ready()
    assert dense.table is not None and sparse.table is None
    for a, b in zip(dense.phrases(probes), sparse.phrases(probes), strict=True):
        assert np.array_equal(a, b)
    assert dense.predict(probes) == sparse.predict(probes)


def test_two_languages_of_thousands_of_letters_stay_small():
    r = random.Random(62)
    alphabets = {"x1": [chr(0x4E00 + i) for i in range(5600)], "x2": [chr(0xAC00 + i) for i in range(5600)]}
    known = {la: texts_of(r, a, 40) + ["".join(a)] for la, a in alphabets.items()}
    parser = language_id.CrossParser(known)
    assert parser.table is None and len(pickle.dumps(parser)) < 20 << 20
    probes = [t for la in known for t in (known[la][3][:80], " ".join(r.sample(known[la][0].split(), 20)))]
    assert parser.ready().predict(probes)[0] == ["x1", "x1", "x2", "x2"]


def test_the_same_documents_train_in_every_run(spark):
    rows = [(None if i % 3 else i % 4, f"{'abc' if i % 2 else 'xyz'} " * (1 + i % 7), "aa" if i % 2 else "bb") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = language_id.train(d.repartition(7)), language_id.train(d.repartition(3, "lang"))
    assert pickle.dumps(one.__dict__) == pickle.dumps(two.__dict__)
