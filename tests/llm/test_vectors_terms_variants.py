"""Operators 11 to 13 against brute force on small fixtures, and their edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marketspark.llm import source_divergence, spelling_variants, vector_dedup
from tests import parity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, word string, n long, rows long"
VECTORS = "vec_id long, embedding array<float>, label int, node long, h long, text string"


# ------------------------------------------------------------------ 11: divergence

def divergence_by_hand(rows):
    """(lang, source, part, item): (value, rank) by the contract, every pair and term written out."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = {}
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= 10]
        of = sorted(s for g, s in groups if g == lang)
        shares = {}
        for s in [*of, None]:
            own = {t: sum(count[lang, x][t] for x in (of if s is None else [s])) for t in kept}
            total = sum(own.values())
            shares[s] = {t: 1 + 10 ** 9 * (n + 2) // (total + 2 * len(kept)) for t, n in own.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        pair = [(-sum(f(shares[source][t], shares[s][t]) for t in kept), s.encode()) for s in of if s != source]
        term = [(-f(shares[source][t], shares[None][t]), t.encode()) for t in kept
                if count[lang, source][t] and shares[source][t] > shares[None][t]]
        for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:10])):
            for rank, (value, item) in enumerate(items, 1):
                out[lang, source, part, item.decode()] = (-value, rank)
    return out


def audited(spark, rows):
    d = spark.createDataFrame([(i, t, la, so, None, "x", "y", 1, 2) for i, (t, la, so) in enumerate(rows)], DOCS)
    found = source_divergence.audit(d).collect()
    assert len({(r.lang, r.source, r.part, r.item) for r in found}) == len(found)
    return {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in found}


def test_divergence_equals_the_sum_over_all_terms(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdéß日") for _ in range(r.randint(1, 3))) for _ in range(90)] + ["", "0", "_"]
    rows = []
    for i in range(160):
        text = " ".join(r.choice(words[: 10 + 5 * (i % 17)]) for _ in range(r.randint(0, 60)))
        rows.append((r.choice([text, text.upper()]), r.choice(["en", "de", None]), f"s{r.choice([0, 0, 0, 1, 2, 3, 4, 5])}"))
    rows += [(None, "en", "silent"), ("", "xx", None), ("one two", "xx", "b"), ("123 !", "yy", "alone")] + [("Tie tie", "t", "u"), ("tie", "t", "v")] * 10
    rows.append((("lang " * 30_000) + "x" * 50_000, "en", "s1"))
    assert audited(spark, rows) == divergence_by_hand(rows)


def test_divergence_of_no_documents_is_empty(spark):
    assert source_divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_divergence_over_many_blocks_of_rows_and_columns(spark, monkeypatch):
    """Small blocks, so that a lang has several of rows and of columns, with overflow."""
    monkeypatch.setattr(source_divergence, "FILL", 4)
    monkeypatch.setattr(source_divergence, "SIDE", 8)
    r = random.Random(4)
    rows = [(" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(12)), r.choice("pq"), f"s{i % 23}") for i in range(300)]
    assert audited(spark, rows) == divergence_by_hand(rows)


def test_divergence_against_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    result = parity.compare(source_divergence.audit(docs), parity.duck_connection(SF), source_divergence.ORACLE)
    assert result["ok"], result


@pytest.mark.parametrize("density", [0.0, 0.02, 0.5])
def test_joint_costs_equal_a_dense_sum(density):
    r = np.random.RandomState(5)
    zero = [r.randint(1, 1000, 37), r.randint(1, 1000, 21)]
    dense, sides = [], []
    for z in zero:
        held = r.rand(len(z), 900) < density
        p = np.where(held, r.randint(1, 10 ** 9, held.shape), z[:, None])
        at = np.nonzero(held)
        tree = source_divergence.build_tree(*at, p[at]) if held.any() else (None, None, None)
        dense.append(p)
        sides.append(source_divergence.Side(z, *tree))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for x, y, same in ((0, 1, False), (0, 0, True)):
        want = np.array([[f(p, q).sum() for q in dense[y]] for p in dense[x]])
        got = source_divergence.joint_costs(sides[x], sides[y], same) + 900 * source_divergence.zero_costs(sides[x], sides[y])
        at = np.triu(np.ones(want.shape, dtype=bool), 1) if same else np.ones(want.shape, dtype=bool)
        assert (got == want)[at].all()


# ------------------------------------------------------------------ 12: vectors

def links_by_hand(rows, cosine=0.93):
    """[(vec_id, n_links, component_id)] by comparing all pairs of a label and length."""
    sound = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = {i: np.array(rows[i][1], dtype=np.float32).astype(float) for i in sound}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    for i in sound:
        for j in sound:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                n[i] += 1
                n[j] += 1
                root[find(j)] = find(i)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return sorted(((row[0], n[i], least.get(find(i))) for i, row in enumerate(rows)), key=repr)


def clustered(r, groups, size, spread, dim=24, labels=2):
    out = []
    for _ in range(groups):
        centre, label = r.standard_normal(dim), int(r.randint(labels))
        out += [((centre + spread * r.standard_normal(dim)).astype(np.float32).tolist(), label) for _ in range(r.randint(1, size))]
    return out


def found_vectors(spark, rows):
    d = spark.createDataFrame([(i, v, la, 7, 8, "t") for i, v, la in rows], VECTORS)
    found = vector_dedup.near_vectors(d).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=repr)


def test_vectors_equal_all_pairs(spark):
    r = np.random.RandomState(6)
    vectors = clustered(r, 60, 9, 0.12)
    rows = [(i, v, la) for i, (v, la) in enumerate(vectors)]
    rows += [(900 + i, [2 * x for x in v], la) for i, (v, la) in enumerate(vectors[:5])]  # other lengths, same direction
    rows += [(950 + i, v, 1 - la) for i, (v, la) in enumerate(vectors[:5])]  # another label
    rows += [(960, vectors[0][0], None), (961, None, 1), (962, [], 1), (963, [0.0] * 24, 1), (964, [float("nan")] * 24, 1),
             (965, [float("inf")] + [1.0] * 23, 1), (966, [None] + [1.0] * 23, 1), (967, [1.0, 2.0], 1), (968, [1.0, 2.0], 1),
             (None, vectors[3][0], vectors[3][1]), (None, None, None), (3, vectors[3][0], vectors[3][1])]
    rows += [(1000 + i, vectors[9][0], vectors[9][1]) for i in range(40)]  # a group of equal vectors
    assert found_vectors(spark, rows) == links_by_hand(rows)


def test_long_lists_are_cut_and_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    monkeypatch.setattr(vector_dedup, "PAIRS", 64)
    r = np.random.RandomState(7)
    vectors = clustered(r, 6, 60, 0.08) + clustered(r, 40, 3, 0.1)
    rows = [(i, v, la) for i, (v, la) in enumerate(vectors)]
    assert found_vectors(spark, rows) == links_by_hand(rows)


def test_no_vectors(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


def test_recall_at_the_link_cosine():
    """Pairs of just the link cosine pass with the calibrated probability, at several sizes of the table."""
    r = np.random.RandomState(8)
    x = vector_dedup.unit_vectors(r.standard_normal((4000, 64)))
    side = r.standard_normal((4000, 64))
    side = vector_dedup.unit_vectors(side - (side * x).sum(axis=1, keepdims=True) * x)
    y = 0.93 * x + np.sqrt(1 - 0.93 ** 2) * side
    for largest in (10, 5_000, 10 ** 6, 10 ** 9):
        plan = vector_dedup.Plan(largest)
        (v, c), (w, d) = plan.signature(x), plan.signature(y)
        close = np.abs(v - w) <= plan.window
        own = np.arange(plan.tables) % vector_dedup.PROJECTIONS
        met = ((c == d) & close[:, own]).any(axis=1) & (close.sum(axis=1) >= plan.least)
        assert met.mean() >= 0.93


def test_vectors_of_the_test_table(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in d.collect()]
    found = sorted(((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_vectors(d).collect()), key=repr)
    assert found == links_by_hand(rows)


# ------------------------------------------------------------------ 13: spelling variants

def variants_by_hand(rows):
    """[(word, form, root, n, n_near, form_n)] by looking each edit of each word up."""
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    letters = sorted(set("".join(words)))
    form, near = {}, {}
    for w in words:
        edits = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters} \
            | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = sorted((e for e in edits - {w} if e in words), key=lambda e: (-words[e], e))
        if near[w] and words[near[w][0]] >= 2 * words[w]:
            form[w] = near[w][0]

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()), key=repr)


def found_variants(spark, rows):
    d = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", 1, 2) for i, t in rows], DOCS)
    return sorted(map(tuple, spelling_variants.variants(d).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_variants_equal_brute_force_on_the_test_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    found = spelling_variants.variants(d).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, found), key=repr) == variants_by_hand([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])


@pytest.mark.parametrize("extended", [64, 2])
def test_variants_of_dense_words(spark, monkeypatch, extended):
    """Few letters, so that most words have near ones; with 2 nearly all grams are extended."""
    monkeypatch.setattr(spelling_variants, "LIST", extended)
    r = random.Random(9)
    words = ["".join(r.choice("abÀÿ÷") for _ in range(r.randint(4, 8))) for _ in range(700)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "babab", "ababa"]
    rows = [(i, " ".join(r.choice([w, w.upper()]) for w in (r.choice(words[: 1 + r.randint(0, len(words) - 1)]) for _ in range(60))))
            for i in range(120)]
    assert found_variants(spark, rows) == variants_by_hand(rows)


def test_variants_of_odd_rows(spark):
    long = "z" * 70_000
    rows = [(1, None), (2, ""), (3, " 12 _ "), (None, "Colour colour color colour"), (None, "Colour colour color colour"),
            (4, "colour color colors " * 3), (5, f"{long} {long[1:]} " * 3), (5, f"{long} {long[1:]} " * 3),
            (6, "equal equal equal equan equan equan equas equas equas equas equas equas"), (7, "équal " * 3), (8, "straße " * 40 + "strase " * 3)]
    short = [(i, t and re.sub("z+", lambda m: "z" * (60 - len(long) + len(m[0])), t)) for i, t in rows]
    assert found_variants(spark, short) == variants_by_hand(short)
    found = {f[0]: f for f in found_variants(spark, rows)}
    assert found[long][1] in (None, long[1:]) and found[long][4] == 1 and found[long[1:]][4] == 1


def test_no_words(spark):
    assert found_variants(spark, []) == [] and found_variants(spark, [(1, None)]) == []


def test_decomposition_keeps_all_grams_but_the_bound():
    r = random.Random(10)
    frequent = {"".join(r.choice("abc") for _ in range(r.choice([2, 3]))) for _ in range(14)} | {"^a", "^b"}
    frequent |= {g[:2] for g in frequent}
    for _ in range(3000):
        w = "".join(r.choice("abc") for _ in range(r.randint(5, 9)))
        i, kind = r.randrange(len(w)), r.choice("dirs")
        v = {"d": w[:i] + w[i + 1:], "i": w[:i] + r.choice("abc") + w[i:], "r": w[:i] + r.choice("abc") + w[i + 1:], "s": w + r.choice("abc")}[kind]
        (g, b), (h, c) = (spelling_variants.decompose(x, frequent) for x in (w, v))
        assert len(g) - b >= 2
        assert sum((Counter(g) & Counter(h)).values()) >= max(len(g) - b, len(h) - c)
