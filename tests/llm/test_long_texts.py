"""Long texts of few different characters: right results in bounded time and memory."""

from __future__ import annotations

import random
import re
import time
import tracemalloc

import numpy as np
import pytest

from marketspark.llm import decontaminate, pii, secret_ledger


@pytest.fixture
def bounded():
    """Under 5 seconds and 1 GB (of what Python and numpy allocate); tracing slows the rest down, so twice the time is given."""
    tracemalloc.start()
    began = time.process_time()
    yield
    used, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert used < 10 and peak < 1e9, (used, peak)


def test_address_parts_of_any_length(bounded):
    zeros = "0" * 5_000
    assert pii.base_spans(f"v 1.2.3.{zeros} and 1.2.3.{zeros}7") == [("ip", 2, 8 + 5_000), ("ip", 8 + 5_000 + 5, 8 + 5_000 + 5 + 6 + 5_001)]
    assert pii.base_spans("1.2.3." + "9" * 6_000) == [] == pii.base_spans("256.1.1.1") and len(pii.base_spans("0255.1.1.000")) == 1


def tokens_by_hand(text):
    return [m.span() for m in re.finditer(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", text)]


def web_tokens(text):
    rules = [r for r in secret_ledger.RULES if r[0] == "web_token"]
    return [(a, b) for _, _, a, b in secret_ledger.scan_text(text, rules, [secret_ledger._compiled(r) for r in rules])]


def test_repeated_token_starts_are_scanned_once(bounded):
    text = "eyJ" * 1_000_000
    assert web_tokens(text) == []
    token = "." + "eyJ" * 5 + ".x-y_z"
    assert web_tokens(f"{text}{token} {text}") == [(0, len(text) + len(token))]


def test_tokens_equal_the_plain_rule():
    r = random.Random(41)
    parts = ["eyJ", "eyJabcdefgh", ".", ".", "a", "_-9", " ", "é", "eyJeyJeyJeyJ", "x" * 9]
    for _ in range(4_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 24)))
        assert web_tokens(text) == tokens_by_hand(text), text


def test_every_rule_is_fast_on_its_own_beginnings(bounded):
    rules = secret_ledger.RULES
    patterns = [secret_ledger._compiled(r) for r in rules]
    for unit in ("token ", "token", "AKIA", "deadbee", "-----BEGIN ", "-----BEGIN A", "ghp_", "glpat-", "password=\"", "eyJ.", "api_key:  "):
        secret_ledger.scan_text(unit * (200_000 // len(unit)), rules, patterns)


def retained_by_hand(block, points):
    """All (item, band) that reach the bound, from every pair of equal q-grams."""
    q, held = decontaminate.Q, {}
    for i, item in enumerate(block.points):
        step = int(block.step[i])
        grams = {}
        for o in range(len(item) - q + 1):
            grams.setdefault(item[o:o + q].tobytes(), []).append(o)
        for p in range(len(points) - q + 1):
            for o in grams.get(points[p:p + q].tobytes(), ()):
                band = (p - o) // step
                held.setdefault((i, band), set()).add(o)
                held.setdefault((i, band - 1), set()).add(o)
    return sorted(k for k, offsets in held.items() if len(offsets) >= block.bound[k[0]])


@pytest.mark.parametrize("places", [1 << 21, 50])
def test_bands_equal_all_pairs_of_grams(monkeypatch, places):
    monkeypatch.setattr(decontaminate, "PLACES", places)
    r = random.Random(42)
    for alphabet in ("=", "ab", "abcdefgh "):
        items = ["".join(r.choice(alphabet) for _ in range(r.choice([10, 12, 40, 130, 260]))) for _ in range(6)]
        items += ["=" * 64, "ab" * 30]
        block = decontaminate.Block(list(enumerate(items))).ready()
        for _ in range(6):
            text = "".join(r.choice([items[r.randrange(8)], "".join(r.choice(alphabet) for _ in range(30)), "=" * 40]) for _ in range(5))
            points = decontaminate.folded(text)
            assert [(i, b) for i, b in block.retained(points)] == retained_by_hand(block, points)


def test_a_rule_line_in_an_item_and_in_long_texts(bounded):
    block = decontaminate.Block([(1, "=" * 400), (2, "a question with == in it " * 8), (3, "-" * 50)]).ready()
    found = block.search(decontaminate.folded("=" * 1_000_000))
    assert {f[0] for f in found} == {1} and found[0][1:] == (0, 400, 0)
    ends = np.array([(a, b) for _, a, b, _ in found])
    assert (ends[1:, 0] >= ends[:-1, 1]).all() and len(ends) > 2_000  # regions do not overlap and fill the text
    assert block.search(decontaminate.folded("=" * 300 + "x" * 300)) == []


# ------------------------------------------------------------------- the added spans of operator 4

def test_disguised_spans_are_missed_by_the_rules():
    r = np.random.RandomState(43)
    samples = {"email": "jo.doe+x@mail.example.org", "ip": "10.0.255.7", "card": "4111 1111 1111 1111", "phone": "+49 170 123 4567"}
    for kind, s in samples.items():
        for _ in range(200):
            form = pii.disguise(kind, s, r)
            assert pii.passes(kind, form) and (kind, 5, 5 + len(form)) not in pii.base_spans(f"call {form} now")
    text, spans = pii.disguised("a jo@x.org, 1.2.3.4 and jo@x.org", r)
    assert [k for k, _, _ in spans] == ["email", "ip", "email"] and all(pii.passes(k, text[a:b]) for k, a, b in spans)


def test_the_model_finds_held_out_spans_that_the_rules_miss():
    import pyarrow.dataset as ds

    table = ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    texts = {x["doc_id"]: x["text"] for x in table if x["text"]}
    fit = [t for i, t in sorted(texts.items()) if i % 2 == 0 and len(t) < pii.SAMPLE_CHARS]
    marked = [t for t in fit if pii.base_spans(t)][:pii.SAMPLE_DOCS]
    tagger = pii.Tagger().fit(marked + [t for t in fit if not pii.base_spans(t)][:pii.PLAIN_DOCS])
    held = [t for i, t in sorted(texts.items()) if i % 2]
    made = [pii.disguised(t, np.random.RandomState(i)) for i, t in enumerate(held)]
    total = hit = false = 0
    for (_, spans), (base, every) in zip(made, pii.all_spans([t for t, _ in made], tagger), strict=True):
        added = [s for s in every if s not in base]
        total += len(spans)
        hit += sum(any(k == kind and a - 2 <= x and y <= b + 2 and x < b and y > a for k, x, y in every) for kind, a, b in spans)
        false += sum(not any(x < b and y > a for _, a, b in spans) for _, x, y in added)
    assert total >= 25 and hit >= 0.75 * total and false <= 2, (total, hit, false)
    plain = pii.all_spans(held, tagger)
    assert [base for base, _ in plain] == [pii.base_spans(t) for t in held]
    assert sum(len(every) - len(base) for base, every in plain) <= 2  # texts as they are
