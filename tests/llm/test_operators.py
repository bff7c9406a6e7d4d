"""The operators against brute force on small fixtures, and their edge cases."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.llm import common, components, decontaminate, exact_dedup, language_id, near_dedup, piece_codec, pii, \
    secret_ledger, sharding, substring_dedup, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, run string, digest string, part int, found string"


def rows(*texts, start=0):
    return [(i + start, t, "en", "s", len(t or ""), "r", "d", 1, "f") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing column names."""
    long = "x" * 60_000 + " " + "word " * 4_000
    table = rows(None, "", " \t\n", long, "a b c", "a b c", "A  b\nc", "é ß 日本 🚀", "one two three four five six")
    table += [table[4], (None, "a b c", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(table, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "substring": substring_dedup.remove_repeats,
    "near": near_dedup.near_duplicates,
    "pii": pii.personal_data,
    "secrets": secret_ledger.secrets,
    "exact": exact_dedup.dedup,
    "shard": sharding.shard,
    "language": language_id.identify,
    "pieces": lambda d: piece_codec.encode_documents(d, public_tokenizers.path("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row_of_an_odd_table(name, odd, empty):
    assert OPERATORS[name](odd).count() == odd.count()
    assert OPERATORS[name](empty).count() == 0


# ------------------------------------------------------------------ 1: substrings

def test_chunks_are_whole_and_survive_an_insertion():
    r = random.Random(2)
    text = " ".join("".join(r.choice("abcdeéß") for _ in range(r.randint(2, 9))) for _ in range(2000))
    data = text.encode()
    ends = substring_dedup.chunk_ends(data).tolist()
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    parts = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    assert all(p.decode() for p in parts)  # no cut inside a character
    moved = ("an insertion " + text[:500] + " another one " + text[500:]).encode()
    ends = substring_dedup.chunk_ends(moved).tolist()
    after = {moved[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    assert sum(p in after for p in parts) > 0.95 * len(parts)
    assert max(np.diff(substring_dedup.chunk_ends(b"a" * 50_000))) <= substring_dedup.MAX_CHUNK


def test_repeated_passages_are_caught_and_clean_documents_left(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(55), text(8)
    planted = [f"{text(40)} {passage} {text(60)}" for _ in range(30)]
    clean = [f"{text(100)}\n{line}\n{text(30)}" for _ in range(30)]
    d = spark.createDataFrame(rows(*planted, *clean), SCHEMA)
    found = {r.doc_id: r for r in substring_dedup.shortened(d).collect()}
    assert set(found) == set(range(1, 30))  # the first document keeps the passage
    assert all(r.kept_in == [0] for r in found.values())
    middle = " ".join(passage.split()[20:35])
    assert all(middle not in r.text for r in found.values())
    kept = {r.doc_id: r.text for r in substring_dedup.remove_repeats(d).collect()}
    assert all(kept[30 + i] == t for i, t in enumerate(clean)) and kept[0] == planted[0]
    assert all(kept[i] == found[i].text for i in found)


def test_repeated_words_between_differing_texts_are_caught(spark):
    r = random.Random(15)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))
    table, long = [], {}
    for unit in ("the", "lorem ipsum", "日本", "x-", "seven letters or more"):
        for words in (300, 90):  # the second document holds less of it, then as much, then more
            stretch = " ".join([unit] * words)
            long[len(table)] = stretch
            table += [f"{text(30)} {stretch} {text(30)}", f"{text(31)} {stretch} {text(29)}"]
    d = spark.createDataFrame(rows(*table), SCHEMA)
    found = {r.doc_id: r for r in substring_dedup.shortened(d).collect()}
    assert set(found) == set(range(len(table))) - set(range(0, len(table), 4))
    for i, row in found.items():
        stretch = long[i - i % 2].encode()
        assert len(stretch) - 200 <= row.removed_bytes <= len(stretch) + 60
    short, more = f"{text(20)} {'the ' * 80}{text(20)}", f"{text(20)} {'the ' * 900}{text(20)}"
    cut = [r.removed_bytes for r in substring_dedup.shortened(spark.createDataFrame(rows(short, more), SCHEMA)).collect()]
    assert len(cut) == 1 and 150 < cut[0] <= 340  # no more than the first document holds


def test_passages_of_short_words_are_caught_whole(spark):
    r = random.Random(16)
    text = lambda n, a, b: " ".join("".join(r.choice("abcdefghijklmné") for _ in range(r.randint(a, b))) for _ in range(n))
    table, passages = [], []
    for _ in range(80):
        passages.append(text(51, 2, 4))
        table += [f"{text(30, 3, 8)} {passages[-1]} {text(30, 3, 8)}" for _ in range(2)]
    line = text(20, 3, 8)
    table += [f"{text(40, 3, 8)}\n{line}\n{text(40, 3, 8)}" for _ in range(2)]  # 20 words stay
    d = spark.createDataFrame(rows(*table), SCHEMA)
    found = {r.doc_id: r for r in substring_dedup.shortened(d).collect()}
    assert set(found) == set(range(1, 160, 2))
    for i, row in found.items():
        data, (span,) = table[i].encode(), row.spans
        a = data.index(passages[i // 2].encode())
        assert a - 8 <= span.start <= a and a + len(passages[i // 2].encode()) <= span.end <= a + len(passages[i // 2].encode()) + 8
        assert data[span.start:span.end] in table[i - 1].encode() and row.kept_in == [i - 1]
        assert row.text.encode() == data[:span.start] + data[span.end:]
    stays = {r.doc_id: r.text for r in substring_dedup.remove_repeats(d).collect()}
    assert all(stays[i] == (found[i].text if i in found else t) for i, t in enumerate(table))


# -------------------------------------------------------------- 2: token files

def test_token_files_against_the_library(spark, docs, texts, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path)
    for d, known in ((docs, texts), (odd, None)):
        folder = common.scratch_path(spark, "test-tokens")
        token_files.write_files(d, folder, path)
        got = token_files.read_digests(spark, folder).collect()
        ordered = d.orderBy("doc_id", "text").select("doc_id", "text").collect()
        start, want = 0, []
        for r in ordered:
            ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
            want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    one = token_files.read_document(spark, folder, 8)
    assert one == [library.encode("one two three four five six").ids + [1]]


def test_word_pieces_equal_whole_text_encoding():
    r = random.Random(1)
    encoder = token_files.WordEncoder(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    odd = ["".join(r.choice("aB'sé.É,1 \n<|>tre²½ªµ_-ĀΣ") for _ in range(40)) for _ in range(3000)]
    odd += ["a<|endoftext|>b <|EndOfText|>", "I'll don't we've'd", "é x y\x85z\x1c", "", "İI"]
    own = [np.frombuffer(x, "<u4").tolist() for x in encoder.batch(odd)]
    assert own == [e.ids for e in encoder.library.encode_batch(odd, add_special_tokens=False)]


def test_pieces_beside_wide_characters_equal_whole_text_encoding():
    r = random.Random(4)
    vocabulary = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()
    some = "aJ'sé.É,1 \n\t\r\v\f\x1c\x85\xa0<|>=`x×÷\u0301\u0307\u030c\u0338\u2019\u3000İſ日가ᄀ🚀"
    table = ["".join(r.choice(some[:n]) for _ in range(r.randint(0, 60))) for n in (27, len(some)) for _ in range(1500)]
    table += ["a" * 5_000 + "1," * 5_000, "İ'll don’t<|endoftext|>Don’t", "J\u030c a<\u0338b"]
    for kept in (100, 600_000):  # with the smaller one, pieces pass between the generations
        encoder = token_files.WordEncoder(vocabulary, max_pieces=kept)
        own = [np.frombuffer(x, "<u4").tolist() for i in range(0, len(table), 300) for x in encoder.batch(table[i:i + 300])]
        assert own == [e.ids for e in encoder.library.encode_batch(table, add_special_tokens=False)]
        assert max(map(len, encoder.memory)) <= encoder.max_piece_chars


def test_new_words_go_to_the_library_many_at_a_time():
    r = random.Random(8)
    words = list(dict.fromkeys("".join(r.choice("abcdefgéß") for _ in range(9)) for _ in range(4000)))
    encoder = token_files.WordEncoder(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    library, calls = encoder.library, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encoder.library = Counted()
    table = [" ".join(words[i:i + 40]) + ". " + " ".join(words[:40]) + "." for i in range(0, len(words), 40)]
    own = [np.frombuffer(x, "<u4").tolist() for x in encoder.batch(table)]
    assert own == [e.ids for e in library.encode_batch(table, add_special_tokens=False)]
    assert len(calls) < len(words) // 50


# ---------------------------------------------------------------- 3: near dedup

def brute_components(texts: dict[int, str], share=85) -> tuple[dict[int, int], dict[int, int]]:
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= share * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def test_near_dedup_against_all_pairs(spark):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(3000)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([3, 12, 60, 300]))] for _ in range(25)]
    table = []
    for b in base:
        for _ in range(r.randint(1, 12)):
            w = list(b)
            for _ in range(r.choice([0, 1, 1, 2, len(w) // 40])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            table.append(" ".join(w) if r.random() < 0.7 else "\n".join(w).title())
    table += ["", None, " \n"]
    r.shuffle(table)
    known = dict(enumerate(table))
    component, size = brute_components(known)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows(*table), SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == component
    assert {r.doc_id: r.n_shingles for r in got} == size
    assert all(r.kept == (r.doc_id == component[r.doc_id]) for r in got)


def test_a_large_group_of_near_copies_is_not_paired_in_full(spark):
    r = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    table = []
    for i in range(600):  # each differs from the base in one word; two of them in two
        w = list(base)
        w[r.randrange(200)] = f"n{i}"
        table.append(" ".join(w))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows(*table), SCHEMA))
    component, _ = brute_components(dict(enumerate(table)))
    assert {r.doc_id: r.component_id for r in got.collect()} == component


def test_near_links_from_the_share_given(spark):
    import corpus_pipeline

    table = []
    for g, changed in enumerate((2, 7, 10, 12, 20)):  # last words that the copy has otherwise
        w = [f"g{g}w{i}" for i in range(104)]
        table += [" ".join(w), " ".join(w[:104 - changed] + [f"n{g}x{i}" for i in range(changed)])]
    d = spark.createDataFrame(rows(*table), SCHEMA)
    sets = [{tuple(t.split()[i:i + 5]) for i in range(100)} for t in table]
    same = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert any(0.8 <= x < 0.85 for x in same) and any(x < 0.8 for x in same) and any(x >= 0.85 for x in same)
    for share, left in ((80, near_dedup.drop_near_duplicates(d, 80)), (85, near_dedup.drop_near_duplicates(d)),
                        (corpus_pipeline.NEAR_SHARE, corpus_pipeline.near(spark, d, SF))):
        gone = {2 * i + 1 for i, x in enumerate(same) if x >= share / 100}
        assert {r.doc_id for r in left.collect()} == set(range(len(table))) - gone


def test_rows_of_one_id_are_kept_by_their_own_text(spark):
    words = [f"w{i}" for i in range(100)]
    a, close, b, c = " ".join(words), " ".join([*words[:99], "x"]), "another text without an id at all", "one more text of row five here"
    d = spark.createDataFrame([(1, a), (None, a), (None, b), (5, close), (5, c)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(d).collect()} == {(1, a), (None, b), (5, c)}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 150: 100}


# ------------------------------------------------------------------- 4: PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t: str) -> list[tuple[str, int, int]]:
    n = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(n(m)) <= 19 and pii.luhn(n(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(n(m)) <= 15]


def test_pii_base_spans(docs, texts):
    r = random.Random(3)
    noise = ["".join(r.choice("a@.1+-( )0 9") for _ in range(60)) for _ in range(5000)]
    noise += ["a@@b.c@d.e.f x@y@z.w", "1" * 9000, "a" * 9000, "x@" * 3000, "4111 1111 1111 1111 +49 30 12345678 1.2.3.4"]
    assert all(pii.base_spans(t) == brute_pii(t) for t in [*texts.values(), *noise])
    for row in pii.personal_data(docs).collect():
        want = brute_pii(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for x, _, _ in want) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(row.spans.split(","))  | {""}


def test_tagger_learns_and_skipping_windows_changes_nothing():
    r = random.Random(6)
    fill = lambda n: " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(n))
    made = lambda: r.choice([f"ann{r.randint(1, 99)}@mail.org", f"10.{r.randint(0, 255)}.7.{r.randint(0, 255)}",
                             f"+49 30 {r.randint(1000000, 9999999)}", "4111 1111 1111 1111"])
    corpus = [f"{fill(r.randint(3, 60))} {made()} {fill(r.randint(3, 60))} {made()} {fill(20)}" for _ in range(160)]
    tagger = pii.Tagger().fit(corpus[:120])
    held = corpus[120:]
    hit = total = 0
    for text, labels in zip(held, tagger.label(held), strict=True):
        for kind, a, b in pii.base_spans(text):
            total += b - a
            hit += int((labels[a:b] == 1 + pii.KINDS.index(kind)).sum())
    assert hit > 0.9 * total
    quick = tagger.spans(held)
    tagger.label = lambda t, label=tagger.label: label(t, every=True)
    assert tagger.spans(held) == quick


def test_crf_gradient_against_differences():
    r = np.random.RandomState(0)
    tagger = pii.Tagger()
    x = r.randint(0, pii.CLASSES, size=(6, 3)).astype(np.uint8)
    y = r.randint(0, pii.LABELS, size=(6, 3)).astype(np.uint8)
    tagger.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    _, grads = tagger.gradient(x, y)
    for k in ("trans", "bias", "outf"):
        at = tuple(0 for _ in tagger.w[k].shape)
        step = 1e-3
        tagger.w[k][at] += step
        high, _ = tagger.gradient(x, y)
        tagger.w[k][at] -= 2 * step
        low, _ = tagger.gradient(x, y)
        tagger.w[k][at] += step
        assert abs((high - low) / (2 * step) - grads[k][at]) < 1e-3


# --------------------------------------------------------------- 5: ledger

def brute_secrets(t: str) -> list[tuple[int, int, str, int]]:
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() and False else c for c in "")
    words = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token"))
    key = "[aA][pP][iI]_?[kK][eE][yY]"
    assign = re.compile(rf"""({words}|{key}{either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_and_unseen_pairs(spark, docs, texts):
    made = ["ToKen = 'abcdefgh12'", "Password:short", "AKIAABCDEFGHIJKL12", "deadbeef" * 4 + " é api_key=12345678", "toKen=12345678"]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    known = texts | {10_000 + i: t for i, t in enumerate(made)}
    folder = common.scratch_path(spark, "test-ledger")
    ledger = secret_ledger.Ledger(spark, folder, secret_ledger.RULES[:3])
    for r in secret_ledger.secrets(d, ledger).collect():
        want = ",".join(f"{k}:{a}:{b}" for a, _, k, b in brute_secrets(known[r.doc_id]))
        assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    blobs = len(set(known.values()))
    assert ledger.scans().count() == blobs
    assert ledger.add(d).count() == 0  # nothing is unseen
    more = secret_ledger.Ledger(spark, folder, [*secret_ledger.RULES[:3], ("prefixed", 1, "ghp_[a-z]{4,}", 1, 0)])
    again = more.add(d).collect()
    assert len(again) == blobs and all(r.rules == ["prefixed@1"] for r in again)
    new = spark.createDataFrame([(1, "a ghp_abcd"), (2, "a ghp_abcd"), (3, made[0])], "doc_id long, text string")
    assert [sorted(r.rules) for r in more.add(new).collect()] == [["access@1", "assign@1", "hex@1", "prefixed@1"]]
    assert {r.doc_id: len(r.found) for r in more.paths(new, ["doc_id"]).collect()} == {1: 1, 2: 1, 3: 1}


# -------------------------------------------------------- 6: decontamination

def test_decontamination_finds_edited_items_only(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 8)))
    items = [" ".join(word() for _ in range(30)) for _ in range(20)]
    bench = spark.createDataFrame([*enumerate(items), (90, ""), (91, None), (92, "short")], "item_id long, text string")
    block = decontaminate.Block(list(enumerate(items))).ready()
    table, want = [], set()
    for i, item in enumerate(items):
        t, k = list(item), int(block.budget[i])
        n = r.choice([0, 1, k, 3 * k + 8])
        for p in r.sample(range(5, len(t) - 5), n):
            t[p] = "#"
        table.append(f"{' '.join(word() for _ in range(20))} {''.join(t).upper()}\n{word()}")
        if n <= k:
            want.add((i, i))
    table += ["short", "a short text", None, "", " ".join(word() for _ in range(300))]
    want.add((20, 92))
    d = spark.createDataFrame(rows(*table), SCHEMA)
    got = decontaminate.contaminated(d, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    for r in got:
        if r.item_id < 20 and r.edits == 0:
            assert table[r.doc_id][r.start:r.end].lower() == items[r.item_id]
    left = decontaminate.drop_contaminated(d, bench)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == set(range(len(table))) - {a for a, _ in want}
    assert decontaminate.contaminated(d, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(d.limit(0), bench).count() == 0


def test_benchmark_in_many_blocks_finds_the_same(spark, monkeypatch):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 8)))
    items = [" ".join(word() for _ in range(r.randint(3, 30))) for _ in range(24)]
    bench = spark.createDataFrame([*enumerate(items), (3, items[3]), (70, items[5]), (71, "x y"), (None, items[2]), (72, None)],
                                  "item_id long, text string")
    table = [f"{word()} {items[i]} {word()} {items[j]}" for i, j in zip(range(0, 24, 2), range(23, 0, -3))]
    d = spark.createDataFrame(rows(*table, "x y", "nothing of it", None, ""), SCHEMA).withColumn("item_id", F.lit("clash"))
    whole = sorted(tuple(x) for x in decontaminate.contaminated(d, bench).collect())
    left = sorted(tuple(map(str, x)) for x in decontaminate.drop_contaminated(d, bench).collect())
    want = {(doc, i) for doc, t in enumerate(table) for i, item in [*enumerate(items), (70, items[5])] if item in t}
    assert want <= {x[:2] for x in whole} and len(left) == 3
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", sum(map(len, items)) // 4)
    held = list(decontaminate.item_blocks(bench))
    assert len(held) > 3 and [last for _, last in held] == [False] * (len(held) - 1) + [True]
    assert sum(len(b.ids) + len(b.short) for b, _ in held) == len(items) + 3
    assert sorted(tuple(x) for x in decontaminate.contaminated(d, bench).collect()) == whole
    assert sorted(tuple(map(str, x)) for x in decontaminate.drop_contaminated(d, bench).collect()) == left


def test_alignment_against_full_table():
    def full(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i] + [0] * len(text)
            for j, e in enumerate(text, 1):
                new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != e))
            row = new
        return min(row)

    r = random.Random(12)
    item = " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(25))
    block = decontaminate.Block([(1, item)]).ready()
    for _ in range(40):
        t = list(item)
        for _ in range(r.randint(0, int(block.budget[0]) + 2)):
            p = r.randrange(len(t))
            t[p:p + r.randint(0, 1)] = r.choice(["", "z", "y"])
        text = "lorem ipsum " * r.randint(0, 3) + "".join(t) + " dolor" * r.randint(0, 3)
        got, edits = block.search(decontaminate.folded(text)), full(item, text)
        assert bool(got) == (edits <= int(block.budget[0])) and (not got or got[0][3] == edits)


# ------------------------------------------------------------ 7: exact dedup

def test_exact_dedup(spark, odd):
    got = exact_dedup.dedup(odd).collect()
    groups: dict[str, list] = {}
    for r in odd.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append(r)
    for plain, members in groups.items():
        best = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        sha = hashlib.sha256(plain.encode()).hexdigest()
        own = [r for r in got if r.text_sha256 == sha]
        assert len(own) == len(members) and all(r.group_size == len(members) and r.keep_id == best.doc_id for r in own)
        assert [r.doc_id for r in own if r.kept] == [best.doc_id]
    left = exact_dedup.drop_duplicates(odd)
    assert left.columns == odd.columns and left.count() == len(groups)


def test_exact_dedup_main_path_is_native(docs):
    plan = exact_dedup.dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------ 8: shards

def test_best_fit_uses_the_tightest_bin():
    assert sharding.best_fit_decreasing([6, 5, 4, 4, 1], 10, 2) == [0, 1, 0, 1, 1]
    assert sharding.best_fit_decreasing([6, 6, 6], 10, 2) is None
    r, tree, plain = random.Random(1), sharding.CapacityTree(), set()
    for _ in range(3000):
        if plain and r.random() < 0.45:
            key = r.choice(sorted(plain))
            tree.remove(key)
            plain.discard(key)
        else:
            key = (r.randint(0, 400), r.randint(0, 9))
            if key not in plain:
                tree.insert(key)
                plain.add(key)
        size = r.randint(0, 420)
        assert tree.tightest(size) == min((k for k in plain if k[0] >= size), default=None)


def test_shards_keep_groups_and_are_near_equal(spark, docs):
    hot = spark.createDataFrame(rows(*["the same text"] * 50, start=50_000), SCHEMA)
    d = docs.select("doc_id", "text").unionByName(hot.select("doc_id", "text"))
    got = sharding.shard(d, 8).join(d, "doc_id").collect()
    assert len(got) == d.count()
    shards: dict[int, list] = {}
    home: dict[str, set] = {}
    for r in got:
        assert r.size == len(r.text.encode()) + 16 and r.text_crc32 == zlib.crc32(r.text.encode())
        shards.setdefault(r.shard, []).append(r)
        home.setdefault(r.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in home.values()) and set(shards) == set(range(8))
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    sizes = [sum(r.size for r in s) for s in shards.values()]
    assert max(sizes) < 1.2 * min(sizes)


# ---------------------------------------------------------------- 9: language

def test_suffix_automaton_knows_every_substring():
    r = random.Random(3)
    s = [r.randint(0, 3) for _ in range(120)]
    edges = language_id.suffix_automaton(s)

    def known(part):
        state = 0
        for c in part:
            if c not in edges[state]:
                return False
            state = edges[state][c]
        return True

    inside = {tuple(s[a:b]) for a in range(120) for b in range(a + 1, min(121, a + 8))}
    assert all(known(p) for p in inside)
    assert all(known(p) == (tuple(p) in inside) for p in ([r.randint(0, 3) for _ in range(r.randint(1, 7))] for _ in range(500)))


def brute_phrases(text: str, corpus: str) -> int:
    n, at = 0, 0
    while at < len(text):
        length = 1
        while at + length < len(text) and text[at:at + length + 1] in corpus:
            length += 1
        n, at = n + 1, at + (length if text[at:at + length] in corpus else 1)
    return n


def test_phrase_counts_against_search():
    train = {"a": ["the cat sat on the mat and the dog ran"], "b": ["el gato y el perro en la casa"]}
    parser = language_id.CrossParser(train).ready()
    for text in ("the dog sat", "el perro", "zzz the", "cat"):
        counts, lettered = parser.phrases([text])
        assert lettered[0]
        assert counts[0].tolist() == [brute_phrases(text, train[k][0] + " ") for k in ("a", "b")]


def test_language_of_held_out_documents(docs):
    got = language_id.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and len(r.text) > 100]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_a_language_of_long_texts_alone_is_learnt(spark):
    long = lambda words: " ".join([words] * (language_id.TRAIN_CHARS // len(words) + 2))
    table = [(i, "the cat sat on the mat and the dog ran", "en") for i in range(8)]
    table += [(i, long("el gato y el perro en la casa"), "es") for i in range(8, 16)]
    d = spark.createDataFrame(table, "doc_id long, text string, lang string")
    parser = language_id.train(d)
    assert parser.languages == ["en", "es"]
    assert {r.doc_id: r.lang_pred for r in language_id.identify(d, parser).collect()} == {i: lang for i, _, lang in table}


def test_no_letters_is_undetermined(spark, docs):
    parser = language_id.train(docs)
    d = spark.createDataFrame(rows(None, "", "123 ... 45", "the of and the"), SCHEMA)
    got = [r.lang_pred for r in language_id.identify(d, parser).orderBy("doc_id").collect()]
    assert got[:3] == ["und"] * 3 and got[3] != "und"


# ------------------------------------------------------------------ 10: pieces

def test_pieces_against_the_library(docs, texts, spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec = piece_codec.PieceCodec(open(path, "rb").read(), max_units=50)
    made = ["", " ", "  a  b\n\tc \x00 é 🚀", "▁a ▁", "a▁ b", " " * 40, "x" * 500, "\n", " ́e<s></s><0x41>", "日本語 テスト" * 5, "aé" * 40 + "\x00\x01" * 20]
    every = [*texts.values(), *made]
    ids = codec.library.encode(every)
    decoded = codec.library.decode(ids)
    assert list(codec.batch(every)) == [(",".join(map(str, i)), d) for i, d in zip(ids, decoded, strict=True)]
    assert [codec.encode(t) for t in made] == ids[len(texts):]
    assert [codec.decode(i) for i in ids] == decoded
    for r in piece_codec.encode_documents(docs, path).collect():
        i = codec.library.encode(texts[r.doc_id])
        assert r.n_tokens == len(i) and r.ids_sha256 == hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(codec.library.decode(i).encode()).hexdigest()
    d = spark.createDataFrame(rows(*made, None), SCHEMA).withColumn("ids", piece_codec.piece_ids(F.col("text"), path))
    back = [r.back for r in d.withColumn("back", piece_codec.piece_text(F.col("ids"), path)).orderBy("doc_id").collect()]
    assert back == [*decoded[len(texts):], ""]


def test_short_and_long_agendas_agree():
    r = random.Random(2)
    codec = piece_codec.PieceCodec(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    for _ in range(500):
        unit = "▁" * r.randint(0, 6) + "".join(r.choice("theringandé") for _ in range(r.randint(1, 20)))
        assert codec._short(unit) == codec._long(unit)


# ------------------------------------------------------------------- pipeline

def test_pipeline_against_brute_force(spark, docs, texts):
    import corpus_pipeline

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    kept = {d: t for d, t in texts.items() if any(c.isalpha() for c in t)}
    groups: dict[str, list[int]] = {}
    for d, t in kept.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append(d)
    kept = {d: texts[d] for d in (min(g, key=lambda d: (-len(texts[d]), d)) for g in groups.values())}
    component, _ = brute_components(kept, share=80)
    kept = {d: t for d, t in kept.items() if component[d] == d}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    fold = lambda t: re.sub(r"\s", " ", t.lower())
    clean = {d for d, t in kept.items() if not any(fold(b) in fold(t) for b in bench)}
    assert set(got) == clean


def test_pipeline_stages_keep_columns(spark, odd):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])
