"""Operator 8 packs every group as plain best-fit-decreasing does, at any size of the table."""

from __future__ import annotations

import random
import zlib

import pytest

from marketspark.llm import sharding


def plain(sizes, bins):
    """Bin of each item of falling size: one item at a time into the fullest bin that holds it, the least capacity that suffices."""
    out, first, rest = {}, 0, sum(sizes)
    at = 0
    while at < len(sizes) and bins - first > 1 and sizes[at] * (bins - first) > rest:
        out[at], rest, first, at = first, rest - sizes[at], first + 1, at + 1

    def fits(capacity):
        room, found = [], {}
        for i in range(at, len(sizes)):
            held = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
            if not held and (len(room) == bins - first or sizes[i] > capacity):
                return None
            if not held:
                room.append(capacity)
                held = [(capacity, len(room) - 1)]
            b = min(held)[1]
            room[b] -= sizes[i]
            found[i] = first + b
        return found

    if at < len(sizes):
        least = max(sizes[at], -(-rest // (bins - first)))
        step, slack, low = sharding.PRECISION, 0.0, 0.0
        while (found := fits(int(least * (1 + slack)))) is None:
            low, slack, step = slack, slack + step, step * 2
        while slack - low > sharding.PRECISION:
            middle = (low + slack) / 2
            better = fits(int(least * (1 + middle)))
            low, slack, found = (low, middle, better) if better is not None else (middle, slack, found)
        out.update(found)
    return [out[i] for i in range(len(sizes))]


def test_runs_equal_items_one_by_one():
    r = random.Random(51)
    for _ in range(300):
        sizes = sorted((r.choice([16, 17, r.randint(16, 60), r.randint(16, 3000)]) for _ in range(r.randint(1, 160))), reverse=True)
        bins = r.randint(1, 9)
        distinct = sorted(set(sizes), reverse=True)
        runs = sharding.pack(distinct, [sizes.count(s) for s in distinct], bins)
        assert [b for of in runs for n, b in of for _ in range(n)] == plain(sizes, bins)


@pytest.mark.parametrize("n", [150, 3000])
def test_shards_are_those_of_plain_best_fit(spark, n):
    r = random.Random(n)
    texts = [None, None, "", ""] + ["".join(r.choice("abé") for _ in range(r.choice([1, 2, 3, 30, r.randint(1, 400)]))) for _ in range(n)]
    texts += [texts[9]] * 40 + [texts[-1]] * 3
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x for x in sharding.shard(d, 7).collect()}
    size = {}
    for t in texts:
        size[t] = size.get(t, 0) + len((t or "").encode()) + 16
    digest = {r.text: r.digest for r in d.selectExpr("text", "coalesce(sha2(text, 256), 'null') AS digest").distinct().collect()}
    order = sorted(size, key=lambda t: (-size[t], digest[t]))
    want = dict(zip(order, plain([size[t] for t in order], 7), strict=True))
    assert {i: x.shard for i, x in got.items()} == {i: want[t] for i, t in enumerate(texts)}
    assert all(got[i].text_crc32 == zlib.crc32((t or "").encode()) for i, t in enumerate(texts))
    for s in range(7):
        assert sorted(x.slot for x in got.values() if x.shard == s) == list(range(sum(x.shard == s for x in got.values())))
