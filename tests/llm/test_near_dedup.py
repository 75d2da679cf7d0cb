"""The near-duplicate stage against brute force: families in blocks, recall, odd columns."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import LOREM, SPACED, low


def shingles(text, k=5):
    words = SPACED.findall(low(text))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def like(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def variants():
    """Variants of one text, from hardly to much changed; some are connected only through others."""
    rnd = random.Random(11)
    base = [rnd.choice(LOREM) + str(rnd.randrange(99)) for _ in range(160)]
    texts = []
    for n in range(240):
        own = list(base)
        for at in rnd.sample(range(160), rnd.randrange(1, 9)):
            own[at] = f"v{rnd.randrange(12)}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("block", [1 << 19, 8000, 1500])
def test_families_in_blocks_lose_no_link(spark, variants, block):
    from lumenstack.llm.simhash import keep_one_each

    sets = [shingles(t) for t in variants]
    want = groups(len(sets), [(i, j) for i, j in combinations(range(len(sets)), 2) if like(sets[i], sets[j])])
    docs = spark.createDataFrame(list(enumerate(variants)), "doc_id bigint, text string")
    assert 3 < len(set(want)) < 200
    assert sorted(r.doc_id for r in keep_one_each(docs, block=block).collect()) == sorted(set(want))


def test_many_texts_of_one_bag_of_words(spark):
    """Equal fingerprints in great number, hardly a shingle in common: nothing goes."""
    from lumenstack.llm.simhash import keep_one_each

    rnd, words = random.Random(3), [w + str(i) for i, w in enumerate(LOREM * 2)]
    texts = [" ".join(rnd.sample(words, len(words))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert keep_one_each(docs, block=12_000).count() == 1500


def test_recall_on_the_test_table(spark):
    """Of the pairs of different texts at 0.8 or more by brute force, 0.9 or more are separated; no pair below is, but through others."""
    from lumenstack.llm.simhash import keep_one_each

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    first = {t: i for i, t in reversed(rows)}
    sets = {i: shingles(t) for t, i in first.items()}
    held = {}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(i)
    near = {(i, j) for own in held.values() if len(own) > 1 for i, j in combinations(sorted(own), 2)}
    near = {(i, j) for i, j in near if like(sets[i], sets[j])}
    kept = {r.doc_id for r in keep_one_each(docs).select("doc_id").collect()}
    assert near and sum(not (i in kept and j in kept) for i, j in near) >= 0.9 * len(near)
    linked = {i for pair in near for i in pair}
    assert all(i in kept for i in sets if i not in linked and sets[i])


def test_odd_columns_and_rows(spark):
    from lumenstack.llm.simhash import keep_one_each

    schema = "doc_id string, text string, _hash bigint, _row int, _n int, _id int, _score double, row int, fp int, key int, family int, blocks int, m map<string,int>"
    same = ("a b c d e f g h", 77, 1, 5, 2, 0.5, 3, 4, 6, 7, 8, {"x": 1})
    rows = [("b", *same), ("a", *same), ("a", *same), (None, *same), (None, None, *same[1:]), ("z", "", *same[1:]), (None, "q w e r t y u i", *same[1:])]
    docs = spark.createDataFrame(rows, schema)
    got = keep_one_each(docs)
    assert got.schema == docs.schema
    assert sorted((str(r.doc_id), r.text or "", r["_hash"], r["_n"], r.m["x"]) for r in got.collect()) == [("None", "q w e r t y u i", 77, 5, 1), ("a", same[0], 77, 5, 1), ("z", "", 77, 5, 1)]
    assert keep_one_each(docs.where(F.lit(False))).count() == 0
