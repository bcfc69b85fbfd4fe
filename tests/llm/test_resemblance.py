import random

import numpy as np
import pytest

from wordloom.llm import resemblance, simhash


def _exact(a, b):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    x, y = grams(a or ""), grams(b or "")
    return len(x & y) / len(x | y) if x and y else 0.0


def _components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def _edited(rng, words, share):
    return [f"x{rng.random()}" if rng.random() < share else w for w in words]


def _fp(text):
    words = (text or "").encode().lower().split()
    return simhash.folded(resemblance.shingles(words))


def _partition(of):
    sets = {}
    for i, c in of.items():
        sets.setdefault(c, set()).add(i)
    return sorted(map(sorted, sets.values()))


def _brute(texts):
    n, fps = range(len(texts)), [_fp(t) for t in texts]
    links = [(i, j) for i in n for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2 or _exact(texts[i], texts[j]) >= 0.8]
    return _partition(_components(n, links))


def _found(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    rows = resemblance.groups(docs, **options).collect()
    assert len(rows) == len(texts)
    return _partition({r.id: r.component for r in rows})


@pytest.mark.parametrize("options", [{}, {"block": 5}, {"heavy": 900}])
def test_components_match_brute_force(spark, options):
    rng = random.Random(3)
    texts = [None, "", " ", "one two", "One  TWO", "one two three"]
    for n in (40, 120, 300, 2500):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts += [" ".join(base)] * 2 + [" ".join(_edited(rng, base, s)) for s in (0.005, 0.01, 0.015, 0.03, 0.05, 0.3) for _ in range(4)]
        texts += [" ".join(base[: n // 2] + [f"v{rng.random()}" for _ in range(n)])]
    assert _found(spark, texts, **options) == _brute(texts)


def test_chains_around_the_limit_match_brute_force(spark):
    """Many texts of one origin whose similarities lie on both sides of 0.8, in groups smaller than the bucket."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(_edited(rng, base, rng.choice([0.01, 0.02, 0.03]))) for _ in range(90)]
    want = _brute(texts)
    assert len(want) > 5
    assert _found(spark, texts) == want
    assert _found(spark, texts, block=16) == want


def test_long_texts_are_compared_whole(spark):
    rng = random.Random(9)
    texts = []
    for n, target in [(2000 + 300 * k, 0.788 + 0.004 * k) for k in range(7)] * 2:
        base = [f"w{rng.random()}" for _ in range(n)]
        changed, at = list(base), list(range(2, n, 7))
        rng.shuffle(at)
        while _exact(" ".join(base), " ".join(changed)) > target:
            for _ in range(5):
                changed[at.pop()] = f"x{rng.random()}"
        texts += [" ".join(base), " ".join(changed)]
    want = _brute(texts)
    assert len(texts) // 2 < len(want) < len(texts) - 1
    assert _found(spark, texts) == want


def test_a_group_joins_labels_by_a_forest():
    own = [np.arange(k, k + 50, dtype=np.uint64) for k in (0, 1, 2, 3, 100, 101)]
    low = np.array([np.frombuffer(resemblance.sketch(s)[0], dtype=np.uint8) for s in own])
    edges = resemblance.joined(np.array([5, 6, 7, 5, 9, 1]), low, own)
    assert len(edges) == 3
    assert _partition(_components([1, 5, 6, 7, 9], edges)) == [[1, 9], [5, 6, 7]]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = resemblance.groups(docs)
    assert found.count() == 0 and resemblance.firsts(docs, found).count() == 0
