"""Ranked lexical search against brute force, and NRA on lists."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from pinprice.llm import lexical_search as L

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counts = [Counter(terms(t)) for _, t, *_ in docs]
    n_docs, n_terms = sum(map(bool, counts)), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    asked = {}
    for i, text, *_ in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(text))
    out = []
    for i, want in asked.items():
        found = []
        for (d, *_), c in zip(docs, counts, strict=True):
            if not c:
                continue
            m = 10 + 90 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in want if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=lambda x: x[:2])


DOCS, ITEMS = "doc_id long, text string, rank int, score string, term string", "item_id long, text string, n int"


def run(spark, docs, items, **options):
    got = L.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=lambda x: x[:2])


@pytest.mark.parametrize("options", [dict(block_docs=7), dict(k=3, group_terms=10), {}])
def test_matches_brute_force(spark, options):
    rng = np.random.default_rng(2)
    words = ["the", "of", "Éa", "x1", "néw", "日本", "a_b", "don't", "U2", *[f"w{i}" for i in range(60)]]
    text = lambda n: " ".join(words[min(int(x), len(words) - 1)] for x in rng.exponential(9, n))
    docs = [(i, text(int(rng.integers(1, 60))), 0, "", "") for i in range(150)]
    docs += [(200 + i, docs[3][1], 0, None, "") for i in range(15)]                               # ties
    docs += [(7, docs[9][1], 0, "", ""), (None, docs[3][1], 0, "", ""), (None, docs[9][1], 0, "", "")]
    docs += [(300, None, 0, "", ""), (301, "", 0, "", ""), (302, " .,!\n\t-", 0, "", ""), (303, text(30_000), 0, "", ""),
             (304, "w1 " * 2000, 0, "", "")]
    items = [(i, text(int(rng.integers(1, 25))), 0) for i in range(12)]
    items += [(3, "日本 THE Of", 0), (20, None, 0), (21, "", 0), (22, "nowhere to be", 0), (None, "the", 0), (23, docs[3][1], 0)]
    k = options.get("k", 10)
    assert run(spark, docs, items, **options) == brute(docs, items, k)


def test_empty_tables_and_a_term_of_every_document(spark):
    assert run(spark, [], [(1, "a", 0)]) == [] and run(spark, [(1, "a", 0, "", "")], []) == []
    assert run(spark, [(1, None, 0, "", "")], [(1, "a", 0)]) == []
    docs = [(i, "a b" if i else "a", 0, "", "") for i in range(2000)]
    assert run(spark, docs, [(1, "A", 0)]) == brute(docs, [(1, "A", 0)])


def test_nra_gives_the_first_k_with_exact_scores():
    rng = np.random.default_rng(4)
    for trial in range(200):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        total, lists = np.zeros(n, np.int64), []
        for _ in range(int(rng.integers(1, 7))):
            d = rng.permutation(n)[:int(rng.integers(0, n + 1))]
            x = np.sort(rng.integers(1, 12, len(d)))[::-1]
            total[d] += x
            lists.append((d, x))
        want = [i for i in np.lexsort((np.arange(n), -total))[:k] if total[i] > 0]
        docs, scores = L.nra(lists, n, k, turn=2)
        assert list(docs) == want and list(scores) == list(total[want])
        floor = int(rng.integers(0, 30))
        docs, scores = L.nra(lists, n, k, floor, turn=1)
        assert [i for i in docs if total[i] >= floor] == [i for i in want if total[i] >= floor]
        assert list(scores) == list(total[docs])


def test_nra_stops_before_the_lists_end():
    """A floor above what unmet documents can reach ends the reading at once."""
    d, x = np.arange(100_000), np.arange(100_000, 0, -1)
    docs, scores = L.nra([(d, x)], 100_000, 3, turn=4)
    assert list(docs) == [0, 1, 2] and list(scores) == [100_000, 99_999, 99_998]
    assert not len(L.nra([(d, x)], 100_000, 3, floor=100_001)[0])
