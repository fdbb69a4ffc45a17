"""Source mixing: targets, copies, whole results."""

import random
from collections import defaultdict

import pytest

from pinprice.llm import source_mixing as M


def reshared(sizes, cap=3):
    """Targets by the definition: share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free and left > 1e-9:
        total, over = sum(weight[s] for s in free), 0.0
        for s in list(free):
            target[s] += left * weight[s] / total
            if target[s] >= cap * sizes[s]:
                over += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                free.discard(s)
        left = over
    return target


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, copies string")
    return df, M.mix(df, **options).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_words_taken(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(3000):
        s = rnd.choice(["a", "b", "B", "é", None, "z"] + ["hot"] * 5)
        rows.append((i, s, " ".join(["w"] * rnd.randint(0, 40)), None, "x"))
    rows += [(9000 + i, "tiny", "w w", 1, None) for i in range(2)]
    df, got = run(spark, rows)
    words = defaultdict(int)
    for i, s, t, *_ in rows:
        words[s] += len(t.split())
    want, taken = reshared(words), defaultdict(int)
    for r in got:
        assert r["size"] == len(r["text"].split()) and 0 <= r["copies"] <= 3
        assert r["source_size"] == words[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["copies"] * r["size"]
    for s in words:
        assert abs(taken[s] - want[s]) <= 45
    assert len(got) == len(rows)
    again = {r["doc_id"]: r["copies"] for r in M.mix(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in got}


def test_a_third_of_equal_documents_is_spread(spark):
    rows = [(i, "hot", "same words here", None, None) for i in range(500)] + [(600, "cold", "w " * 4000, None, None)]
    _, got = run(spark, rows)
    hot = [r["copies"] for r in got if r["source"] == "hot"]
    assert abs(sum(hot) - 500 * got[0]["target"] / got[0]["source_size"]) <= 1 or len(set(hot)) <= 2


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "", None, None), (1, "a", "x", None, None), (1, "a", "x", None, None)]
    df, got = run(spark, rows)
    assert len(got) == 4 and all(r["copies"] <= 3 for r in got)
    assert sum(r["copies"] * r["size"] for r in got) == 2
    assert run(spark, rows[:2])[1][0]["target"] == 0.0
    assert run(spark, [])[1] == []
    assert M.emit(df).columns == df.columns and M.emit(df).count() == 2


def test_emit_returns_columns_named_like_its_own(spark):
    rows = [(i, "w " * (i + 1), "ab"[i % 2], f"S{i}", i, f"T{i}", -i, f"r{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target int, source_size string, "
                                     "copies int, row string")
    times = {r["doc_id"]: r["copies"] for r in M.mix(df).collect()}
    out = M.emit(df).collect()
    assert list(out[0].asDict()) == df.columns
    assert sorted(map(tuple, out)) == sorted(r for r in rows for _ in range(times[r[0]]))
