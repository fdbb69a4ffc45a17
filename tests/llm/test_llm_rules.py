"""Quality rules: measurements against a plain model, bits, policies, ablations."""

import random
import re
from collections import Counter

import pytest

from pinprice.llm import quality_rules as Q


def naive(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often, inside = Counter(win), set()
    for i, w in enumerate(win):
        if often[w] > 1:
            inside |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside),
            len(lines))


def texts():
    rnd = random.Random(6)
    out = [None, "", " ", "\n\n", "a", "a b", "a a a", "a b c a b c", "x\x0by\x1cz w é", "# | <> $%&*" * 20, "l\nl\nl\n \nl",
           "same line here\n" * 40, "w " * 20_000]
    for _ in range(150):
        out.append("".join(rnd.choice(["a", "b", "cd", " ", " ", "\n", "é", "#"]) for _ in range(rnd.randint(0, 200))))
    return out


def test_measurements_equal_a_plain_model(spark):
    rows = [(i, t, i) for i, t in enumerate(texts())] + [(None, "a b c", 0), (0, "dup", 0), (0, "dup", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = Counter((r["doc_id"], *(r[m] for m in Q.MEASURES)) for r in Q.ledger(df).collect())
    assert got == Counter((i, *naive(t)) for i, t, _ in rows)
    assert Q.ledger(df.limit(0)).count() == 0


def test_bits_policies_and_ablations(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    rows = [(1, clean), (2, "few words"), (3, "same three words " * 40), (4, clean + " #" * 40), (5, (clean + "\n") * 5), (6, "z" * 90 + " " + clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    led = Q.ledger(df)
    bits = {r["doc_id"]: r["fail_bits"] for r in led.collect()}
    name = lambda b: {r.name for r in Q.RULES if b >> r.bit & 1}
    assert name(bits[1]) == set() and name(bits[2]) == {"few_words"} and "repeated_words" in name(bits[3])
    assert "symbol_share" in name(bits[4]) and {"repeated_lines", "repeated_words"} <= name(bits[5])
    policy = Q.POLICIES[Q.PRODUCTION]
    assert {r["doc_id"] for r in led.where(Q.passes(policy)).collect()} == {i for i, b in bits.items() if not b & policy.mask}
    table = {r["rule"]: (r["n_failed"], r["n_only"], r["n_docs"]) for r in Q.ablations(led, policy).collect()}
    for r in Q.RULES:
        if r.name in policy.rules:
            own = [b & policy.mask for b in bits.values()]
            assert table[r.name] == (sum(b >> r.bit & 1 for b in own), sum(b == 1 << r.bit for b in own), 6)
    assert len({r.bit for r in Q.RULES}) == len(Q.RULES)


def test_kept_rows_carry_their_columns(spark):
    clean = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, clean, 5, "x"), (2, "no", 6, "y"), (None, clean, None, None)],
                               "doc_id long, text string, fail_bits int, `odd name` string")
    got = Q.keep_documents(df, Q.POLICIES[Q.PRODUCTION])
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, clean, 5, "x"), (None, clean, None, None)], key=str)
    assert Q.keep_documents(df.limit(0), Q.BASE).count() == 0


@pytest.mark.parametrize("ids,want", [([1, 1, 1], 0), ([1, 1, 1, 1], 4), ([1, 2, 3, 9, 1, 2, 3], 6), ([], 0)])
def test_positions_in_repeated_windows(ids, want):
    import numpy as np

    assert Q.covered_by_repeats(np.array(ids, np.int64), 10, 3) == want
