"""Toxicity and language-model scores: held-out quality, exact counts, odd rows."""

import collections
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pinprice.llm import pitman_yor as Y
from pinprice.llm import toxicity as X
from pinprice.llm.common import crc32_mod
from pinprice.session import shared_dir

RND = random.Random(5)
VOCAB = ["".join(RND.choice("abcdefghijklmnoprstu") for _ in range(RND.randint(2, 8))) for _ in range(800)]
BAD = ["idiot", "scum", "zarblo", "zarblix", "vexuno"]


@pytest.fixture(scope="module")
def toxic_docs():
    docs, labels = [], []
    for i in range(600):
        words = [RND.choice(VOCAB) for _ in range(RND.randint(5, 80))]
        bad = i % 6 == 0
        if bad:
            for _ in range(RND.randint(1, 4)):
                words.insert(RND.randrange(len(words)), RND.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_toxicity(spark, toxic_docs):
    docs, labels = toxic_docs
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (None, "scum idiot"), (902, "x " * 30_000)], "doc_id long, text string")
    lb = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    held = crc32_mod(F.col("doc_id"), 4) == 2
    model = X.fit(df.where(~held), lb.where(~held))
    assert model.n_voters <= X.VOTERS + len(X.PATTERNS) + len(X.COUNTS)
    rows = X.score(df, model).collect()
    truth = dict(labels)
    out = [(r["score"], truth[r["doc_id"]]) for r in rows
           if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    p, q = (np.array([s for s, t in out if t == v]) for v in (1, 0))
    assert (p[:, None] > q[None]).mean() > 0.97
    assert (p >= 0.3).mean() > 0.9 and (q < 0.3).mean() > 0.95
    by = collections.Counter(r["doc_id"] for r in rows)
    assert len(rows) == 604 and max(by.values()) == 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert next(r for r in rows if r["doc_id"] is None)["predicted"] == 1
    assert next(r for r in rows if r["doc_id"] == 900)["score"] == next(r for r in rows if r["doc_id"] == 901)["score"] < 0.3


def test_toxicity_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "you idiot, scum"), (2, "fine words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.fit(df, none)
    got = {r["doc_id"]: r["score"] for r in X.score(df, model).collect()}
    assert got[1] > got[2]
    empty = df.limit(0)
    assert X.score(empty, X.fit(empty, none)).count() == 0


def naive_round(model, rows, m, start):
    """Expected sums row by row: P(toxic | votes) from the product of rates and pair factors, written out."""
    totals, pairs = np.zeros(2), {}
    for votes, mark, n in rows:
        v = [int(i in votes) for i in range(m)]
        if model is None:
            if start and mark is None:
                continue
            p = float(mark) if start else 0.9 if votes else 0.02
        else:
            like = []
            for y in (0, 1):
                x = model.prior if y else 1 - model.prior
                for i in range(m):
                    x *= model.rates[y, i] if v[i] else 1 - model.rates[y, i]
                for e, (i, j) in enumerate(model.edges):
                    a, b, both = model.rates[y, i], model.rates[y, j], model.joint[y, e]
                    cell = [[1 - a - b + both, b - both], [a - both, both]][v[i]][v[j]]
                    x *= cell / ((a if v[i] else 1 - a) * (b if v[j] else 1 - b))
                if mark is not None:
                    x *= X.LABEL_ODDS if mark == y else 1
                like.append(x)
            p = like[1] / sum(like)
            n = n if mark is not None or not start else n * X.UNLABELLED_WEIGHT
        totals += n * np.array([1 - p, p])
        for i in votes:
            for j in votes:
                if i <= j:
                    pairs[i, j] = pairs.get((i, j), 0) + n * np.array([1 - p, p])
    return totals, pairs


def label_rows(rng, n=600):
    """Votes of a hidden class: voters 0 and 1 repeat each other, 2 and 3 are independent, 4 never fires."""
    rows = []
    for _ in range(n):
        y = rng.random() < 0.3
        first = rng.random() < (0.7 if y else 0.1)
        v = [first, first if rng.random() < 0.9 else not first, rng.random() < (0.6 if y else 0.05), rng.random() < 0.2, False]
        rows.append((tuple(i for i in range(5) if v[i]), [None, int(y)][rng.random() < 0.3], 1))
    return rows


@pytest.mark.parametrize("labels", [True, False])
def test_label_model_against_a_walk_over_the_rows(spark, labels):
    rows = [(v, y if labels else None, n) for v, y, n in label_rows(np.random.default_rng(3))]
    df = spark.createDataFrame([(list(v), y, n) for v, y, n in rows], "votes array<int>, toxic int, n long")
    patterns = df.groupBy("votes", "toxic").sum("n").withColumnRenamed("sum(n)", "n").repartition(3)
    got = X.label_model(patterns, 5, labels, rounds=4)
    want = None
    for _ in range(4):
        new = X.maximised(*naive_round(want, rows, 5, labels), 5)
        still = want is not None and abs(new.rates - want.rates).max() + abs(new.prior - want.prior) < 1e-3
        want = new
        if still:
            break
    assert np.allclose(got.rates, want.rates) and np.allclose(got.prior, want.prior)
    assert got.edges.tolist() == want.edges.tolist() and np.allclose(got.joint, want.joint)
    if labels:
        assert [0, 1] in got.edges.tolist()          # the voters that repeat each other are a pair


def test_label_model_is_a_distribution_and_pairs_count_once():
    rows = [(v, y, n) for v, y, n in label_rows(np.random.default_rng(4), 3000) if y is not None]
    model = X.maximised(*naive_round(None, rows, 5, True), 5)
    every = np.array([[x >> i & 1 for i in range(5)] for x in range(32)], float)
    for y in (0, 1):
        const, w, u = model.factors(y)
        logs = const + every @ w + (every[:, model.edges[:, 0]] * every[:, model.edges[:, 1]]) @ u
        assert abs(np.exp(logs).sum() - 1) < 1e-6
    plain = X.LabelModel(model.prior, model.rates, np.zeros((0, 2), np.int64), np.zeros((2, 0)))
    one, both = np.array([[1, 0, 0, 0, 0.]]), np.array([[1, 1, 0, 0, 0.]])
    truth = np.log(np.mean([y for v, y, _ in rows if 0 in v and 1 in v and 2 not in v]) /
                   (1 - np.mean([y for v, y, _ in rows if 0 in v and 1 in v and 2 not in v])))
    assert abs(model.log_odds(both)[0] - truth) < abs(plain.log_odds(both)[0] - truth)
    assert plain.log_odds(both)[0] - plain.log_odds(one)[0] > model.log_odds(both)[0] - truth


def test_rare_terms_vote_and_every_training_row_counts(spark):
    """A word of twenty in six thousand toxic rows votes, however few rows fit the classifier."""
    docs = [(i, f"w{i % 50} {'grobnak' if i % 4 == 0 else 'fine'} {'zzyxo' if i % 1200 == 4 else ''}") for i in range(24_000)]
    labels = [(i, int(i % 4 == 0)) for i in range(24_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    model = X.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), labelled=500)
    assert "zzyxo" in model.words + model.prefixes or any("zzyxo".startswith(p) for p in model.prefixes)
    assert any(t.startswith("grob") for t in model.words + model.prefixes)


def test_toxicity_ignores_columns_named_like_its_own(spark):
    rows = [(i, "you idiot" if i % 2 else "fine", i % 2, f"v{i}", 1.0, i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, votes string, score double, id long")
    model = X.fit(df, df)
    out = X.score(df, model).collect()
    assert len(out) == 40 and all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in out)


# -- language model


@pytest.fixture(scope="module")
def scored(spark):
    docs = []
    for i in range(250):
        docs.append((i, ". ".join(" ".join(RND.choices(VOCAB[:60] if RND.random() < 0.7 else VOCAB, k=6)) for _ in range(RND.randint(0, 9)))))
    docs += [(300, None), (301, ""), (302, "Zzunseen " * 4000), (None, "abc The the"), (5, "repeated id"), (303, "x\x0bY z é")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return docs, Y.perplexity(df, crc32_mod(F.col("doc_id"), 5) != 1).collect()


def tokens(t):
    return [w for w in (t or "").encode().lower().split()] + [b"\n"]


def test_counts_and_base_scores_are_exact(scored):
    docs, rows = scored
    learned = [t for i, t in docs if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = collections.Counter(w for t in learned for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t in docs:
        w = tokens(t)
        base = sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[(i, len(w), sum(c[x] > 0 for x in w), n, round(base, 6))] += 1
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert got == want


def test_held_out_texts_are_likelier_than_under_the_base(scored):
    _, rows = scored
    held = [r for r in rows if not r["train"] and r["doc_id"] not in (302,)]
    assert len(held) > 20
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_probabilities_of_all_words_sum_to_one(spark):
    words = [(w.encode(), *RND.choices([0, 0, 1, 2, 9], k=Y.CONTEXTS)) for w in VOCAB[:300]] + [(b"\n", 5, 0, 0, 0, 1, 0, 0, 0)]
    words = [w for w in words if sum(w[1:])]
    ddl = "word binary, " + ", ".join(f"n{i} long" for i in range(Y.CONTEXTS))
    samples, n, v = Y.fit(spark.createDataFrame(words, ddl).coalesce(1))
    assert v == len(words) and n == sum(sum(w[1:]) for w in words) and len(samples) == Y.ROUNDS - 1
    for s in samples:
        counts = np.array([w[1:] for w in words])
        p = Y.spelled(Y._table_of(s.table), [w[0] for w in words])
        # whatever seating agrees with the totals of its round gives proper probabilities
        t, t1 = s.before.seat(counts, p, np.random.default_rng(1))
        after = Y.Seating(s.after.customers, tuple(t.sum(0).tolist()), int(t1.sum()), s.after.discount)
        known = after.context_p(counts, t, after.word_p(t.sum(1), t1, p))
        none = np.zeros((1, Y.CONTEXTS), np.int64)
        rest = after.context_p(none, none, after.word_p(np.zeros(1), np.zeros(1), np.array([1 - p.sum()])))
        assert np.allclose(known.sum(0) + rest[0], 1)


def test_spelling_contexts_are_proper():
    rng = np.random.default_rng(2)
    counts = (rng.random(Y.CELLS) < 0.02) * rng.integers(1, 50, Y.CELLS)
    p, doors = Y.reseat_subtree(counts, np.full(256, 1 / 256), [1, 2])
    assert np.allclose(p.sum(-1), 1) and doors.sum() > 0


def test_seating_bounds_and_repeats():
    rng = np.random.default_rng(1)
    c = np.array([0, 1, 2, 5, 100, 100_000])
    t = Y.seat(c, np.full(6, 0.01), np.full(6, 50), 0.7, 1.0, rng)
    assert (t <= c).all() and (t >= np.minimum(c, 1)).all() and t[-1] > t[3]
    again = Y.seat(c, np.full(6, 0.01), np.full(6, 50), 0.7, 1.0, np.random.default_rng(1))
    assert (again == Y.seat(c, np.full(6, 0.01), np.full(6, 50), 0.7, 1.0, np.random.default_rng(1))).all()


def test_word_order_counts(spark):
    docs = [(i, "alpha beta. gamma delta, omega zeta.") for i in range(40)] + [(100, "alpha beta. gamma delta, omega zeta."),
                                                                              (101, "zeta. omega delta, gamma beta. alpha")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in Y.perplexity(df, F.col("doc_id") < 100).collect()}
    assert got[100] > got[101]


def test_language_model_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = Y.perplexity(df, F.lit(False)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows] == [(0, 0, 0.0, 0.0)] * 2
    assert Y.perplexity(df.limit(0), F.lit(True)).count() == 0


def test_the_word_before_counts(spark):
    """Words before that share a class: only pairs of words tell the texts apart."""
    docs = [(i, f"we {'new york' if i % 2 else 'old barn'} is") for i in range(40)]
    docs += [(100, "we new york is"), (101, "we old york is"), (102, "we new barn is"), (103, "we old barn is")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in Y.perplexity(df, F.col("doc_id") < 100).collect()}
    assert min(got[100], got[103]) > max(got[101], got[102]) + 0.5


def test_pairs_of_all_texts_are_the_restaurants(spark):
    """Against plain counts of pairs: probabilities after a word sum to one, and the pairs that repeat are seated."""
    texts = [" ".join(RND.choices(VOCAB[:12], k=9)) for _ in range(30)]
    docs = list(enumerate(texts)) + [(1000, "")] + [(2000 + i, a) for i, a in enumerate(VOCAB[:12])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["score"] for r in Y.perplexity(df, F.col("doc_id") < 1000).collect()}
    assert all(np.isfinite(x) for x in got.values())
    count = collections.Counter(p for t in texts for p in zip(["", *t.split()], [*t.split(), "\n"], strict=True))
    # a text of one word: its probability after the start, and the end's after it
    assert sum(10 ** got[2000 + i] for i in range(12)) + 10 ** got[1000] < 1
    often, rare = max(VOCAB[:12], key=lambda a: (count["", a] + 1) * (count[a, "\n"] + 0.1)), min(
        VOCAB[:12], key=lambda a: (count["", a] + 1) * (count[a, "\n"] + 0.1))
    assert got[2000 + VOCAB.index(often)] > got[2000 + VOCAB.index(rare)]


def test_the_third_byte_back_has_sixteen_classes():
    """Bytes 8 apart are told apart three places back, and a table packed by equal rows reads as the flat one."""
    cells, first = Y.cells_of([b"axyz", b"ixyz", b"hxyz"])
    assert len({int(c) >> 8 for c in cells[first + 3]}) == 3 and Y.SUBTREES * Y.CELLS == 2**15 * 256
    flat = np.repeat(np.random.default_rng(3).random((8, 256)).astype(np.float32), 16, 0)
    rows = Y.Rows.of(flat.ravel())
    at = np.random.default_rng(4).integers(0, flat.size, 500)
    assert len(rows.rows) == 8 and (rows[at] == flat.ravel()[at]).all()


def test_pairs_met_across_batches_are_plain_counts():
    """Rows of a pair that lie in several batches are one count, with the blocks that can't tell it from their own."""
    rng = np.random.default_rng(5)
    rows = sorted({(int(v), int(u), int(b)): int(rng.integers(0, 3)) for u, v, b in rng.integers(0, 7, (900, 3))}.items())
    v, u, b = (np.array([r[0][i] for r in rows]) for i in range(3))
    own = np.array([r[1] for r in rows])
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (u, v, own * Y.CONTEXTS + u % Y.CONTEXTS, b)],
                                       names=["u", "v", "tag", "block"])
    got = [r for size in (1, 3, 1000) for r in [sorted(
        (r["u"], r["v"], r["k"], r["c"], *r["blocks"]) for x in Y._met(batch.slice(at, size) for at in range(0, len(rows), size))
        for r in x.to_pylist())]]
    count = collections.Counter()
    for (y, x, _), n in rows:
        count[x, y] += n
    want = []
    for (x, y), c in count.items():
        at = [k for (vv, uu, k), n in rows if (uu, vv) == (x, y) and (c > 1 or c > n)]
        want += [(x, y, x % Y.CONTEXTS, c, *at)] if at else []
    assert got == [sorted(want)] * 3 and len(list(Y._met(iter([])))) == 1


def test_language_model_leaves_no_old_tables(spark, monkeypatch):
    """What rounds and passes leave behind is deleted, in two passes as in one, with the same scores."""
    def left():
        base = shared_dir(spark, "llm", unique=False).removeprefix("file:")
        return sorted((d, x) for d in os.listdir(base) for x in os.listdir(f"{base}/{d}") if d.startswith("py-")) if os.path.isdir(base) else []

    docs = [(i, " ".join(RND.choices(VOCAB[:40], k=12))) for i in range(60)] + [(90, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    seen = []
    for tokens_of_a_pass in (1 << 21, 10):
        monkeypatch.setattr(Y, "PASS_TOKENS", tokens_of_a_pass)
        before = set(left())
        seen.append(sorted(Y.perplexity(df, F.col("doc_id") % 5 != 1).collect()))
        new = collections.Counter(d for d, _ in set(left()) - before)
        assert new["py-classes"] == new["py-seated"] == new["py-bases"] == new["py-words"] == new["py-pairs"] == 0
        assert new["py-scores"] == len(seen)
    assert seen[0] == seen[1]


def test_a_worker_holds_one_spelling_table(spark):
    """The tables of earlier rounds would stay in every worker, beside a block and its answers."""
    flat = np.zeros(Y.SUBTREES * Y.CELLS, np.float32)
    for x in (1.0, 2.0, 3.0):
        flat[0] = x
        shared = spark.sparkContext.broadcast(Y._packed(flat))
        assert Y._table_of(shared)[np.array([0, 1])].tolist() == [x, 0.0] and len(Y._TABLES) == 1


def test_texts_are_numbered_and_read_by_one_worker_a_task(spark, tmp_path, capsys):
    """In all the stages of a scan but one Python step reads the texts, and its scores are those of stored blocks."""
    docs = [(i, " ".join(RND.choices(VOCAB[:30], k=15))) for i in range(80)] + [(None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    steps, plain = [], Y.materialised

    def seen(frame, *names):
        frame.explain()
        steps.append((names[-1], capsys.readouterr().out))
        return plain(frame, *names)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(Y, "materialised", seen)
        got = sorted(Y.perplexity(df, F.col("doc_id") % 5 != 1, stored=False).collect(), key=str)
    for name, p in steps:
        lines = [x for x in p.splitlines() if "MapInArrow" in x or "Exchange" in x or "FlatMap" in x or "Scan" in x]
        kinds = ["MapInArrow" in x and "FlatMap" not in x for x in lines]
        assert not any(a and b for a, b in zip(kinds[:-1], kinds[1:], strict=True)), name
    assert {"py-words", "py-pairs", "py-scores"} <= {n for n, _ in steps}
    assert got == sorted(Y.perplexity(df, F.col("doc_id") % 5 != 1).collect(), key=str)


def test_blocks_are_bounded_and_passes_share_them_out(spark, monkeypatch):
    rows = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([True] * 50), pa.array(["x" * (1 << 18)] * 50)],
                                      names=["id", "train", "text"])
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda self: 3})())
    block = next(iter(Y._blocks(iter([rows])))).column(0).to_numpy()
    assert set(block >> 32) == {3} and max(collections.Counter(block.tolist()).values()) <= 17
    parts = [next(iter(Y._from_rows(None, 2, k)(iter([rows])))) for k in (0, 1)]
    assert sorted(i for b in parts for i in b.column(1).to_pylist()) == list(range(50))
    assert not set(parts[0].column(0).to_pylist()) & set(parts[1].column(0).to_pylist())


def test_a_block_is_whole_across_batches():
    """Batches of few bytes cut blocks, which would ask for their words and pairs once per piece."""
    rows = pa.RecordBatch.from_arrays([pa.array([0, 0, 0, 0, 1, 1, 2]), pa.array(range(7)), pa.array([True] * 7),
                                       pa.array(["a b", "a b", None, "a b", "a b", "c", ""])], names=["block", "id", "train", "text"])
    for step in (Y._pairs, Y._ask, Y._count):
        want = [x.to_pylist() for x in Y._by_block(step)(iter([rows]))]
        assert len(want) == 3
        for size in (1, 2, 3):
            assert [x.to_pylist() for x in Y._by_block(step)(rows.slice(i, size) for i in range(0, 7, size))] == want
