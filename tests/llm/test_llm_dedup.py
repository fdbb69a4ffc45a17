"""Line and passage dedup, and near-duplicate classes, against plain models."""

import collections
import random

import numpy as np
import pytest

from pinprice.llm import dart_minhash as D
from pinprice.llm import line_dedup as L
from pinprice.llm.hashing import batches_of, words_of

RND = random.Random(11)
VOCAB = ["".join(RND.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(RND.randint(2, 9))) for _ in range(4000)]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(VOCAB) + ("." if rnd.random() < 0.1 else "") for _ in range(n))


def naive(docs):
    """The texts left when units are met one by one in order of the ids."""
    first = {}
    for i, t in sorted(((i, t) for i, t in docs if t is not None), key=lambda x: x[0]):
        w = words_of([t])
        for d in zip(*L.units_of(w)[2:4], strict=True):
            first.setdefault(d, i)
    out = {}
    for i, t in docs:
        if t is None:
            out[i] = None
            continue
        w, seen, keep = words_of([t]), set(), []
        units = sorted(zip(*L.units_of(w), strict=True), key=lambda u: (u[0], not u[4]))
        runs = []
        for a, b, d1, d2, line in units:
            if first[d1, d2] == i and (d1, d2) not in seen:
                seen.add((d1, d2))
            elif line:
                keep.append((int(w.start[a]), int(w.end[b - 1]), 0))
            elif runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        keep += [(int(w.start[a]), int(w.end[b - 1]), 0) for a, b in runs if b - a >= L.MIN_RUN_WORDS]
        out[i] = L.cut(t, keep)[0]
    return out


@pytest.fixture(scope="module")
def corpus():
    docs = {i: "\n".join(prose(RND.randint(5, 60)) for _ in range(RND.randint(1, 6))) for i in range(60)}
    passage = prose(70)
    for i in (3, 11, 30, 47):                      # pasted inside a line
        words = docs[i].split(" ")
        docs[i] = " ".join([*words[:4], passage, *words[4:]])
    line = prose(20).replace("é", "e")     # only ASCII letters are folded
    for i in (5, 6, 40):
        docs[i] += "\n" + line.upper() if i == 40 else "\n" + line
    docs[50] = docs[20]
    docs[51] = "\n".join([prose(15)] * 4)
    docs[52] = passage + "\n" + passage
    docs |= {53: "", 54: None, 55: " \n\t ", 56: "one", 57: prose(20_000)}
    return docs, passage, line


def test_removal_equals_a_sequential_model(spark, corpus):
    docs, _, _ = corpus
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in L.remove_repeats(df).collect()}
    assert got == naive(list(docs.items()))


def test_passages_go_and_clean_texts_stay(spark, corpus):
    docs, passage, line = corpus
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in L.remove_repeats(df).collect()}
    assert [i for i, r in rows.items() if r["text"] and passage in r["text"]] == [3]
    assert [i for i, r in rows.items() if r["text"] and line.lower() in r["text"].lower()] == [5]
    assert rows[50]["text"] == "" and rows[51]["text"].count("\n") <= 1
    for i in (0, 1, 2, 57):
        assert rows[i]["text"] == docs[i] and rows[i]["removed"] == []
    for i, r in rows.items():
        for s in r["removed"]:
            assert 0 <= s["start"] < s["end"] <= len(docs[i]) and s["first_doc"] <= i
    assert docs[40][rows[40]["removed"][0]["start"]:rows[40]["removed"][0]["end"]] == line.upper()


def test_odd_rows_of_line_dedup(spark):
    a = prose(30)
    rows = [(1, a, "x", 1), (1, a, "x", 2), (None, a, "y", 3), (2, a, None, 4), (None, a, "z", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string, hits int")
    got = L.remove_repeats(df).collect()
    assert set(df.columns) <= set(got[0].asDict()) and len(got) == 5
    assert sorted((r["doc_id"] or -1, r["text"] == a) for r in got) == [(-1, False), (-1, False), (1, True), (1, True), (2, False)]
    assert L.remove_repeats(df.limit(0)).count() == 0


def test_word_hashes_do_not_depend_on_the_batch():
    texts = [prose(40), "", None, "Ä b\tC\x0b d", "one"]
    together = words_of(texts)
    for i, t in enumerate(texts):
        own = words_of([t])
        assert (together.hash[together.first[i]:together.first[i + 1]] == own.hash).all()
        assert len(own.hash) == len((t or "").encode().split())
    assert [*batches_of(texts, 100)][0][0] == 0


def test_short_lines_go_as_in_a_plain_model(spark):
    """Lines of 1 to 9 words among unlike neighbours, against a walk over the lines that hashes nothing."""
    rnd = random.Random(3)
    lines = ["licensed under the apache license, version 2.0."] + [prose(rnd.randint(1, 9), rnd) for _ in range(40)]
    docs = {i: "\n".join(rnd.choice(lines) if rnd.random() < 0.4 else prose(rnd.randint(10, 14), rnd) for _ in range(8))
            for i in range(60)}
    docs[7] = docs[7] + "\n" + lines[0].replace(" ", "  ").upper()
    seen, want = set(), {}
    for i in sorted(docs):
        want[i] = []
        for line in docs[i].split("\n"):
            words = tuple(line.encode().lower().split())
            if words not in seen:
                want[i].append(line)
            seen.add(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: [x for x in r["text"].split("\n") if x.strip()] for r in L.remove_repeats(df).collect()}
    assert got == want


def test_passages_of_over_fifty_words_go_whole(spark):
    """Passages pasted inside lines, also of words with a period of 4, go to the last word; their hosts stay."""
    rnd = random.Random(8)
    passages = [[f"p{n}w{k}" for k in range(51 + n % 5)] for n in range(60)] + [["la", "li", "lo", "lu"] * 14 + ["end"]]
    hosts = {i: [f"h{i}w{k}" for k in range(30)] for i in range(2 * len(passages))}
    docs = {}
    for n, passage in enumerate(passages):
        for i in (n, n + len(passages)):
            at = rnd.randint(1, 29)
            docs[i] = " ".join([*hosts[i][:at], *passage, *hosts[i][at:]])
    docs[500] = "x y " * 60                              # of a text's own repeats, one whole occurrence stays
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"].split() for r in L.remove_repeats(df).collect()}
    for i, host in hosts.items():
        assert got[i] == (docs[i].split() if i < len(passages) else host)
    assert 50 <= len(got[500]) < 120


def test_a_full_filter_changes_nothing(spark, corpus, monkeypatch):
    """Where the filter has too few bits it lets more units through; what goes is the same."""
    docs, _, _ = corpus
    monkeypatch.setattr(L, "MOST_BITS", 64)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in L.remove_repeats(df).collect()}
    assert got == naive(list(docs.items()))


def test_the_filter_lets_its_own_through_and_few_others(spark):
    rng = np.random.default_rng(1)
    own, other = (rng.integers(-2**63, 2**63 - 1, 20_000) for _ in range(2))
    words = L._filter_of(spark.createDataFrame([(int(x),) for x in own], "d long"))
    assert L.passes(words, own).all() and L.passes(words, other).mean() < 0.02
    assert not L.passes(L._filter_of(spark.createDataFrame([], "d long")), other).any()


# -- near duplicates


def counts(t):
    w = (t or "").lower().split()
    if not w:
        return collections.Counter()
    return collections.Counter(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4)))


def brute_classes(docs):
    sets = {i: counts(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            both = sum((a & b).values())
            total = sum(a.values()) + sum(b.values()) - both
            if total and both >= 0.8 * total:
                r, s = root(i), root(j)
                parent[max(r, s)] = min(r, s)
    return {i: root(i) for i in docs}


@pytest.fixture(scope="module")
def copies():
    docs = {i: prose(RND.randint(20, 200)) for i in range(40)}
    for i in range(40, 90):                          # edits of a few words, some beyond the threshold
        words = docs[RND.randrange(0, 6)].split()
        for _ in range(RND.randint(0, 5)):
            words[RND.randrange(len(words))] = RND.choice(VOCAB)
        docs[i] = " ".join(words)
    docs |= {90: docs[7], 91: docs[7].upper(), 92: "", 93: None, 94: "\n ", 95: "two words", 96: "two words",
             97: "a b c " * 400, 98: "a b c " * 390, 99: prose(20_000)}
    docs[100] = docs[99] + " more"
    return docs


def test_classes_equal_brute_force(spark, copies):
    df = spark.createDataFrame(list(copies.items()), "doc_id long, text string").repartition(4)
    got = {r["doc"]: r["class_id"] for r in D.near_duplicates(df).collect()}
    assert got == brute_classes(copies)


def test_one_of_each_class_stays(spark, copies):
    rows = [(i, t, f"s{i}", 1) for i, t in copies.items()] + [(7, copies[7], "again", 2), (None, "x", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string, class_id int")
    got = D.keep_one(df).collect()
    want = {i for i, c in brute_classes(copies).items() if i == c}
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(want)
    assert sum(r["doc_id"] is None for r in got) == 1 and list(got[0].asDict()) == df.columns
    assert D.near_duplicates(df.limit(0)).count() == 0 and D.keep_one(df.limit(0)).count() == 0


def test_rows_of_one_id_or_none_are_rows_of_their_own(spark, copies):
    """Repeated ids with unlike texts, null ids, equal rows, and columns named like the operator's own."""
    a, b, c = prose(40), prose(40), prose(40)
    near = a.split()
    near[20] = "changed"
    rows = [(1, a), (1, b), (2, a.upper()), (None, a), (None, c), (None, c), (3, " ".join(near)), (902, b), (902, b), (902, c),
            (5, ""), (5, ""), (None, None), (6, " \n")]
    ddl = "doc_id long, text string, `__doc` string, row int, h1 string, words string, doc int, `class` int"
    df = spark.createDataFrame([(*r, f"d{i}", i, "h", "w", -i, i) for i, r in enumerate(rows)], ddl).repartition(3)
    got = sorted(((r["doc"], r["class_id"]) for r in D.near_duplicates(df).collect()), key=str)
    want = [(1, 1), (1, 1), (2, 1), (None, 1), (None, 902), (None, 902), (3, 1), (902, 1), (902, 1), (902, 902), (5, 5),
            (5, 5), (None, None), (6, 6)]
    # an edit of one of 40 words leaves 31 of 41 shingles: no link
    want[6] = (3, 3)
    assert got == sorted(want, key=str)
    kept = D.keep_one(df).collect()
    assert list(kept[0].asDict()) == df.columns
    assert all(r["__doc"] == f"d{r['row']}" and r["doc"] == -r["row"] == -r["class"] for r in kept)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == sorted(
        [("1", a), ("1", b), ("902", c), ("3", " ".join(near)), ("5", ""), ("5", ""), ("None", ""), ("6", " \n")])


def test_query_has_a_row_for_every_row(spark, tmp_path):
    from pinprice.llm.queries import op4_dart_minhash

    rows = [(i % 30 if i % 4 else None, prose(20 + i % 3) if i % 5 else "one text of six words here") for i in range(48)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op4_dart_minhash(spark, str(tmp_path)).collect()
    assert len(out) == 48 and sum(r["doc_id"] is None for r in out) == 12
    assert len({r["class_id"] for r, t in zip(out, rows, strict=True) if r["doc_id"] is not None}) > 10


def test_no_link_is_lost_when_no_star_finds_it(spark, monkeypatch):
    """A chain whose ends are unlike, without star rounds that help: the cells find every join."""
    base = prose(60).split()
    docs = {}
    for i in range(12):
        docs[i] = " ".join(base)
        base[(5 * i) % 60] = RND.choice(VOCAB)
    monkeypatch.setattr(D, "STARS", 1)
    monkeypatch.setattr(D, "CHUNK", 2)
    monkeypatch.setattr(D, "WIDE", 3)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["doc"]: r["class_id"] for r in D.near_duplicates(df).collect()} == brute_classes(docs)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    for wa, wb in ((rng.random(300) * 3, rng.random(300) * 3), (np.ones(400), np.r_[np.ones(300), np.zeros(100)]),
                   (np.r_[50.0, np.ones(20)], np.r_[25.0, np.ones(20)])):
        n = len(wa)
        h = rng.integers(1, 2**63, n).astype(np.uint64)
        text = np.repeat([0, 1], n)
        w = np.r_[wa, wb]
        keep = w > 0
        sig = D.signatures(text[keep], np.r_[h, h][keep], w[keep], 2, 2000)
        true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        assert abs((sig[0] == sig[1]).mean() - true) < 0.05


def test_components_against_union_find(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [
        (200, 200 + i) for i in range(1, 50)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        r, s = root(a), root(b)
        parent[max(r, s)] = min(r, s)
    got = {r["doc"]: r["comp"] for r in D.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
