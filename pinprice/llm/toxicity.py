"""Toxicity by weak supervision.

Voters are single words (lexicon), word beginnings and fixed text patterns;
words and beginnings come from a built-in list and from all labelled training
rows by their log-odds. A generative label model explains the votes of all
training documents by a hidden class: given the class, voters fire at their own
rates, and pairs of voters along a forest (the pairs of most mutual information
given the class) have factors of their own, so that voters that repeat each
other are no double evidence. It is a proper distribution over all patterns of
votes. Expectation maximisation runs on Spark: documents of equal votes and
label are one row with a count, and a round is one grouped sum per pair of
voters that fire together. A known label is a nearly sure observation of the
hidden class while the model is fitted, and rows without one weigh
``UNLABELLED_WEIGHT`` beside rows with one (semi-supervised EM: at full weight
the class drifts away from the labels); the model's posteriors, which come from
the votes alone, are the targets of a logistic regression over the votes and their counts,
which scores every whole text in one pass over it.

Bounds (parameters): at most about ``LABELLED`` labelled rows, drawn by a hash
of the id, fit the linear classifier; ``VOTERS`` voters at most, so the models
that go to the tasks and the sums that come back (one per pair of voters) have
a fixed size. All counts and the label model cover all training rows.

Defined results: a null or empty text gets the score of no votes; without
labelled rows of both classes the built-in voters keep the odds they start with; labels
that are null or contradict (several rows of an id) count as absent or as the
greatest; rows of equal id are voted on and scored one by one; ties between
terms go to the shorter kind and the lesser term; texts of any length are read
whole; an empty table gives no rows; further columns, of any name, are ignored.
Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinprice.llm.common import crc32_mod, ship_package, slices, store
from pinprice.operators.joins import join_small

LABELLED, VOTERS = 20_000, 256
ROUNDS = 12
#: Odds of a known label to be right, as the label model sees it.
LABEL_ODDS = 1e6
#: Weight of a training row without a label in the label model, beside rows with one.
UNLABELLED_WEIGHT = 0.1
#: Least mutual information (nats a document) of a pair of voters that gets a factor.
LEAST_INFORMATION = 1e-5
CUT = 0.3
LEAST_ODDS = 1.5  # log-odds that a mined voter must exceed by twice their spread
PREFIXES = range(4, 8)
#: A small list to start from; most voters come from the training rows.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb",
           "ugly", "filthy", "imbecile", "jerk", "bastard")
PATTERNS = (r"\byou(?:'re| are) (?:an? |such )", r"!{3,}", r"\b\w+\*{2,}\w*", r"\b(?:shut up|go away|hate you|kill your)")
#: So many mined places or more are voters too.
COUNTS = (2, 3, 5)
_WORD = re.compile(r"\w+")
_FIXED = [re.compile(p) for p in PATTERNS]


@dataclass
class Model:
    """Voters and the weights of the classifier; ``key`` names it in a worker's cache."""

    words: list[str]
    prefixes: list[str]
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = 0.0

    @property
    def n_voters(self) -> int:
        return len(self.words) + len(self.prefixes) + len(PATTERNS) + len(COUNTS)


class Voting:
    """Which voters fire on a text, and how often the mined ones do."""

    def __init__(self, words: list[str], prefixes: list[str]):
        import ahocorasick

        self.at = {w: i for i, w in enumerate(words)}
        self.prefix_at = {p: len(words) + i for i, p in enumerate(prefixes)}
        self.n = len(words) + len(prefixes)
        self.find = ahocorasick.Automaton()
        for w in {*words, *prefixes}:
            self.find.add_word(w, w)
        self.find.make_automaton()

    def __call__(self, text: str | None) -> tuple[np.ndarray, int]:
        votes, hits = np.zeros(self.n + len(PATTERNS) + len(COUNTS), np.float64), set()
        low = (text or "").lower()
        edge = lambda i: not 0 <= i < len(low) or not (low[i].isalnum() or low[i] == "_")
        for end, w in self.find.iter(low) if self.n else ():
            begin = end - len(w) + 1
            if not edge(begin - 1):
                continue
            if w in self.prefix_at:
                votes[self.prefix_at[w]] = 1
                hits.add(begin)
            if w in self.at and edge(end + 1):
                votes[self.at[w]] = 1
                hits.add(begin)
        for i, p in enumerate(_FIXED):
            votes[self.n + i] = bool(p.search(low))
        votes[-len(COUNTS):] = [len(hits) >= c for c in COUNTS]
        return votes, len(hits)


def features(votes: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """The classifier's inputs: the votes, how many mined places fire (log), and whether any does."""
    return np.column_stack([votes, np.log1p(hits), hits > 0])


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to document counts (kind, term, toxic, clean) of words and beginnings."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def out() -> pa.RecordBatch:
        terms = list({*counts[0], *counts[1]})
        cols = [pa.array([t[0] for t in terms], pa.int32()), pa.array([t[1] for t in terms], pa.string()),
                *(pa.array([counts[c][t] for t in terms], pa.int64()) for c in (1, 0))]
        return pa.RecordBatch.from_arrays(cols, names=["kind", "term", "n1", "n0"])

    for b in batches:
        for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = {w for w in _words(text) if not w.isdigit()}
            counts[toxic].update((0, w) for w in words if len(w) > 2)
            for n in PREFIXES:
                counts[toxic].update((1, p) for p in {w[:n] for w in words if len(w) > n})
        if len(counts[0]) + len(counts[1]) > 1_000_000:
            yield out()
            counts = {0: Counter(), 1: Counter()}
    yield out()


def choose_voters(rows: list[tuple[int, str, int, int]], toxic: int, clean: int,
                  most: int = VOTERS) -> tuple[list[str], list[str]]:
    """Words and beginnings of the strongest evidence; what a chosen beginning covers is left out."""
    scored = []
    for kind, term, n1, n0 in rows:
        odds = np.log((n1 + 0.5) / (toxic + 1)) - np.log((n0 + 0.5) / (clean + 1))
        spread = np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
        if odds - 2 * spread > LEAST_ODDS:
            scored.append((n1 * (odds - 2 * spread), kind, term))
    words, prefixes = [w for w in INSULTS], []
    for _, kind, term in sorted(scored, key=lambda x: (-x[0], x[1], -len(x[2]), x[2])):
        if len(words) + len(prefixes) >= most:
            break
        if any(term.startswith(p) or p.startswith(term) for p in prefixes) or term in words:
            continue
        if kind and any(w.startswith(term) for w in words):
            continue
        (prefixes if kind else words).append(term)
    return words, prefixes


@dataclass
class LabelModel:
    """P(class), the voters' rates in either class, and a forest of pairs with their joint rates."""

    prior: float
    rates: np.ndarray                      # 2 x voters; row 1 is toxic
    edges: np.ndarray                      # pairs of voters (i, j)
    joint: np.ndarray                      # 2 x pairs: both fire

    def factors(self, y: int) -> tuple[float, np.ndarray, np.ndarray]:
        """log P(votes | y) as a constant, a weight per voter and one per pair that fires together."""
        p = self.rates[y]
        const, w, u = float(np.log(1 - p).sum()), np.log(p / (1 - p)), np.zeros(len(self.edges))
        for e, (i, j) in enumerate(self.edges):
            both = self.joint[y, e]
            t = {(a, b): np.log(x) - np.log(p[i] if a else 1 - p[i]) - np.log(p[j] if b else 1 - p[j]) for (a, b), x in (
                ((1, 1), both), ((1, 0), p[i] - both), ((0, 1), p[j] - both), ((0, 0), 1 - p[i] - p[j] + both))}
            const += t[0, 0]
            w[i] += t[1, 0] - t[0, 0]
            w[j] += t[0, 1] - t[0, 0]
            u[e] = t[1, 1] - t[1, 0] - t[0, 1] + t[0, 0]
        return const, w, u

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Log-odds of toxic given the votes alone."""
        (c1, w1, u1), (c0, w0, u0) = self.factors(1), self.factors(0)
        out = np.log(self.prior / (1 - self.prior)) + c1 - c0 + votes @ (w1 - w0)
        if len(self.edges):
            out = out + (votes[:, self.edges[:, 0]] * votes[:, self.edges[:, 1]]) @ (u1 - u0)
        return np.clip(out, -30, 30)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def expected(model: LabelModel | None, votes: np.ndarray, marks: np.ndarray, start: bool) -> tuple[np.ndarray, np.ndarray]:
    """(P(toxic), weight) of rows for the next sums; ``marks``: 1, 0 or nan.

    Without a model yet: known labels alone, if ``start`` says that both classes have some, else any vote.
    """
    known = ~np.isnan(marks)
    if model is None:
        if start:
            return np.where(known, marks, 0.0), known.astype(float)
        return np.where(votes.any(1), 0.9, 0.02), np.ones(len(votes))
    seen = np.where(known, np.where(marks == 1, 1, -1), 0) * np.log(LABEL_ODDS)
    # where there are labels, a row without one counts for less, lest the hidden class become another one
    return _logistic(model.log_odds(votes) + seen), np.where(known | (not start), 1.0, UNLABELLED_WEIGHT)


def maximised(totals: np.ndarray, pairs: dict[tuple[int, int], np.ndarray], m: int) -> LabelModel:
    """The model from expected sums per class (clean, toxic): of documents, and of documents in which i and j both fire."""
    at = np.array(list(pairs), np.int64).reshape(-1, 2)
    sums = np.array(list(pairs.values()), float).reshape(-1, 2).T
    own = at[:, 0] == at[:, 1]
    rates = np.zeros((2, m))
    rates[:, at[own, 0]] = sums[:, own]
    pooled = (rates.sum(0) + 0.11) / (totals.sum() + 2.0)
    rates = (rates + np.array([[0.02], [0.2]])) / (totals[:, None] + 2.0)
    # a voter is no evidence against toxicity: at most it tells nothing
    rates = np.where(rates[1] < rates[0], pooled, rates)
    share = totals / max(totals.sum(), 1e-9)
    at, sums = at[~own], sums[:, ~own]
    p, q = rates[:, at[:, 0]], rates[:, at[:, 1]]
    both = (sums + 2.0 * p * q) / (totals[:, None] + 2.0)  # two documents in which they are independent
    least = np.minimum(p, q)  # every cell of a pair keeps some probability
    both = np.clip(both, np.maximum(p + q - 1 + 1e-9, 1e-6 * least), (1 - 1e-6) * least)
    cells = np.maximum(np.stack([both, p - both, q - both, 1 - p - q + both]), 1e-12)
    free = np.stack([p * q, p * (1 - q), (1 - p) * q, (1 - p) * (1 - q)])
    information = share @ (cells * np.log(cells / free)).sum(0)
    found = np.flatnonzero(information > LEAST_INFORMATION)
    found = found[np.lexsort((at[found, 1], at[found, 0], -information[found]))]
    parent = list(range(m))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    forest = []
    for e in found.tolist():  # the greatest spanning forest
        i, j = root(int(at[e, 0])), root(int(at[e, 1]))
        if i != j:
            parent[i] = j
            forest.append(e)
    return LabelModel(float(np.clip(share[1], 0.005, 0.995)), rates, at[forest], both[:, forest])


def dense(votes: list[list[int]], m: int) -> np.ndarray:
    out = np.zeros((len(votes), m))
    for i, v in enumerate(votes):
        out[i, v] = 1
    return out


def _sums(blob: bytes, m: int, start: bool):
    """mapInArrow: (votes, toxic, n) to expected sums of pairs (i, j) that fire together; (-1, -1) are all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(blob)
        pairs, totals = np.zeros((2, m, m)), np.zeros(2)
        for b in slices(batches, 4096):
            v = dense(b.column(0).to_pylist(), m)
            marks = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            post, weight = expected(model, v, marks, start)
            weight = weight * b.column(2).to_numpy()
            for y, w in ((0, weight * (1 - post)), (1, weight * post)):
                pairs[y] += (v * w[:, None]).T @ v
                totals[y] += w.sum()
        i, j = np.nonzero(np.triu(pairs.sum(0)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()),
             *(pa.array(np.append(pairs[y][i, j], totals[y])) for y in (0, 1))], names=["i", "j", "s0", "s1"])
    return run


def label_model(patterns: DataFrame, m: int, start: bool, rounds: int = ROUNDS) -> LabelModel:
    """Fit to ``patterns``: votes (numbers of the voters that fire), toxic (1, 0 or null) and n documents each."""
    model: LabelModel | None = None
    for _ in range(rounds):
        sums = patterns.select("votes", F.col("toxic").cast("double"), "n").mapInArrow(
            _sums(pickle.dumps(model), m, start), "i int, j int, s0 double, s1 double")
        got = sums.groupBy("i", "j").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1")).toArrow()  # one row per pair of voters
        pairs = {(i, j): np.array([x, y]) for i, j, x, y in zip(*(got[c].to_pylist() for c in ("i", "j", "s0", "s1")),
                                                             strict=True)}
        new = maximised(pairs.pop((-1, -1), np.zeros(2)), pairs, m)
        moved = 1.0 if model is None else float(np.abs(new.rates - model.rates).max()) + abs(new.prior - model.prior)
        model = new
        if moved < 1e-3:
            break
    return model


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    pull = np.full(len(w), ridge * max(1, len(x)) / 100)
    pull[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - target) + pull * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _votes(blob: bytes):
    words, prefixes = pickle.loads(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voting = Voting(words, prefixes)
        for b in slices(batches):
            got = [voting(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([np.flatnonzero(v).astype(np.int32) for v, _ in got], pa.list_(pa.int32())),
                 pa.array([h for _, h in got], pa.int64())], names=["id", "votes", "hits"])
    return run


def _drawn(share: float) -> Column:
    """A share of the rows, by a hash of the id in steps of 2^-53."""
    return F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") < share * 2.0**53


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        labelled: int = LABELLED) -> Model:
    """A model from training rows; ``docs`` and ``labels`` must hold training rows only."""
    ship_package(docs.sparkSession)
    marks = (labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
             .where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic")))
    body = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = join_small(body, marks, "id").select("toxic", "text")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    rows: list[tuple] = []
    if toxic and clean:
        mined = known.mapInArrow(_mine, "kind int, term string, n1 long, n0 long").groupBy("kind", "term").agg(
            F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        odds = F.log((F.col("n1") + 0.5) / (toxic + 1.0)) - F.log((F.col("n0") + 0.5) / (clean + 1.0))
        sure = odds - 2 * F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
        # the strongest evidence comes first; beginnings cover words, so more are looked at than can be chosen
        rows = [tuple(r) for r in mined.where((F.col("n1") >= 3) & (sure > LEAST_ODDS)).orderBy(
            (F.col("n1") * sure).desc(), "kind", "term").limit(40 * VOTERS).collect()]
    words, prefixes = choose_voters(rows, toxic, clean)
    m = len(words) + len(prefixes) + len(PATTERNS) + len(COUNTS)
    # every training document's votes, without its text
    votes = body.mapInArrow(_votes(pickle.dumps((words, prefixes))), "id long, votes array<int>, hits long")
    votes = store(join_small(votes, marks, "id", "left"), "toxic-votes")
    patterns = store(votes.groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n")), "toxic-patterns")
    model = label_model(patterns, m, bool(toxic and clean), ROUNDS if toxic and clean else 1)
    # the classifier's rows: about ``labelled`` at most, with labels if there are any
    asked = votes.where("toxic is not null") if toxic and clean else votes
    got = asked.where(_drawn(min(1.0, labelled / max(asked.count(), 1)))).select("votes", "hits").collect()
    x = dense([r["votes"] for r in got], m)
    out = Model(words, prefixes)
    out.weight, out.bias = fit_linear(features(x, np.array([r["hits"] for r in got], float)), _logistic(model.log_odds(x)))
    return out


def _score(blob: bytes):
    model = pickle.loads(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voting = Voting(model.words, model.prefixes)
        for b in slices(batches):
            got = [voting(t) for t in b.column(1).to_pylist()]
            x = features(np.array([v for v, _ in got]).reshape(len(got), -1), np.array([h for _, h in got], np.float64))
            z = np.clip(x @ model.weight + model.bias, -30, 30)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-z)))], names=["id", "score"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """id, score and predicted (1 from ``cut`` on) of every row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(_score(pickle.dumps(model)), "id long, score double")
    return out.select(F.col("id").alias(id_col), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))


__all__ = ["LabelModel", "Model", "Voting", "choose_voters", "crc32_mod", "expected", "features", "fit", "fit_linear",
           "label_model", "maximised", "score"]
