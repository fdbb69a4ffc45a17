"""Registered queries: one per operator, SQL twins, and the pipeline against its parts."""

import hashlib

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from conftest import SF001

import corpus_pipeline
from pinprice.llm import line_dedup, quality_rules, source_mixing
from pinprice.llm.queries import ORACLE, QUERIES
from tools.check_oracle import TABLES, _hash, _norm


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got, want = _norm(QUERIES[name](spark, SF001).toPandas()), _norm(duck.execute(ORACLE[name]).fetchdf())
    assert list(got.columns) == list(want.columns) and _hash(got) == _hash(want) and len(got)


def test_pipeline_equals_its_stages_one_by_one(spark):
    """Every stage against a plain model of it, on what its predecessor kept."""
    from test_llm_dedup import brute_classes, naive

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-dedup", "passage dedup", "mixing", "byte-level BPE"]
    quality, near, passages, mixed, tokens = (f for _, f in corpus_pipeline.STAGES)
    mask = quality_rules.POLICIES[quality_rules.PRODUCTION].mask

    a = quality(spark, docs, SF001)
    assert a.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in docs.collect() if not _bits(r["text"]) & mask}
    assert {r["doc_id"]: r["text"] for r in a.collect()} == kept

    b = near(spark, a, SF001)
    classes = brute_classes(kept)
    kept = {i: t for i, t in kept.items() if classes[i] == i}
    assert b.columns == docs.columns and {r["doc_id"]: r["text"] for r in b.collect()} == kept

    c = passages(spark, b, SF001)
    kept = naive(list(kept.items()))
    rows = c.collect()
    assert c.columns == docs.columns and {r["doc_id"]: r["text"] for r in rows} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in rows)

    d = mixed(spark, c, SF001)
    times = {r["doc_id"]: r["copies"] for r in source_mixing.mix(c).collect()}
    got = [r["doc_id"] for r in d.collect()]
    assert d.columns == docs.columns and sorted(got) == sorted(i for i, n in times.items() for _ in range(n))

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks=_ranks())
    out = corpus_pipeline.run(spark, SF001).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(got)
    for r in out:
        assert r["ids"] == library.encode_ordinary(kept[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(kept[r["doc_id"]].encode()).hexdigest()


def _bits(text):
    from test_llm_rules import naive

    m = dict(zip(quality_rules.MEASURES, naive(text), strict=True))
    n = m["n_words"]
    fails = (n < 50, 100 * m["n_repeat_words"] > 50 * n, n > 0 and 100 * m["n_symbols"] > 20 * n,
             m["n_lines"] > 0 and 100 * m["n_dup_lines"] > 50 * m["n_lines"],
             n > 0 and (m["word_chars"] < 2 * n or m["word_chars"] > 25 * n))
    return sum(1 << i for i, f in enumerate(fails) if f)


def _ranks():
    import base64

    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}


def test_library_without_the_subpackage():
    """Nothing outside imports it."""
    from pathlib import Path

    root = Path(line_dedup.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "pinprice.llm" not in p.read_text(), p
