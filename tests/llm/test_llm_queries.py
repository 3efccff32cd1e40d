"""Registered queries against DuckDB, and the pipeline against its stages' rules."""

import collections
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline  # noqa: E402
from oracle_harness import compare, duck  # noqa: E402

from washframe.llm.queries import ORACLE, QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    res = compare(spark, duck(SMALL), name, QUERIES[name], ORACLE[name], SMALL)
    assert res["status"] == "ok", res


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SMALL)
        seen[name] = at.collect()
        if name != "pack":
            assert at.columns == docs.columns
    ids = {n: [r.doc_id for r in got] for n, got in seen.items()}
    assert len(ids["language"]) >= 0.97 * len(rows)
    texts = collections.defaultdict(list)
    for r in seen["language"]:
        texts[r.text].append(r.doc_id)
    assert set(ids["near_copies"]) <= {min(d) for d in texts.values()}
    assert sorted(ids["secrets"]) == sorted(ids["near_copies"])
    assert set(ids["mix"]) <= set(ids["secrets"]) and max(collections.Counter(ids["mix"]).values()) <= 3
    tokens = collections.Counter()
    for r in seen["pack"]:
        tokens[r.doc_id] += r.length
    copies = collections.Counter(ids["mix"])
    assert all(tokens[r.doc_id] == copies[r.doc_id] * r.doc_tokens for r in seen["pack"])


def test_language_rejects_gibberish(spark):
    """Random letters and unlearned scripts go, clean documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng, rows = random.Random(1), []
    for i in range(200):   # letters from a, or from the Cyrillic a
        first = 0x61 if i < 100 else 0x430
        words = ("".join(chr(first + rng.randrange(26)) for _ in range(rng.randint(2, 9))) for _ in range(60))
        rows.append((10 ** 9 + i, " ".join(words)))
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    for c in docs.columns[2:]:
        odd = odd.withColumn(c, F.lit(None).cast(docs.schema[c].dataType))
    kept = [r.doc_id for r in corpus_pipeline.language(spark, docs.union(odd), SMALL).select("doc_id").collect()]
    clean = sum(d < 10 ** 9 for d in kept)
    assert clean >= 0.99 * docs.count()
    assert len(kept) - clean <= 0.1 * len(rows)
