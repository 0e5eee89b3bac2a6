"""The stages against brute force, and the registered queries' columns."""

from __future__ import annotations

from collections import defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import check_packing
from tidewatch.llm.queries import table
from tidewatch.session import cut_lineage


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = [cut_lineage(table(spark, folder, "documents"))]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(cut_lineage(stage(spark, docs[-1], folder)))
    return docs


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_keeps_good_documents(spark, folder, stages):
    marks = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect()}
    kept = set(ids(stages[1]))
    good = [d for d, q in marks.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good)


def test_exact_stage(stages):
    assert ids(stages[2]) == sorted(r[0] for r in brute.exact(texts(stages[1])) if r[3])


def test_near_stage(stages):
    assert ids(stages[3]) == sorted(r[0] for r in brute.near_duplicates(texts(stages[2])) if r[0] == r[2])


def test_clean_stage(spark, folder, stages):
    items = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
    assert ids(stages[4]) == sorted(r[0] for r in brute.contamination(texts(stages[3]), items) if not r[5])


def test_packing_stage(stages):
    held = defaultdict(list)
    for d, t in texts(stages[4]):
        held[d].append(t)
    found = stages[5].collect()
    assert {r["doc_id"] for r in found} == set(held)
    check_packing(found, held, 1024)


def test_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
