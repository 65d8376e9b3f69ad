"""Every corpus query beside its SQL, and the pipeline beside what its stages promise."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from costlens.llm import common, jaccard, secrets
from costlens.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from verification.check import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, name):
    assert compare(spark, duck(SMALL), QUERIES[name], ORACLES[name], SMALL)[0].startswith("ok")


def test_all_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in entry.queries() if name.startswith("op") and name[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_cover_their_table(spark, name):
    got = QUERIES[name](spark, SMALL)
    key = next(c for c in ("doc_id", "page_id", "query_id") if c in got.columns)
    source = {"doc_id": "documents", "page_id": "pages", "query_id": "embeddings"}[key]
    rows = common.table(spark, SMALL, source)
    if key == "query_id":
        rows = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    assert {r[0] for r in got.select(key).collect()} == {r[0] for r in rows.select(key).collect()}


def rows_of(frame):
    return Counter(tuple(r) for r in frame.select(*corpus_pipeline.COLUMNS).collect())


def test_pipeline_stages(spark):
    docs = common.table(spark, SMALL, "documents")
    awkward = spark.createDataFrame(
        [(None, "a text without an id", "en", "src1", 20), (90001, None, "en", "src1", None), (90002, "123 ...", None, None, 7), (5, "another text of five", "en", None, 20),
         (90003, "token = abcdef0123456789", "en", None, 24)],
        docs.schema,
    )
    docs = docs.unionByName(awkward).unionByName(docs.where("doc_id = 3"))
    first = common.stored(corpus_pipeline.language(spark, docs, SMALL), "t")
    letters = Counter({r: n for r, n in rows_of(docs).items() if any(map(str.isalpha, r[1] or ""))})
    assert rows_of(first) == letters

    second = common.stored(corpus_pipeline.near_duplicates(spark, first, SMALL), "t")
    groups = jaccard.join(first).collect()
    assert sorted(r.doc_id for r in second.collect()) == sorted({r.component_id for r in groups})
    assert not rows_of(second) - rows_of(first)

    third = common.stored(corpus_pipeline.without_secrets(spark, second, SMALL), "t")
    assert third.count() == second.count() and "abcdef0123456789" not in str(rows_of(third))
    assert secrets.find_secrets(third).where("spans <> ''").count() == 0

    fourth = common.stored(corpus_pipeline.mixed(spark, third, SMALL), "t")
    assert set(rows_of(fourth)) <= set(rows_of(third)) and max(rows_of(fourth).values()) <= 3
    total = third.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    taken = fourth.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert abs(taken - total) < 0.05 * total

    lengths = defaultdict(int)
    for r in corpus_pipeline.packed(spark, fourth, SMALL).collect():
        lengths[r.doc_id, r.doc_tokens] += r.length
    copies = Counter(r.doc_id for r in fourth.collect())
    assert {k[0]: n // k[1] for k, n in lengths.items()} == dict(copies) and all(n % k[1] == 0 for k, n in lengths.items())


def test_pipeline_runs_all_stages(spark):
    docs = common.table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SMALL), "t")
    drop = ["sequence_id"]
    assert sorted(map(str, corpus_pipeline.run(spark, SMALL).drop(*drop).collect())) == sorted(map(str, docs.drop(*drop).collect()))
