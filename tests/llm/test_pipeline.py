"""Queries and pipeline against their SQL, and what each stage of the pipeline keeps against plain Python."""

import pytest
from compare import norm, same, views

import corpus_pipeline
from vellum.llm.queries import ORACLES
from vellum.llm.shared import made_so_far

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(result, con, name):
    columns, rows = result(name)
    cur = con.execute(ORACLES[name])
    want = norm([c[0] for c in cur.description], cur.fetchall())
    assert norm(columns, [tuple(r) for r in rows]) == want


def test_pipeline_matches_sql(spark, con):
    before = made_so_far()
    same(spark, con, corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
    assert made_so_far() == before + 1  # the last stage's table; the others are gone


def test_stages(spark):
    """Stage by stage: columns stay, and each stage leaves what its own contract says."""
    from test_ops import brute_components, brute_hits, brute_mix, golden

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "source_mix", "shards"]
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    first = stages["quality_rules"](spark, docs, DATA).persist()
    was, rows = {r.doc_id: r.text for r in docs.collect()}, first.collect()
    assert first.columns == columns and 0 < len(rows) < len(was) and all(r.n_chars == len(r.text) and len(r.text) <= len(was[r.doc_id]) for r in rows)
    second = stages["near_duplicates"](spark, first, DATA).persist()
    tops = brute_components([(r.doc_id, r.text) for r in rows])
    assert second.columns == columns and sorted(r.doc_id for r in second.collect()) == sorted(i for i, (_, top) in tops.items() if i == top)
    third = stages["decontamination"](spark, second, DATA).persist()
    clean = [r for r in second.collect() for n, hit, *_ in [brute_hits(r.text, items)] if not (hit and 20 * hit >= n)]
    assert third.columns == columns and sorted(r.doc_id for r in third.collect()) == sorted(r.doc_id for r in clean)
    fourth = stages["source_mix"](spark, third, DATA).persist()
    taken, _, _, _ = brute_mix([(r.doc_id, r.text, r.source) for r in clean], golden)
    size = {r.doc_id: len(r.text.encode().split()) for r in clean}
    want = sorted(i for i, n in taken.items() for _ in range((2 * min(n, size[i]) >= size[i]) + (2 * (n - min(n, size[i])) >= size[i])))
    assert fourth.columns == columns and sorted(r.doc_id for r in fourth.collect()) == want
    last = stages["shards"](spark, fourth, DATA).collect()
    assert sorted(r.doc_id for r in last) == want and {r.shard for r in last} == set(range(8))
