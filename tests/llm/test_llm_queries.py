"""Registered training-data queries: DuckDB oracles, the pipeline and empty tables."""

import re

import duckdb
import pytest

import corpus_pipeline
from oracle_check import compare
from qualityspark.llm import common, packing, queries
from test_llm_operators import SPACE, brute_components, brute_hits, brute_spans, low

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    ok, why = compare(queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df())
    assert ok, why


def test_all_queries():
    names = sorted(queries.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, tmp_path, name):
    for t in TABLES:
        common.table(spark, SF, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    docs = common.table(spark, SF, "documents").limit(120)
    extra = spark.createDataFrame([(10 ** 6, None, "en", "s", 0), (10 ** 6 + 1, "", "en", "s", 0), (10 ** 6 + 2, "12 %%", "en", "s", 5),
                                   (10 ** 6 + 3, docs.first().text, "en", "s", 9)], docs.schema)
    docs = common.materialize(docs.unionByName(extra))
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, SF))
        if name != "packing":
            assert out.columns == docs.columns
            kept.append({r.doc_id: r.text for r in out.collect()})
            docs = out
    lang, near, clean, masked = kept
    assert set(text) - set(lang) >= {10 ** 6, 10 ** 6 + 1, 10 ** 6 + 2} and len(lang) >= len(text) - 5
    ids = sorted(lang)
    groups = {ids[c] for _, _, c in brute_components([lang[i] for i in ids], 5, 80)}
    assert set(near) == groups and 10 ** 6 + 3 not in near
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    assert set(clean) == {i for i, t in near.items() if not brute_hits(t, items)[1]}
    assert set(masked) == set(clean)
    for i, t in masked.items():  # only spans change
        parts = [re.escape(x) for x in t.split("<SECRET>")]
        assert re.fullmatch("[^ ]+(?: ?[:=] ?[^ ]+)?".join(parts), clean[i], re.S)
        assert len(parts) == 1 or brute_spans(clean[i]) or len(clean[i]) > len(t)
    packed = out.toPandas()
    assert packed.groupby("doc_id")["n_tokens"].sum().to_dict() == {i: len(SPACE.findall(low(t))) + 1 for i, t in masked.items()}
    assert packed.groupby("bin_id")["n_tokens"].sum().max() <= 2048 and not packed.duplicated(["bin_id", "source"]).any()
    assert packing.OUT.startswith("bin_id")
