"""The registered queries and the pipeline on the smallest tables, each stage against its operator."""

import duckdb
import pytest

import corpus_pipeline
from keelstate.llm import common, decontaminate, near, pii, queries, toxicity
from tests.llm.test_pii import slow
from tests.test_catalog import TABLES, plain


def test_ten_operators_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_answers_every_row(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    docs = {r.doc_id for r in common.table(spark, sf_dir, "documents").select("doc_id").collect()}
    if name == "op4_warc":
        assert len(rows) == 2 * common.table(spark, sf_dir, "pages").count()
    elif name == "op3_secrets":
        assert {r.doc_id for r in rows} <= docs
    else:
        assert {r.doc_id for r in rows} == docs


def test_stages(spark, sf_dir, tmp_path):
    docs = common.table(spark, sf_dir, "documents")
    before, kept = docs, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, before, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        if number < 4:
            assert after.columns == docs.columns and after.schema == docs.schema
        kept.append((before, after))
        before = after

    def ids(frame):
        return {r.doc_id for r in frame.select("doc_id").collect()}

    labels = common.table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).filter("predicted = 1")
    assert ids(kept[0][0]) - ids(kept[0][1]) == ids(scored)
    groups = {r.component_id for r in near.clusters(kept[1][0]).collect()}
    assert ids(kept[1][1]) == groups
    bad = decontaminate.scan(kept[2][0], common.table(spark, sf_dir, "benchmark")).filter("n_items > 0")
    assert ids(kept[2][0]) - ids(kept[2][1]) == ids(bad)
    assert ids(kept[3][0]) == ids(kept[3][1])
    for r in kept[3][1].collect():
        assert not slow(r.text) and r.n_chars == len(r.text)
    assert ids(kept[4][1]) == ids(kept[3][1])
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == ids(kept[3][1])
    assert pii.KINDS[:4] == pii.BASE
