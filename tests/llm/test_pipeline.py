"""The registered queries against SQL, and the pipeline's stages against plain Python."""

import os

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import queries
from tessera.testing import plain
from tests.llm.test_operators import documents, sets_of

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = queries.queries()[name](spark, D)
    names = sorted(df.columns)
    c = duckdb.connect()
    p = f"{D}/documents.parquet"
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    want = c.sql(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert plain(df.select(*names).collect()) == plain(want)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, D).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        old, new = {x.doc_id: x.text for x in before.collect()}, {x.doc_id: x for x in after.collect()}
        assert set(new) <= set(old) and len(new) > 0.5 * len(old)
        if name == "mixing":
            assert len(new) == len(old) and all(x.taken <= 2 * x.size for x in new.values())
        else:
            assert after.columns == columns
        if name in ("quality", "near_duplicates", "decontamination"):
            assert all(new[i].text == old[i] for i in new)
        if name == "near_duplicates":
            sets = {i: sets_of(t, 5) for i, t in old.items()}
            links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
            parent = {i: i for i in old}

            def root(x, parent=parent):
                while parent[x] != x:
                    x = parent[x]
                return x

            for i, j in links:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
            assert set(new) == {i for i in old if root(i) == i}
        before = after


def test_stages_on_odd_tables(spark):
    odd = documents(spark, [None, "", "word", (None, "word word"), (3, "word"), (3, "word"), "A text that says some plain thing here " * 3])
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.limit(0)):
            got = stage(spark, df, D)
            assert name == "mixing" or got.columns == df.columns
            got.collect()
