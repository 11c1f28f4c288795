"""Registered queries against their SQL; the pipeline's stages against their own rules."""
import duckdb
import pytest
from compare import TABLES, rows_of
from pyspark.sql import functions as F
from test_documents import shingle_set
from test_models import brute_windows, words_of

import corpus_pipeline
from veilscan.llm.queries import QUERIES, SQL
from veilscan.llm.store import Store, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    want, cols = cur.fetchall(), [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, want)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    store = Store(spark, "t")
    docs, tables = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = store.save(stage(spark, docs, SF), "stage")
        tables.append({r[0]: r for r in docs.collect()} if name != "packing" else docs.collect())
        assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS
    first = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    good, lines, near, clean, packed = tables
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert all(good[i] == first[i] for i in good)
    known = [i for i in first if i in labels]
    assert sum((i in good) == bool(labels[i]) for i in known) >= 0.97 * len(known)
    seen = set()
    for i in sorted(lines):
        own = [" ".join(words_of(x)) for x in (lines[i].text or "").split("\n")]
        own = [x for x in own if x]
        assert not seen & set(own) and len(set(own)) == len(own)
        seen |= set(own)
        assert set((lines[i].text or "").split("\n")) <= set((good[i].text or "").split("\n"))
    assert seen >= {" ".join(words_of(x)) for r in lines.values() for x in (r.text or "").split("\n")} - {""}
    sets = {i: shingle_set(r.text) for i, r in lines.items()}
    ids = sorted(i for i in near if sets[i])
    assert not [1 for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    windows = brute_windows([(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    sizes = {len(w) for w in windows}
    for i, r in near.items():
        w = words_of(r.text)
        dirty = any(tuple(w[p:p + k]) in windows for k in sizes for p in range(len(w) - k + 1))
        assert (i in clean) == (not dirty)
    assert {r.doc_id for r in packed} == set(clean)
    rows = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, packed))
    assert rows.agg(F.countDistinct("doc_id")).first()[0] == len(clean)
