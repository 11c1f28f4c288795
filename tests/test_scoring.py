"""Scorers over parts of batches."""
import json

import pandas as pd
import pyarrow as pa

from veilscan.operators import scoring


def test_a_scorer_gets_bounded_parts(spark, monkeypatch):
    """No call sees more than PART bytes but for a single longer text; every row is answered once."""
    texts = [None if i % 7 == 0 else "é" * (i * 40) for i in range(100)] + ["x" * 9000, ""]
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    part = 8000

    def run(scored):
        return {r.id: (r.raw, getattr(r, "backend", None)) for r in scored.collect()}

    def seen(s):
        return pd.Series([f'{{"rows": {len(s)}, "bytes": {sum(len((t or "").encode()) for t in s)}}}'] * len(s), index=s.index)

    monkeypatch.setattr(scoring, "PART", part)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    sizes = [(p.num_rows, sum(len((t or "").encode()) for t in p.column(1).to_pylist())) for p in scoring._parts([batch, batch.slice(0, 0)])]
    assert sum(n for n, _ in sizes) == len(texts) and len(sizes) > 20 and all(b <= part or n == 1 for n, b in sizes)
    monkeypatch.undo()
    for got in (run(scoring.score_texts(df, "id", "text", seen)), run(scoring.score_in_turn(df, "id", [("seen", seen)]))):
        assert set(got) == {i if i else None for i in range(len(texts))} and all(json.loads(v[0])["rows"] > 0 for v in got.values())
