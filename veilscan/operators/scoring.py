"""Pluggable scorer: a user function over Arrow batches of texts.

The audited tool calls a model once per page. Here a scorer is any function
``pandas.Series[str] -> pandas.Series[str]`` (raw reply text per input); it
runs on the executors over at most ``PART`` bytes of text (or one text) at a time,
and its output is a ``(key, raw)`` table that feeds the same reply parsing as stored replies.
The default scorer applies the phrase lexicon and answers in the reply
format, so pipelines run end to end without any external service.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import dims

#: Bytes of text that a scorer gets at a time: Arrow batches count rows, whatever their texts weigh.
PART = 4 << 20


def _parts(batches):
    """Slices of the batches with at most ``PART`` bytes in the last column, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + PART, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def rule_scorer(languages=None):
    """Default scorer: lexicon phrases found in each text, as a JSON reply."""
    rows = dims.lexicon_rows(languages)
    cats = dims.CATEGORY_COLUMNS

    def score(texts: pd.Series) -> pd.Series:
        low = texts.fillna("").str.lower()
        found = {out: [[] for _ in range(len(low))] for out in cats.values()}
        for cat, _, _, phrase in rows:
            hit = low.str.contains(phrase.lower(), regex=False).to_numpy()
            for i in hit.nonzero()[0]:
                found[cats[cat]][i].append(phrase)
        out = []
        for i in range(len(low)):
            doc = {c: found[c][i] for c in cats.values()}
            doc["dark_pattern_hints"] = []
            doc["language_detected"] = "unknown"
            out.append(json.dumps(doc, ensure_ascii=False))
        return pd.Series(out, index=texts.index)

    return score


def score_texts(df: DataFrame, key: str, text_col: str = "text", scorer=None,
                raw_col: str = "raw") -> DataFrame:
    """(key, raw) replies of ``scorer`` for every row; runs per part of an Arrow batch."""
    fn = scorer or rule_scorer()
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        for part in _parts(batches):
            raw = pa.array(fn(part.column(1).to_pandas()).astype(object), pa.string(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([part.column(0), raw], names=[key, raw_col])

    return df.select(key, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"{key} {key_type}, {raw_col} string")


def is_object(reply) -> bool:
    """Whether a reply is one JSON object."""
    try:
        return isinstance(json.loads(reply), dict)
    except (TypeError, ValueError):
        return False


def score_in_turn(df: DataFrame, key: str, scorers: list, text_col: str = "text", valid=is_object) -> DataFrame:
    """(key, raw, backend, error): replies of several scorers (name, function), the next one only for rows still without a valid reply.

    A scorer that raises on a batch is asked row by row, so a failure stays with
    its row and never ends the job. ``error`` lists what each scorer before the
    one named by ``backend`` did wrong; without any valid reply raw and backend
    are null.
    """
    key_type = df.schema[key].dataType.simpleString()

    def one(fn, text):
        try:
            return fn(text).iloc[0], None
        except Exception as e:  # any failure of a user's scorer is the row's own
            return None, str(e) or type(e).__name__

    def ask(fn, texts):
        try:
            return [(r, None) for r in fn(texts)]
        except Exception:
            return [one(fn, texts.iloc[i:i + 1]) for i in range(len(texts))]

    def run(batches):
        for part in _parts(batches):
            n, texts = part.num_rows, part.column(1).to_pandas()
            raw, backend, errors, open_ = [None] * n, [None] * n, [[] for _ in range(n)], list(range(n))
            for name, fn in scorers:
                if not open_:
                    break
                still = []
                for i, (reply, error) in zip(open_, ask(fn, texts.iloc[open_])):
                    if error is None and valid(reply):
                        raw[i], backend[i] = reply, name
                    else:
                        errors[i].append(f"{name}: {error or 'no valid reply'}")
                        still.append(i)
                open_ = still
            out = [pa.array(x, pa.string(), from_pandas=True) for x in (raw, backend, ["; ".join(e) or None for e in errors])]
            yield pa.RecordBatch.from_arrays([part.column(0), *out], names=[key, "raw", "backend", "error"])

    return df.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"{key} {key_type}, raw string, backend string, error string")
