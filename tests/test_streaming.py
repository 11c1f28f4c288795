"""Streaming jobs over tables stored as one file or as a folder of part files."""
import pytest

from veilscan.plans.q_stream import q_st_page_signals, streaming_log
from veilscan.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("files", [1, 3])
def test_page_signals_of_a_table_in_parts(spark, tmp_path, files):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.repartition(files).write.parquet(str(tmp_path / "pages.parquet"))
    pages.limit(1).write.parquet(str(tmp_path / "other.parquet"))
    want = sorted(map(tuple, q_st_page_signals(spark, SF).collect()))
    assert sorted(map(tuple, q_st_page_signals(spark, str(tmp_path)).collect())) == want and len(want) == pages.count()


def test_events_of_a_table_in_parts(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    out = []
    for i, d in enumerate((SF, str(tmp_path))):
        state = jobs.current_state(spark, jobs.stream_site_evidence(spark, streaming_log(spark, d), str(tmp_path / f"out{i}")))
        out.append(sorted(map(tuple, state.select("site", "step_count", "n_urgency_texts").collect())))
    assert out[0] == out[1] and out[0]
