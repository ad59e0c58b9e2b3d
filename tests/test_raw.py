from stackwise.session import scratch
from stackwise.sources import raw


def test_raw_sources_come_back_whole(spark):
    """Line ends, empty and null texts, and two rows of one id; the rows are written where they are."""
    rows = [(1, "a\nb\r\n"), (1, "été"), (2, ""), (3, None), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = scratch(spark, "raw")
    paths = raw.written(df, folder)
    got = [(r.doc_id, None if r.content is None else bytes(r.content).decode()) for r in raw.read(paths, folder).collect()]
    key = lambda r: (r[0], r[1] or "")
    assert sorted(got, key=key) == sorted(rows, key=key) and len({r.path for r in paths.collect()}) == 5
    assert "Exchange" not in raw.read(paths, folder)._jdf.queryExecution().executedPlan().toString()
