"""Sources that reach their stop."""

from __future__ import annotations

import duckdb

from doclith.llm import mixing


def test_a_source_at_its_stop_takes_no_row_once_more(spark, tmp_path):
    rows = [(i, "" if i % 3 else "one two", "a") for i in range(60)] + [(100 + i, "many words here " * 40, "b") for i in range(30)] + [(200 + i, None, None) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert {r.copies for r in got if r.doc_id < 60} == {3} and all(r.copies <= 3 and r.taken == r.size * r.copies for r in got)
    assert {r.copies for r in mixing.mixed_rows(df).collect() if r.doc_id < 60} == {3}
    df.write.parquet(str(tmp_path / "d"))
    want = duckdb.sql(mixing.oracle_sql(f"'{tmp_path}/d/*.parquet'")).fetchall()
    names = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(want)
