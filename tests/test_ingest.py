"""Monthly block ingest: positional parse, typing rules, year filter,
metadata, lock files, duplicates, streaming file source."""

import pytest
from pyspark.sql import functions as F

from qualityspark.schema import RAW_COLUMNS
from qualityspark.sources.monthly import load_raw_inputs, model_source, read_blocks


def _row(date, **cells):
    vals = {c: "" for c in RAW_COLUMNS}
    vals["date"] = date
    vals.update(cells)
    return "x," + ",".join(f'"{vals[c]}"' for c in RAW_COLUMNS)


def _block(rows):
    lead = ["title,,", "plant,,", ",,", "header," + ",".join(RAW_COLUMNS)]
    return "\n".join(lead + rows) + "\n"


@pytest.fixture()
def folder(tmp_path):
    a = [_row("2023-08-01", feed_p_ppm="12.5", feed_ffa_pct=" 3.1 ", feed_tank=" t 1 ", feed_type="nan"),
         _row("2023-08-02", feed_p_ppm="STOP", feed_ffa_pct=" plant stopped ", feed_tank="None", feed_type="A B"),
         _row("not a date", feed_p_ppm="9"),
         _row("2023-08-03", feed_p_ppm="1.5d", feed_ffa_pct="1,234", feed_iv="INF", feed_dobi="NAN")]
    b = [_row("2024-01-05", feed_p_ppm="7"), _row("05/01/2024", feed_p_ppm="8")]
    (tmp_path / "2023_08.csv").write_text(_block(a))
    (tmp_path / "2024_01.csv").write_text(_block(b))
    (tmp_path / "~$2024_01.csv").write_text(_block(b))          # office lock file: ignored
    (tmp_path / "notes.md").write_text("not a block")             # other suffix: ignored
    return tmp_path


def test_read_and_type(spark, folder):
    raw = read_blocks(spark, [str(folder), str(folder)])          # duplicate input path
    assert raw.count() == 6
    typed, meta = load_raw_inputs(spark, [str(folder)])
    rows = {(r["source_file"], r["row_pos"]): r for r in typed.collect()}
    assert len(rows) == 5                                          # invalid date dropped
    r1 = rows[("2023_08.csv", 4)]
    assert r1["feed_p_ppm"] == 12.5 and r1["feed_ffa_pct"] == 3.1
    assert r1["feed_tank"] == "T1" and r1["feed_type"] is None
    r2 = rows[("2023_08.csv", 5)]
    assert r2["feed_p_ppm"] is None and r2["feed_ffa_pct"] is None
    assert r2["feed_tank"] == "NONE" and r2["feed_type"] == "AB"
    r4 = rows[("2023_08.csv", 7)]
    assert r4["feed_p_ppm"] is None and r4["feed_ffa_pct"] is None
    assert r4["feed_iv"] == float("inf") and r4["feed_dobi"] is None
    assert rows[("2024_01.csv", 5)]["date"].day == 5              # dd/MM/yyyy spelling
    m = meta.first()
    assert m["rows_loaded_before_year_filter"] == 5 and m["rows_after_year_filter"] == 5
    assert m["years_present"] == "2023,2024"
    assert set(model_source(typed).columns) == set(RAW_COLUMNS) | {"source_file"}


def test_positions_do_not_depend_on_byte_ranges(spark, tmp_path):
    """One file in many ranges, with blank lines, carriage returns and no last line end, beside a small one."""
    lines = ["lead"] * 4 + ["" if i % 17 == 3 else _row(f"2023-01-{i % 28 + 1:02d}", feed_p_ppm=str(i)) for i in range(4, 900)]
    (tmp_path / "big.csv").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "small.csv").write_text("\n".join(lines[:40]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        # the folder, a file of it and a pattern that names the other: each line once
        got = read_blocks(spark, [str(tmp_path), str(tmp_path / "big.csv"), str(tmp_path / "s*.csv")]).select(
            "source_file", "row_pos", "feed_p_ppm").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [("big.csv", i, str(i)) for i in range(4, 900) if i % 17 != 3] + [("small.csv", i, str(i)) for i in range(4, 40) if i % 17 != 3]
    assert sorted(map(tuple, got)) == sorted(want)


def test_one_file_is_many_tasks(spark, tmp_path):
    from qualityspark.sources.monthly import _lines
    (tmp_path / "big.csv").write_text(_block([_row("2023-01-01", feed_p_ppm=str(i)) for i in range(2000)]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        assert _lines(spark, [str(tmp_path)]).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_year_filter(spark, folder):
    typed, meta = load_raw_inputs(spark, [str(folder)], year_filter="2024")
    assert typed.count() == 2
    assert meta.first()["years_present"] == "2024"
    with pytest.raises(ValueError):
        load_raw_inputs(spark, [str(folder)], year_filter="1999; 2001")


def test_streaming_ingest(spark, folder, tmp_path_factory):
    from qualityspark.streaming import start_monthly_ingest
    out = tmp_path_factory.mktemp("out")
    ck = tmp_path_factory.mktemp("ck")
    q = start_monthly_ingest(spark, str(folder), str(out / "t"), str(ck / "c"), once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(out / "t"))
    assert got.count() == 5
    assert got.where(F.col("year") == 2024).count() == 2


def test_materialize_and_cleanup(spark):
    from qualityspark.session import cleanup_scratch, materialize
    df = materialize(spark.range(10).withColumnRenamed("id", "x"))
    assert df.count() == 10
    assert cleanup_scratch(spark)
    assert not cleanup_scratch(spark)          # nothing left to delete
