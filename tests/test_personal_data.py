import duckdb
import pytest

import __spark_entry__ as entry

TEXTS = [
    "call 555-123-4567 +1 555-765-4321 now", "555-123-4567 1 555-765-4321", "555-123-4567 555-123-4568 555-123-4569", "é555-123-4567é (555) 123-4567\n", "555 123-4567 or 555\x0b123-4567 ٥٥٥-123-4567",
    "née123-45-6789 123-45-6789é 10.0.0.1é ü10.0.0.1", "mail .a.b@c.org, -x@y.de; jó@b.org a@bücher.dé z@b.cé", "card 4111 1111 1111 1111é and 4111111111111111, 4111 1111 1111 1112", "١٢٣-45-6789", "12 4111111111111111 4111111111111111", "", None,
]


@pytest.mark.parametrize("name", ["pii_scrub", "redacted", "pii_detect", "pii_scrub_counts"])
def test_as_the_sql_has_it(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    frame = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    clean = lambda rows: {r[0]: tuple(r[1:]) for r in rows}
    got, want = clean(frame.collect()), clean(want)
    if name in ("pii_detect", "pii_scrub_counts"):  # a null text has no counts
        got.pop(11), want.pop(11)
    assert got == want
