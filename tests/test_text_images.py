"""Images of texts whose ZIP's checksum reads like something by chance: the engine's candidates are still those of the SQL."""

import duckdb
import pytest

from palimpsest import queries as q
from palimpsest.plans import engine
from palimpsest.sources import fixtures as fx


def _text(k: int, n: int) -> str:
    """A text of n letters (fixtures.lettered), by number."""
    size = (n - 64) // 2
    return (f"{k} " + "lorem " * (size // 6 + 2))[:size]


#: Number, letters and what stands in the checksum and size of the ZIP: a keyword, an address, a part of a spreadsheet.
CHANCE = [(14819, 366, b"Ssn"), (31108, 12334, b"2@m.0"), (648, 12140, b"xl/")]


@pytest.mark.parametrize("k, n, reads", CHANCE)
def test_letters_turn_while_the_checksum_reads_like_something(k, n, reads):
    body = fx.lettered(_text(k, n).encode())
    z, turned = fx._plain_zip(body)
    assert len(body) == n and reads in fx.zipped({"a.txt": body}) and reads not in z
    assert turned == body[1:] + body[:1] and z == fx.zipped({"a.txt": turned})


def test_sizes_that_read_like_something_end_the_turns():
    z, body = fx._plain_zip(b"ab" * 279934)  # the directory's place holds a GZIP's start, whatever the order of the letters
    assert b"\x1f\x8b\x08" in z and len(body) == 559868


def test_candidates_of_chance_texts_equal_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engine, "SENT", 0)  # clusters meet their bytes by a join, as in large tables
    rows = [(i, _text(k, n)) for i, (k, n, _) in enumerate(CHANCE * 2, 1)] + [(0, "plain"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(q.ORACLE_SQL["recovered_candidates"])
    found = q.QUERIES["recovered_candidates"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall()) and len(want.fetchall()) == 16
