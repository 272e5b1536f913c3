"""SQL on odd texts: without a sign, missing, decomposed."""

from __future__ import annotations

import pytest

import quirework.queries as engine
from tests.test_oracles import plain


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Texts without a sign, missing, decomposed, and of lines without an end."""
    top = tmp_path_factory.mktemp("odd")
    heads = "\n".join(["Chapter 2", "the e\u0301nd", "A\u0300 une e\u0301tude 7", " ", "e\u0301" * 40])
    texts = ["", None, "e\u0301te\u0301 of the\n\u0301x", heads, "\n\n", "Title. Here\r\nthe end", "e\u0301" * 30 + "\n" + "word " * 60, heads * 8, "THE END"]
    rows = [(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts * 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{top}/documents.parquet")
    return str(top)


@pytest.mark.parametrize("name", ["prepared_sources", "normalized_blocks", "recurring_margins", "segments_native", "body_font_size", "document_quality", "segment_assignment", "hybrid_segments", "outline_alignment", "page_results"])
def test_odd_texts_equal_sql(spark, odd, name):
    duck = pytest.importorskip("duckdb").connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet/*.parquet')")
    frame = engine.QUERIES[name](spark, odd)
    columns = sorted(frame.columns)
    cursor = duck.execute(engine.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr) == want
