"""Files, packages and the landing stream; the entry module without its separable part."""

from __future__ import annotations

import subprocess
import sys
import zipfile
from io import BytesIO
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirework.operators import segment, text
from quirework.sources import epub, files, pagexml, plaintext, providers
from quirework.streaming.landing import process_landing

ROOT = Path(__file__).resolve().parent.parent


def test_books_round_trip(spark):
    sections = [("One & two", [("Heading", "One & two"), ("Text", "A <b> c")]), (None, [("Text", "second")])]
    asset = b"GIF89a"
    import hashlib

    book = epub.make_book("T", "en", "id", sections, [("i.gif", "image/gif", asset, hashlib.sha256(asset).hexdigest())])
    got = epub.read_book(book)
    assert got["error"] is None and (got["title"], got["language"]) == ("T", "en")
    assert [b[2:4] for b in got["blocks"]] == [("Heading", "One & two"), ("Text", "A <b> c"), ("Heading", "second")]  # the contents promote the first block
    with pytest.raises(ValueError):
        epub.make_book("T", "en", "id", sections, [("i.gif", "image/gif", asset, "0" * 64)])
    rows = spark.createDataFrame([(1, book), (2, b"%PDF-1.4"), (3, b"junk"), (4, None), (5, b"")], "doc_id long, content binary")
    kinds = {r.doc_id: (r.format_status, r.format) for r in files.select_format(rows).collect()}
    assert kinds == {1: ("Recognized", "epub"), 2: ("Recognized", "pdf"), 3: ("NotRecognized", None), 4: ("NotRecognized", None), 5: ("NotRecognized", None)}
    both = files.select_format(rows, {"a": files.is_pdf, "b": files.is_pdf})
    assert {r.doc_id: r.format_status for r in both.collect()}[2] == "Ambiguous"
    errors = {r.doc_id: r.error is None for r in epub.read_books(rows).collect()}
    assert errors == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_packages_that_leave_the_archive():
    assert epub.safe_path("OPS/a.xhtml", "../img/b.png#x") == "img/b.png"
    for bad in ("../../x", "/etc/passwd", "http://x/y", "a\\b", "", "#f"):
        assert epub.safe_path("OPS/a.xhtml", bad) is None, bad
    raw = BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("../evil", "x")
    assert "leaves the archive" in epub.read_book(raw.getvalue())["error"]


def test_markup_blocks():
    page = '<html><head><title>no</title></head><body><h1 id="a">T <i>x</i></h1><script>bad()</script><p>one<p>two &amp; three<ul><li>l1<li>l2</ul><figure><img src="f.png" alt=""><figcaption>cap</figcaption></figure><img src="g.png" role="presentation">'
    got = epub.parse_markup(page)
    assert got.blocks == [("Heading", "T x", "a"), ("Text", "one", None), ("Text", "two & three", None), ("Text", "l1", None), ("Text", "l2", None), ("Caption", "cap", None)]
    assert got.images == [("f.png", True, False, True), ("g.png", False, True, False)]
    assert epub.parse_markup("<body>loose <b>text</b></body>").blocks == [("Text", "loose text", None)]
    assert epub.parse_markup(None).blocks == []


def test_spool(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 1, "Text"), (1, 2, "Figure")], "doc_id long, page_no int, kind string")
    files.write_spool(boxes, f"{tmp_path}/s")
    assert sorted(files.read_spool(spark, f"{tmp_path}/s").collect()) == sorted(boxes.collect())
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_spool(boxes, f"{tmp_path}/s")
    files.write_spool(boxes.withColumn("kind", F.lit("Other")), f"{tmp_path}/bad")
    with pytest.raises(Exception, match="bad spool row"):
        files.read_spool(spark, f"{tmp_path}/bad").collect()


def test_landing_stream_equals_the_batch(spark, tmp_path):
    rows = [(i, "\n".join(f"line {j} of {i}" for j in range(20)), "en", "s", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/in")
    run = lambda d: segment.segments(text.normalize_blocks(plaintext.blocks(d)))
    process_landing(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", run, files_per_batch=1, once=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(got.collect()) == sorted(run(docs).collect())


def test_entry_without_the_training_operators(tmp_path):
    code = "import sys; sys.modules['quirework.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'segments_native' in q and not any(k.startswith('op') or k == 'pipeline' for k in q if k[2:3].isdigit() or k == 'pipeline'); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
    source = "\n".join(p.read_text() for p in (ROOT / "quirework").rglob("*.py") if "llm" not in p.parts)
    assert "quirework.llm" not in source


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


PAGE = '<PcGts xmlns="urn:x"><Page><ReadingOrder><OrderedGroup>{order}</OrderedGroup></ReadingOrder>{regions}</Page></PcGts>'


def _region(name, own="", lines=()):
    equiv = lambda t: f"<TextEquiv><Unicode>{t}</Unicode></TextEquiv>" if t else ""
    return f'<TextRegion id="{name}" type="paragraph">{equiv(own)}' + "".join(f"<TextLine>{equiv(t)}</TextLine>" for t in lines) + "</TextRegion>"


def _ref(index, name):
    return f'<RegionRefIndexed index="{index}" regionRef="{name}"/>'


@pytest.mark.parametrize(
    ("order", "regions", "want"),
    [
        ([(10, "b"), (2, "a")], [("a", " own  text ", ("line",)), ("b", "", ("one ", "", " two"))], [(2, "a", "own text"), (10, "b", "one two")]),
        ([], [("a", "x", ())], "no reading order"), ([(0, "z")], [("a", "x", ())], "isn't a text region"), ([(0, "a")], [("a", "", (" ",))], "no text"), ([(0, "a")], [("a", "x", ()), ("b", "y", ())], "not in the order"),
        ([(0, "a")], [("a", "x", ()), ("b", "", ())], [(0, "a", "x")]),
    ],
)
def test_page_xml(spark, order, regions, want):
    content = PAGE.format(order="".join(_ref(*o) for o in order), regions="".join(_region(*r) for r in regions))
    rows = spark.createDataFrame([(1, bytearray(content.encode())), (2, bytearray(b"<a>")), (3, None)], "doc_id long, content binary")
    got = pagexml.read_regions(rows).collect()
    mine = [r for r in got if r.doc_id == 1]
    if isinstance(want, str):
        assert len(mine) == 1 and want in mine[0].error and mine[0].reference is None
    else:
        assert [(r.idx, r.region_id, r.reference) for r in mine] == want
    assert [r.error is not None for r in got if r.doc_id > 1] == [True, True]


def test_assets_written_and_read(spark, tmp_path):
    write, read = files.folder_assets(f"file://{tmp_path}/assets")
    assets = spark.createDataFrame([("a", bytearray(b"one")), ("a", bytearray(b"one")), ("b/../c", bytearray(b""))], "asset_id string, content binary")
    files.write_assets(assets, write)
    got = files.read_assets(spark.createDataFrame([("a",), ("b/../c",), ("none",)], "asset_id string"), read).collect()
    assert {r.asset_id: r.content and bytes(r.content) for r in got} == {"a": b"one", "b/../c": b"", "none": None}


def test_provider_limits(spark):
    import time

    def fake(content: bytes) -> bytes:
        if content == b"slow":
            time.sleep(3)
        if content == b"bad":
            raise ValueError("no")
        return content * (100 if content == b"long" else 1)

    rows = [(i, bytearray(x) if x is not None else None) for i, x in enumerate([b"ok", b"slow", b"bad", b"long", b"x" * 60, None])]
    asked = providers.ask(spark.createDataFrame(rows, "k long, image binary"), "image", fake, providers.Limits(seconds=0.5, most_in=50, most_out=100))
    got = {r.k: (r.provider_status, r.answer and bytes(r.answer)) for r in asked.collect()}
    assert got == {0: ("Completed", b"ok"), 1: ("TimedOut", None), 2: ("Failed", None), 3: ("OutputTooLarge", None), 4: ("InputTooLarge", None), 5: ("Completed", b"")}


def test_process_provider_and_commands():
    assert providers.process_provider(["cat"])(b"abc") == b"abc"
    with pytest.raises(RuntimeError, match="exit code"):
        providers.process_provider(["false"])(b"")
    options = providers.Options(engine_version="1.2", endpoints={"layout": "http://layout"})
    assert options.identities() == [("engine", "1.2"), ("layout", "http://layout"), ("rasterizer", "pdftoppm@300")]
    assert providers.raster_command(options, 3, (10, 20, 40, 60)) == ["pdftoppm", "-f", "3", "-l", "3", "-singlefile", "-r", "300", "-x", "10", "-y", "20", "-W", "30", "-H", "40", "-png", "-", "-"]


def test_single_layout_and_conformance(spark):
    answer = lambda n: '{"result":{"layoutParsingResults":[' + ",".join(['{"prunedResult":"{}"}'] * n) + "]}}"
    rows = [(n, "Completed", bytearray(answer(n).encode()), None) for n in range(3)] + [(3, "Completed", bytearray(b"no json"), None), (4, "TimedOut", None, "late")]
    got = {r.k: (r.provider_status, r.layout_json) for r in providers.single_layout(spark.createDataFrame(rows, "k long, provider_status string, answer binary, provider_error string")).collect()}
    assert got == {0: ("Failed", None), 1: ("Completed", "{}"), 2: ("Failed", None), 3: ("Failed", None), 4: ("TimedOut", None)}
    reports = spark.createDataFrame([(0, 0, 0), (1, 2, 0), (None, 0, 0), (9, 0, 0)], "code int, errors int, fatals int")
    outcome = providers.conformance_outcome(F.col("code"), F.col("errors"), F.col("fatals"))
    assert [r[0] for r in reports.select(outcome).collect()] == ["Conformant", "NonConformant", "Failed", "Failed"]


def test_bounded_dispatch(spark):
    events = [(1, i, e) for i, e in enumerate("submit submit submit take submit take take take stop submit take".split())] + [(2, 0, "take")]
    got = providers.dispatch(spark.createDataFrame(events, "queue long, at long, event string").repartition(3), 2).orderBy("queue", "at").collect()
    assert [r.outcome for r in got] == ["Enqueued", "Enqueued", "QueueFull", "Taken", "Enqueued", "Taken", "Taken", "Empty", "Stopping", "Stopped", "Empty", "Empty"]
    assert [r.held for r in got][:4] == [1, 2, 2, 1]


def test_evidence_follows_the_files(spark, tmp_path):
    from quirework.plans import evidence

    rows = lambda n: spark.createDataFrame([(i, "a line\nmore", "en", "s", 11) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    rows(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert evidence.norm_blocks(spark, str(tmp_path)).count() == 4
    rows(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert evidence.norm_blocks(spark, str(tmp_path)).count() == 6
    evidence.forget()
