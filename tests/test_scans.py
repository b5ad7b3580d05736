"""File scans: archive directories, page texts under a byte budget, statuses."""

import pytest
from pyspark.sql import functions as F

from hushgrid.operators import scans
from hushgrid.plans.scans import archive, broken_archive, patched
from hushgrid.sources import archives, files

PAGES = "f long, page int, text string, failed boolean"


def pages(spark, rows, **k):
    d = spark.createDataFrame(rows, PAGES)
    return {r.f: (r.text, r.reason, r.pages_with_text, r.pages_without_text) for r in files.page_texts(d, ["f"], **k).collect()}


def cut(pages_, limit, most=20):
    """The plain form: pages of one file in order."""
    out, done, full, blank, why = b"", 0, 0, 0, None
    for _, text, failed in pages_[:most]:
        done += 1
        if failed:
            why = "parse_failed"
            break
        text = (text or "").strip(files.BLANKS)
        if not text:
            blank += 1
            continue
        full += 1
        gap = b"\n\n" if out else b""
        room = limit - len(out) - len(gap)
        piece = text.encode()[: max(room, 0)].decode("utf-8", "ignore").encode()
        out += gap + piece if piece else b""
        if len(text.encode()) > room:
            why = "text_limit"
            break
    skipped = len(pages_) - done
    return out.decode(), why or ("page_limit" if skipped else "pdf_without_text" if not full else "pdf_text_layer_only"), full, blank + skipped


@pytest.mark.parametrize("limit", [0, 3, 5, 7, 12, 40])
def test_page_texts_equal_the_plain_form(spark, limit):
    texts = ["aé", " 　", "中文𠀀", None, "𠀀", "x" * 9, "", "é" * 3]
    given = {k: [(i + 1, texts[(i * (k + 1) + k) % len(texts)], k % 3 == 2 and i == k) for i in range(k)] for k in range(1, 9)}
    got = pages(spark, [(k, *row) for k, rows in given.items() for row in rows], limit=limit, most=6)
    assert got == {k: cut(rows, limit, 6) for k, rows in given.items()}


def test_no_pages(spark):
    assert pages(spark, []) == {}
    given = spark.createDataFrame([(1, b"%PDF", "pdf", None)], "f long, content binary, format string, reason string")
    for layer in (None, spark.createDataFrame([], PAGES)):
        e = files.extract(given, ["f"], layer).first().extracted
        assert (e.text, e.coverage, e.reason) == ("", "partial", "pdf_without_text")


def test_directory_of_a_plain_archive():
    data = archive([("a.xml", "x" * 50), ("b/", "")]) + b""
    total, whole, entries = archives.read_directory(data)
    assert (total, whole, [(e[0], e[3]) for e in entries]) == (2, True, [("a.xml", 50), ("b/", 0)])
    assert archives.read_directory(None) == archives.read_directory(b"") == archives.read_directory(b"PK\5\6") == (None, False, [])
    assert archives.read_directory(data + b"junk" * 100)[0] == 2  # a comment may follow
    assert archives.read_directory(b"PK\5\6" + data[:-1])[0] is None


def test_first_fault_decides(spark):
    two = archive([("word/a.xml", "a"), ("word/b.xml", "b")])
    wide_then_cut = patched(patched(two, 0, 20, "<II", 1, 2000), 1, 0, "<I", 0)
    cut_then_wide = patched(patched(two, 1, 20, "<II", 1, 2000), 0, 8, "<H", 1)
    late = patched(two, 1, 0, "<I", 0)
    rows = [("docx", x) for x in (two, wide_then_cut, cut_then_wide, late, None)] + [("xlsx", broken_archive(13)), ("xlsx", patched(two, 0, 20, "<II", 600_000, 600_000))]
    d = spark.createDataFrame([(i, f, x) for i, (f, x) in enumerate(rows)], "i int, f string, c binary")
    got = [r.why for r in d.select("i", archives.fault(archives.directory(F.col("c")), F.col("f")).alias("why")).orderBy("i").collect()]
    assert got == [None, "text_limit", "parse_failed", "parse_failed", "parse_failed", None, None]


def test_data_that_belies_its_directory(spark):
    """A passed directory over data that can't be unpacked is a failed file, not a failed job."""
    data = bytearray(archive([("word/a.xml", "hello " * 99)]))
    data[40:50] = b"\xff" * 10
    given = spark.createDataFrame([(1, bytes(data), "docx", None), (2, None, "docx", None), (3, None, "text", None), (4, b"", "text", None)], "f long, content binary, format string, reason string")
    got = {r.f: (r.extracted.text, r.extracted.reason) for r in files.extract(given, ["f"]).collect()}
    assert got == {1: (None, "parse_failed"), 2: (None, "parse_failed"), 3: (None, "parse_failed"), 4: ("", None)}


def test_statuses(spark):
    schema = "f long, format string, extracted struct<text:string,coverage:string,reason:string>"
    mail, ask = "mail a.b@example.com now", "我叫李建国，你好"
    rows = [
        (1, "text", ("clean", "complete", None)), (2, "text", (mail, "complete", None)), (3, "text", (ask, "complete", None)), (4, "docx", (ask, "partial", "embedded_media")),
        (5, "pdf", (ask, "partial", "page_limit")), (6, "pdf", (mail, "partial", "pdf_text_layer_only")), (7, "text", ("x" * 101, "complete", None)), (8, "docx", (None, "none", "parse_failed")),
        (9, "text", ('password="abc def"', "complete", None)), (10, "text", ("", "complete", None)), (11, "text", ("blue term", "complete", None)),
    ]
    out = scans.scan(spark.createDataFrame(rows, schema), ["f"], terms=["blue"], limit=100)
    got = {r.f: (r.status, r.coverage, r.reason, r.secondary, r.n, r.outbound_text) for r in out.collect()}
    assert got == {
        1: ("clean", "complete", None, None, 0, None), 2: ("sensitive", "complete", None, None, 1, "mail [[EMAIL_001]] now"),
        3: ("partial", "partial", "review_required", None, 1, "我叫[[PERSON_001]]，你好"), 4: ("partial", "partial", "review_required", "embedded_media", 1, "我叫[[PERSON_001]]，你好"),
        5: ("partial", "partial", "page_limit", None, 1, None), 6: ("partial", "partial", "pdf_text_layer_only", None, 1, None),
        7: ("unscannable", "none", "text_limit", None, 0, None), 8: ("unscannable", "none", "parse_failed", None, 0, None),
        9: ("sensitive", "complete", None, None, 1, None), 10: ("clean", "complete", None, None, 0, None), 11: ("sensitive", "complete", None, None, 1, got[11][5]),
    }
    assert "blue" not in got[11][5]
    assert scans.scan(spark.createDataFrame([], schema), ["f"]).count() == 0
