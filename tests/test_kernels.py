import io
import struct
import zipfile

import numpy as np
import pytest

from hushgrid.operators import neural
from hushgrid.sources import files

LABELS = ["O", "B-PERSON", "I-PERSON", "E-PERSON", "B-ADDRESS", "I-ADDRESS", "E-ADDRESS"]


def logits(tags, high=8.0):
    x = np.zeros((len(tags), len(LABELS)))
    for i, t in enumerate(tags):
        x[i, LABELS.index(t)] = high
    return x


def test_decoding_keeps_tag_order():
    assert neural.decode_tags(logits(["O", "B-PERSON", "I-PERSON", "E-PERSON", "O"]), LABELS) == ["O", "B-PERSON", "I-PERSON", "E-PERSON", "O"]
    assert "I-PERSON" not in neural.decode_tags(logits(["O", "I-PERSON", "O"]), LABELS)
    assert neural.decode_tags(np.zeros((0, 7)), LABELS) == []
    assert neural.decode_tags(logits(["B-PERSON", "E-PERSON"]), LABELS, np.array([False, False])) == ["O", "O"]


def test_spans_of_tags():
    text = "请联系张默言确认"
    offs = [(i, i + 1) for i in range(len(text))]
    tags = ["O"] * 3 + ["B-PERSON", "I-PERSON", "E-PERSON"] + ["O"] * 2
    assert neural.tag_spans(text, tags, offs, [0.9] * 8, 0.5) == [(3, 6, "PERSON")]
    assert neural.tag_spans(text, tags, offs, [0.4] * 8, 0.5) == []
    two = ["B-PERSON", "I-PERSON", "E-PERSON", "B-PERSON", "E-PERSON"]
    assert neural.tag_spans("张默言李雷", two, offs[:5], [0.9] * 5, 0.5) == [(0, 3, "PERSON"), (3, 5, "PERSON")]


@pytest.mark.parametrize("tokens, count, last", [(251, 1, 251), (416, 2, 226), (832, 5, None), (1662, 9, None)])
def test_windows(spark, tokens, count, last):
    rows = neural.plan_windows(spark.createDataFrame([(tokens,)], "n int"), "n").orderBy("window").collect()
    assert len(rows) == count and rows[-1].token_to == tokens
    assert last is None or rows[-1].token_to - rows[-1].token_from == last


def test_manifest():
    good = {"labels": {"0": "O"}, "threshold": 0.15, "max_length": 256, "stride": 64}
    assert neural.check_manifest(good) == good
    for bad in ({"threshold": 0}, {"max_length": 2}, {"stride": 254}, {"labels": {}}):
        with pytest.raises(ValueError):
            neural.check_manifest(good | bad)


def test_charsets():
    assert files.decode_text("中文".encode("gb18030")) == "中文"
    assert files.decode_text("中文".encode()) == "中文"
    assert files.decode_text("hello there".encode("utf-16-le")) == "hello there"
    assert files.decode_text(b"\xff\xfe" + "hi".encode("utf-16-le")) == "hi"
    assert files.looks_binary(b"a\0b") and not files.looks_binary(b"plain\n") and not files.looks_binary(b"") and files.looks_binary(b"\x01" * 5 + b"a" * 95)
    assert files.truncate_utf8("é" * 5, 5) == "éé"


def office(**parts):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x").replace("_p", ".p"), text)
    return buf.getvalue()


def test_office():
    data = office(word__document_xml='<w:t>Tom &amp; Ann</w:t><a href="http://x">y</a>')
    assert files.office_text(data, "docx", ["word/document.xml"]) == ("http://x Tom & Ann y", "complete", None)
    assert files.office_text(data, "xlsx", ["word/document.xml"])[2] == files.office_text(data, "docx", [])[2] == "parse_failed"
    assert files.office_text(office(word__document_xml="<t>a</t>", word__media__a_png="x"), "docx", ["word/document.xml"])[1:] == ("partial", "embedded_media")


def test_images():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    jpg = b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 30, 20) + b"\0" * 6
    exif = b"Exif\0\0II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
    turned = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + jpg[2:]
    assert files.image_size(png) == (640, 480) and files.image_size(jpg) == (20, 30) and files.image_size(b"") is None
    assert files.upright(jpg) and not files.upright(turned)


def test_files_are_read_and_extracted(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("hello")
    (tmp_path / "b.bin").write_bytes(b"\0")
    (tmp_path / "c.docx").write_bytes(office(word__document_xml="<t>doc</t>"))
    (tmp_path / "d.jsonl").write_text('{"id":"1","text":"x","entities":[{"start":0,"end":1,"label":"P","text":"x"}]}\n\n')
    got = {r.path.rsplit("/", 1)[1]: (r.extracted.text, r.extracted.reason) for r in files.extract(files.read_files(spark, str(tmp_path))).collect()}
    assert got["a.TXT"] == ("hello", None) and got["b.bin"] == (None, "unsupported_format") and got["c.docx"] == ("doc", None)
    assert files.read_jsonl(spark, str(tmp_path / "d.jsonl")).count() == 1
