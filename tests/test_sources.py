import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators.events import cached_listing
from docloom.operators.explorer import sort_items
from docloom.sources import files, office, sinks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def archive(parts, compression=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(*paragraphs, table=()):
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val=\'Heading1\'/></w:pPr>" if h else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for t, h in paragraphs)
    cells = "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in table)
    return archive({"word/document.xml": f"<w:document {W}><w:body>{body}{f'<w:tbl><w:tr>{cells}</w:tr></w:tbl>' if table else ''}</w:body></w:document>"})


def xlsx(cells):
    rows = "".join(f'<c r="{at}" t="inlineStr">{f"<f>{f}</f>" if f else ""}<is><t>{v}</t></is></c>' for at, v, f in cells)
    return archive(
        {
            "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData><row>{rows}</row></sheetData></worksheet>",
        }
    )


def pptx(title, cells):
    tbl = "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:txBody></a:tc>" for c in cells)
    slide = f"<p:sld {A}><p:txBody><a:p><a:r><a:t>{title}</a:t></a:r></a:p></p:txBody><a:tbl><a:tr>{tbl}</a:tr></a:tbl></p:sld>"
    return archive({"ppt/presentation.xml": f"<p:presentation {A}/>", "ppt/slides/slide1.xml": slide})


def shown(name, content):
    return json.loads(office.preview(name, content))


def test_previews():
    p = shown("sample.docx", docx(("Some paragraph", False), table=("a", "b")))
    assert "Some paragraph" in p["text"] and "a | b" in p["text"] and not p["truncated"]
    p = shown("large.xlsx", xlsx([("A1", "first", None), ("A1000000", "last", None)]))
    assert "first" in p["text"] and "last" not in p["text"] and p["truncated"]
    p = shown("sample.pptx", pptx("Title", ["x", "y"]))
    assert p["text"] == "Slide 1\nTitle\nx | y"
    assert shown("corrupted.docx", b"not a zip")["error"] == "invalid or corrupted"
    assert shown("unsafe.docx", archive({"word/document.xml": "a" * (1 << 20)}, zipfile.ZIP_DEFLATED))["error"] == "unsafe compression ratio"
    p = shown("long.docx", docx(("x" * 25_000, False)))
    assert len(p["text"]) == 20_000 and p["truncated"]
    assert shown("sample.txt", b"text")["error"] == "unsupported"
    assert shown("entity.docx", archive({"word/document.xml": '<!DOCTYPE x [<!ENTITY e "e">]><x>&e;</x>'}))["error"] == "invalid or corrupted"


def test_too_large_is_refused(monkeypatch):
    monkeypatch.setattr(office, "MOST_INPUT", 10)
    assert shown("large.docx", docx(("x", False)))["error"] == "too large"


def test_structures():
    w = office.word(docx(("Head", True), ("Body", False), table=("a", "b")))
    assert w == {"paragraphs": ["Head", "Body"], "headings": ["Head"], "tables": [[["a", "b"]]], "has_macros": False}
    e = office.excel(xlsx([("B2", "7", "SUM(A1)"), ("A1", "x", None)]))
    assert e["sheets"]["One"]["B2"] == {"value": "=SUM(A1)", "formula": "=SUM(A1)", "cached_value": "7", "display_value": "7"}
    assert office.sheet_rows(e["sheets"]["One"]) == [(1, [(1, "x")]), (2, [(2, "7")])]


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "docs" / "node_modules").mkdir(parents=True)
    (tmp_path / "docs" / "a.txt").write_text("plain é text")
    (tmp_path / "docs" / "b.docx").write_bytes(docx(("One", False), ("Two", False)))
    (tmp_path / "docs" / "c.xlsx").write_bytes(xlsx([("A1", "x", None), ("B1", "y", None), ("A2", "z", None)]))
    (tmp_path / "docs" / "d.pptx").write_bytes(pptx("Title", ["x", "y"]))
    (tmp_path / "docs" / "bad.docx").write_bytes(b"nope")
    (tmp_path / "docs" / "locked.docx").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1 rest")
    (tmp_path / "docs" / "e.md").write_text("not indexed")
    (tmp_path / "docs" / "~$a.docx").write_bytes(b"x")
    (tmp_path / "docs" / "node_modules" / "f.txt").write_text("ignored")
    found = {r["filename"] for r in files.scan(spark, [str(tmp_path)]).collect()}
    assert found == {"a.txt", "b.docx", "c.xlsx", "d.pptx", "bad.docx", "locked.docx"}
    read = files.read_documents(spark, [str(tmp_path)])
    texts, dead = read.where("reason is null"), read.where("reason is not null")
    assert {r["path"].rpartition("/")[2]: r["text"] for r in texts.collect()} == {"a.txt": "plain é text", "b.docx": "One Two", "c.xlsx": "x y\nz", "d.pptx": "Title\nx y"}
    assert {r["path"].rpartition("/")[2]: r["reason"] for r in dead.collect()} == {"bad.docx": "extract_error", "locked.docx": "password_protected"}
    listed = files.explorer(files.listing(spark, [str(tmp_path)])).select("name").collect()
    assert "e.md" in {r["name"] for r in listed}


def test_metadata_of_versions(spark, tmp_path):
    (tmp_path / "v1.json").write_text('{"version_id": "1", "summary": "ok"}')
    (tmp_path / "v2.json").write_text("{broken")
    (tmp_path / "v1.structure.json").write_text('{"version_id": "9"}')
    rows = files.read_metadata(spark, str(tmp_path), "version_id string, summary string").collect()
    assert [tuple(r) for r in rows] == [("1", "ok")]
    for name in ("profile", "2024_abce", "2024_abcd", "structure"):
        (tmp_path / f"{name}.json").write_text(f'{{\n "version_id": "{name}"\n}}')
    found = files.read_metadata(spark, str(tmp_path), "version_id string, summary string")
    assert {r["version_id"] for r in found.collect()} == {"1", "profile", "2024_abce", "2024_abcd", "structure"}
    assert found.count() == 5


def test_explorer_of_a_folder(spark):
    rows = [("/r/a.txt", "a.txt", 5, 1), ("/r/sub/b.txt", "b.txt", 9, 2), ("/r/sub/deep/c.txt", "c.txt", 7, 4), ("/r/.git/x", "x", 1, 1), ("/rest/d.txt", "d.txt", 1, 1)]
    listed = spark.createDataFrame(rows, "path string, filename string, modified_time long, size long")
    found = files.explorer(listed, folder="/r/")
    assert sorted(tuple(r) for r in found.collect()) == [("a.txt", "/r/a.txt", "file", ".txt", 1, 5), ("sub", "/r/sub", "folder", "", 0, 9)]
    assert {r["name"] for r in files.explorer(listed, True, "/r").collect()} == {"a.txt", "sub", ".git"}
    ordered = sort_items(found.withColumn("created", F.lit(None).cast("long")), "name").collect()
    assert [r["type"] for r in ordered] == ["folder", "file"]


def test_cached_listing_counts_from_the_last_read(spark):
    """Requests every 4 s against 5 s to live: read at 0, 8, 16 s; another key has reads of its own."""
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(k, "/a", at(4 * k)) for k in range(6)] + [(9, "/b", at(1)), (10, "/b", at(6)), (11, "/b", at(10.9))]
    requests = spark.createDataFrame(rows, "event_id long, path string, ts timestamp_ntz")
    found = {(r["path"], r["read_ts"]): r["served"] for r in cached_listing(requests, "path").collect()}
    assert found == {("/a", at(0)): 2, ("/a", at(8)): 2, ("/a", at(16)): 2, ("/b", at(1)): 1, ("/b", at(6)): 2}


def test_sinks_round_trip(spark, tmp_path):
    key = sinks.vault_key("password", b"salt")
    rows = spark.createDataFrame([("secret text é",)], "x string")
    assert sinks.unlock(sinks.lock(rows, "x", key), "x", key).select(F.decode("x", "UTF-8").alias("x")).first()["x"] == "secret text é"
    assert sinks.decrypt_text(sinks.encrypt_text(rows, "x", key), "x", key).first()["x"] == "secret text é"
    with pytest.raises(Exception, match="AES|tag|crypt"):
        sinks.unlock(sinks.lock(rows, "x", key), "x", sinks.vault_key("other", b"salt")).collect()


def test_created_time_roots_and_reasons(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("text")
    (tmp_path / "paper.pdf").write_bytes(b"%PDF words of a page")
    (tmp_path / "folder.txt").mkdir()
    stamped = files.with_created(files.listing(spark, [str(tmp_path)])).collect()
    assert all(abs(r["created_time"] - r["modified_time"]) < 60 for r in stamped) and len(stamped) == 2
    paths = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("a.txt", "none.txt", "folder.txt", "paper.pdf")], "path string")
    found = {r["path"].rpartition("/")[2]: (r["text"], r["reason"]) for r in paths.select("path", files.opened(F.col("path")).alias("x")).select("path", "x.*").collect()}
    assert found == {"a.txt": ("text", None), "none.txt": ("", "not_found"), "folder.txt": ("", "access_error"), "paper.pdf": ("", "extract_error")}
    assert office.access_reason(PermissionError()) == "permission_denied"
    locked = OSError("in use")
    locked.winerror = 32
    assert office.access_reason(locked) == "file_locked"
    assert files.default_roots("/home/x/") == ["/home/x/Desktop", "/home/x/Documents", "/home/x/Downloads"]
    assert files.default_roots("/home/x", "/a/:/b:/a") == ["/a", "/b"]
    monkeypatch.setitem(office.READERS, ".pdf", lambda content: content.decode()[5:])  # stands for a PDF library
    assert office.extract("paper.pdf", b"%PDF words of a page", 5) == ("words", None)
    assert json.loads(office.preview("paper.pdf", b"%PDF words"))["text"] == "words"


def exif(order, tags, further=()):
    """An EXIF block with these tags, and with further ones behind the tag that leads to them."""
    number = lambda x, n: x.to_bytes(n, order)
    entry = lambda tag, value: number(tag, 2) + number(4, 2) + number(1, 4) + number(value, 4)
    own = [entry(t, 7) for t in tags]
    at = 8 + 2 + 12 * (len(own) + bool(further)) + 4
    if further:
        own.append(entry(0x8769, at))
    block = (b"II" if order == "little" else b"MM") + number(42, 2) + number(8, 4) + number(len(own), 2) + b"".join(own) + number(0, 4)
    return block + (number(len(further), 2) + b"".join(entry(t, 7) for t in further) + number(0, 4) if further else b"")


def jpeg(block):
    body = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xda rest"


def test_photos_of_a_camera_are_not_read(monkeypatch):
    for name in (".jpg", ".jpeg", ".png"):
        monkeypatch.setitem(office.READERS, name, lambda content: "words of a scan")  # stands for an OCR library
    png = lambda block: b"\x89PNG\r\n\x1a\n" + len(block).to_bytes(4, "big") + b"eXIf" + block + b"crc0"
    for order in ("little", "big"):
        assert office.extract("a.jpg", jpeg(exif(order, [0x0100, 0x010F])), 99) == ("", None)
        assert office.extract("a.JPEG", jpeg(exif(order, [0x0100], [0x9000, 0xA434])), 99) == ("", None)
        assert office.extract("a.png", png(exif(order, [0x0131])), 99) == ("", None)
        assert office.extract("a.jpg", jpeg(exif(order, [0x0100], [0x9000])), 99) == ("words of a scan", None)
    loop = exif("little", [], [0x9000])
    for content in (b"", b"\xff\xd8", b"\xff\xd8\xff\xe1", jpeg(b"II*\0"), jpeg(loop[:20]), b"\x89PNG\r\n\x1a\n\0\0", jpeg(loop[:18] + (8).to_bytes(4, "little") + loop[22:])):
        assert office.extract("a.jpg", content, 99) == ("words of a scan", None)
