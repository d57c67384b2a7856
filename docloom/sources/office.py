"""Readers of office formats with the standard library alone.

A document is a ZIP archive of XML parts; only the parts that hold text are
opened, and archives that would unpack to far more than their size are refused.
PDF and image readers can be plugged in through READERS.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree as ET

MOST_UNPACKED, MOST_RATIO, MOST_INPUT = 100 << 20, 200, 50 << 20
PREVIEW_CHARS, PREVIEW_PARAGRAPHS, PREVIEW_SHEETS, PREVIEW_ROWS, PREVIEW_COLUMNS, PREVIEW_SLIDES = 20_000, 1000, 8, 80, 50, 20

READERS: dict[str, object] = {}  # extension -> function(bytes) -> text, for formats without a reader here


class Unreadable(ValueError):
    pass


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _get(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def open_archive(content: bytes) -> zipfile.ZipFile:
    if len(content) > MOST_INPUT:
        raise Unreadable("too large")
    if content[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise Unreadable("password_protected")
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Unreadable("invalid or corrupted") from e
    unpacked, packed = (sum(getattr(i, a) for i in z.infolist()) for a in ("file_size", "compress_size"))
    if unpacked > MOST_UNPACKED or unpacked > MOST_RATIO * max(packed, 1):
        raise Unreadable("unsafe compression ratio")
    return z


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element:
    data = z.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise Unreadable("invalid or corrupted")
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise Unreadable("invalid or corrupted") from e


def _text(e: ET.Element) -> str:
    """Text of a paragraph; tabs and breaks as white space, pictures as a mark."""
    marks = {"tab": "\t", "br": "\n", "cr": "\n", "drawing": "[image]", "pict": "[image]"}
    return "".join((x.text or "") if _tag(x) == "t" else marks.get(_tag(x), "") for x in e.iter())


def word(content: bytes) -> dict:
    """paragraphs, headings, tables (rows of cells) and has_macros."""
    z = open_archive(content)
    if "word/document.xml" not in z.namelist():
        raise Unreadable("invalid or corrupted")
    out: dict = {"paragraphs": [], "headings": [], "tables": [], "has_macros": "word/vbaProject.bin" in z.namelist()}
    body = next((e for e in _xml(z, "word/document.xml") if _tag(e) == "body"), None)
    for e in body if body is not None else []:
        if _tag(e) == "p":
            text = _text(e)
            style = next((_get(s, "val") or "" for s in e.iter() if _tag(s) == "pStyle"), "")
            out["paragraphs"].append(text)
            if style.lower().startswith("heading"):
                out["headings"].append(text)
        elif _tag(e) == "tbl":
            rows = [r for r in e if _tag(r) == "tr"]
            out["tables"].append([["\n".join(_text(p) for p in c.iter() if _tag(p) == "p") for c in r if _tag(c) == "tc"] for r in rows])
    return out


def _relations(z: zipfile.ZipFile, name: str) -> dict[str, str]:
    if name not in z.namelist():
        return {}
    return {r.attrib.get("Id", ""): r.attrib.get("Target", "") for r in _xml(z, name)}


def excel(content: bytes) -> dict:
    """sheets: name -> cell -> value, formula, cached_value, display_value; has_macros."""
    z = open_archive(content)
    if "xl/workbook.xml" not in z.namelist():
        raise Unreadable("invalid or corrupted")
    names = z.namelist()
    shared = ["".join(t.text or "" for t in s.iter() if _tag(t) == "t") for s in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    targets = _relations(z, "xl/_rels/workbook.xml.rels")
    out: dict = {"sheets": {}, "has_macros": "xl/vbaProject.bin" in names}
    for s in (e for e in _xml(z, "xl/workbook.xml").iter() if _tag(e) == "sheet"):
        target = targets.get(_get(s, "id") or "", "").lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        cells = {}
        for c in (e for e in _xml(z, path).iter() if _tag(e) == "c") if path in names else []:
            raw = next((v.text for v in c if _tag(v) == "v"), None)
            formula = next((f.text or "" for f in c if _tag(f) == "f"), None)
            kind = c.attrib.get("t")
            if kind == "s" and raw is not None:
                value = shared[int(raw)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter() if _tag(t) == "t")
            else:
                value = raw
            if value is not None or formula is not None:
                written = f"={formula}" if formula is not None else None
                cells[c.attrib.get("r", "")] = {"value": written or value, "formula": written, "cached_value": value, "display_value": value if value is not None else written}
        out["sheets"][s.attrib.get("name", "")] = cells
    return out


def _cell_place(coordinate: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]+)(\d+)", coordinate)
    column = 0
    for ch in m[1] if m else "":
        column = column * 26 + ord(ch) - 64
    return (int(m[2]) if m else 0, column)


def sheet_rows(cells: dict) -> list[tuple[int, list[tuple[int, str]]]]:
    """(row number, (column, value) of its cells that have one), in order."""
    rows: dict[int, list[tuple[int, str]]] = {}
    for at, cell in sorted(((_cell_place(k), v) for k, v in cells.items()), key=lambda x: x[0]):
        if cell["cached_value"] not in (None, ""):
            rows.setdefault(at[0], []).append((at[1], str(cell["cached_value"])))
    return sorted(rows.items())


def slides(content: bytes) -> list[dict]:
    """shapes (texts) and tables (rows of cells) of each slide."""
    z = open_archive(content)
    names = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
    if not names and "ppt/presentation.xml" not in z.namelist():
        raise Unreadable("invalid or corrupted")
    out = []
    for n in sorted(names, key=lambda n: int(re.search(r"\d+", n)[0])):
        root = _xml(z, n)
        joined = lambda e: "\n".join("".join(t.text or "" for t in p.iter() if _tag(t) == "t") for p in e.iter() if _tag(p) == "p")
        tables = [[[joined(c) for c in r if _tag(c) == "tc"] for r in t if _tag(r) == "tr"] for t in root.iter() if _tag(t) == "tbl"]
        out.append({"shapes": [s for s in (joined(e) for e in root.iter() if _tag(e) == "txBody") if s and not _in_table(root, s, tables)], "tables": tables})
    return out


def _in_table(root: ET.Element, text: str, tables: list) -> bool:
    return any(text == cell for t in tables for r in t for cell in r)


#: EXIF tags that a camera or a photo editor writes (maker, model, lens, software), and the one that leads to further tags.
CAMERA_TAGS, FURTHER_TAGS = frozenset([0x010F, 0x0110, 0xA434, 0x0131]), 0x8769
PHOTOS = (".jpg", ".jpeg", ".png")


def _exif(content: bytes) -> bytes:
    """The EXIF block of a JPEG or PNG file; empty if there is none."""
    if content.startswith(b"\xff\xd8"):
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
            size = int.from_bytes(content[at + 2 : at + 4], "big")
            body = content[at + 4 : at + 2 + size]
            if content[at + 1] == 0xE1 and body.startswith(b"Exif\0\0"):
                return body[6:]
            at += 2 + size
    elif content.startswith(b"\x89PNG\r\n\x1a\n"):
        at = 8
        while at + 8 <= len(content):
            size = int.from_bytes(content[at : at + 4], "big")
            if content[at + 4 : at + 8] == b"eXIf":
                return content[at + 8 : at + 8 + size]
            at += 12 + size
    return b""


def taken_by_camera(content: bytes) -> bool:
    """Whether an image's EXIF data name a camera, a lens or an editor: such photos are not read for text."""
    block = _exif(content or b"")
    order = {b"II": "little", b"MM": "big"}.get(block[:2])
    if order is None:
        return False
    todo, seen = [int.from_bytes(block[4:8], order)], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(block):
            continue
        seen.add(at)
        for k in range(int.from_bytes(block[at : at + 2], order)):
            entry = block[at + 2 + 12 * k : at + 14 + 12 * k]
            tag = int.from_bytes(entry[:2], order)
            if len(entry) == 12 and tag in CAMERA_TAGS:
                return True
            if len(entry) == 12 and tag == FURTHER_TAGS:
                todo.append(int.from_bytes(entry[8:12], order))
    return False


def access_reason(error: OSError) -> str:
    """Why a file can't be opened."""
    if isinstance(error, PermissionError) or getattr(error, "winerror", None) == 5:
        return "permission_denied"
    if isinstance(error, FileNotFoundError):
        return "not_found"
    return "file_locked" if getattr(error, "winerror", None) == 32 else "access_error"


def extract(name: str, content: bytes, most: int) -> tuple[str, str | None]:
    """(text, reason): the text to index, at most `most` characters; reason is null if it could be read."""
    ext = "." + (name or "").lower().rpartition(".")[2]
    try:
        if ext in (".txt", ".csv", ".md"):
            text = (content or b"").decode("utf-8", "ignore")
        elif ext == ".docx":
            text = " ".join(word(content)["paragraphs"])
        elif ext == ".xlsx":
            text = "\n".join(" ".join(v for _, v in r) for cells in excel(content)["sheets"].values() for _, r in sheet_rows(cells))
        elif ext == ".pptx":
            text = "\n".join("\n".join([*s["shapes"], *(" ".join(r) for t in s["tables"] for r in t)]) for s in slides(content))
        elif ext in PHOTOS and taken_by_camera(content):
            text = ""
        elif ext in READERS:
            text = READERS[ext](content)
        else:
            return "", "extract_error"
    except Unreadable as e:
        return "", "password_protected" if str(e) == "password_protected" else "extract_error"
    except (KeyError, IndexError, ValueError):
        return "", "extract_error"
    return text[:most], None


def preview(name: str, content: bytes) -> str:
    """JSON of kind, text, truncated and error for a document of an office format."""
    ext = "." + (name or "").lower().rpartition(".")[2]
    result: dict = {"kind": ext[1:].upper(), "text": "", "truncated": False, "error": None}
    cut = False
    try:
        if len(content or b"") > MOST_INPUT:
            raise Unreadable("too large")
        if ext == ".docx":
            d = word(content)
            lines = [p for p in d["paragraphs"] if p.strip()]
            cut = len(lines) > PREVIEW_PARAGRAPHS
            lines = lines[:PREVIEW_PARAGRAPHS] + [" | ".join(r) for t in d["tables"] for r in t]
        elif ext == ".xlsx":
            lines, sheets = [], excel(content)["sheets"]
            cut = len(sheets) > PREVIEW_SHEETS
            for title, cells in list(sheets.items())[:PREVIEW_SHEETS]:
                lines.append(f"Sheet: {title}")
                rows = sheet_rows(cells)
                near = [(n, r) for n, r in rows if n <= PREVIEW_ROWS]
                cut = cut or len(near) < len(rows) or any(c > PREVIEW_COLUMNS for _, r in near for c, _ in r)
                lines += [" | ".join(v for c, v in r if c <= PREVIEW_COLUMNS) for _, r in near]
        elif ext == ".pptx":
            lines, pages = [], slides(content)
            cut = len(pages) > PREVIEW_SLIDES
            for k, s in enumerate(pages[:PREVIEW_SLIDES], 1):
                lines += [f"Slide {k}", *s["shapes"], *(" | ".join(r) for t in s["tables"] for r in t)]
        elif ext in READERS:
            lines = READERS[ext](content).split("\n")
        else:
            raise Unreadable("unsupported")
        text = "\n".join(lines)
        result |= {"text": text[:PREVIEW_CHARS], "truncated": cut or len(text) > PREVIEW_CHARS}
    except (Unreadable, KeyError, IndexError, ValueError) as e:
        result["error"] = str(e) if isinstance(e, Unreadable) else "invalid or corrupted"
    return json.dumps(result)
