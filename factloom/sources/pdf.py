"""PDF pages as rows: a small content-stream reader behind a Python data source and a batch function.

Reads uncompressed and Flate streams, Tm / Td / TD / T* / Tj / TJ / ' / " text operators and notes images.
Widths of glyphs are estimated (half an em), since fonts are not parsed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_SCHEMA = ("path string, page_number int, width double, height double, has_images boolean, "
               "items array<struct<text: string, x: double, y: double, width: double, height: double>>, error string")
OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
REF = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
GLYPH = 0.5


class PdfError(ValueError):
    """The bytes are no PDF this reader can follow."""


def _text(token: bytes) -> str:
    if token.startswith(b"<"):
        raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", token[1:-1])) % 2))
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: ESCAPES.get(m[1], bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), token[1:-1], flags=re.S)
    return raw.decode("utf-16-be", "replace")[1:] if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def _content(body: bytes) -> bytes:
    m = STREAM.search(body)
    if not m:
        return b""
    if b"/FlateDecode" in body[:m.start()]:
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error as e:
            raise PdfError(f"damaged stream: {e}") from e
    return m[1]


def text_items(content: bytes) -> list[dict]:
    """Positioned texts of a content stream."""
    out, stack = [], []
    line = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    at, size, lead = list(line), 12.0, 0.0

    def move(tx: float, ty: float) -> None:
        nonlocal at
        line[4], line[5] = line[4] + tx * line[0] + ty * line[2], line[5] + tx * line[1] + ty * line[3]
        at = list(line)

    def show(text: str) -> None:
        if not text:
            return
        high = abs(at[3] * size) or size
        wide = len(text) * GLYPH * abs(at[0] * size)
        out.append({"text": text, "x": at[4], "y": at[5], "width": wide, "height": high})
        at[4] += wide

    for m in TOKEN.finditer(content):
        t = m.group()
        if t[:1] in b"(<" or re.fullmatch(rb"[-+]?\d*\.?\d+", t) or t[:1] in b"/[]":
            stack.append(t)
            continue
        numbers = [float(x) for x in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", x)]
        texts = [x for x in stack if x[:1] in b"(<"]
        if t == b"BT":
            line = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
            at = list(line)
        elif t == b"Tf" and numbers:
            size = numbers[-1]
        elif t == b"TL" and numbers:
            lead = numbers[-1]
        elif t == b"Tm" and len(numbers) >= 6:
            line = numbers[-6:]
            at = list(line)
        elif t in (b"Td", b"TD") and len(numbers) >= 2:
            lead = -numbers[-1] if t == b"TD" else lead
            move(*numbers[-2:])
        elif t == b"T*":
            move(0, -lead)
        elif t in (b"Tj", b"TJ"):
            show("".join(_text(x) for x in texts))
        elif t in (b"'", b'"'):
            move(0, -lead)
            show("".join(_text(x) for x in texts))
        stack = []
    return out


def parse_pdf(data: bytes) -> list[dict]:
    """Pages in order. Raises PdfError for anything that is no readable PDF."""
    if not data.startswith(b"%PDF-"):
        raise PdfError("no PDF signature")
    objects = {int(m[1]): m[3] for m in OBJECT.finditer(data)}
    if not objects:
        raise PdfError("no objects")
    tree = next((b for b in objects.values() if re.search(rb"/Type\s*/Pages\b", b) and not re.search(rb"/Parent\b", b)), None)
    order: list[int] = []

    def walk(body: bytes, depth: int = 0) -> None:
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        for ref in REF.finditer(kids[1] if kids else b""):
            kid = objects.get(int(ref[1]), b"")
            if re.search(rb"/Type\s*/Pages\b", kid) and depth < 50:
                walk(kid, depth + 1)
            elif kid:
                order.append(int(ref[1]))

    if tree is not None:
        walk(tree)
    order = order or [k for k, b in objects.items() if re.search(rb"/Type\s*/Page\b", b)]
    if not order:
        raise PdfError("no pages")
    pages = []
    for number, k in enumerate(order, 1):
        body = objects[k]
        box = re.search(rb"/MediaBox\s*\[\s*([-\d.\s]+)\]", body) or (tree and re.search(rb"/MediaBox\s*\[\s*([-\d.\s]+)\]", tree))
        sides = [float(x) for x in box[1].split()] if box else [0, 0, 612, 792]
        contents = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        stream = b"\n".join(_content(objects.get(int(r[1]), b"")) for r in REF.finditer(contents[1])) if contents else b""
        resources = body + b"".join(objects.get(int(r[1]), b"") for r in REF.finditer(body))
        images = bool(re.search(rb"/Subtype\s*/Image\b", resources) or re.search(rb"\bBI\s.*?\bID\b", stream, re.S))
        pages.append({"page_number": number, "width": sides[2] - sides[0], "height": sides[3] - sides[1], "has_images": images, "items": text_items(stream)})
    return pages


def _rows(path: str, data: bytes) -> list[tuple]:
    try:
        return [(path, p["page_number"], p["width"], p["height"], p["has_images"], p["items"], None) for p in parse_pdf(bytes(data))]
    except Exception as e:  # one bad file must not fail the job
        return [(path, None, None, None, None, None, f"PDF_PARSE_FAILURE: {e}")]


def pages_of_files(files: DataFrame) -> DataFrame:
    """Pages of a binaryFile frame; files that cannot be read give one row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, c in zip(frame["path"], frame["content"]) for r in _rows(p, c)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "width", "height", "has_images", "items", "error"]).astype({"page_number": "Int32", "has_images": "boolean"})

    return files.select("path", "content").mapInPandas(run, PAGE_SCHEMA)


class PdfSource(DataSource):
    """``spark.read.format("pdf").load(folder_or_file)``."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _PdfReader(self.options.get("path", ""))


class _PdfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _open(self):
        """File system and path below it: a local path or any address pyarrow has a file system for."""
        from pyarrow import fs

        path = self.path.removeprefix("file:") if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def partitions(self) -> list[InputPartition]:
        import re
        from fnmatch import translate

        from pyarrow import fs

        system, path = self._open()
        wild = re.search(r"[*?\[]", path)
        root = path[:wild.start()].rpartition("/")[0] if wild else path
        if system.get_file_info(root).type == fs.FileType.File:
            return [InputPartition(root)]
        every = [f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File]
        fits = re.compile(translate(path)).match if wild else lambda p: p.lower().endswith(".pdf")
        return [InputPartition(p) for p in sorted(every) if fits(p)]

    def read(self, partition: InputPartition):
        system, _ = self._open()
        with system.open_input_file(partition.value) as f:
            for path, number, width, height, images, items, error in _rows(partition.value, f.read()):
                yield (path, number, width, height, images, [tuple(i.values()) for i in items] if items is not None else None, error)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfSource)
