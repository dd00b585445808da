"""PDF files as relations: pages with their text, size and text blocks, and single pages cut out.

A small reader of the format itself: objects (in object streams too), the
page tree with what pages inherit, deflated content, text operators, and
fonts' own tables of characters. Encrypted files, other filters and images
are not read; another parser can be given.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .readers import read_pdfs


class PdfError(ValueError):
    """A file that can't be read."""


class Name(str):
    """A PDF name."""


class Ref(tuple):
    """A reference to an object: (number, generation)."""


_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*[\r\n]\s*)*(<<|>>|\[|\]|\{|\}|\(|<|/[^\s<>\[\](){}/%]*|[^\s<>\[\](){}/%]+)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Reader:
    """Values of a stretch of bytes, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def string(self) -> bytes:
        out, depth = [], 1
        data, i = self.data, self.at
        while i < len(data):
            c = data[i : i + 1]
            if c == b"\\":
                octal = re.compile(rb"[0-7]{1,3}").match(data, i + 1)
                if octal:
                    out.append(bytes([int(octal[0], 8) & 255]))
                    i = octal.end()
                    continue
                nxt = data[i + 1 : i + 2]
                if nxt not in b"\r\n":
                    out.append(_ESCAPES.get(nxt, nxt))
                i += 3 if data[i + 1 : i + 3] == b"\r\n" else 2
                continue
            depth += (c == b"(") - (c == b")")
            i += 1
            if not depth:
                break
            out.append(c)
        self.at = i
        return b"".join(out)

    def value(self):
        """The next value; operators and closing brackets come as bytes, the end as None."""
        m = _TOKEN.match(self.data, self.at)
        if not m:
            self.at = len(self.data)
            return None
        token, self.at = m[1], m.end()
        if token == b"<<":
            out = {}
            while (key := self.value()) not in (b">>", None):
                out[key] = self.value()
            return out
        if token == b"[":
            items = []
            while (x := self.value()) not in (b"]", None):
                if x == b"R" and len(items) >= 2:
                    items[-2:] = [Ref(items[-2:])]
                else:
                    items.append(x)
            return items
        if token == b"(":
            return self.string()
        if token == b"<":
            end = self.data.find(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if token[:1] == b"/":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), token[1:]).decode("latin-1"))
        try:
            number = float(token) if b"." in token else int(token)
        except ValueError:
            return {b"true": True, b"false": False}.get(token, token)
        ref = re.compile(rb"\s+(\d+)\s+R(?![A-Za-z0-9])").match(self.data, self.at)
        if ref and isinstance(number, int):
            self.at = ref.end()
            return Ref((number, int(ref[1])))
        return number


class Pdf:
    """The objects of a file and its pages in order."""

    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise PdfError("no PDF header")
        self.data = data
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        root = None
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data):
            r = Reader(data, m.end())
            value = r.value()
            number = int(m[1])
            self.objects[number] = value
            start = re.compile(rb"\s*stream\r?\n").match(data, r.at)
            if isinstance(value, dict) and start:
                length = value.get("Length")
                end = start.end() + length if isinstance(length, int) else -1
                if end < 0 or not data[end : end + 12].lstrip().startswith(b"endstream"):
                    end = data.find(b"endstream", start.end())
                self.streams[number] = data[start.end() : end]
                if value.get("Root"):
                    root = value["Root"]
        for number in [k for k, v in self.objects.items() if isinstance(v, dict) and v.get("Type") == "ObjStm"]:
            body, first = self.stream(number), self.objects[number].get("First", 0)
            head = Reader(body[:first])
            for _ in range(self.objects[number].get("N", 0)):
                inner, offset = head.value(), head.value()
                self.objects.setdefault(inner, Reader(body, first + offset).value())
        for m in re.finditer(rb"trailer\s*", data):
            trailer = Reader(data, m.end()).value()
            if isinstance(trailer, dict):
                if trailer.get("Encrypt"):
                    raise PdfError("the file is encrypted")
                root = trailer.get("Root", root)
        catalog = self.get(root) or next((v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        if not isinstance(catalog, dict):
            raise PdfError("no catalog")
        self.root, self.pages_ref = root, catalog.get("Pages")
        self.pages = list(self._pages(self.pages_ref, {}, set()))

    def get(self, x):
        return self.objects.get(x[0]) if isinstance(x, Ref) else x

    def stream(self, number: int) -> bytes:
        data, filters = self.streams.get(number, b""), self.get(self.objects[number].get("Filter"))
        for name in filters if isinstance(filters, list) else [filters] if filters else []:
            if name not in ("FlateDecode", "Fl"):
                return b""
            z = zlib.decompressobj()
            try:
                data = z.decompress(data)
            except zlib.error:
                return b""
        return data

    def _pages(self, ref, above: dict, seen: set) -> Iterator[tuple[Ref, dict]]:
        node = self.get(ref)
        if not isinstance(node, dict) or ref in seen:
            return
        seen.add(ref)
        mine = above | {k: node[k] for k in ("MediaBox", "Resources", "Rotate") if k in node}
        if node.get("Type") == "Pages" or "Kids" in node:
            for kid in self.get(node.get("Kids")) or []:
                yield from self._pages(kid, mine, seen)
        else:
            yield ref, node | mine

    def size(self, page: dict) -> tuple[float, float]:
        x0, y0, x1, y1 = (float(self.get(v)) for v in self.get(page.get("MediaBox")) or (0, 0, 612, 792))
        width, height = abs(x1 - x0), abs(y1 - y0)
        return (height, width) if (self.get(page.get("Rotate")) or 0) % 180 else (width, height)

    def _characters(self, font: dict) -> Callable[[bytes], str]:
        """How a font's codes are read: by its own table, else as Windows' Latin characters."""
        ref = font.get("ToUnicode")
        if not isinstance(ref, Ref):
            return lambda b: b.decode("cp1252", "replace")
        table, r, args, wide = {}, Reader(self.stream(ref[0])), [], 1
        text = lambda b: b.decode("utf-16-be", "replace")
        while (x := r.value()) is not None:
            if x == b"endcodespacerange" and args:
                wide = max(1, len(args[-1]))
            elif x == b"endbfchar":
                table |= {a: text(b) for a, b in zip(args[::2], args[1::2], strict=False)}
            elif x == b"endbfrange":
                for low, high, to in zip(args[::3], args[1::3], args[2::3], strict=False):
                    for k in range(int.from_bytes(high) - int.from_bytes(low) + 1):
                        code = (int.from_bytes(low) + k).to_bytes(len(low))
                        table[code] = text(to[k]) if isinstance(to, list) else text(to[:-1] + bytes([(to[-1] + k) & 255]))
            if isinstance(x, bytes) and x.startswith((b"begin", b"end")) and x.isalpha():
                args = []
            elif isinstance(x, (bytes, list)):
                args.append(x)
        return lambda b: "".join(table.get(b[i : i + wide], "") for i in range(0, len(b), wide))

    def spans(self, page: dict) -> list[tuple[str, float, float, float]]:
        """(text, x, y from the top, font size) of the text operators of a page, in order."""
        contents = page.get("Contents")
        refs = self.get(contents) if isinstance(self.get(contents), list) else [contents]
        body = b"\n".join(self.stream(x[0]) for x in refs if isinstance(x, Ref) and x[0] in self.streams)
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        readers: dict[str, Callable[[bytes], str]] = {}
        _, height = self.size(page)
        unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        times = lambda a, b: (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])
        out, stack, saved = [], [], []
        ctm = tm = line = unit
        read, size, leading = (lambda b: b.decode("cp1252", "replace")), 1.0, 0.0
        r = Reader(body)
        numbers = lambda n: [float(x) for x in stack[-n:]]
        while (x := r.value()) is not None:
            if not (isinstance(x, bytes) and x.strip(b"*'\"").isalpha() or x in (b"T*", b"'", b'"')) or self._is_string(r, x):
                stack.append(x)
                continue
            try:
                if x == b"q":
                    saved.append(ctm)
                elif x == b"Q":
                    ctm = saved.pop() if saved else unit
                elif x == b"cm":
                    ctm = times(tuple(numbers(6)), ctm)
                elif x == b"BT":
                    tm = line = unit
                elif x == b"Tf":
                    name, size = stack[-2], float(stack[-1])
                    font = self.get(fonts.get(name)) or {}
                    read = readers.setdefault(name, self._characters(font))
                elif x in (b"Td", b"TD"):
                    dx, dy = numbers(2)
                    leading = -dy if x == b"TD" else leading
                    tm = line = times((1, 0, 0, 1, dx, dy), line)
                elif x == b"TL":
                    leading = float(stack[-1])
                elif x == b"Tm":
                    tm = line = tuple(numbers(6))
                elif x in (b"T*", b"'", b'"'):
                    tm = line = times((1, 0, 0, 1, 0, -leading), line)
                if x in (b"Tj", b"TJ", b"'", b'"'):
                    parts = stack[-1] if isinstance(stack[-1], list) else [stack[-1]]
                    text = "".join(read(p) if isinstance(p, bytes) else " " if isinstance(p, (int, float)) and p < -200 else "" for p in parts)
                    at = times(tm, ctm)
                    out.append((text, at[4], height - at[5], abs(size * (at[3] or at[1]))))
            except (IndexError, TypeError, ValueError):
                pass  # an operator without its operands does nothing
            stack = []
        return out

    @staticmethod
    def _is_string(r: Reader, x) -> bool:
        """Whether a value of bytes was a string, by the bracket that ended it."""
        return isinstance(x, bytes) and r.data[r.at - 1 : r.at] in (b")", b">")

    def blocks(self, page: dict) -> list[dict]:
        """Lines of text: spans that follow each other on one height."""
        out: list[dict] = []
        for text, x, y, size in self.spans(page):
            if not text.strip():
                continue
            width = 0.5 * size * len(text)
            if out and abs(out[-1]["y1"] - y) < 0.3 * size and x >= out[-1]["x0"]:
                last = out[-1]
                gap = " " if x - last["x1"] > 0.2 * size and not last["text"].endswith(" ") else ""
                last |= {"text": last["text"] + gap + text, "x1": x + width, "font_size": max(last["font_size"], size)}
            else:
                out.append({"text": text, "x0": x, "y0": y - size, "x1": x + width, "y1": y, "font_size": size, "block_no": len(out)})
        return [b | {"text": b["text"].strip()} for b in out]


def parse_pdf(data: bytes) -> list[dict]:
    """The pages of a file: width and height in points, blocks of text, and their lines as one text."""
    pdf = Pdf(data)
    out = []
    for _, page in pdf.pages:
        blocks = pdf.blocks(page)
        width, height = pdf.size(page)
        out.append({"width": width, "height": height, "text": "\n".join(b["text"] for b in blocks), "blocks": blocks})
    return out


def single_page(data: bytes, page_number: int) -> bytes:
    """A file with one page, counted from 1: the file itself with a new page tree appended."""
    pdf = Pdf(data)
    if not 1 <= page_number <= len(pdf.pages):
        raise PdfError(f"page {page_number} of {len(pdf.pages)}")
    ref, page = pdf.pages[page_number - 1]
    tree = max(pdf.objects) + 1
    inherited = "".join(f" /MediaBox [{' '.join(f'{float(v):g}' for v in pdf.get(page['MediaBox']))}]" for _ in range("MediaBox" in page)) + (f" /Resources {page['Resources'][0]} {page['Resources'][1]} R" if isinstance(page.get("Resources"), Ref) else "")
    new = {tree: f"<< /Type /Pages /Kids [{ref[0]} {ref[1]} R] /Count 1{inherited} >>", tree + 1: f"<< /Type /Catalog /Pages {tree} 0 R >>"}
    out, places = bytearray(data.rstrip() + b"\n"), {}
    for number, body in new.items():
        places[number] = len(out)
        out += f"{number} 0 obj\n{body}\nendobj\n".encode()
    start = len(out)
    before = re.findall(rb"startxref\s+(\d+)", data)
    out += f"xref\n{tree} 2\n".encode() + b"".join(f"{places[n]:010d} 00000 n \n".encode() for n in new)
    out += f"trailer\n<< /Size {tree + 2} /Root {tree + 1} 0 R{f' /Prev {int(before[-1])}' if before else ''} >>\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out)


_BLOCK = "struct<text:string,x0:double,y0:double,x1:double,y1:double,font_size:double,block_no:int>"
PAGES = f"pdf_filename string, pdf_hash string, page_number int, page_count int, width double, height double, text string, blocks array<{_BLOCK}>, error string"


def read_pages(files: DataFrame, parse: Callable[[bytes], list[dict]] = parse_pdf) -> DataFrame:
    """One row a page of files (pdf_filename, pdf_hash, content), and one with an error for a file that can't be read.

    page_number counts from 1. ``parse`` gives a list of pages with width,
    height, text and blocks; each file is parsed in one piece by one task.
    """
    block = pa.struct([(k, pa.string() if k == "text" else pa.int32() if k == "block_no" else pa.float64()) for k in ("text", "x0", "y0", "x1", "y1", "font_size", "block_no")])
    schema = pa.schema([("pdf_filename", pa.string()), ("pdf_hash", pa.string()), ("page_number", pa.int32()), ("page_count", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("text", pa.string()), ("blocks", pa.list_(block)), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, hash_, content in zip(*batch.columns, strict=True):
                own = {"pdf_filename": name.as_py(), "pdf_hash": hash_.as_py()}
                try:
                    pages = parse(content.as_py() or b"")
                    rows = [own | {k: p.get(k) for k in ("width", "height", "text", "blocks")} | {"page_number": i + 1, "page_count": len(pages), "error": None} for i, p in enumerate(pages)]
                except Exception as e:  # noqa: BLE001  a damaged file is a row, not the end of the job
                    rows = [own | {"error": f"{type(e).__name__}: {e}"[:500]}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("pdf_filename", "pdf_hash", "content").mapInArrow(run, PAGES)


def read_input(spark: SparkSession, path: str) -> DataFrame:
    """The PDF file at ``path``, or those of the folder, not below it; a path that isn't there raises FileNotFoundError."""
    try:
        return read_pdfs(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise


def extract_pages(plan: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Writes the pages of an organize plan as files of one page: (target, status), with extracted, skipped or an error.

    ``plan``: pdf_filename, page_number, category, target. A target that is there is skipped,
    so a task that is run again repeats nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            status = []
            for target, page, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = f"{base}/{target}"
                try:
                    if fs.get_file_info(path).type != pa.fs.FileType.NotFound:
                        status.append("skipped")
                        continue
                    made = single_page(content, page)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    with fs.open_output_stream(path) as out:
                        out.write(made)
                    status.append("extracted")
                except (PdfError, OSError) as e:
                    status.append(f"error: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(status, pa.string())], names=["target", "status"])

    rows = plan.join(files.select("pdf_filename", "content"), "pdf_filename").select("target", "page_number", "content")
    return rows.mapInArrow(run, "target string, status string")
