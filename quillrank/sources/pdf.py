"""Text of PDF files and PDF files of text, as functions of bytes for columns.

Reading follows the page tree and the text operators of each page's content:
objects are found by their heads (so a broken cross-reference table does no harm),
also within object streams; streams may be deflated. Codes of a font become text by
its ToUnicode map, else as Windows-1252. What cannot be read raises PdfError.

Writing puts lines on pages, one line below the other, in a font whose codes are
UTF-16 and whose ToUnicode map says so: any text comes back as it was.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_LINES = 50
#: Bytes that the streams of one file may inflate to.
MOST_BYTES = 256 << 20
#: Bytes of a map that is kept for other files, and codes kept with it; rows of a
#: batch that are rendered or read at once.
MAP_BYTES, MOST_CODES, ROWS = 64 << 10, 1 << 16, 256


class PdfError(ValueError):
    """The file is no PDF that can be read."""


_HEAD = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_TOKEN = re.compile(
    rb"%[^\r\n]*|(?P<dict><<|>>)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<open>[(])|(?P<list>[\[\]])|/(?P<name>[^\s()<>\[\]{}/%]*)|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+))(?![^\s()<>\[\]{}/%])|(?P<word>[^\s()<>\[\]{}/%]+)|[{})>]"
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_END, _STREAM = "end", "stream"


class Name(str):
    """A name, as /Type."""


class Word(str):
    """An operator or key word, as Tj or endobj."""


class Ref(int):
    """The number of an object that is told elsewhere."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets from behind its opening one; and where it ends."""
    out, depth, start = [], 1, at
    for m in re.compile(rb"\\(\d{1,3}|\r\n|.)|[()]", re.S).finditer(data, at):
        if m[0] == b"(":
            depth += 1
        elif m[0] == b")":
            depth -= 1
            if not depth:
                out.append(data[start : m.start()])
                return b"".join(out), m.end()
        else:
            code = m[1]
            out.append(data[start : m.start()])
            start = m.end()
            out.append(bytes([int(code, 8) & 255]) if code.isdigit() and code < b"8" else b"" if code in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(code, code))
    raise PdfError("a string has no end")


def _values(data: bytes, at: int = 0):
    """(value, end) of every token: numbers, bytes, names, words, and whole lists
    and dictionaries."""
    stack: list[tuple[str, list]] = []
    while m := _TOKEN.search(data, at):
        at, kind, value = m.end(), m.lastgroup, None
        if kind == "hex":
            digits = re.sub(rb"\s", b"", m["hex"])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "open":
            value, at = _string(data, at)
        elif kind == "name":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m["name"]).decode("latin-1"))
        elif kind == "number":
            value = float(m["number"]) if b"." in m["number"] else int(m["number"])
        elif kind == "word":
            value = Word(m["word"].decode("latin-1"))
        elif m[0] in (b"[", b"<<"):
            stack.append((m[0].decode(), []))
            continue
        elif m[0] in (b"]", b">>"):
            if not stack:
                continue
            opened, own = stack.pop()
            value = own if opened == "[" else dict(zip([k for k in own[::2] if isinstance(k, Name)], own[1::2]))
        else:
            continue
        if isinstance(value, Word) and value == "R" and stack and len(stack[-1][1]) > 1:
            stack[-1][1].pop()
            value = Ref(stack[-1][1].pop())
        if stack:
            stack[-1][1].append(value)
        else:
            yield value, at


@lru_cache(64)
def _mapped(said: bytes):
    """bytes -> text by a ToUnicode map. Files of one writer share their maps, so
    those of bounded size are kept."""
    text, spans, width = lambda raw: raw.decode("utf-16-be", "surrogatepass"), [], 1
    values = [v for v, _ in _values(said)]
    for i, v in enumerate(values):
        if v in ("beginbfrange", "beginbfchar", "begincodespacerange") and isinstance(v, Word):
            step = 2 if v == "beginbfchar" else 3 if v == "beginbfrange" else 0
            if not step:
                width = max(width, len(values[i + 1]))
                continue
            j = i + 1
            while j + step <= len(values) and isinstance(values[j], bytes):
                low, high, to = values[j], values[j + step - 2], values[j + step - 1]
                spans.append((int.from_bytes(low), int.from_bytes(high), to))
                j += step
    spans.sort(key=lambda s: s[0])

    def one(code: int) -> bytes:
        for low, high, to in spans:
            if low <= code <= high:
                if isinstance(to, list):
                    return to[code - low]
                return to[:-2] + (int.from_bytes(to[-2:]) + code - low).to_bytes(2)
        return b"\xff\xfd"

    known: dict[int, bytes] = {}

    def decode(raw: bytes) -> str:
        codes = [int.from_bytes(raw[i : i + width]) for i in range(0, len(raw), width)]
        if len(known) > MOST_CODES:
            known.clear()
        for c in codes:
            if c not in known:
                known[c] = one(c)
        return text(b"".join(known[c] for c in codes))

    return decode


class _File:
    def __init__(self, raw: bytes):
        if b"%PDF-" not in raw[:1024]:
            raise PdfError("no PDF header")
        self.raw, self.heads, self.held, self.packed, self.room = raw, {}, {}, {}, MOST_BYTES
        for m in _HEAD.finditer(raw):
            self.heads[int(m[1])] = m.end()  # of repeated numbers the last counts
        if re.search(rb"/Encrypt\b", raw):
            raise PdfError("the file is encrypted")
        for n in list(self.heads):
            kind = self.get(Ref(n))
            if isinstance(kind, dict) and kind.get("Type") == "ObjStm":
                body, first = self.stream(Ref(n)), self.get(kind.get("First", 0))
                numbers = [v for v, _ in _values(body[:first])]
                for number, place in zip(numbers[::2], numbers[1::2]):
                    self.packed.setdefault(number, (body, first + place))

    def get(self, value):
        """The value itself, or the one that a reference stands for."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            if value not in self.held:
                if value in self.heads:
                    self.held[value] = next(_values(self.raw, self.heads[value]), (None, 0))[0]
                    if isinstance(self.held[value], int) and not isinstance(self.held[value], bool):
                        self.held[value] = self._plain(self.heads[value])
                elif value in self.packed:
                    self.held[value] = next(_values(*self.packed[value]), (None, 0))[0]
                else:
                    self.held[value] = None
            value = self.held[value]
        raise PdfError("references go in circles")

    def _plain(self, at: int):
        """An object that is a number or a reference."""
        found = [v for v, _ in zip((v for v, _ in _values(self.raw, at)), range(3))]
        return Ref(found[0]) if found[1:2] and isinstance(found[1], int) and found[2:] == ["R"] else found[0]

    def stream(self, ref) -> bytes:
        """The inflated bytes of a stream object."""
        if not isinstance(ref, Ref) or ref not in self.heads:
            raise PdfError("a stream is missing")
        head, end = next(_values(self.raw, self.heads[ref]), (None, 0))
        m = re.compile(rb"\s*stream(?:\r\n|\n|\r)").match(self.raw, end)
        if not isinstance(head, dict) or not m:
            raise PdfError("a stream is missing")
        size = self.get(head.get("Length"))
        stop = m.end() + size if isinstance(size, int) else -1
        if not re.compile(rb"\s*endstream").match(self.raw, stop if stop >= 0 else len(self.raw)):
            stop = self.raw.find(b"endstream", m.end())
            if stop < 0:
                raise PdfError("a stream has no end")
        body, filters = self.raw[m.end() : stop], self.get(head.get("Filter", []))
        for f in filters if isinstance(filters, list) else [filters]:
            if self.get(f) != "FlateDecode":
                raise PdfError(f"streams by {f} are not read")
            inflate = zlib.decompressobj()
            try:
                body = inflate.decompress(body, self.room)
            except zlib.error as e:
                raise PdfError(str(e)) from e
            if inflate.unconsumed_tail:
                raise PdfError("the file inflates too far")
            self.room -= len(body)
        return body

    def pages(self):
        """The page dictionaries in their order, with what they inherit."""
        roots = [x for n in [*self.heads, *self.packed] if isinstance(x := self.get(Ref(n)), dict) and x.get("Type") == "Catalog"]
        if not roots:
            raise PdfError("no catalog")
        todo, seen = [(self.get(roots[-1].get("Pages")), {})], 0
        while todo:
            node, above = todo.pop()
            seen += 1
            if not isinstance(node, dict) or seen > 1_000_000:
                raise PdfError("the page tree is broken")
            own = {**above, **{k: node[k] for k in ("Resources",) if k in node}}
            if node.get("Type") == "Page" or "Kids" not in node:
                yield {**own, **node}
            else:
                todo += [(self.get(k), own) for k in reversed(self.get(node["Kids"]) or [])]

    def decoder(self, font):
        """bytes -> text of a font."""
        font = self.get(font)
        if not isinstance(font, dict) or not isinstance(font.get("ToUnicode"), Ref):
            return lambda raw: raw.decode("cp1252", "replace")
        said = self.stream(font["ToUnicode"])
        return (_mapped if len(said) <= MAP_BYTES else _mapped.__wrapped__)(said)

    def text(self, page: dict) -> str:
        """The text of a page; a new line where the text goes to another height."""
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        contents = self.get(page.get("Contents"))
        refs = contents if isinstance(contents, list) else [] if contents is None else [page["Contents"]]
        out, args, decode, decoders, shown = [], [], self.decoder(None), {}, False
        for v, _ in _values(b"\n".join(self.stream(r) for r in refs)):
            if not isinstance(v, Word):
                args.append(v)
                continue
            if v == "Tf" and len(args) > 1:
                if args[-2] not in decoders:
                    decoders[args[-2]] = self.decoder(fonts.get(args[-2]))
                decode = decoders[args[-2]]
            elif v in ("T*", "'", '"') or v in ("Td", "TD") and len(args) > 1 and args[-1] != 0 or v == "Tm":
                if shown:
                    out.append("\n")
            if v in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
                out.append(decode(args[-1]))
                shown = True
            elif v == "TJ" and args and isinstance(args[-1], list):
                # A wide gap between pieces is a blank.
                out += [decode(x) if isinstance(x, bytes) else " " if x < -200 else "" for x in args[-1]]
                shown = True
            args = []
        return "".join(out)


def pages(raw: bytes) -> list[str]:
    """The text of every page of a PDF file."""
    file = _File(bytes(raw))
    return [file.text(p) for p in file.pages()]


_MAP = b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange %d beginbfrange %s endbfrange endcmap end"


def rendered(text: str, page_lines: int = PAGE_LINES) -> bytes:
    """A PDF file of a text, so many lines a page."""
    lines, objects = text.split("\n"), []

    def stream(body: bytes) -> bytes:
        packed = zlib.compress(body)
        return b"<< /Length %d /Filter /FlateDecode >> stream\n%s\nendstream" % (len(packed), packed)

    def put(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    put(b"<< /Type /Catalog /Pages 2 0 R >>")
    put(b"")
    high = b"".join(b"<%02X00> <%02XFF> <%02X00>\n" % (i, i, i) for i in range(256))
    codes = put(stream(_MAP % (256, high)))
    inner = put(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Helvetica /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 600 >>")
    font = put(b"<< /Type /Font /Subtype /Type0 /BaseFont /Helvetica /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (inner, codes))
    kids = []
    for at in range(0, len(lines), page_lines):
        shown = b" T*\n".join(b"<%s> Tj" % x.encode("utf-16-be", "surrogatepass").hex().encode() for x in lines[at : at + page_lines])
        body = put(stream(b"BT /F1 10 Tf 14 TL 40 800 Td\n%s\nET" % shown))
        kids.append(put(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 %d 0 R >> >> /Contents %d 0 R >>" % (font, body)))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = bytearray(b"%PDF-1.5\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    return bytes(out)


def render(text: Column, page_lines: int = PAGE_LINES) -> Column:
    """PDF bytes of a text column; null for null."""

    def some(t: pa.Array) -> pa.Array:
        return pa.array([None if x is None else rendered(x, page_lines) for x in t.to_pylist()], pa.binary())

    def run(t: pa.Array) -> pa.Array:
        return pa.concat_arrays([some(t.slice(lo, ROWS)) for lo in range(0, max(len(t), 1), ROWS)])

    return F.arrow_udf(run, "binary")(text)
