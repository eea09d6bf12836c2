"""A reader of PDF files in plain Python: objects, streams, pages, text, fonts, images, annotations and attachments.

Objects are found by scanning for ``n g obj``, later ones replacing earlier ones, so files with a broken or missing
cross-reference table and files cut off after any save are read like whole ones. Object streams are unpacked.
Encrypted files yield their objects and no text. No library of PDF is needed; everything works on one file's bytes.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

# Fixed values of the file format.
_SKIPPED = b"\x00\t\n\x0c\r %"
_BLANK = re.compile(rb"(?:[\x00\t\n\x0c\r ]++|%[^\r\n]*+)*+")  # white space and comments
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b")
_TOKEN = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
_REFERENCE = re.compile(rb"\s+(\d+)\s+R(?![A-Za-z0-9])")
_PLAIN, _OCTAL = re.compile(rb"[^()\\]+"), re.compile(rb"[0-7]{1,3}")
_TRAILER = re.compile(rb"trailer(?<!\wtrailer)\b")  # it begins with plain letters, which are searched for quickly
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_INLINE_IMAGE = re.compile(rb"(?s)\bID\s.*?\sEI\b")
#: Parts of the width of a line at which a gap between two strings is a blank, in units of the font size.
_GAP = 0.2
#: Nesting at which a file counts as malicious and the rest of a value is ignored; most inflated bytes of a stream.
_DEPTH, _MOST_BYTES = 60, 1 << 28


class Name(str):
    """A name object, without its slash."""


class Op(bytes):
    """A keyword or an operator; strings are plain bytes."""


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


@dataclass
class Stream:
    values: dict
    raw: bytes


@lru_cache(4096)
def _name(token: bytes) -> Name:
    plain = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), token)
    return Name(plain.decode("utf-8", "replace"))


class Scanner:
    """Reads values from bytes, starting at ``at``."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        if self.at < len(self.data) and self.data[self.at] in _SKIPPED:
            self.at = _BLANK.match(self.data, self.at).end()

    def value(self, depth: int = 0) -> Any:
        """The next value; None at the end."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data) or depth > _DEPTH:
            self.at = len(data) if depth > _DEPTH else at
            return None
        one = data[at]
        if one == 0x2F:  # a name
            m = _TOKEN.match(data, at + 1)
            self.at = m.end() if m else at + 1
            return _name(m[0] if m else b"")
        if one == 0x3C:
            return self._dictionary(depth) if data.startswith(b"<<", at) else self._hexadecimal()
        if one == 0x5B:
            return self._array(depth)
        if one == 0x28:
            return self._literal()
        m = _TOKEN.match(data, at)
        if not m:  # a stray delimiter
            self.at += 1
            return Op(data[at : at + 1])
        self.at = m.end()
        token = m[0]
        if _NUMBER.match(token):
            return self._number(token)
        return True if token == b"true" else False if token == b"false" else Op(token)

    def _number(self, token: bytes) -> Any:
        if token.isdigit():  # perhaps a reference
            m = _REFERENCE.match(self.data, self.at)
            if m:
                self.at = m.end()
                return Ref(int(token), int(m[1]))
        return float(token) if b"." in token else int(token)

    def _dictionary(self, depth: int) -> dict:
        self.at += 2
        out: dict = {}
        while True:
            self.skip()
            if self.at >= len(self.data) or self.data.startswith(b">>", self.at):
                self.at += 2
                return out
            key = self.value(depth + 1)
            if not isinstance(key, Name):
                if key is None or isinstance(key, Op) and key in (b"endobj", b"stream"):
                    return out
                continue
            self.skip()
            if not self.data.startswith(b">>", self.at):
                out[key] = self.value(depth + 1)

    def _array(self, depth: int) -> list:
        self.at += 1
        out = []
        while True:
            self.skip()
            if self.at >= len(self.data) or self.data[self.at] == 0x5D:
                self.at += 1
                return out
            value = self.value(depth + 1)
            if isinstance(value, Op) and value in (b"endobj", b"endstream"):
                return out
            out.append(value)

    def _literal(self) -> bytes:
        at, depth, data, out = self.at + 1, 1, self.data, bytearray()
        while at < len(data):
            if m := _PLAIN.match(data, at):
                out += m[0]
                at = m.end()
                continue
            c = data[at : at + 1]
            if c == b"\\":
                plain, at = _escaped(data, at + 1)
                out += plain
                continue
            depth += (c == b"(") - (c == b")")
            at += 1
            if not depth:
                break
            out += c
        self.at = at
        return bytes(out)

    def _hexadecimal(self) -> bytes:
        end = self.data.find(b">", self.at)
        end = len(self.data) if end < 0 else end
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at + 1 : end])
        self.at = end + 1
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def _escaped(data: bytes, at: int) -> tuple[bytes, int]:
    """What a backslash before ``at`` stands for, and where it ends."""
    octal = _OCTAL.match(data, at)
    if octal:
        return bytes([int(octal[0], 8) & 0xFF]), octal.end()
    c = data[at : at + 1]
    if c in (b"\r", b"\n"):  # a line that goes on
        return b"", at + (2 if data[at : at + 2] == b"\r\n" else 1)
    return _ESCAPES.get(c, c), at + 1


def unescape(literal: str) -> str:
    """A string literal as it stands in a content stream, with or without its parentheses, as text."""
    inner = literal[1:-1] if literal.startswith("(") and literal.endswith(")") else literal
    data, out, at = inner.encode("latin-1", "replace"), bytearray(), 0
    while at < len(data):
        if data[at : at + 1] == b"\\" and at + 1 < len(data):
            plain, at = _escaped(data, at + 1)
            out += plain
        else:
            out += data[at : at + 1]
            at += 1
    return out.decode("latin-1")


def _inflated(data: bytes) -> bytes:
    """As much as can be inflated, whatever the stream's end looks like."""
    for bits in (15, -15):
        machine = zlib.decompressobj(bits)
        try:
            return machine.decompress(data, _MOST_BYTES)
        except zlib.error:
            out, machine = bytearray(), zlib.decompressobj(bits)
            try:
                for i in range(0, len(data), 256):
                    out += machine.decompress(data[i : i + 256], _MOST_BYTES)
            except zlib.error:
                pass
            if out:
                return bytes(out)
    return b""


def _unpredicted(data: bytes, parms: dict) -> bytes:
    """Rows as they were before a PNG predictor (other predictors leave data as it is)."""
    if int(parms.get("Predictor", 1)) < 10:
        return data
    depth = max(1, int(parms.get("Colors", 1)) * int(parms.get("BitsPerComponent", 8)) // 8)
    width = (int(parms.get("Columns", 1)) * int(parms.get("Colors", 1)) * int(parms.get("BitsPerComponent", 8)) + 7) // 8
    out, last = bytearray(), bytearray(width)
    for start in range(0, len(data), width + 1):
        kind, row = data[start], bytearray(data[start + 1 : start + 1 + width])
        row += bytes(width - len(row))
        for i in range(width):
            left = row[i - depth] if i >= depth else 0
            above, corner = last[i], last[i - depth] if i >= depth else 0
            if kind == 4:
                guess = left + above - corner
                away = [abs(guess - x) for x in (left, above, corner)]
                more = (left, above, corner)[away.index(min(away))]
            else:
                more = (0, left, above, (left + above) // 2)[kind] if kind < 4 else 0
            row[i] = (row[i] + more) & 0xFF
        out += row
        last = row
    return bytes(out)


def _ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~")[0]:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += (sum(x * 85 ** (4 - i) for i, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group)
        group += [84] * (5 - n)
        out += (sum(x * 85 ** (4 - i) for i, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def _run_lengths(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
    return bytes(out)


@dataclass
class Font:
    name: str
    embedded: bool
    unicode: dict[int, str] = field(default_factory=dict)
    wide: bool = False
    widths: dict[int, float] = field(default_factory=dict)
    default_width: float = 500.0

    def decode(self, data: bytes) -> tuple[str, float]:
        """The text of a shown string and its width in thousandths of the font size."""
        codes = [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data), 2)] if self.wide else list(data)
        width = sum(self.widths.get(c, self.default_width) for c in codes)
        if self.unicode:
            return "".join(self.unicode.get(c, "" if self.wide else bytes([c]).decode("cp1252", "replace")) for c in codes), width
        return data.decode("utf-16-be", "replace") if self.wide else data.decode("cp1252", "replace"), width


def _character_map(data: bytes) -> dict[int, str]:
    """Codes to text of a ToUnicode map."""
    out: dict[int, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace")
    for kind, body in re.findall(rb"(?s)begin(bfchar|bfrange)(.*?)endbf", data):
        scan, values = Scanner(body), []
        while (v := scan.value()) is not None:
            values.append(v)
        if kind == b"bfchar":
            for code, to in zip(values[::2], values[1::2]):
                if isinstance(code, bytes) and isinstance(to, bytes):
                    out[int.from_bytes(code, "big")] = text(to)
            continue
        for first, last, to in zip(values[::3], values[1::3], values[2::3]):
            if not isinstance(first, bytes) or not isinstance(last, bytes):
                continue
            low, high = int.from_bytes(first, "big"), int.from_bytes(last, "big")
            for i, code in enumerate(range(low, min(high, low + 65535) + 1)):
                if isinstance(to, list):
                    if i < len(to) and isinstance(to[i], bytes):
                        out[code] = text(to[i])
                elif isinstance(to, bytes) and to:
                    out[code] = text(to[:-2] + ((int.from_bytes(to[-2:], "big") + i) & 0xFFFF).to_bytes(2, "big"))
    return out


def _is_string(value) -> bool:
    return isinstance(value, bytes) and not isinstance(value, Op)


def _string(value) -> str | None:
    """A text string: UTF-16 or UTF-8 with its mark, else one byte a character."""
    if not _is_string(value):
        return str(value) if isinstance(value, Name) else None
    if value.startswith(b"\xfe\xff"):
        return value[2:].decode("utf-16-be", "replace")
    if value.startswith(b"\xef\xbb\xbf"):
        return value[3:].decode("utf-8", "replace")
    return value.decode("cp1252", "replace")


class Pdf:
    """One file. Whatever is missing or broken reads as empty.

    ``earlier``: the file as it was before a save, whose bytes ``data`` begins with and whose last byte ends a comment;
    what was read of it is not scanned again unless its last object runs into that comment.
    """

    def __init__(self, data: bytes, earlier: Pdf | None = None):
        self.data = data
        self.objects: dict[int, Any] = {}
        self._raw: dict[int, bytes] = {}
        self.trailer: dict = {}
        self._fonts: dict[int, Font] = {}
        self._spans: list[dict] | None = None
        at = 0
        if earlier and earlier._reach < earlier.data.rfind(b"%%EOF"):
            at, objects, raw, self.trailer = earlier._scanned
            self.objects, self._raw = dict(objects), dict(raw)
        at = self._scan(at)
        self._scanned = at, dict(self.objects), dict(self._raw), self.trailer
        self._unpack()
        for m in _TRAILER.finditer(data):
            found = Scanner(data, m.end()).value()
            if isinstance(found, dict):
                self.trailer = self.trailer | found
        self.encrypted = "Encrypt" in self.trailer

    # Objects

    def _scan(self, at: int) -> int:
        """Reads the objects from ``at`` on; where the last one ends."""
        self._reach = at  # the last byte that decided on an object
        while m := _OBJECT.search(self.data, at):
            scan = Scanner(self.data, m.end())
            value = scan.value()
            at = scan.at
            scan.skip()
            source = self.data[m.end() : at]
            if isinstance(value, dict) and self.data.startswith(b"stream", scan.at):
                start = scan.at + 6
                start += 2 if self.data[start : start + 2] == b"\r\n" else 1
                size = value.get("Length")
                end = start + size if isinstance(size, int) and self.data[start + size : start + size + 12].lstrip().startswith(b"endstream") else self.data.find(b"endstream", start)
                end = len(self.data) if end < 0 else end
                value, at = Stream(value, self.data[start:end].rstrip(b"\r\n") if not isinstance(size, int) else self.data[start:end]), end
                if value.values.get("Type") == "XRef":
                    self.trailer = self.trailer | value.values
            self._put(int(m[1]), value, source)
            at = max(at, m.end())
            self._reach = max(at, scan.at) + len(b"\r\nendstream")
        return at

    def _put(self, number: int, value: Any, source: bytes) -> None:
        self.objects[number] = value
        self._raw[number] = source

    @property
    def sources(self) -> dict[int, str]:
        """The text of each object, of a stream its dictionary, with single blanks."""
        return {number: self.object_text(number) for number in self._raw}

    def _unpack(self) -> None:
        for value in [v for v in self.objects.values() if isinstance(v, Stream) and v.values.get("Type") == "ObjStm"]:
            body, first = self.decoded(value), self.get(value.values.get("First"))
            head = Scanner(body)
            for _ in range(self.get(value.values.get("N")) or 0):
                number, offset = head.value(), head.value()
                if isinstance(number, int) and isinstance(offset, int) and isinstance(first, int):
                    scan = Scanner(body, first + offset)
                    inner = scan.value()
                    self._put(number, inner, body[first + offset : scan.at])

    def get(self, value: Any) -> Any:
        """The value, references followed."""
        for _ in range(_DEPTH):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        return None

    def dictionary(self, value: Any) -> dict:
        value = self.get(value)
        return value.values if isinstance(value, Stream) else value if isinstance(value, dict) else {}

    def array(self, value: Any) -> list:
        value = self.get(value)
        return value if isinstance(value, list) else [] if value is None else [value]

    def filters(self, stream: Stream) -> list[str]:
        return [str(self.get(f)) for f in self.array(stream.values.get("Filter"))]

    def decoded(self, stream: Stream) -> bytes:
        """A stream's data; image codecs are left as they are."""
        data = stream.raw
        parms = [self.dictionary(p) for p in self.array(stream.values.get("DecodeParms"))]
        for i, name in enumerate(self.filters(stream)):
            if name in ("FlateDecode", "Fl"):
                data = _unpredicted(_inflated(data), parms[i] if i < len(parms) else {})
            elif name in ("ASCIIHexDecode", "AHx"):
                data = Scanner(b"<" + data.split(b">")[0] + b">").value()
            elif name in ("ASCII85Decode", "A85"):
                data = _ascii85(data)
            elif name in ("RunLengthDecode", "RL"):
                data = _run_lengths(data)
            else:
                break
        return data

    # Pages

    def pages(self) -> list[tuple[int, dict]]:
        """(object number, dictionary with inherited entries) of every page in order."""
        out: list[tuple[int, dict]] = []
        seen: set[int] = set()

        def walk(ref: Any, inherited: dict, depth: int) -> None:
            number = ref.number if isinstance(ref, Ref) else -1
            node = self.dictionary(ref)
            if not node or depth > _DEPTH or (number in seen and number >= 0):
                return
            seen.add(number)
            passed = inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            if "Kids" in node:
                for kid in self.array(node["Kids"]):
                    walk(kid, passed, depth + 1)
            else:
                out.append((number, passed | node))

        root = self.dictionary(self.trailer.get("Root")) or next((v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), {})
        walk(root.get("Pages"), {}, 0)
        return out

    def page_contents(self) -> dict[int, int]:
        """Object number of each content stream to the page, from 1, that shows it."""
        return {ref.number: i + 1 for i, (_, page) in enumerate(self.pages()) for ref in (self.array(page.get("Contents")) if not isinstance(page.get("Contents"), Ref) or isinstance(self.get(page["Contents"]), list) else [page["Contents"]]) if isinstance(ref, Ref)}

    def size_of(self, page: dict) -> tuple[float, float]:
        box = [self.get(x) for x in self.array(page.get("CropBox") or page.get("MediaBox"))]
        if len(box) != 4 or not all(isinstance(x, (int, float)) for x in box):
            return 612.0, 792.0
        return abs(float(box[2] - box[0])), abs(float(box[3] - box[1]))

    def _resources(self, page: dict, kind: str) -> dict:
        return self.dictionary(self.dictionary(page.get("Resources")).get(kind))

    def font(self, ref: Any) -> Font:
        number = ref.number if isinstance(ref, Ref) else -1
        if number not in self._fonts or number < 0:
            self._fonts[number] = self._read_font(self.dictionary(ref))
        return self._fonts[number]

    def _read_font(self, values: dict) -> Font:
        inner = self.dictionary(next(iter(self.array(values.get("DescendantFonts"))), None)) or values
        held = self.dictionary(inner.get("FontDescriptor"))
        font = Font(str(values.get("BaseFont") or inner.get("BaseFont") or values.get("Name") or "unknown"), any(k in held for k in ("FontFile", "FontFile2", "FontFile3")), wide=values.get("Subtype") == "Type0")
        number = lambda x: x if isinstance(x, (int, float)) else 0
        first = self.get(values.get("FirstChar"))
        if isinstance(first, int):
            font.widths = {first + i: float(number(self.get(w))) for i, w in enumerate(self.array(values.get("Widths")))}
        if font.wide:
            font.default_width = float(number(self.get(inner.get("DW"))) or 1000)
        table = self.get(values.get("ToUnicode"))
        if isinstance(table, Stream):
            font.unicode = _character_map(self.decoded(table))
        return font

    def fonts(self) -> list[tuple[int, str, bool]]:
        """(page, name, embedded) of each font that a page names."""
        return [(i + 1, f.name, f.embedded) for i, (_, page) in enumerate(self.pages()) for f in map(self.font, self._resources(page, "Font").values())]

    def images(self) -> list[dict]:
        out = []
        for i, (_, page) in enumerate(self.pages()):
            width, height = self.size_of(page)
            for ref in self._resources(page, "XObject").values():
                image = self.get(ref)
                if not isinstance(image, Stream) or image.values.get("Subtype") != "Image":
                    continue
                w, h, bits = (self.get(image.values.get(k)) for k in ("Width", "Height", "BitsPerComponent"))
                w, h, bits = (int(x) if isinstance(x, (int, float)) else 0 for x in (w, h, bits))
                space = self.get(image.values.get("ColorSpace"))
                out.append({
                    "xref": ref.number if isinstance(ref, Ref) else 0, "page": i + 1, "width": w, "height": h, "bpc": bits, "size_bytes": len(image.raw),
                    "colorspace": str(space[0] if isinstance(space, list) and space else space or ""), "filter": ",".join(self.filters(image)),
                    "dpi_x": w / (width / 72) if width else 0.0, "dpi_y": h / (height / 72) if height else 0.0,
                })
        return out

    def pixels(self) -> list[dict]:
        """(page, height, width, nChannels, data in BGR order) of images in 8-bit gray or RGB that need no image codec."""
        out = []
        for found in self.images():
            image = self.objects.get(found["xref"])
            channels = {"DeviceGray": 1, "DeviceRGB": 3}.get(found["colorspace"], 0)
            if not isinstance(image, Stream) or not channels or found["bpc"] != 8:
                continue
            data, n = self.decoded(image), found["width"] * found["height"] * channels
            if not n or len(data) < n or set(self.filters(image)) & {"DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode", "DCT", "LZWDecode"}:
                continue
            if channels == 3:
                swapped = bytearray(data[:n])
                swapped[0::3], swapped[2::3] = data[2:n:3], data[0:n:3]
                data = bytes(swapped)
            out.append({"page": found["page"], "height": found["height"], "width": found["width"], "nChannels": channels, "data": data[:n]})
        return out

    # Text

    def spans(self) -> list[dict]:
        """(page, block, line, text, font, bbox) of each run of text that is shown, in the order of the streams."""
        if self.encrypted:
            return []
        if self._spans is None:  # texts, lines and blocks are made of them
            self._spans = [{"page": i + 1, **span} for i, (_, page) in enumerate(self.pages()) for span in self._page_spans(page)]
        return self._spans

    def _page_spans(self, page: dict) -> list[dict]:
        parts = [self.get(c) for c in self.array(page.get("Contents"))]
        data = b"\n".join(self.decoded(c) for c in parts if isinstance(c, Stream))
        return Show(self, page, self.size_of(page)[1]).run(data)

    def text(self) -> list[str]:
        """Plain text of each page: a line for each line of spans."""
        out = []
        for i in range(len(self.pages())):
            out.append("")
        lines: dict[tuple, str] = {}
        for span in self.spans():
            key = (span["page"], span["line"])
            lines[key] = lines.get(key, "") + span["text"]
        for (page, _), line in lines.items():
            if line.strip():
                out[page - 1] += line.rstrip() + "\n"
        return out

    def lines(self) -> list[dict]:
        """(page, spans of text and font) of each line, in order."""
        out: dict[tuple, list[dict]] = {}
        for span in self.spans():
            out.setdefault((span["page"], span["line"]), []).append({"text": span["text"], "font": span["font"]})
        return [{"page": page, "spans": spans} for (page, _), spans in out.items()]

    def blocks(self) -> list[dict]:
        """(page, texts, bbox around them) of each block."""
        out: dict[tuple, dict] = {}
        for span in self.spans():
            box = span["bbox"]
            block = out.setdefault((span["page"], span["block"]), {"page": span["page"], "spans": [], "bbox": list(box)})
            block["spans"].append(span["text"])
            block["bbox"] = [pick(a, b) for pick, a, b in zip((min, min, max, max), block["bbox"], box)]
        return list(out.values())

    # Facts about the file

    def metadata(self) -> dict[str, str]:
        """The information dictionary as text, by lower-case name with the usual spellings."""
        names = {"Title": "title", "Author": "author", "Subject": "subject", "Keywords": "keywords", "Creator": "creator", "Producer": "producer", "CreationDate": "creationDate", "ModDate": "modDate"}
        found = self.dictionary(self.trailer.get("Info"))
        return {as_: s for name, as_ in names.items() if (s := _string(self.get(found.get(name)))) is not None}

    def xmp(self) -> str:
        """The first metadata stream, or an empty text."""
        found = next((v for v in self.objects.values() if isinstance(v, Stream) and v.values.get("Subtype") == "XML"), None)
        return self.decoded(found).decode("utf-8", "replace") if found else ""

    def annotations(self) -> list[dict]:
        out = []
        for i, (_, page) in enumerate(self.pages()):
            for a in map(self.dictionary, self.array(page.get("Annots"))):
                kind = str(self.get(a.get("Subtype")) or "")
                if not kind or kind == "Widget":
                    continue
                action = self.dictionary(a.get("A"))
                info = [_string(self.get(a.get(k))) for k in ("Contents", "T", "Subj")] + [str(action.get("S") or ""), _string(self.get(action.get("URI")))]
                opacity = self.get(a.get("CA"))
                out.append({"page": i + 1, "type": kind, "opacity": float(opacity) if isinstance(opacity, (int, float)) else 1.0, "info": " ".join(x for x in info if x)})
        return out

    def widgets(self) -> list[dict]:
        kinds = {"Tx": "Text", "Btn": "Button", "Ch": "Choice", "Sig": "Signature"}
        out = []
        for i, (_, page) in enumerate(self.pages()):
            for a in map(self.dictionary, self.array(page.get("Annots"))):
                if self.get(a.get("Subtype")) == "Widget":
                    parent = self.dictionary(a.get("Parent"))
                    kind = str(self.get(a.get("FT") or parent.get("FT")) or "")
                    out.append({"page": i + 1, "type": kinds.get(kind, kind), "name": _string(self.get(a.get("T") or parent.get("T"))) or ""})
        return out

    def attachments(self) -> list[dict]:
        out = []
        for value in self.objects.values():
            if isinstance(value, dict) and value.get("Type") in ("Filespec", "F") and "EF" in value:
                held = self.get(next(iter(self.dictionary(value["EF"]).values()), None))
                out.append({"name": _string(self.get(value.get("UF") or value.get("F"))) or "", "size": len(self.decoded(held)) if isinstance(held, Stream) else 0})
        return out

    def object_text(self, number: int) -> str:
        return " ".join(self._raw.get(number, b"").decode("latin-1").split())

    def stream_text(self, number: int) -> str:
        """The text that a content stream shows, by its strings alone."""
        value = self.objects.get(number)
        return content_text(self.decoded(value)) if isinstance(value, Stream) else ""


def content_text(data: bytes) -> str:
    """Strings that text operators show, in the order of the operators' kinds: Tj, TJ, ' and "; blanks between them.

    ``'`` and ``"`` begin a line. This needs no fonts and reads strings as one byte a character.
    """
    shown: dict[bytes, list[str]] = {b"Tj": [], b"TJ": [], b"'": [], b'"': []}
    scan, operands = Scanner(data), []
    while (value := scan.value()) is not None:
        if not isinstance(value, Op) or value not in shown or not operands:
            operands = [*operands[-3:], value]
            continue
        last = operands[-1]
        strings = [x for x in (last if isinstance(last, list) else [last]) if _is_string(x)]
        line = ["\n"] if value in (b"'", b'"') and strings else []
        shown[value] += line + [s.decode("latin-1") for s in strings]
        operands = []
    return " ".join(x for parts in shown.values() for x in parts).strip()


class Show:
    """Runs a page's content stream and notes which strings are shown where."""

    def __init__(self, pdf: Pdf, page: dict, height: float, depth: int = 0):
        self.pdf, self.page, self.height, self.depth = pdf, page, height, depth
        self.fonts = pdf._resources(page, "Font")
        self.font, self.size = Font("unknown", False), 12.0
        self.x = self.y = self.line_x = self.line_y = self.leading = 0.0
        self.scale, self.move = (1.0, 1.0), (0.0, 0.0)
        self.stack: list[tuple] = []
        self.out: list[dict] = []
        self.line = self.block = -1
        self.end: tuple[float, float] | None = None

    def run(self, data: bytes) -> list[dict]:
        scan, operands = Scanner(_INLINE_IMAGE.sub(b" ", data)), []
        while (value := scan.value()) is not None:
            if isinstance(value, Op):
                action = getattr(self, "_" + _OPERATORS[value], None) if value in _OPERATORS else None
                if action:
                    try:
                        action(operands)
                    except (TypeError, ValueError, IndexError):
                        pass  # an operator with the wrong operands does nothing
                operands = []
            else:
                operands = [*operands[-40:], value]
        return self.out

    def _save(self, _) -> None:
        self.stack.append((self.font, self.size, self.scale, self.move))

    def _restore(self, _) -> None:
        if self.stack:
            self.font, self.size, self.scale, self.move = self.stack.pop()

    def _concat(self, m) -> None:
        a, _, _, d, e, f = map(float, m[-6:])
        self.move = (self.move[0] + e * self.scale[0], self.move[1] + f * self.scale[1])
        self.scale = (self.scale[0] * (a or 1.0), self.scale[1] * (d or 1.0))

    def _begin(self, _) -> None:
        self.x = self.y = self.line_x = self.line_y = 0.0
        self.block += 1

    def _set_font(self, v) -> None:
        self.font, self.size = self.pdf.font(self.fonts.get(v[-2])), float(v[-1])

    def _set_leading(self, v) -> None:
        self.leading = float(v[-1])

    def _next(self, v) -> None:
        self.line_x, self.line_y = self.line_x + float(v[-2]), self.line_y + float(v[-1])
        self.x, self.y = self.line_x, self.line_y

    def _next_leading(self, v) -> None:
        self.leading = -float(v[-1])
        self._next(v)

    def _matrix(self, v) -> None:
        self.line_x, self.line_y = float(v[-2]), float(v[-1])
        self.x, self.y = self.line_x, self.line_y

    def _down(self, _) -> None:
        self._next([0, -(self.leading or self.size * 1.2)])

    def _show(self, v) -> None:
        self._put([v[-1]])

    def _show_array(self, v) -> None:
        self._put(v[-1])

    def _down_show(self, v) -> None:
        self._down(v)
        self._put([v[-1]])

    def _draw(self, v) -> None:
        """A form is run with its own resources."""
        form = self.pdf.get(self.pdf._resources(self.page, "XObject").get(v[-1]))
        if isinstance(form, Stream) and form.values.get("Subtype") == "Form" and self.depth < 8:
            inner = Show(self.pdf, {"Resources": form.values.get("Resources", self.page.get("Resources"))}, self.height, self.depth + 1)
            inner.scale, inner.move, inner.line, inner.block, inner.end = self.scale, self.move, self.line, self.block, self.end
            self.out += inner.run(self.pdf.decoded(form))
            self.line, self.block, self.end = inner.line, inner.block, inner.end

    def _put(self, items) -> None:
        text, start = "", self.x
        for item in items:
            if _is_string(item):
                shown, width = self.font.decode(item)
                text += shown
                self.x += width / 1000 * self.size
            elif isinstance(item, (int, float)):
                gap = -item / 1000
                text += " " if gap > _GAP and text and not text.endswith(" ") else ""
                self.x += gap * self.size
        if not text:
            return
        left, base = start * self.scale[0] + self.move[0], self.y * self.scale[1] + self.move[1]
        if self.end is None or abs(self.end[1] - base) > 0.5:
            self.line += 1
        elif left - self.end[0] > _GAP * self.size and self.out and not self.out[-1]["text"].endswith(" "):
            text = " " + text
        right = self.x * self.scale[0] + self.move[0]
        self.end = (right, base)
        size = abs(self.size * self.scale[1])
        box = [left, self.height - base - size, right, self.height - base]
        self.out.append({"block": max(0, self.block), "line": self.line, "text": text, "font": self.font.name, "bbox": [float(x) for x in box]})


# Operators that matter for text, and what is done for them.
_OPERATORS = {
    b"q": "save", b"Q": "restore", b"cm": "concat", b"BT": "begin", b"Tf": "set_font", b"TL": "set_leading", b"Td": "next", b"TD": "next_leading",
    b"Tm": "matrix", b"T*": "down", b"Tj": "show", b"TJ": "show_array", b"'": "down_show", b'"': "down_show", b"Do": "draw",
}
