"""Text of simple PDF files, with the standard library alone.

Reads objects (in the clear or in object streams), the page tree, Flate-coded content
streams and the text operators; fonts with a ToUnicode map are read by it, others as Latin-1.
Files that are encrypted, or have no text (scans), say so instead.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class PdfError(ValueError):
    """The file can't be read."""


def _inflate(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    if b"/FlateDecode" not in body[: m.start()]:
        return m[1]
    try:
        return zlib.decompressobj().decompress(m[1])
    except zlib.error as e:
        raise PdfError("a stream is damaged") from e


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            inner, first = _inflate(body), int(re.search(rb"/First\s+(\d+)", body)[1])
            numbers = list(map(int, inner[:first].split()))
            places = [first + at for at in numbers[1::2]] + [len(inner)]
            found |= {n: inner[a:b] for n, a, b in zip(numbers[::2], places, places[1:], strict=False)}
    return found


def _pages(objects: dict[int, bytes], node: int, seen: set[int]) -> list[int]:
    body = objects.get(node, b"")
    if node in seen:
        return []
    seen.add(node)
    kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
    return [p for k in _REF.findall(kids[1]) for p in _pages(objects, int(k), seen)] if kids else [node]


def _unicode_map(cmap: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}

    def code(x: bytes) -> bytes:
        return bytes.fromhex(x.decode())

    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        pairs = re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)
        out |= {code(a): code(b).decode("utf-16-be", "replace") for a, b in pairs}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            lo, hi, to, width = int(a, 16), int(b, 16), int(c, 16), len(a) // 2
            out |= {(lo + i).to_bytes(width, "big"): chr(to + i) for i in range(min(hi - lo, 0xFFFF) + 1)}
    return out


def _said(token: bytes, codes: dict[bytes, str] | None) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPE.sub(lambda m: _PLAIN.get(m[1], m[1]) if not m[1].isdigit() else bytes([int(m[1], 8) & 255]), token[1:-1])
    if not codes:
        return raw.decode("latin-1")
    width = max(map(len, codes))
    return "".join(codes.get(raw[i : i + width], "") for i in range(0, len(raw), width))


def _page_text(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    out: list[str] = []
    held: list[bytes] = []
    codes = None
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<[]/-+.0123456789":
            held.append(token)
            continue
        if token == b"Tf":
            codes = next((fonts.get(x[1:]) for x in reversed(held) if x[:1] == b"/"), None)
        elif token in (b"Tj", b"'", b'"', b"TJ"):
            if token in (b"'", b'"'):
                out.append("\n")
            for x in held:
                if x[:1] in b"(<":
                    out.append(_said(x, codes))
                elif token == b"TJ" and x[:1] not in b"[]/" and float(x) < -200:
                    out.append(" ")
        elif token in (b"T*", b"ET") or (token in (b"Td", b"TD") and len(held) > 1 and float(held[-1]) != 0):
            out.append("\n")
        held = []
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n")


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page."""
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise PdfError("the file is encrypted")
    objects = _objects(data)
    root = next((n for n, b in objects.items() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    tree = re.search(rb"/Pages\s+(\d+)", objects.get(root, b"")) if root is not None else None
    if not tree:
        raise PdfError("the file has no page tree")
    out = []
    for page in _pages(objects, int(tree[1]), set()):
        body = objects.get(page, b"")
        where = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
        content = b"\n".join(_inflate(objects.get(int(n), b"")) for n in _REF.findall(where[1])) if where else b""
        shared = re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", body)
        resources = objects.get(int(shared[1]), b"") if shared else body
        table = re.search(rb"/Font\s*(?:<<(.*?)>>|(\d+)\s+\d+\s+R)", resources, re.S)
        listed = (table[1] if table[1] is not None else objects.get(int(table[2]), b"")) if table else b""
        fonts = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", listed):
            to = re.search(rb"/ToUnicode\s+(\d+)", objects.get(int(number), b""))
            if to:
                fonts[name] = _unicode_map(_inflate(objects.get(int(to[1]), b"")))
        out.append(_page_text(content, fonts))
    return out
