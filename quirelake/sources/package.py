"""Zip packages of office documents: their parts, relationships and properties."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

MAX_PART_BYTES, MAX_PACKAGE_BYTES = 64 << 20, 256 << 20
FORMATS = ("docx", "xlsx", "csv", "pptx", "pdf")
MAIN_PARTS = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "pptx": "ppt/presentation.xml"}


def local(tag) -> str:
    """A name without its namespace."""
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def attr(el: ET.Element, name: str, default: str | None = None) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in el.attrib.items() if local(k) == name), default)


class Package:
    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = {n.lstrip("/"): n for n in self.zip.namelist()}
        self.read_bytes = 0

    def has(self, part: str) -> bool:
        return part.lstrip("/") in self.names

    def bytes(self, part: str) -> bytes | None:
        name = self.names.get(part.lstrip("/"))
        if name is None:
            return None
        size = self.zip.getinfo(name).file_size
        self.read_bytes += size
        if size > MAX_PART_BYTES or self.read_bytes > MAX_PACKAGE_BYTES:
            raise ValueError(f"too large: {part}")
        return self.zip.read(name)

    def xml(self, part: str) -> ET.Element | None:
        raw = self.bytes(part)
        return None if raw is None else ET.fromstring(raw)

    def required(self, part: str) -> ET.Element:
        root = self.xml(part)
        if root is None:
            raise ValueError(f"missing part: {part}")
        return root

    def parts(self, prefix: str = "", suffix: str = "") -> list[str]:
        return sorted(n for n in self.names if n.startswith(prefix) and n.endswith(suffix))

    def rels(self, part: str) -> list[dict]:
        """Relationships of a part: id, type, target (resolved), raw, external."""
        folder, _, name = part.rpartition("/")
        root = self.xml(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        out = []
        for el in root if root is not None else ():
            raw = el.get("Target", "")
            external = el.get("TargetMode", "").lower() == "external" or re.match(r"(?i)https?://|mailto:", raw) is not None
            target = raw if external else resolve(folder, raw)
            out.append({"id": el.get("Id", ""), "type": el.get("Type", ""), "raw": raw, "target": target, "external": external})
        return out

    def content_types(self) -> tuple[dict[str, str], dict[str, str]]:
        root = self.xml("[Content_Types].xml")
        by_ext, by_part = {}, {}
        for el in root if root is not None else ():
            if local(el.tag) == "Default":
                by_ext[el.get("Extension", "").lower()] = el.get("ContentType", "")
            elif local(el.tag) == "Override":
                by_part[el.get("PartName", "").lstrip("/")] = el.get("ContentType", "")
        return by_ext, by_part

    def content_type(self, part: str) -> str | None:
        by_ext, by_part = self.content_types()
        return by_part.get(part.lstrip("/"), by_ext.get(part.rpartition(".")[2].lower()))

    def properties(self, qualified: bool = False, custom: bool = True) -> dict | None:
        """core, app and custom properties; the last of equal names wins. qualified: names keep their prefix."""
        out = {"core": self._texts("docProps/core.xml", qualified), "app": self._texts("docProps/app.xml", qualified), "custom": {}}
        root = self.xml("docProps/custom.xml") if custom else None
        for el in root if root is not None else ():
            if local(el.tag) == "property":
                out["custom"][el.get("name", "")] = "".join(el.itertext()).strip()
        return out if any(out.values()) else None

    def _texts(self, part: str, qualified: bool) -> dict[str, str]:
        raw = self.bytes(part)
        if raw is None:
            return {}
        prefix = {u.decode(): p.decode() for p, u in re.findall(rb'xmlns:(\w+)="([^"]*)"', raw)}
        out = {}
        for el in ET.fromstring(raw).iter():
            text = (el.text or "").strip()
            if text:
                space = el.tag[1:].partition("}")[0] if el.tag.startswith("{") else ""
                name = local(el.tag)
                out[f"{prefix[space]}:{name}" if qualified and space in prefix else name] = text
        return out


def resolve(base: str, target: str) -> str:
    """The part that a target names, seen from a folder."""
    path = target if target.startswith("/") or (base and target.startswith(base + "/")) else f"{base}/{target}"
    return posixpath.normpath("/" + path).lstrip("/")


def looks_like_pdf(content: bytes) -> bool:
    return re.match(rb"(\xef\xbb\xbf)?[\t\n\f\r ]*%PDF-", content[:1024]) is not None


def detect_format(content: bytes) -> str:
    if looks_like_pdf(content):
        return "pdf"
    try:
        names = set(Package(content).names)
    except zipfile.BadZipFile:
        raise ValueError("unknown format") from None
    for fmt, part in MAIN_PARTS.items():
        if part in names:
            return fmt
    raise ValueError("unknown format")


def parse_format(name: str | None) -> str | None:
    n = (name or "").strip().lower().removeprefix(".")
    return n if n in FORMATS else None


def resolve_format(content: bytes, hint: str | None = None, path: str | None = None) -> str:
    return parse_format(hint) or (parse_format(path.rpartition(".")[2]) if path and "." in path else None) or detect_format(content)


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&apos;")


def write(parts: dict[str, str | bytes]) -> bytes:
    """A package of parts, in the order of their names; the same parts give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(parts):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), parts[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()
