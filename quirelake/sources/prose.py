"""Word-processing documents and presentations, as sections and slides of paragraphs, tables and comments."""

from __future__ import annotations

import re
from xml.etree import ElementTree as ET

from . import ir
from .package import Package, attr, local

HYPERLINK = re.compile(r'(?i)HYPERLINK\s*"([^"]*)"')


def _kids(el: ET.Element | None, *names: str):
    return [] if el is None else [c for c in el if local(c.tag) in names]


def _merge(inlines: list[dict]) -> list[dict]:
    """Neighbouring texts as one, empty ones left out."""
    out: list[dict] = []
    for i in inlines:
        if "Text" in i:
            if not i["Text"]:
                continue
            if out and "Text" in out[-1]:
                out[-1] = ir.text(out[-1]["Text"] + i["Text"])
                continue
        out.append(i)
    return out


class _Body:
    """Reads the blocks of one word-processing part."""

    def __init__(self, links: dict[str, str], comments: dict[str, dict]) -> None:
        self.links, self.known, self.used = links, comments, {}

    def blocks(self, el: ET.Element) -> list[dict]:
        out = []
        for child in el:
            name = local(child.tag)
            if name == "p":
                p = self.paragraph(child)
                if p["inlines"]:
                    out.append({"Paragraph": p})
            elif name == "tbl":
                out.append({"Table": ir.table(self.rows(child))})
            elif name in ("sdt", "sdtContent", "customXml", "smartTag", "ins", "footnote", "endnote"):
                out += self.blocks(child)
        return out

    def rows(self, tbl: ET.Element) -> list[list[dict]]:
        return [[self.cell(tc) for tc in _kids(tr, "tc")] for tr in _kids(tbl, "tr")]

    def cell(self, tc: ET.Element) -> dict:
        paras = [b["Paragraph"] for b in self.blocks(tc) if "Paragraph" in b]
        return ir.cell(*(paras or [ir.paragraph(ir.text(""))]))

    def paragraph(self, p: ET.Element) -> dict:
        out: list[dict] = []
        field: dict | None = None  # a complex field: its instruction, and where its result starts
        for kind, value in self.runs(p):
            if kind == "begin":
                field = {"instr": "", "at": None}
            elif kind == "instr" and field is not None:
                field["instr"] += value
            elif kind == "separate" and field is not None:
                field["at"] = len(out)
            elif kind == "end" and field is not None:
                target = self.field_target(field["instr"])
                if target and field["at"] is not None:
                    shown = "".join(i["Text"] if "Text" in i else i["Link"]["display"] for i in out[field["at"] :])
                    out[field["at"] :] = [ir.link(shown, target)]
                field = None
            elif kind == "text":
                out.append(ir.text(value))
            elif kind == "link":
                out.append(value)
        return {"inlines": _merge(out)}

    @staticmethod
    def field_target(instr: str) -> str | None:
        if m := HYPERLINK.search(instr):
            return m[1]
        return next((w for w in instr.split() if w.startswith(("http://", "https://", "mailto:"))), None)

    def runs(self, el: ET.Element):
        for child in el:
            name = local(child.tag)
            if name == "t":
                yield "text", child.text or ""
            elif name == "tab":
                yield "text", "\t"
            elif name in ("br", "cr"):
                yield "text", "\n"
            elif name == "instrText":
                yield "instr", child.text or ""
            elif name == "fldChar":
                yield attr(child, "fldCharType", ""), ""
            elif name in ("hyperlink", "fldSimple"):
                shown = "".join(v if k == "text" else v["Link"]["display"] if k == "link" else "" for k, v in self.runs(child))
                rid = next((v for k, v in child.attrib.items() if k.endswith("}id")), None)
                target = self.links.get(rid or "", "") if name == "hyperlink" else self.field_target(attr(child, "instr", "")) or ""
                yield ("link", ir.link(shown, target, rid)) if target else ("text", shown)
            elif name in ("commentReference", "commentRangeStart"):
                note = self.known.get(attr(child, "id", ""))
                if note:
                    self.used.setdefault(note["id"], note)
                    if name == "commentReference":
                        yield "text", f"[^{note['id']}]"
            elif name in ("r", "ins", "smartTag", "sdt", "sdtContent", "customXml"):
                yield from self.runs(child)


def _docx_comments(package: Package) -> dict[str, dict]:
    root = package.xml("word/comments.xml")
    out = {}
    for el in _kids(root, "comment"):
        lines = ["".join(t.text or "" for t in p.iter() if local(t.tag) == "t") for p in el.iter() if local(p.tag) == "p"]
        raw = attr(el, "id", "")
        out[raw] = {"id": f"c{raw}", "author": attr(el, "author", ""), "text": "\n".join(lines).strip()}
    return out


def read_docx(content: bytes, properties: bool = True) -> dict:
    """Body, headers, footers, footnotes and endnotes, in this order, as sections."""
    package = Package(content)
    comments = _docx_comments(package)
    parts = ["word/document.xml", *package.parts("word/header", ".xml"), *package.parts("word/footer", ".xml"), *(p for p in ("word/footnotes.xml", "word/endnotes.xml") if package.has(p))]
    sections = []
    for part in parts:
        root = package.required(part)
        links = {r["id"]: r["target"] for r in package.rels(part) if r["external"] and r["type"].endswith("/hyperlink")}
        body = _Body(links, comments)
        first = next(iter(_kids(root, "body")), root)
        name = "body" if part == "word/document.xml" else part.rpartition("/")[2].removesuffix(".xml")
        sections.append({"name": name, "blocks": body.blocks(first), "comments": list(body.used.values())})
    return ir.document("Docx", sections=sections, properties=package.properties() if properties else None)


class _Slide:
    def __init__(self, links: dict[str, str]) -> None:
        self.links = links

    def paragraph(self, p: ET.Element) -> dict:
        out = []
        for run in p:
            name = local(run.tag)
            if name == "br":
                out.append(ir.text("\n"))
            if name not in ("r", "fld"):
                continue
            shown = "".join(t.text or "" for t in _kids(run, "t"))
            click = next((c for pr in _kids(run, "rPr") for c in _kids(pr, "hlinkClick")), None)
            rid = next((v for k, v in click.attrib.items() if k.endswith("}id")), "") if click is not None else ""
            target = self.links.get(rid, "")
            out.append(ir.link(shown, target, rid) if target else ir.text(shown))
        return {"inlines": _merge(out)}

    def paragraphs(self, el: ET.Element) -> list[dict]:
        found = [self.paragraph(p) for p in el.iter() if local(p.tag) == "p"]
        return [p for p in found if ir.plain(p).strip()]

    def blocks(self, root: ET.Element, tables: bool = True) -> tuple[str | None, list[dict]]:
        title, out = None, []
        for el in self.shapes(root):
            if local(el.tag) == "tbl":
                if tables:
                    rows = [[ir.cell(*(self.paragraphs(tc) or [ir.paragraph(ir.text(""))])) for tc in _kids(tr, "tc")] for tr in _kids(el, "tr")]
                    out.append({"Table": ir.table(rows)})
                continue
            paras = self.paragraphs(el)
            kinds = {attr(ph, "type", "") for ph in el.iter() if local(ph.tag) == "ph"}
            if title is None and paras and kinds & {"title", "ctrTitle"}:
                title = ir.plain(paras[0]).strip()
            out += [{"Paragraph": p} for p in paras]
        if title is None:
            title = next((ir.plain(b["Paragraph"]).strip() for b in out if "Paragraph" in b), None)
        return title, out

    def shapes(self, el: ET.Element):
        for child in el:
            if local(child.tag) in ("sp", "tbl"):
                yield child
            else:
                yield from self.shapes(child)


def _pptx_comments(package: Package, rels: list[dict]) -> list[dict]:
    authors = {attr(a, "id", ""): attr(a, "name", "") for a in _kids(package.xml("ppt/commentAuthors.xml"), "cmAuthor")}
    out = []
    for rel in rels:
        if rel["type"].endswith("/comments") and (root := package.xml(rel["target"])) is not None:
            for cm in _kids(root, "cm"):
                said = "".join((t.text or "") for t in cm.iter() if local(t.tag) in ("text", "t")).strip()
                who = attr(cm, "authorId", "")
                out.append({"id": f"c{len(out) + 1}", "author": authors.get(who, who), "text": said})
            break
    return out


def read_pptx(content: bytes, properties: bool = True, slides: set[int] | None = None) -> dict:
    package = Package(content)
    deck = package.required("ppt/presentation.xml")
    by_id = {r["id"]: r["target"] for r in package.rels("ppt/presentation.xml")}
    order = [next(v for k, v in el.attrib.items() if k.startswith("{") and local(k) == "id") for el in deck.iter() if local(el.tag) == "sldId"]
    out = []
    for number, rid in enumerate(order, 1):
        if slides and number not in slides:
            continue
        if rid not in by_id:
            raise ValueError(f"no relationship for slide {number}")
        part = by_id[rid]
        rels = package.rels(part)
        own = _Slide({r["id"]: r["target"] for r in rels if r["type"].endswith("/hyperlink")})
        title, blocks = own.blocks(package.required(part))
        notes = None
        for rel in rels:
            if rel["type"].endswith("/notesSlide") and (root := package.xml(rel["target"])) is not None:
                notes = [b["Paragraph"] for b in _Slide({}).blocks(root, tables=False)[1]] or None
                break
        out.append({"number": number, "title": title, "blocks": blocks, "notes": notes, "comments": _pptx_comments(package, rels)})
    return ir.document("Pptx", slides=out, properties=package.properties() if properties else None)
