"""Office packages from document trees."""

from __future__ import annotations

import re

from . import ir
from .package import escape, write
from .spreadsheets import col_name

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
MIME = "application/vnd.openxmlformats-officedocument"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


class _Parts:
    """Parts with their content types and relationships."""

    def __init__(self) -> None:
        self.parts: dict[str, str] = {}
        self.types: dict[str, str] = {}
        self.rels: dict[str, list[tuple[str, str, str, bool]]] = {}

    def add(self, name: str, mime: str, xml: str) -> None:
        self.parts[name], self.types[name] = HEAD + xml, f"{MIME}.{mime}+xml"

    def rel(self, part: str, kind: str, target: str, external: bool = False) -> str:
        own = self.rels.setdefault(part, [])
        own.append((f"rId{len(own) + 1}", kind, target, external))
        return own[-1][0]

    def bytes(self) -> bytes:
        out: dict[str, str | bytes] = dict(self.parts)
        for part, rels in self.rels.items():
            folder, _, name = part.rpartition("/")
            items = "".join(f'<Relationship Id="{i}" Type="{R}/{k}" Target="{escape(t)}"' + (' TargetMode="External"' if x else "") + "/>" for i, k, t, x in rels)
            out[f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"] = f'{HEAD}<Relationships xmlns="{RELS}">{items}</Relationships>'
        types = "".join(f'<Override PartName="/{n}" ContentType="{t}"/>' for n, t in self.types.items())
        out["[Content_Types].xml"] = f'{HEAD}<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>'
        return write(out)


def _t(tag: str, text: str) -> str:
    return f'<{tag} xml:space="preserve">{escape(text)}</{tag}>'


def _header_row(t: dict) -> list[list[dict]]:
    head = [] if t["synthetic_headers"] else [[ir.cell(ir.paragraph(ir.text(h))) for h in t["headers"]]]
    rows = head + t["rows"]
    width = max(map(len, rows), default=0)
    return [r + [ir.cell(ir.paragraph(ir.text("")))] * (width - len(r)) for r in rows]


def docx(doc: dict) -> bytes:
    """The body section; its comments and links."""
    z = _Parts()
    main = "word/document.xml"
    body = next((s for s in doc["sections"] if s["name"] == "body"), doc["sections"][0] if doc["sections"] else {"blocks": [], "comments": []})
    ids = {c["id"]: str(i) for i, c in enumerate(body["comments"])}

    def run(text: str) -> str:
        out = ""
        for piece in re.split(r"(\[\^[^\]|]+\])", text):
            if piece[:2] == "[^" and piece[2:-1] in ids:
                out += f'<w:r><w:commentReference w:id="{ids[piece[2:-1]]}"/></w:r>'
            elif piece:
                out += f"<w:r>{_t('w:t', piece)}</w:r>"
        return out

    def para(p: dict) -> str:
        out = ""
        for i in p["inlines"]:
            if "Text" in i:
                out += run(i["Text"])
            else:
                rid = z.rel(main, "hyperlink", i["Link"]["target"], True)
                out += f'<w:hyperlink r:id="{rid}"><w:r>{_t("w:t", i["Link"]["display"])}</w:r></w:hyperlink>'
        return f"<w:p>{out}</w:p>"

    def block(b) -> str:
        if b == "Separator":
            return "<w:p/>"
        if "Paragraph" in b:
            return para(b["Paragraph"])
        rows = _header_row(b["Table"])
        grid = "<w:gridCol/>" * max(map(len, rows), default=0)
        return f"<w:tbl><w:tblGrid>{grid}</w:tblGrid>" + "".join("<w:tr>" + "".join(f"<w:tc>{''.join(map(para, c['content']))}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"

    inner = "".join(map(block, body["blocks"]))
    z.rel("", "officeDocument", main)
    if body["comments"]:
        notes = "".join(f'<w:comment w:id="{ids[c["id"]]}" w:author="{escape(c["author"])}">' + "".join(f"<w:p><w:r>{_t('w:t', x)}</w:r></w:p>" for x in c["text"].split("\n")) + "</w:comment>" for c in body["comments"])
        z.add("word/comments.xml", "wordprocessingml.comments", f'<w:comments xmlns:w="{W}">{notes}</w:comments>')
        z.rel(main, "comments", "comments.xml")
    z.add(main, "wordprocessingml.document.main", f'<w:document xmlns:w="{W}" xmlns:r="{R}"><w:body>{inner}</w:body></w:document>')
    return z.bytes()


NUMBER = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")


def xlsx(doc: dict) -> bytes:
    """Sheets with their tables one below the other, an empty row between; formulas at their addresses."""
    z = _Parts()
    book, strings, sheets = "xl/workbook.xml", {}, ""
    for n, s in enumerate(doc["sheets"] or [{"name": "Sheet1", "tables": [], "formulas": []}], 1):
        notes = {f["cell_ref"]: f["formula"].removeprefix("=") for f in s["formulas"]}
        rows, at = "", 0
        for t in s["tables"]:
            for r in _header_row(t):
                at += 1
                cells = ""
                for j, c in enumerate(r):
                    ref, text = f"{col_name(j + 1)}{at}", "\n".join(ir.plain(p) for p in c["content"])
                    if ref in notes:
                        value = f"<v>{escape(text)}</v>" if NUMBER.fullmatch(text) else ""
                        cells += f'<c r="{ref}"><f>{escape(notes[ref])}</f>{value}</c>'
                    elif NUMBER.fullmatch(text):
                        cells += f'<c r="{ref}"><v>{text}</v></c>'
                    elif text:
                        cells += f'<c r="{ref}" t="s"><v>{strings.setdefault(text, len(strings))}</v></c>'
                    else:
                        cells += f'<c r="{ref}"/>'
                rows += f'<row r="{at}">{cells}</row>'
            at += 1
        z.add(f"xl/worksheets/sheet{n}.xml", "spreadsheetml.worksheet", f'<worksheet xmlns="{S}"><sheetData>{rows}</sheetData></worksheet>')
        rid = z.rel(book, "worksheet", f"worksheets/sheet{n}.xml")
        sheets += f'<sheet name="{escape(s["name"])}" sheetId="{n}" r:id="{rid}"/>'
    z.rel("", "officeDocument", book)
    z.rel(book, "sharedStrings", "sharedStrings.xml")
    z.add("xl/sharedStrings.xml", "spreadsheetml.sharedStrings", f'<sst xmlns="{S}">' + "".join(f"<si>{_t('t', x)}</si>" for x in strings) + "</sst>")
    z.add(book, "spreadsheetml.sheet.main", f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets>{sheets}</sheets></workbook>')
    return z.bytes()


_GROUP = '<p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/></p:spTree>'
_COLORS = 'bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" ' + " ".join(f'accent{i}="accent{i}"' for i in range(1, 7)) + ' hlink="hlink" folHlink="folHlink"'


def pptx(doc: dict) -> bytes:
    """Slides with notes and comments, on one empty layout of one master."""
    z = _Parts()
    deck, ids = "ppt/presentation.xml", ""
    authors = sorted({c["author"] for s in doc["slides"] for c in s["comments"]})

    def para(p: dict, part: str) -> str:
        out = ""
        for i in p["inlines"]:
            if "Text" in i:
                out += f"<a:r><a:t>{escape(i['Text'])}</a:t></a:r>"
            else:
                rid = z.rel(part, "hyperlink", i["Link"]["target"], True)
                out += f'<a:r><a:rPr><a:hlinkClick r:id="{rid}"/></a:rPr><a:t>{escape(i["Link"]["display"])}</a:t></a:r>'
        return f"<a:p>{out}</a:p>"

    def shape(paras: str, placeholder: str) -> str:
        return f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{placeholder}"/></p:nvPr></p:nvSpPr><p:txBody>{paras}</p:txBody></p:sp>'

    ns = f'xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{R}"'
    master, layout = "ppt/slideMasters/slideMaster1.xml", "ppt/slideLayouts/slideLayout1.xml"
    white = '<p:bg><p:bgPr><a:solidFill><a:srgbClr val="FFFFFF"/></a:solidFill><a:effectLst/></p:bgPr></p:bg>'
    listed = f'<p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="{z.rel(master, "slideLayout", "../slideLayouts/slideLayout1.xml")}"/></p:sldLayoutIdLst>'
    z.add(master, "presentationml.slideMaster", f"<p:sldMaster {ns}><p:cSld>{white}{_GROUP}</p:cSld><p:clrMap {_COLORS}/>{listed}</p:sldMaster>")
    z.rel(layout, "slideMaster", "../slideMasters/slideMaster1.xml")
    z.add(layout, "presentationml.slideLayout", f'<p:sldLayout {ns} type="blank"><p:cSld>{_GROUP}</p:cSld></p:sldLayout>')
    masters = f'<p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="{z.rel(deck, "slideMaster", "slideMasters/slideMaster1.xml")}"/></p:sldMasterIdLst>'
    for n, s in enumerate(doc["slides"], 1):
        part, shapes = f"ppt/slides/slide{n}.xml", ""
        z.rel(part, "slideLayout", "../slideLayouts/slideLayout1.xml")
        blocks = list(s["blocks"])
        if s["title"] is not None:
            shapes += shape(f"<a:p><a:r><a:t>{escape(s['title'])}</a:t></a:r></a:p>", "title")
            if blocks and blocks[0] != "Separator" and "Paragraph" in blocks[0] and ir.plain(blocks[0]["Paragraph"]).strip() == s["title"].strip():
                blocks.pop(0)
        for b in blocks:
            if b == "Separator":
                continue
            if "Paragraph" in b:
                shapes += shape(para(b["Paragraph"], part), "body")
            else:
                rows = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody>{''.join(para(p, part) for p in c['content'])}</a:txBody></a:tc>" for c in r) + "</a:tr>" for r in _header_row(b["Table"]))
                shapes += f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl>{rows}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
        z.add(part, "presentationml.slide", f"<p:sld {ns}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>")
        if s["notes"]:
            notes = f"ppt/notesSlides/notesSlide{n}.xml"
            z.add(notes, "presentationml.notesSlide", f"<p:notes {ns}><p:cSld><p:spTree>{shape(''.join(para(p, notes) for p in s['notes']), 'body')}</p:spTree></p:cSld></p:notes>")
            z.rel(part, "notesSlide", f"../notesSlides/notesSlide{n}.xml")
        if s["comments"]:
            said = "".join(f'<p:cm authorId="{authors.index(c["author"])}" idx="{i}"><p:text>{escape(c["text"])}</p:text></p:cm>' for i, c in enumerate(s["comments"], 1))
            z.add(f"ppt/comments/comment{n}.xml", "presentationml.comments", f"<p:cmLst {ns}>{said}</p:cmLst>")
            z.rel(part, "comments", f"../comments/comment{n}.xml")
        ids += f'<p:sldId id="{255 + n}" r:id="{z.rel(deck, "slide", f"slides/slide{n}.xml")}"/>'
    if authors:
        who = "".join(f'<p:cmAuthor id="{i}" name="{escape(a)}"/>' for i, a in enumerate(authors))
        z.add("ppt/commentAuthors.xml", "presentationml.commentAuthors", f"<p:cmAuthorLst {ns}>{who}</p:cmAuthorLst>")
        z.rel(deck, "commentAuthors", "commentAuthors.xml")
    z.rel("", "officeDocument", deck)
    z.add(deck, "presentationml.presentation.main", f"<p:presentation {ns}>{masters}<p:sldIdLst>{ids}</p:sldIdLst></p:presentation>")
    return z.bytes()


WRITERS = {"docx": docx, "xlsx": xlsx, "pptx": pptx}


def create(doc: dict, fmt: str) -> bytes:
    if fmt not in WRITERS:
        raise ValueError(f"can't write {fmt}")
    return WRITERS[fmt](doc)
