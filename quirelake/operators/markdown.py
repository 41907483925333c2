"""Markdown of document trees, and document trees of markdown. Rendering what was parsed gives the same text again."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..sources import ir


@dataclass(frozen=True)
class Options:
    """tag: the word that opens the front matter. profile: compact or human."""

    tag: str = "document"
    profile: str = "compact"
    first_row_as_header: bool = True
    formulas: bool = True
    headers_footers: bool = True
    properties: bool = False
    frontmatter: bool = True


def _pipes(s: str) -> str:
    return s.replace("|", "\\|")


def inlines(p: dict, escaped: bool = False) -> str:
    esc = _pipes if escaped else str
    out = []
    for i in p["inlines"]:
        if "Text" in i:
            out.append(esc(i["Text"]))
        else:
            shown, target = esc(i["Link"]["display"]), esc(i["Link"]["target"])
            out.append(shown if not target else f"[{shown}]({target})" if shown else f"<{target}>")
    return "".join(out)


def cell(c: dict) -> str:
    return "<br>".join(inlines(p, True) for p in c["content"])


def _line(cells: list[str]) -> str:
    return "|" + "".join(f" {c} |" for c in cells)


def table(t: dict, o: Options) -> str:
    rows = [[cell(c) for c in r] for r in t["rows"]]
    head = rows.pop(0) if o.first_row_as_header and rows else [_pipes(h) for h in t["headers"]]
    lines = ([f"### {t['caption']}"] if t["caption"] is not None else []) + [_line(head), "|" + " --- |" * len(head), *map(_line, rows)]
    return "\n".join(lines) + "\n"


def comment(n: dict, escaped: bool) -> str:
    esc = _pipes if escaped else str
    who = f"|{esc(n['author'])}" if n["author"] else ""
    return f"[^{n['id']}{who}]: {esc(n['text'])}\n"


def _comments(notes: list[dict], escaped: bool) -> str:
    return "### Comments\n" + "".join(comment(n, escaped) for n in notes) + "\n" if notes else ""


def _blocks(blocks: list[dict] | list, o: Options) -> str:
    out = []
    for b in blocks:
        if b == "Separator":
            out.append("---\n\n")
        elif "Paragraph" in b:
            out.append(inlines(b["Paragraph"]) + "\n")
        else:
            out.append(table(b["Table"], o) + "\n")
    return "".join(out)


def properties(props: dict | None, o: Options) -> str:
    entries = sorted((k, v) for group in ("core", "app", "custom") for k, v in (props or {}).get(group, {}).items())
    if not entries:
        return ""
    if o.profile == "human":
        return "### Document Properties\n" + "".join(f"- {k}: {_pipes(v)}\n" for k, v in entries) + "\n---\n\n"
    return "properties: " + "; ".join(f"{k}={_pipes(v)}" for k, v in entries) + "\n\n"


def _sheet(s: dict, o: Options) -> str:
    out = f"## Sheet: {s['name']}\n\n" + "".join(table(t, o) + "\n" for t in s["tables"])
    if o.formulas and s["formulas"]:
        human = o.profile == "human"
        out += "### Formulas\n" if human else ""
        for i, f in enumerate(s["formulas"], 1):
            body = f["formula"].removeprefix("=")
            out += f"[^f{i}]: {f['cell_ref']} = `={body}`\n" if human else f"{f['cell_ref']}=`={body}`\n"
        out += "\n"
    return out


def _slide(s: dict, o: Options) -> str:
    blocks = list(s["blocks"])
    if s["title"] is not None:
        same = (i for i, b in enumerate(blocks) if b != "Separator" and "Paragraph" in b and all("Text" in x for x in b["Paragraph"]["inlines"]) and inlines(b["Paragraph"]).strip() == s["title"].strip())
        if (i := next(same, None)) is not None:
            del blocks[i]
    head = f"## Slide {s['number']}" + (f" - {_pipes(s['title'])}" if s["title"] is not None else "") + "\n\n"
    notes = "### Notes\n" + "".join(inlines(p) + "\n" for p in s["notes"]) + "\n" if s["notes"] else ""
    return head + _blocks(blocks, o) + notes + _comments(s["comments"], True)


def render(doc: dict, o: Options = Options()) -> str:
    flag = lambda b: str(b).lower()
    kind = doc["kind"].lower()
    out = ""
    if o.frontmatter:
        out = f"<!-- {o.tag}: kind={kind} profile={o.profile} first_row_as_header={flag(o.first_row_as_header)} formulas={flag(o.formulas)} headers_footers={flag(o.headers_footers)} properties={flag(o.properties)} -->\n\n"
    if o.properties:
        out += properties(doc["properties"], o)
    if kind == "xlsx":
        return out + "".join(_sheet(s, o) for s in doc["sheets"])
    if kind == "docx":
        shown = [s for s in doc["sections"] if o.headers_footers or not s["name"].startswith(("header", "footer"))]
        return out + "\n".join(f"## Section: {s['name']}\n\n" + _blocks(s["blocks"], o) + _comments(s["comments"], False) for s in shown)
    if kind == "pptx":
        return out + "".join(_slide(s, o) for s in doc["slides"])
    for page in (doc.get("pdf") or {"pages": []})["pages"]:
        body = page["markdown"]
        out += f"## Page: {page['number']}\n\n" + (body + ("" if body.endswith("\n") else "\n") + "\n" if body else "")
    return out


FRONT = re.compile(r"<!-- (\w+): (kind=[^>]*?) -->\n{0,2}")
KINDS = (("Xlsx", re.compile(r"## Sheet: ")), ("Docx", re.compile(r"## Section: ")), ("Pptx", re.compile(r"## Slide [0-9]")), ("Pdf", re.compile(r"## Page: ")))
_INLINE = re.compile(r"\[([^\[\]]*)\]\(([^()\s]*)\)|<((?:https?://|mailto:)[^<>\s]*)>")
_COMMENT = re.compile(r"\[\^([^|\]]+)(?:\|((?:\\\||[^|\]])*))?\]: (.*)")
_FORMULA = {"compact": re.compile(r"([A-Z]+[0-9]+)=`=(.*)`"), "human": re.compile(r"\[\^f[0-9]+\]: ([A-Z]+[0-9]+) = `=(.*)`")}


def parse_frontmatter(md: str) -> tuple[str | None, Options]:
    m = FRONT.match(md)
    if not m:
        return None, Options()
    kv = dict(x.split("=", 1) for x in m[2].split() if "=" in x)
    on = lambda k, d: kv.get(k, d) == "true"
    o = Options(m[1], kv.get("profile", "compact"), on("first_row_as_header", "true"), on("formulas", "true"), on("headers_footers", "true"), on("properties", "false"))
    return kv.get("kind"), o


def detect_kind(md: str) -> str | None:
    for line in md.split("\n"):
        for kind, pattern in KINDS:
            if pattern.match(line):
                return kind
    return None


def parse_inlines(text: str) -> dict:
    out, at = [], 0
    for m in _INLINE.finditer(text):
        if m.start() > at:
            out.append(ir.text(text[at : m.start()]))
        out.append(ir.link("", m[3]) if m[3] else ir.link(m[1], m[2]))
        at = m.end()
    if at < len(text) or not out:
        out.append(ir.text(text[at:]))
    return {"inlines": out}


def split_row(line: str) -> list[str]:
    body = line.strip().removeprefix("|")
    body = body[:-1] if body.endswith("|") and not body.endswith("\\|") else body
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", body)]


def is_separator(line: str) -> bool:
    return re.fullmatch(r"\s*\|(\s*:?-{3,}:?\s*\|)+\s*", line) is not None


def parse_table(lines: list[str], caption: str | None, header: bool) -> dict:
    """A run of pipe lines as a table; the header becomes its first row where it came from one."""
    rows = [split_row(x) for x in lines if not is_separator(x)]
    head = rows[0] if rows else []
    if not header:
        rows = rows[1:]
    t = ir.table([[ir.cell(*(parse_inlines(p) for p in c.split("<br>"))) for c in r] for r in rows], caption)
    if not header:
        t["headers"], t["synthetic_headers"] = head, all(h == f"Col{i + 1}" for i, h in enumerate(head))
    return t


def _parse_blocks(lines: list[str], o: Options) -> list:
    out: list = []
    i = 0
    while i < len(lines):
        line = lines[i]
        caption = line[4:] if line.startswith("### ") and i + 1 < len(lines) and lines[i + 1].startswith("|") else None
        j = i + (caption is not None)
        if j < len(lines) and lines[j].startswith("|") and j + 1 < len(lines) and is_separator(lines[j + 1]):
            end = j
            while end < len(lines) and lines[end].startswith("|"):
                end += 1
            out.append({"Table": parse_table(lines[j:end], caption, o.first_row_as_header)})
            i = end + (end < len(lines) and lines[end] == "")
            continue
        if line == "---" and i + 1 < len(lines) and lines[i + 1] == "":
            out.append("Separator")
            i += 2
            continue
        out.append({"Paragraph": parse_inlines(line)})
        i += 1
    return out


def _split(md: str, pattern: re.Pattern) -> tuple[str, list[tuple[str, str]]]:
    """What stands before the first heading, and each heading with what follows it."""
    marks = [m for m in re.finditer(r"(?m)^.*$", md) if pattern.match(m[0])]
    ends = [m.start() for m in marks[1:]] + [len(md)]
    return (md[: marks[0].start()] if marks else md), [(m[0], md[m.end() + 1 : e]) for m, e in zip(marks, ends, strict=True)]


def _lines(body: str) -> list[str]:
    return body.strip("\n").split("\n") if body.strip("\n") else []


def _notes(lines: list[str]) -> list[dict]:
    out = []
    for line in lines:
        if m := _COMMENT.fullmatch(line):
            out.append({"id": m[1], "author": (m[2] or "").replace("\\|", "|"), "text": m[3].replace("\\|", "|")})
        elif out and line:
            out[-1]["text"] += "\n" + line
    return out


def _parse_properties(head: str, o: Options) -> dict | None:
    found = {}
    if m := re.search(r"(?m)^properties: (.*)$", head):
        found = dict(x.split("=", 1) for x in m[1].split("; ") if "=" in x)
    elif "### Document Properties" in head:
        found = dict(m.groups() for m in re.finditer(r"(?m)^- ([^:]+): (.*)$", head))
    return {"core": {k: v.replace("\\|", "|") for k, v in found.items()}, "app": {}, "custom": {}} if found else None


def parse(md: str, kind: str | None = None) -> tuple[dict, Options]:
    """The document tree of a text that render made (or one like it), and the options that it names."""
    md = md.replace("\r\n", "\n")
    named, o = parse_frontmatter(md)
    body = FRONT.sub("", md, count=1) if FRONT.match(md) else md
    kind = (named or kind or detect_kind(body) or "").capitalize()
    patterns = dict(KINDS)
    if kind not in patterns:
        raise ValueError("the kind of the document can't be told")
    head, parts = _split(body, re.compile(r"## Page: [0-9]+$") if kind == "Pdf" else patterns[kind])
    doc = ir.document(kind, properties=_parse_properties(head, o))
    for title, text in parts:
        if kind == "Xlsx":
            lines = _lines(text)
            notes = [{"cell_ref": m[1], "formula": "=" + m[2]} for x in lines if (m := _FORMULA[o.profile].fullmatch(x))]
            rest = [x for x in lines if not _FORMULA[o.profile].fullmatch(x) and x != "### Formulas"]
            doc["sheets"].append({"name": title[10:], "tables": [b["Table"] for b in _parse_blocks(rest, o) if b != "Separator" and "Table" in b], "formulas": notes, "hyperlinks": []})
        elif kind == "Docx":
            text, _, said = text.partition("### Comments\n")
            doc["sections"].append({"name": title[12:], "blocks": _parse_blocks(_lines(text), o), "comments": _notes(_lines(said))})
        elif kind == "Pptx":
            m = re.match(r"## Slide ([0-9]+)(?: - (.*))?$", title)
            text, _, said = text.partition("### Comments\n")
            text, _, spoken = text.partition("### Notes\n")
            notes = [parse_inlines(x) for x in _lines(spoken)]
            doc["slides"].append({"number": int(m[1]) if m else 0, "title": m[2].replace("\\|", "|") if m and m[2] is not None else None, "blocks": _parse_blocks(_lines(text), o), "notes": notes or None, "comments": _notes(_lines(said))})
        else:
            doc.setdefault("pdf", {"pages": [], "diagnostics": None})["pages"].append({"number": int(title[9:]), "markdown": text.strip("\n")})
    return doc, o


def select_sections(md: str, pages: set[int] | None = None, sheets: tuple[list[int], list[str]] | None = None) -> str:
    """The rendered text with only the pages or slides of these numbers, or the sheets of these numbers and names."""
    pattern = re.compile(r"## (Page: [0-9]+|Slide [0-9]+)") if pages is not None else re.compile(r"## Sheet: ")
    head, parts = _split(md, pattern)

    def wanted(i: int, title: str) -> bool:
        if pages is not None:
            return int(re.search(r"[0-9]+", title)[0]) in pages
        return i in sheets[0] or title[10:] in sheets[1]

    kept = [f"{t}\n{b}" for i, (t, b) in enumerate(parts, 1) if wanted(i, t)]
    if not kept:
        raise ValueError("nothing is selected")
    return head + "".join(kept)


def human(o: Options) -> Options:
    return replace(o, profile="human")
