"""Find and replace in office packages: scopes are sets of parts, content keeps its runs.

A replacement is a dict: find, to, match (exact, ignore_case, whole_word, whole_word_ignore_case), mode (all or first).
A patch is a dict: replaces (a list of replacements with scope and keep_formatting), title (a new core title), renames (old and
new sheet names), edits (part, from, to: first occurrence). Every replacement must match somewhere, or the patch fails."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..sources.package import Package, escape, write

META = ("docProps/core.xml", "docProps/app.xml", "docProps/custom.xml")
# The parts that a scope names.
SCOPES: dict[str, dict[str, str]] = {
    "docx": {
        "body": r"word/document\.xml", "headers": r"word/header[^/]*\.xml", "footers": r"word/footer[^/]*\.xml", "comments": r"word/comments[^/]*\.xml",
        "footnotes": r"word/footnotes\.xml", "endnotes": r"word/endnotes\.xml", "core": r"docProps/core\.xml", "app": r"docProps/app\.xml",
        "custom": r"docProps/custom\.xml", "metadata_all": r"docProps/(core|app|custom)\.xml",
        "all_content": r"word/(document|header[^/]*|footer[^/]*|comments[^/]*|footnotes|endnotes)\.xml",
        "all_text": r"word/(document|header[^/]*|footer[^/]*|comments[^/]*|footnotes|endnotes)\.xml|docProps/(core|app|custom)\.xml",
    },
    "pptx": {
        "slide_titles": r"ppt/slides/slide[^/]*\.xml", "slide_body": r"ppt/slides/slide[^/]*\.xml", "notes": r"ppt/notesSlides/[^/]*\.xml",
        "comments": r"ppt/comments/[^/]*\.xml", "comment_authors": r"ppt/commentAuthors\.xml", "core": r"docProps/core\.xml", "app": r"docProps/app\.xml",
        "custom": r"docProps/custom\.xml", "metadata_all": r"docProps/(core|app|custom)\.xml", "all_content": r"ppt/(slides|notesSlides|comments)/[^/]*\.xml",
        "all_text": r"ppt/(slides|notesSlides|comments)/[^/]*\.xml|ppt/commentAuthors\.xml|docProps/(core|app|custom)\.xml",
    },
    "xlsx": {
        "shared_strings": r"xl/sharedStrings\.xml", "inline_strings": r"xl/worksheets/[^/]*\.xml", "workbook_text": r"xl/(sharedStrings|worksheets/[^/]*)\.xml",
        "comments": r"xl/(comments[^/]*|threadedComments/[^/]*)\.xml", "persons": r"xl/persons/[^/]*\.xml", "sheet_names": r"xl/workbook\.xml",
        "headers_footers": r"xl/worksheets/[^/]*\.xml", "core": r"docProps/core\.xml", "app": r"docProps/app\.xml", "custom": r"docProps/custom\.xml",
        "metadata_all": r"docProps/(core|app|custom)\.xml", "all_content": r"xl/(sharedStrings|worksheets/[^/]*|comments[^/]*|threadedComments/[^/]*)\.xml",
        "all_text": r"xl/(sharedStrings|worksheets/[^/]*|comments[^/]*|threadedComments/[^/]*|persons/[^/]*)\.xml|docProps/(core|app|custom)\.xml",
    },
}
#: What holds text nodes together, and the text nodes, by kind of part.
CONTAINERS = {"docx": ("w:p", "w:t"), "pptx": ("a:p", "a:t"), "xlsx": ("si|is", "t"), "comments": ("comment|p:cm|threadedComment", "t|a:t|p:text|text")}


def pattern(r: dict) -> re.Pattern:
    match = r.get("match", "exact")
    body = re.escape(r["find"])
    body = rf"\b{body}\b" if "whole_word" in match else body
    return re.compile(body, re.I if "ignore_case" in match else 0)


def _expand(to: str, m: re.Match, literal: bool) -> str:
    """What stands in for a match; $0 is the match itself unless the match is exact, $$ a dollar, other names are empty."""
    if literal:
        return to
    return re.sub(r"\$(?:\{(\w+)\}|(\w+)|(\$))", lambda g: "$" if g[3] else m[0] if (g[1] or g[2]) == "0" else "", to)


def replace_text(text: str, r: dict) -> tuple[str, int]:
    if not r["find"]:
        raise ValueError("nothing to find")
    literal = r.get("match", "exact") == "exact"
    return pattern(r).subn(lambda m: _expand(r["to"], m, literal), text, count=1 if r.get("mode") == "first" else 0)


def unescape(s: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = s.replace(a, b)
    return s


def _nodes(names: str) -> re.Pattern:
    return re.compile(rf"(<(?:{names})(?:\s[^<>]*)?>)([^<]*)(</(?:{names})>)")


def replace_in_nodes(xml: str, names: str, r: dict) -> tuple[str, int]:
    """Replaces in the text nodes only, one by one."""
    hits = 0

    def one(m: re.Match) -> str:
        nonlocal hits
        if r.get("mode") == "first" and hits:
            return m[0]
        new, n = replace_text(unescape(m[2]), r)
        hits += n
        return m[1] + escape(new) + m[3] if n else m[0]

    return _nodes(names).sub(one, xml), hits


def replace_in_runs(xml: str, names: str, r: dict) -> tuple[str, int]:
    """Replaces in the text that runs of one container give together: what a match gives goes to the run in which it
    starts, the runs after it lose what it covers."""
    nodes = list(_nodes(names).finditer(xml))
    texts = [unescape(m[2]) for m in nodes]
    whole = "".join(texts)
    literal = r.get("match", "exact") == "exact"
    matches = list(pattern(r).finditer(whole))[: 1 if r.get("mode") == "first" else None]
    if not matches:
        return xml, 0
    ends, total = [], 0
    for t in texts:
        total += len(t)
        ends.append(total)
    out = [""] * len(texts)

    def give(a: int, b: int) -> None:
        start = 0
        for i, e in enumerate(ends):
            out[i] += whole[max(a, start) : max(min(b, e), max(a, start))]
            start = e

    at = 0
    for m in matches:
        give(at, m.start())
        out[next(i for i, e in enumerate(ends) if m.start() < e)] += _expand(r["to"], m, literal)
        at = m.end()
    give(at, total)
    pieces, last = [], 0
    for m, text in zip(nodes, out, strict=True):
        head = m[1] if text == text.strip() or "xml:space" in m[1] else m[1][:-1] + ' xml:space="preserve">'
        pieces += [xml[last : m.start()], head, escape(text), m[3]]
        last = m.end()
    return "".join([*pieces, xml[last:]]), len(matches)


def _in_containers(xml: str, container: str, node: str, r: dict) -> tuple[str, int]:
    hits = 0

    def one(m: re.Match) -> str:
        nonlocal hits
        if r.get("mode") == "first" and hits:
            return m[0]
        new, n = replace_in_runs(m[0], node, r)
        hits += n
        return new

    out = re.sub(rf"(?s)<({container})(?:\s[^<>]*)?>.*?</\1>", one, xml)
    return out, hits


def parts_of(package: Package) -> dict[str, bytes]:
    return {name: package.zip.read(raw) for name, raw in package.names.items() if not raw.endswith("/")}


def _kind(fmt: str, part: str) -> tuple[str, str] | None:
    if part in META:
        return None
    if "omment" in part and fmt != "docx":
        return CONTAINERS["comments"]
    return CONTAINERS[fmt]


def apply_replace(fmt: str, parts: dict[str, bytes], r: dict, report: dict) -> None:
    scope = SCOPES[fmt].get(r.get("scope", "all_text"))
    if scope is None:
        raise ValueError(f"no scope {r['scope']} in {fmt}")
    total = 0
    for name in sorted(n for n in parts if re.fullmatch(scope, n)):
        report["parts_scanned"] += 1
        xml = parts[name].decode("utf-8", "replace")
        kind = _kind(fmt, name)
        if r.get("scope") == "sheet_names":
            new, n = _sub_attr(xml, r)
        elif kind and r.get("keep_formatting", fmt != "docx"):
            new, n = _in_containers(xml, *kind, r)
            if not n and fmt == "docx":
                new, n = replace_text(xml, r)
        elif kind and fmt == "xlsx":
            new, n = replace_in_nodes(xml, kind[1], r)
        else:
            new, n = replace_text(xml, r)
        if n:
            parts[name] = new.encode()
            report["parts_modified"] += 1
            report["replacements_applied"] += n
            total += n
    if not total:
        raise ValueError(f"no match for {r['find']!r}")


def _sub_attr(xml: str, r: dict) -> tuple[str, int]:
    hits = 0

    def one(m: re.Match) -> str:
        nonlocal hits
        new, n = replace_text(unescape(m[2]), r)
        hits += n
        return m[1] + escape(new) + m[3]

    return re.sub(r'(<sheet\b[^<>]*?\bname=")([^"]*)(")', one, xml), hits


def sheet_ref(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", name) else "'" + name.replace("'", "''") + "'"


def rewrite_sheet_refs(formula: str, old: str, new: str) -> tuple[str, int]:
    """A formula's references to a sheet after its renaming: quoted ones, then plain ones."""
    out, a = re.subn(re.escape("'" + old.replace("'", "''") + "'!"), lambda _: sheet_ref(new) + "!", formula)
    out, b = re.subn(rf"(?<![\w.']){re.escape(old)}!", lambda _: sheet_ref(new) + "!", out)
    return out, a + b


def rename_sheet(parts: dict[str, bytes], old: str, new: str, report: dict) -> None:
    """The sheet itself, and formulas, defined names and charts that name it."""
    book = parts["xl/workbook.xml"].decode()
    mark = f'name="{escape(old)}"'
    if mark not in book:
        raise ValueError(f"no sheet {old!r}")
    parts["xl/workbook.xml"] = book.replace(mark, f'name="{escape(new)}"', 1).encode()
    changed, hits = {"xl/workbook.xml"}, 1
    for name in sorted(n for n in parts if re.fullmatch(r"xl/(workbook|worksheets/[^/]*|charts/[^/]*)\.xml", n)):

        def one(m: re.Match, name=name) -> str:
            nonlocal hits
            out, n = rewrite_sheet_refs(unescape(m[2]), old, new)
            hits += n
            if n:
                changed.add(name)
            return m[1] + escape(out) + m[3] if n else m[0]

        parts[name] = _nodes("f|c:f|definedName").sub(one, parts[name].decode()).encode()
    report["parts_scanned"] += 1
    report["parts_modified"] += len(changed)
    report["replacements_applied"] += hits


def set_title(parts: dict[str, bytes], title: str, report: dict) -> None:
    raw = parts.get("docProps/core.xml")
    if raw is None:
        raise ValueError("there are no core properties")
    xml, new = raw.decode(), f"<dc:title>{escape(title)}</dc:title>"
    forms: list[tuple[str, Callable[[re.Match], str]]] = [
        (r"(?s)<dc:title(?:\s[^<>]*)?>.*?</dc:title>|<dc:title\s*/>", lambda m: new),
        (r"</(?:\w+:)?coreProperties>", lambda m: new + m[0]),
        (r"<((?:\w+:)?coreProperties)([^<>]*)/>", lambda m: f"<{m[1]}{m[2]}>{new}</{m[1]}>"),
    ]
    for form, to in forms:
        out, n = re.subn(form, to, xml, count=1)
        if n:
            if "xmlns:dc=" not in out:
                out = re.sub(r"<((?:\w+:)?coreProperties)", r'<\1 xmlns:dc="http://purl.org/dc/elements/1.1/"', out, count=1)
            parts["docProps/core.xml"] = out.encode()
            report["parts_scanned"] += 1
            report["parts_modified"] += 1
            report["replacements_applied"] += 1
            return
    raise ValueError("the core properties can't be read")


def patch(content: bytes, fmt: str, spec: dict) -> tuple[bytes, dict]:
    """The patched package and its report: parts_scanned, parts_modified, replacements_applied."""
    parts = parts_of(Package(content))
    report = {"parts_scanned": 0, "parts_modified": 0, "replacements_applied": 0}
    for e in spec.get("edits", ()):
        part = e["part"].lstrip("/")
        if part not in parts or e["from"] not in (xml := parts[part].decode()):
            raise ValueError(f"no match in {part}")
        parts[part] = xml.replace(e["from"], e["to"], 1).encode()
        report = {"parts_scanned": report["parts_scanned"] + 1, "parts_modified": report["parts_modified"] + 1, "replacements_applied": report["replacements_applied"] + 1}
    for old, new in spec.get("renames", ()):
        rename_sheet(parts, old, new, report)
    for r in spec.get("replaces", ()):
        apply_replace(fmt, parts, r, report)
    if spec.get("title") is not None:
        set_title(parts, spec["title"], report)
    return write(parts), report
