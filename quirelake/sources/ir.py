"""The document tree that readers give and writers take: plain dicts and lists, as in its JSON form."""

from __future__ import annotations


def document(kind: str, **more) -> dict:
    return {"kind": kind, "properties": None, "sheets": [], "slides": [], "sections": []} | more


def text(value: str) -> dict:
    return {"Text": value}


def link(display: str, target: str, rel_id: str | None = None) -> dict:
    return {"Link": {"display": display, "target": target, "rel_id": rel_id}}


def paragraph(*inlines: dict) -> dict:
    return {"inlines": list(inlines)}


def cell(*paragraphs: dict) -> dict:
    return {"content": list(paragraphs)}


def table(rows: list[list[dict]], caption: str | None = None) -> dict:
    """Rows padded to the widest one, with headers Col1..ColN."""
    width = max(map(len, rows), default=0)
    full = [[*r, *(cell(paragraph(text(""))) for _ in range(width - len(r)))] for r in rows]
    return {"caption": caption, "headers": [f"Col{i + 1}" for i in range(width)], "rows": full, "synthetic_headers": True}


def plain(p: dict) -> str:
    """The text of a paragraph; a link gives its display, or else its target."""
    return "".join(i["Text"] if "Text" in i else i["Link"]["display"] or i["Link"]["target"] for i in p["inlines"])


def text_table(rows: list[list[str]], caption: str | None = None) -> dict:
    return table([[cell(paragraph(text(c))) for c in r] for r in rows], caption)
