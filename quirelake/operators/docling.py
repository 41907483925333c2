"""The nested JSON of document converters: texts, tables and groups that point at each other."""

from __future__ import annotations

from ..sources import ir

NAMES = {"Docx": "document", "Xlsx": "spreadsheet", "Pptx": "presentation", "Pdf": "document"}


class _Builder:
    def __init__(self, name: str) -> None:
        root = lambda layer: {"self_ref": f"#/{layer}", "children": [], "content_layer": layer, "name": "_root_", "label": "unspecified"}
        self.doc = {"schema_name": "DoclingDocument", "version": "1.9.0", "name": name, "furniture": root("furniture"), "body": root("body"), "groups": [], "texts": [], "tables": [], "pictures": [], "key_value_items": [], "pages": {}}

    def _add(self, kind: str, parent: str, item: dict) -> str:
        ref = f"#/{kind}/{len(self.doc[kind])}"
        self.doc[kind].append({"self_ref": ref, "parent": {"$ref": parent}, "children": []} | item)
        self._node(parent)["children"].append({"$ref": ref})
        return ref

    def _node(self, ref: str) -> dict:
        _, kind, *i = ref.split("/")
        return self.doc[kind][int(i[0])] if i else self.doc[kind]

    def text(self, parent: str, text: str, label: str = "paragraph", layer: str = "body") -> str:
        return self._add("texts", parent, {"content_layer": layer, "label": label, "prov": [], "orig": text, "text": text})

    def group(self, parent: str, name: str, label: str = "section", layer: str = "body") -> str:
        return self._add("groups", parent, {"content_layer": layer, "name": name, "label": label})

    def table(self, parent: str, t: dict, layer: str = "body") -> None:
        if t["caption"]:
            self.text(parent, t["caption"], "caption", layer)
        cells = [
            {"row_span": 1, "col_span": 1, "start_row_offset_idx": i, "end_row_offset_idx": i + 1, "start_col_offset_idx": j, "end_col_offset_idx": j + 1, "text": "\n".join(ir.plain(p) for p in c["content"]), "column_header": i == 0, "row_header": False, "row_section": False}
            for i, r in enumerate(t["rows"])
            for j, c in enumerate(r)
        ]
        data = {"table_cells": cells, "num_rows": len(t["rows"]), "num_cols": len(t["rows"][0]) if t["rows"] else 0}
        self._add("tables", parent, {"content_layer": layer, "label": "table", "prov": [], "data": data})

    def blocks(self, parent: str, blocks: list, layer: str = "body", label: str = "paragraph") -> None:
        for b in blocks:
            if b == "Separator":
                continue
            if "Paragraph" in b:
                if text := ir.plain(b["Paragraph"]):
                    self.text(parent, text, label, layer)
            else:
                self.table(parent, b["Table"], layer)

    def comments(self, parent: str, notes: list[dict], layer: str = "body") -> None:
        if notes:
            group = self.group(parent, "comments", layer=layer)
            for n in notes:
                self.text(group, f"{n['author']}: {n['text']}" if n["author"] else n["text"], "footnote", layer)


def convert(doc: dict) -> dict:
    b = _Builder(NAMES[doc["kind"]])
    for s in doc["sections"]:
        if s["name"].startswith(("header", "footer")):
            b.blocks("#/furniture", s["blocks"], "furniture", "page_header" if s["name"].startswith("header") else "page_footer")
            b.comments("#/furniture", s["comments"], "furniture")
        else:
            parent = "#/body" if s["name"] == "body" else b.group("#/body", s["name"])
            b.blocks(parent, s["blocks"])
            b.comments(parent, s["comments"])
    for s in doc["sheets"]:
        group = b.group("#/body", s["name"])
        for t in s["tables"]:
            b.table(group, t)
        for f in s["formulas"]:
            b.text(group, f"{f['cell_ref']} = {f['formula']}", "text")
    for s in doc["slides"]:
        b.doc["pages"][str(s["number"])] = {"page_no": s["number"], "size": {"width": 0.0, "height": 0.0}}
        group = b.group("#/body", f"Slide {s['number']}" + (f" - {s['title']}" if s["title"] else ""))
        if s["title"]:
            b.text(group, s["title"], "title")
        b.blocks(group, s["blocks"])
        for p in s["notes"] or ():
            b.text(group, ir.plain(p), "text")
        b.comments(group, s["comments"])
    for page in (doc.get("pdf") or {"pages": []})["pages"]:
        b.doc["pages"][str(page["number"])] = {"page_no": page["number"], "size": {"width": 0.0, "height": 0.0}}
        if page["markdown"].strip():
            b.text("#/body", page["markdown"], "text")
    return b.doc
