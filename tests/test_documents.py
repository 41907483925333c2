"""Readers, writers, markdown, JSON and patches over documents that are built here."""

import io
import json
import zipfile

import pytest

from quirelake.operators import docling as D, layout as L, markdown as M, patches as P
from quirelake.sources import documents as S, ir, package, pdf, prose, spreadsheets as X, writers

P1 = lambda *x: {"Paragraph": ir.paragraph(*x)}
T = ir.text
CSV = b"Product,Amount,Total\r\nWidget,1200,=B2*2\r\n\"a,|b\",0.10\r\n"


def docx():
    body = [P1(T("A summary")), P1(T("See "), ir.link("here", "https://host.example/a"), T(" now.[^c0]")), {"Table": ir.text_table([["Region", "a|b"], ["EMEA", "12%"], ["NA", ""]])}, P1(T("The end"))]
    return ir.document("Docx", sections=[{"name": "body", "blocks": body, "comments": [{"id": "c0", "author": "Someone", "text": "A note"}]}])


def pptx():
    slides = [
        {"number": 1, "title": "First | one", "blocks": [P1(T("First | one")), P1(T("text")), {"Table": ir.text_table([["x", "y"]])}], "notes": [ir.paragraph(T("spoken"))], "comments": [{"id": "c1", "author": "Who", "text": "why"}]},
        {"number": 2, "title": "Second", "blocks": [P1(T("Second")), P1(ir.link("l", "http://host.example"))], "notes": None, "comments": []},
    ]
    return ir.document("Pptx", slides=slides)


def xlsx():
    sheet = lambda name, rows, notes: {"name": name, "tables": [ir.text_table(rows, X.caption(1, rows))], "formulas": notes, "hyperlinks": []}
    return ir.document("Xlsx", sheets=[sheet("Sales", [["Name", "N"], ["w", "12"], ["z", "007"]], [{"cell_ref": "B3", "formula": "SUM(A1:A2)"}]), sheet("My Data", [["1"]], [])])


def pdf_bytes(text=b"BT /F1 24 Tf 72 720 Td (A heading) Tj /F1 12 Tf 0 -40 Td (Some words) Tj 0 -14 Td [(on two) -300 (lines.)] TJ 0 -14 Td (and a third) Tj ET"):
    import zlib

    z = zlib.compress(text)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(z) + z + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Helvetica >>", b"<< /Title (A title) >>"]
    return b"junk\n%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R /Info 6 0 R >>\n%%EOF"


def test_formats():
    for fmt, doc in (("docx", docx()), ("pptx", pptx()), ("xlsx", xlsx())):
        assert package.detect_format(writers.create(doc, fmt)) == fmt
    assert package.detect_format(b"\xef\xbb\xbf \n%PDF-1.7") == "pdf" and package.resolve_format(b"a,b", None, "x.CSV") == "csv"
    with pytest.raises(ValueError):
        package.detect_format(b"a,b")
    assert package.resolve("word", "../a/./b.xml") == "a/b.xml" and package.resolve("word", "/x/y") == "x/y" and package.resolve("word", "word/z") == "word/z"


def test_written_documents_read_back():
    back = prose.read_docx(writers.docx(docx()))
    same = docx()
    same["sections"][0]["blocks"][1]["Paragraph"]["inlines"][1]["Link"]["rel_id"] = back["sections"][0]["blocks"][1]["Paragraph"]["inlines"][1]["Link"]["rel_id"]
    assert back["sections"] == same["sections"]
    slides = prose.read_pptx(writers.pptx(pptx()))["slides"]
    assert [s["title"] for s in slides] == ["First | one", "Second"] and slides[0]["notes"] and slides[0]["comments"] == pptx()["slides"][0]["comments"]
    assert M.render({**pptx(), "slides": slides}) == M.render(pptx())
    assert [s["number"] for s in prose.read_pptx(writers.pptx(pptx()), slides={2})["slides"]] == [2]
    book = X.read_xlsx(writers.xlsx(xlsx()))
    assert [s["name"] for s in book["sheets"]] == ["Sales", "My Data"] == X.sheet_names(writers.xlsx(xlsx()))
    assert book["sheets"][0]["formulas"] == xlsx()["sheets"][0]["formulas"]
    assert X.sheet_sizes(writers.xlsx(xlsx())) == [("Sales", 3, 2), ("My Data", 1, 1)]


@pytest.mark.parametrize("make", [docx, pptx, xlsx])
@pytest.mark.parametrize("profile", ["compact", "human"])
@pytest.mark.parametrize("header", [True, False])
def test_markdown_is_stable(make, profile, header):
    o = M.Options(profile=profile, first_row_as_header=header)
    text = M.render(make(), o)
    doc, named = M.parse(text)
    assert named == o and M.render(doc, o).rstrip("\n") == text.rstrip("\n")


def test_markdown_of_csv():
    text = S.to_markdown(CSV, "csv")
    assert "### Table 1 (rows 1–3, cols A–C)\n| Product | Amount | Total |\n| --- | --- | --- |\n| Widget | 1200 | =B2*2 |\n| a,\\|b | 0.10 |  |" in text
    assert "C2=`=B2*2`" in text
    assert M.properties({"core": {"b": "2", "a": "1|"}, "app": {}, "custom": {}}, M.Options()) == "properties: a=1\\|; b=2\n\n"


def test_spreadsheet_values():
    styles = X.Styles.__new__(X.Styles)
    styles.strings, styles.uses_1904 = ["first"], False
    styles.hints = [None, X.format_hint(14, "mm-dd-yy"), X.format_hint(10, "0.00%"), X.format_hint(164, '"$"#,##0.00'), X.format_hint(22, "m/d/yy h:mm")]
    show = styles.show
    assert show("n", 1, "45292", "", True) == "2024-01-01" and show("n", 1, "45292", "", False) == ""
    assert show("n", 2, "0.125", "", True) == "12.50%" and show("n", 3, "1200", "", True) == "$1,200.00" and show("n", 2, "0.125", "", False) == "0.125"
    assert show("n", 4, "46054.6041667", "", True) == "2026-02-01 14:30"
    assert show("s", None, "0", "", True) == "first" and show("s", None, "9", "", True) == "9" and show("b", None, "1", "", True) == "true"
    assert [X.col_name(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"] and X.parse_ref("AA10") == (9, 26) and X.parse_ref("A0") is None
    assert X.trim([["a", ""], ["", ""]]) == [["a"]] and X.trim([["", ""]]) == [[""]]


def test_docling():
    d = D.convert(docx())
    assert [t["label"] for t in d["texts"]] == ["paragraph", "paragraph", "paragraph", "footnote"] and d["tables"][0]["data"]["num_cols"] == 2
    assert d["body"]["children"][2] == {"$ref": "#/tables/0"} and d["groups"][0]["name"] == "comments"
    assert D.convert(pptx())["pages"]["2"]["page_no"] == 2


def test_selection():
    text = M.render(pptx())
    assert "Second" not in M.select_sections(text, pages={1}) and "First" not in M.select_sections(text, pages={2})
    assert "My Data" in M.select_sections(M.render(xlsx()), sheets=L.sheet_selector("My Data"))
    with pytest.raises(ValueError):
        M.select_sections(text, pages={9})
    assert L.number_ranges("1,3-5") == [1, 3, 4, 5] and L.sheet_selector("Sales,2,4-5") == ([2, 4, 5], ["Sales"]) and L.spread_pages(3, 9) == [1, 5, 9]
    for bad in ("", "0", "5-3", "1,,2", "x"):
        with pytest.raises(ValueError):
            L.number_ranges(bad)


def test_patches():
    content = writers.docx(docx())
    out, report = P.patch(content, "docx", {"replaces": [{"find": "SUMMARY", "to": "report", "match": "ignore_case", "scope": "body", "keep_formatting": True}]})
    assert report == {"parts_scanned": 1, "parts_modified": 1, "replacements_applied": 1}
    assert ir.plain(prose.read_docx(out)["sections"][0]["blocks"][0]["Paragraph"]) == "A report"
    with pytest.raises(ValueError):
        P.patch(content, "docx", {"replaces": [{"find": "nowhere", "to": "x"}]})
    runs = "<w:p><w:r><w:t>Hel</w:t></w:r><w:r><w:t>lo wor</w:t></w:r><w:r><w:t>ld &amp; all</w:t></w:r></w:p>"
    assert P.replace_in_runs(runs, "w:t", {"find": "Hello world", "to": "Bye"}) == ('<w:p><w:r><w:t>Bye</w:t></w:r><w:r><w:t></w:t></w:r><w:r><w:t xml:space="preserve"> &amp; all</w:t></w:r></w:p>', 1)
    assert P.replace_text("a.b a.b", {"find": "a.b", "to": "$1"}) == ("$1 $1", 2) and P.replace_text("The the", {"find": "the", "to": "<$0>", "match": "ignore_case", "mode": "first"}) == ("<The> the", 1)
    book, report = P.patch(writers.xlsx(xlsx()), "xlsx", {"renames": [("Sales", "New 'one'")]})
    assert X.sheet_names(book) == ["New 'one'", "My Data"]
    assert P.rewrite_sheet_refs("=Sales!A1+'Sales'!B1+MySales!C1", "Sales", "x y") == ("='x y'!A1+'x y'!B1+MySales!C1", 2)
    core = package.write({"docProps/core.xml": '<cp:coreProperties xmlns:cp="c"></cp:coreProperties>', "word/document.xml": "<a/>"})
    titled, _ = P.patch(core, "docx", {"title": "T & U"})
    assert package.Package(titled).properties()["core"]["title"] == "T & U"


def test_pdf():
    d = pdf.read_pdf(pdf_bytes())
    assert d["pdf"]["diagnostics"] == {"classification": "TextBased", "confidence": 1.0, "page_count": 1, "pages_needing_ocr": [], "has_encoding_issues": False}
    assert d["pdf"]["pages"][0]["markdown"] == "# A heading\n\nSome words on two lines. and a third" and d["properties"]["core"]["title"] == "A title"
    assert pdf.fonts_used(pdf_bytes()) == [{"font": "Helvetica", "pages": [1], "items": 5}]
    codes, width = pdf.to_unicode(b"begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0001> <0003> <0041> endbfrange 1 beginbfchar <0009> <00660069> endbfchar")
    assert width == 2 and codes == {1: "A", 2: "B", 3: "C", 9: "fi"}
    assert pdf.read_pdf(pdf_bytes(b"q Q"))["pdf"]["diagnostics"]["classification"] == "Scanned"


def test_documents_as_rows(spark, tmp_path):
    rows = [(1, writers.docx(docx()), None), (2, writers.xlsx(xlsx()), "xlsx"), (3, pdf_bytes(), "pdf"), (4, CSV, "csv"), (5, b"nothing", None), (6, None, None), (7, writers.pptx(pptx()), ".pptx")]
    df = spark.createDataFrame(rows, "doc_id int, content binary, format string").repartition(3)
    got = {r["doc_id"]: r for r in S.markdown(df).collect()}
    assert got[1]["markdown"] == S.to_markdown(rows[0][1]) and got[5]["error"] and got[6]["error"] and not got[7]["error"]
    assert json.loads({r["doc_id"]: r for r in S.ir_json(df, light=True).collect()}[2]["ir"])["sheets"][0]["tables"] == []
    assert json.loads({r["doc_id"]: r["info"] for r in S.inspected(df).collect()}[2])["sheets"][0] == {"name": "Sales", "rows": 3, "cols": 2}
    books = df.where("doc_id = 2")
    cells = {(r["sheet"], r["row"], r["col"]): r["text"] for r in S.xlsx_texts(books).collect()}
    assert cells[1, 0, 0] == "Name" and cells[1, 1, 1] == "12" and cells[2, 0, 0] == "1"
    assert S.parts(books).where("part_name = 'xl/workbook.xml'").first()["content_type"].endswith("main+xml")
    assert S.pdf_items(df.where("doc_id = 3")).count() == 5
    out = {r["doc_id"]: r for r in S.patched(df.where("doc_id in (1, 2)"), {"replaces": [{"find": "EMEA", "to": "EU"}]}).collect()}
    assert out[1]["result"]["replacements_applied"] == 1 and out[2]["error"]
    made = S.created(spark.createDataFrame([(1, S.to_markdown(rows[0][1]))], "doc_id int, markdown string"), "docx").first()
    assert package.detect_format(bytes(made["content"])) == "docx"
    assert "-b\n+c" in S.diffs(spark.createDataFrame([(1, "a\nb", "a\nc")], "doc_id int, a string, b string")).first()["diff"]
    S.register(spark)
    df.createOrReplaceTempView("files")
    assert spark.sql("select doc_format(content) f from files where doc_id = 1").first()["f"] == ".docx"


def test_stream(spark, tmp_path):
    from quirelake.streaming.ingest import markdown_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(CSV)
    q = markdown_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert "| Widget |" in spark.sql("select markdown from streamed").first()["markdown"]
    assert S.read_files(spark, str(tmp_path / "in")).first()["format"] == "csv"


def test_pdf_page_of_over_a_million_values_is_read_to_its_end():
    d = pdf.Document(pdf_bytes(b"0 0 0 rg " * 260_000 + b"BT /F1 12 Tf 72 700 Td (the end) Tj ET"))
    assert [i["text"] for i in pdf.page_items(d, d.pages()[0])["items"]] == ["the end"]


def test_pdf_paragraphs_by_the_documents_own_gaps():
    page = b"BT /F1 10 Tf 72 700 Td (one) Tj " + b"".join(b"0 -%d Td (%s) Tj " % x for x in [(24, b"two"), (24, b"three"), (24, b"four"), (40, b"five"), (24, b"six"), (24, b"seven")]) + b"ET"
    assert pdf.read_pdf(pdf_bytes(page))["pdf"]["pages"][0]["markdown"] == "one two three four\n\nfive six seven"


def test_pptx_has_a_master_and_a_layout():
    with zipfile.ZipFile(io.BytesIO(writers.pptx(pptx()))) as z:
        read = {n: z.read(n).decode() for n in z.namelist()}
    assert "<p:sldMaster " in read["ppt/slideMasters/slideMaster1.xml"] and "<p:sldLayout " in read["ppt/slideLayouts/slideLayout1.xml"]
    assert "slideLayout1.xml" in read["ppt/slides/_rels/slide1.xml.rels"] and "slideMaster1.xml" in read["ppt/slideLayouts/_rels/slideLayout1.xml.rels"]
    assert "sldMasterIdLst" in read["ppt/presentation.xml"] and "slideMaster+xml" in read["[Content_Types].xml"]
