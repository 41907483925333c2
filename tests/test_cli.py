"""Terminal commands over small files."""

import json

import pytest

from quirelake import cli
from quirelake.sources import writers
from tests.test_documents import CSV, docx, pdf_bytes, pptx


def test_markdown_and_json(tmp_path, capsys):
    (tmp_path / "a.csv").write_bytes(CSV)
    assert cli.main(["markdown", str(tmp_path / "a.csv")]) == 0 and "| Widget |" in capsys.readouterr().out
    assert cli.main(["stream", str(tmp_path / "a.csv"), "--output-format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["kind"] == "Xlsx"
    assert cli.main(["convert", str(tmp_path / "a.csv")]) == 0 and "| Widget |" in (tmp_path / "a.md").read_text()
    assert cli.main(["markdown", str(tmp_path / "none.csv")]) == 1 and "error" in capsys.readouterr().err
    assert cli.to_format_and_markdown(writers.docx(docx()))[0] == "docx" and json.loads(cli.to_json(CSV, "csv"))["sheets"]


def test_inspect(tmp_path, capsys, monkeypatch):
    (tmp_path / "a.pptx").write_bytes(writers.pptx(pptx()))
    (tmp_path / "a.pdf").write_bytes(pdf_bytes())
    assert cli.main(["inspect", str(tmp_path / "a.pptx")]) == 0 and "Slides (2):" in capsys.readouterr().out
    assert cli.main(["inspect", str(tmp_path / "a.pdf")]) == 0 and "Classification: TextBased" in capsys.readouterr().out
    monkeypatch.setenv("AI", "1")
    assert cli.main(["inspect", str(tmp_path / "a.pdf")]) == 0 and json.loads(capsys.readouterr().out)["pdf"]["page_count"] == 1


def test_create_and_diff(tmp_path, capsys):
    for n, word in (("a", "one"), ("b", "two")):
        (tmp_path / f"{n}.md").write_text(f"## Section: body\n\nhello <{word}>\n\nthe same\n")
        assert cli.main(["create", str(tmp_path / f"{n}.docx"), str(tmp_path / f"{n}.md")]) == 0
    assert cli.main(["create", str(tmp_path / "a.txt"), str(tmp_path / "a.md")]) == 1
    capsys.readouterr()
    assert cli.main(["diff", str(tmp_path / "a.docx"), str(tmp_path / "b.docx")]) == 0
    said = capsys.readouterr().out
    assert f"{cli.RED}-hello <one>{cli.END}" in said and f"{cli.GREEN}+hello <two>{cli.END}" in said
    assert cli.coloured("") == "No differences found.\n"
    assert cli.main(["diff", str(tmp_path / "a.docx"), str(tmp_path / "b.docx"), "--html", str(tmp_path / "d.html")]) == 0
    assert '<span class="added">+hello &lt;two&gt;</span>' in (tmp_path / "d.html").read_text()


def test_words(capsys):
    assert cli.main(["--help-tree", "1"]) == 0 and "├── markdown — " in capsys.readouterr().out
    assert cli.rendered("# A\n**b** and *c*\n") == f"{cli.BOLD}A{cli.END}\nb and c\n"
    assert "likely needs OCR" in cli.scanned_warning(pdf_bytes(b"q Q")) and "Forced" in cli.scanned_warning(pdf_bytes(b"q Q"), True)
    assert cli.scanned_warning(pdf_bytes()) is None
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
