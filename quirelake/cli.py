"""Terminal commands: markdown, stream, convert, inspect, diff, create. One document each; batches are DataFrames (documents.py).

    python -m quirelake markdown report.docx
    python -m quirelake diff a.docx b.docx --html out.html
"""

from __future__ import annotations

import argparse
import difflib
import html
import json
import os
import sys
from pathlib import Path

from .operators import layout as L, markdown as M
from .sources import documents as S, pdf, writers
from .sources.package import resolve_format

GREEN, RED, BLUE, BOLD, END = "\x1b[32m", "\x1b[31m", "\x1b[36m", "\x1b[1m", "\x1b[0m"


def _read(path: str) -> bytes:
    return sys.stdin.buffer.read() if path == "-" else Path(path).read_bytes()


def to_format_and_markdown(content: bytes, fmt: str | None = None) -> tuple[str, str]:
    """What a document is, and its markdown."""
    fmt = resolve_format(content, fmt)
    return fmt, S.to_markdown(content, fmt)


def to_json(content: bytes, fmt: str | None = None, pretty: bool = False) -> str:
    """The document tree with whole tables as JSON."""
    return json.dumps(S.extract(content, fmt), ensure_ascii=False, indent=2 if pretty else None)


def unified(a: str, b: str, context: int = 3, names: tuple[str, str] = ("a", "b")) -> str:
    return "".join(difflib.unified_diff(a.splitlines(keepends=True), b.splitlines(keepends=True), *names, n=context))


def coloured(diff: str) -> str:
    """A unified diff for a terminal; a sentence where nothing differs."""
    if not diff:
        return "No differences found.\n"
    paint = {"+++": BOLD, "---": BOLD, "@@": BLUE, "+": GREEN, "-": RED}
    start = lambda x: next((c for p, c in paint.items() if x.startswith(p)), "")
    return "".join(f"{c}{x}{END}\n" if (c := start(x)) else x + "\n" for x in diff.splitlines())


def html_diff(a: str, b: str) -> str:
    """A page of its own with the unified diff, lines classed as added, removed, hunk and context."""
    kind = lambda x: "context" if x.startswith(("+++", "---")) else {"+": "added", "-": "removed", "@": "hunk"}.get(x[:1], "context")
    lines = "\n".join(f'<span class="{kind(x)}">{html.escape(x, quote=False)}</span>' for x in unified(a, b).splitlines())
    style = "body{font-family:monospace;margin:2rem}pre{line-height:1.6}span{display:block}.added{background:#dfd}.removed{background:#fdd}.hunk{color:#06c}"
    return f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<title>markdown diff</title>\n<style>{style}</style>\n</head>\n<body>\n<h1>markdown diff</h1>\n<pre>{lines}</pre>\n</body>\n</html>\n'


def rendered(text: str) -> str:
    """Markdown for a terminal: headings in bold, marks of bold and italic gone."""
    import re

    out = []
    for x in text.splitlines():
        if m := re.match(r"#{1,6} (.*)", x):
            x = f"{BOLD}{m[1]}{END}"
        out.append(re.sub(r"\*\*(.+?)\*\*|(?<!\*)\*([^*\s][^*]*)\*", lambda m: m[1] or m[2], x))
    return "\n".join(out) + "\n"


def inspect_text(info: dict) -> str:
    """What there is in a document, as lines."""
    out = [f"Format: {info['format']}"]
    if info.get("sections"):
        out.append("Sections: " + ", ".join(s["name"] for s in info["sections"]))
    if "sheets" in info:
        out.append(f"Sheets ({len(info['sheets'])}):")
        out += [f"  {k}. {s['name']} ({s['rows']} rows x {s['cols']} cols)" for k, s in enumerate(info["sheets"], 1)]
    if "slides" in info:
        out.append(f"Slides ({len(info['slides'])}):")
        for s in info["slides"]:
            notes = ["notes"] * bool(s["has_notes"]) + [f"{s['comment_count']} comments"] * bool(s["comment_count"])
            out.append(f"  {s['number']}. {s['title'] or '(untitled)'}" + "".join(f" [{n}]" for n in notes))
    if "pdf" in info:
        p = info["pdf"]
        out += ["PDF Diagnostics:", f"  Classification: {p['classification']}", f"  Confidence: {p['confidence']:.4f}", f"  Page count: {p['page_count']}"]
        out += ["  Pages needing OCR: " + (", ".join(map(str, p["pages_needing_ocr"])) or "none"), f"  Has encoding issues: {str(p['has_encoding_issues']).lower()}"]
    return "\n".join(out) + "\n"


def scanned_warning(content: bytes, force: bool = False) -> str | None:
    """Advice for a PDF of images, of which nothing can be read."""
    r = pdf.process(content)
    if r["kind"] not in ("Scanned", "ImageBased"):
        return None
    sure = f"PDF classified as {r['kind']} (confidence: {r['confidence']:.0%}"
    if force:
        return f"Info: {sure}, {r['pages']} page(s)). Forced extraction attempted - output may be empty or incomplete."
    pages = "pages needing OCR: " + ", ".join(map(str, r["pages_needing_ocr"])) if r["pages_needing_ocr"] else f"{r['pages']} page(s)"
    return f"Warning: {sure}, {pages}). No text could be extracted - this document likely needs OCR.\nHint: use --force to attempt extraction anyway."


def with_agent_defaults(args: argparse.Namespace, environ: dict | None = None) -> argparse.Namespace:
    """With AI=1 in the environment the output is indented JSON, unless another is asked for."""
    if (os.environ if environ is None else environ).get("AI") in ("1", "true") and args.output_format is None:
        args.output_format, args.pretty = "json", True
    return args


def help_tree(parser: argparse.ArgumentParser, depth: int = 2) -> str:
    """The commands with their arguments as a tree."""
    out = [f"{parser.prog} — {parser.description or ''}", ""]
    subs = next((a for a in parser._actions if isinstance(a, argparse._SubParsersAction)), None)
    for k, (name, sub) in enumerate(subs.choices.items() if subs else ()):
        last = k + 1 == len(subs.choices)
        out.append(("└── " if last else "├── ") + f"{name} — {sub.description or ''}")
        if depth > 1:
            for a in sub._actions[1:]:
                out.append(("    " if last else "│   ") + f"  {', '.join(a.option_strings) or f'<{a.dest}>'}" + (f"  {a.help}" if a.help else ""))
    return "\n".join(out) + "\n"


def _options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--format", choices=["docx", "xlsx", "csv", "pptx", "pdf"], help="skip detection")
    p.add_argument("--output-format", choices=["markdown", "json"], help="markdown unless told otherwise")
    p.add_argument("--pretty", action="store_true", help="indented JSON, painted markdown")
    p.add_argument("--pages", help="pages or slides, such as 1,3-5")
    p.add_argument("--sheets", help="names or numbers of sheets")
    p.add_argument("--force", action="store_true", help="read scanned PDF files, too")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("quirelake", description="Office documents as markdown and JSON")
    top.add_argument("--help-tree", type=int, metavar="DEPTH", help="all commands as a tree")
    sub = top.add_subparsers(dest="command")
    for name, about in (("markdown", "A document as markdown"), ("stream", "A file, or - for the standard input, as markdown or JSON"), ("inspect", "What there is in a document")):
        p = sub.add_parser(name, description=about)
        p.add_argument("input")
        _options(p)
    p = sub.add_parser("convert", description="A document as a file beside it")
    p.add_argument("input")
    p.add_argument("-o", "--output")
    _options(p)
    p = sub.add_parser("diff", description="How two documents differ")
    p.add_argument("a")
    p.add_argument("b")
    p.add_argument("--html", help="write a page to this file")
    _options(p)
    p = sub.add_parser("create", description="Markdown as a .docx, .xlsx or .pptx file")
    p.add_argument("output")
    p.add_argument("input")
    return top


def _output(content: bytes, args: argparse.Namespace) -> str:
    fmt = resolve_format(content, args.format, None if args.input == "-" else args.input)
    if args.output_format == "json":
        return json.dumps(S.extract(content, fmt, force=args.force), ensure_ascii=False, indent=2 if args.pretty else None) + "\n"
    return rendered(_markdown(content, fmt, args)) if args.pretty else _markdown(content, fmt, args)


def _markdown(content: bytes, fmt: str, args: argparse.Namespace) -> str:
    text = S.to_markdown(content, fmt, **({"force": True} if args.force and fmt == "pdf" else {}))
    if args.pages or args.sheets:
        text = M.select_sections(text, pages=set(L.number_ranges(args.pages)) if args.pages else None, sheets=L.sheet_selector(args.sheets) if args.sheets else None)
    if fmt == "pdf" and len(text.strip()) < 50 and (said := scanned_warning(content, args.force)):
        print(said, file=sys.stderr)
    return text


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    try:
        if args.help_tree is not None or not args.command:
            sys.stdout.write(help_tree(top, args.help_tree or 2))
        elif args.command == "create":
            made = writers.create(M.parse(_read(args.input).decode())[0], Path(args.output).suffix.lstrip(".").lower())
            Path(args.output).write_bytes(made)
            print(f"Created {args.output} ({len(made)} bytes)", file=sys.stderr)
        elif args.command == "diff":
            a, b = (_markdown(c, resolve_format(c, args.format, p), args) for p, c in ((p, _read(p)) for p in (args.a, args.b)))
            if args.html:
                Path(args.html).write_text(html_diff(a, b))
            else:
                sys.stdout.write(coloured(unified(a, b, names=(args.a, args.b))))
        elif args.command == "inspect":
            content = _read(args.input)
            info = S.inspect(content, resolve_format(content, args.format, None if args.input == "-" else args.input))
            with_agent_defaults(args)
            sys.stdout.write(json.dumps(info, indent=2 if args.pretty else None) + "\n" if args.output_format == "json" else inspect_text(info))
        else:
            content = _read(args.input)
            if args.command != "markdown":
                with_agent_defaults(args)
            text = _output(content, args)
            if args.command == "convert":
                to = args.output or str(Path(args.input).with_suffix(".json" if args.output_format == "json" else ".md"))
                Path(to).write_text(text)
                print(f"Wrote {args.output_format or 'markdown'} to {to}", file=sys.stderr)
            else:
                sys.stdout.write(text)
    except (OSError, ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
