"""Text functions as Column expressions: cleaning, line classes, quality of extracted text, XML and markdown escapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Prefixes, words and signs that decide a class.
CAPTION_PREFIXES = (
    "Figura ", "Fig. ", "Fig ", "Tabela ", "Source:", "Fonte:", "Source ", "Fonte ", "Note:", "Nota:", "Chart ", "Gráfico ",
    "Graph ", "Diagram ", "Image ", "Imagem ", "Photo ", "Foto ",
)
CODE_PREFIXES = (
    "import ", "export ", "from ", "const ", "let ", "var ", "function ", "class ", "def ", "pub fn ", "fn ", "async fn ", "impl ",
    "=> ", "-> ", ":: ", ":= ",
)
MONOSPACE_FONTS = (
    "courier", "consolas", "monaco", "menlo", "mono", "fixed", "terminal", "typewriter", "source code", "fira code", "jetbrains",
    "inconsolata", "dejavu sans mono", "liberation mono",
)
BOLD_FONTS = ("bold", "-bd", "_bd", "black", "heavy", "demi-bold", "semi-bold")
ITALIC_FONTS = ("italic", "oblique", "-it", "_it", "slant", "inclined", "kursiv")
HYPHEN_LETTERS = "a-zA-ZáàâãéèêíïóôõöúçñÁÀÂÃÉÈÊÍÏÓÔÕÖÚÇÑ"
BULLETS = "•●○◦"
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def trim(c: Column) -> Column:
    """Without the white space around it, all kinds of it."""
    return F.regexp_replace(c, r"^[\s\x{85}\x{A0}\p{Z}]+|[\s\x{85}\x{A0}\p{Z}]+$", "")


def _starts(c: Column, prefixes: tuple[str, ...]) -> Column:
    return _any([F.startswith(c, F.lit(p)) for p in prefixes])


def signs(c: Column, of: str) -> Column:
    """How many characters are of a class (a pattern of one character): what goes without them. No array of matches is made."""
    return F.length(c) - F.length(F.regexp_replace(c, of, ""))


def is_caption_line(c: Column) -> Column:
    t = trim(c)
    return _starts(t, CAPTION_PREFIXES) | F.lower(t).rlike(r"^(figure|table) \s*[0-9(#]") | F.startswith(F.lower(t), F.lit("source:"))


def starts_with_bullet_marker(c: Column) -> Column:
    return c.rlike(rf"^\s*[{BULLETS}*-] ")


def is_list_item(c: Column) -> Column:
    """A bullet, a number or a letter with a dot or parenthesis; a mark with only digits (or none) before it counts if a
    digit stands among the first five characters."""
    head = F.substring(F.regexp_replace(c, r"^\s+", ""), 1, 5)
    numbered = head.rlike(r"[0-9]") & head.rlike(r"^[0-9]*[.)]")
    return starts_with_bullet_marker(c) | numbered | c.rlike(r"^\s*([A-Za-z][.)]|\(.\))")


def format_list_item(c: Column) -> Column:
    t = F.regexp_replace(c, r"^\s+", "")
    return F.regexp_replace(t, rf"^(\*{{0,2}})[{BULLETS}]\s*", "- $1")


def is_code_like(c: Column) -> Column:
    t = trim(c)
    marks = signs(t, r"[{}()\[\];=<>]")
    return _starts(t, CODE_PREFIXES) | ((marks >= 3) & (F.octet_length(t) < 200)) | t.rlike(r"[;{}]$")


def is_monospace_font(c: Column) -> Column:
    return _any([F.contains(F.lower(c), F.lit(p)) for p in MONOSPACE_FONTS])


def is_bold_font(c: Column) -> Column:
    low = F.lower(c)
    return _any([F.contains(low, F.lit(p)) for p in BOLD_FONTS]) | (F.contains(low, F.lit("medium")) & ~F.contains(low, F.lit("mediumitalic")))


def is_italic_font(c: Column) -> Column:
    return _any([F.contains(F.lower(c), F.lit(p)) for p in ITALIC_FONTS])


def is_page_number_line(c: Column) -> Column:
    t = trim(c)
    page = F.lower(t).rlike(r"^page\s*(of$|of |[0-9]|$)")
    return t.rlike(r"^[0-9]{1,4}$") | page | t.rlike(r"^\s*[0-9]+\s* of \s*[0-9]+\s*$") | t.rlike(r"^-\s*[0-9]+\s*-$")


def collapse_dot_leaders(c: Column) -> Column:
    return F.regexp_replace(c, r"\.{4,}", " ... ")


def fix_hyphenation(c: Column) -> Column:
    return F.regexp_replace(c, f"([{HYPHEN_LETTERS}]) - ([{HYPHEN_LETTERS}])", "$1-$2")


def collapse_consecutive_spaces(c: Column) -> Column:
    """Runs of spaces inside a line become one; its indentation stays. Leading empty lines go."""
    inner = F.regexp_replace(c, r"(?m)(?<=\S) {2,}", " ")
    return F.regexp_replace(inner, r"^\n+", "")


def format_urls(c: Column) -> Column:
    """Bare URLs become links, unless they stand in one already."""
    return F.regexp_replace(c, r"(?<!\]\()(?<!\[)(?<!<)(https?://[^\s<>)\]]+[^\s<>)\].,;])", "[$1]($1)")


def remove_page_numbers(c: Column) -> Column:
    """Drops page-number lines that stand alone between empty lines or breaks, or right before a break."""
    lines = F.split(F.regexp_replace(F.regexp_replace(c, r"\r\n", "\n"), r"\n$", ""), "\n", -1)
    # the array of lines is bound once, by transform over an array of one
    return F.array_join(F.element_at(F.transform(F.array(lines), _without_page_numbers), 1), "\n")


def _without_page_numbers(ls: Column) -> Column:
    def keep(line: Column, i: Column) -> Column:
        clean = lambda j: F.trim(F.get(ls, j))
        edge = lambda j: clean(j).isin("", "---")
        alone = ((i == 0) | edge(i - 1)) & ((i + 1 == F.size(ls)) | edge(i + 1))
        before = (clean(i + 1) == "---") | ((clean(i + 1) == "") & (clean(i + 2) == "---"))
        return ~(is_page_number_line(line) & (F.coalesce(alone, F.lit(False)) | F.coalesce(before, F.lit(False))))

    return F.filter(ls, keep)


def clean_markdown(c: Column, hyphens: bool = True, page_numbers: bool = True, urls: bool = True) -> Column:
    """Dot leaders, hyphens, page numbers, URLs, spaces and empty lines, in this order; ends with one line feed."""
    t = collapse_dot_leaders(c)
    t = fix_hyphenation(t) if hyphens else t
    t = remove_page_numbers(t) if page_numbers else t
    t = format_urls(t) if urls else t
    t = F.regexp_replace(collapse_consecutive_spaces(t), r"\n{3,}", "\n\n")
    return F.concat(trim(t), F.lit("\n"))


def normalize_for_comparison(c: Column) -> Column:
    t = trim(F.regexp_replace(c, r"\s+", " "))
    return trim(F.regexp_replace(F.regexp_replace(t, r"^[0-9]+", ""), r"[0-9]+$", ""))


def is_structural_line(c: Column) -> Column:
    return trim(c).rlike(r"^(#|[-*+] |[0-9]+[.)])")


def is_decorative_separator(c: Column) -> Column:
    return trim(c).rlike(r"^(\S)\1+$") & ~trim(c).rlike(r"^[\p{L}\p{N}]")


def has_dot_leaders(c: Column) -> Column:
    return F.contains(c, F.lit("....")) | (F.regexp_count(c, F.lit(r"\.{3,}")) >= 2)


def is_garbage_text(c: Column) -> Column:
    """At least 50 signs, white space and markdown marks apart, less than half of them letters or digits."""
    good = signs(c, r"[\p{IsAlphabetic}\p{N}]")
    rest = signs(c, r"[^\s\x{85}\p{Z}#*|\-\p{IsAlphabetic}\p{N}]")
    return (good + rest >= 50) & (good * 2 < good + rest)


def is_cid_garbage(c: Column) -> Column:
    total = signs(c, r"[^\s\x{85}\p{Z}]")
    control = signs(c, r"[\x{80}-\x{84}\x{86}-\x{9F}]")
    high = signs(c, r"[\x{A1}-\x{FF}]")
    letters = signs(c, "[A-Za-z]")
    return is_garbage_text(c) | ((total >= 5) & ((control * 20 >= total) | ((high * 5 >= total * 2) & (letters * 3 < total))))


def detect_encoding_issues(c: Column) -> Column:
    """A replacement character, or dollars that stand for spaces."""
    dollars = signs(c, r"\$")
    between = signs(c, r"(?<=[A-Za-z])\$(?=[A-Za-z])")
    return F.contains(c, F.lit("\ufffd")) | ((dollars > 10) & ((between > 20) | (between * 2 > dollars)))


def expand_ligatures(c: Column) -> Column:
    t = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "")
    t = F.regexp_replace(t, r"[\x{2000}-\x{200A}]", " ")
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), t)


def is_rtl_text(c: Column) -> Column:
    rtl = signs(c, r"[\x{590}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFC}]")
    other = signs(c, r"[\p{IsAlphabetic}&&[^\x{590}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFC}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]]")
    return (rtl > 0) & (rtl > other)


def normalize_font_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^/", ""), r"^[A-Z]{6}\+", "")


def parse_page_marker(c: Column) -> Column:
    return F.nullif(F.regexp_extract(trim(c), r"^<!-- Page ([0-9]+) -->$", 1), F.lit("")).cast("int")


def starts_with_section_number(c: Column) -> Column:
    return c.rlike(r"^\s*[0-9]+(\.[0-9]+)+")


def is_footnote_row(c: Column) -> Column:
    return trim(c).rlike(r"^(\([0-9]{1,2}\)|[0-9]{1,2}\)|[*†‡])\s*\S")


def is_page_number_cell(c: Column) -> Column:
    return trim(c).rlike(r"^([0-9]{1,4}|[0-9]{1,3}-[0-9]{1,3}|[A-Z]-[0-9]{1,3})$")


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def excel_sheet_ref(c: Column) -> Column:
    return F.when(c.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$"), c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")))


def escape_pipes(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def unescape_pipes(c: Column) -> Column:
    return F.replace(c, F.lit("\\|"), F.lit("|"))


def literal_pattern(find: Column) -> Column:
    """A regular expression that finds just this text."""
    return F.regexp_replace(find, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def occurrences(c: Column, find: str, match: str = "exact") -> Column:
    """How often the text has it; match: exact, ignore_case, whole_word or whole_word_ignore_case."""
    return F.regexp_count(c, F.lit(_pattern(find, match)))


def replace_text(c: Column, find: str, to: str, match: str = "exact", first: bool = False) -> Column:
    """Exact matches take the replacement as it is; for others $1 and the like in it refer to the match."""
    if match == "exact" and not first:
        return F.replace(c, F.lit(find), F.lit(to))
    to = to.replace("\\", "\\\\")
    to = to.replace("$", "\\$") if match == "exact" else to
    if first:
        return F.regexp_replace(c, "(?s)^(.*?)" + _pattern(find, match), "$1" + to)
    return F.regexp_replace(c, _pattern(find, match), to)


def _pattern(find: str, match: str) -> str:
    import re

    out = re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", find)
    out = rf"\b{out}\b" if "whole_word" in match else out
    return f"(?i){out}" if "ignore_case" in match else out


# Words that a plausible English text has.
COMMON_WORDS = (
    "the", "and", "of", "to", "in", "a", "is", "that", "for", "with", "on", "as", "by", "from", "this", "be", "are", "at", "or", "not", "it", "our",
)
CJK = r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"


def is_cjk(c: Column) -> Column:
    return c.rlike(f"[{CJK}]")


def score_text(c: Column) -> Column:
    """How plausible a decoded text is: 10 for a common word, 1 for a letter or digit, 2 for a space, less 2 for other signs
    (6 for control and replacement characters), less 15 for over 15 letters without a common word."""
    words = F.size(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: w.isin(*COMMON_WORDS)))
    n = lambda p: signs(c, p)
    letters = n(f"[A-Za-z{CJK}]")
    bad = n(r"[\x{0}-\x{1F}\x{7F}-\x{9F}\x{FFFD}]")
    other = F.length(c) - letters - n("[0-9 ]") - bad
    return words * 10 + letters + n(" ") * 2 + n("[0-9]") - (other + bad * 3) * 2 - F.when((letters > 15) & (words == 0), 15).otherwise(0)


def clean_symbol_pua(c: Column) -> Column:
    """Signs of symbol fonts in F000-F0FF: bullets, check marks, and what stands at the code without F000."""
    out = F.translate(c, "\uf0a1\uf0a7\uf0b7\uf0fc", "•••✓")
    codes = [x for x in range(0x20, 0x100) if x not in (0xA1, 0xA7, 0xB7, 0xFC)]
    return F.translate(out, "".join(chr(0xF000 + x) for x in codes), "".join(map(chr, codes)))


def decode_text_string(raw: Column) -> Column:
    """Bytes of a PDF text string: UTF-16 after its mark, else Latin-1."""
    return F.when(F.hex(F.substring(raw, 1, 2)) == "FEFF", F.decode(F.substring(raw, 3, 1 << 30), "UTF-16BE")).otherwise(F.decode(raw, "ISO-8859-1"))


def reverse_visual_rtl(c: Column) -> Column:
    """Lines of visual right-to-left text in logical order: all is reversed, runs of Latin letters and digits are put back."""
    runs = F.regexp_extract_all(F.reverse(c), F.lit(r"[A-Za-z0-9][A-Za-z0-9.,:/-]*[A-Za-z0-9]|[A-Za-z0-9]|[^A-Za-z0-9]+"), F.lit(0))
    return F.when(is_rtl_text(c), F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[A-Za-z0-9]"), F.reverse(r)).otherwise(r)), "")).otherwise(c)


def is_letterspaced(c: Column) -> Column:
    """Most of a text's words are single letters."""
    words = F.filter(F.split(trim(c), r"\s+"), lambda w: w != "")
    single = F.filter(words, lambda w: w.rlike(r"^\p{L}$"))
    return (F.size(words) >= 4) & (F.size(single) >= F.size(words) * 0.7)
