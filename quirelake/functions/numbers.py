"""Spreadsheet references, dates and number formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The format codes that a number-format id stands for.
BUILTIN_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss",
    22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 49: "@",
}
# The serial numbers of 1970-01-01 in both date systems.
EPOCH_1900, EPOCH_1904 = 25_569, 24_107


def col_to_name(n: Column) -> Column:
    """1 is A, 27 is AA; 0 is empty. Up to three letters."""
    n = n.cast("long")
    letter = lambda x: F.char(F.lit(65) + F.pmod(x, F.lit(26)))
    one, two, three = n - 1, F.floor((n - 27) / 26), F.floor((n - 703) / 676)
    return (
        F.when(n <= 0, "")
        .when(n <= 26, letter(one))
        .when(n <= 702, F.concat(letter(two), letter(one)))
        .otherwise(F.concat(letter(three), letter(F.floor((n - 27) / 26)), letter(one)))
    )


def cell_ref(row0: Column, col0: Column) -> Column:
    return F.concat(col_to_name(col0 + 1), (row0 + 1).cast("string"))


def parse_cell_ref(ref: Column) -> Column:
    """A1 to struct(row, col), both from 0; null where there is no letter or the row is 0. $ signs are skipped."""
    letters = F.upper(F.regexp_replace(ref, "[^A-Za-z]", ""))
    digits = F.regexp_replace(ref, "[^0-9]", "")
    col = F.aggregate(F.split(letters, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))
    row = digits.try_cast("int")
    ok = (letters != "") & (digits != "") & (row > 0)
    return F.when(ok, F.struct((row - 1).alias("row"), (col - 1).alias("col")))


def dimension_size(ref: Column) -> Column:
    """A1:B2 to struct(rows, cols)."""
    a, b = parse_cell_ref(F.split_part(ref, F.lit(":"), F.lit(1))), parse_cell_ref(F.split_part(ref, F.lit(":"), F.lit(-1)))
    return F.struct((F.abs(b["row"] - a["row"]) + 1).alias("rows"), (F.abs(b["col"] - a["col"]) + 1).alias("cols"))


def excel_serial_text(serial: Column, has_time: bool = False, seconds: bool = False, uses_1904: bool = False) -> Column:
    """A serial day number as ISO text; the time is rounded to seconds."""
    day, part = F.floor(serial), F.round((serial - F.floor(serial)) * 86_400).cast("long")
    day, part = F.when(part >= 86_400, day + 1).otherwise(day), F.when(part >= 86_400, 0).otherwise(part)
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (day - (EPOCH_1904 if uses_1904 else EPOCH_1900)).cast("int")), "yyyy-MM-dd")
    if not has_time:
        return date
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    parts = [two(F.floor(part / 3600)), two(F.floor(F.pmod(part, F.lit(3600)) / 60))] + ([two(F.pmod(part, F.lit(60)))] if seconds else [])
    return F.concat(date, F.lit(" "), F.concat_ws(":", *parts))


def serial_of(ts: Column, uses_1904: bool = False) -> Column:
    """The serial number of a timestamp (UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000.0) + F.lit(EPOCH_1904 if uses_1904 else EPOCH_1900)


def grouped(value: Column, decimals: int, commas: bool = True) -> Column:
    """Fixed decimals, thousands in groups, no minus before zero."""
    text = F.format_number(F.abs(value), decimals)
    text = text if commas else F.replace(text, F.lit(","), F.lit(""))
    zero = "0" if decimals == 0 else "0." + "0" * decimals
    return F.when((value < 0) & (text != zero), F.concat(F.lit("-"), text)).otherwise(text)


def currency(value: Column, decimals: int = 2, commas: bool = True) -> Column:
    body = grouped(value, decimals, commas)
    return F.when(F.startswith(body, F.lit("-")), F.concat(F.lit("-$"), F.substr(body, F.lit(2)))).otherwise(F.concat(F.lit("$"), body))


def percent(value: Column, decimals: int = 2) -> Column:
    return F.concat(grouped(value * 100, decimals, False), F.lit("%"))


def strip_quoted_and_bracketed(code: Column) -> Column:
    return F.regexp_replace(code, r"""\\.|"[^"]*"?|\[[^\]]*\]""", "")


def _core(code: Column) -> Column:
    return F.lower(strip_quoted_and_bracketed(F.split_part(code, F.lit(";"), F.lit(1))))


def is_date_like_format(code: Column) -> Column:
    return _core(code).rlike("yy|dd|mm/|/mm|m/d|d/m|am/pm|h")


def decimal_places(code: Column) -> Column:
    return F.length(F.regexp_extract(strip_quoted_and_bracketed(F.split_part(code, F.lit(";"), F.lit(1))), r"^[^.]*\.([0#]*)", 1))


def builtin_format(num_fmt_id: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in BUILTIN_FORMATS.items() for x in kv)), num_fmt_id.cast("int"))


def is_builtin_date(num_fmt_id: Column) -> Column:
    return num_fmt_id.between(14, 22) | num_fmt_id.between(45, 47)


def format_hint(num_fmt_id: Column, code: Column) -> Column:
    """struct(kind, decimals, grouping, has_time, seconds); kind: date, percent, currency, number or null."""
    date = is_date_like_format(code) | is_builtin_date(num_fmt_id)
    kind = (
        F.when(code.isNull(), F.when(is_builtin_date(num_fmt_id), "date"))
        .when(date, "date")
        .when(F.contains(code, F.lit("%")), "percent")
        .when(F.contains(code, F.lit("$")), "currency")
        .when(code.rlike("[0#]"), "number")
    )
    return F.struct(kind.alias("kind"), F.coalesce(decimal_places(code), F.lit(0)).alias("decimals"), F.coalesce(F.contains(code, F.lit(",")), F.lit(False)).alias("grouping"), F.coalesce(_core(code).rlike("h|am/pm"), F.lit(False)).alias("has_time"), F.coalesce(F.contains(_core(code), F.lit("s")), F.lit(False)).alias("seconds"))


def render_number(value: Column, hint: Column, uses_1904: bool = False, most_decimals: int = 6) -> Column:
    """A number under a format hint; numbers without one keep their text (that of the column)."""
    number = value.try_cast("double")
    by = lambda f: F.coalesce(*(F.when(hint["decimals"] == d, f(d)) for d in range(most_decimals + 1)))
    date = F.when(~hint["has_time"], excel_serial_text(number, uses_1904=uses_1904)).when(hint["seconds"], excel_serial_text(number, True, True, uses_1904)).otherwise(excel_serial_text(number, True, False, uses_1904))
    plain = lambda commas: by(lambda d: grouped(number, d, commas))
    money = lambda commas: by(lambda d: currency(number, d, commas))
    return (
        F.when(hint["kind"] == "date", date)
        .when(hint["kind"] == "percent", by(lambda d: percent(number, d)))
        .when(hint["kind"] == "currency", F.when(hint["grouping"], money(True)).otherwise(money(False)))
        .when(hint["kind"] == "number", F.when(hint["grouping"], plain(True)).otherwise(plain(False)))
        .otherwise(value.cast("string"))
    )


def looks_like_number(c: Column) -> Column:
    return c.rlike("^[0-9.,+-]*$") & c.rlike("[0-9]")


def financial_values(c: Column) -> Column:
    """The values of a cell such as `$ 1,234 $ 5,678`."""
    return F.regexp_extract_all(c, F.lit(r"\(?\$? ?-?[0-9][0-9,]*(?:\.[0-9]+)?%?\)?"), F.lit(0))


def is_writable_number(c: Column) -> Column:
    """Whether a writer stores the text as a number: no leading zero but 0 and 0.x."""
    return c.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")


def looks_like_table_data(c: Column) -> Column:
    """Numbers, dates, part codes, values with units, designations in parentheses, temperature ranges."""
    t = F.trim(c)
    date = (F.length(t) <= 10) & (F.length(t) - F.length(F.regexp_replace(t, "[0-9]", "")) >= 4) & t.rlike("^[0-9/-]*[/-][0-9/-]*$")
    code = (F.length(t) <= 10) & t.rlike(r"^[\p{IsAlphabetic}\p{N}]+$") & t.rlike("[0-9]")
    unit = t.rlike("[0-9]") & t.rlike("°|V|A|Hz|µ|pin")
    paren = F.contains(t, F.lit("(")) & F.contains(t, F.lit(")")) & t.rlike("[0-9]")
    return (t != "") & (looks_like_number(t) | date | code | unit | paren | (t.rlike("°[CF]") & F.contains(t, F.lit("to"))))
