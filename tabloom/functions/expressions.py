"""Column builders: missing values, parsing, keys, masks, periods, status words. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currency marks that an amount may carry.
CURRENCY_MARKS = ("人民币", "RMB", "CNY", "¥", "￥", "$", "€", "£")
#: Full-width digits and marks of a number, and their plain forms.
WIDE, PLAIN = "０１２３４５６７８９．，（）－＋％　", "0123456789.,()-+% "


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def is_missing(c: str | Column) -> Column:
    """Null, or text of blanks only."""
    return col(c).isNull() | (F.trim(col(c).cast("string")) == "")


def blank_to_null(c: str | Column) -> Column:
    trimmed = F.trim(col(c))
    return F.when(trimmed != "", trimmed)


def parse_number(c: str | Column, scale: int = 6, percent: bool = True) -> Column:
    """Text to decimal(38, scale), null if it is no number: currency marks, grouping commas, (1.5) as -1.5, 5% as 0.05."""
    text = F.translate(col(c).cast("string"), WIDE, PLAIN)
    marks = "|".join("\\" + m if m == "$" else m for m in CURRENCY_MARKS)
    bare = F.trim(F.regexp_replace(text, rf"(?i)({marks})\s*", ""))
    negative = bare.rlike(r"^\(.*\)$")
    bare = F.when(negative, F.regexp_extract(bare, r"^\((.*)\)$", 1)).otherwise(bare)
    share = bare.endswith("%") if percent else F.lit(False)
    bare = F.when(share, F.regexp_replace(bare, "%$", "")).otherwise(bare)
    grouped = bare.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$")
    plain = bare.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?$")
    digits = F.when(grouped, F.regexp_replace(bare, ",", "")).when(plain, bare)
    value = digits.try_cast(f"decimal(38,{scale})")
    value = F.when(share, (value / 100).cast(f"decimal(38,{scale})")).otherwise(value)
    return F.when(negative, -value).otherwise(value)


#: Date patterns tried in this order; ambiguous day/month orders stay null.
DATE_PATTERNS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyy年M月d日", "yyyyMMdd", "d-MMM-yyyy", "yyyy-M-d HH:mm:ss", "yyyy/M/d HH:mm:ss", "yyyy-M-d'T'HH:mm:ss")


def parse_date(c: str | Column, patterns: tuple[str, ...] = DATE_PATTERNS) -> Column:
    text = F.trim(col(c).cast("string"))
    serial = F.when(text.rlike(r"^[2-7]\d{4}(\.0*)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.regexp_extract(text, r"^(\d+)", 1).try_cast("int")))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)).cast("date") for p in patterns], serial)


def canonical_key(c: str | Column) -> Column:
    """Key text: trimmed; a whole number written with a fraction of zeros loses it; missing is null. "001" stays apart from "1"."""
    text = F.trim(col(c).cast("string"))
    short = F.when(text.rlike(r"^-?(0|[1-9]\d*)\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)
    return F.when(text != "", short)


def safe_div(a: str | Column, b: str | Column) -> Column:
    """Null for a zero or null denominator."""
    return F.try_divide(col(a), col(b))


def money(c: str | Column, scale: int = 2) -> Column:
    """Exact amount, so that sums do not depend on the order of rows."""
    return col(c).cast(f"decimal(18,{scale})")


def mask(c: str | Column, method: str = "partial", salt: str = "", char: str = "*", keep_start: int = 1, keep_end: int = 1) -> Column:
    """partial, full, hash, phone, email, name or id; null stays null.

    A text that a method has no form for (a phone number of under seven digits, an address without @, an id of eight characters or
    fewer) is masked partially: all but keep_start and keep_end characters, or all of them if it has no more.
    """
    if len(char) != 1 or keep_start < 0 or keep_end < 0:
        raise ValueError("one mask character, and kept ends of zero or more")
    text = col(c).cast("string")
    n = F.length(text)
    hide = lambda count: F.repeat(F.lit(char), count)
    tail = F.substring(text, -keep_end, keep_end) if keep_end else F.lit("")
    partial = F.when(n <= keep_start + keep_end, hide(F.greatest(n, F.lit(1)))).otherwise(F.concat(F.substring(text, 1, keep_start), hide(n - keep_start - keep_end), tail))
    if method == "partial":
        return partial
    if method == "full":
        return F.when(n.isNotNull(), hide(F.greatest(n, F.lit(3))))
    if method == "hash":
        return F.substring(F.sha2(F.concat(F.lit(salt), text).cast("binary"), 256), 1, 16)
    if method == "phone":
        digits = F.regexp_replace(text, r"\D", "")
        return F.when(F.length(digits) >= 7, F.concat(F.substring(digits, 1, 3), hide(F.length(digits) - 7), F.substring(digits, -4, 4))).otherwise(partial)
    if method == "email":
        host = F.substring_index(text, "@", -1)
        user = F.substring(text, F.lit(1), n - F.length(host) - 1)
        return F.when(text.contains("@"), F.concat(F.substring(user, 1, 1), hide(F.greatest(F.length(user) - 1, F.lit(3))), F.lit("@"), host)).otherwise(partial)
    if method == "name":
        return F.concat(F.substring(text, 1, 1), hide(F.greatest(n - 1, F.lit(1))))
    if method == "id":
        return F.when(n > 8, F.concat(F.substring(text, 1, 4), hide(n - 8), F.substring(text, -4, 4))).otherwise(partial)
    raise ValueError(f"unknown mask: {method}")


PERIODS = ("day", "week", "month", "quarter", "year")


def period(c: str | Column, grain: str) -> Column:
    """First day of the period; weeks start on Monday."""
    if grain not in PERIODS:
        raise ValueError(f"unknown period: {grain}")
    return F.date_trunc(grain, col(c)).cast("date")


def month_text(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def classify(c: str | Column, rules: list[tuple[str, list[str]]], other: str = "unknown") -> Column:
    """First rule one of whose words the text holds; put negative words first."""
    text, out = F.lower(F.trim(col(c).cast("string"))), None
    for label, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w.lower())
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(other) if out is not None else F.lit(other)


def escape_formula(c: str | Column) -> Column:
    """Texts that a spreadsheet would run as a formula get a leading apostrophe."""
    return F.when(col(c).rlike(r"^[ \t\r\n]*[=+\-@]"), F.concat(F.lit("'"), col(c))).otherwise(col(c))
