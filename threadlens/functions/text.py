"""Text scalars: cleaning, previews, truncation, counts, timestamps, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions.rounding import half_even_div, tenths_str

# Unicode-aware whitespace (Python's str.split() splits on Unicode whitespace).
WS_RE = r"(?U)\s+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(t) -> Column:
    """Python's str.strip(): remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(_c(t), r"(?U)^\s+|\s+$", "")


def clean_text(t) -> Column:
    """TX4: strip lines, drop empty ones, join by space, collapse whitespace."""
    return F.trim(F.regexp_replace(F.coalesce(_c(t), F.lit("")), WS_RE, " "))


def word_count(t) -> Column:
    """TX8: number of whitespace-separated words (maximal runs of non-whitespace)."""
    return F.regexp_count(F.coalesce(_c(t), F.lit("")), F.lit(r"(?U)\S+")).cast("bigint")


def ocr_only(t) -> Column:
    """TX3: text after the first 'Image Text:' up to the next one, stripped; null if absent."""
    parts = F.split(_c(t), "Image Text:")
    return F.when(F.size(parts) > 1, strip(F.element_at(parts, 2)))


def text_preview(t, max_length: int = 500) -> Column:
    """TX6: short text as is; else cut at max, back to the last '.' when it lies in the
    last 30 %, otherwise append '...'."""
    t = _c(t)
    cut = F.substring(t, 1, max_length)
    back = F.instr(F.reverse(cut), ".")
    last_period = F.when(back > 0, F.length(cut) - back).otherwise(F.lit(-1))  # 0-based
    return (F.when(F.length(t) <= max_length, t)
             .when(last_period > max_length * 0.7, F.substring(cut, 1, last_period + 1))
             .otherwise(F.concat(cut, F.lit("..."))))


def truncate_text(t, max_length: int = 100, suffix: str = "...") -> Column:
    """TX7: at most max_length characters including the suffix."""
    t = _c(t)
    keep = max_length - len(suffix)
    if keep >= 0:
        head = F.substring(t, 1, keep)
    else:  # a negative slice end counts from the end of the text
        head = F.substring(t, F.lit(1), F.greatest(F.length(t) + keep, F.lit(0)))
    return F.when(F.length(t) <= max_length, t).otherwise(F.concat(head, F.lit(suffix)))


_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss",
             "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE",
             "%I": "hh", "%p": "a", "%j": "DDD", "%f": "SSSSSS", "%%": "%"}


def strftime_to_spark(fmt: str) -> str:
    """Translate a strftime pattern into a Spark datetime pattern (literal text quoted)."""
    out, lit, i = [], [], 0
    while i < len(fmt):
        code = fmt[i:i + 2]
        if code in _STRFTIME:
            if lit:
                out.append("'" + "".join(lit).replace("'", "''") + "'")
                lit = []
            out.append(_STRFTIME[code])
            i += 2
        else:
            lit.append(fmt[i])
            i += 1
    if lit:
        out.append("'" + "".join(lit).replace("'", "''") + "'")
    return "".join(out)


def format_timestamp(iso, fmt: str = "%Y-%m-%d %H:%M:%S") -> Column:
    """TX9: ISO timestamp text re-rendered with fmt; unparsable input returned unchanged."""
    s = _c(iso)
    ts = F.try_to_timestamp(s)
    return F.coalesce(F.date_format(ts, strftime_to_spark(fmt)), s)


def format_score(n) -> Column:
    """TX10: >= 1e6 as x.xM, >= 1e3 as x.xk, else the number (one decimal, exact half-even)."""
    n = _c(n).cast("bigint")
    return (F.when(n >= 1_000_000, F.concat(tenths_str(half_even_div(n, F.lit(100_000))), F.lit("M")))
             .when(n >= 1_000, F.concat(tenths_str(half_even_div(n, F.lit(100))), F.lit("k")))
             .otherwise(n.cast("string")))
