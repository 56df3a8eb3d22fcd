"""Text expressions: trimming, missing tokens, footer-row test, search."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import EXCEL_ERRORS, TOTAL_ROW_PATTERN, WHITESPACE


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def filled(template: str, **parts) -> Column:
    """A text with its ``{name}`` places filled by columns (or plain texts)."""
    pieces = [F.lit(t) if i % 2 == 0 else (parts[t] if isinstance(parts[t], Column) else F.lit(parts[t]))
              for i, t in enumerate(re.split(r"\{(\w+)\}", template)) if i % 2 or t]
    return F.concat(*pieces) if pieces else F.lit("")


def strip_ws(col) -> Column:
    """Remove leading and trailing whitespace of any kind (Python's ``str.strip``)."""
    return F.trim(_c(col).cast("string"), F.lit(WHITESPACE))


def clean_text(col) -> Column:
    """Trim; blank or a spreadsheet error cell → NULL."""
    t = strip_ws(col)
    return F.when((t != "") & ~t.isin(EXCEL_ERRORS), t)


def tokens_to_null(col, tokens) -> Column:
    c = _c(col)
    return F.when(~c.isin(list(tokens)), c)


def first_filled_cells(cols, k: int = 3) -> Column:
    """The first ``k`` non-blank trimmed cells of a row, as an array."""
    arr = F.array(*[F.trim(_c(c).cast("string")) for c in cols])
    filled = F.filter(arr, lambda x: x.isNotNull() & (x != ""))
    return F.slice(filled, 1, k)


def is_total_row(cols, pattern: str = TOTAL_ROW_PATTERN) -> Column:
    """True when one of the row's first three filled cells starts like a footer."""
    return F.exists(first_filled_cells(cols, 3), lambda x: x.rlike(pattern))


def row_matches(cols_text, pattern: str) -> Column:
    """True when any lower-cased cell text matches the (regex) pattern."""
    arr = F.array(*[F.lower(c) for c in cols_text])
    return F.exists(arr, lambda x: x.rlike(pattern))
