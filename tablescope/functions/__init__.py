"""Column expressions (JVM-side, code-generated) used by every operator."""
from .numbers import (to_number, is_number_text, clean_double, as_number, fround, safe,
                      py_float_text, value_text, strip_number_text, has_currency_char)
from .dates import (to_timestamp_mixed, as_timestamp, is_date_text, has_time_of_day,
                    week_end_sunday, monday_week_number, period_start, period_label,
                    granularity_for_span, span_days)
from .text import filled, strip_ws, clean_text, tokens_to_null, first_filled_cells, is_total_row, row_matches

__all__ = [n for n in dir() if not n.startswith("_")]
