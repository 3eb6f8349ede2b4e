"""Message headers of an export, `d/m/yy[yy], h:mm am|pm - `, and their date rules."""

from __future__ import annotations

import datetime

from . import text as tx

# --- fixed values: header grammar -----------------------------------------------------------
# Parts may be apart by any whitespace, line ends included; any script's digits delimit.
STAMP = (
    rf"\p{{Nd}}{{1,2}}/\p{{Nd}}{{1,2}}/\p{{Nd}}{{2,4}},[{tx.WS}]*"
    rf"\p{{Nd}}{{1,2}}:\p{{Nd}}{{2}}[{tx.WS}]*[AaPp][Mm]"
)
HEADER = rf"{STAMP}[{tx.WS}]*-[{tx.WS}]*"
# Years a nanosecond timestamp can hold in full; others count as unreadable dates.
FIRST_YEAR, LAST_YEAR = 1678, 2261
# --------------------------------------------------------------------------------------------


def stamp_to_date(stamp: str, pivot_year: int | None = None) -> str:
    """SQL for the timestamp of a header, null when it names no valid date.

    ``stamp`` is SQL text too, so that lambdas can use it.

    Day first; a month above 12 with a possible month in the day's place swaps the two.
    Two-digit years fall within fifty years of ``pivot_year`` (default: this year).
    """
    now = pivot_year if pivot_year is not None else datetime.date.today().year
    century = now // 100 * 100
    # p = [day, month, year, hour, minute, am|pm]; the lambda takes the stamp apart only once
    parts = f"regexp_extract_all(lower({stamp}), r'\\p{{Nd}}+|[ap]m', 0)"
    first, second, year, hour, minute = (f"try_cast(p[{i}] AS INT)" for i in range(5))
    swapped = f"{second} > 12 AND {first} <= 12"
    return f"""get(transform(array({parts}), p -> CASE WHEN size(p) = 6 THEN try_make_timestamp_ntz(
        CASE WHEN length(p[2]) = 2 THEN
               CASE WHEN {century} + {year} >= {now + 50} THEN {century - 100} + {year}
                    WHEN {century} + {year} < {now - 50} THEN {century + 100} + {year}
                    ELSE {century} + {year} END
             WHEN length(p[2]) = 4 AND {year} BETWEEN {FIRST_YEAR} AND {LAST_YEAR} THEN {year} END,
        CASE WHEN {swapped} THEN {first} ELSE {second} END,
        CASE WHEN {swapped} THEN {second} ELSE {first} END,
        CASE WHEN {hour} <= 12 THEN {hour} % 12 + CASE WHEN p[5] = 'pm' THEN 12 ELSE 0 END END,
        {minute}, 0) END), 0)"""
