"""Text helpers for columns that leave the platform."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mask_email(email: Column) -> Column:
    """Keep the first letter of the local part; hide everything when there is not exactly one @."""
    parts = F.split(email, "@")
    local, host = parts[0], F.try_element_at(parts, F.lit(2))
    kept = F.when(F.length(local) > 1, F.substring(local, 1, 1)).otherwise("")
    return F.when(F.size(parts) == 2, F.concat(kept, F.lit("***@"), host)).otherwise("***")


def sanitize(text: Column, max_length: int = 255) -> Column:
    """Trimmed of white space and cut to the column width."""
    return F.substring(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")), 1, max_length)
