"""Text that is safe in a log line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Controls, line and paragraph separators, format characters and lone surrogates.
HIDDEN = "[\\x{0}-\\x{1F}\\x{7F}-\\x{9F}\\x{2028}\\x{2029}\\p{Cf}\\p{Cs}]"


def log_text(x: Column) -> Column:
    """Hidden characters as \\uXXXX (beyond the first plane as two), backslashes doubled; nulls stay null."""
    code = lambda n: F.concat(F.lit("\\u"), F.lpad(F.hex(n), 4, "0"))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        pair = F.concat(code(F.lit(0xD800) + F.floor((n - 0x10000) / 1024)), code(F.lit(0xDC00) + (n - 0x10000) % 1024))
        return F.when(c == "\\", F.lit("\\\\")).when(c.rlike(HIDDEN), F.when(n > 0xFFFF, pair).otherwise(code(n))).otherwise(c)

    plain = ~x.rlike(HIDDEN) & ~F.contains(x, F.lit("\\"))
    return F.when(plain, x).when(x.isNotNull(), F.array_join(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), one), ""))
