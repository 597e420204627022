"""Time helpers that do not depend on the session's time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, as written (no zone is applied)."""
    t = f"cast({name} as timestamp_ntz)"
    return F.expr(f"datediff({t}, date'1970-01-01') * {DAY}L + hour({t}) * 3600000000L + minute({t}) * 60000000L + cast(extract(second from {t}) * 1000000 as long)")
