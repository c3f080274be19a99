import datetime as dt

UTC = dt.timezone.utc
IST = dt.timezone(dt.timedelta(hours=5, minutes=30))


def at(text: str, zone=UTC) -> dt.datetime:
    """A naive UTC datetime for a wall-clock text in ``zone``."""
    return dt.datetime.fromisoformat(text).replace(tzinfo=zone).astimezone(UTC).replace(tzinfo=None)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
