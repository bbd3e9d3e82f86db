"""What several test modules share."""

import datetime as dt


def day(n: int) -> dt.date:
    return dt.date(2012, 1, 1) + dt.timedelta(days=n)


def rows(df, *order):
    """Rows as dicts, sorted by the given columns."""
    found = [r.asDict() for r in df.collect()]
    return sorted(found, key=lambda r: tuple((r[c] is not None, r[c]) for c in order)) if order else found
