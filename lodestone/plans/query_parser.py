"""Search strings with filters, as a plan and as a predicate."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed names of filters -> column that a filter tests (None: used by a later step) and how.
FILTERS = {"channel": ("channel_id", "="), "topic": (None, "="), "guest": (None, "="), "after": ("upload_date", ">="), "before": ("upload_date", "<="), "language": ("language_iso", "=")}
#: Fixed other names of filters.
ALIASES = {"language": "lang|language"}


@dataclass(frozen=True)
class QueryPlan:
    text: str
    filters: dict[str, str] = field(default_factory=dict)

    def predicate(self) -> Column | None:
        """The filters on columns, all of which must hold; dates compare as dates."""
        out = None
        for name, (column, how) in FILTERS.items():
            if column is None or not (value := self.filters.get(name)):
                continue
            c, v = F.col(column), F.lit(value)
            test = c == v if how == "=" else c >= F.to_date(v) if how == ">=" else c <= F.to_date(v)
            out = test if out is None else out & test
        return out


def parse_query(raw: str) -> QueryPlan:
    """name:value and name:"a value"; of each name the first counts, the rest of the string is free text."""
    text, found = raw, {}
    for name in FILTERS:
        called = ALIASES.get(name, name)
        m = re.search(rf'(?<!\S)(?:{called}):(?:"([^"]*)"|(\S+))', text, re.I)
        if m:
            found[name] = (m[1] if m[1] is not None else m[2]).strip()
            text = text[: m.start()] + " " + text[m.end() :]
    return QueryPlan(" ".join(text.split()), found)
