"""Small text helpers of catalogs and readers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_slices(spec: str, **values: object) -> tuple[slice, ...]:
    """"1:5, ::2, -3:" as slices; ``{name}`` takes a keyword's value first."""
    out = []
    for part in spec.format(**values).split(","):
        bounds = [int(x) if x.strip() else None for x in part.split(":")]
        if len(bounds) > 3:
            raise ValueError(f"not a slice: {part!r}")
        out.append(slice(bounds[0], bounds[0] + 1 or None) if len(bounds) == 1 else slice(*bounds))
    return tuple(out)


def role_key(name: Column) -> Column:
    """A name in lower case, letters and digits only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def identifier(name: str) -> str:
    """A valid identifier for a name."""
    out = re.sub(r"\W", "_", name)
    return f"_{out}" if not out or out[0].isdigit() else out
