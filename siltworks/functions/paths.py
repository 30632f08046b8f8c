"""Path spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(c: Column) -> Column:
    """One spelling per folder: blanks around it, back slashes, empty and `.` segments and a closing
    slash are dropped and `name/..` is folded. Null and what is then empty give null."""
    p = F.regexp_replace(F.trim(c), r"[\\/]+", "/")
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(x))
        ),
    )
    s = F.array_join(F.when(F.array_contains(parts, ".."), folded).otherwise(parts), "/")
    return F.nullif(s, F.lit(""))


def trimmed(c: Column) -> Column:
    """Without blanks around it; null where nothing is left."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
