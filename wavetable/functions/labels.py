"""Region labels from hierarchical acronyms, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Acronyms of the visual areas, names that stand for no region, fields told by their beginning, suffix of cortical layers.
VISUAL = ["VIS", "VISa", "VISal", "VISam", "VISl", "VISli", "VISmma", "VISmmp", "VISp", "VISpl", "VISpm", "VISpor", "VISrl"]
NO_REGION = ["", "root", "void", "nan"]
BEGINNINGS = ["CA1", "CA2", "CA3", "DG"]
LAYER = r"(?<=[A-Za-z])[0-9]+(?:/[0-9]+)?[ab]?$"


def region(acronym: Column) -> Column:
    name = F.trim(acronym)
    found = F.when(name.isNull() | name.isin(NO_REGION), F.lit("UNK")).when(F.regexp_replace(name, LAYER, "").isin(VISUAL) | name.isin(VISUAL), "VIS")
    for start in BEGINNINGS:
        found = found.when(name.startswith(start), start)
    return found.otherwise("UNK")
