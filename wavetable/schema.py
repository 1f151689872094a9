"""Tables of the library and the checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Label space in its order, and the label of what maps to none.
CLASSES = ["CA1", "CA2", "CA3", "DG", "VIS"]
UNKNOWN = "UNK"
#: Class views: names of the classes that a score counts.
VIEWS = {"4class": ["CA1", "CA3", "DG", "VIS"], "5class": CLASSES}


def _fields(**kinds: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in kinds.items()]


CHUNK_INDEX = T.StructType(
    _fields(
        chunk_id=T.LongType(), dataset=T.StringType(), session=T.StringType(), probe=T.StringType(), channel=T.IntegerType(), depth_um=T.DoubleType(), acronym=T.StringType(), region=T.StringType(),
        t0_s=T.DoubleType(), grp=T.StringType(), scale_mean_uv=T.DoubleType(), scale_std_uv=T.DoubleType(),
    )
)
OPTIONAL_INDEX = T.StructType(_fields(lateral_um=T.DoubleType(), ccf_ap_um=T.DoubleType(), ccf_dv_um=T.DoubleType(), ccf_lr_um=T.DoubleType()))
CHUNKS = T.StructType([*CHUNK_INDEX.fields, *OPTIONAL_INDEX.fields, T.StructField("fs", T.DoubleType()), T.StructField("wave", T.ArrayType(T.FloatType()))])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df


def guard(ok: Column, value: Column, message: str) -> Column:
    """value, or an error on the first row where ok does not hold."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def view_labels(view: str) -> list[int]:
    return [CLASSES.index(c) for c in VIEWS[view]]


def in_view(df: DataFrame, view: str, label: str = "label") -> DataFrame:
    """Rows whose label a class view counts."""
    return df.filter(F.col(label).isin(view_labels(view)))
