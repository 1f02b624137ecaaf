"""Fields as tables of cells: one row (t, [z], y, x, v) for each cell that has a value."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lon_to_180, lon_to_360, not_nan


@dataclass(frozen=True)
class Grid:
    """Sizes of a field; z is 1 for a surface. periodic: the last column touches the first."""

    t: int
    y: int
    x: int
    z: int = 1
    periodic: bool = False


def is_periodic(lons: list[float]) -> bool:
    """Whether the columns go around: the last lies a step or less short of the first."""
    return len(lons) > 1 and lons[-1] - lons[0] >= 360 - abs(lons[1] - lons[0])


def ingest(df: DataFrame, value: str = "v") -> DataFrame:
    """A cell table without NaN and NULL cells."""
    return df.withColumn(value, not_nan(F.col(value))).filter(F.col(value).isNotNull())


def from_array(spark: SparkSession, array) -> DataFrame:
    """A small dense NumPy array (t, y, x) or (t, z, y, x) as a cell table."""
    import numpy as np

    a = np.asarray(array, dtype=float)
    at = np.argwhere(~np.isnan(a))
    names = ["t", "y", "x"] if a.ndim == 3 else ["t", "z", "y", "x"]
    rows = [(*map(int, i), float(a[tuple(i)])) for i in at]
    return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", v double")


def read_fields(spark: SparkSession, paths: Iterable[str], value: str = "v") -> DataFrame:
    """Several Parquet files of one field, joined along time."""
    return ingest(spark.read.parquet(*paths), value)


def write_fields(df: DataFrame, path: str) -> None:
    """Parquet, partitioned by t, so later time slices prune."""
    df.repartition("t").write.partitionBy("t").parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder's path within the shared one."""
    import uuid

    from ..operators.graph import shared

    return f"{shared(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def select(df: DataFrame, **bounds: tuple[float, float]) -> DataFrame:
    """Rows whose columns lie within inclusive bounds."""
    for name, (low, high) in bounds.items():
        df = df.filter(F.col(name).between(low, high))
    return df


def convert_lons(dim_x: DataFrame, to: int, lon: str = "lon") -> DataFrame:
    """A longitude dimension (x, lon) in [0, 360) (to=360) or [-180, 180) (to=180), in order: x and the new place, new_x.
    A dimension table is as long as a row of the grid."""
    if lon not in dim_x.columns:
        raise ValueError(f"no column {lon}")
    new = (lon_to_360 if to == 360 else lon_to_180)(F.col(lon).cast("double"))
    out = dim_x.withColumn(lon, new)
    return out.withColumn("new_x", (F.row_number().over(Window.orderBy(lon, "x")) - 1).cast("int"))


#: Prefixes of the two kinds of runs, by scenario.
HISTORICAL = ("b.e21.BHISTcmip6.", "b.e21.BHISTsmbb.")
FUTURE = ("b.e21.BSSP370cmip6.", "b.e21.BSSP370smbb.")


def member_prefixes(names: DataFrame, name: str = "name") -> DataFrame:
    """Of NetCDF file names, the distinct members (scenario, prefix): the name without its last three parts."""
    n = F.col(name)
    scenario = F.when(F.greatest(*[n.startswith(p) for p in HISTORICAL]), "historical").when(
        F.greatest(*[n.startswith(p) for p in FUTURE]), "future"
    )
    rows = names.filter(n.endswith(".nc")).select(scenario.alias("scenario"), F.regexp_replace(n, r"(\.[^.]*){3}$", "").alias("prefix"))
    return rows.filter("scenario IS NOT NULL").distinct()


def find_members(prefixes: DataFrame, part: str, prefix: str = "prefix") -> DataFrame:
    """The prefixes that contain `part`, with their places (from 0) among all in order. A list of a few hundred members."""
    place = (F.row_number().over(Window.orderBy(prefix)) - 1).cast("int")
    return prefixes.select(prefix, place.alias("place")).filter(F.col(prefix).contains(part))


def find_member(prefixes: list[str], part: str) -> list[tuple[str, int]]:
    """The prefixes that contain `part`, with their places."""
    return [(p, i) for i, p in enumerate(prefixes) if part in p]


def member_files(prefix: str, variable: str, scenario: str) -> list[str]:
    """The decade files of a member: 17 historical ones, 9 future ones."""
    first, decades, last = (1850, 16, "201001-201412") if scenario == "historical" else (2015, 8, "209501-210012")
    spans = [f"{y}01-{y + 9}12" for y in range(first, first + 10 * decades, 10)] + [last]
    return [f"{prefix}.{variable}.{s}.nc" for s in spans]


def member_pair(historical: list[str], future: list[str], part: str) -> tuple[str, str]:
    """A member's historical and future prefix. The place is looked up among the historical ones for both."""
    found = find_member(historical, part)
    if not found:
        raise ValueError(f"no member {part}")
    prefix, place = found[0]
    return prefix, future[place]


def monthly_grid(lineitem: DataFrame) -> DataFrame:
    """A surface field of 83 months on 12 x 24 cells, in whole cents."""
    d = lineitem.select("l_shipdate", "l_suppkey", "l_partkey", "l_extendedprice")
    t = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int")
    keys = [t.alias("t"), (F.col("l_suppkey") % 12).cast("int").alias("y"), (F.col("l_partkey") % 24).cast("int").alias("x")]
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return d.groupBy(*keys).agg(F.sum(cents).cast("double").alias("v"))


def quarterly_grid(lineitem: DataFrame) -> DataFrame:
    """A volume field by quarter on 4 x 12 x 24 cells, in whole cents."""
    d = lineitem.select("l_shipdate", "l_suppkey", "l_partkey", "l_extendedprice", "l_linenumber")
    t = ((F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1).cast("int")
    keys = [t.alias("t"), (F.col("l_linenumber") % 4).cast("int").alias("z"), (F.col("l_suppkey") % 12).cast("int").alias("y"),
            (F.col("l_partkey") % 24).cast("int").alias("x")]
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return d.groupBy(*keys).agg(F.sum(cents).cast("double").alias("v"))
