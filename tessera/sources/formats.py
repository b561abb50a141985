"""Readers and writers by format name, and fixed-width text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import table_file

#: The default columns of a measurement table (fixed values: names, with dots as underscores, and types).
STANDARD = T.StructType(
    [
        T.StructField(name, kind)
        for names, kind in (
            ("flags", T.LongType()),
            ("id", T.IntegerType()),
            ("panel", T.LongType()),
            ("entering", T.BooleanType()),
            ("intensity_sum_value intensity_sum_variance intensity_prf_value intensity_prf_variance lp profile_correlation partiality", T.DoubleType()),
        )
        for name in names.split()
    ]
)


def empty_standard(spark: SparkSession, n: int) -> DataFrame:
    """n rows of the standard columns, each the zero of its type."""
    zero = {T.BooleanType(): F.lit(False)}
    return spark.range(n).select(*(zero.get(f.dataType, F.lit(0)).cast(f.dataType).alias(f.name) for f in STANDARD))


def _text_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a reflection text file: lines of `!` are headers; columns by white space, h k l value sigma x y z first."""
    fields = F.split(F.trim("value"), r"\s+")
    names = [("h", "int"), ("k", "int"), ("l", "int"), ("value", "double"), ("sigma", "double"), ("x", "double"), ("y", "double"), ("z", "double")]
    rows = spark.read.text(path).where(~F.col("value").startswith("!") & (F.trim("value") != ""))
    return rows.select(*(fields[k].cast(kind).alias(name) for k, (name, kind) in enumerate(names)))


READERS = {
    "parquet": lambda spark, path: spark.read.parquet(path),
    "orc": lambda spark, path: spark.read.orc(path),
    "json": lambda spark, path: spark.read.json(path),
    "csv": lambda spark, path: spark.read.csv(path, header=True, inferSchema=True),
    "integrate_hkl": _text_rows,
    "table_file": table_file.read,
}


def sniffed(spark: SparkSession, path: str) -> str:
    """The format of a file: by its suffix, else Parquet, ORC or a table file by what it begins with."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix in ("parquet", "orc", "json", "csv"):
        return suffix
    if suffix == "hkl":
        return "integrate_hkl"
    head = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.substr("content", F.lit(1), F.lit(64)).alias("h")).first()
    raw = bytes(head.h) if head else b""
    if raw[:4] == b"PAR1":
        return "parquet"
    if raw[:3] == b"ORC":
        return "orc"
    if raw[:2] == b"\x1f\x8b" or b"reflection_table" in raw:
        return "table_file"
    raise ValueError(f"can't tell the format of {path}")


def read(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A table of a registered format; "auto" tells it by the file's name and first bytes."""
    if format == "auto":
        format = sniffed(spark, path)
    if format not in READERS:
        raise ValueError(f"no reader for {format}")
    return READERS[format](spark, path)


def fixed_width(columns: list[tuple[str, str]], table: DataFrame) -> Column:
    """One line per row by printf formats."""
    return F.concat(*(F.format_string(f, F.col(c)) for c, f in columns)).alias("value")


#: Lines of text formats (fixed values): columns with printf formats.
LINES = {
    "shelx": [("h", "%4d"), ("k", "%4d"), ("l", "%4d"), ("value", "%8.2f"), ("sigma", "%8.2f"), ("batch", "%4d")],
    "xds_ascii": [("h", "%d"), ("k", " %d"), ("l", " %d"), ("value", " %f"), ("sigma", " %f")],
    "best": [("h", "%4d"), ("k", " %4d"), ("l", " %4d"), ("value", " %10.2f"), ("sigma", " %10.2f")],
    "best_background": [("d", "%10.4f"), ("value", " %10.2f"), ("sigma", " %10.2f")],
    "sadabs": [
        ("h", "%4d"), ("k", "%4d"), ("l", "%4d"), ("value", "%8.2f"), ("sigma", "%8.2f"), ("batch", "%4d"),
        *((c, "%8.5f") for c in ("ix", "dx", "iy", "dy", "iz", "dz")), ("x", "%7.2f"), ("y", "%7.2f"), ("z", "%8.2f"), ("two_theta", "%7.2f"), ("step", "%5d"),
    ],
    "pets": [("h", "%4d"), ("k", "%4d"), ("l", "%4d"), ("value", " %.3f"), ("sigma", " %.3f"), ("zone", " %d")],
    "mmcif": [("row_id", "%d"), ("h", " %4d"), ("k", " %4d"), ("l", " %4d"), ("value", " %8.3f"), ("sigma", " %8.3f"), ("z", " %.2f")],
}
#: Lines before the rows of a format, by its columns (fixed values).
HEADERS = {
    "pets": ["loop_", *(f"_refln_{c}" for c in ("index_h", "index_k", "index_l", "intensity_meas", "intensity_sigma", "zone_axis_id"))],
    "mmcif": ["loop_", *(f"_diffrn_refln.{c}" for c in ("id", "index_h", "index_k", "index_l", "intensity_net", "intensity_sigma", "pdbx_image_id"))],
    "xds_ascii": ["!NUMBER_OF_ITEMS_IN_EACH_DATA_RECORD=5", "!ITEM_H=1", "!ITEM_K=2", "!ITEM_L=3", "!ITEM_IOBS=4", "!ITEM_SIGMA(IOBS)=5", "!END_OF_HEADER"],
}
#: Greatest value and index that a fixed-width format holds.
WIDTHS = {"shelx": (99_999.99, 999), "sadabs": (99_999.99, 999)}


def scale_to_fit(table: DataFrame, format: str) -> DataFrame:
    """table with value and sigma divided by a power of ten, if need be, so that all fit the format's width; ValueError for an index that doesn't."""
    if format not in WIDTHS:
        return table
    most, index = WIDTHS[format]
    ends = table.agg(F.max(F.greatest(F.abs("value"), F.col("sigma"))).alias("v"), F.max(F.greatest(*(F.abs(F.col(c)) for c in "hkl"))).alias("i")).first()
    if ends.i is not None and ends.i > index:
        raise ValueError(f"an index of {ends.i} doesn't fit the {format} format")
    factor = 1.0
    while ends.v is not None and ends.v / factor > most:
        factor *= 10
    return table if factor == 1 else table.withColumns({"value": F.col("value") / factor, "sigma": F.col("sigma") / factor})


def reciprocal_json(table: DataFrame, rlp: list[str], digits: int, dataset: str = "id") -> DataFrame:
    """value: a line of JSON per row, with the reciprocal point rounded and the dataset."""
    return table.select(F.to_json(F.struct(F.array(*(F.round(c, digits) for c in rlp)).alias("rlp"), F.col(dataset).alias("experiment_id"))).alias("value"))


def aligned(tables: dict[str, DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """Merged tables side by side on the union of their keys, columns suffixed by the name; null where a table lacks the key."""
    tagged = None
    for name, t in tables.items():
        one = t.select(*keys, F.lit(name).alias("_t"), *columns)
        tagged = one if tagged is None else tagged.unionByName(one)
    picks = [F.first(F.when(F.col("_t") == n, F.col(c)), ignorenulls=True).alias(f"{c}_{n}") for n in tables for c in columns]
    return tagged.groupBy(*keys).agg(*picks)


def as_indexed_array(table: DataFrame, index: list[str], kind: str) -> DataFrame:
    """index, value and sigma of a kind of intensity, of all rows; KeyError if it is missing."""
    for c in (f"{kind}_value", f"{kind}_variance"):
        if c not in table.columns:
            raise KeyError(f"Unknown column: {c}")
    return table.select(*index, F.col(f"{kind}_value").alias("value"), F.sqrt(f"{kind}_variance").alias("sigma"))


def lines(table: DataFrame, format: str, order: list[str]) -> DataFrame:
    """value, the lines of a text format, sorted by range so that files follow one another."""
    return table.repartitionByRange(*order).sortWithinPartitions(*order).select(fixed_width(LINES[format], table))


def write(table: DataFrame, path: str, format: str = "parquet", order: list[str] | None = None) -> None:
    """Writes a table in a registered format; text formats need an order."""
    if format in LINES:
        out = lines(scale_to_fit(table, format), format, order or ["h", "k", "l"])
        if format in HEADERS:  # a file of its own, first by name
            spark = table.sparkSession
            head = spark.createDataFrame([(x,) for x in HEADERS[format]], "value string").coalesce(1)
            head.write.text(f"{path}/part=0")
            out.write.text(f"{path}/part=1")
        else:
            out.write.text(path)
    elif format in ("parquet", "orc", "json", "csv"):
        table.write.format(format).option("header", True).save(path)
    else:
        raise ValueError(f"no writer for {format}")
