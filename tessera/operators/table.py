"""The table algebra: rows by place, splits, unions, ids of datasets, sorts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require(table: DataFrame, columns: list[str]) -> DataFrame:
    """table, if it has these columns; else KeyError."""
    for c in columns:
        if c not in table.columns:
            raise KeyError(f"Unknown column: {c}")
    return table


def get(table: DataFrame, name: str, default: Column | None = None) -> Column | None:
    """A column, or the default where there is none of that name."""
    return table[name] if name in table.columns else default


def slice_rows(table: DataFrame, row_id: str, start: int, stop: int, step: int = 1) -> DataFrame:
    """Rows of half-open [start, stop) by a dense row id, every step-th."""
    return table.where((F.col(row_id) >= start) & (F.col(row_id) < stop) & ((F.col(row_id) - start) % step == 0))


def select_rows(table: DataFrame, row_id: str, wanted: DataFrame) -> DataFrame:
    """Rows by a table of (pos, row_id): repeated where asked twice; pos gives their order."""
    return table.join(wanted.select("pos", F.col(row_id)), row_id)


def delete_rows(table: DataFrame, row_id: str, unwanted: DataFrame) -> DataFrame:
    """All rows but those."""
    return table.join(unwanted.select(row_id), row_id, "left_anti")


def update(table: DataFrame, other: DataFrame, row_id: str) -> DataFrame:
    """Columns of both by row id; those of other win."""
    kept = [c for c in table.columns if c == row_id or c not in other.columns]
    return table.select(kept).join(other, row_id)


def append_defaults(table: DataFrame, rows: DataFrame) -> DataFrame:
    """UNION ALL; columns that rows lack get the zero of their type."""
    zero = {"string": F.lit(""), "boolean": F.lit(False)}
    missing = {c: zero.get(t, F.lit(0)).cast(t) for c, t in table.dtypes if c not in rows.columns}
    return table.unionByName(rows.withColumns(missing))


def extend(table: DataFrame, other: DataFrame, ids: DataFrame, other_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """UNION ALL of rows and of the maps (id, identifier); ValueError if one id has two identifiers."""
    both = ids.unionByName(other_ids).distinct()
    if not both.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("an id has two identifiers")
    return table.unionByName(other), both


def concat(tables: list[DataFrame]) -> DataFrame:
    """UNION ALL with ids renumbered 0.. by (table, id); id -1 stays."""
    tagged = [t.withColumn("_table", F.lit(k)) for k, t in enumerate(tables)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    pairs = rows.where("id >= 0").select("_table", "id").distinct()
    # a row per dataset: a dimension table
    new = pairs.withColumn("_new", F.dense_rank().over(Window.orderBy("_table", "id")) - 1)
    joined = rows.join(F.broadcast(new), ["_table", "id"], "left")
    return joined.withColumn("id", F.coalesce("_new", "id").cast("int")).drop("_table", "_new")


def reset_ids(table: DataFrame) -> DataFrame:
    """Ids compacted to 0..n-1 in ascending order; -1 stays."""
    return concat([table])


def split_partials(table: DataFrame, z0: str = "z0", z1: str = "z1", row_id: str = "row_id") -> DataFrame:
    """One row per plane of [z0, z1), with partial_id, the row it comes from. The column is there even if no row spans planes."""
    planes = table.withColumns({"partial_id": F.col(row_id), "_z": F.explode(F.sequence(F.col(z0), F.col(z1) - 1))})
    return planes.withColumns({z0: F.col("_z"), z1: F.col("_z") + 1}).drop("_z")


def random_split(table: DataFrame, n: int, seed: int, order: list[str]) -> DataFrame:
    """table with part 0..n-1, parts of near-equal size: rows in the order of md5 of seed and row, dealt in turn.

    Places come from buckets of the hash, as many as keep one to some hundred thousand rows, and their sizes before.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in order)))
    digits = max(2, math.ceil(math.log(max(table.count(), 1) / 100_000 + 1, 16)) + 1)
    parts = table.withColumns({"_key": key, "_bucket": F.substr(key, F.lit(1), F.lit(digits))})
    sizes = parts.groupBy("_bucket").count()
    before = sizes.select("_bucket", (F.sum("count").over(Window.orderBy("_bucket")) - F.col("count")).alias("_before"))  # a row per bucket
    ranked = parts.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", *order)) - 1).join(before, "_bucket")
    return ranked.withColumn("part", ((F.col("_rank") + F.col("_before")) % n).cast("int")).drop("_bucket", "_rank", "_before", "_key")


def sort_rows(table: DataFrame, column: str, row_id: str, reverse: bool = False, parts: list[str] | None = None) -> DataFrame:
    """Stable sort by a column, or by some of its components in an order."""
    keys = [F.col(f"{column}.{p}") for p in parts] if parts else [F.col(column)]
    return table.orderBy(*(k.desc() if reverse else k.asc() for k in keys), row_id)


def subsort(table: DataFrame, first: str, second: str, row_id: str) -> DataFrame:
    """Sorted by the second column within runs of the first."""
    return table.orderBy(first, second, row_id)


def top_datasets(table: DataFrame, n: int, key: str = "id") -> DataFrame:
    """Rows of the n datasets with most rows, ties to the smaller id."""
    best = table.groupBy(key).count().orderBy(F.desc("count"), key).limit(n)
    return table.join(F.broadcast(best.select(key)), key, "left_semi")  # n rows


def in_ranges(table: DataFrame, ranges: DataFrame, z: str = "z", how: str = "slice") -> DataFrame:
    """Rows whose z lies in a range (id, lo, hi) of their dataset, told once.

    "slice": lo - 1 <= z < hi. "valid": lo - 1 <= z <= hi. "inside": lo < z < hi.
    """
    x = F.col(z)
    sets = ranges.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("_r"))
    met = table.join(F.broadcast(sets), "id")  # a row per dataset
    inside = {"slice": lambda r: (x >= r["lo"] - 1) & (x < r["hi"]), "valid": lambda r: (x >= r["lo"] - 1) & (x <= r["hi"]), "inside": lambda r: (x > r["lo"]) & (x < r["hi"])}[how]
    return met.where(F.exists("_r", inside)).drop("_r")


def batch_of(z: Column, offset: Column) -> Column:
    """The batch number of an image position."""
    return F.floor(z) + 1 + offset


def add_hash(h: Column, k: Column, l: Column, entering: Column) -> Column:  # noqa: E741
    """A number of an index triple in (-512, 512) and a direction."""
    return entering.cast("long") * (1 << 30) + (h + 512) * (1 << 20) + (k + 512) * (1 << 10) + (l + 512)


def tolerance_groups(values: DataFrame, value: str, tolerance: float) -> DataFrame:
    """value, grp: sorted distinct values; a group ends where a value is more than tolerance above its first.

    A gap wider than the tolerance ends a group wherever the group began, so values are first cut into runs without such
    gaps; a run streams through one task in order, its groups are numbered after those of the runs before. Only a row per
    run is numbered in one task.
    """
    from tessera.operators.ranks import value_places

    kind = dict(values.dtypes)[value]
    places = value_places(values.select(value).distinct().withColumn("_one", F.lit(1)), ["_one"], value).select(value, "before")
    ahead = places.select(F.col(value).alias("_last"), (F.col("before") + 1).alias("before"))
    cut = places.join(ahead, "before", "left").withColumn("_cut", F.col("_last").isNull() | (F.col(value) - F.col("_last") > tolerance))
    starts = cut.where("_cut").select(F.col("before").alias("_run"), F.lead("before").over(Window.orderBy("before")).alias("_end"))
    ranged = cut.select(value, "before").withColumn("_k", F.floor(F.col("before") / 65536))
    spans = starts.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_run") / 65536), F.floor((F.coalesce("_end", F.lit(places.count())) - 1) / 65536))))
    met = ranged.join(spans, "_k").where((F.col("before") >= F.col("_run")) & (F.col("_end").isNull() | (F.col("before") < F.col("_end"))))

    def run(frames):
        last, start, group = None, None, -1
        for f in frames:
            out = []
            for r, v in zip(f["_run"], f[value], strict=True):
                if r != last:
                    last, start, group = r, v, 0
                elif v - start > tolerance:
                    start, group = v, group + 1
                out.append(group)
            yield f[["_run", value]].assign(_in=out)

    told = met.select("_run", value).repartition("_run").sortWithinPartitions("_run", value).mapInPandas(run, f"_run long, {value} {kind}, _in int")
    told = told.checkpoint()
    sizes = told.groupBy("_run").agg((F.max("_in") + 1).alias("_n"))
    earlier = sizes.select("_run", (F.sum("_n").over(Window.orderBy("_run")) - F.col("_n")).alias("_earlier"))
    return told.join(earlier, "_run").select(value, (F.col("_earlier") + F.col("_in")).cast("int").alias("grp"))


# columns and rows one by one


def has_column(table: DataFrame, name: str) -> bool:
    return name in table.columns


def without_columns(table: DataFrame, names: list[str]) -> DataFrame:
    """table without these columns; KeyError for one that it lacks."""
    return require(table, names).drop(*names)


def set_selected_columns(table: DataFrame, other: DataFrame, names: list[str], row_id: str) -> DataFrame:
    """table with some columns taken from another of the same rows."""
    new = require(other, names).select(row_id, *names)
    return table.drop(*names).join(new, row_id).select(*table.columns, *(n for n in names if n not in table.columns))


def set_selected_rows(table: DataFrame, other: DataFrame, row_id: str) -> DataFrame:
    """table with the rows of another in place of those of the same number, in the columns that both have."""
    shared = [c for c in table.columns if c in other.columns and c != row_id]
    new = other.select(row_id, F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in shared))
    met = table.join(new, row_id, "left")
    return met.select(*(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c) for c in table.columns))


def get_row(table: DataFrame, row_id: str, number: int) -> dict:
    """A row as a dictionary; IndexError if there is none."""
    found = table.where(F.col(row_id) == number).first()
    if found is None:
        raise IndexError(number)
    return found.asDict(recursive=True)


def set_row(table: DataFrame, row_id: str, number: int, values: dict) -> DataFrame:
    """table with new values in some columns of a row."""
    here = F.col(row_id) == number
    return table.withColumns({c: F.when(here, F.lit(v).cast(dict(table.dtypes)[c])).otherwise(F.col(c)) for c, v in values.items() if c in require(table, list(values)).columns})


def delete_row(table: DataFrame, row_id: str, number: int) -> DataFrame:
    return table.where(F.col(row_id) != number)


def insert_rows(table: DataFrame, rows: DataFrame, row_id: str, at: int) -> DataFrame:
    """table with rows, numbered from 0, before row ``at``; later rows move on, and columns that rows lack get the zero of their type."""
    n = rows.count()
    later = F.when(F.col(row_id) >= at, F.col(row_id) + n).otherwise(F.col(row_id))
    kind = dict(table.dtypes)[row_id]
    return append_defaults(table.withColumn(row_id, later.cast(kind)), rows.withColumn(row_id, (F.col(row_id) + at).cast(kind)))


def delete_slice(table: DataFrame, row_id: str, start: int, stop: int, step: int = 1) -> DataFrame:
    """table without every step-th row of half-open [start, stop)."""
    at = F.col(row_id)
    return table.where(~((at >= start) & (at < stop) & ((at - start) % step == 0)))


def reordered(table: DataFrame, permutation: DataFrame, row_id: str) -> DataFrame:
    """table with rows renumbered: row ``pos`` is the old row of that number in (pos, row)."""
    met = table.join(permutation.select("pos", F.col("row").alias(row_id)), row_id)
    return met.withColumn(row_id, F.col("pos")).drop("pos").select(table.columns)


def records(table: DataFrame, row_id: str):
    """The rows as dictionaries in order, a partition at a time."""
    for r in table.orderBy(row_id).toLocalIterator():
        yield r.asDict(recursive=True)


def help_text(schema) -> str:
    """Name and type of each column, one a line."""
    return "\n".join(f"{f.name}: {f.dataType.simpleString()}" for f in schema.fields)
