"""Bookkeeping of datasets: a table of rows with the map from dataset ids to identifiers.

The map is a DataFrame (id, identifier) beside the rows, so that a selection among 10^5 datasets is one semi-join. Maps are
small beside their rows but not bounded: joins with them are left to the optimiser, which broadcasts by measured size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import checkpoint_dir


def dense(table: DataFrame, order: list[str], name: str) -> DataFrame:
    """table with a number from 0 in the order of distinct values of a column set: ranks within ranges, shifted by the sizes before.

    The values are dealt by range, so no task sorts them all; what goes through one task is a row per range. They are
    written once, as ranges are cut by a sample.
    """
    checkpoint_dir(table)
    keys = table.select(*order).distinct().repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    keys = keys.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sizes = keys.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = keys.join(before, "_part").select(*order, (F.col("_rank") + F.col("_before")).cast("int").alias(name))
    return table.join(numbered, order)


@dataclass(frozen=True)
class Datasets:
    """Rows with a column ``id``, and the map (id, identifier). Rows of id -1 belong to no dataset."""

    rows: DataFrame
    ids: DataFrame

    def select(self, condition: Column) -> Datasets:
        """Rows of a condition; the map keeps the ids that are left."""
        return Datasets(self.rows.where(condition), self.ids).clean()

    def columns(self, *names: str) -> Datasets:
        """Some columns, and the whole map."""
        return Datasets(self.rows.select(*names), self.ids)

    def slice(self, row_id: str, start: int, stop: int, step: int = 1) -> Datasets:
        """Every step-th row of half-open [start, stop), and the ids that they have."""
        at = F.col(row_id)
        return self.select((at >= start) & (at < stop) & ((at - start) % step == 0))

    def clean(self) -> Datasets:
        """The map without ids that no row has."""
        return Datasets(self.rows, self.ids.join(self.rows.select("id").distinct(), "id", "left_semi"))

    def select_identifiers(self, identifiers: list[str]) -> Datasets:
        """Rows and map of these identifiers; unknown ones are passed over."""
        ids = self.ids.where(F.col("identifier").isin(identifiers))
        return Datasets(self.rows.join(ids.select("id"), "id", "left_semi"), ids)

    def remove_identifiers(self, identifiers: list[str]) -> Datasets:
        """Rows and map without these identifiers; unknown ones are passed over."""
        gone = self.ids.where(F.col("identifier").isin(identifiers)).select("id")
        return Datasets(self.rows.join(gone, "id", "left_anti"), self.ids.join(gone, "id", "left_anti"))

    def unknown(self, identifiers: list[str]) -> list[str]:
        """Those of the identifiers that the map lacks."""
        known = {r.identifier for r in self.ids.where(F.col("identifier").isin(identifiers)).collect()}  # as many as were asked for
        return [x for x in identifiers if x not in known]

    def choose(self, *, use: list[str] | None = None, exclude: list[str] | None = None) -> Datasets:
        """Datasets to use, or all but those to exclude. ValueError for both, or for unknown ones."""
        if use and exclude:
            raise ValueError("choose datasets to use or to exclude, not both")
        if missing := self.unknown(use or exclude or []):
            raise ValueError(f"no datasets {', '.join(missing)}")
        return self.select_identifiers(use) if use else self.remove_identifiers(exclude) if exclude else self

    def choose_ids(self, *, use: list[int] | None = None, exclude: list[int] | None = None) -> Datasets:
        """As ``choose``, by id."""
        if use and exclude:
            raise ValueError("choose datasets to use or to exclude, not both")
        if not (use or exclude):
            return self
        known = {r.id for r in self.ids.where(F.col("id").isin(use or exclude)).collect()}
        if missing := [i for i in use or exclude if i not in known]:
            raise ValueError(f"no datasets {missing}")
        keep = F.col("id").isin(use) if use else ~F.col("id").isin(exclude)
        return Datasets(self.rows.where(keep), self.ids.where(keep))

    def in_order(self, identifiers: list[str]) -> DataFrame:
        """The rows of a list of identifiers, with ``place`` of their dataset in it: the order of the selection."""
        spark = self.rows.sparkSession
        places = spark.createDataFrame(list(enumerate(identifiers)), "place int, identifier string")
        return self.rows.join(self.ids.join(places, "identifier").select("id", "place"), "id")

    def reset_ids(self) -> Datasets:
        """Ids 0 to n - 1 in the map's order; id -1 stays."""
        new = dense(self.ids, ["id"], "_new")
        rows = self.rows.join(new.select("id", "_new"), "id", "left").withColumn("id", F.coalesce("_new", F.when(F.col("id") == -1, -1)).cast("int"))
        return Datasets(rows.drop("_new").select(self.rows.columns), new.select(F.col("_new").alias("id"), "identifier"))

    def assign_identifiers(self, seed: int = 0) -> Datasets:
        """Names for the ids that have none (null or empty): hashes of seed and id, the same again for the same seed. Given names stay."""
        made = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
        missing = self.rows.where("id >= 0").select("id").distinct().join(self.ids, "id", "left_anti").withColumn("identifier", F.lit(None).cast("string"))
        ids = self.ids.unionByName(missing)
        return Datasets(self.rows, ids.withColumn("identifier", F.when(F.length(F.coalesce("identifier", F.lit(""))) == 0, made).otherwise(F.col("identifier"))))

    def faults(self) -> DataFrame:
        """fault, n: identifiers that two ids have, ids of two identifiers, and rows whose id isn't mapped; no row where all is consistent."""
        twice = self.ids.groupBy("identifier").agg(F.countDistinct("id").alias("n")).where("n > 1").agg(F.count("*").alias("n"))
        double = self.ids.groupBy("id").agg(F.countDistinct("identifier").alias("n")).where("n > 1").agg(F.count("*").alias("n"))
        lost = self.rows.where("id >= 0").join(self.ids.select("id"), "id", "left_anti").agg(F.count("*").alias("n"))
        named = [x.select(F.lit(name).alias("fault"), "n") for name, x in (("identifier of two ids", twice), ("id of two identifiers", double), ("rows without a dataset", lost))]
        return reduce(DataFrame.unionByName, named).where("n > 0")

    def consistent(self) -> bool:
        return self.faults().isEmpty()

    def extend(self, other: Datasets) -> Datasets:
        """UNION ALL of rows and maps; ValueError if one id has two identifiers."""
        out = Datasets(self.rows.unionByName(other.rows), self.ids.unionByName(other.ids).distinct())
        if not out.ids.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("an id has two identifiers")
        return out

    def indices_by_id(self, n: int, row_id: str = "row_id") -> DataFrame:
        """id, rows: the row numbers of each of n datasets in order, empty for those without rows."""
        grid = self.rows.sparkSession.range(n).select(F.col("id").cast("int").alias("id"))
        met = self.rows.groupBy("id").agg(F.array_sort(F.collect_list(row_id)).alias("rows"))
        return grid.join(met, "id", "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<long>")))

    def top(self, n: int) -> Datasets:
        """The n datasets of most rows, ties to the smaller id."""
        best = self.rows.where("id >= 0").groupBy("id").count().orderBy(F.desc("count"), "id").limit(n).select("id")
        return Datasets(self.rows.join(F.broadcast(best), "id", "left_semi"), self.ids.join(F.broadcast(best), "id", "left_semi"))  # n rows

    def top_by_significance(self, n: int, i_over_sigma: Column) -> Datasets:
        """The n datasets of highest mean I / sigma, ties to the smaller id."""
        best = self.rows.where("id >= 0").groupBy("id").agg(F.avg(i_over_sigma).alias("_m")).orderBy(F.desc("_m"), "id").limit(n).select("id")
        return Datasets(self.rows.join(F.broadcast(best), "id", "left_semi"), self.ids.join(F.broadcast(best), "id", "left_semi"))  # n rows

    def random(self, n: int, seed: int = 0) -> Datasets:
        """n datasets, those of the least hash of seed and id."""
        best = self.ids.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), "id").limit(n).select("id")
        return Datasets(self.rows.join(F.broadcast(best), "id", "left_semi"), self.ids.join(F.broadcast(best), "id", "left_semi"))  # n rows

    def by_dataset(self, function, schema: str) -> DataFrame:
        """function(pandas rows of one dataset) for each: for steps that SQL can't express; a dataset must fit one task."""
        return self.rows.where("id >= 0").groupBy("id").applyInPandas(function, schema)


def combine(sets: list[Datasets]) -> Datasets:
    """All datasets in one table, renumbered 0 to n - 1 by (place in the list, id); id -1 stays."""
    maps = reduce(DataFrame.unionByName, (s.ids.select(F.lit(k).alias("_set"), "id", "identifier") for k, s in enumerate(sets)))
    numbered = dense(maps, ["_set", "id"], "_new")
    rows = reduce(DataFrame.unionByName, (s.rows.withColumn("_set", F.lit(k)) for k, s in enumerate(sets)))
    met = rows.join(numbered.select("_set", "id", "_new"), ["_set", "id"], "left")
    return Datasets(
        met.withColumn("id", F.coalesce("_new", F.lit(-1)).cast("int")).select(sets[0].rows.columns),
        numbered.select(F.col("_new").cast("int").alias("id"), "identifier"),
    )


def parse_multiple(sets: list[Datasets]) -> Datasets:
    """The tables as they are if no two share an id, else combined."""
    ids = reduce(DataFrame.unionByName, (s.ids.select("id") for s in sets))
    if ids.groupBy("id").count().where("count > 1").isEmpty():
        return reduce(Datasets.extend, sets)
    return combine(sets)


def chunk_of(size: int, id_: str = "id") -> Column:
    """The chunk of datasets that a row goes to when tables are split by so many."""
    return F.floor(F.col(id_) / size).cast("int")


def write_split(table: DataFrame, path: str, by: str) -> None:
    """A folder per value of a column: datasets, chunks or wavelengths."""
    table.write.partitionBy(by).parquet(path)


def image_set_ids(rows: DataFrame, image_set: str, row_id: str = "row_id") -> DataFrame:
    """rows with imageset_id: distinct image sets numbered in the order in which rows first name them."""
    first = rows.groupBy(image_set).agg(F.min(row_id).alias("_first"))
    return rows.join(dense(first, ["_first"], "imageset_id").select(image_set, "imageset_id"), image_set)


def job_blocks(first: int, last: int, size: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Blocks [start, stop) of so many images that overlap by so many, the last one cut at the end."""
    if not 0 <= overlap < size:
        raise ValueError("blocks must be longer than their overlap")
    out, at = [], first
    while True:
        out.append((at, min(at + size, last)))
        if at + size >= last:
            return out
        at += size - overlap


def split_over_blocks(table: DataFrame, first: int, last: int, size: int, overlap: int = 0, z: tuple[str, str] = ("z0", "z1")) -> DataFrame:
    """table with job: one row per block that [z0, z1) meets, rows over an edge in each of both. Blocks are worked out, not joined."""
    n, step = len(job_blocks(first, last, size, overlap)), size - overlap
    low = F.floor((F.col(z[0]) - first - size) / step) + 1
    high = F.ceil((F.col(z[1]) - first) / step) - 1
    jobs = F.sequence(F.greatest(F.lit(0), low).cast("int"), F.least(F.lit(n - 1), high).cast("int"))
    met = (F.col(z[1]) > first) & (F.col(z[0]) < last) & (F.greatest(F.lit(0), low) <= F.least(F.lit(n - 1), high))
    return table.where(met).withColumn("job", F.explode(jobs))


def repeat_groups(image: Column, repeat: int) -> Column:
    """The group of an image in a series that repeats after so many."""
    return F.pmod(image, F.lit(repeat)).cast("int")


def gap_free(batches: DataFrame, batch: str) -> DataFrame:
    """batch, new: batch numbers without gaps, from 0."""
    return dense(batches.select(batch).distinct(), [batch], "new")


#: Words of an image-range command: dataset, first and last image.
_RANGE = r"^(\d+):(\d+):(\d+)$"


def parse_excluded(commands: list[str]) -> list[tuple[int, int, int]]:
    """(id, first, last) of commands "id:first:last", several separated by commas."""
    import re

    out = []
    for part in (p.strip() for c in commands for p in c.split(",")):
        if not (m := re.match(_RANGE, part)):
            raise ValueError(f"can't read the range {part!r}")
        i, first, last = map(int, m.groups())
        if last < first:
            raise ValueError(f"the range {part} ends before it begins")
        out.append((i, first, last))
    return out


def remove_ranges(valid: list[tuple[int, int]], excluded: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed image ranges without some images: what is left, as ranges in order."""
    out = sorted(valid)
    for a, b in excluded:
        rest = []
        for lo, hi in out:
            if b < lo or a > hi:
                rest.append((lo, hi))
                continue
            if lo < a:
                rest.append((lo, a - 1))
            if hi > b:
                rest.append((b + 1, hi))
        out = rest
    return out


def stills_of_sequence(rows: DataFrame, points: DataFrame, z: tuple[str, str] = ("z0", "z1")) -> DataFrame:
    """One row per scan point in [z0, z1) of its dataset, with a dense id of (dataset, point).

    ``points`` (id, first, last) are the scans' images; an id is the points of the datasets before and the place.
    """
    before = points.withColumn("_before", F.sum(F.col("last") - F.col("first")).over(Window.orderBy("id")) - (F.col("last") - F.col("first")))
    met = rows.join(before, "id")
    low, high = F.greatest(F.col(z[0]), F.col("first")), F.least(F.col(z[1]), F.col("last"))
    met = met.where(low < high).withColumn("point", F.explode(F.sequence(low.cast("int"), (high - 1).cast("int"))))
    return met.withColumn("id", (F.col("_before") + F.col("point") - F.col("first")).cast("int")).select(*rows.columns, "point")
