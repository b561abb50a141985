"""The status bits of a row, predicates on them, and a small boolean language over their names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bit positions of each status, and the statuses that are several bits.
BITS = {
    "predicted": 0, "observed": 1, "indexed": 2, "used_in_refinement": 3,
    "strong": 5, "reference_spot": 6, "dont_integrate": 7,
    "integrated_sum": 8, "integrated_prf": 9,
    "overloaded": 10, "overlapped_bg": 11, "overlapped_fg": 12, "in_powder_ring": 13,
    "foreground_includes_bad_pixels": 14, "background_includes_bad_pixels": 15,
    "used_in_modelling": 16, "centroid_outlier": 17,
    "failed_during_background_modelling": 18, "failed_during_summation": 19, "failed_during_profile_fitting": 20,
    "bad_reference": 21, "user_excluded_in_scaling": 22, "outlier_in_scaling": 23, "excluded_for_scaling": 24,
    "excluded_for_refinement": 25, "scaled": 26, "not_suitable_for_refinement": 27,
}
COMPOSITES = {
    "integrated": ["integrated_sum", "integrated_prf"],
    "includes_bad_pixels": ["foreground_includes_bad_pixels", "background_includes_bad_pixels"],
    "bad_shoebox": ["overloaded", "overlapped_bg", "overlapped_fg", "in_powder_ring", "foreground_includes_bad_pixels", "background_includes_bad_pixels"],
    "bad_spot": ["overloaded", "overlapped_bg", "overlapped_fg", "in_powder_ring", "foreground_includes_bad_pixels", "background_includes_bad_pixels"],
    "bad_for_scaling": ["user_excluded_in_scaling", "outlier_in_scaling", "excluded_for_scaling"],
    "bad_for_refinement": ["excluded_for_refinement", "centroid_outlier", "not_suitable_for_refinement"],
}
FLAGS = {name: 1 << bit for name, bit in BITS.items()} | {name: sum(1 << BITS[x] for x in of) for name, of in COMPOSITES.items()}


def has_flags(flags: Column, value: int, every: bool = True) -> Column:
    """Whether all bits of value are set, or any."""
    met = flags.bitwiseAND(F.lit(value))
    return met == value if every else met != 0


def set_flags(flags: Column, rows: Column, value: int) -> Column:
    """flags with the bits of value on where rows holds."""
    return F.when(rows, flags.bitwiseOR(F.lit(value))).otherwise(flags)


def unset_flags(flags: Column, rows: Column, value: int) -> Column:
    """flags with the bits of value off where rows holds."""
    return F.when(rows, flags.bitwiseAND(F.lit(~value))).otherwise(flags)


class FlagExpression:
    """Names joined by `|`, `&`, `~` and brackets, compiled to a Column; a name holds if all its bits are set.

    `|` binds least, then `&`, then `~`. Anything else raises ValueError; nothing is ever evaluated as code.
    """

    def __init__(self, text: str):
        self.tokens = re.findall(r"\w+|[^\w\s]", text)
        self.at = 0
        self.flags: Column | None = None

    def _peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def _take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ""

    def _either(self) -> Column:
        out = self._both()
        while self._peek() == "|":
            self._take()
            out = out | self._both()
        return out

    def _both(self) -> Column:
        out = self._one()
        while self._peek() == "&":
            self._take()
            out = out & self._one()
        return out

    def _one(self) -> Column:
        token = self._take()
        if token == "~":
            return ~self._one()
        if token == "(":
            out = self._either()
            if self._take() != ")":
                raise ValueError("a bracket isn't closed")
            return out
        if token not in FLAGS:
            raise ValueError(f"not a flag: {token or 'end of expression'}")
        return has_flags(self.flags, FLAGS[token])

    def column(self, flags: Column) -> Column:
        self.at, self.flags = 0, flags
        out = self._either()
        if self._peek():
            raise ValueError(f"unexpected {self._peek()}")
        return out


def flag_census(table: DataFrame, flags: str = "flags") -> DataFrame:
    """flag, n: how many rows have each flag, those of none left out; one pass over the table."""
    counts = table.agg(*(F.sum(has_flags(F.col(flags), v).cast("long")).alias(name) for name, v in FLAGS.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("flag"), F.col(name).alias("n")) for name in FLAGS))
    return counts.select(F.explode(pairs).alias("x")).select("x.flag", "x.n").where("n > 0")
