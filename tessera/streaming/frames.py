"""Images that come in order: frames pushed one after the other per panel, and boxes that are cut out as their planes come."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def pushed_frames(pixels: DataFrame, panel: str = "panel", frame: str = "frame", value: str = "value") -> DataFrame:
    """panel, frame, n, total of each frame of a stream of pixels, whose frames must follow one another.

    A panel's state is its last frame. One that isn't the next, or comes in two batches, ends the query with ValueError:
    there is no lateness to wait for.
    """
    def push(key, parts, state):
        rows = pd.concat(list(parts))
        last = state.get[0] if state.exists else None
        out = []
        for f, part in rows.groupby(frame, sort=True):
            if last is not None and f != last + 1:
                raise ValueError(f"panel {key[0]}: frame {f} after {last}")
            last = int(f)
            out.append((key[0], last, len(part), float(part[value].sum())))
        state.update((last,))
        yield pd.DataFrame(out, columns=["panel", "frame", "n", "total"])

    kind = dict(pixels.dtypes)
    schema = f"panel {kind[panel]}, frame long, n long, total double"
    return pixels.groupBy(panel).applyInPandasWithState(push, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def cut_boxes(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """row_id, data (row-major over z, y, x) of each box of a static table once its last plane has come.

    ``pixels`` is a stream of whole planes: panel, z, y, x, value. A box's state holds its planes so far and is dropped
    when the box is told, so what is kept is the boxes that span the present images.
    """
    b = boxes.select("row_id", "panel", *(f"{a}{k}" for a in "xyz" for k in (0, 1)))
    inside = (F.col("p.panel") == F.col("b.panel"))
    for a in "xyz":
        inside = inside & (F.col(f"p.{a}") >= F.col(f"b.{a}0")) & (F.col(f"p.{a}") < F.col(f"b.{a}1"))
    met = pixels.alias("p").join(b.alias("b"), inside).select("b.row_id", "b.x0", "b.x1", "b.y0", "b.y1", "b.z0", "b.z1", "p.z", "p.y", "p.x", "p.value")

    def collect(key, parts, state):
        rows = pd.concat(list(parts))
        one = rows.iloc[0]
        nx, ny, nz = (int(one[f"{a}1"] - one[f"{a}0"]) for a in "xyz")
        data, seen = (list(state.get[0]), state.get[1]) if state.exists else ([0.0] * (nx * ny * nz), 0)
        at = ((rows["z"] - one["z0"]) * ny + rows["y"] - one["y0"]) * nx + rows["x"] - one["x0"]
        for i, v in zip(at, rows["value"], strict=True):
            data[int(i)] = float(v)
        seen = max(seen, int(rows["z"].max() - one["z0"]) + 1)
        if seen == nz:
            state.remove()
            yield pd.DataFrame({"row_id": [key[0]], "data": [data]})
        else:
            state.update((data, seen))
            yield pd.DataFrame({"row_id": pd.Series([], dtype="int64"), "data": pd.Series([], dtype=object)})

    return met.groupBy("row_id").applyInPandasWithState(collect, "row_id long, data array<double>", "data array<double>, seen int", "append", GroupStateTimeout.NoTimeout)
