"""Reduction of pictures to an 8x8 luminance grid (HSH4).

:func:`resample_grid` and the default of :func:`image_grids` resample with a Lanczos
kernel of three lobes, columns first and then rows, channel by channel, and take the
luminance of the 64 results.  Weights are whole numbers (2^20 to one), so sums are
exact in any order and the same picture has the same cells on any cluster.
:func:`reduce_grid` takes box means instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.hashing import average_hash
from lumenlake.functions.numbers import div

_SIDE = 8

# Rec. 709 weights of red, green and blue, in ten-thousandths.
_LUMA = (2126, 7152, 722)


def _cell_of(at: Column, size: Column) -> Column:
    return div(at * _SIDE, size).cast("int")


def _cells_under(at: Column, size: Column) -> Column:
    """Grid lines a pixel covers when the picture has fewer pixels than the grid."""
    return F.filter(
        F.sequence(F.lit(0), F.lit(_SIDE - 1)),
        lambda c: div(c * size, _SIDE) == at,
    )


def reduce_grid(pixels: DataFrame) -> DataFrame:
    """Pixel rows ``(id, width, height, x, y, luma)`` to ``(id, cells)``.

    Each cell is the mean of its box, rounded half up.  The sums are combined
    before the shuffle, so at most 64 rows per picture and task move.
    """
    large = (F.col("width") >= _SIDE) & (F.col("height") >= _SIDE)
    direct = pixels.filter(large).select(
        "id", "luma",
        (_cell_of(F.col("y"), F.col("height")) * _SIDE
         + _cell_of(F.col("x"), F.col("width"))).alias("cell"),
    )
    cover = [
        F.when(size >= _SIDE, F.array(_cell_of(at, size))).otherwise(_cells_under(at, size))
        for at, size in [(F.col("x"), F.col("width")), (F.col("y"), F.col("height"))]
    ]
    stretched = (
        pixels.filter(~large)
        .select("id", "luma", cover[0].alias("cols"), cover[1].alias("rows"))
        .select("id", "luma", F.explode("cols").alias("col"), "rows")
        .select("id", "luma", "col", F.explode("rows").alias("row"))
        .select("id", "luma", (F.col("row") * _SIDE + F.col("col")).alias("cell"))
    )
    sums = direct.unionByName(stretched).groupBy("id", "cell").agg(
        F.sum("luma").alias("total"), F.count("*").alias("n")
    )
    means = sums.select(
        "id", "cell",
        div(F.col("total") * 2 + F.col("n"), F.col("n") * 2).cast("int").alias("mean"),
    )
    # 64 entries per picture, always.
    return means.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("cell", "mean"))).getField("mean").alias("cells")
    )


# Weight of a sample at the kernel's centre, and steps per unit between the two passes.
_ONE = 1 << 20
_STEP = 1 << 16


def _weights_of(rows: DataFrame, at: str, size: str) -> DataFrame:
    """Adds ``w0`` to ``w7``: what a sample counts for each cell of its line, null for nothing.

    A column per cell and steps of their own, so that it all becomes compiled code.
    """
    kept, cells = rows.columns, range(_SIDE)
    offsets = [
        f"((2 * {at} + 1) * {_SIDE}L - {2 * c + 1} * {size}) / (2.0D * greatest({size}, {_SIDE})) AS t{c}" for c in cells
    ]
    angles = [f"pi() * t{c} AS p{c}" for c in cells] + [f"pi() * t{c} / 3 AS q{c}" for c in cells]
    weights = [
        f"CASE WHEN t{c} = 0 THEN {_ONE}L WHEN abs(t{c}) < 3 "
        f"THEN CAST(floor(sin(p{c}) / p{c} * sin(q{c}) / q{c} * {_ONE} + 0.5D) AS BIGINT) END AS w{c}" for c in cells
    ]
    counting = [f"CASE WHEN w{c} <> 0 THEN w{c} END AS w{c}" for c in cells]
    return (
        rows.selectExpr(*kept, *offsets).selectExpr(*kept, *[f"t{c}" for c in cells], *angles)
        .selectExpr(*kept, *weights).selectExpr(*kept, *counting)
    )


def _resampled(rows: DataFrame, keys: list[str], at: str, size: str, cell: str, channels: tuple[str, ...], of_key: tuple[str, ...] = ()) -> DataFrame:
    """``keys, of_key, cell, d, channels``: sums of weights and of weighted samples, a row
    for each cell of a line that some sample counts for; ``of_key`` are the same in all of a key.

    The cells of a line are columns of one row until they are summed up, so no row per
    sample and cell is made.
    """
    cells = range(_SIDE)
    sums = _weights_of(rows, at, size).groupBy(*keys).agg(
        *[F.first(x).alias(x) for x in of_key],
        *[F.sum(f"w{c}").alias(f"d{c}") for c in cells],
        *[F.sum(F.col(f"w{c}") * F.col(x)).alias(f"{x}{c}") for x in channels for c in cells],
    )
    listed = F.array(*[
        F.struct(F.lit(c).alias(cell), F.col(f"d{c}").alias("d"), *[F.col(f"{x}{c}").alias(x) for x in channels])
        for c in cells
    ])
    return sums.select(*keys, *of_key, F.inline(listed)).filter("d IS NOT NULL")


def _floor_div(a: str, b: str) -> str:
    """SQL of the floor of a quotient with a positive divisor."""
    return f"(({a} - pmod({a}, {b})) div {b})"


def resample_grid(pixels: DataFrame, channels: tuple[str, ...] = ("luma",)) -> DataFrame:
    """Pixel rows ``(id, width, height, x, y, <channels>)`` to ``(id, cells)``.

    ``channels`` is one of luminance, or red, green and blue.  Each pass adds up weighted
    values and weights for the eight cells of a line; the sums are combined before the
    shuffle, so a column of a picture and then a row of its grid move as one row a task.
    """
    down = _resampled(
        pixels.select("id", "width", "height", "x", "y", *channels), ["id", "x"], "y", "height", "row", channels, ("width",)
    )
    between = [F.expr(_floor_div(f"(2 * {_STEP} * {c} + d)", "(2 * d)")).alias(c) for c in channels]
    across = _resampled(down.select("id", "row", "x", "width", *between), ["id", "row"], "x", "width", "col", channels)
    whole = [
        F.expr(f"least(greatest({_floor_div(f'(2 * {c} + {_STEP} * d)', f'(2 * {_STEP} * d)')}, 0), 255)").alias(c)
        for c in channels
    ]
    cells = across.select("id", (F.col("row") * _SIDE + F.col("col")).alias("cell"), *whole)
    if len(channels) == 1:
        value = F.col(channels[0])
    else:
        value = div(sum(w * F.col(c) for w, c in zip(_LUMA, channels)), 10000)
    # 64 entries per picture, always.
    return cells.select("id", "cell", value.cast("int").alias("value")).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("cell", "value"))).getField("value").alias("cells")
    )


def perceptual_hashes(grids: DataFrame) -> DataFrame:
    """``(id, perceptual_hash)`` of grids."""
    return grids.select("id", average_hash(F.col("cells")).alias("perceptual_hash"))


def image_grids(images: DataFrame, resampling: str = "lanczos") -> DataFrame:
    """``(path, width, height, cells)`` of rows from :func:`sources.images.read_images`.

    The raw bytes of a picture are one binary value; resampling them (``lanczos`` or
    ``box``) is the one step that built-in functions cannot do without a row per pixel.
    """
    cells_of = {"lanczos": _lanczos_cells, "box": _box_means}[resampling]

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = [
                cells_of(data, w, h, c) for data, w, h, c
                in zip(batch["data"], batch["width"], batch["height"], batch["n_channels"])
            ]
            yield batch[["path", "width", "height"]].assign(cells=cells)

    return images.mapInPandas(reduced, "path string, width int, height int, cells array<int>")


def _weights(size: int) -> np.ndarray:
    """Weight of each sample of a line for each cell."""
    i, c = np.arange(size)[None, :], np.arange(_SIDE)[:, None]
    t = ((2 * i + 1) * _SIDE - (2 * c + 1) * size) / (2.0 * max(size, _SIDE))
    return np.where(np.abs(t) < 3, np.floor(np.sinc(t) * np.sinc(t / 3) * _ONE + 0.5), 0).astype(np.int64)


def _lanczos_cells(data: bytes, width: int, height: int, channels: int) -> list[int]:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    down, across = _weights(height), _weights(width)
    d, e = down.sum(axis=1)[:, None], across.sum(axis=1)[None, :]
    planes = []
    # Bytes are ordered B, G, R.
    for k in (0,) if channels == 1 else (2, 1, 0):
        # Whole numbers below 2^53 in floating point: sums are exact.
        lines = (down.astype(np.float64) @ raw[:, :, k].astype(np.float64)).astype(np.int64)
        lines = (2 * _STEP * lines + d) // (2 * d)
        planes.append(np.clip((2 * (lines @ across.T) + _STEP * e) // (2 * _STEP * e), 0, 255))
    luma = planes[0] if channels == 1 else sum(w * p for w, p in zip(_LUMA, planes)) // 10000
    return luma.ravel().tolist()


def _box_means(data: bytes, width: int, height: int, channels: int) -> list[int]:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        luma = raw[:, :, 0].astype(np.int64)
    else:
        # Bytes are ordered B, G, R.
        luma = sum(w * raw[:, :, k].astype(np.int64) for w, k in zip(_LUMA, (2, 1, 0))) // 10000
    out = []
    for row in range(_SIDE):
        top, bottom = _span(row, height)
        for col in range(_SIDE):
            left, right = _span(col, width)
            box = luma[top:bottom, left:right]
            out.append(int((2 * box.sum() + box.size) // (2 * box.size)))
    return out


def _span(cell: int, size: int) -> tuple[int, int]:
    """Pixels of a grid line: those that fall in it, or the one that covers it."""
    if size < _SIDE:
        first = cell * size // _SIDE
        return first, first + 1
    return -(-cell * size // _SIDE), -(-(cell + 1) * size // _SIDE)
