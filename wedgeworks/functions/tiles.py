"""Adjacency as bit masks over tiles of 32 ids; bit 31 is a tile's lowest id. Masks are LONG, because
``bit_count`` extends the sign of an INT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 32


def tile_of(v: str) -> Column:
    """Tile of an id."""
    return F.expr(f"{v} div {WIDTH}")


def tile_mask(v: str) -> Column:
    """The single bit of an id in its tile."""
    return F.expr(f"shiftleft(1L, cast({WIDTH - 1} - {v} % {WIDTH} as int))")


def mask_popcount(mask: Column) -> Column:
    """Bits set in a mask."""
    return F.bit_count(mask).cast("long")


def tile_keys(edges: DataFrame, n: int) -> DataFrame:
    """Linear keys of an edge's lower and upper tile, ``n`` being the padded vertex count."""
    return edges.select("c", "r", F.expr(f"r + (c div {WIDTH}) * {n}L").alias("lower_key"), F.expr(f"c * ({n}L div {WIDTH}) + r div {WIDTH}").alias("upper_key"))


def decode_keys(keys: DataFrame, n: int) -> DataFrame:
    """Tile and id that the linear keys stand for."""
    return keys.select(
        F.expr(f"lower_key div {n}L").alias("lower_tile"), F.expr(f"lower_key % {n}L").alias("lower_r"), F.expr(f"upper_key div ({n}L div {WIDTH})").alias("upper_c"), F.expr(f"upper_key % ({n}L div {WIDTH})").alias("upper_tile")
    )


def lower_tiles(edges: DataFrame) -> DataFrame:
    """``(tile, r, mask)``: smaller neighbours of r in each tile."""
    return edges.groupBy(tile_of("c").alias("tile"), "r").agg(F.bit_or(tile_mask("c")).alias("mask"))


def upper_tiles(edges: DataFrame) -> DataFrame:
    """``(c, tile, mask)``: larger neighbours of c in each tile."""
    return edges.groupBy("c", tile_of("r").alias("tile")).agg(F.bit_or(tile_mask("r")).alias("mask"))


def suffix_ones(u_tiles: DataFrame) -> DataFrame:
    """``(c, tile, ones)``: ones of a pivot from this tile to its last."""
    onward = W.partitionBy("c").orderBy("tile").rowsBetween(0, W.unboundedFollowing)
    return u_tiles.select("c", "tile", F.sum(mask_popcount(F.col("mask"))).over(onward).alias("ones"))


def work_estimate(edges: DataFrame) -> DataFrame:
    """``(warps, blocks)``: 32-wide steps over pivots with two larger neighbours, and fours of them."""
    from .edges import drop_single_pivots

    steps = suffix_ones(upper_tiles(drop_single_pivots(edges))).agg(F.coalesce(F.sum(F.expr(f"(ones + {WIDTH - 1}) div {WIDTH}")), F.lit(0)).alias("warps"))
    return steps.select("warps", F.expr("(warps + 3) div 4").alias("blocks"))


def sort_pairs(l_tiles: DataFrame) -> DataFrame:
    """Lower tiles in order of (tile, r)."""
    return l_tiles.orderBy("tile", "r")
