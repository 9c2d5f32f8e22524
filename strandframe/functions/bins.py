"""Bins of the binning index, linear windows and virtual offsets, as Column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (shift, first bin) of the five levels below the whole, finest first. Fixed values.
LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))
WINDOW_SHIFT = 14


def reg2bin(beg: Column, end: Column) -> Column:
    """Smallest bin that holds [beg, end), 0-based; an empty interval counts as its first base."""
    last = F.greatest(end, beg + 1) - 1
    out = F.lit(0)
    for shift, first in reversed(LEVELS):
        out = F.when(F.shiftright(beg, shift) == F.shiftright(last, shift), F.shiftright(beg, shift) + first).otherwise(out)
    return out


def reg2bins(beg: Column, end: Column) -> Column:
    """All bins that may hold records overlapping [beg, end), coarse to fine."""
    last = F.greatest(end, beg + 1) - 1
    levels = [F.sequence(F.shiftright(beg, s) + f, F.shiftright(last, s) + f) for s, f in reversed(LEVELS)]
    return F.concat(F.array(F.lit(0)), *levels)


def linear_window(pos: Column) -> Column:
    return F.shiftright(pos, WINDOW_SHIFT)


def split_voffset(v: Column) -> Column:
    """struct(block offset, offset in the uncompressed block)"""
    v = v.cast("long")
    return F.struct(F.shiftrightunsigned(v, 16).alias("coffset"), v.bitwiseAND(F.lit(65535)).cast("int").alias("uoffset"))


def make_voffset(coffset: Column, uoffset: Column) -> Column:
    return F.shiftleft(coffset.cast("long"), 16).bitwiseOR(uoffset.cast("long"))
