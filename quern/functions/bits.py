"""Column builders over 64-bit masks of 8 by 8 bitmaps: bit 8y + x is pixel (y, x). All stay within code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 8


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def const(mask: int) -> Column:
    return F.lit(_signed(mask)).cast("long")


COLUMN = [sum(1 << (8 * y + x) for y in range(8)) for x in range(8)]
ROW = [0xFF << (8 * y) for y in range(8)]
ALL = (1 << 64) - 1


def ink(mask: Column) -> Column:
    return F.bit_count(mask)


def shift(mask: Column, dy: int, dx: int) -> Column:
    """Moves the pixels; what leaves the grid is gone, the rest is blank."""
    live = ALL
    for x in range(8):
        if not 0 <= x + dx < 8:
            live &= ~COLUMN[x]
    out, by = mask.bitwiseAND(const(live & ALL)), 8 * dy + dx
    return F.shiftleft(out, by) if by > 0 else F.shiftrightunsigned(out, -by) if by < 0 else out


def dilate(mask: Column) -> Column:
    """Each pixel and its four neighbours."""
    out = mask
    for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        out = out.bitwiseOR(shift(mask, dy, dx))
    return out


def _swap(mask: Column, by: int, keep: int) -> Column:
    """Exchanges two halves that are ``by`` bits apart; ``keep`` marks the lower ones."""
    low = F.shiftleft(mask.bitwiseAND(const(keep)), by)
    return low.bitwiseOR(F.shiftrightunsigned(mask, by).bitwiseAND(const(keep)))


def flip_rows(mask: Column) -> Column:
    """Top to bottom."""
    out = _swap(mask, 8, 0x00FF00FF00FF00FF)
    out = _swap(out, 16, 0x0000FFFF0000FFFF)
    return _swap(out, 32, 0x00000000FFFFFFFF)


def flip_columns(mask: Column) -> Column:
    """Left to right."""
    out = _swap(mask, 1, 0x5555555555555555)
    out = _swap(out, 2, 0x3333333333333333)
    return _swap(out, 4, 0x0F0F0F0F0F0F0F0F)


def transpose(mask: Column) -> Column:
    out = mask
    for by, keep in ((28, 0x00000000F0F0F0F0), (14, 0x0000CCCC0000CCCC), (7, 0x00AA00AA00AA00AA)):
        diff = out.bitwiseXOR(F.shiftrightunsigned(out, by)).bitwiseAND(const(keep))
        out = out.bitwiseXOR(diff).bitwiseXOR(F.shiftleft(diff, by))
    return out


def text(mask: Column) -> Column:
    """64 characters of 0 and 1 in reading order."""
    return F.reverse(F.lpad(F.bin(mask), 64, "0"))


def orbit(grid: Column, mirrored: bool = False) -> list[Column]:
    """The four quarter turns of a text of 64 pixels, and their mirror images: one permutation each, so no tree of masks grows."""
    place = [(y, x) for y in range(8) for x in range(8)]
    out = []
    for flip in (False, True)[: 1 + mirrored]:
        now = {(y, x): (y, 7 - x if flip else x) for y, x in place}
        for _ in range(4):
            out.append(F.concat(*[F.substring(grid, 8 * now[p][0] + now[p][1] + 1, 1) for p in place]))
            now = {(7 - x, y): now[y, x] for y, x in place}
    return out


def iou(a: Column, b: Column) -> Column:
    union = F.bit_count(a.bitwiseOR(b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.bit_count(a.bitwiseAND(b)) / union)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)
