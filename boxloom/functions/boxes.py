"""Box geometry as Column expressions. Boxes are xywh in float pixels; no UDFs, so all of it stays in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def num(v: float) -> Column:
    """A DOUBLE literal; untyped SQL decimals would change thresholds."""
    return F.lit(float(v))


def corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column, clamp: bool = True) -> Column:
    w, h = x2 - x1, y2 - y1
    if clamp:
        w, h = F.greatest(num(0), w), F.greatest(num(0), h)
    return F.struct(x1.alias("x"), y1.alias("y"), w.alias("w"), h.alias("h"))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two xywh boxes; 0 where the union is empty."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    ax2, ay2, bx2, by2 = ax + aw, ay + ah, bx + bw, by + bh
    iw = F.greatest(num(0), F.least(ax2, bx2) - F.greatest(ax, bx))
    ih = F.greatest(num(0), F.least(ay2, by2) - F.greatest(ay, by))
    inter = iw * ih
    area = lambda x, y, x2, y2: F.greatest(num(0), x2 - x) * F.greatest(num(0), y2 - y)
    union = area(ax, ay, ax2, ay2) + area(bx, by, bx2, by2) - inter
    return F.when(union > 0, inter / union).otherwise(num(0))


def relative_area(w: Column, h: Column, width: Column, height: Column) -> Column:
    whole = (width * height).cast("double")
    return F.when(whole > 0, F.greatest(w, num(0)) * F.greatest(h, num(0)) / whole).otherwise(num(0))


def size_bin(rel: Column, small_max: float = 0.01, medium_max: float = 0.05) -> Column:
    return F.when(rel < num(small_max), "small").when(rel < num(medium_max), "medium").otherwise("large")


def clip(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Both corners moved into the image; the width or height may come out as zero or less."""
    cl = lambda v, top: F.least(F.greatest(v, num(0)), top.cast("double"))
    x1, y1, x2, y2 = cl(x, width), cl(y, height), cl(x + w, width), cl(y + h, height)
    return F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))


def out_of_bounds(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return (x < 0) | (y < 0) | (x + w > width) | (y + h > height)


def intersection(box: tuple[Column, ...], window: tuple[Column, ...]) -> Column:
    """The common part as xywh, null where the two only touch or lie apart."""
    (x, y, w, h), (wx, wy, ww, wh) = box, window
    x1, y1 = F.greatest(x, wx), F.greatest(y, wy)
    x2, y2 = F.least(x + w, wx + ww), F.least(y + h, wy + wh)
    part = F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))
    return F.when((x2 > x1) & (y2 > y1), part)


def visible_fraction(part: Column, w: Column, h: Column) -> Column:
    return part["w"] * part["h"] / F.greatest(num(1e-9), w * h)


def flip_x(x: Column, w: Column, width: Column) -> tuple[Column, Column]:
    """x1 and x2 after mirroring the image left to right."""
    return width - (x + w), width - x


def yolo(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, ...]:
    return (x + w / 2) / width, (y + h / 2) / height, w / width, h / height


def fixed8(v: Column) -> Column:
    """Eight decimals, rounded by the exact binary value and halves of it to even.

    The product with 1e8 is taken with its rounding error (the factor has 27 bits, so splitting the value is enough);
    formatting functions round the shortest decimal form instead, which goes the other way at what only looks like a
    half. From 2**25 on, where no digit is lost, the plain form is used.
    """
    a = F.abs(v)
    c = a * num(134217729)
    high = c - (c - a)
    p = a * num(1e8)
    error = (high * num(1e8) - p) + (a - high) * num(1e8)
    k = F.floor(p)
    over = (p - k - num(0.5)) + error
    n = k + F.when((over > 0) | ((over == 0) & (k % 2 == 1)), 1).otherwise(0)
    text = F.concat(((n - n % 100_000_000) / 100_000_000).cast("bigint").cast("string"), F.lit("."), F.lpad((n % 100_000_000).cast("string"), 8, "0"))
    sign = F.when(v < 0, "-").otherwise("")
    return F.when(a < num(2**25), F.concat(sign, text)).otherwise(F.format_string("%.8f", v))


def valid_box(bbox: Column) -> Column:
    """Four finite numbers with positive extent; false (never null) otherwise."""
    # size() is read first; element access past the end gives null
    parts = [F.get(bbox, F.lit(i)) for i in range(4)]
    fine = [p.isNotNull() & ~F.isnan(p) & (F.abs(p) < num(float("inf"))) for p in parts]
    ok = (F.size(bbox) == 4) & fine[0] & fine[1] & fine[2] & fine[3] & (parts[2] > 0) & (parts[3] > 0)
    return F.coalesce(ok, F.lit(False))
