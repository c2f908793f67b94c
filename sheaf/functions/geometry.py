"""Box geometry: a box is array<double> of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.values import let


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    return _share(both, area(a) + area(b) - both)


def overlap(a: Column, b: Column) -> Column:
    """The intersection over the smaller box."""
    return _share(intersection(a, b), F.least(area(a), area(b)))


def cover(a: Column, b: Column) -> Column:
    """The share of a that b covers."""
    return _share(intersection(a, b), area(a))


def union_box(a: Column, b: Column) -> Column:
    return F.array(F.floor(F.least(a[0], b[0])), F.floor(F.least(a[1], b[1])), F.ceil(F.greatest(a[2], b[2])), F.ceil(F.greatest(a[3], b[3])))


def is_legal(b: Column) -> Column:
    return (b[2] > b[0]) & (b[3] > b[1])


def centre_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow((a[0] + a[2] - b[0] - b[2]) / 2, 2) + F.pow((a[1] + a[3] - b[1] - b[3]) / 2, 2))


def reading_score(a: Column, b: Column, i: Column, j: Column) -> Column:
    return F.abs(i - j) * 85 + F.when(b[1] > a[3], 0).otherwise(30)


def position_score(a: Column, b: Column) -> Column:
    apart = F.abs((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)
    return apart * F.when(F.least(a[2], b[2]) - F.greatest(a[0], b[0]) > 0, 0.5).otherwise(1.5)


def caption_score(a: Column, b: Column, i: Column, j: Column) -> Column:
    """The lower, the likelier b captions a."""
    return reading_score(a, b, i, j) + position_score(a, b) + centre_distance(a, b) * 0.1


def is_close(a: Column, b: Column, most: float = 1.8) -> Column:
    """Near by centres, or side by side, or one above the other with little between."""
    wa, wb, ha, hb = a[2] - a[0], b[2] - b[0], a[3] - a[1], b[3] - b[1]
    x = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    y = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    below = F.greatest(F.lit(0.0), F.greatest(a[1], b[1]) - F.least(a[3], b[3]))
    beside = F.greatest(F.lit(0.0), F.greatest(a[0], b[0]) - F.least(a[2], b[2]))
    return (
        (centre_distance(a, b) <= (wa + wb + ha + hb) / 4 * most)
        | ((_share(x, F.least(wa, wb)) > 0.3) & (below < F.greatest(ha, hb)))
        | ((_share(y, F.least(ha, hb)) > 0.3) & (beside < F.greatest(wa, wb) * 0.5))
    )


def clipped(points: Column, width: int, height: int) -> Column:
    """The whole-number box around a polygon (x, y, x, y, ...) inside the page; null if nothing is left."""
    xs = F.filter(points, lambda _, k: k % 2 == 0)
    ys = F.filter(points, lambda _, k: k % 2 == 1)
    low = lambda v: F.greatest(F.floor(F.array_min(v)), F.lit(0))
    high = lambda v, most: F.least(F.ceil(F.array_max(v)), F.lit(most))
    box = F.array(low(xs), low(ys), high(xs, width), high(ys, height)).cast("array<double>")
    return F.when(is_legal(box), box)


def kept_boxes(boxes: Column, most: float = 0.9) -> Column:
    """Greedy suppression: by score, highest first, then index; a box stays if no kept box overlaps it by more than `most`.

    boxes: array<struct<score, index, bbox>>. Returns the kept ones by index.
    """
    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct((-b["score"]).alias("s"), b["index"].alias("index"), b["bbox"].alias("bbox"))))
    none = F.slice(ordered, F.lit(1), F.lit(0))
    step = lambda acc, b: F.when(F.exists(acc, lambda k: iou(k["bbox"], b["bbox"]) > most), acc).otherwise(F.array_append(acc, b))
    return F.array_sort(F.transform(F.aggregate(ordered, none, step), lambda b: b["index"]))


def resized(height: Column, width: Column, factor: int = 28, least: int = 3136, most: int = 11289600) -> Column:
    """Height and width as multiples of `factor` whose product keeps the bounds; null beyond an aspect of 200."""
    near = lambda v: F.greatest(F.lit(factor), F.bround(v / factor, 0) * factor)
    h, w = near(height), near(width)
    shrink, grow = F.sqrt(height * width / most), F.sqrt(least / (height * width))
    down = lambda v: F.greatest(F.lit(factor), F.floor(v / shrink / factor) * factor)
    up = lambda v: F.ceil(v * grow / factor) * factor
    pick = lambda v, n: F.when(h * w > most, down(v)).when(h * w < least, up(v)).otherwise(n).cast("long")
    fits = F.greatest(height, width) / F.least(height, width) <= 200
    return F.when(fits, F.struct(pick(height, h).alias("height"), pick(width, w).alias("width")))


def fits_resized(boxes: Column, resized_size: tuple[Column, Column], original_size: tuple[Column, Column]) -> Column:
    """Whether boxes (array<array<double>>) are of the resized page (width, height) and not of the original one.

    Of the legal boxes 0.7 must lie in the resized page, 2 % or 4 points aside, and their furthest edges must be no
    further from its scale than from the original's. No legal box, or a page without size, gives false.
    """
    (rw, rh), (ow, oh) = resized_size, original_size
    legal = F.filter(boxes, lambda b: F.coalesce((F.size(b) == 4) & is_legal(b), F.lit(False)))
    tx, ty = (F.greatest(F.lit(4), F.floor(v * 0.02)) for v in resized_size)
    inside = F.filter(legal, lambda b: (b[0] >= -tx) & (b[1] >= -ty) & (b[2] <= rw + tx) & (b[3] <= rh + ty))
    far = lambda k: F.array_max(F.transform(legal, lambda b: b[k]))
    off = lambda x, y: F.abs(far(2) / ow - x) + F.abs(far(3) / oh - y)
    sized = (F.least(rw, rh, ow, oh) > 0) & (F.size(legal) > 0)
    return F.coalesce(F.when(sized, (F.size(inside) >= F.size(legal) * 0.7) & (off(rw / ow, rh / oh) <= off(F.lit(1.0), F.lit(1.0)))), F.lit(False))


def rescaled_boxes(boxes: Column, resized_size: tuple[Column, Column], original_size: tuple[Column, Column]) -> Column:
    """Boxes (array<array<double>>) of a resized page (width, height) in whole numbers of the original one, inside it.

    They stay as they are if the pages have one scale or a page has no size, or if over 0.4 of them would leave the page
    by more than 2 % or 4 points; what isn't four numbers stays too. Halves go to even. Null gives null.
    """
    (rw, rh), (ow, oh) = resized_size, original_size
    scales = [F.try_divide(r, F.when(o > 0, o)) for r, o in zip(resized_size, original_size, strict=True)]
    sized = F.coalesce(F.least(rw, rh, ow, oh) > 0, F.lit(False))
    alike = (F.abs(scales[0] - 1) < 1e-3) & (F.abs(scales[1] - 1) < 1e-3)
    whole = lambda b: F.coalesce(F.size(b) == 4, F.lit(False)) & ~F.exists(b, lambda v: v.isNull())
    each = lambda of: lambda b: F.when(whole(b), of(b).cast("array<double>")).otherwise(b)
    scaled = F.transform(boxes, each(lambda b: F.array(*(F.bround(F.try_divide(b[k], F.when(scales[k % 2] > 0, scales[k % 2])), 0) for k in range(4)))))
    tx, ty = (F.greatest(F.lit(4), F.floor(v * 0.02)) for v in original_size)
    out = lambda b: whole(b) & ((b[2] > ow + tx) | (b[3] > oh + ty) | (b[0] < -tx) | (b[1] < -ty))
    clip = each(lambda b: F.array(*(F.greatest(F.lit(0.0), F.least(b[k], original_size[k % 2].cast("double"))) for k in range(4))))
    settled = let(scaled, lambda s: F.when(F.size(F.filter(s, out)) > F.size(s) * 0.4, boxes).otherwise(F.transform(s, clip)))
    return F.when(sized & ~alike, settled).otherwise(boxes)
