"""Boxes, lines and zones as column expressions. A box is (x1, y1, x2, y2); a polygon is an array of [x, y]."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .plates import let

Box = tuple[Column, Column, Column, Column]
# Shares of a box in a zone, of a zone under a box, and of a box whose centre is in a zone.
ZONE_SHARES = (0.25, 0.30, 0.20)


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{n}") for n in ("x1", "y1", "x2", "y2"))


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    wide = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    high = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return wide * high


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def coverage(inner: Box, outer: Box) -> Column:
    """Share of the inner box that the outer one covers; 0 for an empty box."""
    own = area(inner)
    return F.when(own > 0, intersection(inner, outer) / own).otherwise(0.0)


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def bottom_center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, b[3]


def expand(b: Box, share: float, width: float, height: float) -> Box:
    """The box grown by a share of its size on every side, inside the frame."""
    dx, dy = (b[2] - b[0]) * share, (b[3] - b[1]) * share
    return F.greatest(b[0] - dx, F.lit(0.0)), F.greatest(b[1] - dy, F.lit(0.0)), F.least(b[2] + dx, F.lit(width)), F.least(b[3] + dy, F.lit(height))


def contains(b: Box, x: Column, y: Column) -> Column:
    return x.between(b[0], b[2]) & y.between(b[1], b[3])


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) ** 2 + (ay - by) ** 2)


def side_of_line(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """1 or -1 for the sides of the line from a to b, 0 on it."""
    cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    return F.signum(cross).cast("int")


def shoelace(polygon: Column) -> Column:
    """Area of a polygon."""
    turned = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    crosses = F.zip_with(polygon, turned, lambda a, b: F.get(a, F.lit(0)) * F.get(b, F.lit(1)) - F.get(b, F.lit(0)) * F.get(a, F.lit(1)))
    return F.abs(F.aggregate(crosses, F.lit(0.0), lambda s, x: s + x)) / 2


def in_polygon(polygon: Column, x: Column, y: Column) -> Column:
    """Whether an odd number of edges lies right of the point."""
    turned = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))

    def crosses(a: Column, b: Column) -> Column:
        ax, ay, bx, by = F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(b, F.lit(0)), F.get(b, F.lit(1))
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)

    return F.size(F.filter(F.zip_with(polygon, turned, crosses), lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def polygon_problem(polygon: Column) -> Column:
    """Why a normalised polygon is refused: too few points, out of range, crossing or touching itself, or too small; null if it is
    fine. A point that is given twice in a row is one point."""
    points = F.filter(polygon, lambda p, i: p != F.get(polygon, (i + F.size(polygon) - 1) % F.size(polygon)))
    n = F.size(points)
    turned = F.concat(F.slice(points, 2, n), F.slice(points, 1, 1))
    edges = F.zip_with(points, turned, lambda a, b: F.concat(a, b))
    out = F.exists(polygon, lambda p: (F.size(p) != 2) | F.exists(p, lambda v: (v < 0) | (v > 1)))

    def orientation(ax, ay, bx, by, cx, cy):
        return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))

    def cross(e: Column, f: Column) -> Column:
        """Whether two edges meet anywhere but where one follows the other."""
        g = lambda s, i: F.get(s, F.lit(i))
        o = [orientation(g(a, 0), g(a, 1), g(a, 2), g(a, 3), g(b, i), g(b, i + 1)) for a, b, i in ((e, f, 0), (e, f, 2), (f, e, 0), (f, e, 2))]
        ends = ((e, f, 0), (e, f, 2), (f, e, 0), (f, e, 2))
        within = lambda a, b, i: F.reduce(F.array(*[g(b, i + k).between(F.least(g(a, k), g(a, k + 2)), F.greatest(g(a, k), g(a, k + 2))) for k in (0, 1)]), F.lit(True), lambda s, x: s & x)
        touch = reduce(lambda s, x: s | x, [(o[n] == 0) & within(*end) for n, end in enumerate(ends)])
        return ((o[0] * o[1] < 0) & (o[2] * o[3] < 0)) | touch

    def follows(i: Column, j: Column, e: Column, f: Column) -> Column:
        """Whether edge j comes right after i and does not turn back on it."""
        g = lambda s, k: F.get(s, F.lit(k))
        back = (orientation(g(e, 0), g(e, 1), g(e, 2), g(e, 3), g(f, 2), g(f, 3)) == 0) & ((g(e, 2) - g(e, 0)) * (g(f, 2) - g(f, 0)) + (g(e, 3) - g(e, 1)) * (g(f, 3) - g(f, 1)) < 0)
        return ((i + 1) % n == j) & ~back

    numbered = F.transform(edges, lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    apart = lambda a, b: (a["i"] < b["i"]) & ~follows(a["i"], b["i"], a["e"], b["e"]) & ~follows(b["i"], a["i"], b["e"], a["e"])
    crossing = F.exists(numbered, lambda a: F.exists(numbered, lambda b: apart(a, b) & cross(a["e"], b["e"])))
    return F.when(F.size(polygon) < 3, "too few points").when(out, "out of range").when((n < 3) | crossing, "crosses itself").when(shoelace(polygon) < 0.01, "too small")


def clipped(polygon: Column, b: Box) -> Column:
    """The part of a polygon inside a box (Sutherland-Hodgman, a side of the box at a time). Of a polygon with a dent, parts may be joined
    by edges along the box's side, which leaves the area right."""

    def side(polygon: Column, axis: int, limit: Column, above: bool) -> Column:
        turned = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))

        def kept(p: Column, q: Column) -> Column:
            pa, qa, po, qo = (F.get(v, F.lit(i)) for i in (axis, 1 - axis) for v in (p, q))
            inside, next_in = (pa >= limit, qa >= limit) if above else (pa <= limit, qa <= limit)
            met = po + (limit - pa) / F.nullif(qa - pa, F.lit(0.0)) * (qo - po)
            cut = F.array(limit, met) if axis == 0 else F.array(met, limit)
            return F.concat(F.when(inside, F.array(p)).otherwise(F.array().cast("array<array<double>>")), F.when(inside != next_in, F.array(cut)).otherwise(F.array().cast("array<array<double>>")))

        return F.flatten(F.zip_with(polygon, turned, kept))

    cuts = [(0, b[0], True), (0, b[2], False), (1, b[1], True), (1, b[3], False)]
    step = lambda out, cut: let(out, lambda p: side(p, *cut))
    return reduce(step, cuts, polygon)


def clip_area(b: Box, zone: Column) -> Column:
    """Area of a zone inside a box."""
    return let(clipped(zone, b), lambda p: F.when(F.size(p) < 3, 0.0).otherwise(shoelace(p)))


def clip_share(b: Box, zone: Column) -> Column:
    """Share of a box inside a zone."""
    return F.coalesce(clip_area(b, zone) / F.nullif(area(b), F.lit(0.0)), F.lit(0.0))


def in_zone(b: Box, zone: Column) -> Column:
    """Whether a box counts as inside a zone: by its own share, by the share of the zone that it covers, or by less of itself if its centre
    or the middle of its lower side is inside. A zone of less than three points holds everything, a box without area is in none."""
    (x, y), (bx, by) = center(b), bottom_center(b)
    size = F.coalesce(F.size(zone), F.lit(0))

    def judged(inside: Column) -> Column:
        own, zones = inside / F.nullif(area(b), F.lit(0.0)), inside / F.nullif(shoelace(zone), F.lit(0.0))
        middle = (in_polygon(zone, x, y) | in_polygon(zone, bx, by)) & (own >= ZONE_SHARES[2])
        return F.coalesce((own >= ZONE_SHARES[0]) | (zones >= ZONE_SHARES[1]) | middle, F.lit(False))

    return F.when(size < 3, True).otherwise(let(clip_area(b, zone), judged))


def zone_of(b: Box, near: Column, mid: Column) -> Column:
    """NEAR, MID or FAR of a box and two zones, in the same units; a null zone is passed over."""
    return F.when(near.isNotNull() & in_zone(b, near), "NEAR").when(mid.isNotNull() & in_zone(b, mid), "MID").otherwise("FAR")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in hex; 999 if one is missing or no hash."""
    number = lambda h: F.conv(h, 16, -10).cast("long")
    good = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    return F.when(F.coalesce(good, F.lit(False)), F.bit_count(number(a).bitwiseXOR(number(b)))).otherwise(999)


def pixel_quality(width: Column, height: Column, sharpness: Column, contrast: Column) -> Column:
    """Quality of a crop by its size in pixels, the variance of its Laplacian and its spread of grey levels; 0 for a tiny or missing one."""
    aspect = width / F.greatest(height, F.lit(1.0))
    quality = crop_quality(sharpness / 180, width * height / (192 * 64), contrast / 40, F.when(aspect.between(1.8, 4.8), 1.0).otherwise(0.75))
    return F.when((height >= 6) & (width >= 12), quality).otherwise(0.0)


def reread_quality(width: Column, height: Column, sharpness: Column) -> Column:
    """Quality of a crop that is read again later: size first, then focus; 0.5 where it isn't known."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.coalesce(unit(0.55 * unit(width * height / (192 * 64)) + 0.45 * unit(sharpness / 150)), F.lit(0.5))


def focus_score(b: Box, confidence: Column, vehicle: Column, width: float, height: float, focus: tuple[float, float]) -> Column:
    """How much a box deserves the focus: confidence, size against 12 % of the frame, nearness to the focus, and a bonus for vehicles."""
    x, y = center(b)
    size = F.least(F.lit(1.0), area(b) / (width * height) / 0.12)
    near = F.greatest(F.lit(0.0), 1.0 - distance(x, y, F.lit(focus[0]), F.lit(focus[1])) / (width**2 + height**2) ** 0.5)
    return F.coalesce(confidence, F.lit(0.0)) * 0.40 + size * 0.35 + near * 0.17 + F.when(vehicle, 0.08).otherwise(0.0)


def crop_quality(focus: Column, resolution: Column, contrast: Column, aspect: Column) -> Column:
    """Weighted quality of a crop from scores between 0 and 1."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    return 0.45 * unit(focus) + 0.30 * unit(resolution) + 0.15 * unit(contrast) + 0.10 * unit(aspect)


def event_score(ocr: Column, consensus: Column, quality: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return 0.45 * zero(ocr) + 0.30 * zero(consensus) + 0.25 * zero(quality)
