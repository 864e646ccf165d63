"""Boxes, easing and colour as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two half-open intervals share, never negative."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def box_overlap(a: Column, b: Column) -> Column:
    return overlap(a["x0"], a["x1"], b["x0"], b["x1"]) * overlap(a["y0"], a["y1"], b["y0"], b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area; 0 where both are empty."""
    shared = box_overlap(a, b)
    joint = box_area(a) + box_area(b) - shared
    return F.when(joint > 0, shared / joint).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Shared area over the smaller area; 0 where that is empty."""
    smaller = F.least(box_area(a), box_area(b))
    return F.when(smaller > 0, box_overlap(a, b) / smaller).otherwise(0.0)


def spatial_relations(a: Column, b: Column, slack: float = 2.0) -> dict[str, Column]:
    """left, right, top, bottom with a slack in pixels, and intersect."""
    return {
        "left": a["x1"] <= b["x0"] + slack,
        "right": a["x0"] >= b["x1"] - slack,
        "top": a["y1"] <= b["y0"] + slack,
        "bottom": a["y0"] >= b["y1"] - slack,
        "intersect": box_overlap(a, b) > 0,
    }


def direction_word(dx: Column, dy: Column) -> Column:
    """right, left, down or up by the larger part; none where both are zero."""
    across = F.when(dx > 0, "right").otherwise("left")
    along = F.when(dy > 0, "down").otherwise("up")
    return F.when((dx == 0) & (dy == 0), "none").when(F.abs(dx) >= F.abs(dy), across).otherwise(along)


def _cubic(t: Column, p1: Column, p2: Column) -> Column:
    return 3 * (1 - t) * (1 - t) * t * p1 + 3 * (1 - t) * t * t * p2 + t * t * t


def bezier_ease(x: Column, x1: Column, y1: Column, x2: Column, y2: Column, steps: int = 40) -> Column:
    """y of a cubic-bezier easing at x, by halving the parameter's interval."""
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")),
        lambda s, _: F.struct(
            F.when(_cubic((s["lo"] + s["hi"]) / 2, x1, x2) < x, (s["lo"] + s["hi"]) / 2).otherwise(s["lo"]).alias("lo"),
            F.when(_cubic((s["lo"] + s["hi"]) / 2, x1, x2) < x, s["hi"]).otherwise((s["lo"] + s["hi"]) / 2).alias("hi"),
        ),
        lambda s: _cubic((s["lo"] + s["hi"]) / 2, y1, y2),
    )
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(found)


def affine_corners(x: Column, y: Column, sx: Column, sy: Column, degrees: Column, width: Column, height: Column) -> Column:
    """Corners of a centred box after scale, rotation and translation, as an array of structs."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))

    def corner(u: float, v: float) -> Column:
        px, py = sx * width * u, sy * height * v
        return F.struct((x + c * px - s * py).alias("x"), (y + s * px + c * py).alias("y"))

    return F.array(corner(-0.5, -0.5), corner(0.5, -0.5), corner(0.5, 0.5), corner(-0.5, 0.5))


def bounding_box(corners: Column) -> Column:
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def hex_to_channels(colour: Column) -> Column:
    """Red, green and blue of #rrggbb or #rgb; null for any other text."""
    short = F.regexp_replace(F.lower(colour), r"^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    return F.when(short.rlike("^#[0-9a-f]{6}$"), F.array(*[F.conv(F.substring(short, i, 2), 16, 10).cast("int") for i in (2, 4, 6)]))


def channels_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c.cast("int"))), 2, "0") for c in (r, g, b)])


# sRGB to XYZ under D65, and the white point.
_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
_WHITE = (0.95047, 1.0, 1.08883)


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """CIELAB of 8-bit sRGB channels."""

    def linear(v: Column) -> Column:
        u = v / 255.0
        return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))

    def cube(t: Column) -> Column:
        return F.when(t > 216 / 24389, F.pow(t, F.lit(1 / 3))).otherwise((24389 / 27 * t + 16) / 116)

    lin = [linear(v) for v in (r, g, b)]
    fx, fy, fz = (cube((m[0] * lin[0] + m[1] * lin[1] + m[2] * lin[2]) / w) for m, w in zip(_XYZ, _WHITE, strict=True))
    return [116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)]


def delta_e(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0)))
