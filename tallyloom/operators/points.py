"""Filters and reports over point tables ``(id, x, y, z, r, g, b, opacity)``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..session import materialise
from .components import connected_components

AXES = ("x", "y", "z")


def _cols(names=AXES) -> dict[str, Column]:
    return {a: F.col(a).cast("double") for a in names}


def _box(low: dict[str, float], high: dict[str, float]) -> Column:
    out = F.lit(True)
    for a in low:
        out = out & (F.col(a).cast("double") >= low[a]) & (F.col(a).cast("double") <= high[a])
    return out


def _finite(names) -> Column:
    out = F.lit(True)
    for n in names:
        c = F.col(n).cast("double")
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return out


def _all(points: DataFrame, reason: str, **extra) -> tuple[DataFrame, dict]:
    return points.withColumn("keep", F.lit(True)), {"applied": False, "reason": reason, **extra}


def spatial_core_filter(
    points: DataFrame, core_quantile: float = 0.82, padding_ratio: float = 0.42, min_opacity_quantile: float = 0.35, min_keep: int = 1000
) -> tuple[DataFrame, dict]:
    """Mark the dense spatial core in ``keep``; keep everything, with a reason, when too little is left."""
    if points.isEmpty():
        return _all(points, "empty")
    finite = points.filter(_finite([*AXES, "opacity"]))
    n = finite.count()
    if n < min_keep:
        return _all(points, "too_few_finite_points", finite_points=n)
    cut = exact_quantiles(finite, _cols(["opacity"]), [min_opacity_quantile])["opacity"][0]
    anchors = finite.filter(F.col("opacity").cast("double") >= cut)
    n_anchors = anchors.count()
    if n_anchors < min_keep:
        anchors, n_anchors = finite, n
    centre = {a: v[0] for a, v in exact_quantiles(anchors, _cols(), [0.5]).items()}
    squares = [F.pow(F.col(a).cast("double") - centre[a], 2) for a in AXES]
    dist = F.sqrt(squares[0] + squares[1] + squares[2])
    radius = exact_quantiles(anchors, {"d": dist}, [min(max(core_quantile, 0.5), 0.88)])["d"][0]
    core = anchors.filter(dist <= max(radius, 1e-6))
    n_core = core.count()
    if n_core < min_keep:
        return _all(points, "too_few_core_points", core_points=n_core)
    box = exact_quantiles(core, _cols(), [0.01, 0.99])
    pad = {a: max(hi - lo, 1e-6) * padding_ratio for a, (lo, hi) in box.items()}
    low, high = {a: box[a][0] - pad[a] for a in AXES}, {a: box[a][1] + pad[a] for a in AXES}
    marked = points.withColumn("keep", F.coalesce(_finite([*AXES, "opacity"]) & _box(low, high), F.lit(False)))
    kept = marked.filter("keep").count()
    if kept < min_keep:
        return _all(points, "too_few_foreground_points", kept_points=kept)
    return marked, {
        "applied": True, "anchor_points": n_anchors, "core_points": n_core, "kept_points": kept,
        "opacity_threshold": cut, "center": centre, "bounds_min": low, "bounds_max": high,
    }


CELL = ["cx", "cy", "cz"]


def _near_cells(df: DataFrame, keep: list[str]) -> DataFrame:
    """Each row once per cell within two steps per axis, as (nx, ny, nz)."""
    for a in AXES:
        near = F.sequence(F.col(f"c{a}") - 2, F.col(f"c{a}") + 2)
        df = df.select(*keep, *[c for c in ("nx", "ny", "nz") if c in df.columns], F.explode(near).alias(f"n{a}"))
    return df


FEW = 1024  # point pairs of two cells that are compared one by one


def _nested(level: int) -> list[Column]:
    """The cell's part a point lies in when every side is halved ``level`` times; exact, as the factor is a power of 2."""
    return [F.floor(F.col(f"q{a}") * float(1 << level)).alias(f"k{a}") for a in AXES]


PART = ["kx", "ky", "kz"]


def _placed(points: DataFrame, side: float, keep: list[str]) -> DataFrame:
    """Points with their cell ``root`` and their place in units of its side."""
    q = [(F.col(a).cast("double") / side).alias(f"q{a}") for a in AXES]
    return points.select(*keep, *[F.col(a).cast("double").alias(a) for a in AXES], *q).withColumn("root", F.struct(*[F.floor(f"q{a}").alias(f"c{a}") for a in AXES]))


def _boxes(placed: DataFrame, level: int) -> DataFrame:
    """``(root, part, n, lo, hi)``: number and bounding box of the points of each part."""
    grouped = placed.groupBy("root", F.struct(*_nested(level)).alias("part"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.struct(*[F.min(a).alias(a) for a in AXES]).alias("lo"), F.struct(*[F.max(a).alias(a) for a in AXES]).alias("hi"))


def _norm(parts: list[Column]) -> Column:
    return F.sqrt(F.pow(parts[0], 2) + F.pow(parts[1], 2) + F.pow(parts[2], 2))


def _bounds() -> tuple[Column, Column]:
    """The least and greatest distance that points of boxes a and b can have, rounded like distances of points."""
    gap = [F.greatest(F.col(f"lo_b.{x}") - F.col(f"hi_a.{x}"), F.col(f"lo_a.{x}") - F.col(f"hi_b.{x}"), F.lit(0.0)) for x in AXES]
    far = [F.greatest(F.col(f"hi_b.{x}") - F.col(f"lo_a.{x}"), F.col(f"hi_a.{x}") - F.col(f"lo_b.{x}")) for x in AXES]
    return _norm(gap), _norm(far)


def near_parts(pairs: DataFrame, left: DataFrame, right: DataFrame, radius: float, each: bool) -> DataFrame:
    """Which cells, or with ``each`` which left points, have points at most ``radius`` apart.

    ``pairs`` are ``(root_a, root_b)`` cells of the ``_placed`` points of both
    sides.  Gives ``(root_a, root_b)`` or the left points' ``(id)``.  Both cells are halved together: a pair of parts whose boxes are
    too far apart is dropped, one whose boxes lie within the radius is done, and
    only the others are halved again, down to FEW pairs of points.  So two full
    cells are decided by the parts along their border.
    """
    out, level = None, 0
    frontier = pairs.distinct().select("root_a", "root_b", F.lit(None).cast("struct<kx:bigint,ky:bigint,kz:bigint>").alias("up_a"), F.lit(None).cast("struct<kx:bigint,ky:bigint,kz:bigint>").alias("up_b"))
    while True:
        sided = frontier
        for side, points in (("a", left), ("b", right)):
            used = points.join(frontier.select(F.col(f"root_{side}").alias("root")).distinct(), "root", "left_semi")
            box = _boxes(used, level).select(F.col("root").alias(f"root_{side}"), F.col("part").alias(f"part_{side}"), F.col("n").alias(f"n_{side}"), F.col("lo").alias(f"lo_{side}"), F.col("hi").alias(f"hi_{side}"))
            if level:
                halved = F.struct(*[F.floor(F.col(f"part_{side}.{k}") / 2).alias(k) for k in PART])
                sided = sided.join(box.withColumn(f"up_{side}", halved), [f"root_{side}", f"up_{side}"])
            else:
                sided = sided.join(box, f"root_{side}")
        least, most = _bounds()
        # boxes of no extent have equal bounds, so every pair is decided at last
        tested = sided.withColumn("least", least).filter(F.col("least") <= radius)
        tested = materialise(tested.select("root_a", "root_b", "part_a", "part_b", "n_a", "n_b", (most <= radius).alias("within")), f"parts{level}")
        hit = tested.filter("within")
        if each:
            hit = hit.select("root_a", "part_a").distinct()
            found = left.withColumn("part_a", F.struct(*_nested(level))).join(hit.withColumnRenamed("root_a", "root"), ["root", "part_a"], "left_semi").select("id")
            rest = tested.join(hit, ["root_a", "part_a"], "left_anti")
        else:
            found = hit.select("root_a", "root_b").distinct()
            rest = tested.join(found, ["root_a", "root_b"], "left_anti")
        small = F.col("n_a") * F.col("n_b") <= FEW
        points_of = lambda t, side: t.select(F.col("root").alias(f"root_{side}"), F.struct(*_nested(level)).alias(f"part_{side}"), F.struct(*AXES).alias(f"p_{side}"), *(["id"] if each and side == "a" else []))
        last = rest.filter(small).join(points_of(left, "a"), ["root_a", "part_a"]).join(points_of(right, "b"), ["root_b", "part_b"])
        apart = _norm([F.col(f"p_a.{x}") - F.col(f"p_b.{x}") for x in AXES])
        found = found.unionByName(last.filter(apart <= radius).select(*(["id"] if each else ["root_a", "root_b"])).distinct())
        if tested.filter(~F.col("within") & ~small).isEmpty():
            return (found if out is None else out.unionByName(found)).distinct()
        found = materialise(found, "found")
        out = found if out is None else out.unionByName(found)
        rest = rest.filter(~small)
        if not each:
            rest = rest.join(found, ["root_a", "root_b"], "left_anti")
        frontier = materialise(rest.select("root_a", "root_b", F.col("part_a").alias("up_a"), F.col("part_b").alias("up_b")), "frontier")
        level += 1


def radius_components(points: DataFrame, radius: float) -> DataFrame:
    """``(id, component)``: points linked whenever two are at most ``radius`` apart.

    With cells of side radius / sqrt(3) all points of one cell belong together,
    so the graph is one of cells.  Two near cells are first tested with the
    outermost points of each (a fixed number per cell); only cell pairs that this
    leaves in different components are halved on, see ``near_parts``.
    """
    side = radius / math.sqrt(3.0) * (1 - 1e-12)
    named = materialise(_placed(points, side, ["id"]), "cells")
    directions = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]
    dots = [sum((F.col(a) * float(s) for a, s in zip(AXES, d)), F.lit(0.0)) for d in directions]
    point = F.struct(*AXES)
    outer = named.groupBy("root").agg(F.array_distinct(F.array(*[f(point, dot) for dot in dots for f in (F.min_by, F.max_by)])).alias("ps"))
    outer = materialise(outer.select("root", "root.*", "ps"), "outer")
    far = _near_cells(outer, ["root", *CELL, "ps"]).filter("not (cx = nx and cy = ny and cz = nz)")
    other = outer.select(F.col("root").alias("root_b"), F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("cz").alias("nz"), F.col("ps").alias("ps2"))
    near = far.select(F.col("root").alias("root_a"), "ps", "nx", "ny", "nz").join(other, ["nx", "ny", "nz"]).filter("root_a < root_b")
    close = F.exists("ps", lambda p: F.exists("ps2", lambda q: _norm([p[x] - q[x] for x in AXES]) <= radius))
    near = materialise(near.select("root_a", "root_b", close.alias("linked")), "near")
    links = near.filter("linked").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    comps = connected_components(links)
    tag = lambda c: comps.select(F.col("id").alias(c), F.col("component").alias("of_" + c))
    unsure = (
        near.filter("not linked").join(tag("root_a"), "root_a", "left").join(tag("root_b"), "root_b", "left")
        .filter("coalesce(of_root_a, root_a) <> coalesce(of_root_b, root_b)").select("root_a", "root_b")
    )
    more = near_parts(unsure, named, named, radius, each=False)
    final = connected_components(links.unionByName(more.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))))
    joined = named.select("id", "root").join(final.select(F.col("id").alias("root"), "component"), "root", "left")
    cell_of = joined.select("id", F.coalesce("component", "root").alias("k"))
    least = cell_of.groupBy("k").agg(F.min("id").alias("component"))
    return cell_of.join(least, "k").select("id", "component")


def color_anchor_filter(
    points: DataFrame, mad_multiplier: float = 4.0, padding_ratio: float = 0.30, min_anchors: int = 100, min_keep: int = 1000,
    link_ratio: float = 0.014, distance_ratio: float = 0.0025,
) -> tuple[DataFrame, dict]:
    """Mark the object around the largest cluster of saturated green points in ``keep``."""
    if points.isEmpty():
        return _all(points, "empty")
    r, g, b, o = (F.col(c).cast("double") for c in ("r", "g", "b", "opacity"))
    # fixed values: the colour rule of an anchor
    rule = (g > 0.18) & (g > r * 1.10) & (g > b * 1.04) & (F.greatest(r, g, b) - F.least(r, g, b) > 0.10) & (o > 0.25)
    anchors = materialise(points.filter(rule), "anchors")
    n_anchors = anchors.count()
    if n_anchors < min_anchors:
        return _all(points, "too_few_anchor_points", anchor_points=n_anchors)
    span = {a: hi - lo for a, (lo, hi) in exact_quantiles(points, _cols(), [0.01, 0.99]).items()}
    diagonal = max(math.sqrt(sum(v * v for v in span.values())), 1e-6)
    comps = materialise(radius_components(anchors, diagonal * link_ratio), "comps")
    top = comps.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").first()
    core = anchors.join(comps.filter(F.col("component") == top["component"]).select("id"), "id", "left_semi")
    n_core = top["n"]
    if n_core < min_anchors:
        med = {a: v[0] for a, v in exact_quantiles(anchors, _cols(), [0.5]).items()}
        mad = exact_quantiles(anchors, {a: F.abs(F.col(a).cast("double") - med[a]) for a in AXES}, [0.5])
        reach = {a: mad_multiplier * max(mad[a][0], span[a] * 0.002, 1e-4) for a in AXES}
        core = anchors.filter(_box({a: med[a] - reach[a] for a in AXES}, {a: med[a] + reach[a] for a in AXES}))
        n_core = core.count()
    core = materialise(core.select("id", *AXES), "core")
    box = exact_quantiles(core, _cols(), [0.01, 0.99])
    pad = {a: (hi - lo) * padding_ratio + span[a] * 0.002 for a, (lo, hi) in box.items()}
    low, high = {a: box[a][0] - pad[a] for a in AXES}, {a: box[a][1] + pad[a] for a in AXES}
    radius = diagonal * distance_ratio
    side = radius / math.sqrt(3.0) * (1 - 1e-12)
    inside = materialise(_placed(points.filter(_box(low, high)), side, ["id"]), "inside")
    cores = materialise(_placed(core, side, []), "cores")
    filled = cores.select("root").distinct()
    same = inside.join(filled, "root", "left_semi").select("id")  # a core point in the same cell is near enough
    open_points = materialise(inside.join(filled, "root", "left_anti"), "open")
    around = _near_cells(open_points.select("root").distinct().select("root", "root.*"), ["root", *CELL])
    around = around.select(F.col("root").alias("root_a"), F.struct(*[F.col(f"n{a}").alias(f"c{a}") for a in AXES]).alias("root_b"))
    pairs = around.join(filled.withColumnRenamed("root", "root_b"), "root_b", "left_semi")
    near = near_parts(pairs, open_points, cores, radius, each=True)
    keep_ids = materialise(same.unionByName(near).distinct().withColumn("__k", F.lit(True)), "keep")
    kept = keep_ids.count()
    if kept < min_keep:
        return _all(points, "too_few_foreground_points", kept_points=kept)
    marked = points.join(keep_ids, "id", "left").withColumn("keep", F.coalesce("__k", F.lit(False))).drop("__k")
    return marked, {
        "applied": True, "anchor_points": n_anchors, "core_points": n_core, "kept_points": kept, "scene_diagonal": diagonal,
        "foreground_radius": radius, "bounds_min": low, "bounds_max": high,
    }


def dampen_luminance(points: DataFrame, quantile: float = 0.86, target: float = 0.74, blend: float = 0.75, max_channel: float | None = None) -> tuple[DataFrame, dict]:
    """Blend over-bright colours down to the target luminance."""
    if points.isEmpty():
        return points, {"applied": False, "reason": "empty"}
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    lum = r * 0.2126 + g * 0.7152 + b * 0.0722
    ok = _finite("rgb")
    threshold = exact_quantiles(points.filter(ok), {"l": lum}, [min(max(quantile, 0.0), 1.0)])["l"][0]
    if math.isnan(threshold):
        return points, {"applied": False, "reason": "no_finite_colors"}
    high = ok & (lum >= threshold) & (lum > target)
    count = points.filter(high).count()
    if count == 0:
        return points, {"applied": False, "reason": "no_high_luminance_colors", "threshold": threshold}
    amount = min(max(blend, 0.0), 1.0)
    scale = F.least(F.lit(1.0), F.lit(target) / F.greatest(lum, F.lit(1e-6)))

    def damp(c: Column) -> Column:
        v = c * scale * amount + c * (1.0 - amount)
        v = F.least(v, F.lit(max_channel)) if max_channel is not None else v
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(high, v).otherwise(c)))

    out = points.select(*[damp(F.col(c).cast("double")).alias(c) if c in "rgb" else F.col(c) for c in points.columns])
    return out, {"applied": True, "threshold": threshold, "damped_points": count}


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def attach_masks(frames: DataFrame, masks: DataFrame, frame_path: str, mask_path: str) -> DataFrame:
    """Add the mask with the same file stem to every frame; a frame without one is an error."""
    m = masks.select(file_stem(F.col(mask_path)).alias("__stem"), F.col(mask_path).alias("mask"))
    joined = frames.withColumn("__stem", file_stem(F.col(frame_path))).join(m, "__stem", "left")
    missing = F.raise_error(F.concat(F.lit("no mask for "), F.col(frame_path))).cast("string")
    return joined.withColumn("mask", F.coalesce("mask", missing)).drop("__stem")


def registration_report(frames: DataFrame, registered: Column, occupancy: Column, index: str, min_ratio: float, low: float, high: float) -> DataFrame:
    """One row of counts, occupancy range, failures and the passed flag.

    The invalid indices are a table of their own, see :func:`invalid_masks`.
    """
    bad = (occupancy < low) | (occupancy > high)
    r = frames.agg(
        F.count(F.lit(1)).alias("extracted"), F.count_if(registered).alias("registered"), F.count(occupancy).alias("masked"),
        F.coalesce(F.min(occupancy), F.lit(0.0)).alias("occupancy_min"), F.coalesce(F.max(occupancy), F.lit(0.0)).alias("occupancy_max"),
        F.coalesce(F.avg(occupancy), F.lit(0.0)).alias("occupancy_mean"), F.count_if(bad).alias("invalid"),
    ).withColumn("ratio", F.col("registered") / F.greatest("extracted", F.lit(1)))
    failures = F.array_compact(F.array(
        F.when(F.col("ratio") < min_ratio, "registration_ratio"),
        F.when((F.col("registered") == 0) | (F.col("masked") != F.col("registered")), "mask_count"),
        F.when(F.col("invalid") > 0, "mask_occupancy"),
    ))
    return r.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def invalid_masks(frames: DataFrame, occupancy: Column, index: str, low: float, high: float) -> DataFrame:
    return frames.filter((occupancy < low) | (occupancy > high)).select(index)
