"""Metrics over pixel rows (image_id, y, x, b, g, r): aggregates that Spark spreads over all pixels.

One image may have any number of pixels: sums, extremes and histograms are
combined before the shuffle, so that at most 256 rows per image and channel meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour, scores

EPS = 1e-6


def grey() -> Column:
    return colour.grey(F.col("b"), F.col("g"), F.col("r"))


def colour_cast(pixels: DataFrame) -> DataFrame:
    """(image_id, channel means, dominances, ratio, severity, temperature, spread)."""
    means = pixels.groupBy("image_id").agg(F.avg("b").alias("blue_channel_mean"), F.avg("g").alias("green_channel_mean"), F.avg("r").alias("red_channel_mean"))
    names = ("blue_dominance", "green_dominance", "blue_green_ratio", "blue_water_severity", "color_temperature", "color_channel_std")
    for name in names:
        means = means.withColumn(name, scores.derived()[name])
    return means


def global_contrast(pixels: DataFrame) -> DataFrame:
    found = pixels.select("image_id", grey().alias("v")).groupBy("image_id").agg(F.stddev_pop("v").alias("s"), F.avg("v").alias("m"), F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    return found.select("image_id", (F.col("s") / (F.col("m") + EPS)).alias("rms_contrast"), ((F.col("hi") - F.col("lo")) / (F.col("hi") + F.col("lo") + EPS)).alias("michelson_contrast"))


def lab_columns() -> dict[str, Column]:
    return dict(zip(("lab_l", "lab_a", "lab_b"), colour.lab(F.col("b"), F.col("g"), F.col("r")), strict=True))


def lab_metrics(pixels: DataFrame) -> DataFrame:
    """(image_id, lab_contrast, uciqe_score)."""
    lab = pixels.withColumns(lab_columns())
    light = F.col("lab_l") / 255.0
    da, db = F.col("lab_a") / 255.0 - 128 / 255, F.col("lab_b") / 255.0 - 128 / 255
    rows = lab.select("image_id", "lab_l", light.alias("light"), F.sqrt(da * da + db * db).alias("chroma"))
    found = rows.groupBy("image_id").agg(
        (F.stddev_pop("lab_l") / (F.avg("lab_l") + EPS)).alias("lab_contrast"),
        (0.4680 * F.stddev_pop("chroma") + 0.2745 * F.stddev_pop("light") + 0.2576 * F.avg(F.col("chroma") / (F.col("light") + EPS))).alias("uciqe_score"),
    )
    return found


def uicm(pixels: DataFrame) -> DataFrame:
    rg, yb = F.col("r") - F.col("g"), (F.col("r") + F.col("g")) / 2 - F.col("b")
    found = pixels.select("image_id", rg.alias("rg"), yb.alias("yb")).groupBy("image_id").agg(F.avg("rg").alias("m1"), F.avg("yb").alias("m2"), F.var_pop("rg").alias("v1"), F.var_pop("yb").alias("v2"))
    return found.select("image_id", (-0.0268 * F.sqrt(F.col("m1") * F.col("m1") + F.col("m2") * F.col("m2")) + 0.1586 * F.sqrt(F.col("v1") + F.col("v2"))).alias("uicm"))


def histogram(pixels: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(image_id, channel, v, n, total): how often each value of each named column occurs."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("channel"), x.cast("int").alias("v")) for name, x in values.items()]))
    counts = pixels.select("image_id", each.alias("e")).groupBy("image_id", "e.channel", "e.v").agg(F.count("*").alias("n"))
    totals = counts.groupBy("image_id", "channel").agg(F.sum("n").alias("total"))
    return counts.join(totals, ["image_id", "channel"])


def entropies(pixels: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(image_id, channel, entropy) in bits, over the values that occur."""
    p = F.col("n") / (F.col("total") + EPS)
    return histogram(pixels, values).groupBy("image_id", "channel").agg(F.sum(-p * F.log2(p)).alias("entropy"))


def distribution(pixels: DataFrame) -> DataFrame:
    """(image_id, channel, uniformity, dynamic_range): distance to the uniform histogram, share of used values."""
    p, u = F.col("n") / (F.col("total") + EPS), F.lit(1 / 256)
    found = histogram(pixels, {n: F.col(n) for n in "bgr"}).groupBy("image_id", "channel").agg(F.sum((p - u) * (p - u)).alias("s"), F.count("*").alias("k"), F.count_if(p > 0.001).alias("used"))
    return found.select("image_id", "channel", ((F.col("s") + (256 - F.col("k")) * u * u) / (u + EPS)).alias("uniformity"), (F.col("used") / 256).alias("dynamic_range"))


def weber(pixels: DataFrame, size: int = 32) -> DataFrame:
    """(image_id, weber_contrast): centre against surround of patches, by grouping on the patch."""
    rows = pixels.select("image_id", "y", "x", grey().alias("v"))
    sides = rows.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    patch = lambda n: F.floor(F.col(n) / size)
    inner = lambda n: (F.col(n) % size >= size // 4) & (F.col(n) % size < 3 * size // 4)
    inside = inner("y") & inner("x")
    per = rows.groupBy("image_id", patch("y").alias("i"), patch("x").alias("j")).agg(
        F.avg(F.when(inside, F.col("v"))).alias("centre"), F.avg(F.when(~inside & (F.col("v") > 0), F.col("v"))).alias("around"),
    )
    joined = per.join(sides, "image_id").withColumn("around", F.coalesce("around", "centre"))
    use = (F.col("i") * size < F.col("h") - size) & (F.col("j") * size < F.col("w") - size) & (F.col("around") > 1)
    return joined.groupBy("image_id").agg(F.coalesce(F.avg(F.when(use, F.abs(F.col("centre") - F.col("around")) / F.col("around"))), F.lit(0.0)).alias("weber_contrast"))


def fast_metrics(pixels: DataFrame) -> DataFrame:
    """(image_id, fast_*): the cheap approximate metrics, with sample deviations and zero borders.

    They share names with exact metrics elsewhere but not their definitions, hence the prefix.
    The four neighbours come from one shuffle by image and pixel: each pixel sends its value to those around it.
    """
    v = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    rows = pixels.select("image_id", "y", "x", "b", "g", "r", v.alias("v"))
    sent = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)]
    each = F.explode(F.array(*[F.struct((F.col("y") + i).alias("y"), (F.col("x") + j).alias("x"), F.lit(k).alias("k"), F.col("v").alias("v")) for k, (i, j) in enumerate(sent)]))
    around = rows.select("image_id", each.alias("e")).groupBy("image_id", "e.y", "e.x").agg(*[F.coalesce(F.max(F.when(F.col("e.k") == k, F.col("e.v"))), F.lit(0.0)).alias(f"n{k}") for k in range(9)], F.count_if(F.col("e.k") == 0).alias("own"))
    n = lambda k: F.col(f"n{k}")  # noqa: E731  a value sent down by one row comes from above
    gx = (n(6) + 2 * n(4) + n(8)) - (n(5) + 2 * n(3) + n(7))
    gy = (n(7) + 2 * n(2) + n(8)) - (n(5) + 2 * n(1) + n(6))
    lap = n(1) + n(2) + n(3) + n(4) - 4 * n(0)
    made = around.where("own > 0").select("image_id", lap.alias("lap"), F.sqrt(gx * gx + gy * gy).alias("grad"))
    sums = made.groupBy("image_id").agg(F.var_samp("lap").alias("fast_laplacian_variance"), F.avg("grad").alias("fast_gradient"), (F.avg("grad") + F.stddev_samp("grad")).alias("limit"))
    edges = made.join(sums.select("image_id", "limit"), "image_id").groupBy("image_id").agg(F.avg((F.col("grad") > F.col("limit")).cast("double")).alias("fast_edge_density"))
    flat = rows.groupBy("image_id").agg(
        *[F.avg(c).alias(f"fast_{n}_mean") for c, n in (("b", "blue"), ("g", "green"), ("r", "red"))],
        *[F.stddev_samp(c).alias(f"fast_{n}_std") for c, n in (("b", "blue"), ("g", "green"), ("r", "red"))],
        (F.stddev_pop("v") / 255).alias("fast_rms_contrast"), ((F.max("v") - F.min("v")) / (F.max("v") + F.min("v") + EPS)).alias("fast_michelson_contrast"),
    )
    found = flat.join(sums.drop("limit"), "image_id").join(edges, "image_id")
    blue, green, red, rms = (F.col(f"fast_{n}") for n in ("blue_mean", "green_mean", "red_mean", "rms_contrast"))
    found = found.withColumns({"fast_blue_dominance": (blue - red) / 255, "fast_color_temperature": (blue + green) / F.greatest(red, F.lit(1.0))})
    return found.withColumns({
        "fast_blue_water": scores.clip(5 * F.col("fast_blue_dominance") + 5 * (1 - rms), 0.0, 10.0),
        "fast_visibility": scores.clip(0.5 * rms + 0.5 * (1 - F.abs(F.col("fast_blue_dominance")))),
    })
