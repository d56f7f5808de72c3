"""Per-image statistics and the plausibility gate, on arrays of RGB in [0, 1]; one row an image, no explode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.scalar import array_percentile

#: The gate's thresholds.
MEAN_SATURATION, P95_SATURATION, MEAN_SPREAD, COLOURFUL_FRACTION = 0.30, 0.65, 0.12, 0.35
PIXEL_SATURATION, PIXEL_SPREAD = 0.50, 0.15
INTENSITY_STD, INTENSITY_RANGE = 0.01, 0.02
LUMINANCE = (0.2126, 0.7152, 0.0722)


def pixel_stats(images: DataFrame, digits: int = 6) -> DataFrame:
    """``images``: image_id, r, g, b (arrays of double of one length)."""
    def mean(a):
        return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a).cast("double"))

    high = F.transform(F.arrays_zip("r", "g", "b"), lambda p: F.greatest(p["r"], p["g"], p["b"]))
    low = F.transform(F.arrays_zip("r", "g", "b"), lambda p: F.least(p["r"], p["g"], p["b"]))
    light = F.transform(F.arrays_zip("r", "g", "b"), lambda p: LUMINANCE[0] * p["r"] + LUMINANCE[1] * p["g"] + LUMINANCE[2] * p["b"])
    x = images.select("image_id", high.alias("high"), low.alias("low"), light.alias("light"))
    x = x.withColumn("spread", F.zip_with("high", "low", lambda a, b: a - b))
    x = x.withColumn("saturation", F.zip_with("spread", "high", lambda s, h: F.when(h > 1e-6, s / h).otherwise(0.0)))
    x = x.withColumn("colourful", F.zip_with("saturation", "spread", lambda s, d: F.when((s >= PIXEL_SATURATION) & (d >= PIXEL_SPREAD), 1.0).otherwise(0.0)))
    x = x.withColumn("centre", mean(F.col("light"))).withColumn("ordered", F.array_sort("light"))
    spread2 = F.transform("light", lambda v: (v - F.col("centre")) * (v - F.col("centre")))
    r = lambda c: F.round(c, digits)
    return x.select(
        "image_id", r(mean(F.col("saturation"))).alias("mean_saturation"), r(array_percentile(F.array_sort("saturation"), 0.95)).alias("p95_saturation"),
        r(mean(F.col("spread"))).alias("mean_spread"), r(mean(F.col("colourful"))).alias("colourful_fraction"), r(F.sqrt(mean(spread2))).alias("intensity_std"),
        r(array_percentile(F.col("ordered"), 0.99) - array_percentile(F.col("ordered"), 0.01)).alias("intensity_range"))


def plausibility(stats: DataFrame) -> DataFrame:
    """verdict: colour comes before blank, else pass."""
    strong = (F.col("mean_saturation") >= MEAN_SATURATION) & (F.col("p95_saturation") >= P95_SATURATION) & (F.col("mean_spread") >= MEAN_SPREAD)
    broad = (F.col("colourful_fraction") >= COLOURFUL_FRACTION) & (F.col("mean_spread") >= MEAN_SPREAD)
    blank = (F.col("intensity_std") < INTENSITY_STD) & (F.col("intensity_range") < INTENSITY_RANGE)
    return stats.withColumn("verdict", F.when(strong | broad, "colour").when(blank, "blank").otherwise("pass"))
