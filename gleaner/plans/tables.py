"""How the driver's tables stand in for the reference's inputs; each DataFrame has its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.scalar import argmax, softmax
from gleaner.operators.near import median_bits
from gleaner.plans.registry import table

SPLITS, CLASSES = ["Training", "Testing"], ["en", "fr", "de", "es"]
NAMES = ["glioma", "meningioma", "notumor", "pituitary"]


def files(spark: SparkSession, sf: str) -> DataFrame:
    """A document is a file: its language is the class, its extension follows from the source."""
    d = table(spark, sf, "documents")
    kind = F.substr("source", F.lit(4)).cast("int") % 5
    ext = F.when(kind == 0, ".jpg").when(kind == 1, ".jpeg").when(kind == 2, ".png").when(kind == 3, ".bmp").otherwise(".txt")
    split = F.when(F.col("doc_id") % 5 == 0, "Testing").otherwise("Training")
    real = F.when(F.col("n_chars") % 11 == 0, "PNG").when(kind < 2, "JPEG").when(kind == 2, "PNG").when(kind == 3, "BMP")
    return d.select(
        "doc_id", split.alias("split"), F.col("lang").alias("class"), "source", ext.alias("extension"),
        F.concat(split, F.lit("/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 10, "0"), ext).alias("relative_path"),
        F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("file_size_bytes"),
        (F.col("n_chars") % 7 * 32 + 64).cast("int").alias("width"), (F.col("n_chars") % 5 * 32 + 64).cast("int").alias("height"),
        F.when(F.col("n_chars") % 3 == 0, "L").when(F.col("n_chars") % 3 == 1, "RGB").otherwise("RGBA").alias("mode"), real.alias("format"), (F.col("n_chars") >= 40).alias("valid"))


FILES = """files AS (
  SELECT doc_id, split, lang AS class, source, extension, split || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || extension AS relative_path,
         sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS file_size_bytes, CAST(n_chars % 7 * 32 + 64 AS INT) AS width, CAST(n_chars % 5 * 32 + 64 AS INT) AS height,
         CASE n_chars % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'RGB' ELSE 'RGBA' END AS mode,
         CASE WHEN n_chars % 11 = 0 THEN 'PNG' WHEN kind < 2 THEN 'JPEG' WHEN kind = 2 THEN 'PNG' WHEN kind = 3 THEN 'BMP' END AS format, n_chars >= 40 AS valid
  FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'Testing' ELSE 'Training' END AS split, CAST(substr(source, 4) AS INT) % 5 AS kind,
               CASE CAST(substr(source, 4) AS INT) % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.png' WHEN 3 THEN '.bmp' ELSE '.txt' END AS extension FROM documents))"""


def training(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).filter("split = 'Training'")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(model, ordinal, filepath, y_true, prob, y_pred): four numbers of an embedding are a model's logits."""
    e = table(spark, sf, "embeddings")
    out = None
    for i, name in enumerate(("baseline", "transfer")):
        logits = F.transform(F.slice("embedding", 4 * i + 1, 4), lambda x: x.cast("double"))
        m = e.select(
            F.lit(name).alias("model"), F.lit(i).alias("ordinal"), F.concat(F.lit("data/"), F.lpad(F.col("vec_id").cast("string"), 8, "0"), F.lit(".jpg")).alias("filepath"),
            (F.col("label") % 4).cast("int").alias("y_true"), softmax(logits).alias("prob"), argmax(logits).alias("y_pred"), "vec_id")
        out = m if out is None else out.unionByName(m)
    return out


PREDICTIONS = """raw AS (
  SELECT 'baseline' AS model, 0 AS ordinal, vec_id, label, CAST(embedding[1:4] AS DOUBLE[]) AS z FROM embeddings
  UNION ALL SELECT 'transfer', 1, vec_id, label, CAST(embedding[5:8] AS DOUBLE[]) FROM embeddings),
ex AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS ez FROM raw),
predictions AS (SELECT model, ordinal, vec_id, 'data/' || lpad(CAST(vec_id AS VARCHAR), 8, '0') || '.jpg' AS filepath, CAST(label % 4 AS INT) AS y_true,
  list_transform(ez, lambda x: x / list_sum(ez)) AS prob, CAST(list_position(z, list_max(z)) - 1 AS INT) AS y_pred FROM ex)"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events in time are the epochs of a run; ``value`` is the validation loss."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("run"), F.row_number().over(w).cast("long").alias("epoch"), "value", F.when(F.col("event_type") == "view", 1).otherwise(2).alias("stage"))


HISTORY = """history AS (SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS epoch, value,
  CASE WHEN event_type = 'view' THEN 1 ELSE 2 END AS stage FROM events)"""


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), median_bits(F.col("embedding")).alias("fp"), F.when(F.col("vec_id") % 5 == 0, "Testing").otherwise("Training").alias("split"), F.col("label").cast("string").alias("class"))


_MID = "((list_sort(embedding)[32])::DOUBLE + (list_sort(embedding)[33])::DOUBLE) / 2"
#: The sign bit is added last, so that no sum leaves 64 bits.
FINGERPRINTS = f"""mids AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, {_MID} AS mid FROM embeddings),
fingerprints AS (SELECT vec_id AS id, label,
  CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN e[i + 1] > mid THEN 1::HUGEINT << CAST(63 - i AS INT) ELSE 0::HUGEINT END)) AS HUGEINT)
  - (CASE WHEN e[1] > mid THEN 9223372036854775808::HUGEINT ELSE 0::HUGEINT END) AS big FROM mids),
codes AS (SELECT id, CAST(big AS BIGINT) AS fp, CASE WHEN id % 5 = 0 THEN 'Testing' ELSE 'Training' END AS split, CAST(label AS VARCHAR) AS class FROM fingerprints),
pairs AS (SELECT a.id AS i, b.id AS j, CAST(bit_count(xor(a.fp, b.fp)) AS INT) AS distance FROM codes a JOIN codes b ON a.id < b.id AND bit_count(xor(a.fp, b.fp)) <= 20)"""


def images(spark: SparkSession, sf: str) -> DataFrame:
    """An embedding is an image of 21 pixels; every third number is a channel, tinted less for small labels."""
    e = table(spark, sf, "embeddings")
    base = lambda i: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda p: F.least(F.abs(F.get("embedding", p * 3).cast("double")) * 4 + F.abs(F.get("embedding", p * 3 + i).cast("double")) * F.col("label") / 2, F.lit(1.0)))
    return e.select(F.col("vec_id").alias("image_id"), base(0).alias("r"), base(1).alias("g"), base(2).alias("b"))


def _channel(i: int) -> str:
    return f"list_transform(range(0, 21), lambda p: least(abs(e[p * 3 + 1]) * 4 + abs(e[p * 3 + {i} + 1]) * label / 2, 1.0::DOUBLE))"


def _pct(a: str, p: float) -> str:
    at = f"(len({a}) - 1) * {p}::DOUBLE"
    return f"({a}[CAST(floor({at}) AS INT) + 1] + ({a}[CAST(ceil({at}) AS INT) + 1] - {a}[CAST(floor({at}) AS INT) + 1]) * ({at} - floor({at})))"


IMAGES = f"""src AS (SELECT vec_id AS image_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
rgb AS (SELECT image_id, {_channel(0)} AS r, {_channel(1)} AS g, {_channel(2)} AS b FROM src),
hl AS (SELECT image_id, list_transform(range(1, 22), lambda i: greatest(r[i], g[i], b[i])) AS hi, list_transform(range(1, 22), lambda i: least(r[i], g[i], b[i])) AS lo,
  list_transform(range(1, 22), lambda i: 0.2126::DOUBLE * r[i] + 0.7152::DOUBLE * g[i] + 0.0722::DOUBLE * b[i]) AS lum FROM rgb),
sp AS (SELECT *, list_transform(range(1, 22), lambda i: hi[i] - lo[i]) AS spread, list_transform(range(1, 22), lambda i: CASE WHEN hi[i] > 1e-6 THEN (hi[i] - lo[i]) / hi[i] ELSE 0 END) AS sat FROM hl),
pixel AS (SELECT image_id, round(list_avg(sat), 6) AS mean_saturation, round({_pct('list_sort(sat)', 0.95)}, 6) AS p95_saturation, round(list_avg(spread), 6) AS mean_spread,
  round(list_avg(list_transform(range(1, 22), lambda i: CASE WHEN sat[i] >= 0.5 AND spread[i] >= 0.15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS colourful_fraction,
  round(sqrt(list_avg(list_transform(lum, lambda v: (v - list_avg(lum)) * (v - list_avg(lum))))), 6) AS intensity_std,
  round({_pct('list_sort(lum)', 0.99)} - {_pct('list_sort(lum)', 0.01)}, 6) AS intensity_range FROM sp)"""
