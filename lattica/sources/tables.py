"""Sources and sinks: labelled images, masks, CSV, face positions, and the driver's tables read as images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.vectors import doubles, hard_mask

PIXELS = "image_id long, r int, c int, height int, width int, b double, g double, red double, mask double"
FACES = T.StructType([T.StructField("image_name", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(origin, file, height, width, n_channels, data) of every PNG below a folder."""
    i = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(folder)
    return i.select("image.origin", F.element_at(F.split("image.origin", "/"), -1).alias("file"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data")


def dataset(spark: SparkSession, folder: str, names: list[str], per_class: int) -> DataFrame:
    """(image_id, name, class, image, mask, segmentation): images <name>_<letter>.png with their masks and manual segments.

    image_id is class * per_class + the letter's place; masks are <file>-mask.png and segments <name>_<letter>_seg.png.
    Images without one of the two have null there.
    """
    files = image_files(spark, folder)
    part = lambda p: files.withColumn("name", F.regexp_extract("file", p, 1)).withColumn("letter", F.regexp_extract("file", p, 2)).where("name <> ''")
    data = F.struct("height", "width", "n_channels", "data")
    image = part(r"^(.+)_([a-z])\.png$").select("name", "letter", data.alias("image"))
    mask = part(r"^(.+)_([a-z])\.png-mask\.png$").select("name", "letter", data.alias("mask"))
    seg = part(r"^(.+)_([a-z])_seg\.png$").select("name", "letter", data.alias("segmentation"))
    classes = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    out = image.withColumn("class", classes[F.col("name")]).where(F.col("class").isNotNull())
    place = F.ascii("letter") - ord("a")
    out = out.join(mask, ["name", "letter"], "left").join(seg, ["name", "letter"], "left").where(place < per_class)
    return out.select((F.col("class") * per_class + place).cast("long").alias("image_id"), "name", "class", "image", "mask", "segmentation")


def decoded_pixels(images: DataFrame) -> DataFrame:
    """pixels of dataset() images: channels in 0 to 255, blue first; mask 1 where kept, from the mask image's channel 0.

    A grey image has its one channel three times. Images are decoded one at a time; a missing mask keeps all pixels.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in it:
            for x in d.itertuples(index=False):
                h, w, n = x.image["height"], x.image["width"], x.image["n_channels"]
                b = np.frombuffer(x.image["data"], np.uint8).reshape(h * w, n)
                m = np.zeros(h * w) if x.mask is None else np.frombuffer(x.mask["data"], np.uint8).reshape(h * w, x.mask["n_channels"])[:, 0]
                at = np.arange(h * w)
                colours = {c: b[:, min(k, n - 1)].astype(float) for k, c in enumerate(("b", "g", "red"))}
                yield pd.DataFrame({"image_id": x.image_id, "r": at // w, "c": at % w, "height": h, "width": w, **colours, "m": m.astype(float)})

    out = images.select("image_id", "image", "mask").mapInPandas(run, "image_id long, r int, c int, height int, width int, b double, g double, red double, m double")
    return out.select("image_id", "r", "c", "height", "width", "b", "g", "red", hard_mask(F.col("m")).alias("mask"))


def read_csv(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Cells c0 to cn as strings: split at commas, without quotes, header or trimming; the last line is kept."""
    cells = F.split("value", ",", -1)
    return spark.read.text(path).select(*(F.get(cells, F.lit(i)).alias(f"c{i}") for i in range(columns)))


def leading_number(cell: Column) -> Column:
    """The integer that a string starts with, else 0."""
    return F.coalesce(F.regexp_extract(cell, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0)).cast("double")


def face_positions(spark: SparkSession, path: str) -> DataFrame:
    c = read_csv(spark, path, 3)
    return c.select(F.col("c0").alias("image_name"), leading_number(F.col("c1")).alias("x"), leading_number(F.col("c2")).alias("y"))


def write_face_positions(faces: DataFrame, path: str) -> None:
    faces.select(F.concat_ws(",", "image_name", F.col("x").cast("int").cast("string"), F.col("y").cast("int").cast("string")).alias("value")).write.text(path)


def matrix_lines(matrix: DataFrame) -> DataFrame:
    """(i, line) of a matrix (i, j, v): values joined by comma and space, in column order."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("j", F.col("v").cast("string").alias("s")))), lambda x: x["s"])
    return matrix.groupBy("i").agg(F.concat_ws(", ", row).alias("line"))


def write_matrix_csv(matrix: DataFrame, path: str) -> None:
    matrix_lines(matrix).repartitionByRange("i").sortWithinPartitions("i").select(F.col("line").alias("value")).write.text(path)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples(id, x, label) from the embeddings table, as doubles."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), doubles("embedding").alias("x"), "label")


def vector_images(spark: SparkSession, sf_dir: str, side: int = 8) -> DataFrame:
    """Each vector as a side x side image: pixels with v, three channels in 0 to 1, mask 1 where v >= 0, and its class."""
    n = side * side
    p = vectors(spark, sf_dir).select(F.col("id").alias("image_id"), "label", "x", F.posexplode("x").alias("pix", "v")).where(F.col("pix") < n)
    at = lambda k: (F.element_at("x", ((F.col("pix") + k) % n + 1).cast("int")) + 1) / 2
    return p.select("image_id", "label", "pix", F.floor(F.col("pix") / side).cast("int").alias("r"), (F.col("pix") % side).alias("c"), F.lit(side).alias("height"), F.lit(side).alias("width"), "v", at(0).alias("b"), at(1).alias("g"), at(2).alias("red"), F.when(F.col("v") >= 0, 1.0).otherwise(0.0).alias("mask"))
