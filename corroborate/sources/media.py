"""Media files: recursive scans by suffix with labels from folders, admission by suffix and size, origin from bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.routing import ADMITTED, MAX_BYTES

# Suffixes of kinds, and names of phone makers as they stand in files.
IMAGES = ["jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff"]
VIDEOS = ["mp4", "avi", "mov", "mkv", "webm", "flv"]
BRANDS = ["Apple", "Samsung", "Xiaomi", "Huawei", "OnePlus", "Google", "SONY", "OPPO", "vivo", "realme", "Motorola", "Nokia", "LG", "HTC"]
#: Of these, the makers that a second tool knows.
TRUSTED_BRANDS = ["Apple", "Samsung", "Xiaomi", "Huawei", "OnePlus", "Google", "SONY"]
EXIF, SIDES = b"Exif\0\0", ["4032", "3024"]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def kind(path: Column) -> Column:
    return F.when(suffix(path).isin(IMAGES), "image").when(suffix(path).isin(VIDEOS), "video").otherwise("unknown")


def scan(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """(path, length, modificationTime, label, kind[, content]): files under ``root`` that are admitted; the label is 1 in
    a folder named Fake, 0 in one named Real. The size is pushed down to the source; contents are read only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.where((F.col("length") <= MAX_BYTES) & suffix(F.col("path")).isin(ADMITTED))
    folder = F.lower(F.regexp_extract("path", r"/(?i)(real|fake)/", 1))
    columns = ["path", "length", "modificationTime", F.when(folder == "fake", 1).when(folder == "real", 0).alias("label"), kind(F.col("path")).alias("kind")]
    return files.select(*columns, *["content"] * with_content)


def _holds(content: Column, *words: str | bytes) -> Column:
    """Any of some byte strings within the first 2 MB; case matters."""
    head = F.substring(content, 1, 2_000_000)
    found = F.lit(False)
    for w in words:
        found = found | F.contains(head, F.lit(bytearray(w.encode() if isinstance(w, str) else w)))
    return found


def phone_origin(content: Column) -> Column:
    """An EXIF or JFIF marker and a maker's name, both within the first 2 MB."""
    return _holds(content, EXIF, "JFIF") & _holds(content, *BRANDS)


def phone_trust(content: Column, width: Column, height: Column) -> Column:
    """struct(trust, is_phone): .4 for a maker's name and .3 for a side of phone pictures in digits, both only with an EXIF
    marker, and .3 for as many bytes a pixel as phones have (sizes are null where the picture can't be read); a phone
    from more than one half on."""
    exif, per = _holds(content, EXIF), F.least(F.length(content), F.lit(2_000_000)) / (width * height)
    trust = F.when(exif & _holds(content, *TRUSTED_BRANDS), 0.4).otherwise(0.0) + F.when(exif & _holds(content, *SIDES), 0.3).otherwise(0.0) + F.when((per > 0.3) & (per < 1.8), 0.3).otherwise(0.0)
    return F.struct(F.round(F.least(trust, F.lit(1.0)), 6).alias("trust"), (trust > 0.5).alias("is_phone"))


def frame_indices(src_fps: Column, n_frames: Column, fps: float = 30.0, most: int = 300) -> Column:
    """array<long> of the frames that are decoded: multiples of the step, rounded half to even, at most ``most``."""
    step = F.greatest(F.lit(1.0), src_fps / fps)
    every = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * step, 0).cast("long"))
    return F.filter(every, lambda i: i < n_frames)


def first_per_class(rows: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """The first ``n`` of each class by key."""
    from pyspark.sql import Window

    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(label).orderBy(key))).where(F.col("__n") <= n).drop("__n")


def duration(seconds: Column, n_frames: Column, fps: Column) -> Column:
    """Seconds as told, else frames over rate, else 0."""
    return F.coalesce(seconds, F.try_divide(n_frames.cast("double"), fps), F.lit(0.0))


def quantisation_tables(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, table, mean) for each quantisation table in the headers of JPEG files; other files have none."""
    import pandas as pd

    def parse(data: bytes) -> list[tuple[int, float]]:
        out, at = [], 2
        while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xDB:
                body, k = data[at + 4 : at + 2 + size], 0
                while k < len(body):
                    wide = 2 if body[k] >> 4 else 1
                    cells = body[k + 1 : k + 1 + 64 * wide]
                    values = [int.from_bytes(cells[i : i + wide], "big") for i in range(0, len(cells), wide)]
                    out.append((body[k] & 15, round(sum(values) / max(1, len(values)), 4)))
                    k += 1 + 64 * wide
            at += 2 + size
        return out

    def run(batches):
        for b in batches:
            rows = [(k, t, m) for k, c in zip(b[key], b[content]) if c is not None for t, m in parse(bytes(c))]
            yield pd.DataFrame(rows, columns=[key, "table", "mean"])

    return files.select(key, content).mapInPandas(run, f"{key} {dict(files.dtypes)[key]}, table int, mean double")
