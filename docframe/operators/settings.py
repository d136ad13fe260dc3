"""Settings and sources as columns: formats, binarisation, photos, word arrays, model lists, prompts, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags that cameras write (fixed values of the EXIF standard): maker, model, exposure, aperture, sensitivity, time taken, focal length.
CAMERA_TAGS = (271, 272, 33434, 33437, 34855, 36867, 37386)


def source_format(path: Column) -> Column:
    """png for PNG files, jpeg for all others."""
    return F.when(F.lower(path).endswith(".png"), "png").otherwise("jpeg")


def binarise(mode: Column, engine: Column, intent: Column) -> Column:
    """on and off as said; auto: for the local text engine, if the outcome isn't an image."""
    m = F.lower(F.coalesce(mode, F.lit("auto")))
    return F.when(m == "on", True).when(m == "off", False).otherwise((engine == "tesseract") & (intent != "image"))


def enlarger(model: Column, fmt: Column) -> Column:
    return F.coalesce(F.nullif(model, F.lit("")), F.when(fmt == "png", "sharp").otherwise("general"))


def is_photo(exif: Column, fmt: Column) -> Column:
    """A camera's tag, or six tags and more in a JPEG or TIFF."""
    tags = F.map_keys(exif)
    return (F.size(F.array_intersect(tags, F.array(*[F.lit(t) for t in CAMERA_TAGS]))) > 0) | (fmt.isin("jpeg", "jpg", "tif", "tiff") & (F.size(tags) >= 6))


def array_words(pages: DataFrame, by: str = "page_id") -> DataFrame:
    """Words of parallel arrays (text, conf, left, top, width, height): blank ones go, boxes as left, top, right, bottom of one pixel at least."""
    zipped = F.arrays_zip("text", "conf", "left", "top", "width", "height")
    w = pages.select(by, F.posexplode(zipped).alias("pos", "z")).where(F.trim("z.text") != "")
    right, bottom = F.col("z.left") + F.greatest(F.lit(1), "z.width"), F.col("z.top") + F.greatest(F.lit(1), "z.height")
    return w.select(by, "pos", F.trim("z.text").alias("text"), F.col("z.conf").try_cast("double").alias("confidence"), F.col("z.left").alias("left"), F.col("z.top").alias("top"), right.alias("right"), bottom.alias("bottom"))


def model_list(lines: DataFrame, line: str = "line") -> DataFrame:
    """Models of a cached list: no blank lines, comments, or notes of when it was checked."""
    x = F.trim(line)
    return lines.where((x != "") & ~x.startswith("#") & ~F.lower(x).rlike("^checked (at|from)")).withColumn(line, x)


def allowed(models: DataFrame, allow: DataFrame, name: str = "model") -> DataFrame:
    """Models on the list, whatever their case; the first of equal ones."""
    from docframe.operators.control import first_of_each

    keyed = models.withColumn("_k", F.lower(name))
    return first_of_each(keyed.join(F.broadcast(allow.select(F.lower(name).alias("_k")).distinct()), "_k", "left_semi"), F.col("_k"), "ord").drop("_k")


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with its {names} replaced, nothing else being special."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), F.coalesce(v, F.lit("")))
    return template


def with_hint(prompt: Column, hint: Column, most: int = 6000) -> Column:
    """A prompt with another engine's text behind it, cut to 1,000 to 20,000 characters."""
    most = max(1000, min(20000, most))
    h = F.trim(F.coalesce(hint, F.lit("")))
    cut = F.when(F.length(h) > most, F.concat(F.rtrim(F.left(h, F.lit(most))), F.lit("\n[truncated]"))).otherwise(h)
    return F.when(h == "", prompt).otherwise(F.concat(F.trim(prompt), F.lit("\n\nA first reading of this page, which may be wrong:\n"), cut))


def idempotency_key(*parts: Column) -> Column:
    """A key of a call for retries, of 200 characters at most."""
    return F.left(F.concat(F.lit("k-"), F.sha2(F.concat_ws("\x1f", *parts), 256)), F.lit(200))


def preset_is_active(chosen: Column, preset: Column) -> Column:
    """Whether the chosen values are just those of a preset, in any order."""
    return F.array_sort(F.array_distinct(chosen)) == F.array_sort(F.array_distinct(preset))


def artifacts(files: DataFrame, packages: DataFrame, path: str = "path") -> DataFrame:
    """Machine-written JSON files that lie in no package folder: ancestors of each file are joined, not compared one by one."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    inside = files.select(path, F.explode(above).alias("_a")).join(packages.select(F.col(path).alias("_a")), "_a", "left_semi").select(path).distinct()
    return files.where(F.lower(path).endswith(".json")).join(inside, path, "left_anti")
