"""Ruled tables: line centres from projections, merged cells, and page images as NumPy arrays.

Images have no built-in functions in Spark, so their kernels work on arrays in
Arrow passes; a page is bounded, and pages are independent rows.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docframe.operators.merges import tables
from docframe.session import kept, shared_folder

GAP = 5
DARK = 180
PNG_MARK = b"\x89PNG\r\n\x1a\n"


def line_centers(positions: DataFrame, by: str = "region", pos: str = "pos", gap: int = GAP) -> DataFrame:
    """Centres of runs of positions that are at most `gap` apart, rounded half to even."""
    w = Window.partitionBy(by).orderBy(pos)
    fresh = F.when(F.col(pos) - F.lag(pos).over(w) > gap, 1).otherwise(0)
    runs = positions.withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(by, "_g").agg(F.bround((F.min(pos) + F.max(pos)) / 2.0).cast("long").alias("center")).select(by, "center")


def rectangular(cells: DataFrame, by: str = "component") -> DataFrame:
    """Whether the cells of each component fill their bounding rectangle."""
    area = (F.max("row") - F.min("row") + 1) * (F.max("col") - F.min("col") + 1)
    return cells.groupBy(by).agg((area == F.count_distinct("row", "col")).alias("rectangular"))


# -- kernels on arrays of rows by columns, 0 (black) to 255 --


def png_encode(gray: np.ndarray) -> bytes:
    """An 8-bit greyscale PNG."""
    h, w = gray.shape
    raw = np.zeros((h, w + 1), np.uint8)
    raw[:, 1:] = gray
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """Grey values of an 8-bit PNG that isn't interlaced: grey, RGB, palette, with or without alpha (which is dropped)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, palette = 8, b"", None
    w = h = depth = kind = 0
    while at < len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlaced:
                raise ValueError("8-bit PNGs without interlacing are read")
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed += body
        at += n + 12
    size = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * size)
    out = np.zeros((h, w * size), np.int32)
    above = np.zeros(w * size, np.int32)
    for y in range(h):
        line, how = rows[y, 1:].astype(np.int32), int(rows[y, 0])
        if how == 2:
            line = (line + above) & 255
        elif how in (1, 3, 4):
            for x in range(w * size):  # each value needs the one before it
                left = int(line[x - size]) if x >= size else 0
                up, corner = int(above[x]), int(above[x - size]) if x >= size else 0
                if how == 1:
                    add = left
                elif how == 3:
                    add = (left + up) // 2
                else:
                    guess = left + up - corner
                    add = min((left, up, corner), key=lambda v, g=guess: abs(g - v))
                line[x] = (line[x] + add) & 255
        out[y] = above = line
    pixels = out.reshape(h, w, size).astype(np.uint8)
    if kind == 3:
        pixels = palette[pixels[:, :, 0]]
    if pixels.shape[2] >= 3:
        return np.round(pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    return pixels[:, :, 0]


def median3(gray: np.ndarray) -> np.ndarray:
    p = np.pad(gray, 1, mode="edge")
    h, w = gray.shape
    return np.median(np.stack([p[y : y + h, x : x + w] for y in range(3) for x in range(3)]), axis=0).astype(np.uint8)


def autocontrast(gray: np.ndarray, cutoff: float = 0.5) -> np.ndarray:
    """Stretches what remains after cutting off `cutoff` percent at either end."""
    low, high = np.percentile(gray, [cutoff, 100 - cutoff])
    if high <= low:
        return gray
    return np.clip((gray.astype(np.float64) - low) * 255 / (high - low), 0, 255).round().astype(np.uint8)


def contrast(gray: np.ndarray, factor: float) -> np.ndarray:
    mean = round(float(gray.mean()))
    return np.clip((gray.astype(np.float64) - mean) * factor + mean, 0, 255).round().astype(np.uint8)


def box_mean(gray: np.ndarray, radius: int) -> np.ndarray:
    """Means over squares, from an integral image."""
    p = np.pad(gray.astype(np.float64), radius, mode="edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * radius + 1
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / (n * n)


def unsharp(gray: np.ndarray, radius: int = 1, percent: int = 120, threshold: int = 2) -> np.ndarray:
    detail = gray - box_mean(gray, radius)
    return np.clip(np.where(np.abs(detail) >= threshold, gray + detail * percent / 100, gray), 0, 255).round().astype(np.uint8)


def binarize(gray: np.ndarray, radius: int = 15, less: float = 10.0) -> np.ndarray:
    """Black where a pixel is darker than its surroundings by `less`."""
    return np.where(gray < box_mean(gray, radius) - less, 0, 255).astype(np.uint8)


def strip_vertical_lines(gray: np.ndarray, share: float = 0.6) -> np.ndarray:
    """Columns that are dark over most of the height become the mean of their neighbours, as scanner streaks do."""
    streak = (gray < DARK).mean(0) >= share
    if not streak.any() or streak.all():
        return gray
    good = np.flatnonzero(~streak)
    out = gray.copy()
    for x in np.flatnonzero(streak):
        at = np.searchsorted(good, x)
        near = [good[i] for i in (at - 1, at) if 0 <= i < len(good)]
        out[:, x] = gray[:, near].mean(1).astype(np.uint8)
    return out


def preclean(gray: np.ndarray, level: int = 1) -> np.ndarray:
    """Median, contrast and sharpening, more of each with the level (0: nothing)."""
    if level <= 0:
        return gray
    for _ in range(min(level, 2)):
        gray = median3(gray)
    return unsharp(contrast(autocontrast(gray, 0.5 if level == 1 else 1.0), 1.0 + 0.15 * level))


#: Angles of lines that are looked for, in degrees, and by how much a profile has to be sharper than that of the page as it is.
MOST_SKEW, SHARPER = 15.0, 1.0003


def skew_angle(gray: np.ndarray, most: float = MOST_SKEW) -> float:
    """Degrees by which the lines of a page go down to the right.

    Dark pixels are sheared by each angle and counted by row: rows of text give the sharpest profile (the largest sum of
    squares) at the angle of the lines.  Half degrees first, on columns of four, then tenths and fiftieths around the best; 0 if no angle is
    sharper than none, as on a page without lines."""
    ink = np.maximum(0.0, DARK - gray.astype(np.float64))
    if not ink.any():
        return 0.0

    def sharpness(ink: np.ndarray, wide: int):
        # Columns are shifted as a whole, so the steps within them will do where they are fewer than the dark pixels.
        steps = np.diff(ink, axis=0, prepend=0, append=0)
        stepwise = np.count_nonzero(steps) < np.count_nonzero(ink)
        y, x = np.nonzero(steps if stepwise else ink)
        weight = (steps if stepwise else ink)[y, x]
        middle = (np.arange(ink.shape[1]) + 0.5) * wide - gray.shape[1] / 2

        @functools.cache
        def of(angle: float) -> float:
            shift = -middle * np.tan(np.radians(angle))
            shift -= np.floor(shift.min())
            whole = shift.astype(np.int64)
            low = y + whole[x]
            part = (shift - whole)[x] * weight  # a pixel counts in both rows that it lies between
            n = ink.shape[0] + int(whole.max()) + 3
            profile = np.bincount(low, weight - part, n) + np.bincount(low + 1, part, n)
            if stepwise:
                profile = np.cumsum(profile)
            profile = np.convolve(profile, (0.25, 0.5, 0.25))  # else angles that fall on whole rows look sharper
            return float(profile @ profile)

        return of

    wide = 4  # columns that are one at first
    rough = sharpness(np.add.reduceat(ink, np.arange(0, ink.shape[1], wide), axis=1), wide)
    halves = [k / 2 for k in range(-int(2 * most), int(2 * most) + 1)]
    best = max(halves, key=lambda v: (rough(v), -abs(v)))
    fine = sharpness(ink, 1)
    best = max((v for k in range(-4, 5) if abs(v := round(best + k / 10, 1)) <= most), key=lambda v: (fine(v), -abs(v)))
    # The sharpest angles form a plateau, as pixels are steps: its middle.
    around = {v: fine(v) for k in range(-15, 16) if abs(v := round(best + k / 50, 2)) <= most}
    top = [v for v, sharp in around.items() if sharp >= 0.9995 * max(around.values())]
    best = round((min(top) + max(top)) / 2, 2)
    return best if fine(best) > SHARPER * fine(0.0) else 0.0


def rotated(gray: np.ndarray, angle: float, rows: int = 256) -> np.ndarray:
    """The page turned by `angle` degrees against the clock about its middle, by bilinear interpolation, its borders continued."""
    h, w = gray.shape
    sin, cos = np.sin(np.radians(angle)), np.cos(np.radians(angle))
    out, x, flat = np.empty_like(gray), np.arange(w) - (w - 1) / 2, np.ascontiguousarray(gray).ravel()
    for top in range(0, h, rows):
        y = (np.arange(top, min(h, top + rows)) - (h - 1) / 2)[:, None]
        from_x = np.clip(cos * x - sin * y + (w - 1) / 2, 0, w - 1)
        from_y = np.clip(sin * x + cos * y + (h - 1) / 2, 0, h - 1)
        x0, y0 = from_x.astype(np.intp), from_y.astype(np.intp)
        fx, fy = from_x - x0, from_y - y0
        at, right, below = y0 * w + x0, x0 < w - 1, (y0 < h - 1) * w
        upper = flat.take(at) * (1 - fx) + flat.take(at + right) * fx
        at += below
        lower = flat.take(at) * (1 - fx) + flat.take(at + right) * fx
        out[top : top + rows] = (upper * (1 - fy) + lower * fy).round()
    return out


def deskew(gray: np.ndarray, most: float = MOST_SKEW) -> np.ndarray:
    """The page with its lines level; as it is if they are."""
    angle = skew_angle(gray, most)
    return gray if angle == 0 else rotated(gray, angle)


def skew_angles(pages: DataFrame, content: str = "content", out: str = "skew") -> DataFrame:
    """PNG pages with the angle of their lines (null without a page); a column of that name is replaced."""
    pages = pages.drop(out)

    def work(parts):
        for part in parts:
            part[out] = [None if data is None else skew_angle(png_decode(data)) for data in part[content]]
            yield part

    return pages.mapInPandas(work, StructType([*pages.schema.fields, StructField(out, DoubleType())]))


def resized(gray: np.ndarray, width: int, height: int, lobes: int = 3) -> np.ndarray:
    """An image of another size by windowed sinc interpolation (Lanczos), row by row and column by column."""

    def weights(old: int, new: int) -> np.ndarray:
        scale = max(1.0, old / new)
        centre = (np.arange(new) + 0.5) * old / new - 0.5
        x = (np.arange(old)[None, :] - centre[:, None]) / scale
        w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0)
        return w / w.sum(1, keepdims=True)

    out = weights(gray.shape[0], height) @ gray.astype(np.float64) @ weights(gray.shape[1], width).T
    return np.clip(out, 0, 255).round().astype(np.uint8)


def upscaled(gray: np.ndarray, factor: int, enlarge=None) -> np.ndarray:
    """An enlarged page: by a program given as a function, else by interpolation; factors under two change nothing."""
    if factor < 2:
        return gray
    if enlarge is not None:
        try:
            return enlarge(gray, factor)
        except (OSError, ValueError):  # the program isn't there, or failed
            pass
    return resized(gray, gray.shape[1] * factor, gray.shape[0] * factor)


def normalized(gray: np.ndarray, least: int = 1600, most: int = 2800, stretch: bool = True, factor: float = 1.0, sharpness: float = 1.0, median: int = 0) -> np.ndarray:
    """A photographed page made ready: long side between two bounds, contrast stretched and raised, sharpened, smoothed."""
    long = max(gray.shape)
    scale = least / long if long < least else most / long if long > most else 1.0
    if scale != 1.0:
        gray = resized(gray, max(1, int(gray.shape[1] * scale + 0.5)), max(1, int(gray.shape[0] * scale + 0.5)))
    if stretch:
        gray = autocontrast(gray, 0.0)
    if factor != 1.0:
        gray = contrast(gray, factor)
    if sharpness != 1.0:
        soft = box_mean(gray, 1)
        gray = np.clip(soft + (gray - soft) * sharpness, 0, 255).round().astype(np.uint8)
    return median3(gray) if median >= 3 else gray


def numeric_enhanced(gray: np.ndarray) -> np.ndarray:
    """A crop of numbers with its contrast stretched and raised, and sharpened."""
    return unsharp(contrast(autocontrast(gray, 0.25), 1.55), 1, 140, 2)


def numeric_crop(gray: np.ndarray, box: tuple[int, int, int, int], pad: int = 8, wide: int = 1200, most: int = 4) -> np.ndarray:
    """A padded crop, enlarged to a width of `wide` by at most `most` times."""
    part = crop(gray, box, pad)
    factor = min(most, wide / part.shape[1]) if part.size else 1.0
    return resized(part, round(part.shape[1] * factor), round(part.shape[0] * factor)) if factor > 1 else part


def tiff_order(read) -> tuple[str, int]:
    """Byte order and the first directory's place of a TIFF, by a function that reads ranges (place, length)."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack_from(order + "H", head, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    return order, struct.unpack_from(order + "I", head, 4)[0]


def tiff_directory(read, order: str, at: int) -> tuple[dict[int, tuple], int]:
    """Numeric tags of the directory at a place, and the place of the next one (0: none)."""
    sizes = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
    n = struct.unpack(order + "H", read(at, 2))[0]
    entries, tags = read(at + 2, 12 * n + 4), {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", entries, 12 * i)
        if kind in sizes:
            code, size = sizes[kind]
            value = entries[12 * i + 8 : 12 * i + 12]
            if size * count > 4:
                value = read(struct.unpack(order + "I", value)[0], size * count)
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", value)
    return tags, struct.unpack_from(order + "I", entries, 12 * n)[0]


def tiff_pixels(read, tags: dict[int, tuple]) -> np.ndarray:
    """The grey image of a directory of uncompressed strips: 8 bits a sample, one sample (either polarity) or three a pixel."""
    width, height, samples = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    if tags.get(259, (1,))[0] != 1 or set(tags.get(258, (1,))) != {8} or samples not in (1, 3):
        raise ValueError("a TIFF frame of a kind that isn't read")
    raw = b"".join(read(o, c) for o, c in zip(tags[273], tags[279], strict=True))
    pixels = np.frombuffer(raw, np.uint8, width * height * samples).reshape(height, width, samples)
    gray = pixels[..., 0] if samples == 1 else (pixels @ np.array([299, 587, 114]) // 1000).astype(np.uint8)
    return 255 - gray if samples == 1 and tags.get(262, (1,))[0] == 0 else gray


def tiff_frames(data: bytes) -> list[np.ndarray]:
    """All frames of a TIFF as gray images (see tiff_pixels)."""

    def read(at: int, n: int) -> bytes:
        return data[at : at + n]

    order, at = tiff_order(read)
    frames = []
    while at:
        tags, at = tiff_directory(read, order, at)
        frames.append(tiff_pixels(read, tags))
    return frames


def image_frames(files: DataFrame, key: str = "path", content: str = "content", first_only: bool = False) -> DataFrame:
    """Frames of image files as PNG pages: key, frame (from 0), content; only the first where that is asked for."""
    kind = dict(files.dtypes)[key]

    def work(batches):
        for batch in batches:
            out = []
            for k, data in zip(batch[key], batch[content], strict=True):
                data = bytes(data)
                frames = [png_decode(data)] if data[:8] == b"\x89PNG\r\n\x1a\n" else tiff_frames(data)
                out += [(k, i, png_encode(f)) for i, f in enumerate(frames[:1] if first_only else frames)]
            yield pd.DataFrame(out, columns=[key, "frame", "content"])

    return files.select(key, content).mapInPandas(work, f"{key} {kind}, frame int, content binary")


def crop(gray: np.ndarray, box: tuple[int, int, int, int], pad: int = 8) -> np.ndarray:
    x, y, w, h = box
    return gray[max(0, y - pad) : max(0, y + h + pad), max(0, x - pad) : max(0, x + w + pad)]


def _runs(on: np.ndarray, gap: int = GAP) -> list[int]:
    at = np.flatnonzero(on)
    if not len(at):
        return []
    return [int(round((part[0] + part[-1]) / 2)) for part in np.split(at, np.flatnonzero(np.diff(at) > gap) + 1)]


def ruled_places(gray: np.ndarray, columns: float = 0.25, rows: float = 0.30, coverage: float = 0.50) -> list[tuple[int, int, list[int], bool]]:
    """Places (row, col, box) between the lines of a ruled table, and whether the separator to the right is missing, which is
    looked at in the head row."""
    dark = gray < DARK
    xs, ys = _runs(dark.mean(0) >= columns), _runs(dark.mean(1) >= rows)
    if len(xs) < 2 or len(ys) < 2:
        return []
    top, bottom = ys[0] + 4, ys[1] - 4
    bands = [dark[top:bottom, max(0, x - 3) : x + 4] for x in xs]
    missing = [bottom > top and band.size > 0 and band.mean(0).max() < coverage for band in bands]
    return [(r, c, [xs[c], ys[r], xs[c + 1] - xs[c], ys[r + 1] - ys[r]], bool(r == 0 and c + 2 < len(xs) and missing[c + 1])) for r in range(len(ys) - 1) for c in range(len(xs) - 1)]


def clean_page(gray: np.ndarray, level: int = 1, strip: bool = True, scale: int = 0, straight: bool = True, binary: bool = False, intent: str = "text", enlarge=None, angle: float | None = None) -> np.ndarray:
    """A page made ready for recognition: cleaned (not where the image itself is wanted), without streaks, enlarged, straightened, in
    black and white; each step only if it is asked for, in this order.  angle: that of its lines, where it is known already."""
    if intent != "image":
        gray = preclean(gray, level)
    if strip:
        gray = strip_vertical_lines(gray)
    gray = upscaled(gray, scale, enlarge)
    if straight:
        gray = deskew(gray) if angle is None else gray if angle == 0 else rotated(gray, angle)
    return binarize(gray) if binary else gray


def clean_pages(pages: DataFrame, content: str = "content", enabled: bool = True, angle: str | None = None, **steps) -> DataFrame:
    """PNG pages cleaned by clean_page(): a function of bytes and settings, by Arrow batches; as they are if it isn't enabled.

    angle: a column with the angle of a page's lines, if it was measured on the page as it is (null: it is measured)."""
    if not enabled:
        return pages

    @F.pandas_udf("binary")
    def clean(images: pd.Series, angles: pd.Series) -> pd.Series:
        return pd.Series([None if data is None else png_encode(clean_page(png_decode(data), angle=None if pd.isna(v) else v, **steps)) for data, v in zip(images, angles, strict=True)])

    return pages.withColumn(content, clean(content, F.col(angle) if angle else F.lit(None).cast("double")))


def spread(pages: DataFrame, key: str) -> DataFrame:
    """Pages dealt over as many tasks as shuffles have: an image takes longer than its few bytes tell, so that neither the files'
    sizes nor those of the shuffled rows are to decide."""
    return pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def page_assets(pages: DataFrame, source: str = "source", clean: str = "content", dpi: int = 300) -> DataFrame:
    """For each page (page, from 0) the files of its source image and of the image that was read: their names, contents and hashes."""
    number = F.format_string("%04d", (F.col("page") + 1).cast("long"))
    name = lambda kind: F.concat(F.lit("pages/page-"), number, F.lit(f".{kind}.png"))
    return pages.withColumns({"source_page_image": name("source"), "ocr_page_image": name("ocr"), "source_page_sha256": F.sha2(source, 256), "ocr_page_sha256": F.sha2(clean, 256), "raster_dpi": F.lit(dpi)})


def png_size(content: str):
    """Width and height of a PNG column, from its header (built-in functions)."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height"))).otherwise(F.struct(F.lit(0).alias("width"), F.lit(0).alias("height")))


def places_of(pages: DataFrame, id_col: str = "page_id", content: str = "content") -> DataFrame:
    """The places of the ruled table on each page, with what is joined to the right (see ruled_places)."""

    def work(frames):
        for frame in frames:
            out = [(i, *place, False) for i, data in zip(frame[id_col], frame[content], strict=True) if data is not None for place in ruled_places(png_decode(data))]
            yield pd.DataFrame(out, columns=[id_col, "row", "col", "box", "open_right", "open_down"])

    kind = dict(pages.dtypes)[id_col]
    return pages.select(id_col, content).mapInPandas(work, f"{id_col} {kind}, row int, col int, box array<int>, open_right boolean, open_down boolean")


def tables_of(pages: DataFrame, id_col: str = "page_id", content: str = "content") -> DataFrame:
    """Cells (row, col, rowspan, colspan, box) of the ruled table on each page; none if a joined cell isn't a rectangle."""
    grid = kept(places_of(pages, id_col, content), shared_folder(pages.sparkSession), "places")
    cells = tables(grid, id_col)
    corner = grid.select(id_col, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("box").alias("_last"))
    last = cells.join(grid.select(id_col, "row", "col", F.col("box").alias("_first")), [id_col, "row", "col"]).withColumn("_r", F.col("row") + F.col("rowspan") - 1).withColumn("_c", F.col("col") + F.col("colspan") - 1)
    whole = last.join(corner, [id_col, "_r", "_c"])
    x, y = F.col("_first")[0], F.col("_first")[1]
    box = F.array(x, y, F.col("_last")[0] + F.col("_last")[2] - x, F.col("_last")[1] + F.col("_last")[3] - y)
    return whole.select(id_col, "row", "col", "rowspan", "colspan", box.alias("box"))
