"""Frames: sampling, batches, copies, quality."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked

EVERY, BATCH, THRESHOLD, LINES = 3, 50, 0.65, 720
DARK, GAIN, LIFT, SIDE = 80.0, 1.5, 40.0, 224


def sample(frames: DataFrame, number: str, every: int = EVERY) -> DataFrame:
    return frames.where(F.col(number) % every == 0)


def batched(frames: DataFrame, job: str, order: list[str], size: int = BATCH) -> DataFrame:
    """batch_id and frame_index (place in the batch) of every frame; each job is numbered by itself, over as many tasks as it needs."""
    numbered = ranked(frames, [job], order, "_n")
    return numbered.withColumn("batch_id", F.floor(F.col("_n") / size)).withColumn("frame_index", F.col("_n") % size).drop("_n")


def copies(frames: DataFrame, scope: list[str], content: Column, index: str) -> DataFrame:
    """is_duplicate and duplicate_of_frame: the first frame of the scope with the same content.

    The first ones are found by grouping, which combines before it shuffles, and joined back, which can split a large group.
    Null contents are no copies of each other.
    """
    rows = frames.withColumn("_hash", F.sha2(content, 256))
    key = ["_hash", *scope]
    first = rows.groupBy(*(F.col(k).alias(f"_of_{k}") for k in key)).agg(F.min(index).alias("_first"))
    same = F.lit(True)
    for k in key:
        same = same & rows[k].eqNullSafe(first[f"_of_{k}"])
    out = rows.join(first, same, "left").withColumn("is_duplicate", F.col("_hash").isNotNull() & (F.col(index) > F.col("_first")))
    return out.withColumn("duplicate_of_frame", F.when(F.col("is_duplicate"), F.col("_first"))).select(*frames.columns, "is_duplicate", "duplicate_of_frame")


def labelled(confidence: Column, threshold: float = THRESHOLD) -> Column:
    """GOOD above the threshold, BAD up to it, null without a score."""
    return F.when(confidence > threshold, "GOOD").when(confidence.isNotNull(), "BAD")


def tall(height: Column, most: int = LINES) -> Column:
    """Whether a video must be scaled down before frames are taken."""
    return height > most


def existing(frames: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """The frames whose file is there."""
    return frames.join(files.select(path), path, "left_semi").select(frames.columns)


def counts(frames: DataFrame, *keys: str) -> DataFrame:
    return frames.groupBy(*keys).agg(F.count("*").alias("total_frames"), F.count_if(F.col("label") == "GOOD").alias("good_frames"), F.count_if(F.col("label") == "BAD").alias("bad_frames"), F.count_if(F.col("label").isNull()).alias("failed_frames"))


def named(frames: DataFrame, batches: DataFrame) -> DataFrame:
    """The frames of replies with the name of the frame they tell of, if there is one, else the name they gave themselves."""
    names = batches.select("job_id", "batch_id", "frame_index", F.col("filename").alias("_name"))
    given = F.col("actual_frame") if "actual_frame" in frames.columns else F.lit(None).cast("string")
    return frames.join(names, ["job_id", "batch_id", "frame_index"], "left").withColumn("actual_frame", F.coalesce("_name", given)).drop("_name")


def luminance(pixels: np.ndarray) -> float:
    """Mean of the rounded grey values of BGR pixels."""
    return float(np.rint(pixels[..., :3] @ np.array([0.114, 0.587, 0.299])).mean())


def grey_luminance(pixels: Column) -> Column:
    """luminance() of grey pictures, given as their grey values: equal parts of all channels make the value itself; null for null and empty."""
    return F.aggregate(pixels, F.lit(0).cast("long"), lambda total, x: total + x.cast("long")) / F.size(pixels)


def resized(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """side x side by linear interpolation between pixel centres, rounded; beyond the outer centres the edge counts on."""

    def along(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    (top, bottom, down), (left, right, across) = along(pixels.shape[0]), along(pixels.shape[1])
    p = pixels.astype(float)
    rows = p[top] * (1 - down)[:, None, None] + p[bottom] * down[:, None, None]
    return np.rint(rows[:, left] * (1 - across)[None, :, None] + rows[:, right] * across[None, :, None])


def prepared(pixels: np.ndarray) -> np.ndarray:
    """A dark picture is brightened; then SIDE x SIDE, 0 to 1."""
    if luminance(pixels) < DARK:
        pixels = np.clip(np.rint(np.abs(GAIN * pixels.astype(float) + LIFT)), 0, 255)
    return (resized(pixels) / 255).astype(np.float32)


def contrast_scorer(pixels: np.ndarray) -> float:
    """A stand-in for a trained model: a logistic of brightness and contrast."""
    return float(1 / (1 + np.exp(-(4 * pixels.mean() + 8 * pixels.std() - 3))))


def score(images: DataFrame, scorer: Callable[[np.ndarray], float | None] = contrast_scorer) -> DataFrame:
    """path, luminance, fingerprint, confidence, label, model of the rows of Spark's image source; undecodable ones have nulls.

    A scorer that has weights (`weights.Weights`) loads them on its first picture in a process and tells their version as
    model; one whose weights are missing gives null scores.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, w, n, data in zip(b.height, b.width, b.channels, b.data):
                if h <= 0 or n <= 0:
                    out.append((None, None, None))
                    continue
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, n)
                pixels = np.repeat(pixels, 3, axis=2) if n == 1 else pixels[..., :3]
                out.append((luminance(pixels), fingerprint(pixels), scorer(prepared(pixels))))
            rows = pd.DataFrame(out, columns=["luminance", "fingerprint", "confidence"]).astype({"luminance": "Float64", "fingerprint": "Int64", "confidence": "Float64"})
            yield rows.assign(path=b.path, model=getattr(scorer, "version", None))[["path", "luminance", "fingerprint", "confidence", "model"]]

    flat = images.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return flat.mapInPandas(run, "path string, luminance double, fingerprint bigint, confidence double, model string").withColumn("label", labelled(F.col("confidence")))


def fingerprint(pixels: np.ndarray) -> int:
    """64 bits of a picture that other sizes and compressions hardly change: whether each of 8 x 8 places is brighter than the one to its left."""
    grey = pixels[..., :3] @ np.array([0.114, 0.587, 0.299])
    rows, columns = (np.linspace(0, n, m + 1) for n, m in zip(grey.shape, (8, 9)))
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)

    def upto(at: np.ndarray, axis: int, held: np.ndarray) -> np.ndarray:
        """Sums up to places between pixels, which take their part of the pixel that they cut."""
        low = np.minimum(at.astype(int), held.shape[axis] - 2)
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        return held.take(low, axis) * (1 - part) + held.take(low + 1, axis) * part

    cells = np.diff(np.diff(upto(columns, 1, upto(rows, 0, total)), axis=0), axis=1) / np.outer(np.diff(rows), np.diff(columns))
    return int(np.packbits(cells[:, 1:] > cells[:, :-1]).view(">i8")[0])


#: Bits in which fingerprints of copies may differ, and pieces of a fingerprint: of as many, at least one is then equal.
NEAR, BANDS = 7, 8


def near_copies(frames: DataFrame, scope: list[str], index: str, bits: str = "fingerprint", most: int = NEAR) -> DataFrame:
    """is_duplicate and duplicate_of_frame by fingerprints: the first frame of the scope that differs in `most` bits at most.

    Fingerprints of a scope meet where one of BANDS pieces is equal, which none within BANDS - 1 bits can miss; equal ones
    are one row there. A frame is a copy of the earliest frame that is near it, itself aside; null fingerprints are no
    copies. Scopes are batches, so what meets in a piece is bounded by a batch.
    """
    if most >= BANDS:
        raise ValueError(f"{BANDS} pieces find all within {BANDS - 1} bits only")
    keys = [*scope, bits]
    one = frames.where(F.col(bits).isNotNull()).groupBy(*keys).agg(F.min(index).alias("_first"))
    width = 64 // BANDS
    piece = lambda i: F.shiftrightunsigned(F.col(bits), i * width).bitwiseAND((1 << width) - 1)
    cut = one.select("*", F.posexplode(F.array(*(piece(i) for i in range(BANDS)))).alias("_band", "_piece"))
    other = cut.select(*(F.col(c).alias(f"_o_{c}") for c in cut.columns))
    meet = (cut["_band"] == other["_o__band"]) & (cut["_piece"] == other["_o__piece"]) & (other["_o__first"] < cut["_first"])
    for k in scope:
        meet = meet & cut[k].eqNullSafe(other[f"_o_{k}"])
    near = cut.join(other, meet & (F.bit_count(cut[bits].bitwiseXOR(other[f"_o_{bits}"])) <= most))
    earliest = near.groupBy(*keys).agg(F.min("_o__first").alias("_of"))
    held = one.join(earliest, keys, "left") if not scope else one.alias("a").join(earliest.alias("b"), _same("a", "b", keys), "left").select("a.*", "b._of")
    held = held.withColumn("_of", F.coalesce("_of", "_first")).drop("_first").select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_of")
    same = F.lit(True)
    for k in keys:
        same = same & frames[k].eqNullSafe(held[f"_k_{k}"])
    copy = F.coalesce(F.col(index) > F.col("_of"), F.lit(False))
    return frames.join(held, same, "left").select(*frames.columns, copy.alias("is_duplicate"), F.when(copy, F.col("_of")).alias("duplicate_of_frame"))


def _same(a: str, b: str, keys: list[str]) -> Column:
    both = F.lit(True)
    for k in keys:
        both = both & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return both


def told_or_near(frames: DataFrame, scope: list[str], index: str) -> DataFrame:
    """near_copies() where the provider has told nothing: its own is_duplicate and duplicate_of_frame win where it is not null."""
    found = near_copies(frames.withColumnRenamed("is_duplicate", "_told").withColumnRenamed("duplicate_of_frame", "_told_of"), scope, index)
    told = F.col("_told").isNotNull()
    out = found.withColumn("is_duplicate", F.coalesce("_told", "is_duplicate")).withColumn("duplicate_of_frame", F.when(told, F.col("_told_of")).otherwise(F.col("duplicate_of_frame")))
    return out.select(frames.columns)
