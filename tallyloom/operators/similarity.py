"""Scores of embeddings against prompt vectors, and of two embedding sets against each other.

Prompt vectors are an argument of these functions: a checked, short list, as the prompts of a
classifier are.  They travel with the task, so images are never joined to prompts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.joins import bounded_rows
from tallyloom.operators.ordered import positions
from tallyloom.session import staged

MAX_PROMPTS = 4096
MAX_SIZE = 4096  # components of a vector whose covariances are taken
SCALE = 100.0
SLICE = 1024  # vectors that are multiplied with a block of prompts at once


def prompt_list(prompts: DataFrame, name: str, vector: str, limit: int = MAX_PROMPTS) -> list[tuple]:
    """The prompts as sorted (name, vector) pairs; a table with more than ``limit`` is refused."""
    rows = bounded_rows(prompts.select(name, vector), limit, "prompts")
    return sorted((row[0], [float(x) for x in row[1]]) for row in rows)


def l2_normalise(vector: Column) -> Column:
    """Divide by the length; a zero vector stays as it is."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(doubles, lambda x: x / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm > 0, norm, 1.0)


def cosine_to(vector: Column, prompts: Sequence[tuple]) -> Column:
    """Cosine to every prompt, in prompt order, as one matrix product per batch of rows."""
    right = _unit(np.array([v for _, v in prompts], dtype="float64")).T

    @F.pandas_udf("array<double>")
    def cosine(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(_unit(np.stack(batch.to_numpy()).astype("float64")) @ right))

    return cosine(vector)


def similarities(images: DataFrame, vector: str, prompts: Sequence[tuple]) -> DataFrame:
    """The scaled similarity matrix in long form: one row per image and prompt."""
    names = F.array(*[F.lit(n) for n, _ in prompts])
    rest = [c for c in images.columns if c != vector]
    scored = images.select(*rest, F.posexplode(cosine_to(F.col(vector), prompts)).alias("__i", "__cos"))
    return scored.select(*rest, F.get(names, F.col("__i")).alias("prompt"), (F.col("__cos") * SCALE).alias("similarity"))


def best_prompt(images: DataFrame, vector: str, prompts: Sequence[tuple]) -> DataFrame:
    """The closest prompt of each image; at a tie the first."""
    names = F.array(*[F.lit(n) for n, _ in prompts])
    rest = [c for c in images.columns if c != vector]
    scored = images.select(*rest, cosine_to(F.col(vector), prompts).alias("__cos"))
    best = F.array_max("__cos")
    at = F.array_position("__cos", best).cast("int") - 1
    return scored.select(*rest, F.get(names, at).alias("prompt"), best.alias("cosine"))


def closest(vectors: np.ndarray, prompts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the closest prompt of each vector, at a tie the first, and its cosine."""
    right = _unit(np.stack(prompts).astype("float64")).T
    at, best = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    for start in range(0, len(vectors), SLICE):
        cosine = _unit(np.stack(vectors[start : start + SLICE]).astype("float64")) @ right
        found = cosine.argmax(axis=1)
        at[start : start + SLICE], best[start : start + SLICE] = found, cosine[np.arange(len(found)), found]
    return at, best


def best_of_many(
    images: DataFrame, key: str, vector: str, prompts: DataFrame, name: str, prompt_vector: str, block: int = 1024, rows: int = 1 << 14
) -> DataFrame:
    """The closest prompt of each image (key, prompt, cosine), for prompt tables of any size; at a tie the first.

    Blocks of prompts meet chunks of images, whose sizes do not depend on the tables.  A chunk's products
    are made slice by slice, and of each only the best prompt per image is kept.
    """
    numbered, seen = staged(positions(prompts.select(F.col(name).alias("prompt"), F.col(prompt_vector).alias("p")), ["prompt"], "n"), "prompts", n=F.count(F.lit(1)))
    n_blocks = max(1, -(-seen["n"] // block))
    n_chunks = max(1, -(-images.count() // rows))
    left = images.select(
        F.col(key).alias("key"),
        F.col(vector).alias("v"),
        F.pmod(F.xxhash64(key), F.lit(n_chunks)).alias("chunk"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"),
    )
    right = numbered.select(
        "prompt",
        "p",
        F.floor((F.col("n") - 1) / block).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long"))).alias("chunk"),
    )
    kind = images.schema[key].dataType.simpleString()
    text = prompts.schema[name].dataType.simpleString()

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"key": a["key"][:0], "prompt": b["prompt"][:0], "cosine": pd.Series([], dtype="float64")})
        b = b.sort_values("prompt")
        at, cosine = closest(a["v"].to_numpy(), b["p"].to_numpy())
        return pd.DataFrame({"key": a["key"].to_numpy(), "prompt": b["prompt"].to_numpy()[at], "cosine": cosine})

    met = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(product, f"key {kind}, prompt {text}, cosine double")
    best = met.groupBy("key").agg(F.min_by(F.struct("prompt", "cosine"), F.struct(-F.col("cosine"), F.col("prompt"))).alias("b"))
    return best.select(F.col("key").alias(key), "b.prompt", "b.cosine")


def unit_score(cosine: Column) -> Column:
    """A cosine moved to the range 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine + 1) / 2))


def style_score(images: DataFrame, vector: str, prompts: Sequence[tuple]) -> DataFrame:
    """Mean best similarity over all images, as loss and as score from 0 to 1."""
    mean = F.avg("cosine")
    return best_prompt(images, vector, prompts).agg((-SCALE * mean).alias("style_loss"), unit_score(mean).alias("style_score"))


def class_probabilities(images: DataFrame, vector: str, prompts: Sequence[tuple]) -> DataFrame:
    """Zero-shot class probabilities: softmax over the scaled similarities, with the best class."""
    names = F.array(*[F.lit(n) for n, _ in prompts])
    rest = [c for c in images.columns if c != vector]
    scored = images.select(*rest, cosine_to(F.col(vector), prompts).alias("__cos"))
    top = F.array_max("__cos")
    raised = scored.withColumn("__exp", F.transform("__cos", lambda c: F.exp(SCALE * (c - top))))
    total = F.aggregate("__exp", F.lit(0.0), lambda acc, x: acc + x)
    probs = raised.withColumn("probabilities", F.transform("__exp", lambda x: x / total))
    at = F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1
    return probs.select(*rest, F.get(names, at).alias("predicted"), "probabilities")


def entropy(probabilities: Column) -> Column:
    return F.aggregate(
        probabilities, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))
    )


def combine(parts: dict[str, float]) -> Column:
    """A weighted sum of component columns; a missing component adds nothing."""
    total = F.lit(0.0)
    for name, weight in parts.items():
        total = total + F.lit(weight) * F.coalesce(F.col(name), F.lit(0.0))
    return total


def evasion_score(images: DataFrame, detections: DataFrame, target: int) -> DataFrame:
    """Total confidence of one class per image, 0 for images without such a detection."""
    found = detections.where(F.col("cls") == target).groupBy("image_id").agg(F.sum("conf").alias("__c"))
    return images.join(found, "image_id", "left").withColumn("evasion", F.coalesce("__c", F.lit(0.0))).drop("__c")


def combined_score(evasion: Column, style: Column, suspicion: Column) -> Column:
    """Evasion times style, less for suspicious images (documented only)."""
    return evasion * style / (1 + suspicion)


def _checked(vector: Column, size: Column) -> Column:
    """The vector, or an error if it is longer than ``MAX_SIZE`` or not of the given size."""
    fits = (F.size(vector) == size) & (size <= MAX_SIZE)
    return F.when(fits, vector).otherwise(F.raise_error(F.lit(f"vectors must be of one size, at most {MAX_SIZE}")).cast("array<double>"))


def moments(df: DataFrame, vector: str) -> tuple[DataFrame, DataFrame]:
    """Means (i, n, mean) and sample covariances (i, j, covariance; j <= i) of the components of vectors.

    The means come first.  Products are then summed of differences to them, so a large common offset
    does not cancel digits; tasks send one sum per pair of components.
    """
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    given = df.where(F.col(vector).isNotNull()).select(doubles.alias("v"))
    size = given.agg(F.max(F.size("v"))).scalar()
    given = given.select(_checked(F.col("v"), size).alias("v"))
    means = given.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    pairs = F.sort_array(F.collect_list(F.struct("i", "mean")))
    centre = means.agg(F.transform(pairs, lambda p: p["mean"])).scalar()
    moved = given.withColumn("centre", centre).select(F.zip_with("v", "centre", lambda x, m: x - m).alias("v"))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, None
        for batch in batches:
            if batch.empty:
                continue
            m = np.stack(batch["v"].to_numpy()).astype("float64")
            n, total = n + len(m), m.T @ m if total is None else total + m.T @ m
        if n:
            i, j = np.tril_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "n": n, "sum": total[i, j]})

    sums = moved.mapInPandas(add_up, "i int, j int, n long, sum double").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    return means, sums.select("i", "j", (F.col("sum") / F.greatest(F.col("n") - 1, F.lit(1))).alias("covariance"))


def frechet_distance(left: DataFrame, right: DataFrame, vector: str) -> DataFrame:
    """Distance between the normal distributions of two embedding sets (documented only).

    Only the means and covariances of both sets meet in the last step: a number per pair of components, of
    which there are at most ``MAX_SIZE`` squared.
    """
    parts = []
    for side, df in (("left", left), ("right", right)):
        means, covariances = moments(df, vector)
        parts += [
            means.select(F.lit(side).alias("side"), "i", F.lit(-1).alias("j"), F.col("mean").alias("value")),
            covariances.select(F.lit(side).alias("side"), "i", "j", F.col("covariance").alias("value")),
        ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)

    def finish(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        stats = {}
        for side, s in part.groupby("side"):
            mean = s.loc[s.j < 0].sort_values("i")["value"].to_numpy()
            pairs = s.loc[s.j >= 0]
            covariance = np.zeros((len(mean), len(mean)))
            covariance[pairs.i, pairs.j] = covariance[pairs.j, pairs.i] = pairs["value"]
            stats[side] = (mean, covariance)
        if len(stats) < 2:
            return pd.DataFrame({"distance": [float("nan")]})
        (m1, c1), (m2, c2) = stats["left"], stats["right"]
        roots = np.sqrt(np.clip(np.linalg.eigvals(c1 @ c2).real, 0, None)).sum()
        value = ((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * roots
        return pd.DataFrame({"distance": [float(max(value, 0.0))]})

    return rows.groupBy(F.lit(0).alias("all")).applyInPandas(finish, "distance double")
