"""Column expressions over ``array<double>`` vectors and probability rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_literal(values: Sequence[float]) -> Column:
    """A fixed vector as one foldable expression, so wide vectors do not become wide plans."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(arr: Column) -> Column:
    """Square root of the sum of squares; null elements make the norm null."""
    return F.sqrt(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x * x))


def euclidean(arr: Column, center: Sequence[float]) -> Column:
    """Distance of a vector column to a fixed vector."""
    fixed = vector_literal(center)
    return l2_norm(F.zip_with(arr, fixed, lambda x, c: x - c))


def center_distances(arr: Column, centers: Sequence[Sequence[float]]) -> Column:
    """Distances of a vector column to each of a few fixed centres."""
    return F.array(*[euclidean(arr, c) for c in centers])


def min_distance(dists: Column) -> Column:
    return F.array_min(dists)


def nearest_index(dists: Column) -> Column:
    """0-based index of the smallest distance, the first on ties."""
    return (F.array_position(dists, F.array_min(dists)) - 1).cast("int")


def distance_softmax(dists: Column) -> Column:
    """exp(min d - d) scaled to sum 1."""
    low = F.array_min(dists)
    raw = F.transform(dists, lambda d: F.exp(low - d))
    return F.transform(raw, lambda e: e / array_sum(raw))


def argmax_class(probs: Column) -> Column:
    """0-based index of the largest probability, the first on ties."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def clip_renormalize(probs: Column) -> Column:
    """Negative entries become 0, then the row is scaled to sum 1 (null for an all-zero row)."""
    clipped = F.transform(probs, lambda p: F.greatest(p, F.lit(0.0)))
    return F.transform(clipped, lambda p: p / F.nullif(array_sum(clipped), F.lit(0.0)))


def ordinal_probabilities(cum: Sequence[Column]) -> Column:
    """Class probabilities from P(y > class i), clipped and renormalised.

    The number of classes is known, so this is plain arithmetic inside generated
    code rather than a lambda over an array.
    """
    cum = list(cum)
    parts = [F.lit(1.0) - cum[0]]
    parts += [cum[i - 1] - cum[i] for i in range(1, len(cum))]
    parts.append(cum[-1])
    clipped = [F.greatest(p, F.lit(0.0)) for p in parts]
    total = clipped[0]
    for p in clipped[1:]:
        total = total + p
    return F.array(*[p / F.nullif(total, F.lit(0.0)) for p in clipped])


def threshold_decode(cum: Sequence[Column]) -> Column:
    """Number of cumulative probabilities above one half."""
    total = F.lit(0)
    for c in cum:
        total = total + (c > 0.5).cast("int")
    return total


def row_topk_classes(probs: Column, k: int) -> Column:
    """The k most probable (class, prob) pairs of a row, most probable first."""
    pairs = F.transform(probs, lambda p, i: F.struct((-p).alias("neg"), i.alias("class"), p.alias("prob")))
    ordered = F.slice(F.array_sort(pairs), 1, k)
    return F.transform(ordered, lambda s: F.struct(s["class"].alias("class"), s["prob"].alias("prob")))


def zero_to_null_array(arr: Column) -> Column:
    """Zeros mean missing in a description block."""
    return F.transform(arr, lambda x: F.nullif(x, F.lit(0.0)))


def fill_array(arr: Column, fill: Sequence[float]) -> Column:
    """Replace null elements by position."""
    fixed = vector_literal(fill)
    return F.zip_with(arr, fixed, lambda x, m: F.coalesce(x, m))


def scale_array(arr: Column, mean: Sequence[float], scale: Sequence[float]) -> Column:
    """(x - mean) / scale by position."""
    shift = vector_literal(mean)
    width = vector_literal(scale)
    return F.zip_with(F.zip_with(arr, shift, lambda x, m: x - m), width, lambda x, s: x / s)
