"""Embedding near-dedup: exact cosine links by a tiled comparison in PCA order.

Vectors are turned into the principal axes of all of them, largest first. Two blocks of vectors are compared on
the leading axes alone; what the others can still add is at most the product of the two suffixes' norms, and
pairs that can't reach the threshold stop there. The rest go on by further axes, and pairs that are left are decided
by their whole cosine in double precision. No pair at or above the threshold is lost.

Vectors are made distinct first (copies link with each other and share their links). They are ordered along a
Hilbert curve of the leading axes and cut into groups; groups whose boxes on the leading axes lie farther apart than
the threshold allows are never brought together. Each pair of groups that are is one bounded piece of
work. A piece reports sums of links per vector and enough links to hold its parts together, never all pairs.

Rows without an id, and null, empty or zero vectors, or those with null or non-finite components, link with
nothing: no links, and their own id as component (kept; without an id: null, not kept). Vectors of different
lengths link with none of another length. Rows repeated in full count as one vector. If an id has
several vectors, their links are taken together. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import land
from plumbline.llm.components import connected_components
from plumbline.llm.packing import hilbert_keys

THRESHOLD = 0.9
# Leading axes that groups' boxes and the first comparison use, and axes added at each further step.
LEAD = 16
# Vectors of a group, and the most groups: beyond, groups grow.
GROUP_ROWS = 4096
MOST_GROUPS = 2048
TILE = 1024
CURVE_AXES, CURVE_BITS = 4, 10
# More than rounding can move a sum of products of unit vectors: in single and in double precision.
_SLACK, _FINE = 1e-4, 1e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<f8") for v in values])


@F.pandas_udf(T.BinaryType())
def _packed(values: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(v, "<f8").tobytes() for v in values], dtype=object)


def distinct_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(node, copies, dim, vector) of comparable vectors, each once; node is its smallest id."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(_comparable()).distinct().groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")).select(
        "node", "copies", F.size("v").alias("dim"), _packed("v").alias("vector"), "v"
    )


def _comparable():
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Axes in columns, largest first. The driver gets dim x dim sums, whatever the number of vectors."""

    def products(batches):
        total = np.zeros((dim, dim))
        for rows in batches:
            if len(rows):
                u = _unit(_matrix(rows["vector"]))
                total += u.T @ u
        i, j = np.indices((dim, dim))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    sums = vectors.select("vector").mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    matrix = np.zeros((dim, dim))
    for r in sums.collect():
        matrix[r["i"], r["j"]] = r["s"]
    values, axes = np.linalg.eigh((matrix + matrix.T) / 2)
    return np.ascontiguousarray(axes[:, np.argsort(-values, kind="stable")])


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the smallest node of its part under links (a, b)."""
    part = np.arange(n)
    while True:
        low = np.minimum(part[a], part[b])
        before = part.copy()
        np.minimum.at(part, a, low)
        np.minimum.at(part, b, low)
        part = part[part]
        if (part == before).all():
            return part


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of unit rows of ``a`` and ``b``, given in PCA order, with cosine at or above the threshold."""
    dim = a.shape[1]
    cuts = [*range(min(lead, dim), dim, lead), dim]

    def suffix(rows, cut):
        return np.sqrt(np.maximum((rows[:, cut:] ** 2).sum(axis=1), 0))

    # the norms of what is left are one more axis: one product gives the sum so far plus its greatest rest
    cut = cuts[0]
    head_a = np.column_stack([a[:, :cut], suffix(a, cut)]).astype(np.float32)
    head_b = np.column_stack([b[:, :cut], suffix(b, cut)]).astype(np.float32)
    i, j = np.nonzero(head_a @ head_b.T >= threshold - _SLACK)
    if len(i) * 4 > len(a) * len(b):  # nearly all go on: whole products are cheaper than picking
        whole = a @ b.T
        return np.nonzero(whole >= threshold - _FINE)
    so_far = np.einsum("ij,ij->i", a[i, :cut], b[j, :cut])
    for start, stop in zip(cuts, cuts[1:]):
        so_far += np.einsum("ij,ij->i", a[i, start:stop], b[j, start:stop])
        can = so_far + suffix(a, stop)[i] * suffix(b, stop)[j] >= threshold - _FINE
        i, j, so_far = i[can], j[can], so_far[can]
    keep = so_far >= threshold - _FINE
    return i[keep], j[keep]


def _compare(axes: np.ndarray, threshold: float):
    def links(key, rows):
        rows = rows.sort_values("node", kind="stable")
        one, two = rows["one"].iloc[0], rows["two"].iloc[0]
        raw = _matrix(rows["vector"])
        turned = _unit(raw) @ axes
        group, nodes, copies = (rows[c].to_numpy() for c in ("group", "node", "copies"))
        first, second = np.flatnonzero(group == one), np.flatnonzero(group == two)
        counts = np.zeros(len(rows))
        part = np.arange(len(rows))
        for x in range(0, len(first), TILE):
            p = first[x : x + TILE]
            for y in range(x if one == two else 0, len(second), TILE):
                q = second[y : y + TILE]
                i, j = tile_links(turned[p], turned[q], threshold)
                i, j = p[i], q[j]
                if one == two:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                near = _exact(raw, i, j, threshold)
                i, j = i[near], j[near]
                counts += np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
                part = _parts(len(rows), np.concatenate([i, np.arange(len(rows))]), np.concatenate([j, part]))
        linked, tied = np.flatnonzero(counts), np.flatnonzero(part != np.arange(len(rows)))
        return pd.DataFrame(
            {
                "a": np.concatenate([nodes[linked], nodes[tied]]),
                "b": pd.array(np.concatenate([nodes[linked], nodes[part[tied]]]), "Int64"),
                "n": np.concatenate([counts[linked].astype(np.int64), np.zeros(len(tied), np.int64)]),
            }
        )

    return links


def _exact(raw: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold by their own vectors' cosine in double precision."""
    near = np.empty(len(i), bool)
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    norms = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        near[at : at + (1 << 16)] = np.einsum("ij,ij->i", scaled[p], scaled[q]) / (norms[p] * norms[q]) >= threshold
    return near


def _grouped(vectors: DataFrame, axes: np.ndarray, group_rows: int) -> tuple[DataFrame, int]:
    """The vectors with their group: even cuts of the curve through the leading axes."""
    n = vectors.count()
    groups = max(1, min(MOST_GROUPS, -(-n // group_rows)))

    def places(batches):
        for rows in batches:
            if not len(rows):
                continue
            lead = _unit(_matrix(rows["vector"])) @ axes[:, :CURVE_AXES]
            cells = np.clip((lead + 1) / 2 * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.int64)
            yield rows.assign(place=hilbert_keys(cells, CURVE_BITS))

    placed = vectors.mapInPandas(places, "node long, copies long, vector binary, place long")
    # a fraction from a hash parts vectors of one cell, so a cell is cut like any other stretch
    placed = land(placed.withColumn("place", F.col("place") + F.pmod(F.xxhash64("vector"), F.lit(4093)) / 4093))
    if groups == 1:
        return placed.withColumn("group", F.lit(0)), 1
    cuts = placed.approxQuantile("place", [k / groups for k in range(1, groups)], 0.05 / groups)

    @F.pandas_udf("int")
    def group(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, place, side="right").astype(np.int32))

    return placed.withColumn("group", group("place")), groups


def _meetings(grouped: DataFrame, axes: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """(group, one, two) for every pair of groups whose boxes on the leading axes are near enough.

    The driver gets two numbers per group and leading axis, of at most MOST_GROUPS groups.
    """
    lead = min(LEAD, axes.shape[0])

    def boxes(batches):
        low, high = {}, {}
        for rows in batches:
            if not len(rows):
                continue
            turned = _unit(_matrix(rows["vector"])) @ axes[:, :lead]
            for g in np.unique(rows["group"]):
                own = turned[rows["group"].to_numpy() == g]
                low[g] = np.minimum(low.get(g, np.inf), own.min(axis=0))
                high[g] = np.maximum(high.get(g, -np.inf), own.max(axis=0))
        for g in low:
            yield pd.DataFrame({"group": [g] * lead, "axis": range(lead), "low": low[g], "high": high[g]})

    found = (
        grouped.select("group", "vector")
        .mapInPandas(boxes, "group int, axis int, low double, high double")
        .groupBy("group", "axis")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .collect()
    )
    ids = sorted({r["group"] for r in found})
    at = {g: k for k, g in enumerate(ids)}
    low, high = np.zeros((len(ids), lead)), np.zeros((len(ids), lead))
    for r in found:
        low[at[r["group"]], r["axis"]], high[at[r["group"]], r["axis"]] = r["low"], r["high"]
    out = []
    for k, g in enumerate(ids):
        gap = np.maximum(0, np.maximum(low[k] - high[k:], low[k:] - high[k]))
        for h in np.flatnonzero((gap**2).sum(axis=1) <= 2 - 2 * threshold + _FINE) + k:
            out += [(g, g, ids[h])] if h == k else [(g, g, ids[h]), (ids[h], g, ids[h])]
    return out


def vector_links(vectors: DataFrame, dim: int, threshold: float, group_rows: int) -> DataFrame:
    """(a, b, n): a = b with n, a part of the links of a; or b, which is in one component with a."""
    own = vectors.where(F.col("dim") == dim).select("node", "copies", "vector")
    axes = principal_axes(own, dim)
    grouped, _ = _grouped(own, axes, group_rows)
    pairs = own.sparkSession.createDataFrame(_meetings(grouped, axes, threshold), "group int, one int, two int")
    met = grouped.select("node", "copies", "vector", "group").join(F.broadcast(pairs), "group")
    return met.groupBy("one", "two").applyInPandas(_compare(axes, threshold), "a long, b long, n long")


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``df``."""
    vectors = land(distinct_vectors(df, id_col, vector_col))
    dims = sorted(r["dim"] for r in vectors.select("dim").distinct().collect())
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    found = None
    for dim in dims:
        part = vector_links(vectors, dim, threshold, group_rows)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = land(found)
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("a != b").select("a", "b"))
    placed = (
        vectors.select("node", "copies", "v")
        .join(links, "node", "left")
        .join(parts, "node", "left")
        .select(
            F.col("v").alias("d"),
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    known = rows.where(_comparable()).join(placed, F.col("v") == F.col("d")).select("vec_id", "n_links", "component_id")
    alone = rows.where(~_comparable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = known.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
