"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact reranking.

Unit vectors are centred and turned into the axes of their largest variance, then
by a rotation that brings them close to the corners of a cube (alternating signs
and the orthogonal Procrustes problem); their signs are balanced binary codes. A
code is cut into substrings, one table each. Vectors that share a substring meet
in a bucket, where the cosine of the original vectors decides. Centring
widens angles, most of all between vectors close to the mean: the number of
tables follows from the widest angle of a pair outside a radius around the mean,
and vectors within it are compared with all that can be similar to them.

Equal vectors are one row with a weight from the start. A bucket is a bounded
amount of work: large ones are dealt into blocks of about BLOCK rows, and each
pair of blocks is a unit of its own. Units return, per vector, a number of links
and the smallest id it is connected with there, not pairs; a pair that meets in
several tables counts in the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.components import components
from lexmill.llm.vectors import sample_matrix, stack, usable_rows, vector_id
from lexmill.storage import materialize

SAMPLE_ROWS = 4096
ITERATIONS = 30
MISS = 0.01  # wanted share of missed links at the threshold itself
MOST_TABLES = 400
BUCKET_ROWS = 256
BLOCK = 1024
# Cosines this close to the threshold are computed again in one fixed order of additions.
CLOSE = 1e-9


@dataclass
class Codes:
    """Binary codes: bit i is the sign of the i-th coordinate of (x - mean) @ axes."""

    mean: np.ndarray
    axes: np.ndarray  # dimensions x bits
    width: int  # bits per substring
    radius: float = 0.0  # vectors closer to the mean are central: the codes promise nothing for them
    chord: float = 0.0  # distance of two unit vectors at the threshold

    @property
    def tables(self) -> int:
        return self.axes.shape[1] // self.width

    def nearness(self, unit: np.ndarray) -> np.ndarray:
        """2 for central vectors, 1 for others that can be similar to a central one, else 0."""
        far = np.linalg.norm(unit - self.mean, axis=1)
        return (far < self.radius).astype(np.int64) + ((self.radius > 0) & (far < self.radius + self.chord + CLOSE))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Substrings as whole numbers, one column per table."""
        bits = ((unit - self.mean) @ self.axes > 0).reshape(len(unit), -1, self.width)
        return bits @ (1 << np.arange(self.width, dtype=np.int64))


def quantisation(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Axes whose signs are balanced codes of the centred rows of ``x``, by iterative quantisation."""
    _, turned = np.linalg.eigh(x.T @ x)
    turned = turned[:, ::-1]
    v = x @ turned
    rotation = np.linalg.qr(rng.normal(size=(x.shape[1],) * 2))[0]
    for _ in range(ITERATIONS):
        a, _, b = np.linalg.svd(np.where(v @ rotation > 0, 1.0, -1.0).T @ v)
        rotation = (a @ b).T
    return turned @ rotation


def fit_codes(sample: np.ndarray, n: int, cosine: float, seed: int = 3) -> Codes:
    """Codes for ``n`` vectors: substrings long enough for buckets of BUCKET_ROWS, and enough of them.

    Two vectors agree in a bit with probability 1 - angle / pi, seen from the
    mean. Of pairs at the threshold outside a radius around the mean, the widest
    angle is that of two vectors on its edge. The radius is the one with the
    least work: a smaller one needs more tables, a larger one has more central
    vectors to compare. No unit vector is closer to the mean than 1 - |mean|.
    """
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    width = min(max(8, math.ceil(math.log2(max(n, 2) / BUCKET_ROWS))), 40)
    chord = math.sqrt(2 * (1 - cosine))
    far = np.sort(np.linalg.norm(unit - mean, axis=1))

    def tables_outside(radius: float) -> int:
        met = (1 - 2 * math.asin(min(1.0, chord / 2 / radius)) / math.pi) ** width
        return math.ceil(math.log(MISS) / math.log1p(-met)) if met > MISS / MOST_TABLES else MOST_TABLES + 1

    # (work, tables, radius), in comparisons; without tables that suffice all pairs are compared
    plans = [(float(n) * n, 1, 3.0)]
    free = 1 - float(np.linalg.norm(mean))
    if free > CLOSE and (tables := tables_outside(free)) <= MOST_TABLES:
        plans.append((float(n) * BUCKET_ROWS * tables, tables, 0.0))
    for radius in np.unique(far[:: max(1, len(far) // 256)]):
        if radius > CLOSE and (tables := tables_outside(radius)) <= MOST_TABLES:
            central, near = (np.searchsorted(far, x, "right") / len(far) for x in (radius, radius + chord))
            plans.append((float(n) * BUCKET_ROWS * (tables + 1) + float(n) * n * central * near, tables, float(radius)))
    _, tables, radius = min(plans)
    rng = np.random.default_rng(seed)
    axes = [quantisation(unit - mean, rng) for _ in range(math.ceil(width * tables / unit.shape[1]))]
    return Codes(mean, np.hstack(axes)[:, : width * tables], width, radius, chord)


def unit_links(f: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links within one unit: for each vector with any, their weight counted here and the smallest id connected."""
    table, i, j = (int(f[c].iloc[0]) for c in ("table", "i", "j"))
    f = f.sort_values("vec_id")
    x, ids, weight, keys, block = stack(f["v"]), f["vec_id"].to_numpy(), f["weight"].to_numpy(), stack(f["keys"])[:, :table], f["block"].to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T
    near = np.abs(c - cosine) < CLOSE
    for a, b in zip(*np.nonzero(near)):
        c[a, b] = (x[a] * x[b]).sum()
    link = c >= cosine
    np.fill_diagonal(link, False)
    if i != j:  # pairs within a block have a unit of their own
        link &= block[:, None] != block[None, :]
    some = np.flatnonzero(link.any(axis=1))
    link, ids, weight, keys = link[np.ix_(some, some)], ids[some], weight[some], keys[some]
    counted = link.copy()
    for t in range(table):
        counted &= keys[:, t][:, None] != keys[:, t][None, :]
    label = np.arange(len(ids))  # ids are sorted: the first place is the smallest id
    while len(ids):
        least = np.minimum(label, np.where(link, label[None, :], len(ids)).min(axis=1))
        if (least == label).all():
            break
        label = least
    return pd.DataFrame({"vec_id": ids, "n": counted @ weight, "least": ids[label]})


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``df``; ids are whole numbers.

    n_links counts the other vectors linked directly, component_id is the
    smallest id reachable by links, kept marks the row that has it. Vectors that
    are null, zero, of another length than most, or have null or non-finite
    components link with nothing. Repeated rows count once and get the same
    result each; rows that share an id but not the vector are one vector that
    has the links of both. Rows with a null id link with nothing, have a null
    component_id and are not kept. Other columns are left out; an empty table
    gives an empty result.
    """
    rows = df.select(df[id_col].cast("bigint").alias("vec_id"))
    vectors = usable_rows(df, id_col, vector_col).withColumn("key", vector_id(F.col("v")))
    classes = vectors.groupBy("key", "vec_id").agg(F.first("v").alias("v")).groupBy("key").agg(
        F.min("vec_id").alias("class"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")
    )
    classes = materialize(classes, "vector_classes")
    n = classes.count()
    members = materialize(vectors.join(classes.select("key", "class", "weight"), "key").select("vec_id", "class", "weight").distinct(), "vector_members")
    sample = sample_matrix(classes.select(F.col("class").alias("vec_id"), "v"), SAMPLE_ROWS, seed)
    if n < 2:
        counts, links = members.select(F.col("class").alias("id"), F.lit(0).cast("bigint").alias("n")).limit(0), members.select(F.col("class").alias("a"), F.col("class").alias("b")).limit(0)
    else:
        found = materialize(_linked(classes, fit_codes(sample, n, cosine, seed), cosine), "vector_links")
        counts = found.groupBy(F.col("vec_id").alias("id")).agg(F.sum("n").alias("n"))
        links = found.select(F.col("vec_id").alias("a"), F.col("least").alias("b"))
    # equal vectors are linked; so are the classes of an id that has several vectors
    same = members.filter("vec_id <> class").select(F.col("vec_id").alias("a"), F.col("class").alias("b"))
    merged = components(links.unionByName(same))
    per_id = members.join(counts, F.col("class") == F.col("id"), "left").groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    result = rows.join(per_id, "vec_id", "left").join(merged, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def _linked(classes: DataFrame, codes: Codes, cosine: float) -> DataFrame:
    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = stack(f["v"])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            f["keys"] = list(codes.keys(x) if len(f) else [])
            f["near"] = codes.nearness(x) if len(f) else []
            yield f

    # written, so that both uses below see the same rows
    with_keys = classes.select(F.col("class").alias("vec_id"), "weight", "v")
    with_keys = materialize(with_keys.mapInPandas(coded, "vec_id long, weight long, v array<double>, keys array<long>, near long"), "vector_codes")
    posted = with_keys.select("*", F.posexplode("keys").alias("table", "bucket"))
    sizes = with_keys.select(F.posexplode("keys").alias("table", "bucket")).groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    placed = posted.join(sizes, ["table", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = placed.select("vec_id", "weight", "v", "keys", "table", "bucket", "block", other)
    central = _central_units(with_keys, codes.tables) if codes.radius > 0 else None
    units = units.unionByName(central) if central is not None else units
    units = units.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return units.groupBy("table", "bucket", "i", "j").applyInPandas(lambda f: unit_links(f, cosine), "vec_id long, n long, least long")


def _central_units(with_keys: DataFrame, tables: int) -> DataFrame | None:
    """A further table in which blocks of central vectors meet each other and those of all that can be similar to them."""
    n = with_keys.agg(F.count_if(F.expr("near = 2")), F.count_if(F.expr("near = 1"))).first()
    inner, outer = (math.ceil(k / BLOCK) for k in n)
    if not inner:
        return None
    place, blocks = F.xxhash64("vec_id"), lambda first, k: F.sequence(F.lit(first), F.lit(first + k - 1))
    is_central = F.col("near") == 2
    block = F.when(is_central, F.pmod(place, F.lit(inner))).otherwise(F.pmod(place, F.lit(max(outer, 1))) + inner).cast("int")
    other = F.when(is_central, blocks(0, inner + outer)).otherwise(blocks(0, inner))
    return with_keys.filter("near > 0").select(
        "vec_id", "weight", "v", "keys", F.lit(tables).alias("table"), F.lit(0).cast("long").alias("bucket"), block.alias("block"), F.explode(other).alias("other")
    )
