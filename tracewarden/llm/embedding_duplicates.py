"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Every tree splits a set of vectors at the median of their projections on a random direction; vectors
nearer to the median than the spill margin go to both sides.  A pair just inside the threshold is parted
by a split only if its projections lie on different sides of that margin, with a probability of ``PARTED``, and
then still has the other trees; the deeper the trees must be for the largest label, the more of them there are, so that
such a pair is lost with a probability of ``LOST`` at any size.  Sets are split until they have ``LEAF`` vectors.  A split is made only if a
quarter of the set lies beyond the margin on either side; a set that no direction parts so is a dense cluster
and stays whole.

Equal vectors count as one with a weight.  Within a leaf all vectors are compared, in blocks of ``BLOCK``.
A pair that meets in several leaves counts in the first of them only, so link counts are sums over leaves
and no pair is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import graph
from tracewarden.llm.common import materialize, release, ship

COSINE = 0.93
LEVELS, LEAF, BLOCK = 24, 1024, 1024
#: The spill margin in standard deviations of the projected distance of a pair at the threshold; the probability that a split
#: by it parts such a pair, from the normal distribution: 2 (phi(1) - (1 - Phi(1))) sqrt(2 - 2 COSINE) phi(0); that all trees do.
SPILL, PARTED, LOST = 0.5, 0.025, 1e-4


def trees(largest: int, leaf: int) -> int:
    """How many trees leave a pair at the threshold unmet with a probability of at most LOST, if the largest label has so many vectors."""
    levels = max(1, int(np.ceil(np.log2(max(2, largest / leaf)))) + 1)  # spill makes trees deeper
    return max(2, int(np.ceil(np.log(LOST) / np.log(1 - (1 - PARTED) ** levels))))


def directions(dim: int, n: int) -> np.ndarray:
    """n x LEVELS random directions, the same in every process."""
    return np.random.Generator(np.random.Philox(key=dim)).standard_normal((n * LEVELS, dim)) / np.sqrt(dim)


def margin(dim: int) -> float:
    return SPILL * np.sqrt(2 - 2 * COSINE) / np.sqrt(dim)


def units(vecs: DataFrame) -> DataFrame:
    """(vec_id, node, grp, dim, unit) of the rows; node, which stands for label and vector, is null for rows that can't link."""
    ship(vecs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, grp, dims, unit = [], [], [], []
            for label, raw in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                v = np.array(raw.values.to_numpy(zero_copy_only=False), "f8") if label is not None and raw.is_valid else np.empty(0)
                most = np.abs(v).max() if len(v) else 0.0
                if not np.isfinite(most) or most == 0:  # a null component is NaN here, and so is the maximum
                    for x in (node, grp, dims, unit):
                        x.append(None)
                    continue
                v = v / most
                v = v / np.sqrt(v @ v)
                key = f"{label}/{len(v)}"
                packed = v.tobytes()
                node.append(xxhash.xxh64_intdigest(key.encode() + packed) - (1 << 63))
                grp.append(key)
                dims.append(len(v))
                unit.append(packed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(grp, pa.string()), pa.array(dims, pa.int32()), pa.array(unit, pa.binary())], ["vec_id", "node", "grp", "dim", "unit"])

    kind = vecs.schema["vec_id"].dataType.simpleString()
    rows = vecs.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"vec_id {kind}, node long, grp string, dim int, unit binary")


def planted(nodes: DataFrame, n: int) -> DataFrame:
    """(node, margin, leaf, along): each of ``nodes`` (node, grp, dim, unit) at the root of n trees, with its projections on the directions of the levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                dims, along = part.column(1).to_pylist(), []
                for dim, unit in zip(dims, part.column(2), strict=True):
                    if dim not in known:
                        known[dim] = directions(dim, n)
                    along.append((known[dim] @ np.frombuffer(unit.as_buffer(), "f8")).astype("f4").reshape(n, LEVELS))
                for t in range(n):
                    flat = pa.array(np.concatenate([x[t] for x in along]))
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(along) * LEVELS + 1, LEVELS, dtype="i4")), flat)
                    leaf = [xxhash.xxh64_intdigest(f"{g}#{t}") - (1 << 63) for g in part.column(3).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([margin(d) for d in dims]), pa.array(leaf, pa.int64()), rows], ["node", "margin", "leaf", "along"])

    return nodes.select("node", "dim", "unit", "grp").mapInArrow(run, "node long, margin double, leaf long, along array<float>")


def leaves(nodes: DataFrame, n: int) -> DataFrame:
    """(node, leaf): the leaves of n trees that each of ``nodes`` falls in.

    Only the sets that a level splits are written anew; others are done where they are.
    """
    rows = materialize(planted(nodes, n), "tree-rows")
    done, idle = [], 0
    for level in range(LEVELS):
        at = F.element_at("along", level + 1)
        cut = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(at, [0.25, 0.5, 0.75], 1000).alias("q"), F.first("margin").alias("m")).where(F.col("n") > LEAF)
        cut = materialize(cut.select("leaf", "q", ((F.col("q")[0] < F.col("q")[1] - F.col("m")) & (F.col("q")[2] > F.col("q")[1] + F.col("m"))).alias("wide")), "splits")
        state = cut.agg(F.count(F.lit(1)).alias("large"), F.count_if("wide").alias("wide")).first()
        idle = 0 if state["wide"] else idle + 1
        if not state["large"] or idle == 2:  # what is still large then is dense in all directions
            break
        if not state["wide"]:
            continue
        large = cut.select("leaf", F.when(F.col("wide"), F.col("q")[1]).alias("mid"))  # large sets that aren't wide have another try
        done.append(rows.join(large.select("leaf"), "leaf", "left_anti").select("node", "leaf"))
        split = rows.join(large, "leaf")
        sides = F.when(F.col("mid").isNull(), F.array(F.lit(2))).otherwise(
            F.array_compact(F.array(F.when(at <= F.col("mid") + F.col("margin"), F.lit(0)), F.when(at > F.col("mid") - F.col("margin"), F.lit(1))))
        )
        split = split.withColumn("side", F.explode(sides))
        rows = materialize(split.select("node", "margin", F.when(F.col("side") == 2, F.col("leaf")).otherwise(F.xxhash64("leaf", "side", F.lit(level))).alias("leaf"), "along"), "tree-rows")
    return reduce(DataFrame.unionByName, done, rows.select("node", "leaf"))


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair of blocks of one leaf: for each vector that links, the weight of its new partners and its root within the two blocks."""
    leaf, i, j = int(pdf["leaf"].iat[0]), int(pdf["i"].iat[0]), int(pdf["j"].iat[0])
    x = np.stack([np.frombuffer(u, "f8") for u in pdf["unit"]])
    node, weight, block = pdf["node"].to_numpy(), pdf["weight"].to_numpy("i8"), pdf["block"].to_numpy()
    linked = x @ x.T >= COSINE
    np.fill_diagonal(linked, False)
    if i != j:
        linked &= block[:, None] != block[None, :]  # pairs within a block have a task of their own
    if not linked.any():
        return pd.DataFrame({"node": [], "links": [], "root": []}).astype("i8")
    names = {n: k for k, n in enumerate(sorted({n for own in pdf["own"] for n in own if n < leaf}))}
    earlier = np.zeros((len(x), len(names)), "f4")
    for k, own in enumerate(pdf["own"]):
        for n in own:
            if n < leaf:
                earlier[k, names[n]] = 1
    links = (linked & ~(earlier @ earlier.T > 0)) @ weight if names else linked @ weight
    root = node.copy()
    while True:
        low = np.where(linked, root[None, :], np.iinfo("i8").max).min(axis=1)
        new = np.minimum(root, low)
        if (new == root).all():
            break
        root = new
    hit = linked.any(axis=1)
    return pd.DataFrame({"node": node[hit], "links": links[hit], "root": root[hit]})


def link(vecs: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vecs`` (vec_id, label, embedding; other columns are ignored).

    Two rows link if their labels are equal and not null and the cosine of their vectors, in double
    precision, is at least COSINE.  Null, empty and zero vectors, and vectors with null or non-finite
    components, link with nothing, nor do vectors of different lengths.  Equal vectors link, repeated rows
    too.  component_id is the smallest vec_id of the component, null if all are null; kept is false for a
    null vec_id.  An empty table gives an empty result.
    """
    spark: SparkSession = vecs.sparkSession
    rows = materialize(units(vecs), "units")
    nodes = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("weight"), *(F.first(c).alias(c) for c in ("grp", "dim", "unit")))
    nodes = materialize(nodes, "vectors")
    largest = nodes.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    met = materialize(leaves(nodes, trees(largest, LEAF)), "leaves")
    own = met.groupBy("node").agg(F.collect_set("leaf").alias("own"))
    sizes = met.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes.select("leaf", "blocks"), "leaf-sizes")
    placed = met.join(sizes.hint("merge"), "leaf").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = materialize(placed, "placed")
    held = nodes.select("node", "weight", "unit").join(own, "node")
    own = materialize(held, "held")
    held = placed.join(own.hint("merge"), "node")
    held = held.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k"))
    found = held.select("leaf", "i", "j", "block", "node", "weight", "unit", "own").groupBy("leaf", "i", "j").applyInPandas(_compare, "node long, links long, root long")
    found = materialize(found, "found")
    release(met, sizes, placed, own)
    roots = graph.merge(graph.no_roots(spark), found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    per = graph.rooted(nodes.select("node", "weight"), "node", roots, "root").join(counts, "node", "left")
    per = materialize(per.select("node", "root", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "per-vector")
    all_ = materialize(rows.select("vec_id", "node").join(per.hint("merge"), "node", "left"), "per-row")
    release(nodes, found, roots, per, rows)
    least = materialize(all_.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("component_id")), "components")
    out = all_.join(least.hint("merge"), "root", "left")
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
