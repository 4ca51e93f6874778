"""Exact near-duplicate links of vectors: a metric range join.

On unit vectors a cosine of at least c is a Euclidean distance of at most r = sqrt(2 - 2c). Sampled pivots partition
the vectors by the nearest pivot. A vector is replicated to another cell only if the triangle inequality (against the
cell's radius and both pivot distances) and the distance to the bisecting hyperplane let the cell hold a vector within
r. A cell of many vectors is cut into blocks that count as cells; of two cells only one's vectors are replicated to the
other, in turn, so that all cells get alike. Cells join independently, streaming what was replicated past their own
block, so memory is bounded. Single-precision products find the candidates, with a margin for their rounding; doubles
decide. Vectors of floats travel as floats.

Equal vectors are one class with a weight from the start. A cell returns the number of links of each class and, of the
links themselves, only a forest that connects the same classes, so a group of near copies gives a line per member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, components, table, temporary

COSINE = 0.95
#: Vectors of one block, those compared with a block at once, and the most pivots (which the driver and each task hold).
BLOCK, STRIP, PIVOTS = 4096, 512, 1024
#: Slack of the distance tests against rounding; it only lets more pairs be compared.
SLACK = 1e-6


def _dense(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Doubles of each list; None where it can't link: null, empty, zero, null or non-finite components."""
    out: list[np.ndarray | None] = []
    for x in column:
        v = None
        if x.is_valid and len(x.values) and not x.values.null_count:
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            n = np.sqrt(v @ v)
            if not np.isfinite(n) or n == 0:
                big = np.abs(v).max()
                v = v / big if np.isfinite(big) and big > 0 else None
        out.append(v)
    return out


def _prepared(batches: Iterator[pa.RecordBatch], form: type) -> Iterator[pa.RecordBatch]:
    """(id, key, vec): components as bytes of ``form``, which holds them exactly, and a digest of them."""
    for batch in batches:
        vecs = [None if v is None else (v + 0.0).astype(form).tobytes() for v in _dense(batch.column(1))]
        keys = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in vecs]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["id", "key", "vec"])


def _unit(column: pa.Array, form: type) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), form).reshape(len(column), -1).astype(np.float64)
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


def hits(a: np.ndarray, b: np.ndarray, small_a: np.ndarray, cosine: float) -> np.ndarray:
    """Whether the cosine of each pair of unit vectors is at least ``cosine``; small_a: ``a`` in single precision."""
    near = small_a @ b.T.astype(np.float32) >= cosine - 1e-6 * (16 + a.shape[1])
    if (rows := np.flatnonzero(near.any(axis=1))).size:
        cols = np.flatnonzero(near.any(axis=0))
        near[np.ix_(rows, cols)] &= a[rows] @ b[cols].T >= cosine
    return near


def sends(unit: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether of two different units the first one's vectors are replicated to the second; else it is the other way."""
    return (unit > to) == ((unit + to) % 2 == 0)


class Cells:
    """Pivots of one dimension, with what is known of their cells."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        self.apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * x @ self.pivots.T))

    def reach(self, d: np.ndarray, home: np.ndarray, radius: np.ndarray, r: float) -> np.ndarray:
        """Whether a cell can hold a vector within r of each vector."""
        own = d[np.arange(len(d)), home][:, None]
        near = (d <= radius + r + SLACK) & (d <= own + 2 * r + SLACK)
        return near & (d * d - own * own <= 2 * r * self.apart[home] + SLACK)


def _forest(linked: np.ndarray, labels: np.ndarray, own: np.ndarray, others: np.ndarray) -> list[tuple[int, int]]:
    """Edges for the links (block, others): each linked other to its first link, and merges of block labels (which
    are updated), so that the edges so far connect what the links do."""
    out = []
    cols = np.flatnonzero(linked.any(axis=0))
    if not len(cols):
        return out
    first = linked[:, cols].argmax(axis=0)
    out += list(zip(others[cols].tolist(), own[first].tolist()))
    spread = np.where(linked[:, cols], labels[:, None], -1)
    low = np.where(linked[:, cols], labels[:, None], len(labels)).min(axis=0)
    for c in np.flatnonzero(spread.max(axis=0) != low):
        found = np.unique(labels[linked[:, cols[c]]])
        out += [(int(own[a]), int(own[found[0]])) for a in found[1:]]  # a label is the index of a member
        labels[np.isin(labels, found[1:])] = found[0]
    return out


def _join(batches: Iterator[pa.RecordBatch], cosine: float, form: type) -> Iterator[pa.RecordBatch]:
    """(unit, role, node, weight, vec), sorted by unit and role, to (u, v, n): links' numbers (v null) and edges."""

    def out(u, v, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "n"])

    unit, own, held, counted = None, None, [], None

    def close() -> Iterator[pa.RecordBatch]:
        if own is not None and counted.any():
            at = np.flatnonzero(counted)
            yield out(own[0][at], [None] * len(at), counted[at])

    def start() -> Iterator[pa.RecordBatch]:
        """The block is complete: it is compared with itself."""
        nonlocal own, counted, held
        node, weight, vec = (np.concatenate(x) for x in zip(*held))
        held = []
        own, counted, edges = [node, weight, vec, np.arange(len(node)), vec.astype(np.float32)], np.zeros(len(node), np.int64), []
        for a in range(0, len(node), STRIP):
            near = hits(vec, vec[a : a + STRIP], own[4], cosine)
            near[np.arange(a, min(len(node), a + STRIP)), np.arange(near.shape[1])] = False
            counted[a : a + STRIP] += weight @ near
            edges += _forest(near, own[3], node, node[a : a + STRIP])
        if edges:
            yield out([e[0] for e in edges], [e[1] for e in edges], [None] * len(edges))

    for batch in batches:
        units, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero((np.diff(units) != 0) | (np.diff(roles) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(units)]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if units[a] != unit:
                if held:
                    yield from start()
                yield from close()
                unit, own, counted, held = units[a], None, None, []
            node, weight, vec = part.column(2).to_numpy(), part.column(3).to_numpy(), _unit(part.column(4), form)
            if roles[a] == 0:
                held.append((node, weight, vec))
                continue
            if held:
                yield from start()
            if own is None:
                continue
            for c in range(0, len(node), STRIP):
                near = hits(own[2], vec[c : c + STRIP], own[4], cosine)
                if not near.any():
                    continue
                counted += near @ weight[c : c + STRIP]
                back = own[1] @ near
                at = np.flatnonzero(back)
                yield out(node[c : c + STRIP][at], [None] * len(at), back[at])
                edges = _forest(near, own[3], own[0], node[c : c + STRIP])
                yield out([e[0] for e in edges], [e[1] for e in edges], [None] * len(edges))
    if held:
        yield from start()
    yield from close()


def near_vectors(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths with each other; such a row is a component of its own. Equal rows count each other as links.
    A null id is not a candidate for component_id and is never kept. An empty table gives an empty result. Other
    columns are not read.
    """
    spark, r = df.sparkSession, float(np.sqrt(2 - 2 * cosine))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with temporary() as made:
        form = np.float32 if isinstance(getattr(df.schema[vec_col].dataType, "elementType", None), T.FloatType) else np.float64
        all_rows = table(df.select(F.col(id_col).cast("long").alias("id"), vec_col).mapInArrow(lambda b: _prepared(b, form), "id long, key binary, vec binary"))
        rows = all_rows.filter("key is not null")
        classes = rows.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("w"), F.first("vec").alias("vec"))
        classes = table(classes.withColumn("node", F.monotonically_increasing_id()))
        total = classes.count()
        picked = classes.orderBy(F.xxhash64("key"), "key").limit(int(min(PIVOTS, max(1, -(-total // block))))).select("vec").collect()  # at most PIVOTS
        by_size: dict[int, list[bytes]] = {}
        for p in picked:
            by_size.setdefault(len(p["vec"]), []).append(bytes(p["vec"]))
        base, cells = {}, {}
        for size, held in sorted(by_size.items()):
            base[size] = sum(len(c.pivots) for c in cells.values())
            cells[size] = Cells(_unit(pa.array(held, pa.binary()), form))
        n_cells = sum(len(c.pivots) for c in cells.values())
        lost = n_cells  # vectors of a length that no pivot has: one cell for all, compared by length

        def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = np.array([len(v.as_buffer()) for v in batch.column(2)])
                home, far = np.full(len(sizes), lost), np.full(len(sizes), 2.0)
                for size, c in cells.items():
                    if len(at := np.flatnonzero(sizes == size)):
                        d = c.distances(_unit(batch.column(2).take(pa.array(at)), form))
                        home[at], far[at] = base[size] + d.argmin(axis=1), d.min(axis=1)
                # lengths without a pivot get cells of their own beyond the others
                home = np.where(home == lost, lost + sizes, home)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(home, pa.int64()), pa.array(far, pa.float64())], names=["node", "w", "vec", "home", "far"])

        homed = table(classes.select("node", "w", "vec").mapInArrow(homes, "node long, w long, vec binary, home long, far double"))
        # at most PIVOTS rows, and one for each length that no pivot has
        known = {x["home"]: x for x in homed.groupBy("home").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
        blocks = {h: -(-x["n"] // block) for h, x in known.items()}
        first_unit, units = {}, 0
        for h in sorted(known):
            first_unit[h], units = units, units + blocks[h]
        radius = np.array([known[j]["far"] if j in known else -9.0 for j in range(n_cells)])

        unit_cell = np.repeat(sorted(known), [blocks[h] for h in sorted(known)])
        pivoted = unit_cell < n_cells

        def replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, min(512, (1 << 24) // max(1, units)))
            for whole in batches:
                for start in range(0, whole.num_rows, step):
                    batch = whole.slice(start, step)
                    node, home = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                    sizes = np.array([len(v.as_buffer()) for v in batch.column(2)])
                    reach = np.zeros((len(node), n_cells), bool)
                    for size, c in cells.items():
                        at = np.flatnonzero(sizes == size)
                        if len(at):
                            lo, hi = base[size], base[size] + len(c.pivots)
                            x = _unit(batch.column(2).take(pa.array(at)), form)
                            reach[at, lo:hi] = c.reach(c.distances(x), home[at] - lo, radius[lo:hi], r)
                    own = np.array([first_unit[h] + (k * 0x9E3779B97F4A7C15 >> 20) % blocks[h] for k, h in zip(node.tolist(), home.tolist())], np.int64)
                    goes = unit_cell[None, :] == home[:, None]
                    goes[:, pivoted] |= reach[:, unit_cell[pivoted]]
                    goes &= sends(own[:, None], np.arange(units)[None, :])
                    goes[np.arange(len(own)), own] = True
                    row, unit = np.nonzero(goes)
                    at = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(unit, pa.int64()), pa.array((unit != own[row]).astype(np.int32), pa.int32()), batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at)],
                        names=["unit", "role", "node", "weight", "vec"],
                    )

        spread = homed.mapInArrow(replicas, "unit long, role int, node long, weight long, vec binary")
        dealt = spread.repartition(max(n_parts, min(units, 8 * n_parts)), "unit").sortWithinPartitions("unit", "role")
        found = table(dealt.mapInArrow(lambda b: _join(b, cosine, form), "u long, v long, n long"))
        counts = found.filter("v is null").groupBy("u").agg(F.sum("n").alias("links")).withColumnRenamed("u", "node")
        rooted = components(found.filter("v is not null").select("u", "v"))
        facts = table(classes.select("node", "key", "first", "w").join(counts, "node", "left").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node")))
        roots = table(facts.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")))
        named = table(attach(facts, roots, "root", "n").select("key", "w", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id"))
        made.keep(all_rows, named)
    linked = attach(rows.select("id", "key"), named, "key", "w").select("id", "n_links", "component_id")
    alone = all_rows.filter("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
