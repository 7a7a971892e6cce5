"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them, one vector kept per group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopmill.llm.common import saved
from shopmill.llm.components import components

#: Residents of a cell that are compared at once, with four times as many rows; larger cells are cut into such blocks.
BLOCK = 1024
#: Vectors that a cell is meant to be home to. Cells lie in coarse cells; at most so many coarse cells, and cells in one.
RESIDENTS, MAX_COARSE, MAX_FINE = 256, 2048, 512
#: Distinct vectors that centres are fitted on, for each centre.
SAMPLE_PER_CELL = 20
ROUNDS = 8
#: Rows of a coarse cell that one task places in its cells.
PLACED_TOGETHER = 50_000
#: A cell's number: that of its coarse cell, and below it this many bits for its own.
FINE_BITS = 20


def spherical_k_means(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of unit vectors; starts from evenly spaced rows, so it gives the same at each run."""
    cells = max(1, min(cells, len(sample)))
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        home = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def margin(threshold: float, size: int) -> float:
    """How far beyond a cell's border a vector still visits the cell.

    Linked vectors differ by a chord of ``sqrt(2 - 2 threshold)`` at most. Along a given direction, such as that from
    one centre to another, a difference in no particular direction has the chord over the root of the dimension as
    standard deviation; this is one and a quarter of that. One of two linked vectors lies no further from the border
    between their cells than half their difference across it, and a pair is missed only if neither of the two visits
    the other's cell.
    """
    return 1.25 * math.sqrt(2 - 2 * threshold) / math.sqrt(size)


def _unit(arrays: pa.Array, size: int) -> np.ndarray:
    x = np.asarray(arrays.flatten(), float).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells_of(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For each vector its cell, and which others are near: those whose border with its own is within reach."""
    dots = x @ centres.T
    home = dots.argmax(axis=1)
    lead = dots[np.arange(len(x)), home][:, None] - dots
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))[home]
    close = lead <= reach * np.maximum(apart, 1e-9)
    close[np.arange(len(x)), home] = False
    return home, close


def _assign(centres: np.ndarray, reach: float):
    """Adds to each vector its own coarse cell and those near it."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = centres.shape[1]
        for batch in stream:
            # vectors of another dimension have a coarse cell for it
            homes = -np.asarray(batch.column("vector").value_lengths()).astype(np.int64)
            near: list[list[int]] = [[] for _ in range(batch.num_rows)]
            fits = np.flatnonzero(homes == -size)
            for first in range(0, len(fits), 2048):
                part = fits[first : first + 2048]
                home, close = _cells_of(_unit(batch.column("vector").take(pa.array(part)), size), centres, reach)
                homes[part] = home
                for at, row in zip(part.tolist(), close):
                    near[at] = np.flatnonzero(row).tolist()
            columns = [*batch.columns, pa.array(homes, pa.int64()), pa.array(near, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "home", "near"])

    return batches


def _fit_fine(frame: pd.DataFrame) -> pd.DataFrame:
    """Centres of the cells of one coarse cell, from a sample of its residents."""
    cells = min(MAX_FINE, math.ceil(frame["residents"].iloc[0] / RESIDENTS))
    sample = _unit(pa.array(frame.sort_values("id")["vector"].tolist()), len(frame["vector"].iloc[0]))
    centres = spherical_k_means(sample[: cells * SAMPLE_PER_CELL], cells)
    return pd.DataFrame({"coarse": frame["coarse"].iloc[0], "vector": list(centres)})


def _place(threshold: float):
    """Cells of vectors in their coarse cells. Rows come by coarse cell and salt, the centres of its cells first.

    ``id, cell, own``: the cell in the coarse cell that the vector is nearest to, and those near that one; ``own`` is
    the one cell that is its home.
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, centres = None, [], None
        for batch in stream:
            marks = np.stack([np.asarray(batch.column(k)) for k in ("coarse", "salt", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                coarse, salt, kind = marks[first].tolist()
                if (coarse, salt) != at:
                    at, held, centres = (coarse, salt), [], None
                rows = batch.slice(first, last - first)
                size = int(rows.column("vector").value_lengths()[0].as_py())
                if kind == 0:
                    held.append(_unit(rows.column("vector"), size))
                    continue
                if centres is None:
                    centres = np.concatenate(held)
                for start in range(0, rows.num_rows, 2048):
                    part = rows.slice(start, 2048)
                    home, close = _cells_of(_unit(part.column("vector"), size), centres, margin(threshold, size))
                    close[np.arange(len(home)), home] = True
                    row, fine = np.nonzero(close)
                    own = (fine == home[row]) & (np.asarray(part.column("home"))[row] == coarse)
                    ids = np.asarray(part.column("id"))[row]
                    cell = (coarse << FINE_BITS) + fine
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cell), pa.array(own)], ["id", "cell", "own"])

    return batches


def _visits(distinct: DataFrame, size: int, count: int, threshold: float) -> DataFrame:
    """``id, home, near``: the cell that each vector is resident of, and the others that it visits."""
    coarse_cells = min(MAX_COARSE, math.ceil(math.sqrt(count / RESIDENTS)) or 1)
    order = distinct.filter(F.size("vector") == size).orderBy(F.xxhash64("id"), "id")
    drawn = order.limit(coarse_cells * SAMPLE_PER_CELL).select("vector").toArrow().column("vector").combine_chunks()
    centres = spherical_k_means(_unit(drawn, size), coarse_cells) if len(drawn) else np.zeros((1, size))
    schema = "id long, vector array<double>, home long, near array<long>"
    homes = distinct.select("id", "vector").mapInArrow(_assign(centres, margin(threshold, size)), schema)
    homes = saved(homes)
    residents = homes.groupBy(F.col("home").alias("coarse")).agg(F.count("*").alias("residents"))
    drawn_at = Window.partitionBy("home").orderBy(F.xxhash64("id"), "id")
    sample = homes.withColumn("drawn", F.row_number().over(drawn_at)).filter(F.col("drawn") <= MAX_FINE * SAMPLE_PER_CELL)
    sample = sample.select(F.col("home").alias("coarse"), "id", "vector", "drawn").join(residents, "coarse")
    needed = F.ceil(F.col("residents") / RESIDENTS) * SAMPLE_PER_CELL
    fine = sample.filter(F.col("drawn") <= needed).groupBy("coarse").applyInPandas(_fit_fine, "coarse long, vector array<double>")
    fine = saved(fine)

    placed = homes.withColumn("coarse", F.explode(F.concat(F.array("home"), "near")))
    salts = placed.groupBy("coarse").agg(F.ceil(F.count("*") / PLACED_TOGETHER).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")
    vectors = placed.join(salts, "coarse").select("coarse", salt.alias("salt"), F.lit(1).alias("kind"), "id", "home", "vector")
    everywhere = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    none = F.lit(0).cast("long")
    heads = fine.join(salts, "coarse").select(
        "coarse", everywhere.alias("salt"), F.lit(0).alias("kind"), none.alias("id"), none.alias("home"), "vector"
    )
    ordered = heads.unionByName(vectors).repartition("coarse", "salt").sortWithinPartitions("coarse", "salt", "kind")
    visits = ordered.mapInArrow(_place(threshold), "id long, cell long, own boolean")
    return visits.groupBy("id").agg(
        F.max(F.when(F.col("own"), F.col("cell"))).alias("home"),
        F.collect_list(F.when(~F.col("own"), F.col("cell"))).alias("near"),
    )


def _compare(threshold: float):
    """Links inside the blocks of cells: rows ``(id, 0, number of vectors linked)`` and ``(id, id of its group, 0)``."""

    def block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = rows.column("cell")[0].as_py()
        ids, copies, home = (rows.column(n).to_numpy() for n in ("id", "copies", "home"))
        hosting, hosted = (rows.column(n).to_numpy() for n in ("hosting", "hosted"))
        vectors = rows.column("vector").combine_chunks()
        x = _unit(vectors, int(vectors.value_lengths()[0].as_py()))
        near = rows.column("near").to_pylist()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        hosts, others = np.flatnonzero((home == cell) & hosting), np.flatnonzero(hosted)
        for first in range(0, len(hosts), 512):
            part = hosts[first : first + 512]
            a, b = np.nonzero(x[part] @ x[others].T >= threshold - 1e-9)
            a, b = part[a], others[b]
            # two residents meet both ways round: once counts
            fits = (home[b] != cell) | (ids[a] < ids[b])
            a, b = a[fits], b[fits]
            if len(a):
                # a pair with different cells may meet in both: it counts in the lower one then
                lower = np.flatnonzero((home[b] != cell) & (home[b] < cell))
                twice = [k for k in lower.tolist() if home[b[k]] in near[a[k]]]
                a, b = np.delete(a, twice), np.delete(b, twice)
                edge = np.flatnonzero(np.einsum("kd,kd->k", x[a], x[b]) < threshold)
                a, b = np.delete(a, edge), np.delete(b, edge)
            found.append((a, b))
        a, b = (np.concatenate(p) for p in zip(*found))
        links = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
        label = np.arange(len(x))
        while True:
            before = label.copy()
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (before == label).all():
                break
        has, joined = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(x)))
        return (
            np.concatenate([ids[has], ids[joined]]),
            np.concatenate([ids[has], ids[label[joined]]]),
            np.concatenate([links[has].astype(np.int64), np.zeros(len(joined), np.int64)]),
        )

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        keys = ("cell", "i", "j")

        def done() -> pa.RecordBatch:
            a, b, n = block(pa.Table.from_batches(held))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

        for batch in stream:
            marks = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                part = batch.slice(first, last - first)
                if held and any(held[0].column(k)[0] != part.column(k)[0] for k in keys):
                    yield done()
                    held = []
                held.append(part)
        if held:
            yield done()

    return batches


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row of ``vectors``.

    ``n_links`` counts the other rows whose cosine, in double precision, is at least ``threshold``; ``component_id``
    is the smallest key that links reach, and ``kept`` marks the row that has it. No link is below the threshold; a
    link between different vectors may be missed if neither lies near the border of the other's cell (see `margin`;
    the tests measure recall against all pairs). Equal vectors meet as one before that, so their links are all there.

    The number of cells follows that of vectors: spherical k-means finds coarse cells on a sample, and cells of about
    `RESIDENTS` vectors inside each coarse cell on a sample of its own. A vector is resident of one cell and visits
    those whose border is near; residents are compared with all vectors of their cell, guests not with each other.
    Large cells are cut into blocks of rows by hash, and each pair of blocks is compared on its own, so a cell with a
    third of all vectors is many small tasks.

    Vectors that are null, zero or hold null or non-finite components link with nothing, neither do vectors of
    different dimension; dimensions other than the most frequent have a cell each. Rows with a null key are returned
    with no link and a null component. Repeated rows count as copies of each other. Other columns are ignored; an
    empty table gives an empty result.
    """
    value = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col(f"`{key}`").isNotNull() & finite & F.exists(value, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("key"), F.when(usable, value).alias("vector"))
    # -0.0 and 0.0 are one value for grouping; a digest keeps wide vectors out of the joins
    digest = F.sha2(F.concat_ws(",", F.transform("vector", lambda v: (v + 0.0).cast("string"))), 256)
    keyed = rows.withColumn("digest", F.when(F.col("vector").isNotNull(), digest))
    narrow = saved(keyed.select("key", "digest"))
    distinct = saved(
        keyed.filter("digest is not null")
        .groupBy("digest")
        .agg(F.min("key").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    )
    sizes = {r[0]: r[1] for r in distinct.groupBy(F.size("vector")).count().orderBy(F.desc("count")).limit(1).collect()}
    size, count = next(iter(sizes.items()), (1, 0))
    visits = _visits(distinct, size, count, threshold)
    homes = distinct.drop("digest").join(visits, "id")
    placed = saved(homes.withColumn("cell", F.explode(F.concat(F.array("home"), "near"))))
    resident = F.col("home") == F.col("cell")
    counts = placed.groupBy("cell").agg(
        F.ceil(F.count_if(resident) / BLOCK).cast("int").alias("hosting"),
        F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("hosted"),
    )
    parted = placed.join(counts, "cell").filter("hosting > 0")
    for name in ("hosting", "hosted"):
        parted = parted.withColumn(f"own_{name}", F.pmod(F.xxhash64("id"), name).cast("int"))
    # a row stands in its second block of pairs; a resident also in its first
    second = F.transform(F.sequence(F.lit(0), F.col("hosting") - 1), lambda i: F.struct(i.alias("i"), F.col("own_hosted").alias("j")))
    first = F.transform(F.sequence(F.lit(0), F.col("hosted") - 1), lambda j: F.struct(F.col("own_hosting").alias("i"), j.alias("j")))
    pairs = F.when(resident, F.array_union(first, second)).otherwise(second)
    blocks = parted.withColumn("pair", F.explode(pairs))
    sides = [(F.col(f"own_{name}") == F.col(f"pair.{at}")).alias(name) for name, at in (("hosting", "i"), ("hosted", "j"))]
    blocks = blocks.select("cell", "pair.i", "pair.j", *sides, "id", "copies", "home", "near", "vector")
    ordered = blocks.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "id")
    found = saved(ordered.mapInArrow(_compare(threshold), "a long, b long, n long"))
    degrees = found.filter("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    groups = components(found.filter("n = 0")).withColumnRenamed("node", "id")
    named = (
        distinct.select("digest", "id", "copies")
        .join(degrees, "id", "left")
        .join(groups, "id", "left")
        .select(
            "digest",
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    component = F.coalesce("component_id", "key")
    return narrow.join(named, "digest", "left").select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )
