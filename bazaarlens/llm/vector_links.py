"""Near-duplicate vectors by an inverted multi-index with verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm import multi_index as mi
from bazaarlens.llm.components import connected_components
from bazaarlens.llm.staging import staged

#: Fitting: rows of the sample, vectors per cell aimed at.
SAMPLE_ROWS, CELL_ROWS, MAX_CODES = 16_384, 64, 256
#: Calibrating: rows of the sample that is compared with all rows, how many of them at once, and the
#: cosine from which two vectors are copies.
TRIAL_ROWS, COMPARED_ROWS, COPY_COSINE = 65_536, 1024, 1 - 1e-9
#: Entries, and searching vectors, of one block of a band (cells of one first code).
BLOCK_ROWS = 512


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _needs(shared, cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For the sample vectors that link with vectors of a batch, copies aside: the largest summed bound
    up to which cells must be visited to find the pair. The smaller bound of both ends counts, as a
    pair is found if either visits the other's cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, keys, sample, labels = shared.value
        own = {}
        for at, label in enumerate(labels):
            own.setdefault(label, []).append(at)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _unit(mi.matrix(batch.column("embedding"))), np.asarray(batch.column("vec_id"))
            (one, two), (i, j) = grid.bounds(x), grid.codes(x)
            of = {}
            for row, label in enumerate(batch.column("label").to_pylist()):
                of.setdefault(label, []).append(row)
            need = np.full(len(keys), -1.0)
            for label, rows in of.items():
                rows = np.array(rows)
                for begin in range(0, len(own.get(label, [])), COMPARED_ROWS):
                    at = np.array(own[label][begin : begin + COMPARED_ROWS])
                    near = x[rows] @ sample[at].T
                    near = (near >= cosine) & (near < COPY_COSINE) & (ids[rows, None] != keys[None, at])
                    hit = np.flatnonzero(near.any(0))
                    if not len(hit):
                        continue
                    (p, q), (k, m) = grid.bounds(sample[at[hit]]), grid.codes(sample[at[hit]])
                    there = one[np.ix_(rows, k)] + two[np.ix_(rows, m)]
                    back = (p[:, i[rows]] + q[:, j[rows]]).T
                    least = np.where(near[:, hit], np.minimum(there, back), -1.0).max(0)
                    need[at[hit]] = np.maximum(need[at[hit]], least)
            found = np.flatnonzero(need >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(need[found])], names=["at", "need"])

    return run


def _radius(usable: DataFrame, shared, cosine: float, recall: float, whole: bool) -> float:
    """The summed bound up to which cells are visited.

    Sample vectors are compared with all vectors of their label, and the radius is the largest
    that any of their links needs. With n sample vectors that have links, at most 3 / n of
    all such vectors need more (at 95% confidence); where the sample is the whole table, none
    does. If that does not vouch for ``recall``, the squared distance at the threshold is the
    radius, which no pair's bound exceeds.
    """
    exact = max(0.0, 2 - 2 * cosine) + 1e-9
    if recall >= 1 and not whole:
        return exact
    needs = usable.select("vec_id", "label", "embedding").mapInArrow(_needs(shared, cosine), "at long, need double")
    row = needs.groupBy("at").agg(F.max("need").alias("need")).agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).first()
    if not whole and row.n * (1 - recall) < 3:
        return exact
    return min(exact, (row.need or 0.0) + 1e-9)


def _code(index, radius: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each vector's own cell, and the bands (first codes) of the cells that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(mi.matrix(batch.column("embedding")))
            (one, two), (i, j) = grid.bounds(x), grid.codes(x)
            bands = [list(dict.fromkeys(a for a, _ in mi.visited(p, q, radius))) for p, q in zip(one, two, strict=True)]
            extra = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(bands, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "home", "code", "bands"])

    return run


def _verify(index, radius: float, cosine: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between the searching classes and the entries of one block.

    Returns for each class with links: the vectors it links with, and the smallest id that
    links inside the block connect it with. A pair is counted for the searching class, and
    for the entry too unless the entry's own search visits the other's cell.
    """

    def run(block: pd.DataFrame) -> pd.DataFrame:
        q, e = block[block["searching"]], block[~block["searching"]]
        empty = pd.DataFrame({"vec_id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        if q.empty or e.empty:
            return empty
        grid, band = index.value, int(e["band"].iloc[0])
        x, y = (_unit(np.stack(d["embedding"]).astype(np.float64)) for d in (q, e))
        qid, eid, code = q["vec_id"].to_numpy(), e["vec_id"].to_numpy(), e["code"].to_numpy()
        one, two = grid.bounds(x)
        reach = one[:, [band]] + two <= radius
        links = np.zeros((len(q), len(e)), bool)
        for c in np.unique(code):
            rows, cols = np.flatnonzero(reach[:, c]), np.flatnonzero(code == c)
            if len(rows):
                near = x[rows] @ y[cols].T >= cosine
                links[np.ix_(rows, cols)] = near & (qid[rows, None] != eid[None, cols])
        rows, cols = links.any(1), links.any(0)
        if not rows.any():
            return empty
        links, q, e, qid, eid = links[np.ix_(rows, cols)], q[rows], e[cols], qid[rows], eid[cols]
        one, two = grid.bounds(y[cols])
        back = (one[:, q["home"]] + two[:, q["code"]] <= radius).T
        n = np.r_[links @ e["copies"].to_numpy(), (links & ~back).T @ q["copies"].to_numpy()]
        top = np.iinfo(np.int64).max
        low_q, low_e = qid.copy(), eid.copy()
        while True:
            new_q = np.minimum(low_q, np.where(links, low_e[None], top).min(1))
            new_e = np.minimum(low_e, np.where(links, new_q[:, None], top).min(0))
            if (new_q == low_q).all() and (new_e == low_e).all():
                break
            low_q, low_e = new_q, new_e
        return pd.DataFrame({"vec_id": np.r_[qid, eid], "n": n, "root": np.r_[low_q, low_e]})

    return run


def link_vectors(vectors: DataFrame, cosine: float, recall: float = 0.99, seed: int = 0) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each vector of ``vectors`` (vec_id, embedding, label).

    Two vectors link if their labels are equal and not null and their cosine, in doubles,
    is at least ``cosine``. Vectors that are null, of another than the most frequent
    length, zero, or with null or non-finite components link with nothing; neither do rows
    with a null id. Rows that repeat a vec_id count as one vector (the least row stays).

    Equal vectors of a label form a class, for which its smallest id stands with the number
    of copies, so copies never meet each other. Codebooks are fitted to at most
    ``SAMPLE_ROWS`` vectors; every class is coded. Each visits the cells nearest to it until
    the summed bound passes a radius at which all links of ``TRIAL_ROWS`` sample vectors are
    found, or no link can be missed where they have too few links to vouch for ``recall``.
    Every pair met is verified on the vectors themselves.

    Blocks of one band of cells are compared in one task; a band with many entries or
    many searching vectors is dealt into more blocks, so near copies of one vector spread
    over tasks. A block returns a count and one edge per class, never its pairs.
    """
    rows = vectors.where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v"))
    rows = staged(rows.select("vec_id", "v.label", "v.embedding"), "linked-rows")
    dim = mi.common_dim(vectors, "embedding")
    usable = rows.where(F.col("label").isNotNull() & mi.usable("embedding", dim))
    total = usable.count()
    keys, sample, labels = mi.fit_sample(usable, "vec_id", "embedding", total, TRIAL_ROWS, seed, "label")
    if not len(keys):
        alone = F.col("vec_id")
        return rows.select(alone, F.lit(0).cast("long").alias("n_links"), alone.alias("component_id"), F.lit(True).alias("kept"))
    sample = _unit(sample)
    codes = int(min(max(4, round((total / CELL_ROWS) ** 0.5)), MAX_CODES, max(1, len(sample) // 16)))
    chosen = np.sort(np.random.default_rng(seed).permutation(len(sample))[:SAMPLE_ROWS])
    index = mi.MultiIndex.fit(sample[chosen], codes, seed)
    context = vectors.sparkSession.sparkContext
    trial = context.broadcast((index, keys, sample, labels))
    radius = _radius(usable, trial, cosine, recall, len(keys) == total)
    trial.unpersist()
    shared = context.broadcast(index)
    kind = dict(usable.dtypes)
    classes = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    classes = classes.select("vec_id", "copies", "label", "embedding")
    schema = f"vec_id long, copies long, label {kind['label']}, embedding {kind['embedding']}, home int, code int, bands array<int>"
    coded = staged(classes.mapInArrow(_code(shared, radius), schema), "coded-vectors")

    key = ["label", "band"]
    own = ["vec_id", "copies", "label", "embedding", "home", "code"]
    entries = coded.select(*own, F.col("home").alias("band"), F.lit(False).alias("searching"))
    search = coded.select(*own, F.explode("bands").alias("band"), F.lit(True).alias("searching"))
    blocks = (
        entries.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("e_blocks"))
        .join(search.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("q_blocks")), key)
    )
    blocks = staged(blocks, "vector-blocks")

    def part(name: str, seed: int):
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(name)).cast("int")

    def every(name: str):
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    columns = [*own, "band", "searching", "e", "q"]
    entries = entries.join(blocks, key).withColumn("e", part("e_blocks", 1)).withColumn("q", every("q_blocks")).select(columns)
    search = search.join(blocks, key).withColumn("q", part("q_blocks", 2)).withColumn("e", every("e_blocks")).select(columns)
    verify = _verify(shared, radius, cosine)
    found = entries.union(search).groupBy(*key, "e", "q").applyInPandas(verify, "vec_id long, n long, root long")
    found = staged(found, "vector-links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    parts = connected_components(found, "vec_id", "root").withColumnRenamed("node", "vec_id")
    groups = coded.select("vec_id", "copies", *_fingerprint()).join(counts, "vec_id", "left").join(parts, "vec_id", "left")
    groups = groups.select(
        "f1",
        "f2",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )
    linked = usable.select("vec_id", *_fingerprint()).join(groups, ["f1", "f2"]).select("vec_id", "n_links", "component_id")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id").join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept")
    )


def _fingerprint() -> list:
    """128 bits that stand for a label and a vector."""
    return [F.xxhash64("label", "embedding").alias("f1"), F.xxhash64(F.lit(1), "embedding", "label").alias("f2")]
