"""Near-duplicate embeddings by product quantisation with inverted lists.

Vectors go to unit length and are filed under their nearest coarse centroid;
what is left over is coded by one of ``CODES`` codewords per subspace, and the
length of the error of that code is kept.  Each vector probes every list that
can hold a partner.  A partner in list c is at least as far away as the plane
halfway between c and the own centroid, so only lists whose plane is within
the search radius are probed, however many these are.  Distances to the codes
come from one lookup table per vector and list.  By the triangle inequality a
true partner is no farther from the query than the search radius plus its own
coding error, so the table distances drop nothing that is a link; what they
let through is decided by the exact cosine in double precision.  No link is
missed.

Scale: centroids and codewords are fitted on a bounded sample; every vector is
indexed.  Equal vectors are one class and are searched once.  The lists, one
after the other, are cut into blocks of ``BLOCK`` to ``WIDEST`` vectors, and
every task compares one pair of blocks, so a list that holds a third of all
rows is many tasks.  Blocks no member of which probes the other are never
paired.  Where vectors are spread evenly in many dimensions nearly all lists
are probed, and the work is that of all pairs of blocks.  A task returns
counts per vector and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import renamed_apart
from cardloom.llm.components import components
from cardloom.session import checkpointed

COSINE = 0.95
SAMPLE = 20_000
"""Vectors that centroids and codewords are fitted on."""
SUBSPACES, CODES = 8, 64
BLOCK, WIDEST = 1024, 8192
"""Vectors in a block: a table's blocks widen up to the second number, so that fewer copies are shuffled."""
MAX_LISTS = 4096


def unit(vector: np.ndarray) -> np.ndarray:
    return vector / np.sqrt((vector * vector).sum(axis=-1, keepdims=True))


def kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of ``points``; starts from evenly spaced rows, empty cells keep their place."""
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(points, centres, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        cells, starts = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(points[order], starts, axis=0)
        centres[cells] = sums / np.diff(np.r_[starts, len(points)])[:, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` nearest centres of each point, nearest first."""
    n = min(n, len(centres))
    out = np.empty((len(points), n), np.int32)
    for at in range(0, len(points), 4096):
        part = points[at : at + 4096]
        away = (centres * centres).sum(axis=1) - 2 * part @ centres.T
        some = np.argpartition(away, n - 1, axis=1)[:, :n]
        rank = np.lexsort((some, np.take_along_axis(away, some, 1)), axis=1)
        out[at : at + 4096] = np.take_along_axis(some, rank, 1)
    return out


class Index:
    """Coarse centroids and subspace codewords."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = kmeans(sample, lists)
        left = sample - self.centres[nearest(sample, self.centres, 1)[:, 0]]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.words = [kmeans(left[:, cut], CODES) for cut in self.cuts]

    def code(self, points: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the lengths of their errors."""
        left = points - self.centres[lists]
        codes = np.column_stack([nearest(left[:, c], w, 1)[:, 0] for c, w in zip(self.cuts, self.words)]).astype(np.uint8)
        error = sum(((left[:, c] - w[codes[:, i]]) ** 2).sum(axis=1) for i, (c, w) in enumerate(zip(self.cuts, self.words)))
        return codes, np.sqrt(error)

    def probed(self, points: np.ndarray, own: np.ndarray, lists: np.ndarray, radius: float) -> np.ndarray:
        """Whether each point, filed under its list in ``own``, can have a partner within ``radius`` in each of ``lists``."""
        to = self.centres[lists]
        squares = (to * to).sum(axis=1)
        out = np.empty((len(points), len(lists)), bool)
        for at in range(0, len(points), 1024):
            part, home = points[at : at + 1024], self.centres[own[at : at + 1024]]
            home_squares = (home * home).sum(axis=1)
            farther = squares - 2 * part @ to.T - (home_squares - 2 * (part * home).sum(axis=1))[:, None]
            apart = np.sqrt(np.maximum(squares + home_squares[:, None] - 2 * home @ to.T, 0))
            out[at : at + 1024] = farther <= 2 * radius * apart + 1e-6
        return out

    def squared_distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of whole queries to coded members of list ``at``, from one table per subspace."""
        left = queries - self.centres[at]
        out = np.zeros((len(codes), len(queries)))  # by member: a code copies one row of a table for all queries
        for i, (cut, words) in enumerate(zip(self.cuts, self.words)):
            part = left[:, cut]
            table = (part * part).sum(axis=1)[:, None] + (words * words).sum(axis=1) - 2 * part @ words.T
            out += np.take(np.ascontiguousarray(table.T), codes[:, i], axis=0)
        return out.T


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that can link: no null, non-finite or missing component, not empty, not zero."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    infinite = F.lit(float("inf"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite)) & F.exists("v", lambda x: x != 0)
    return embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & fine)


def _counted(linked: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row the sum of the sizes of the columns it links."""
    out = np.zeros(len(linked), np.int64)
    for at in range(0, len(linked), 256):
        out[at : at + 256] = (linked[at : at + 256] @ sizes.astype(float)).astype(np.int64)
    return out


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the bipartite links in a matrix; columns are numbered after the rows."""
    n_rows = len(linked)
    fresh_rows, fresh_cols = linked.any(axis=1), linked.any(axis=0)
    across = np.ascontiguousarray(linked.T)
    edges = []
    for start in np.flatnonzero(fresh_rows).tolist():
        if not fresh_rows[start]:
            continue
        fresh_rows[start] = False
        waiting = [start]
        while waiting:
            node = waiting.pop()
            if node < n_rows:
                new = np.flatnonzero(linked[node] & fresh_cols)
                fresh_cols[new] = False
                new += n_rows
            else:
                new = np.flatnonzero(across[node - n_rows] & fresh_rows)
                fresh_rows[new] = False
            edges += [(node, other) for other in new.tolist()]
            waiting += new.tolist()
    return edges


def _exact(x: np.ndarray, y: np.ndarray, near: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the pairs in ``near`` have at least the cosine; products at once where there are many."""
    sure = np.zeros_like(near)
    if np.count_nonzero(near) * 16 > near.size:
        dots = x @ y.T
        sure = near & (dots >= cosine + 1e-9)
        near = near & (np.abs(dots - cosine) < 1e-9)
    rows, cols = np.nonzero(near)
    for part in range(0, len(rows), 1 << 15):
        r, c = rows[part : part + (1 << 15)], cols[part : part + (1 << 15)]
        sure[r, c] = (x[r] * y[c]).sum(axis=1) >= cosine
    return sure


def _points(column: pd.Series) -> np.ndarray:
    """Unit vectors of packed ones."""
    return unit(np.stack([_unpacked(v) for v in column]))


def _packed(v: np.ndarray) -> bytes:
    """Bytes of a vector, as single precision where that says the same; one zero byte marks it."""
    with np.errstate(over="ignore"):
        short = v.astype("<f4")
    return short.tobytes() + b"\0" if (short == v).all() else v.astype("<f8").tobytes()


def _unpacked(v: bytes) -> np.ndarray:
    return np.frombuffer(v, "<f4", len(v) // 4).astype(float) if len(v) % 4 else np.frombuffer(v, "<f8")


def _compare(index: Index, queries: pd.DataFrame, members: pd.DataFrame, cosine: float, same: bool) -> tuple[pd.DataFrame, list]:
    """Counts per class id and spanning edges of the links of two blocks, or of a block with itself.

    Links of two blocks are found here only, and counted for both ends.
    """
    x, y = _points(queries["v"]), _points(members["v"])
    codes = np.stack([np.frombuffer(c, np.uint8) for c in members["codes"]])
    radius = np.sqrt(2 - 2 * cosine)
    reach = (radius + members["error"].to_numpy() + 1e-6) ** 2
    own, lists = queries["list"].to_numpy(), members["list"].to_numpy()
    there = np.unique(lists)
    probed = index.probed(x, own, there, radius)
    linked = np.zeros((len(x), len(y)), bool)
    for i, at in enumerate(there.tolist()):
        cols, asking = np.flatnonzero(lists == at), np.flatnonzero(probed[:, i])
        for part in range(0, len(asking), 512):
            rows = asking[part : part + 512]
            near = index.squared_distances(x[rows], at, codes[cols]).T <= reach[cols, None]
            if near.any():
                c, r = np.nonzero(_exact(y[cols], x[rows], near, cosine))
                linked[rows[r], cols[c]] = True
    names = np.r_[queries["cls"].to_numpy(), members["cls"].to_numpy()]
    if same:
        np.fill_diagonal(linked, False)
    # links are few among spread vectors: only rows and columns with one are counted and spanned
    rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    linked = linked[np.ix_(rows, cols)]
    n = np.zeros(len(names), np.int64)
    n[rows] = _counted(linked, members["size"].to_numpy()[cols])
    if not same:
        n[len(x) + cols] = _counted(linked.T, queries["size"].to_numpy()[rows])
    ends = names[np.r_[rows, len(x) + cols]]
    counts = pd.DataFrame({"cls": names, "n": n})
    return counts[counts["n"] > 0], [(int(ends[a]), int(ends[b])) for a, b in _forest(linked)]


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing.  Vectors of different lengths never link.  Equal
    vectors link with each other, repeated rows with the same id too.  Rows
    with a null id neither link nor count; their component is null and they
    are not kept.  Labels and other columns are not read.  An empty table
    gives an empty table.
    """
    spark = embeddings.sparkSession
    good = usable(embeddings).filter("vec_id IS NOT NULL")
    classes = checkpointed(good.groupBy("v").agg(F.min("vec_id").alias("cls"), F.count("*").alias("size")))
    member_of = good.join(classes.select("v", "cls"), "v").select("vec_id", "cls")

    found = None
    for row in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect():  # one row per vector length
        part = _links(spark, classes.filter(F.size("v") == row["d"]), row["n"], cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "cls bigint, other bigint, n bigint")
    found = checkpointed(found)
    counts = found.filter("other IS NULL").groupBy("cls").agg(F.sum("n").alias("n"))
    comps = components(found.filter("other IS NOT NULL"), "cls", "other").withColumnRenamed("node", "cls")
    by_class = (
        classes.select("cls", "size")
        .join(counts, "cls", "left")
        .join(comps, "cls", "left")
        .select(
            "cls",
            (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            F.coalesce("component", "cls").alias("component_id"),
        )
    )
    linked = checkpointed(member_of.join(by_class, "cls").select("vec_id", "n_links", "component_id"))
    alone = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id")).exceptAll(linked.select("vec_id"))
    return linked.unionByName(
        alone.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(spark, classes: DataFrame, n: int, cosine: float) -> DataFrame:
    """(cls, null, n) counts and (cls, other, null) spanning edges among classes of one vector length."""
    sampled = classes.orderBy(F.xxhash64("cls"), "cls").select("v").limit(SAMPLE).toPandas()["v"]
    lists = int(max(1, min(MAX_LISTS, round(n**0.5 / 2), len(sampled) // 8 or 1)))
    index = spark.sparkContext.broadcast(Index(unit(np.stack(sampled.to_numpy())), lists))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.stack(batch.column("v").to_numpy(zero_copy_only=False))
            points = unit(raw)
            near = nearest(points, own.centres, 1)[:, 0]
            codes, error = own.code(points, near)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("cls", "size")),
                    pa.array([_packed(v) for v in raw], pa.binary()),
                    pa.array(near, pa.int32()),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(error),
                ],
                ["cls", "size", "v", "list", "codes", "error"],
            )

    filed = checkpointed(
        classes.select("cls", "size", "v").mapInArrow(file, "cls bigint, size bigint, v binary, list int, codes binary, error double")
    )

    # the lists lie one after the other; a row's place in its list is drawn by hash, and blocks are cut at even places
    width = min(max(BLOCK, n // 12), max(BLOCK, WIDEST))
    members = {r["list"]: r["n"] for r in filed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MAX_LISTS
    starts, at = {}, 0
    for i in sorted(members):
        starts[i], at = at, at + members[i]
    places = spark.createDataFrame([(i, starts[i], members[i]) for i in members], "list int, start bigint, n bigint")
    placed = filed.join(F.broadcast(places), "list").withColumn(
        "block", F.floor((F.col("start") + F.pmod(F.xxhash64("cls"), F.col("n"))) / width).cast("int")
    )
    filled = np.array(sorted(members))
    first = np.array([starts[i] // width for i in filled.tolist()])
    last = np.array([(starts[i] + members[i] - 1) // width for i in filled.tolist()])
    radius = np.sqrt(2 - 2 * cosine)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = unit(np.stack([_unpacked(v) for v in batch.column("v").to_pylist()]))
            probed = index.value.probed(points, batch.column("list").to_numpy(), filled, radius)
            rows, blocks = [], []
            for row, (own, where) in enumerate(zip(batch.column("block").to_pylist(), probed)):
                asked = np.zeros(last[-1] + 2, int)  # +1 where a probed list starts, -1 behind its end
                np.add.at(asked, first[where], 1)
                np.add.at(asked, last[where] + 1, -1)
                found = np.flatnonzero(np.cumsum(asked) > 0)
                found = found[found >= own]  # a pair of blocks meets once
                rows.append(np.full(len(found), row))
                blocks.append(found)
            picked = batch.select(["cls", "size", "v", "list", "block"]).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, pa.array(np.concatenate(blocks), pa.int32())], ["cls", "size", "v", "list", "qb", "mb"]
            )

    asking = placed.mapInArrow(ask, "cls bigint, size bigint, v binary, list int, qb int, mb int")
    met = checkpointed(asking.select("qb", "mb").distinct())
    asked = renamed_apart(placed).join(met.withColumnRenamed("mb", "block"), "block").select(
        "qb", F.col("block").alias("mb"), "cls", "size", "v", "list", "codes", "error"
    )

    def compare(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"cls": [], "other": [], "n": []})
        queries, rows = (d.sort_values("cls", ignore_index=True) for d in (queries, rows))
        counts, edges = _compare(index.value, queries, rows, cosine, key[0] == key[1])
        out = pd.DataFrame(edges, columns=["cls", "other"])
        return pd.concat(
            [
                pd.DataFrame({"cls": counts["cls"], "other": pd.array([None] * len(counts), "Int64"), "n": counts["n"].astype("Int64")}),
                pd.DataFrame({"cls": out["cls"], "other": out["other"].astype("Int64"), "n": pd.array([None] * len(out), "Int64")}),
            ]
        )

    keys = ["qb", "mb"]
    return asking.groupBy(*keys).cogroup(renamed_apart(asked).groupBy(*keys)).applyInPandas(compare, "cls bigint, other bigint, n bigint")
