"""A stored coarse index over card vectors: rows lie in lists around centroids, and a search opens some lists only.

Nothing is overwritten.  A rebuild or an upsert writes a batch of its own
and then one commit file, whose number is taken by creating it: of two writers
at the same number one fails to create it and takes the next.  Readers see the
batches of the last committed rebuild and of the upserts after it, so a batch
that was cut short is never seen, and of a card's rows the last committed one counts.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import vectors as vec
from cardloom.operators import retrieval as rt
from cardloom.scale import slices, top_per_key
from cardloom.session import checkpointed

SAMPLE = 5_000
"""Bound of the sample that the centroids of a course are fitted on; every card is indexed."""
MAX_LISTS = 1024
ROUNDS = 8
MAX_BROADCAST = 32_768
"""Centroids that are broadcast at once, 64 MB; a course has at most ``MAX_LISTS``."""
NO_LIST = -1
"""List of cards in courses that had no centroids at the last rebuild; every search of the course opens it."""

_ROWS = (
    "course string, card_id string, ord bigint, boosted boolean, reference_only boolean, keyword_tokens array<string>, "
    "lexical_counts array<int>, document_counts array<int>, list int"
)


def unit(counts: np.ndarray) -> np.ndarray:
    return counts / vec.norms(counts)[:, None]


def fitted(vectors: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of length one by rounds of nearest centroid and mean; the first rows start them."""
    centres = vectors[np.linspace(0, len(vectors) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        of = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, vectors)
        some = np.einsum("ij,ij->i", sums, sums) > 0
        centres[some] = unit(sums[some])
    return centres


class CoarseIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    # ---- commits ------------------------------------------------------------

    def _files(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        return jvm, folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """Commits in order, each with number, kind and batch; a file whose writer stopped before its content is none."""
        jvm, folder, files = self._files()
        if not files.exists(folder):
            return []
        found = []
        for status in files.listStatus(folder):
            number = re.fullmatch(r"(\d{9})\.json", status.getPath().getName())
            if number:
                stream = files.open(status.getPath())
                content = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                if content:
                    found.append({"number": int(number[1])} | json.loads(content))
        return sorted(found, key=lambda c: c["number"])

    def _commit(self, kind: str, batch: str, after: int = 0) -> None:
        """Takes the next number by creating its file; ``after`` refuses if a rebuild came in between."""
        jvm, folder, files = self._files()
        files.mkdirs(folder)
        number = max((c["number"] for c in self.commits()), default=0)
        while True:
            number += 1
            try:
                stream = files.create(jvm.org.apache.hadoop.fs.Path(folder, f"{number:09d}.json"), False)
            except Py4JJavaError as taken:
                if "AlreadyExists" not in str(taken.java_exception):
                    raise
                continue
            if kind == "more" and any(c["kind"] == "base" and c["number"] > after for c in self.commits()):
                stream.close()  # left empty: no commit
                raise RuntimeError("the index was rebuilt meanwhile; upsert again")
            stream.write(json.dumps({"kind": kind, "batch": batch}).encode())
            stream.close()
            return

    def live(self) -> list[dict]:
        """The last rebuild and the upserts after it."""
        commits = self.commits()
        base = max((c["number"] for c in commits if c["kind"] == "base"), default=None)
        return [] if base is None else [c for c in commits if c["number"] >= base]

    # ---- writing ------------------------------------------------------------

    def _counted(self, cards: DataFrame) -> DataFrame:
        rows = cards if rt.is_counted(cards) else rt.counted_cards(cards)
        return rows.filter("course IS NOT NULL").select(*rt.COUNTED)

    def _write(self, rows: DataFrame, centres: DataFrame, batch: str) -> None:
        rows = _assigned(rows, centres)
        rows.repartitionByRange("course", "list", "ord").write.partitionBy("course", "list").parquet(f"{self.path}/lists/batch={batch}")

    def rebuild(self, cards: DataFrame) -> None:
        """New centroids and lists from ``cards`` (unique ids per course), seen by readers once all is written."""
        batch = uuid.uuid4().hex
        rows = checkpointed(self._counted(cards))
        sizes = rows.groupBy("course").agg(F.least(F.lit(MAX_LISTS), F.round(F.sqrt(F.count("*")))).cast("int").alias("lists"))
        drawn = top_per_key(
            rows.select("course", "document_counts", F.xxhash64("card_id").alias("turn"), "ord"),
            ["course"],
            [F.col("turn"), F.col("ord")],
            SAMPLE,
            salt=F.col("ord"),
        ).join(sizes, "course")

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["turn", "ord"])
            vectors = unit(np.stack(pdf["document_counts"].to_list()).astype(np.float64))
            centres = fitted(vectors, min(int(pdf["lists"].iloc[0]), len(vectors)))
            return pd.DataFrame({"course": pdf["course"].iloc[0], "centres": [list(map(list, centres))]})

        fit_schema = "course string, centres array<array<double>>"
        drawn.groupBy("course").applyInPandas(fit, fit_schema).write.parquet(f"{self.path}/centroids/batch={batch}")
        self._write(rows, self.centroids(batch), batch)
        self._commit("base", batch)

    def upsert(self, cards: DataFrame) -> None:
        """New and changed cards (unique ids per course) join the lists of the present centroids."""
        live = self.live()
        if not live:
            return self.rebuild(cards)
        batch = uuid.uuid4().hex
        self._write(self._counted(cards), self.centroids(live[0]["batch"]), batch)
        self._commit("more", batch, after=live[0]["number"])

    # ---- reading ------------------------------------------------------------

    def centroids(self, batch: str | None = None) -> DataFrame:
        """(course, centres): the centroids of a course, by list number."""
        live = self.live()
        batch = batch or (live[0]["batch"] if live else None)
        schema = "course string, centres array<array<double>>"
        if batch is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/centroids/batch={batch}")

    def rows(self, where: F.Column | None = None) -> DataFrame:
        """Counted rows with their list, each card as last committed; ``where`` on course and list reaches the scan."""
        live = self.live()
        if not live:
            return self.spark.createDataFrame([], _ROWS)
        stored = None
        for commit in live:
            part = self.spark.read.schema(_ROWS).parquet(f"{self.path}/lists/batch={commit['batch']}")
            part = part.withColumn("number", F.lit(commit["number"]))
            stored = part if stored is None else stored.unionByName(part)
        wanted = stored if where is None else stored.filter(where)
        if len(live) == 1:
            return wanted.drop("number")
        later = (
            stored.filter(F.col("number") > live[0]["number"]).groupBy("course", "card_id").agg(F.max("number").alias("last"))
        )
        return wanted.join(later, ["course", "card_id"], "left").filter("last IS NULL OR number >= last").drop("number", "last")


def centroid_lots(centres: DataFrame) -> Iterator[dict[str, np.ndarray]]:
    """Centroids by course, in lots of at most ``MAX_BROADCAST`` in all or of one course."""
    sizes = centres.select("course", F.size("centres").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    lots = 1 if total <= MAX_BROADCAST else -(-2 * total // MAX_BROADCAST)
    for lot in range(lots):
        part = centres if lots == 1 else centres.filter(F.pmod(F.xxhash64("course"), F.lit(lots)) == lot)
        yield {r["course"]: np.array(r["centres"]) for r in part.collect()}


def _assigned(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Rows with the list of the nearest centroid; ties go to the smaller number."""
    names = [c.split()[0] for c in _ROWS.split(", ")]
    known = checkpointed(centres)
    out = rows.join(known.select("course"), "course", "left_anti").withColumn("list", F.lit(NO_LIST)).select(*names)
    for lot in centroid_lots(known):
        shared = rows.sparkSession.sparkContext.broadcast(lot)

        def assign(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in slices(frames):
                pdf = pdf[pdf["course"].isin(shared.value)].reset_index(drop=True)
                found = np.zeros(len(pdf), np.int32)
                for course, at in pdf.groupby("course", sort=False).indices.items():
                    vectors = unit(np.stack(pdf["document_counts"].iloc[at].to_list()).astype(np.float64))
                    found[at] = (vectors @ shared.value[course].T).argmax(axis=1)
                yield pdf.assign(list=found)[names]

        out = out.unionByName(rows.mapInPandas(assign, _ROWS))
    return out
