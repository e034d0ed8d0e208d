"""Exact duplicates of whole texts through compressed tries.

A trie branches at the first byte at which texts differ; an edge carries all
bytes up to the next branch.  The end of a text is a terminal, which holds the
smallest id of the documents with that text.

Each scan task first collects its own texts in tries, so a text that very many
documents share leaves a task once, with the least id there and a number, its
node.  Texts are then dealt out by range over a prefix that is longer where
many texts begin alike, and inserted whole into the trie of their range.  The
walk over that trie gives each node the least id of its text in the whole table.
Documents look that up by their node, of which each task has its own, so no
key is hot and no document list is ever held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.session import checkpointed, shared_table

LOCAL_BYTES = 24 << 20
"""Bytes of edges after which a scan task passes its trie on and starts another."""
RANGE_BYTES = 32 << 20
"""Text bytes that one range aims at."""
HEAVY = 1 << 18
"""A prefix is heavy from 1/HEAVY of all bytes on, so there are at most so many, and they can be broadcast."""
PREFIXES = (32, 256, 2048)
_BATCH_BYTES = 4 << 20


class Trie:
    """Compressed trie over byte strings; a node is [edge bytes, children by first byte, terminal value]."""

    def __init__(self):
        self.root, self.held = [b"", {}, None], 0

    def end_of(self, text: bytes) -> list:
        """The node at which ``text`` ends, made where missing; its value is None until it is set."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None]
                self.held += len(child[0])
                return child
            if text.startswith(child[0], at):
                node, at = child, at + len(child[0])
                continue
            same = _common(child[0], text, at)
            fork = node[1][text[at]] = [child[0][:same], {child[0][same]: child}, None]
            child[0] = child[0][same:]
            node, at = fork, at + same
        return node

    def terminals(self) -> Iterator[tuple[bytes, object]]:
        """(text, value) of every terminal, by a walk over all edges."""
        stack = [(b"", self.root)]
        while stack:
            before, node = stack.pop()
            text = before + node[0]
            if node[2] is not None:
                yield text, node[2]
            stack.extend((text, child) for child in node[1].values())

    def values(self) -> Iterator[object]:
        """The terminals' values alone: a walk that spells no text."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[2] is not None:
                yield node[2]
            stack.extend(node[1].values())


def _common(edge: bytes, text: bytes, at: int) -> int:
    """Length of the common start of ``edge`` and ``text[at:]``, by halving."""
    low, high = 0, min(len(edge), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if edge[low:mid] == text[at + low : at + mid] else (low, mid - 1)
    return low


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def with_least_id(docs: DataFrame, columns: dict[str, pa.DataType], describe: Callable[[bytes], tuple], schema: str) -> DataFrame:
    """(doc_id, least, *columns) of every row of ``docs`` (doc_id, text, ...), text-free.

    ``least`` is the smallest id with the same text in the whole table, null
    where no row with that text has an id or where the row's text is alone
    in its task and nowhere smaller.  ``describe`` gives the values of
    ``columns`` (declared in ``schema``) for a text; other columns of ``docs``
    after the first two are kept.
    """
    spark = docs.sparkSession
    keep = docs.columns[2:]
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[2:])
    names = ["doc_id", "node", *keep, *columns, "text", "head", "size", "least", "several"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, node, schema = Trie(), TaskContext.get().partitionId() << 33, None
        for batch in batches:
            schema = batch.schema
            nodes, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or b""
                end = trie.end_of(text)
                if end[2] is None:
                    end[2] = [node, doc_id, False, describe(text)]
                    node += 1
                else:
                    end[2][1:3] = _least(end[2][1], doc_id), True
                nodes.append(end[2][0])
                found.append(end[2][3])
            own = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(columns.values())]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), *[batch.column(k) for k in keep], *own]
                + [pa.nulls(n, t) for t in (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())],
                names,
            )
            if trie.held > LOCAL_BYTES:
                yield from _terminal_rows(trie, schema, keep, columns, names)
                trie = Trie()
        yield from _terminal_rows(trie, schema, keep, columns, names)

    path = shared_table(spark, "tries")
    declared = f"doc_id bigint, node bigint{kept}, {schema}, text binary, head binary, size bigint, least bigint, several boolean"
    docs.mapInArrow(scan, declared).write.option("compression", "zstd").parquet(path)
    written = spark.read.parquet(path)
    lookup = _least_by_node(spark, written.filter("text is not null").select("node", "text", "head", "size", "least", "several"))
    rows = written.filter("text is null").select("doc_id", "node", *keep, *columns)
    return rows.join(lookup, "node", "left").select("doc_id", "least", *keep, *columns)


def _terminal_rows(trie: Trie, schema: pa.Schema, keep: list, columns: dict, names: list) -> Iterator[pa.RecordBatch]:
    """Rows (node, text, head, size, least, several) of a task's trie, in batches of bounded bytes."""

    def batch(rows: list) -> pa.RecordBatch:
        n = len(rows)
        texts, nodes, least, several = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.array(nodes, pa.int64())]
            + [pa.nulls(n, schema.field(k).type) for k in keep]
            + [pa.nulls(n, kind) for kind in columns.values()]
            + [pa.array(texts, pa.binary()), pa.array([t[: PREFIXES[0]] for t in texts], pa.binary()), pa.array(map(len, texts), pa.int64())]
            + [pa.array(least, pa.int64()), pa.array(several, pa.bool_())],
            names,
        )

    rows, held = [], 0
    for text, (node, least, several, _) in trie.terminals():
        rows.append((text, node, least, several))
        held += len(text)
        if held > _BATCH_BYTES:
            yield batch(rows)
            rows, held = [], 0
    if rows:
        yield batch(rows)


def _prefixed(texts: DataFrame, limit: int) -> DataFrame:
    """With ``prefix``, by which texts are dealt out: longer where the texts of a shorter one exceed ``limit`` bytes."""
    texts = texts.withColumn("prefix", F.col("head"))
    for longer in PREFIXES[1:]:
        heavy = checkpointed(texts.groupBy("prefix").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > limit).select("prefix"))
        if heavy.isEmpty():
            break
        texts = (
            texts.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), "prefix", "left")
            .withColumn("prefix", F.when(F.col("heavy"), F.substring("text", 1, longer)).otherwise(F.col("prefix")))
            .drop("heavy")
        )
    return texts


def _least_by_node(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(node, least) for every node whose text has several documents."""
    total = texts.agg(F.sum("size")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("node", "least", "several")])
            for (node, least, several), text in zip(rows, batch.column("text")):
                end = trie.end_of(text.as_py())
                if end[2] is None:
                    end[2] = [least, several, [node]]
                else:
                    end[2][0] = _least(end[2][0], least)
                    end[2][2].append(node)
        out = [(node, least) for least, several, nodes in trie.values() if several or len(nodes) > 1 for node in nodes]
        for at in range(0, len(out), 1 << 16):
            nodes, least = zip(*out[at : at + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(least, pa.int64())], ["node", "least"])

    dealt = _prefixed(texts, max(total // HEAVY, total // ranges)).repartitionByRange(ranges, "prefix")
    return dealt.select("text", "node", "least", "several").mapInArrow(merge, "node bigint, least bigint")
