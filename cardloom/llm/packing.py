"""Best-fit packing of token sequences in a tree of rounds.

Documents become token pieces of at most ``capacity`` ids.  In the first
round every partition packs its own pieces best-fit, longest first, and emits
the bins that are nearly full.  Its underfull bins travel on as items: the
bins of ``FAN_IN`` nodes meet in one node of the next round and are packed
again, until one node is left, which emits everything.

Scale: the texts are read once; what is shuffled are piece lengths of the
underfull bins only.  A node passes on at most ``CARRY`` bins, the emptiest
ones, and emits the rest as they are, so a node of the tree never holds more
than ``FAN_IN * CARRY`` bins however large the corpus is: no row is dropped, a
bin only stops looking for company.  Every round is checkpointed in the shared
folder, so a lost executor repeats only its own node.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import release, slices
from cardloom.session import checkpointed

CAPACITY = 2048
END = 0
"""Id that closes every document."""
NEARLY_FULL = 0.995
FAN_IN = 8
CARRY = 4096
LEAST_ITEMS = 4_000
"""Small partitions are joined, without a shuffle, to leaves of about so many items."""
LEAF_ITEMS = 100_000
"""Items that a leaf packs at once; a larger partition is packed in several goes."""

PLACED = "doc_id bigint, no_id boolean, piece int, start bigint, length bigint, ids_crc32 bigint, node bigint, bin bigint, offset bigint, done boolean"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _exact(path: str):
    """The tokenizer itself, loaded by the first text that needs it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _encoders(path: str):
    """(fast, special strings) of a tokenizer file; once per Python worker.

    ``fast`` runs the same byte-level BPE, with the ranks of the vocabulary and
    merges in the file, several times faster; texts that hold one of the
    special strings, and all texts where ``fast`` is None, go to the tokenizer itself.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = tuple(t["content"] for t in spec.get("added_tokens", []))
    pattern = _byte_level_pattern(spec)
    if pattern is None:
        return None, special
    visible = _visible_bytes()
    ranks = {bytes(visible[c] for c in token): id_ for token, id_ in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("from_file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return fast, special


def _byte_level_pattern(spec: dict) -> str | None:
    """The split pattern where the file is plain byte-level BPE with ids in merge order; else None."""
    plain = (
        spec["model"].get("type") == "BPE"
        and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        and not spec["pre_tokenizer"].get("add_prefix_space")
        and spec.get("normalizer") is None
    )
    if not plain:
        return None
    vocab = spec["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    ids = [vocab.get("".join(m)) for m in merges]
    if None in ids or any(a >= b for a, b in zip(ids, ids[1:])):
        return None
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=1)
def _visible_bytes() -> dict[str, int]:
    """Byte-level BPE writes bytes as visible characters: itself where printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)})
    return table


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a whole text and the closing id; a null text is empty."""
    fast, special = _encoders(path)
    text = text or ""
    if fast is None or any(s in text for s in special):
        ids = _exact(path).encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_ordinary(text)
    ids.append(END)
    return np.array(ids, dtype="<u4")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, on request, the ``ids`` themselves.

    Only documents of more than ``capacity`` ids are cut: into full pieces,
    but for the first, which takes what is left over.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * ids]
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = token_ids(text.as_py(), path)
                first = len(found) % capacity or capacity
                cuts = [0, *range(first, len(found), capacity), len(found)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = found[a:b]
                    rows.append((doc, piece, a, b - a, zlib.crc32(part.tobytes()), *[part.tolist()] * ids))
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, schema
    )


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length, placed in the given order into the open bin with the least room that holds it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    open_rooms = 0  # bit r is set if a bin with room r is open
    bins, offsets = [], []
    for length in lengths:
        fitting = open_rooms >> length
        if fitting:
            room = length + ((fitting & -fitting).bit_length() - 1)
            found = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            found, room = len(fills), capacity
            fills.append(0)
        bins.append(found)
        offsets.append(fills[found])
        fills[found] += length
        left = room - length
        if left:
            if not by_room[left]:
                open_rooms |= 1 << left
            by_room[left].append(found)
    return bins, offsets


def _packed(rows: pd.DataFrame, node: int, first_bin: int, capacity: int, last: bool) -> pd.DataFrame:
    """Pack the bins in ``rows`` (equal ``bin``: one item) into bins numbered from ``first_bin``."""
    items = rows.groupby("bin", sort=True)["length"].sum()
    order = np.lexsort((items.index.to_numpy(), -items.to_numpy()))
    bins, offsets = best_fit(items.to_numpy()[order].tolist(), capacity)
    place = pd.DataFrame({"new": bins, "shift": offsets}, index=items.index[order])
    at = place.loc[rows["bin"]]
    fill = pd.Series(items.to_numpy()[order]).groupby(np.asarray(bins)).sum()
    done = np.ones(len(fill), bool) if last else (fill >= NEARLY_FULL * capacity).to_numpy()
    waiting = np.flatnonzero(~done)
    if len(waiting) > CARRY:  # the fullest have the least to gain
        rank = np.lexsort((waiting, fill.to_numpy()[waiting]))
        done[waiting[rank[CARRY:]]] = True
    new = at["new"].to_numpy()
    return rows.assign(
        node=node, bin=new + first_bin, offset=rows["offset"].to_numpy() + at["shift"].to_numpy(), done=done[new]
    )


def _leaves(capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        first, waiting = 0, []

        def go() -> pd.DataFrame:
            nonlocal first, waiting
            rows = pd.concat(waiting, ignore_index=True)
            rows = rows.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
            rows["bin"], rows["offset"] = np.arange(len(rows)), 0
            out = _packed(rows, node, first, capacity, False)
            first, waiting = int(out["bin"].max()) + 1, []
            return out

        for frame in frames:
            waiting.append(frame)
            if sum(map(len, waiting)) >= LEAF_ITEMS:
                yield go()
        if any(map(len, waiting)):
            yield go()
        release()

    return run


def _inner(capacity: int, last: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [frame for frame in frames if len(frame)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        for node, own in rows.groupby("parent"):
            own = own.sort_values(["node", "bin", "offset"], kind="stable", ignore_index=True)
            own["bin"] = own.groupby(["node", "bin"], sort=True).ngroup()
            yield _packed(own, int(node), 0, capacity, last).drop(columns="parent")
        del held, rows, own
        release()

    return run


def packed(made: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN) -> DataFrame:
    """``made`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Offsets run without gaps from 0 in each sequence; no sequence holds more
    than ``capacity`` ids.  Sequence ids are round, node and bin in one long.
    """
    leaves = checkpointed(made)
    width = max(1, min(leaves.rdd.getNumPartitions(), -(-leaves.count() // LEAST_ITEMS)))
    leaves = leaves.coalesce(width)
    with_places = leaves.selectExpr(  # pandas has no null in a long
        "coalesce(doc_id, 0L) AS doc_id", "doc_id IS NULL AS no_id", "piece", "start", "length", "ids_crc32", "0L AS node", "0L AS bin", "0L AS offset", "false AS done"
    )
    now = checkpointed(with_places.mapInPandas(_leaves(capacity), PLACED))
    level, parts = 0, []
    while True:
        sequence = F.lit(level << 57) + F.shiftleft(F.col("node"), 33) + F.col("bin")
        parts.append(now.filter("done").withColumn("sequence_id", sequence))
        if width == 1 and level:
            break
        width = -(-width // fan_in)
        level += 1
        parent = F.floor(F.col("node") / fan_in)
        # the node number itself is the key: a bounded node never shares a task by chance of a hash alone
        rest = now.filter(~F.col("done")).withColumn("parent", parent).repartition(width, "parent")
        now = checkpointed(rest.mapInPandas(_inner(capacity, width == 1), PLACED))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every token piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds the closing id alone.
    Repeated rows and null ids are packed as often as they come.  An empty
    table gives an empty table; other columns are not read.
    """
    return packed(pieces(docs, tokenizer, capacity), capacity)


def sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and ``pieces`` (doc_id, piece, offset, length) in order.

    Needs unique doc_ids.  A group is one sequence of at most ``capacity`` ids.
    """
    placed = pack_documents(docs, tokenizer, capacity).select("doc_id", "piece", "length", "sequence_id", "offset")
    with_ids = pieces(docs, tokenizer, capacity, ids=True).select("doc_id", "piece", "ids")
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return (
        placed.join(with_ids, ["doc_id", "piece"])
        .groupBy("sequence_id")
        .agg(parts.alias("p"))
        .select(
            "sequence_id",
            F.flatten("p.ids").alias("ids"),
            F.transform("p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("pieces"),
        )
    )
