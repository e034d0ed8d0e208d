"""Boundary to model calls and converters: an injected callable, run per row inside Arrow tasks.

No network code lives here.  Without a callable a deterministic stand-in is used.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom import fixed_values as fixed
from cardloom.scale import slices

DISTIL_INSTRUCTION = (
    "Extract study cards from the given text only. Return one JSON object {\"cards\": [...]}; each card has id, topic, "
    "kind (概念/定理/方法/例题/易错点), keywords, prerequisites, applicability, steps, core_formula_latex, technique, "
    "worked_example, error_notes and source_page. Leave unknown fields empty and skip tables of contents, reading plans and credits."
)


class Transient(Exception):
    """Raised by a callable for a failure worth retrying (rate limit, timeout, 5xx)."""


def raise_for_status(status: int, text: str = "") -> None:
    """For callables that speak HTTP: transient failures as ``Transient``, other failures as an error."""
    if status in fixed.TRANSIENT_STATUS:
        raise Transient(f"status {status}: {text}")
    if status >= 400:
        raise RuntimeError(f"status {status}: {text}")


def with_retries(
    call: Callable[[dict], str],
    attempts: int = fixed.RETRY_ATTEMPTS,
    longest: float = fixed.RETRY_MAX_SECONDS,
    sleep: Callable[[float], None] = time.sleep,
) -> Callable[[dict], str]:
    def tried(row: dict) -> str:
        for attempt in range(1, attempts + 1):
            try:
                return call(row)
            except Transient:
                if attempt == attempts:
                    raise
                sleep(min(2**attempt, longest))
        raise AssertionError

    return tried


def with_json_repair(call: Callable[[dict], str], tries: int = 3) -> Callable[[dict], str]:
    """Ask again with the error until the answer is one JSON object."""

    def repaired(row: dict) -> str:
        problem = ""
        for _ in range(tries):
            asked = {**row, "repair": problem} if problem else row
            text = call(asked) or ""
            fenced = re.search(r"```(?:json)?\s*(.*?)\s*```", text, re.S)
            body = (fenced.group(1) if fenced else text).strip()
            try:
                if isinstance(json.loads(body), dict):
                    return body
                problem = "the top level must be a JSON object"
            except ValueError as exc:
                problem = str(exc)
        raise ValueError(f"no JSON object after {tries} tries: {problem}")

    return repaired


def call_rows(
    df: DataFrame,
    call: Callable[[dict], str],
    result: str,
    partitions: int | None = None,
    error: str | None = None,
) -> DataFrame:
    """Adds ``result`` = ``call(row)``.  ``partitions`` sets how many calls run at once.

    With ``error`` a call that fails leaves a null result and its reason in
    that column, and the job goes on; without it the failure ends the job.
    """
    added = [result, *([error] if error else [])]
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T.StringType()) for name in added]])
    columns = df.columns

    def outcome(row: dict) -> tuple[str | None, str | None]:
        try:
            return call(row), None
        except Exception as exc:  # a row's failure is data
            if not error:
                raise
            return None, f"{type(exc).__name__}: {exc}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            told = [outcome(r) for r in pdf.to_dict("records")]
            yield pdf[columns].assign(**{name: [t[i] for t in told] for i, name in enumerate(added)})

    return (df.repartition(partitions) if partitions else df).mapInPandas(run, schema)


def sample_cards(row: dict) -> str:
    """Stand-in for a card model: up to three cards from the text's own sentences, fixed by their hash."""
    sentences = [s.strip() for s in re.split(r"[。．.!?！？\n]+", row["chunk"]) if len(s.strip()) >= 8]
    ranked = sorted(sentences, key=lambda s: hashlib.md5(s.encode("utf-8")).hexdigest())[:3]
    cards = [
        {
            "id": f"{i}",
            "topic": s,
            "kind": fixed.KINDS[int(hashlib.md5(s.encode("utf-8")).hexdigest(), 16) % len(fixed.KINDS)],
            "keywords": s.split()[:5],
            "steps": [s],
        }
        for i, s in enumerate(ranked)
    ]
    return json.dumps({"cards": cards}, ensure_ascii=False)


def echo_answer(row: dict) -> str:
    """Stand-in for an answering model."""
    return "answer " + hashlib.md5((row["system"] + row["user"]).encode("utf-8")).hexdigest()[:8]


def items(answers: DataFrame, answer: str, array: str) -> DataFrame:
    """Rows ``(item_no, raw_json)`` of the named array in a JSON answer."""
    raw = F.from_json(answer, T.StructType([T.StructField(array, T.ArrayType(T.StringType()))]))[array]
    return answers.select("*", F.posexplode(raw).alias("item_no", "raw_json")).drop(answer)


def convert_slices(slices: DataFrame, convert: Callable[[list[str]], dict[str, str]], stem: str = "stem") -> DataFrame:
    """Run a converter once per request batch; ``convert`` maps the stems of a batch to Markdown.

    A batch holds few slices by construction, so a group stays small.  A
    transient failure is tried again; a batch that fails for good leaves null
    Markdown and its ``call_error``, and the other batches go on.
    """
    schema = T.StructType(
        [
            slices.schema["batch_no"],
            slices.schema[stem],
            T.StructField("md_content", T.StringType()),
            T.StructField("call_error", T.StringType()),
        ]
    )
    tried = with_retries(lambda row: convert(row["stems"]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            done, problem = tried({"stems": pdf[stem].tolist()}), None
        except Exception as exc:  # a batch's failure is data
            done, problem = {}, f"{type(exc).__name__}: {exc}"
        return pdf[["batch_no", stem]].assign(md_content=[done.get(s) for s in pdf[stem]], call_error=problem)

    return slices.groupBy("batch_no", F.xxhash64(F.regexp_replace(stem, r"-\d+$", ""))).applyInPandas(run, schema)


def first_that_works(*calls: Callable[[dict], str]) -> Callable[[dict], str]:
    """Try one source after the other, as for part lists; the last failure is raised."""

    def tried(row: dict) -> str:
        for call in calls[:-1]:
            try:
                return call(row)
            except Exception:  # the next source is the answer to any failure
                continue
        return calls[-1](row)

    return tried


SEGMENTS = "array<struct<start: double, end: double, text: string>>"


def recognised_segments(parts: DataFrame, recognise: Callable[[dict], str], keys: list[str]) -> DataFrame:
    """Speech recognition per part: ``recognise`` returns ``[{start, end, text}, ...]`` as JSON."""
    told = call_rows(parts, with_retries(recognise), "_segments")
    rows = told.select(*keys, F.posexplode(F.from_json("_segments", SEGMENTS)).alias("seq", "_s"))
    text = F.trim("_s.text")
    return rows.select(
        *keys, F.col("seq").cast("bigint").alias("seq"), "_s.start", "_s.end", text.alias("text")
    ).filter(F.col("text") != "")
