"""Card rows for fixtures, and small brute-force twins of the operators."""

import hashlib
import math
import re
import unicodedata

from cardloom.schema import CARD
from pyspark.sql import types as T

CARD_ORD = T.StructType([*CARD.fields, T.StructField("ord", T.LongType())])


def card(id, topic, kind="方法", course="数学", chapter="第一章", ord=0, **more):
    row = dict(
        id=id, course=course, chapter=chapter, topic=topic, kind=kind, keywords=[], prerequisites=[], applicability="",
        steps=[], core_formula_latex="", technique="", worked_example="", error_notes=[], source_page="", source_url="",
        reference_only=False, ord=ord,
    )
    row.update(more)
    return row


def cards_df(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in CARD_ORD.fieldNames()) for r in rows], CARD_ORD)


def tokens(text):
    clean = unicodedata.normalize("NFKC", text.lower())
    out = re.findall(r"[A-Za-z0-9]+", clean)
    for run in re.findall("[一-鿿]+", clean):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def vector(text):
    v = [0] * 256
    for t in tokens(text):
        h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
        v[h % 256] += 1 if h >> 8 & 1 else -1
    return v


def cosine(a, b):
    na, nb = (math.sqrt(sum(x * x for x in v)) or 1.0 for v in (a, b))
    return sum(x * y for x, y in zip(a, b)) / (na * nb)


def brute_hybrid(question, rows, k, use_vector=True):
    """Straight scoring of all cards of one course; returns (id, rounded score) in rank order."""
    asked, q = set(tokens(question)), vector(question)
    scores, vectors = {}, []
    for c in sorted(rows, key=lambda r: r["ord"]):
        base = [c["topic"], c["applicability"], " ".join(c["steps"]), " ".join(c["keywords"]), c["technique"]]
        full = base + [c["worked_example"], " ".join(c["error_notes"])]
        vectors.append((cosine(q, vector(" ".join(full))), c["ord"], c["id"], c["reference_only"]))
        if c["reference_only"] or not asked:
            continue
        words = {t for w in c["keywords"] for t in tokens(w)}
        s = 0.6 * (len(asked & words) / len(asked)) + 0.35 * cosine(q, vector(" ".join(base)))
        s += 0.15 if c["kind"] in ("方法", "例题") else 0.0
        if s > 0:
            scores[c["id"]] = s
    if use_vector:
        for cos, _, cid, flagged in sorted(vectors, key=lambda v: (-v[0], v[1]))[: max(3 * k, 10)]:
            if not flagged:
                scores[cid] = scores.get(cid, 0.0) + max(0.0, cos)
    return [(i, round(s, 4)) for i, s in sorted(scores.items(), key=lambda x: -x[1])[:k]]
