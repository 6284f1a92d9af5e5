"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonestats.llm.byte_bpe import text_runs
from zonestats.llm.common import saved, smallest_by_hash

DIM = 4096  # hashed n-grams of one to three bytes
SAMPLE = 300  # documents a language's centroids are clustered from
CENTROIDS = 3
RUN = 512  # rows whose counts are held at once (``DIM`` each)
_ASCII = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def counts(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Hashed n-gram counts of each text: lower case, runs of what is not a
    letter as one space, n-grams of one to three bytes."""
    plain = [b" " + b" ".join(t.lower().encode().translate(_ASCII).split()) + b" " for t in texts]
    x = np.frombuffer(b"\0".join(plain), np.uint8).astype(np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(p) + 1 for p in plain])[: len(x)]
    out = np.zeros(len(texts) * dim, np.int64)
    for n in (1, 2, 3):
        g, ok = np.zeros(len(x) - n + 1, np.uint32), np.ones(len(x) - n + 1, bool)
        for i in range(n):
            part = x[i: len(x) - n + 1 + i]
            g = g * np.uint32(257) + part + np.uint32(n)
            ok &= part != 0
        h = ((g * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(dim)
        out += np.bincount(doc[: len(h)][ok] * dim + h[ok], minlength=len(out))
    return out.reshape(len(texts), dim)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(texts, len(idf))).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _document_frequencies(batches, dim: int):
    total = np.zeros(dim + 1, np.int64)
    for batch in batches:
        for _, texts in text_runs(batch, 1 << 18, RUN):
            total[:dim] += (counts(texts, dim) > 0).sum(axis=0)
            total[dim] += len(texts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(total)], names=["gram", "docs"])


def _cluster(frame: pd.DataFrame, idf: np.ndarray, k: int) -> pd.DataFrame:
    """Spherical k-means from farthest-first starts over one language's sample."""
    frame = frame.sort_values("h")
    x = vectors(frame["text"].fillna("").tolist(), idf)
    x = x[np.linalg.norm(x, axis=1) > 0]
    rows = []
    if len(x):
        c = x.mean(axis=0, keepdims=True)
        c = x[[int(np.argmax(x @ c.T))]]
        while len(c) < min(k, len(x)):
            c = np.vstack([c, x[int(np.argmin((x @ c.T).max(axis=1)))]])
        for _ in range(12):
            own = (x @ c.T).argmax(axis=1)
            c = np.vstack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = x @ c.T
        own = near.argmax(axis=1)
        for i in range(len(c)):
            if (own == i).any():  # half the similarity of the farthest member still counts as near
                rows.append((c[i].astype("<f4").tobytes(), float(near[own == i, i].min()) / 2))
    return pd.DataFrame({"lang": [frame["lang"].iloc[0]] * len(rows), "centroid": [r[0] for r in rows],
                         "least": [r[1] for r in rows]})


def fit(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        dim: int = DIM, sample: int = SAMPLE, k: int = CENTROIDS) -> dict:
    """Inverse document frequencies over all training rows (language known,
    not held out); centroids from at most ``sample`` rows of each language,
    the smallest by a hash of the id. The model has ``dim`` numbers and ``k``
    centroids of ``dim`` numbers for each language.

    A null or empty text counts as a document without n-grams and gives no
    centroid; rows without an id are one id, rows that repeat an id and language
    are sampled together; other columns are ignored. Without training rows the
    model has no language, and every text is ``und``."""
    train = docs.filter(~F.coalesce(held_out, F.lit(False)) & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    seen = train.select("text").mapInArrow(partial(_document_frequencies, dim=dim), "gram long, docs long") \
        .groupBy("gram").agg(F.sum("docs").alias("docs")).toPandas().sort_values("gram")  # dim + 1 rows
    df = seen["docs"].to_numpy() if len(seen) else np.zeros(dim + 1, np.int64)
    idf = (np.log((1 + df[dim]) / (1 + df[:dim])) + 1).astype(np.float32)
    picked = smallest_by_hash(train.select("lang", "doc_id").distinct(), "lang", sample)
    picked = saved(picked, "lang-sample")
    texts = train.join(F.broadcast(picked), ["lang", "doc_id"])
    model = texts.groupBy("lang").applyInPandas(lambda frame: _cluster(frame, idf, k), "lang string, centroid binary, least double").toPandas()
    model = model.sort_values(["lang", "centroid"])
    return {"idf": idf, "langs": model["lang"].tolist(), "least": model["least"].to_numpy(),
            "centroids": np.vstack([np.frombuffer(c, "<f4") for c in model["centroid"]]) if len(model) else np.zeros((0, dim), np.float32)}


def _predict_rows(batches, model: dict):
    langs, c = model["langs"], model["centroids"]
    for batch in batches:
        for first, texts in text_runs(batch, 1 << 18, RUN):
            near = vectors(texts, model["idf"]) @ c.T if langs else np.zeros((len(texts), 1))
            best = near.argmax(axis=1)
            top = near[np.arange(len(texts)), best]
            known = [bool(langs) and has_letter(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, len(texts)),
                 pa.array([langs[b] if ok else "und" for b, ok in zip(best, known)]),
                 pa.array([float(min(max(s, 0.0), 1.0)) if ok else 0.0 for s, ok in zip(top, known)]),
                 pa.array([not ok or bool(s < model["least"][b]) for b, s, ok in zip(best, top, known)])],
                names=["doc_id", "nearest", "score", "rejected"])


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, nearest (language of the nearest
    centroid by cosine; ``und`` for a text that is null or has no letter, or
    if the model has no language), score (that cosine, 0 to 1; 0 for ``und``),
    rejected (nothing near enough: the cosine is under half that of the
    centroid's farthest member), lang (nearest, or ``und`` if rejected).

    Reads the text only. Repeated rows are judged alike, ties go to the first
    language in order, an empty table gives no rows, other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    out = src.mapInArrow(partial(_predict_rows, model=model),
                         f"doc_id {kind}, nearest string, score double, rejected boolean")
    return out.withColumn("lang", F.when(F.col("rejected"), F.lit("und")).otherwise(F.col("nearest")))
