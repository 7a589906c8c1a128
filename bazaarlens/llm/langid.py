"""Language ID: averaged embeddings of hashed subwords under a linear softmax.

Subwords are the runs of two to four characters within lower-cased words, with the word's edges. Embeddings and the
softmax are trained by stochastic gradient descent in numpy on a bounded sample of labelled documents, whose subwords are
counted on the executors. A part of the sample calibrates the probabilities (a temperature) and the rejection threshold.
A prediction averages over every subword of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bazaarlens.llm.arrays import slices, text_buffers
from bazaarlens.llm.naming import names_apart

BUCKET_BITS, DIMENSIONS = 16, 16
#: Documents of each language that training looks at; the whole model sees no more than so many times the languages.
SAMPLE_PER_LANGUAGE = 800
#: Share of right predictions that is wanted among those not rejected.
ACCEPT_ACCURACY = 0.99
_LETTER: list[np.ndarray] = []


def held_out(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == 1


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every subword, and which texts have a letter."""
    flat = data.tobytes()
    texts = [flat[a:b].decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    points = np.frombuffer((" " + " ".join(texts) + "   ").encode("utf-32-le", "replace"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), sizes)
    letter = _letters()[points]
    n = len(doc)
    has = np.bincount(doc[letter[1 : n + 1]], minlength=len(texts)) > 0
    points = np.where(letter, points, np.uint32(32))
    buckets, owners = [], []
    inside = np.ones(n, bool)
    h = points[:n] * np.uint32(0x9E3779B1)
    for size in (2, 3, 4):
        if size > 2:
            inside &= letter[size - 2 : size - 2 + n]
        last = points[size - 1 : size - 1 + n]
        h = (h ^ last) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        take = np.flatnonzero(inside & (letter[:n] | letter[size - 1 : size - 1 + n]))
        buckets.append(((h[take] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
        owners.append(np.minimum(doc[take], len(texts) - 1))
    return np.concatenate(buckets), np.concatenate(owners), has


@dataclass(frozen=True)
class LanguageModel:
    labels: list[str]
    #: Per bucket and label: the embedding under the softmax's weights, so that a text's score is a mean of rows.
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _counted(rows: DataFrame) -> DataFrame:
    """label, part and the subword counts of each text, as bytes of int32 buckets and of float32 shares: at most
    2**BUCKET_BITS pairs, however long it is."""
    target = pa.schema([("label", pa.string()), ("part", pa.int64()), ("bucket", pa.binary()), ("share", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            found, shares = [], []
            for d in range(batch.num_rows):
                b, _, _ = subwords(data[offsets[d] : offsets[d + 1]], np.array([0, offsets[d + 1] - offsets[d]]))
                own, n = np.unique(b, return_counts=True)
                found.append(own.astype(np.int32).tobytes())
                shares.append((n / max(1, n.sum())).astype(np.float32).tobytes())
            arrays = [batch.column("label"), batch.column("part"), pa.array(found, pa.binary()), pa.array(shares, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return rows.mapInArrow(work, "label string, part long, bucket binary, share binary")


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
    per_label: int = SAMPLE_PER_LANGUAGE, epochs: int = 4, seed: int = 11,
) -> LanguageModel:
    """Learn from at most about ``per_label`` documents of each label, drawn by a hash of their id over all rows."""
    rows = labelled.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["label"]: r["count"] for r in rows.groupBy(F.col(label_col).alias("label")).count().collect()}
    labels = sorted(counts)
    if not labels:
        return LanguageModel([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k in labels for x in (k, int(min(1, per_label / counts[k]) * (1 << 30)))])
    picked = rows.filter(draw < share[F.col(label_col)])
    sample = _counted(picked.select(F.col(label_col).alias("label"), F.pmod(F.xxhash64(F.lit(seed + 1), id_col), F.lit(10**9)).alias("part"), F.col(text_col).alias("text")))
    docs = sorted(sample.toLocalIterator(), key=lambda r: (r["part"], r["label"], len(r["bucket"])))
    docs = [
        (np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["share"], np.float32), labels.index(r["label"]), r["part"] % 5 == 0)
        for r in docs
    ]
    random = np.random.default_rng(seed)
    embed = (random.random((1 << BUCKET_BITS, DIMENSIONS), dtype=np.float32) - 0.5) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    fit, check = [d for d in docs if not d[3]], [d for d in docs if d[3]]
    for epoch in range(epochs):
        rate = np.float32(0.5 * (1 - epoch / epochs))
        for i in random.permutation(len(fit)):
            bucket, part, label, _ = fit[i]
            x = part @ embed[bucket]
            z = x @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = weights @ p
            weights -= rate * np.outer(x, p)
            bias -= rate * np.float32(0.1) * p
            # a document moves its embeddings by their share in it, scaled so that long ones learn as much as short ones
            embed[bucket] -= rate * np.float32(len(bucket)) ** np.float32(0.5) * np.outer(part, back)
    table = embed @ weights
    z = np.stack([d[1] @ table[d[0]] + bias for d in check]) if check else np.zeros((0, len(labels)))
    truth = np.array([d[2] for d in check], int)

    def loss(t: float) -> float:
        own = z / t - (z / t).max(axis=1, keepdims=True)
        return float((np.log(np.exp(own).sum(axis=1)) - own[np.arange(len(truth)), truth]).sum())

    temperature = min(np.geomspace(0.05, 20, 60), key=loss) if len(truth) else 1.0
    model = LanguageModel(labels, table.astype(np.float32), bias, float(temperature), 0.0)
    threshold = 0.0
    if len(truth):
        p = model.probabilities(z - bias)
        best, right = p.max(axis=1), p.argmax(axis=1) == truth
        order = np.argsort(-best)
        good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= ACCEPT_ACCURACY
        threshold = float(best[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
        threshold = 0.0 if good.all() else threshold
    return LanguageModel(labels, model.table, bias, model.temperature, threshold)


@names_apart
def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (calibrated probability) and accepted (score reaches the rejection threshold).

    A text that is null or has no letter, and any text under a model without labels, is ``und`` with score 0, and not
    accepted. Ties go to the first label. Keeps all columns but the text's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted", text_col)]
    schema = T.StructType([*(docs.schema[c] for c in keep), *new])
    target = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column("__text"))
            labels, scores = [], []
            for a, b in slices(offsets, 1 << 19):
                bucket, doc, has = subwords(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.maximum(np.bincount(doc, minlength=b - a), 1)
                mean = np.stack([np.bincount(doc, m.table[bucket, k], b - a) for k in range(len(m.labels))], axis=1) / n[:, None] if m.labels else None
                p = m.probabilities(mean) if m.labels else np.zeros((b - a, 1))
                best = p.argmax(axis=1)
                known = has & bool(m.labels)
                labels += [m.labels[i] if k else "und" for i, k in zip(best.tolist(), known.tolist(), strict=True)]
                scores.append(np.where(known, p.max(axis=1), 0.0))
            score = np.concatenate([np.zeros(0), *scores])
            accepted = (score > 0) & (score >= m.threshold)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(labels, pa.string()), pa.array(score), pa.array(accepted)], schema=target)

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(work, schema)
