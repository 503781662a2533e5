"""Toxicity: character n-gram linear classifier with naive Bayes log-count ratios.

A document's features are the distinct byte n-grams (n = 4, 5, 6, packed exactly
into 64 bits) of its lower-cased text with every run of other characters than
letters as one blank. Each feature is scaled by its naive Bayes log-count ratio
r = log((p / |p|) / (q / |q|)); a logistic regression is fitted on the scaled features.

Fitting uses at most ``sample_rows`` labelled rows (``SAMPLE_ROWS``), those of the
smallest hashed doc_id; everything else is distributed:

1. document frequencies of n-gram buckets by class over the sample, summed per segment
   of buckets; buckets whose class rates differ significantly stay;
2. exact n-grams of those buckets, with their frequencies by class, the same test;
3. the sample's rows over those n-grams (a few dozen a row) go to the driver, which
   fits the weights. The bound on the rows bounds what is gathered.

Scoring is one map pass over whole texts: no shuffle, memory of one slice of bytes.

Defined results: null text counts as empty; an empty text gets the score of the
intercept alone; rows without a label take no part in fitting; with no labelled
row, or one class only, the score is the class rate (0.5 without any). Repeated rows
are scored each; extra columns pass through ``score`` untouched unless they have the names
of its outputs, which it replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import MIX, distinct, slices, string_buffers
from panelcast.llm.linear import fit_logistic, sigmoid

SIZES = (4, 5, 6)
SAMPLE_ROWS = 20_000
BUCKET_BITS = 20
SEGMENT = 1 << 14
MIN_Z = 4.0
MIN_DOCS = 4


@dataclass
class ToxicityModel:
    keys: np.ndarray    # sorted packed n-grams
    weights: np.ndarray  # weight * log-count ratio of each
    bias: float


def _blank_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64)
    for c in range(128):
        if not chr(c).isalpha():
            table[c] = 32
    return table


_BLANK = _blank_table()


def _ngrams(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(packed n-gram, document) for each size; a blank stands before and after a text."""
    n_docs = len(offs) - 1
    at = offs + np.arange(n_docs + 1) * 2
    padded = np.full(int(at[-1]) + 1, 32, np.uint64)
    lens = np.diff(offs)
    doc = np.repeat(np.arange(n_docs), lens + 2)
    inner = np.ones(int(at[-1]), bool)
    inner[at[:-1]] = False
    inner[at[1:] - 1] = False
    padded[:-1][inner] = _BLANK[buf]
    padded = padded[:-1]
    # a run of blanks counts once
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32) | (doc[1:] != doc[:-1])
    padded, doc = padded[keep], doc[keep].astype(np.int32)
    key = padded.copy()
    for n in range(2, max(SIZES) + 1):
        key = (key[:-1] << np.uint64(8)) | padded[n - 1:]
        if n in SIZES and len(key):
            same = doc[n - 1:] == doc[:len(key)]
            yield key[same] | np.uint64(n << 56), doc[:len(key)][same]


def _bucket(key: np.ndarray) -> np.ndarray:
    return ((key * MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _z(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Two-sample z of the document rates of the classes."""
    p, q = pos / n_pos, neg / n_neg
    mean = (pos + neg) / (n_pos + n_neg)
    var = np.maximum(mean * (1 - mean), 1e-12) * (1 / n_pos + 1 / n_neg)
    return (p - q) / np.sqrt(var)


def _unique_pairs(doc: np.ndarray, feature: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    pair = distinct(doc.astype(np.int64) * width + feature)
    return pair // width, pair % width


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = 1 << BUCKET_BITS
    counts = np.zeros((2, width), np.int32)
    for batch in batches:
        buf, offs = string_buffers(batch.column("text"))
        y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in slices(offs):
            own = buf[offs[i]:offs[j]]
            grams = list(_ngrams(own, offs[i:j + 1] - offs[i]))
            if grams:
                d, f = _unique_pairs(np.concatenate([d for _, d in grams]), _bucket(np.concatenate([k for k, _ in grams])), width)
                for label in (0, 1):
                    counts[label] += np.bincount(f[y[i:j][d] == label], minlength=width).astype(np.int32)
    full = [s for s in range(width // SEGMENT) if counts[:, s * SEGMENT:(s + 1) * SEGMENT].any()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()),
         pa.array([counts[:, s * SEGMENT:(s + 1) * SEGMENT].tobytes() for s in full], pa.binary())],
        ["segment", "counts"])


def _prepared(docs: DataFrame, text_col: str, *others: Column) -> DataFrame:
    return docs.select(F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"), *others)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column | None,
                    sample_rows: int, *others: Column, text_col: str = "text",
                    id_col: str = "doc_id") -> DataFrame:
    """(text, label, others) of at most ``sample_rows`` labelled rows that ``keep`` admits.

    The ids are chosen first (a bounded top-k of hashed ids), then one broadcast join of
    that bounded list picks the texts from the scan."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    if keep is not None:
        ids = ids.where(keep)
    ids = (ids.groupBy(id_col).agg(F.max(F.col(label_col)).cast("int").alias("label"))
           .orderBy(F.xxhash64(id_col), id_col).limit(sample_rows))
    docs = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"), *others)
    return docs.join(F.broadcast(ids), id_col)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", keep: Column | None = None,
        text_col: str = "text", id_col: str = "doc_id",
        sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most ``sample_rows`` rows of ``labels`` (0/1 in ``label_col``) that ``keep`` admits."""
    spark = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // 4)
    sample = (labelled_sample(docs, labels, label_col, keep, sample_rows, text_col=text_col, id_col=id_col)
              .select(F.col(id_col).cast("string").alias("id"), F.lower("text").alias("text"), "label")
              .repartition(min(parts, 32), "id").persist())
    try:
        return _fit_sample(sample)
    finally:
        sample.unpersist()


def _fit_sample(sample: DataFrame) -> ToxicityModel:
    none = np.empty(0, np.uint64), np.empty(0)
    by_class = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_pos, n_neg = by_class.get(1, 0), by_class.get(0, 0)
    if not n_pos or not n_neg:
        rate = (n_pos + 0.5) / (n_pos + n_neg + 1.0)
        return ToxicityModel(*none, float(np.log(rate / (1 - rate))))

    def tested(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int32).reshape(2, -1).astype(np.int64) for c in frame["counts"])
        neg, pos = total
        good = np.flatnonzero((pos + neg >= MIN_DOCS) & (np.abs(_z(pos, neg, n_pos, n_neg)) >= MIN_Z))
        return pd.DataFrame({"bucket": good + int(frame["segment"].iloc[0]) * SEGMENT})

    found = (sample.select("text", "label").mapInArrow(_bucket_counts, "segment int, counts binary")
             .groupBy("segment").applyInPandas(tested, "bucket long").toPandas())
    marked = np.zeros(1 << BUCKET_BITS, bool)
    marked[found["bucket"].to_numpy(np.int64)] = True

    def exact_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, poss = [], []
        for batch in batches:
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            for key, doc in _marked_pairs(batch, marked):
                keys.append(key)
                poss.append(y[doc])
        if keys:
            every, label = np.concatenate(keys), np.concatenate(poss)
            key = distinct(every)
            at = np.searchsorted(key, every)
            pos = np.bincount(at, label, len(key)).astype(np.int64)
            n = np.bincount(at, minlength=len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(pos), pa.array(n - pos)],
                                             ["key", "pos", "neg"])

    mean = (F.col("pos") + F.col("neg")) / (n_pos + n_neg)
    z = (F.col("pos") / n_pos - F.col("neg") / n_neg) / F.sqrt(
        F.greatest(mean * (1 - mean), F.lit(1e-12)) * (1 / n_pos + 1 / n_neg))
    chosen = (sample.select("text", "label").mapInArrow(exact_counts, "key long, pos long, neg long")
              .groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
              .where((F.col("pos") + F.col("neg") >= MIN_DOCS) & (F.abs(z) >= MIN_Z)).toPandas())
    keys = chosen["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    if not len(keys):
        return ToxicityModel(*none, float(np.log(n_pos / n_neg)))
    p = chosen["pos"].to_numpy(np.float64)[order] + 1.0
    q = chosen["neg"].to_numpy(np.float64)[order] + 1.0
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    table = _lookup(keys)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [np.empty(0, np.int64)]
            for key, doc in _marked_pairs(batch, table):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                hits.append(doc[hit] * len(keys) + at[hit])
            pairs = distinct(np.concatenate(hits))
            per = np.searchsorted(pairs // len(keys), np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"),
                 pa.ListArray.from_arrays(pa.array(per), pa.array((pairs % len(keys)).astype(np.int32)))],
                ["id", "label", "features"])

    # rows of equal features count as one with a weight, so copies cost nothing
    rows = (sample.mapInArrow(rows_of, "id string, label int, features array<int>")
            .groupBy("label", "features").agg(F.count("*").cast("double").alias("n"), F.min("id").alias("id"))
            .toArrow().sort_by([("id", "ascending"), ("label", "ascending")]))
    y, weight = rows.column("label").to_numpy().astype(np.float64), rows.column("n").to_numpy()
    features = rows.column("features").combine_chunks()
    per, cols = np.diff(features.offsets.to_numpy()), features.values.to_numpy().copy()
    del rows, features
    pa.default_memory_pool().release_unused()
    w, bias = fit_logistic(np.repeat(np.arange(len(y), dtype=np.int32), per), cols, ratio.astype(np.float32)[cols], y, weight, len(keys))
    return ToxicityModel(keys, w * ratio, bias)


def _lookup(keys: np.ndarray) -> np.ndarray:
    marked = np.zeros(1 << BUCKET_BITS, bool)
    marked[_bucket(keys)] = True
    return marked


def _marked_pairs(batch: pa.RecordBatch, marked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (n-gram, document) of a batch whose bucket is marked."""
    buf, offs = string_buffers(batch.column("text"))
    for i, j in slices(offs):
        for key, doc in _ngrams(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]):
            hit = marked[_bucket(key)]
            key, doc = key[hit], doc[hit].astype(np.int64)
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            yield key[new], doc[new] + i


def scorer(model: ToxicityModel) -> Callable[[pa.RecordBatch], np.ndarray]:
    marked = _lookup(model.keys)

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        total = np.full(batch.num_rows, model.bias)
        if len(model.keys):
            for key, doc in _marked_pairs(batch, marked):
                at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
                hit = model.keys[at] == key
                total += np.bincount(doc[hit], model.weights[at[hit]], batch.num_rows)
        return sigmoid(total)

    return scores


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text",
          score_col: str = "toxicity", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with the probability of label 1 in
    ``score_col``, for every whole text."""
    docs = docs.drop(score_col)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # thousands of n-grams at most, by the sample's bound
    kept = docs.select(columns if columns is not None else docs.columns)
    lowered, shape = "__lowered", T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(held.value)
        for batch in batches:
            texts = batch.select([lowered]).rename_columns(["text"])
            rest = batch.drop_columns([lowered])
            yield rest.append_column(score_col, pa.array(scores(texts)))

    text = F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias(lowered)
    return docs.select(*kept.columns, text).mapInArrow(run, shape)
