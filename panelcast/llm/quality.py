"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document's features are its hashed words (term frequencies, L2-normalised), structure
statistics of the text (shares of letters, capitals, digits, marks, blanks, bars;
word and line lengths; repetition) and numeric metadata columns. The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),

so all pairwise interactions cost time linear in the number of features.

Fitting uses at most ``sample_rows`` labelled rows (``SAMPLE_ROWS``), chosen by hashed
id; their features (bounded by the sample) go to the driver, which fits by Adam.
Scoring is one map pass over whole texts, without a shuffle; memory follows one slice
of bytes. The model is 2^``HASH_BITS`` x (1 + ``RANK``) numbers, a fixed size.

Defined results: null text counts as empty; null or non-finite metadata counts as 0;
an empty text has only structure features of 0 and its metadata; with labels of one class
or none the score is the class rate (0.5 without any). Repeated rows are scored each; extra
columns pass through ``score``, an existing column of the output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import slices, span_hashes, string_buffers, word_spans
from panelcast.llm.linear import sigmoid
from panelcast.llm.toxicity import labelled_sample

SAMPLE_ROWS = 8_000
HASH_BITS = 15
RANK = 4
STRUCTURE = ("letters", "capitals", "digits", "marks", "blanks", "bars", "lines", "word_bytes",
             "word_spread", "line_words", "distinct", "same_next", "top_word", "log_words", "stops")


@dataclass
class QualityModel:
    w0: float
    w: np.ndarray       # words, then structure and metadata
    v: np.ndarray       # the same rows, RANK columns
    mean: np.ndarray    # of structure and metadata
    scale: np.ndarray


def _classes() -> dict[str, np.ndarray]:
    byte = np.arange(256)
    lower = (byte >= 97) & (byte <= 122)
    upper = (byte >= 65) & (byte <= 90)
    digit = (byte >= 48) & (byte <= 57)
    blank = (byte == 32) | ((byte >= 9) & (byte <= 13))
    return {"letters": lower | upper | (byte >= 128), "capitals": upper, "digits": digit,
            "blanks": blank, "marks": (byte > 32) & (byte < 127) & ~(lower | upper | digit),
            "bars": byte == ord("|"), "lines": byte == 10, "stops": (byte == 46) | (byte == 33) | (byte == 63)}


_CLASSES = _classes()


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, word bucket, value) triples and the structure matrix of some texts."""
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1).astype(np.float64)
    stats = {}
    for name, members in _CLASSES.items():
        pre = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(members[buf], out=pre[1:])
        stats[name] = (pre[offs[1:]] - pre[offs[:-1]]) / size
    start, end, doc = word_spans(buf, offs)
    width = (end - start).astype(np.float64)
    words = np.bincount(doc, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    mean = np.bincount(doc, width, n) / some
    h = span_hashes(buf, start, end)
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    # distinct words of each text: the document's number and 40 bits of the hash in one integer
    both = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(both))).astype(np.float64)
    d = (both[at] >> np.uint64(40)).astype(np.int64)
    bucket = ((both[at] >> np.uint64(40 - HASH_BITS)) & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, d, count)
    stats |= {"word_bytes": np.log1p(mean), "word_spread": np.sqrt(np.maximum(
                  np.bincount(doc, width ** 2, n) / some - mean ** 2, 0)) / np.maximum(mean, 1),
              "line_words": np.log1p(words / (stats["lines"] * size + 1)),
              "distinct": np.bincount(d, minlength=n) / some,
              "same_next": np.bincount(doc[1:][same], minlength=n) / some,
              "top_word": top / some, "log_words": np.log1p(words)}
    norm = np.sqrt(np.bincount(d, count ** 2, n))
    return d, bucket, count / np.maximum(norm[d], 1), np.stack([stats[k] for k in STRUCTURE], 1)


def _metadata(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    cols = [np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64),
                          nan=0.0, posinf=0.0, neginf=0.0) for c in names]
    dense = np.stack(cols, 1) if cols else np.empty((batch.num_rows, 0))
    return np.sign(dense) * np.log1p(np.abs(dense))


def _meta_columns(metadata: list[str]) -> list[Column]:
    return [F.col(c).cast("double").alias(f"__meta{i}") for i, c in enumerate(metadata)]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", keep: Column | None = None,
        text_col: str = "text", id_col: str = "doc_id", metadata: tuple[str, ...] = ("n_chars",),
        sample_rows: int = SAMPLE_ROWS, epochs: int = 12) -> QualityModel:
    """Fit on at most ``sample_rows`` rows of ``labels`` (0/1 in ``label_col``) that ``keep`` admits."""
    metadata = list(metadata)
    meta = [f"__meta{i}" for i in range(len(metadata))]
    sample = labelled_sample(docs, labels, label_col, keep, sample_rows, *_meta_columns(metadata),
                             text_col=text_col, id_col=id_col)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = string_buffers(batch.column("text"))
            dense_meta = _metadata(batch, meta)
            for i, j in slices(offs):
                d, bucket, value, dense = features(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                per = pa.array(np.searchsorted(d, np.arange(j - i + 1)).astype(np.int32))
                dense = np.concatenate([dense, dense_meta[i:j]], 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), batch.column("label").slice(i, j - i),
                     pa.ListArray.from_arrays(per, pa.array(bucket.astype(np.int32))),
                     pa.ListArray.from_arrays(per, pa.array(value.astype(np.float32))),
                     pa.array([x.tobytes() for x in dense], pa.binary())],
                    ["id", "label", "bucket", "value", "dense"])

    rows = (sample.select(F.col(id_col).cast("string").alias("id"), "label", "text", *meta)
            .mapInArrow(rows_of, "id string, label int, bucket array<int>, value array<float>, dense binary")
            .toArrow())
    order = np.argsort(np.array(rows.column("id").to_pylist(), dtype=object), kind="stable")
    rows = rows.take(pa.array(order.astype(np.int64)))
    y = rows.column("label").to_numpy().astype(np.float64)
    width = (1 << HASH_BITS) + len(STRUCTURE) + len(metadata)
    model = QualityModel(0.0, np.zeros(width), np.zeros((width, RANK)),
                         np.zeros(width - (1 << HASH_BITS)), np.ones(width - (1 << HASH_BITS)))
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        model.w0 = float(np.log(rate / (1 - rate)))
        return model
    dense = np.stack([np.frombuffer(x) for x in rows.column("dense").to_pylist()])
    model.mean, model.scale = dense.mean(0), dense.std(0) + 1e-6
    bucket, value = (rows.column(c).combine_chunks() for c in ("bucket", "value"))
    return _adam(model, bucket.offsets.to_numpy().astype(np.int64), bucket.values.to_numpy().astype(np.int64),
                 value.values.to_numpy().astype(np.float64), _standard(model, dense), y, epochs)


def _standard(model: QualityModel, dense: np.ndarray) -> np.ndarray:
    return np.clip((dense - model.mean) / model.scale, -6, 6) / np.sqrt(dense.shape[1] or 1)


def _sums(model: QualityModel, n: int, d: np.ndarray, bucket: np.ndarray, value: np.ndarray,
          dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine's output before the sigmoid, and its factor sums."""
    words = 1 << HASH_BITS
    linear = np.bincount(d, model.w[bucket] * value, n) + dense @ model.w[words:]
    sums, squares = dense @ model.v[words:], (dense ** 2) @ (model.v[words:] ** 2)
    for f in range(model.v.shape[1]):
        term = model.v[bucket, f] * value
        sums[:, f] += np.bincount(d, term, n)
        squares[:, f] += np.bincount(d, term ** 2, n)
    return model.w0 + linear + 0.5 * (sums ** 2 - squares).sum(1), sums


def _adam(model: QualityModel, per: np.ndarray, bucket: np.ndarray, value: np.ndarray,
          dense: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.02, l2: float = 1e-4,
          size: int = 256) -> QualityModel:
    words, rng = 1 << HASH_BITS, np.random.default_rng(7)
    width = len(model.w)
    theta = np.concatenate([np.zeros((width, 1)), rng.normal(0, 0.05, (width, RANK))], 1)
    moment, second = np.zeros_like(theta), np.zeros_like(theta)
    p = y.mean()
    w0, m0, s0, step = float(np.log(p / (1 - p))), 0.0, 0.0, 0
    docs_of = np.repeat(np.arange(len(y)), np.diff(per))
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // size)):
            rows = np.sort(rows)
            spans = np.concatenate([np.arange(per[r], per[r + 1]) for r in rows])
            d, b, x = np.searchsorted(rows, docs_of[spans]), bucket[spans], value[spans]
            model.w0, model.w, model.v = w0, theta[:, 0], theta[:, 1:]
            z, sums = _sums(model, len(rows), d, b, x, dense[rows])
            err = (sigmoid(z) - y[rows]) / len(rows)
            ex, step = err[d] * x, step + 1
            grad = l2 * theta / len(rows)
            grad[:words, 0] += np.bincount(b, ex, words)
            grad[words:, 0] += dense[rows].T @ err
            for f in range(RANK):
                v = theta[:, 1 + f]
                grad[:words, 1 + f] += np.bincount(b, ex * (sums[d, f] - v[b] * x), words)
                grad[words:, 1 + f] += dense[rows].T @ (err * sums[:, f]) - v[words:] * ((dense[rows] ** 2).T @ err)
            moment = 0.9 * moment + 0.1 * grad
            second = 0.999 * second + 0.001 * grad ** 2
            fix1, fix2 = 1 - 0.9 ** step, 1 - 0.999 ** step
            theta -= rate * (moment / fix1) / (np.sqrt(second / fix2) + 1e-8)
            m0, s0 = 0.9 * m0 + 0.1 * err.sum(), 0.999 * s0 + 0.001 * err.sum() ** 2
            w0 -= rate * (m0 / fix1) / (np.sqrt(s0 / fix2) + 1e-8)
    model.w0, model.w, model.v = w0, theta[:, 0].copy(), theta[:, 1:].copy()
    return model


def score(docs: DataFrame, model: QualityModel, text_col: str = "text",
          metadata: tuple[str, ...] = ("n_chars",), score_col: str = "quality_score",
          columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with the probability of label 1 in ``score_col``."""
    metadata = list(metadata)
    docs = docs.drop(score_col)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size
    kept = docs.select(columns if columns is not None else docs.columns)
    meta, words = [f"__meta{i}" for i in range(len(metadata))], "__words"
    shape = T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            buf, offs = string_buffers(batch.column(words))
            dense_meta = _metadata(batch, meta)
            z = np.empty(batch.num_rows)
            for i, j in slices(offs):
                d, bucket, value, dense = features(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                dense = _standard(model, np.concatenate([dense, dense_meta[i:j]], 1))
                z[i:j], _ = _sums(model, j - i, d, bucket, value, dense)
            yield batch.drop_columns([words, *meta]).append_column(score_col, pa.array(sigmoid(z)))

    text = F.coalesce(F.col(text_col), F.lit("")).alias(words)
    return docs.select(*kept.columns, text, *_meta_columns(metadata)).mapInArrow(run, shape)
