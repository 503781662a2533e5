"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Words are runs of ASCII letters (A-Z count as a-z), digits and all characters beyond ASCII. An item's windows are
its ``n`` consecutive words; an item of fewer words, but not none, is one window. The distinct windows are
broadcast as sorted hashes beside the items' words. Each task hashes the windows of whole texts (prefix
sums, one subtraction a window), looks them up, and compares every hit with the item's own words byte by
byte, so equal hashes alone never count. A document word inside any occurrence of a window is hit.

``find`` adds what was found; ``remove_spans`` cuts the hit words out, ``remove_documents`` drops
documents whose share of hit words is above a limit.

Scale: one map pass over the documents, no shuffle. What is broadcast is bounded: at most ``BLOCK_BYTES``
of item words. A larger benchmark is dealt into blocks below that bound (the sizes are checked; items
of more than ``SEGMENT_WORDS`` words are cut into pieces that overlap by n - 1 words, so each window lies in
one), each block is a pass of its own that writes only its hits, and a document's hits are joined.

Null and empty texts have no words; a null or wordless item has no window; rows of one item id are one item; the
windows of items without an id count as hits, but are not listed; repeated documents are each
scanned; whole texts are read, in slices of some megabytes (a longer text is one slice); an empty benchmark hits
nothing; other columns are kept, one called ``found_col`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import MIX, _powers, mix64, saved, slices, span_hashes, string_buffers, word_spans

BLOCK_BYTES = 8 << 20
SEGMENT_WORDS = 65_536
_CHECK = 65_536  # hits compared at once

#: The characters between words, for the JVM; the same bytes for NumPy.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = np.zeros(256, bool)
_BETWEEN[:128] = True
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])))])
_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])


class Words(NamedTuple):
    """The words of some texts: spans of one lower-cased byte array, and each word's text."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    @staticmethod
    def of(buf: np.ndarray, offs: np.ndarray) -> Words:
        buf = _LOWER[buf]
        return Words(buf, *word_spans(buf, offs, _BETWEEN))

    def prefix(self) -> np.ndarray:
        """Prefix sums of the words' hashes, each times a power of an odd base."""
        h = span_hashes(self.buf, self.start, self.end)
        out = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _powers(len(h) + 1)[0][:-1], out=out[1:])
        return out

    def left(self) -> np.ndarray:
        """Words from each one to the end of its text."""
        return np.searchsorted(self.doc, self.doc, side="right") - np.arange(len(self.doc))


def run_hashes(prefix: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place."""
    return mix64((prefix[at + k] - prefix[at]) * _powers(len(prefix))[1][at] + np.array([k], np.uint64) * MIX)


def same_words(a: Words, a_at: np.ndarray, b: Words, b_at: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from a place of ``a`` are those from a place of ``b``, byte by byte."""
    out = np.zeros(len(a_at), bool)
    for lo in range(0, len(a_at), _CHECK):
        i = a_at[lo:lo + _CHECK, None] + np.arange(k)
        j = b_at[lo:lo + _CHECK, None] + np.arange(k)
        size = a.end[i] - a.start[i]
        alike = (size == b.end[j] - b.start[j]).all(1)
        some = np.flatnonzero(alike)
        each = size[some].ravel()
        inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        differ = a.buf[np.repeat(a.start[i[some].ravel()], each) + inner] != b.buf[np.repeat(b.start[j[some].ravel()], each) + inner]
        owner = np.repeat(np.repeat(some, k), each)
        alike[owner[differ]] = False
        out[lo:lo + _CHECK] = alike
    return out


class Windows(NamedTuple):
    """The distinct windows of one length: sorted hashes, a place each, and the class of their item sets."""

    hashes: np.ndarray
    at: np.ndarray
    sets: np.ndarray
    sieve: np.ndarray


class Index(NamedTuple):
    words: Words
    windows: dict[int, Windows]
    set_offs: np.ndarray   # items of set s: set_items[set_offs[s]:set_offs[s + 1]]
    set_items: np.ndarray
    items: list[str]


def build(items: list[str | None], texts: pa.Array, n: int) -> Index:
    """The windows of a bounded block of items."""
    words = Words.of(*string_buffers(texts))
    prefix, left = words.prefix(), words.left()
    names = sorted({x for x in items if x is not None})
    number = {x: k for k, x in enumerate(names)}
    own = np.array([number.get(x, -1) for x in items], np.int64)
    size = np.bincount(words.doc, minlength=len(items))[words.doc] if len(words.doc) else np.empty(0, np.int64)
    length = np.where(left >= n, n, np.where((left == size) & (size < n), size, 0))
    sets: dict[bytes, int] = {}
    windows = {}
    for k in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(length == k)
        h = run_hashes(prefix, at, k)
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        new = np.ones(len(at), bool)   # unlike the one before: unequal windows of one hash stay apart
        new[1:] = (h[1:] != h[:-1])
        again = np.flatnonzero(~new)
        new[again] = ~same_words(words, at[again], words, at[again - 1], k)
        group = np.cumsum(new) - 1
        pairs = np.unique(np.stack([group, own[words.doc[at]]], 1), axis=0)
        cut = np.searchsorted(pairs[:, 0], np.arange(group[-1] + 2))
        of_set = np.array([sets.setdefault(pairs[cut[g]:cut[g + 1], 1][pairs[cut[g]:cut[g + 1], 1] >= 0].tobytes(), len(sets))
                           for g in range(group[-1] + 1)], np.int64)
        bits = min(22, max(12, int(len(h) * 8).bit_length()))
        sieve = np.zeros(1 << bits, bool)
        sieve[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
        windows[k] = Windows(h[new], at[new], of_set, sieve)
    lists = [np.frombuffer(x, np.int64) for x in sets]
    offs = np.cumsum([0, *(len(x) for x in lists)])
    return Index(words, windows, offs, np.concatenate([np.empty(0, np.int64), *lists]), names)


def scan(words: Words, n_docs: int, index: Index) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which words are hit, and the numbers of the items found in each text."""
    prefix, left = words.prefix(), words.left()
    edge = np.zeros(len(words.doc) + 1, np.int64)
    seen = [np.empty(0, np.int64)]
    n_sets = max(len(index.set_offs) - 1, 1)
    for k, known in index.windows.items():
        at = np.flatnonzero(left >= k)
        h = run_hashes(prefix, at, k)
        maybe = known.sieve[(h >> np.uint64(65 - len(known.sieve).bit_length())).astype(np.int64)]
        at, h = at[maybe], h[maybe]
        lo = np.searchsorted(known.hashes, h, side="left")
        runs = np.searchsorted(known.hashes, h, side="right") - lo
        place = np.repeat(at, runs)
        window = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(lo, runs)
        true = same_words(words, place, index.words, known.at[window], k)
        place, window = place[true], window[true]
        edge += np.bincount(place, minlength=len(edge)) - np.bincount(place + k, minlength=len(edge))
        seen.append(np.unique(words.doc[place] * n_sets + known.sets[window]))
    pairs = np.unique(np.concatenate(seen))
    doc, of = pairs // n_sets, pairs % n_sets
    cut = np.searchsorted(doc, np.arange(n_docs + 1))
    found = [np.unique(np.concatenate([np.empty(0, np.int64), *(
        index.set_items[index.set_offs[s]:index.set_offs[s + 1]] for s in of[cut[d]:cut[d + 1]])]))
        if cut[d] < cut[d + 1] else seen[0] for d in range(n_docs)]
    return np.cumsum(edge[:-1]) > 0, found


def runs_of(hit: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of every run of hit words of one text."""
    apart = doc[1:] != doc[:-1]
    first, last = hit.copy(), hit.copy()
    first[1:] &= ~hit[:-1] | apart
    last[:-1] &= ~hit[1:] | apart
    return np.flatnonzero(first), np.flatnonzero(last)


def _grouped(values: pa.Array, per: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), values)


def _found(words: Words, offs: np.ndarray, hit: np.ndarray, items: pa.ListArray) -> pa.StructArray:
    n = len(offs) - 1
    first, last = runs_of(hit, words.doc)
    base = offs[words.doc[first]]
    spans = pa.StructArray.from_arrays([pa.array(words.start[first] - base), pa.array(words.end[last] - base)], ["begin", "end"])
    per = np.bincount(words.doc[first], minlength=n)
    return pa.StructArray.from_arrays(
        [pa.array(np.bincount(words.doc, minlength=n)), pa.array(np.bincount(words.doc[hit], minlength=n)), items,
         _grouped(spans, per)], ["n_words", "n_hit", "items", "spans"])


def _texts(batch: pa.RecordBatch, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    return string_buffers(batch.column(text_col).fill_null(""))


def _named(found: list[np.ndarray], names: list[str]) -> pa.ListArray:
    flat = np.concatenate([np.empty(0, np.int64), *found])
    return _grouped(pa.array(names, pa.string()).take(pa.array(flat)), np.array([len(x) for x in found], np.int64))


def blocks(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> list[DataFrame]:
    """(item, text) of the benchmark's words, in frames of at most ``BLOCK_BYTES`` of text each."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    every = benchmark.select(F.col(item_col).cast("string").alias("item"),
                             F.regexp_extract_all(lower, F.lit(f"({WORD})"), 1).alias("w")).where("size(w) > 0")
    pieces = F.greatest(F.ceil((F.size("w") - (n - 1)) / SEGMENT_WORDS), F.lit(1)).cast("int")
    every = every.select("item", "w", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    text = F.array_join(F.slice("w", F.col("piece") * SEGMENT_WORDS + 1, F.lit(SEGMENT_WORDS + n - 1)), " ")
    every = every.select("item", text.alias("text")).distinct()
    size = F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)))
    total, parts = every.agg(size).first()[0] or 0, 1
    if total <= BLOCK_BYTES:
        return [every]
    every = saved(every, "items")
    most = total
    while most > BLOCK_BYTES:   # pieces are small beside a block, so this ends
        parts = max(2 * parts, -(-2 * total // BLOCK_BYTES))
        block = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
        most = every.groupBy(block.alias("b")).agg(size.alias("s")).agg(F.max("s")).first()[0]
    return [every.where(block == b) for b in range(parts)]


def _index(block: DataFrame, n: int) -> Broadcast:
    held = block.toArrow()   # at most BLOCK_BYTES, checked in blocks()
    texts = held.column("text").combine_chunks() if held.num_rows else pa.array([], pa.string())
    return block.sparkSession.sparkContext.broadcast(build(held.column("item").to_pylist(), texts, n))


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", found_col: str = "contamination") -> DataFrame:
    """``docs`` with a struct ``found_col``: n_words, n_hit, items (ids found, as strings, sorted), and spans
    (byte offsets of the runs of hit words in the UTF-8 text)."""
    parts = blocks(benchmark, n, item_col, item_text_col)
    kept = docs.drop(found_col)
    shape = T.StructType([*kept.schema.fields, T.StructField(found_col, FOUND)])
    if len(parts) == 1:
        held = _index(parts[0], n)

        def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                buf, offs = _texts(batch, text_col)
                for i, j in slices(offs):
                    words = Words.of(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                    hit, items = scan(words, j - i, held.value)
                    out = _found(words, offs[i:j + 1] - offs[i], hit, _named(items, held.value.items))
                    yield batch.slice(i, j - i).append_column(found_col, out)

        return kept.mapInArrow(one_pass, shape)

    kept = saved(kept.withColumn("__row", F.monotonically_increasing_id()), "documents")
    hits = None
    for part in parts:
        held = _index(part, n)
        found = saved(kept.select("__row", text_col).mapInArrow(_hits_of(held, text_col), _HITS), "hits")
        held.destroy()
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("__row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("__first", "__last")],
                                     F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = _texts(batch, text_col)
            for i, j in slices(offs):
                words = Words.of(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                edge = np.zeros(len(words.doc) + 1, np.int64)
                base = np.searchsorted(words.doc, np.arange(j - i))
                for name, by, step in (("__first", 0, 1), ("__last", 1, -1)):
                    column = batch.column(name).slice(i, j - i)
                    per = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                    edge += step * np.bincount(column.flatten().to_numpy() + np.repeat(base, per) + by, minlength=len(edge))
                column = batch.column("__items").slice(i, j - i)
                items = _grouped(column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                out = _found(words, offs[i:j + 1] - offs[i], np.cumsum(edge[:-1]) > 0, items)
                yield batch.select(shape.names[:-1]).slice(i, j - i).append_column(found_col, out)

    return kept.join(hits, "__row", "left").mapInArrow(joined, shape)


_HITS = "__row long, __first array<long>, __last array<long>, __items array<string>"


def _hits_of(held: Broadcast, text_col: str):
    """For the documents that a block's windows hit: the runs of hit words (numbers in the text) and the items."""
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = _texts(batch, text_col)
            for i, j in slices(offs):
                words = Words.of(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                hit, items = scan(words, j - i, held.value)
                first, last = runs_of(hit, words.doc)
                per = np.bincount(words.doc[first], minlength=j - i)
                base = np.searchsorted(words.doc, words.doc[first])
                out = pa.RecordBatch.from_arrays(
                    [batch.column("__row").slice(i, j - i), _grouped(pa.array(first - base), per),
                     _grouped(pa.array(last - base), per), _named(items, held.value.items)],
                    ["__row", "__first", "__last", "__items"])
                yield out.filter(pa.array(per > 0))
    return hits


def remove_documents(docs: DataFrame, benchmark: DataFrame, share: float = 0.0, **options) -> DataFrame:
    """The documents whose hit words are at most ``share`` of their words."""
    out = find(docs, benchmark, found_col="__found", **options)
    return out.where(F.col("__found.n_hit") <= share * F.col("__found.n_words")).drop("__found")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents, each without its runs of hit words (from the first one's start to the last one's end)."""
    out = find(docs, benchmark, text_col=text_col, found_col="__found", **options)
    return out.withColumn(text_col, without(text_col, "__found.spans")).drop("__found").select(docs.columns)


def without(text_col: str, spans_col: str) -> Column:
    """A text without spans of bytes; spans begin and end between characters."""
    raw, spans = F.encode(text_col, "UTF-8"), F.col(spans_col)
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["begin"]), F.array(F.octet_length(text_col).cast("long")))
    rest = F.zip_with(begins, ends, lambda a, z: F.decode(F.substring(raw, (a + 1).cast("int"), (z - a).cast("int")), "UTF-8"))
    return F.when(F.size(spans) > 0, F.array_join(rest, "")).otherwise(F.col(text_col))
