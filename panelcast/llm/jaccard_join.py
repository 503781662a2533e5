"""N-gram Jaccard join with set-relation skipping, down to the components of its links.

A document's set holds its distinct n-word shingles (64-bit hashes). Two sets link when
100 * |intersection| >= percent * |union|. The result is each document's component.

1. Sets under one order. A sketch of shingle counts over all documents (2**bits cells, at most
   2**``MAX_SKETCH_BITS``) puts frequent shingles last; the order only affects the speed.
   Each document gives its size, a 128-bit fingerprint and its prefix, the first
   n - ceil(percent/100 * n) + 1 shingles: sets that link share a shingle of their prefixes. Equal
   sets become one representative (the smallest id) before any list is made.
2. Index lists by shingle, in buckets of hashed shingles, lists of one entry dropped. A list is
   ordered by set size and position; the partners of an entry lie in one window of sizes, which is walked
   block by block: blocks beyond the window and blocks of one group (see 3) are skipped whole. A pair
   stays only if the positions of one of its shared shingles leave enough shingles after it.
3. Answers from answers. First each set is checked with its likeliest neighbour in the lists (the one
   that it most often stands beside). The links so far form groups of highly similar sets; for sets of one
   group the answer follows, and all their pairs in all lists are skipped. Up to ``ROUNDS`` times more, each set is
   checked with its likeliest neighbour of another group, which makes groups of copies grow together in a row
   per copy. Then *all* pairs over the remaining borders are
   gathered, with the number of prefix shingles they share, and dropped where that number bounds the
   intersection below the threshold; the others are checked. So no link between components is missed, while
   a group of thousands of copies costs some rows per copy, not a row per pair. In lists of ``LONG_LIST`` entries
   and more each set brings its parity bitmap (a bit or two per shingle): two bitmaps differ in at most as many
   places as their sets, so most pairs that don't link end in the list's own task.
4. A check compares the bitmaps of all pairs, then finer ones, made from the texts of the documents
   concerned (picked in the scan by a fixed-size Bloom filter); the few pairs that these admit intersect their whole
   sets. So sets, eight bytes a shingle, travel hardly further than the links that they prove.

No step collects rows to the driver; joins by id are skew-split by Spark, since only plain rows with unique
keys stand on one side. Work on one list grows with the square of its *groups*, not of its sets.

Defined results: a null text, or one without words, is empty: size 0, its own component; fewer
words than n make one shingle; null ids give null components; rows of one id are one document's
versions: they link as any others and have one component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import Scratch, distinct, give_back, mix64, partitions_for, saved, slices, string_buffers, text_bytes, tidy
from panelcast.llm.graph import components, id_bitmap, maybe_in
from panelcast.llm.shingles import shingle_hashes, unique_sets

MAX_SKETCH_BITS = 26
SEGMENT = 1 << 14
BUCKET_BYTES = 24_000_000
LEAST_BUCKETS = 64
BLOCK = 64
LONG_LIST = 16
ROUNDS = 2
PAIR_ROWS = 500_000     # pairs that a task holds at once


@dataclass(frozen=True)
class Rule:
    """n-word shingles; sets link at a Jaccard similarity of percent/100."""
    n: int = 5
    percent: int = 80

    def prefix(self, size: np.ndarray) -> np.ndarray:
        return size - -(-size * self.percent // 100) + 1

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least intersection of sets of sizes a and b that link."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def sizes_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets of sizes a and b can link at all: they share no more than the smaller one."""
        return np.minimum(a, b) * 100 >= np.maximum(a, b) * self.percent


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


# ---- the order -------------------------------------------------------------------------------

def frequency_classes(texts: DataFrame, n: int, amount: int) -> np.ndarray:
    """A class per sketch cell: 0 for the bulk, higher for cells far above the mean."""
    bits = int(np.clip(np.log2(max(amount, 1) / 400), 14, MAX_SKETCH_BITS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            buf, offs = string_buffers(batch.column("text"))
            for i, j in slices(offs):
                h, _ = shingle_hashes(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], n)
                at = np.sort((h >> np.uint64(64 - bits)).astype(np.int64))
                new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
                cells[at[new]] += np.diff(np.append(new, len(at))).astype(np.uint32)
        for s in range(0, len(cells), SEGMENT):
            own = cells[s:s + SEGMENT]
            if own.any():
                small = own.astype(np.uint16) if own.max() < 65536 else own
                yield pa.RecordBatch.from_arrays([pa.array([s // SEGMENT], pa.int32()), pa.array([small.tobytes()], pa.binary())],
                                                 ["segment", "cells"])

    def total(key: tuple, group: pa.Table) -> pa.Table:
        out = np.zeros(min(SEGMENT, 1 << bits), np.int64)
        for x in group.column("cells"):
            raw = x.as_buffer()
            out += np.frombuffer(raw, np.uint16 if raw.size == 2 * len(out) else np.uint32)
        return pa.table({"segment": group.column("segment").slice(0, 1), "cells": pa.array([out.tobytes()], pa.binary())})

    shape = "segment int, cells binary"
    cells = np.zeros(1 << bits, np.int64)
    # at most 2**MAX_SKETCH_BITS cells reach the driver
    for r in texts.select("text").mapInArrow(count, shape).groupBy("segment").applyInArrow(tidy(total), shape).collect():
        own = np.frombuffer(r["cells"], np.int64)
        cells[r["segment"] * SEGMENT:r["segment"] * SEGMENT + len(own)] = own
    ratio = np.maximum(cells, 1) / (4 * cells.mean() + 8)
    return np.clip(np.floor(np.log2(ratio)) + 1, 0, 62).astype(np.uint8)


def ordered_sets(buf: np.ndarray, offs: np.ndarray, n: int, classes: np.ndarray) -> list[np.ndarray]:
    """Each document's set as ascending keys: the frequency class, then the hash."""
    h, doc = shingle_hashes(buf, offs, n)
    bits = len(classes).bit_length() - 1
    key = (classes[(h >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (h & np.uint64((1 << 58) - 1))
    return unique_sets(key, doc, len(offs) - 1)


# ---- representatives and lists ---------------------------------------------------------------

def parity(keys: np.ndarray, times: int = 1) -> bytes:
    """A set's parity bitmap, of a power of two of ``times`` to twice as many bits per shingle (64 at least)."""
    width = max(64, 1 << int(times * len(keys) - 1).bit_length())
    return np.packbits((np.bincount((keys & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) folded to ``width`` bytes."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _described(texts: DataFrame, rule: Rule, held) -> DataFrame:
    """(id, size, f1, f2, prefix, bits) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = held.value
        for batch in batches:
            buf, offs = string_buffers(batch.column("text"))
            for i, j in slices(offs):
                sets = ordered_sets(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], rule.n, classes)
                size = np.array([len(x) for x in sets], np.int64)
                mixed = [mix64(x) for x in sets]
                prefix = rule.prefix(size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(size.astype(np.int32)),
                     pa.array([int(x.sum().view(np.int64)) if len(x) else 0 for x in mixed], pa.int64()),
                     pa.array([int(np.bitwise_xor.reduce(x * x | np.uint64(1)).view(np.int64)) if len(x) else 0 for x in mixed], pa.int64()),
                     pa.array([x[:p].tobytes() if len(x) else None for x, p in zip(sets, prefix, strict=True)], pa.binary()),
                     pa.array([parity(x) if len(x) else None for x in mixed], pa.binary())],
                    ["id", "size", "f1", "f2", "prefix", "bits"])

    return texts.mapInArrow(run, "id long, size int, f1 long, f2 long, prefix binary, bits binary")


_ENTRY = np.dtype([("token", "<u8"), ("rep", "<i8"), ("size", "<i4"), ("pos", "<i4"), ("last", "<u4")])


def _lists(reps: DataFrame, buckets: int) -> DataFrame:
    """(bucket, entries): the lists of at least two sets, ordered by (token, size, position, rep)."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = string_buffers(batch.column("prefix"))
            token = np.frombuffer(raw.tobytes(), np.uint64)
            offs = offs // 8
            per = np.diff(offs)
            row = np.repeat(np.arange(batch.num_rows), per)
            out = np.empty(len(token), _ENTRY)
            out["token"], out["rep"] = token, batch.column("rep").to_numpy()[row]
            out["size"], out["pos"] = batch.column("size").to_numpy()[row], np.arange(len(token)) - offs[:-1][row]
            out["last"] = (token[offs[1:] - 1] >> np.uint64(32)).astype(np.uint32)[row]
            bucket = (mix64(token) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            out, cut = out[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array([out[cut[b]:cut[b + 1]].tobytes() for b in full], pa.binary())],
                ["bucket", "entries"])

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(x.as_buffer(), _ENTRY) for x in group.column("entries")])
        token = np.sort(e["token"])
        twice = token[1:][token[1:] == token[:-1]]
        at = np.minimum(np.searchsorted(twice, e["token"]), max(len(twice) - 1, 0))
        e = e[twice[at] == e["token"]] if len(twice) else e[:0]
        e = e[np.lexsort((e["rep"], e["pos"], e["size"], e["token"]))]
        # bounded rows: lists of a bucket in stretches that end with a list
        rows, at = [], 0
        while at < len(e):
            end = min(at + 100_000, len(e))
            while end < len(e) and e["token"][end] == e["token"][end - 1]:
                end += 1
            rows.append(e[at:end].tobytes())
            at = end
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(rows), pa.int32()), "entries": pa.array(rows, pa.binary())})

    shape = "bucket int, entries binary"
    return reps.mapInArrow(deal, shape).groupBy("bucket").applyInArrow(tidy(merge), shape)


def _neighbours(lists: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): each set with the one that it most often stands beside in a list."""
    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("entries"):
                e = np.frombuffer(blob.as_buffer(), _ENTRY)
                ok = e["token"][1:] == e["token"][:-1]
                ok &= e["size"][:-1].astype(np.int64) * 100 >= e["size"][1:].astype(np.int64) * rule.percent
                x, y = e["rep"][:-1][ok], e["rep"][1:][ok]
                a, b = np.concatenate([x, y]), np.concatenate([y, x])
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(np.diff(np.append(new, len(a))))],
                                                 ["a", "b", "n"])

    beside_each = (lists.mapInArrow(beside, "a long, b long, n long").where("a <> b")
                   .groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1"))
    likeliest = beside_each.groupBy("a").agg(F.max(F.struct(F.col("n"), (-F.col("b")).alias("b"))).alias("m"))
    return likeliest.select(F.least(F.col("a"), -F.col("m.b")).alias("a"), F.greatest(F.col("a"), -F.col("m.b")).alias("b")).distinct()


def _places(lists: DataFrame) -> DataFrame:
    """(rep, bucket, long): where each set stands, and whether in a long list there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket"), batch.column("entries"), strict=True):
                e = np.frombuffer(blob.as_buffer(), _ENTRY)
                length = np.diff(np.append(_starts(e["token"]), len(e)))
                both = distinct(e["rep"].astype(np.int64) << 1 | np.repeat(length >= LONG_LIST, length))
                yield pa.RecordBatch.from_arrays([pa.array(both >> 1), pa.array([bucket.as_py()] * len(both), pa.int32()),
                                                  pa.array((both & 1).astype(bool))], ["rep", "bucket", "long"])

    return (lists.mapInArrow(run, "rep long, bucket int, long boolean")
            .groupBy("rep", "bucket").agg(F.bool_or("long").alias("long")))


def _starts(token: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)


def _gathered(static: DataFrame, places: DataFrame, groups: DataFrame) -> DataFrame:
    """A bucket's lists and bitmaps with the groups of its sets; only the groups change between rounds."""
    own = places.join(groups.select(F.col("node").alias("rep"), F.col("component").alias("own")), "rep")
    return static.withColumn("own", F.lit(None).cast("long")).unionByName(own.select(
        "bucket", F.lit(None).cast("binary").alias("entries"), "rep", F.lit(None).cast("binary").alias("bits"), "own"))


def _columns(group: pa.Table) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's entries in list order; where its lists start, their lengths, and each entry's list."""
    e = [np.frombuffer(x.as_buffer(), _ENTRY) for x in group.column("entries") if x.is_valid]
    e = np.concatenate(e) if e else np.empty(0, _ENTRY)
    c = {name: np.ascontiguousarray(e[name]) for name in ("token", "rep", "size", "pos", "last")}
    c["rep"] = c["rep"].astype(np.int64)
    labels = group.filter(pc.is_valid(group.column("own")))
    node, own = labels.column("rep").to_numpy(), labels.column("own").to_numpy()
    order = np.argsort(node)
    node, own = node[order], own[order]
    c["own"] = c["rep"].copy()
    if len(node):
        at = np.minimum(np.searchsorted(node, c["rep"]), len(node) - 1)
        c["own"] = np.where(node[at] == c["rep"], own[at], c["rep"])
    maps = group.filter(pc.is_valid(group.column("bits")))
    bits = {r.as_py(): np.frombuffer(x.as_buffer(), np.uint8) for r, x in zip(maps.column("rep"), maps.column("bits"), strict=True)}
    order = np.lexsort((c["rep"], c["pos"], c["size"], c["token"]))
    c = {k: v[order] for k, v in c.items()}
    c["bits"] = np.empty(len(e), object)
    c["bits"][:] = [bits.get(r) for r in c["rep"].tolist()]
    start = _starts(c["token"])
    length = np.diff(np.append(start, len(e)))
    return c, start, length, np.repeat(np.arange(len(start)), length)


def _likely_across(gathered: DataFrame, tried: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): each set with the one of another group that it seems to share most with: in long lists by
    their bitmaps; in short ones, where standing side by side counts for the list's length, among
    pairs that seem to share most of their prefixes."""
    def likely(key: tuple, group: pa.Table) -> pa.Table:
        c, start, length, at = _columns(group)
        ok = np.flatnonzero((at[1:] == at[:-1]) & (c["own"][1:] != c["own"][:-1]) & (length[at[1:]] < LONG_LIST))
        si = c["size"][ok].astype(np.int64)
        near = si * 100 >= c["size"][ok + 1].astype(np.int64) * rule.percent
        i, j, n, prefix = [ok[near]], [ok[near] + 1], [np.maximum(length[at[ok[near]]] // 2, 1)], [rule.prefix(si[near])]
        for k in np.flatnonzero(length >= LONG_LIST):
            x, y, spare = _best_in_long_list({name: v[start[k]:start[k] + length[k]] for name, v in c.items()}, rule)
            i.append(x + start[k])
            j.append(y + start[k])
            prefix.append(rule.prefix(c["size"][i[-1]].astype(np.int64)))
            n.append(prefix[-1] + spare)
        i, j = np.concatenate(i), np.concatenate(j)
        return pa.table({"a": np.minimum(c["rep"][i], c["rep"][j]), "b": np.maximum(c["rep"][i], c["rep"][j]),
                         "n": np.concatenate(n), "prefix": np.concatenate(prefix)})

    pairs = (gathered.groupBy("bucket").applyInArrow(tidy(likely), "a long, b long, n long, prefix long")
             .groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("prefix").alias("prefix"))
             .where("n * 5 >= prefix * 3").join(tried, ["a", "b"], "left_anti"))
    each = pairs.select("a", "b", "n").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    best = each.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("m"))
    return best.select(F.least("a", -F.col("m.b")).alias("a"), F.greatest("a", -F.col("m.b")).alias("b")).distinct()


def _across(gathered: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): all pairs of different groups whose sets can still link."""
    def found(group: pa.Table) -> Iterator[np.ndarray]:
        c, start, length, lists_at = _columns(group)
        # a list within one group has nothing to ask
        mixed = np.zeros(len(start), bool)
        mixed[lists_at[c["own"] != c["own"][start][lists_at]]] = True
        short = mixed & (length < LONG_LIST)
        if short.any():
            yield from _short_lists(c, start, length, lists_at, short, rule)
        for k in np.flatnonzero(mixed & ~short):
            yield from _long_list({n: v[start[k]:start[k] + length[k]] for n, v in c.items()}, rule)

    def pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in summed(found(pa.Table.from_batches(list(batches))), PAIR_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in some.T], ["a", "b", "margin", "n", "fits"])
        give_back()

    # a pair's shared prefix shingles over all lists, against the least number that can suffice
    return (gathered.groupBy("bucket").applyInArrow(pairs, "a long, b long, margin long, n long, fits long")
            .groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("margin").alias("margin"), F.sum("fits").alias("fits"))
            .where("n >= margin and fits > 0").select("a", "b"))


def summed(parts: Iterator[np.ndarray], limit: int) -> Iterator[np.ndarray]:
    """Rows (a, b, margin, fits) of pairs as (a, b, least margin, rows, sum of fits), of at most about ``limit`` rows at a time:
    a pair may come several times, but a long list's pairs are never held at once."""
    held, n = [], 0

    def merged() -> np.ndarray:
        a, b, margin, count, fits = np.concatenate(held).T
        order = np.lexsort((b, a))
        a, b, margin, count, fits = a[order], b[order], margin[order], count[order], fits[order]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return np.stack([a[new], b[new], np.minimum.reduceat(margin, new), np.add.reduceat(count, new),
                         np.add.reduceat(fits, new)], 1)

    for part in parts:
        if len(part):
            held.append(np.insert(part, 3, 1, axis=1))
            n += len(part)
        if n >= limit:
            held = [merged()]
            n = len(held[0])
            if 2 * n >= limit:
                yield held[0]
                held, n = [], 0
    if n:
        yield merged()


def _pair_rows(c: dict, i: np.ndarray, j: np.ndarray, rule: Rule) -> np.ndarray:
    """Entries i, j of one list that pass by group and size: the pair, the least number of shared prefix
    shingles that can suffice, and whether the positions here leave enough."""
    ok = (c["own"][i] != c["own"][j])
    i, j = i[ok], j[ok]
    si, sj = c["size"][i].astype(np.int64), c["size"][j].astype(np.int64)
    need = rule.needed(si, sj)
    ok = si * 100 >= sj * rule.percent
    i, j, si, sj, need = i[ok], j[ok], si[ok], sj[ok], need[ok]
    # a pair's first shared shingle must leave enough after it; later ones only count
    fits = np.minimum(si - c["pos"][i], sj - c["pos"][j]) >= need
    # the set whose prefix ends first is known in full up to there: what it shares lies among the
    # shared prefix shingles or after its prefix
    rest_i, rest_j = si - rule.prefix(si), sj - rule.prefix(sj)
    li, lj = c["last"][i], c["last"][j]
    rest = np.where(li < lj, rest_i, np.where(lj < li, rest_j, np.maximum(rest_i, rest_j)))
    a, b = np.minimum(c["rep"][i], c["rep"][j]), np.maximum(c["rep"][i], c["rep"][j])
    return np.stack([a, b, need - rest, fits], 1)


def _short_lists(c: dict, start: np.ndarray, length: np.ndarray, lists_at: np.ndarray, some: np.ndarray, rule: Rule) -> Iterator[np.ndarray]:
    at = np.flatnonzero(some[lists_at])
    end = (start + length)[lists_at[at]]
    for off in range(1, int(length[some].max())):
        at, end = at[at + off < end], end[at + off < end]
        for k in range(0, len(at), PAIR_ROWS):
            yield _pair_rows(c, at[k:k + PAIR_ROWS], at[k:k + PAIR_ROWS] + off, rule)


def _block_pairs(c: dict, rule: Rule) -> Iterator[tuple[int, int, np.ndarray]]:
    """A long list, block against block: where two blocks start, and for each of their pairs how many places
    its bitmaps could still differ in if it links (negative: it doesn't). A block of larger sizes than the
    window ends the walk; blocks of one group are skipped."""
    n = len(c["rep"])
    cuts = np.arange(0, n, BLOCK)
    size = c["size"].astype(np.int64)
    low, top = size[cuts], size[np.minimum(cuts + BLOCK, n) - 1]
    own_low, own_high = np.minimum.reduceat(c["own"], cuts), np.maximum.reduceat(c["own"], cuts)
    bits = []
    for x in cuts:
        rows = c["bits"][x:x + BLOCK]
        width = min(len(r) for r in rows)
        bits.append(np.stack([folded(r, width) for r in rows]))
    for x in range(len(cuts)):
        for y in range(x, len(cuts)):
            if top[x] * 100 < low[y] * rule.percent:
                break
            if own_low[x] == own_high[x] == own_low[y] == own_high[y]:
                continue
            width = min(bits[x].shape[1], bits[y].shape[1])
            u, v = (folded(bits[k], width).copy().view(np.uint64) for k in (x, y))
            apart = np.bitwise_count(u[:, None, :] ^ v[None, :, :]).sum(2, dtype=np.int64)
            si, sj = size[cuts[x]:cuts[x] + len(u), None], size[None, cuts[y]:cuts[y] + len(v)]
            # folded to a small set's width, a much larger one's bitmap says nothing: sizes come first
            yield cuts[x], cuts[y], np.where(rule.sizes_fit(si, sj), si + sj - 2 * rule.needed(si, sj) - apart, -1)


def _long_list(c: dict, rule: Rule) -> Iterator[np.ndarray]:
    for x, y, spare in _block_pairs(c, rule):
        i, j = np.nonzero(spare >= 0)
        i, j = i + x, j + y
        if x == y:
            i, j = i[i < j], j[i < j]
        yield _pair_rows(c, i, j, rule)


def _best_in_long_list(c: dict, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, partner, spare places): each entry with the closest one of another group that can link."""
    n = len(c["rep"])
    best, partner = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for x, y, spare in _block_pairs(c, rule):
        rows, cols = spare.shape
        spare = np.where(c["own"][x:x + rows, None] == c["own"][None, y:y + cols], -1, spare)
        for first, other, table in ((x, y, spare), (y, x, spare.T)):
            at = table.argmax(1)
            top = table[np.arange(len(table)), at]
            better = np.flatnonzero(top > best[first:first + len(table)])
            best[first + better], partner[first + better] = top[better], at[better] + other
    some = np.flatnonzero(best >= 0)
    return some, partner[some], best[some]


# ---- checks ----------------------------------------------------------------------------------

def _picked(frame: DataFrame, pairs: DataFrame, make, shape: str, scratch: Scratch) -> DataFrame:
    """``make`` of the batches of ``frame`` with the rows whose id is in ``pairs`` (and perhaps a few more, by
    a Bloom filter of a fixed size): the rows aren't shuffled. Valid while ``scratch`` is."""
    # distinct ids lie in few partitions; each task of pairs would send a filter of its own
    ids = scratch.saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    bits = int(np.clip(np.ceil(np.log2(max(ids.count(), 1) * 32)), 16, 27))
    held = scratch.broadcast(id_bitmap(ids, "id", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from make(batch.filter(pa.array(maybe_in(held.value, batch.column("id").to_numpy()))))

    return frame.mapInArrow(run, shape)


def _sets_of(texts: DataFrame, pairs: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """(rep, size, bits, keys) of the documents in ``pairs``: whole sets as sorted hashes, and bitmaps of four to eight
    bits per shingle."""
    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        buf, offs = string_buffers(batch.column("text"))
        for i, j in slices(offs):
            h, doc = shingle_hashes(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], rule.n)
            sets = unique_sets(h, doc, j - i)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(i, j - i), pa.array([len(x) for x in sets], pa.int32()),
                 pa.array([parity(mix64(x), 4) if len(x) else b"\0" * 8 for x in sets], pa.binary()),
                 pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", "size", "bits", "keys"])

    return _picked(texts, pairs, make, "rep long, size int, bits binary, keys binary", scratch)


def _can_link(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose sizes and bitmaps don't rule a link out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = batch.column("m").to_numpy().astype(np.int64), batch.column("n").to_numpy().astype(np.int64)
            most, fit = m + n - 2 * rule.needed(m, n), rule.sizes_fit(m, n)
            good = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                if not fit[k]:
                    continue
                u, v = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                width = min(len(u), len(v))
                good[k] = np.bitwise_count((folded(u, width) ^ folded(v, width)).view(np.uint64)).sum() <= most[k]
            yield batch.select(["a", "b"]).filter(pa.array(good))

    both = (pairs.join(sets.select(F.col("rep").alias("a"), F.col("size").alias("m"), F.col("bits").alias("x")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("size").alias("n"), F.col("bits").alias("y")), "b"))
    return both.select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def _checked(pairs: DataFrame, texts: DataFrame, reps: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """The pairs (a written table) that link: those that coarse and then fine bitmaps admit, by their whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                common = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum()) if len(u) else 0
                good[k] = 100 * common >= rule.percent * (len(u) + len(v) - common) and common > 0
            yield batch.select(["a", "b"]).filter(pa.array(good))

    with Scratch(texts.sparkSession) as own:
        coarse = _picked(reps.select(F.col("rep").alias("id"), "size", "bits"), pairs, lambda b: [b],
                         "id long, size int, bits binary", own).withColumnRenamed("id", "rep")
        admitted = own.saved(_can_link(pairs, coarse, rule), "admitted")
        sets = own.saved(_sets_of(texts, admitted, rule, own), "sets")
        likely = own.saved(_can_link(admitted, sets, rule), "likely").distinct()
        few = _picked(sets.select(F.col("rep").alias("id"), "keys"), likely, lambda b: [b], "id long, keys binary", own)
        both = (likely.join(few.select(F.col("id").alias("a"), F.col("keys").alias("x")), "a")
                .join(few.select(F.col("id").alias("b"), F.col("keys").alias("y")), "b"))
        return scratch.saved(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct(), "links")


def join_components(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document with an id."""
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    with Scratch(spark) as scratch:
        found = saved(_components(texts, rule, scratch), "components")
    none = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias(id_col), F.lit(None).cast("long").alias("n_shingles"),
                                                     F.lit(None).cast("long").alias("component_id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id").unionByName(none)


def _components(texts: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """(id, n_shingles, component_id), on tables that ``scratch`` holds."""
    spark = texts.sparkSession
    amount = text_bytes(texts, "text")
    classes = scratch.broadcast(frequency_classes(texts, rule.n, amount))  # a fixed size at most
    described = scratch.saved(_described(texts, rule, classes), "described")
    same = ["size", "f1", "f2"]
    reps = scratch.saved(described.where("size > 0").groupBy(*same).agg(
        F.min("id").alias("rep"), F.min("prefix").alias("prefix"), F.min("bits").alias("bits")), "reps")
    # about a byte of prefix entries for a byte of text; never so few buckets that their number decides in how many
    # of them a set stands
    buckets = max(LEAST_BUCKETS, partitions_for(spark, amount, BUCKET_BYTES))
    lists = scratch.saved(_lists(reps.select("rep", "size", "prefix"), buckets), "lists")
    tried = scratch.saved(_neighbours(lists, rule), "tried")
    links = _checked(tried, texts, reps, rule, scratch)
    groups = components(links, scratch)
    places = scratch.saved(_places(lists), "places")
    maps = places.where("long").join(reps.select("rep", "bits"), "rep")
    none = F.lit(None)
    static = scratch.saved(lists.select("bucket", "entries", none.cast("long").alias("rep"), none.cast("binary").alias("bits")).union(
        maps.select("bucket", none.cast("binary").alias("entries"), "rep", "bits")), "static")
    for _ in range(ROUNDS):
        asked = scratch.saved(_likely_across(_gathered(static, places, groups), tried, rule), "tried")
        found = _checked(asked, texts, reps, rule, scratch)
        tried, links = tried.union(asked), links.union(found)
        n_found = found.count()
        if n_found:
            groups = components(links, scratch)
        if n_found * 20 < asked.count():  # groups hardly grow any more
            break
    rest = scratch.saved(_across(_gathered(static, places, groups), rule).join(tried, ["a", "b"], "left_anti"), "rest")
    more = _checked(rest, texts, reps, rule, scratch)
    # equal sets hold documents together by their representative; a document's id may have several sets
    own = described.where("size > 0").join(reps.select(*same, "rep"), same)
    versions = own.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    groups = components(links.union(more).union(versions).distinct(), scratch)
    return (described.select("id", "size").join(groups.withColumnRenamed("node", "id"), "id", "left")
            .select("id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")))
