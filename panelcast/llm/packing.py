"""Packing token sequences: best-fit decreasing with a segment tree over capacities.

Each document's ids (a public vocabulary's, then an end id) are cut into full windows
first; what is left of it, and each full window, is a piece. Pieces are dealt by a hash into
groups of about ``GROUP_PIECES``; in a group they are placed longest first, each into the open
window whose remaining capacity is the tightest that fits. A segment tree indexed by remaining
capacity holds the number of open windows and finds it in log2(window) steps.

Tokenising is one map pass that emits a few numbers a piece (checksums are taken there), so
neither texts nor ids are shuffled; the plan of pieces is small, dealt evenly (one hot
source or repeated row spreads by the hash of id, position and row number), and written
to the shared folder, so a lost executor costs no second tokenising. The tokenizer's file is read by
every worker. Groups are independent: the padding lost at a group's end is one window in thousands.

Defined results: a null text counts as empty and yields the end id alone; repeated rows are
packed each; equal lengths go by doc_id, then by position; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from panelcast.llm.bpe import PATTERN, byte_alphabet
from panelcast.llm.common import saved

WINDOW = 2048
END_ID = 1
GROUP_PIECES = 50_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A function text -> uint32 ids. Where a vocabulary's ids are in the order of its merges, the
    ranks engine gives the same ids several times as fast as the file's own library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
    merges = ["".join(m.split(" ", 1) if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    ranked = [vocab[m] for m in merges]
    letters = byte_alphabet()
    byte_level = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer")
    if byte_level and ranked == sorted(ranked) and len(ranked) + 256 == len(vocab):
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        return lambda text: fast.encode_to_numpy(text, allowed_special="all")
    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The window (0, 1, ...) of each piece; ``lengths`` must not increase and be in 1..window."""
    leaves = 1 << int(window).bit_length()
    tree = [0] * (2 * leaves)                    # open windows by remaining capacity, summed upwards
    stacks: list[list[int]] = [[] for _ in range(window + 1)]
    out = np.empty(len(lengths), np.int64)
    opened = 0
    for k, n in enumerate(lengths.tolist()):
        if n == window:
            out[k] = opened
            opened += 1
            continue
        # the first non-empty leaf at or right of n: up while there is none on the right, then down
        at = n + leaves
        if not tree[at]:
            while at > 1 and not (at % 2 == 0 and tree[at + 1]):
                at //= 2
            at = at + 1 if at > 1 else 0
            while at and at < leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        if at:
            room = at - leaves
            own = stacks[room].pop()
            while at:
                tree[at] -= 1
                at //= 2
        else:
            room, own = window, opened
            opened += 1
        out[k] = own
        room -= n
        if room:
            stacks[room].append(own)
            at = room + leaves
            while at:
                tree[at] += 1
                at //= 2
    return out


def _pieces(path: str, id_field: T.StructField, window: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, row = tokenizer(path), 0
        for batch in batches:
            texts = batch.column("__text")
            doc, start, length, crc, total, lane, raw = ([] for _ in range(7))
            for k in range(batch.num_rows):
                ids = np.append(ids_of(texts[k].as_py()), end_id).astype("<u4")
                n, blob = len(ids), ids.tobytes()
                for at in range(0, n, window):
                    own = blob[4 * at:4 * (at + window)]
                    doc.append(k)
                    start.append(at)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    total.append(n)
                    lane.append(row)
                    if with_ids:
                        raw.append(own)
                row += 1
            cols = [batch.column(id_field.name).take(pa.array(doc, pa.int64())),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc, total, lane))]
            names = [id_field.name, "start", "length", "ids_crc32", "doc_tokens", "lane"]
            if with_ids:
                cols.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence at which offset.

    ``with_ids`` adds each piece's ids (little-endian unsigned 32-bit) for ``sequences``; the
    checksum of a piece is always of those ids."""
    spark = docs.sparkSession
    id_field = T.StructField(id_col, docs.schema[id_col].dataType)
    longs = ["start", "length", "ids_crc32", "doc_tokens", "lane"]
    shape = T.StructType([id_field, *(T.StructField(c, T.LongType()) for c in longs),
                          *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    pieces = saved(docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
                   .mapInArrow(_pieces(path, id_field, window, end_id, with_ids), shape), "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    out = T.StructType([id_field, *(T.StructField(c, T.LongType()) for c in
                                    ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")),
                        *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    names = [f.name for f in out.fields]

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", id_col, "start", "lane"], ascending=[False, True, True, True])
        length = frame["length"].to_numpy()
        own = best_fit_decreasing(length, window)
        order = np.argsort(own, kind="stable")
        frame, own, length = frame.iloc[order], own[order], length[order]
        before = np.cumsum(length) - length          # ids before each piece in the group
        base = before[np.searchsorted(own, own)]     # ids before its window
        frame = frame.assign(sequence_id=own + (int(frame["__group"].iloc[0]) << 40), offset=before - base)
        return frame[names]

    group = F.pmod(F.xxhash64(id_col, "start", "ids_crc32", "lane"), F.lit(groups))
    return pieces.withColumn("__group", group).groupBy("__group").applyInPandas(place, out)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The sequences themselves, from ``pack(..., with_ids=True)``: (sequence_id, length, ids), the
    ids padded to ``window`` unless their number is a power of two."""
    def join(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(frame.sort_values("offset")["ids"]), "<u4").astype(np.int64)
        n = len(ids)
        full = n if n & (n - 1) == 0 else window
        ids = np.concatenate([ids, np.full(full - n, pad_id, np.int64)])
        return pd.DataFrame({"sequence_id": frame["sequence_id"].iloc[:1], "length": [n], "ids": [ids]})

    return pieces.groupBy("sequence_id").applyInPandas(join, "sequence_id long, length long, ids array<long>")
