"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that ends the prefix's
encoding. It is the token t ending there such that the encoding of what stands before
t ends in a token u and (u, t) is a compatible pair: merging u + t by rank gives u, t
again. So one pass over the positions, trying the vocabulary's matches that end there,
fills the last token of every prefix; following the back-pointers gives the exact ids.

The matches come from a suffix automaton's transitions in the reversed direction: the set of
all token suffixes, walked byte by byte from the position to the left; a walk ends where no token
has that suffix. The pair test undoes the merges of both tokens alternately, latest first, and
looks for a merge across the boundary that would have come earlier. Both run as array
expressions over all distinct pieces of a slice at once; a bounded cache keeps the pieces seen.

Spark scans the texts; one map pass encodes and decodes every whole text, however long, without a shuffle; an empty
table gives no rows.

A text is cut into pieces where the vocabulary's own library cuts it: which characters are letters, numbers or blanks is
asked of its pre-tokenizer once, on the driver, so that a newer Unicode table in the pattern's module doesn't matter. Pieces of
more than ``LONG_PIECE`` bytes are encoded one by one, by the same recurrence in a plain loop.

Defined results: a null text counts as empty, with no ids and an empty decoded text. The
special tokens' strings in a text become their ids, as the tokenizer's file says. Repeated
rows are encoded each; other columns pass through ``encode``, an existing column of an output's
name is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pattern by which this kind of byte-level vocabulary splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_PIECES = 400_000
LONG_PIECE = 256
_NO = np.int32(-1)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary's file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranges(codes: list[int]) -> str:
    """Ascending characters as the inside of a regex set."""
    if not codes:
        return ""
    x = np.array(codes, np.int64)
    new = np.flatnonzero(np.diff(x, prepend=-2) != 1)
    ends = np.append(new[1:], len(x)) - 1
    return "".join(f"\\U{a:08X}-\\U{z:08X}" for a, z in zip(x[new].tolist(), x[ends].tolist(), strict=True))


_KINDS = (r"\p{L}", r"\p{N}", r"\s")


@lru_cache(maxsize=4)
def library_pattern(path: str) -> tuple[str, str]:
    """``PATTERN`` with the letters, numbers and blanks of the library that the vocabulary's file belongs to, and
    the characters for which it differs from ``PATTERN``."""
    from tokenizers import Tokenizer
    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    own = {kind: regex.findall(kind, every) for kind in _KINDS}
    own["other"] = regex.findall(r"[^\s\p{L}\p{N}\p{Cn}]", every)   # what isn't assigned here is in no older table
    doubtful = list(own[r"\s"])
    sample = {r"\p{L}": "a", r"\p{N}": "1", "other": "!"}
    for kind, beside in sample.items():
        for at in range(0, len(own[kind]), 512):
            some = own[kind][at:at + 512]
            if len(cut(beside + "".join(some))) > 1:   # of one kind they are one piece
                doubtful += some

    def kind_of(c: str) -> str:
        """The kind of neighbour that it shares a piece with."""
        return next((kind for kind, beside in sample.items() if len(cut(beside + c)) == 1), r"\s")

    before = {c: kind for kind, chars in own.items() for c in chars}
    moved = {c: kind for c in doubtful if (kind := kind_of(c)) != before[c]}
    if not moved:
        return PATTERN, ""
    classes = []
    for kind in _KINDS:
        more = _ranges(sorted(ord(c) for c, k in moved.items() if k == kind))
        fewer = _ranges(sorted(ord(c) for c in moved if before[c] == kind))
        classes.append(f"[[{kind}{more}]--[{fewer}]]" if fewer else f"[{kind}{more}]")
    letter, number, blank = classes
    pattern = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^{blank}{letter}{number}]+|{blank}+(?![^{blank}])|{blank}+")
    return pattern, "".join(sorted(moved))


class _PairTable:
    """Open-addressed map from a pair of small integers to an integer, for array lookups."""

    def __init__(self, first: np.ndarray, second: np.ndarray, value: np.ndarray):
        bits = max(4, int(len(first) * 4).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        key = first.astype(np.int64) << 32 | second.astype(np.int64)
        slot, todo, step = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            at = (slot[todo] + step) & self.mask
            free = self.keys[at] == -1
            self.keys[at[free]] = key[todo[free]]  # of equal slots the last written stays
            won = self.keys[at] == key[todo]
            self.values[at[won]] = value[todo[won]]
            todo, step = todo[~won], step + 1
        self.longest = step + 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first.astype(np.int64) << 32 | second.astype(np.int64)
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], _NO)
        todo = np.flatnonzero((found != key) & (found != -1))
        for _ in range(self.longest):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class Encoder:
    """One vocabulary: encodes and decodes pieces; bounded cache of distinct pieces."""

    def __init__(self, path: str, pattern: tuple[str, str] = (PATTERN, "")):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        size = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.special = added
        self.usual, self.exact = regex.compile(PATTERN), regex.compile(pattern[0], regex.V1)
        self.odd = frozenset(pattern[1])
        self.far = re.compile(f"[^\\x00-{re.escape(chr(ord(min(pattern[1])) - 1))}]") if pattern[1] else None
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.base = np.full(256, -1, np.int32)
        for token, i in vocab.items():
            if len(token) == 1:
                self.base[letters[token]] = i
        # rank of a token: when its merge comes; single bytes come before all merges
        left, right, made = (np.array([vocab[x] for x in column], np.int64) for column in
                             zip(*((a, b, a + b) for a, b in merges), strict=True)) if merges else (np.empty(0, np.int64),) * 3
        self.rank = np.full(size, -1, np.int64)
        self.rank[made] = np.arange(len(made))
        self.parts = np.stack([np.arange(size), np.arange(size)], 1)
        self.parts[made] = np.stack([left, right], 1)
        self.pair = _PairTable(left, right, np.arange(len(made)))
        self.merges = left, right
        self._automaton(vocab, letters)
        self.cache: dict[str, tuple[str, int, bytes]] = {}

    def _automaton(self, vocab: dict[str, int], letters: dict[str, int]) -> None:
        """States: the suffixes of tokens. step(state of s, byte b) is the state of b + s, or none."""
        state: dict[bytes, int] = {b"": 0}
        source, byte, target, token_at = [], [], [], {0: -1}
        for i in vocab.values():
            word = self.bytes_of[i]
            at = 0
            for k in range(len(word) - 1, -1, -1):
                nxt = state.get(word[k:])
                if nxt is None:
                    nxt = state[word[k:]] = len(state)
                    source.append(at)
                    byte.append(word[k])
                    target.append(nxt)
                at = nxt
            token_at[at] = i
        self.step = _PairTable(np.array(source), np.array(byte), np.array(target))
        self.edges = source, byte, target
        self.plain: tuple[dict, dict, dict] | None = None
        self.token_of = np.full(len(state), -1, np.int32)
        for s, i in token_at.items():
            self.token_of[s] = i

    def compatible(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether encoding the text of u + t gives the tokens u, t, for each pair.

        Undo the merges of both sides, latest first. At each moment the tokens that meet at the
        boundary must not have a merge that comes before the one just undone (for
        the right side: not later than it either, since of equal ranks the left one is first)."""
        u, t = u.astype(np.int64), t.astype(np.int64)
        good = np.zeros(len(u), bool)
        live = np.arange(len(u))
        limit = np.full(len(u), np.iinfo(np.int64).max)
        while len(live):
            a, b, most = u[live], t[live], limit[live]
            cross = self.pair.get(a, b)
            ok = (cross < 0) | (cross >= most)
            live, a, b = live[ok], a[ok], b[ok]
            ra, rb = self.rank[a], self.rank[b]
            end = (ra < 0) & (rb < 0)
            good[live[end]] = True
            live, a, b, ra, rb = live[~end], a[~end], b[~end], ra[~end], rb[~end]
            # the later merge is undone first; of equal ranks the right one was made later
            on_left = ra > rb
            u[live] = np.where(on_left, self.parts[a, 1], a)
            t[live] = np.where(on_left, b, self.parts[b, 0])
            limit[live] = np.where(on_left, ra, rb + 1)
        return good

    def _fits(self, u: int, t: int, ranks: dict[int, int], seen: dict[int, bool]) -> bool:
        """``compatible`` of one pair, remembered."""
        key = u << 32 | t
        if key in seen:
            return seen[key]
        rank, parts, limit, a, b = self.rank, self.parts, 1 << 62, u, t
        while True:
            if ranks.get(a << 32 | b, limit) < limit:
                good = False
                break
            ra, rb = int(rank[a]), int(rank[b])
            if ra < 0 and rb < 0:
                good = True
                break
            if ra > rb:
                limit, a = ra, int(parts[a, 1])
            else:
                limit, b = rb + 1, int(parts[b, 0])
        seen[key] = good
        return good

    def encode_long(self, piece: bytes) -> list[int]:
        """Ids of one long piece, prefix by prefix."""
        if self.plain is None:
            source, byte, target = self.edges
            self.plain = ({a << 8 | b: c for a, b, c in zip(source, byte, target, strict=True)},
                          {int(a) << 32 | int(b): r for r, (a, b) in enumerate(zip(*self.merges, strict=True))}, {})
        step, ranks, seen = self.plain
        if len(seen) > CACHE_PIECES:
            seen.clear()
        token_of, last, width = self.token_of.tolist(), [0] * len(piece), [0] * len(piece)
        for end in range(len(piece)):
            state, at = 0, end
            while at >= 0:
                state = step.get(state << 8 | piece[at], -1)
                if state < 0:
                    break
                token = token_of[state]
                if token >= 0 and (at == 0 or self._fits(last[at - 1], token, ranks, seen)):
                    last[end], width[end] = token, end - at + 1
                    break
                at -= 1
        out, end = [], len(piece) - 1
        while end >= 0:
            out.append(last[end])
            end -= width[end]
        return out[::-1]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; all but long ones at once."""
        long = [k for k, p in enumerate(pieces) if len(p) > LONG_PIECE]
        if long:
            chains = self.encode_pieces([b"" if len(p) > LONG_PIECE else p for p in pieces])
            for k in long:
                chains[k] = self.encode_long(pieces[k])
            return chains
        sizes = np.array([len(p) for p in pieces], np.int64)
        if not len(sizes) or not sizes.max():
            return [[] for _ in pieces]
        order = np.argsort(-sizes, kind="stable")
        n_by = sizes[order]
        offs = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(n_by, out=offs[1:])
        buf = np.frombuffer(b"".join([pieces[i] for i in order]), np.uint8)
        last = np.full(int(offs[-1]), -1, np.int32)   # last token of the prefix that ends with this byte
        width = np.zeros(int(offs[-1]), np.int32)      # its bytes
        most = int(n_by[0])
        for end in range(1, most + 1):
            live = np.searchsorted(-n_by, -end, side="right")  # pieces of at least `end` bytes
            here = offs[:live] + end - 1
            state = np.zeros(live, np.int64)
            todo = np.arange(live)
            for back in range(1, end + 1):
                state = self.step.get(state, buf[here[todo] - back + 1]).astype(np.int64)
                walk = state >= 0
                todo, state = todo[walk], state[walk]
                if not len(todo):
                    break
                token = self.token_of[state]
                is_token = np.flatnonzero(token >= 0)
                if back < end and len(is_token):
                    before = last[here[todo[is_token]] - back]
                    is_token = is_token[self.compatible(before, token[is_token])]
                at = here[todo[is_token]]
                last[at], width[at] = token[is_token], back
                if len(is_token):  # the last token of a prefix is unique
                    rest = np.ones(len(todo), bool)
                    rest[is_token] = False
                    todo, state = todo[rest], state[rest]
        # back-pointers, all pieces at once
        chains: list[list[int]] = [[] for _ in pieces]
        at = offs[1:] - 1
        live = np.flatnonzero(n_by > 0)
        steps = []
        while len(live):
            steps.append((live, last[at[live]]))
            at[live] -= width[at[live]]
            live = live[at[live] >= offs[live]]
        if steps:
            piece = np.concatenate([s[0] for s in steps])
            token = np.concatenate([s[1] for s in steps])
            by = np.argsort(piece, kind="stable")
            piece, token = piece[by], token[by]
            cut = np.searchsorted(piece, np.arange(len(pieces) + 1))
            flat = token.tolist()
            for k, i in enumerate(order.tolist()):
                chains[i] = flat[cut[k]:cut[k + 1]][::-1]
        return chains

    def split(self, text: str) -> list[str]:
        """The pieces of a stretch of text; the slower exact pattern only where it differs."""
        exact = self.odd and not text.isascii() and self.far.search(text) and not self.odd.isdisjoint(text)
        return (self.exact if exact else self.usual).findall(text)

    def parts_of(self, text: str) -> list[tuple[bool, str]]:
        """A text's stretches, and whether each is a special token's string."""
        if self.special_split is None:
            return [(False, text)]
        found = self.special_split.split(text)
        return [(i % 2 == 1, x) for i, x in enumerate(found) if x] if len(found) > 1 else [(False, text)]

    def learn(self, pieces: set[str]) -> None:
        """Put the encodings of pieces into the cache."""
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        names = list(pieces)
        for p, ids in zip(names, self.encode_pieces([p.encode() for p in names]), strict=True):
            self.cache[p] = (",".join(map(str, ids)), len(ids), b"".join([self.bytes_of[i] for i in ids]))

    def look_up(self, texts: list[str]) -> Iterator[list[tuple[str, int, bytes]]]:
        """For each text, what the cache holds for each of its pieces; a slice of texts at a time."""
        cache, i = self.cache, 0
        while i < len(texts):
            cut, size = [], 0
            while i < len(texts) and (size < 4_000_000 or not cut):
                plain = [(special, x if special else self.split(x)) for special, x in self.parts_of(texts[i])]
                cut.append(plain)
                size += len(texts[i])
                i += 1
            pieces = {p for plain in cut for special, found in plain if not special for p in found}
            new = pieces.difference(cache)
            if len(cache) + len(new) > CACHE_PIECES:
                cache.clear()
                new = pieces
            self.learn(new)
            for plain in cut:
                out: list[tuple[str, int, bytes]] = []
                for special, found in plain:
                    if special:
                        out.append((str(self.special[found]), 1, found.encode()))
                    else:
                        out += [cache[p] for p in found]
                yield out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for row in rows for i in row[0].split(",")] for rows in self.look_up(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: tuple[str, str] = (PATTERN, "")) -> Encoder:
    """One encoder per Python worker and vocabulary; its cache outlives a task."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
           decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of every whole text, and the text decoded from them if asked for.

    ``path`` names the vocabulary's file, which every worker must be able to open."""
    docs = docs.drop(ids_col, *([decoded_col] if decoded_col else []))
    shape = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())),
                          *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])])
    text, pattern = "__text", library_pattern(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            ids = own.encode(batch.column(text).to_pylist())
            out = batch.drop_columns([text]).append_column(ids_col, pa.array(ids, pa.list_(pa.int32())))
            if decoded_col:
                out = out.append_column(decoded_col, pa.array([own.decode(x) for x in ids], pa.string()))
            yield out

    return docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, shape)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the number of ids, and SHA-256 of the joined decimal ids and of the decoded text."""
    shape = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()),
                          T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    pattern = library_pattern(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for rows in own.look_up(batch.column("__text").to_pylist()):
                decoded = b"".join([r[2] for r in rows]).decode("utf-8", errors="replace")
                out[0].append(sum([r[1] for r in rows]))
                out[1].append(hashlib.sha256(",".join([r[0] for r in rows]).encode()).hexdigest())
                out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(out[0], pa.int64()), *(pa.array(x, pa.string()) for x in out[1:])],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, shape)
