"""Jaccard join, suffix arrays and suffix dedup against brute force."""

import random
import tracemalloc

import numpy as np
import pytest
from brute import components, removed

from panelcast.llm import jaccard_join, suffix_array, suffix_dedup
from panelcast.llm.common import Scratch
from panelcast.llm.graph import components as graph_components
from panelcast.llm.graph import id_bitmap, maybe_in

WORDS = [a + b for a in ("ba", "ko", "li", "mu", "te") for b in ("n", "r", "s", "t")]


def near_copies(seed, n_groups=6, size=25, words=60, edits=4):
    rng, rows = random.Random(seed), []
    for _ in range(n_groups):
        base = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(5, words))]
        for _ in range(rng.randrange(1, size)):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return rows


ODD = [None, "", " \t\n", "One two", "one TWO", "one two three four five", "ONE two three four five", "a a a a a a a a a", "a " * 3000,
       "é É é É é", "x\x0by\x0cz w v"]


def docs_of(spark, texts, ids=None):
    ids = ids if ids is not None else [3 * i + 1 for i in range(len(texts))]
    return spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, size int")


def joined(spark, docs, rule):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(docs, rule).collect()}


@pytest.mark.parametrize("seed,n,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_components_of_near_copies(spark, seed, n, percent):
    texts = near_copies(seed) + ODD + ["the very same line of words here"] * 20
    docs = docs_of(spark, texts)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert joined(spark, docs, jaccard_join.Rule(n, percent)) == components(rows, n, percent)


def test_long_lists_walk_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "PAIR_ROWS", 40)   # answers leave in many batches
    texts = near_copies(7, n_groups=3, size=60, words=40, edits=9)
    docs = docs_of(spark, texts)
    want = components([(r.doc_id, r.text) for r in docs.collect()], 3, 70)
    assert joined(spark, docs, jaccard_join.Rule(3, 70)) == want


@pytest.mark.parametrize("limit", [1, 50, 10_000])
def test_pairs_summed_in_batches(limit):
    rng = np.random.default_rng(limit)
    rows = np.stack([rng.integers(0, 9, 2000), rng.integers(9, 20, 2000), rng.integers(-5, 5, 2000), rng.integers(0, 2, 2000)], 1)
    want, got = {}, {}
    for a, b, margin, fits in rows.tolist():
        m, n, f = want.get((a, b), (99, 0, 0))
        want[a, b] = min(m, margin), n + 1, f + fits
    batches = list(jaccard_join.summed(iter(np.array_split(rows, 40)), limit))
    for a, b, margin, n, fits in np.concatenate(batches).tolist():
        m, k, f = got.get((a, b), (99, 0, 0))
        got[a, b] = min(m, margin), k + n, f + fits
    assert got == want
    assert max(map(len, batches)) <= max(limit + 50, 99)
    assert not list(jaccard_join.summed(iter([np.empty((0, 4), np.int64)]), limit))


def test_a_long_list_is_never_held_whole():
    """All pairs of 3,000 near copies of which none is in a group yet: 4.5 million."""
    n = 3000
    bits = np.zeros(n, object)
    bits[:] = [np.zeros(8, np.uint8)] * n
    c = {"rep": np.arange(n), "own": np.arange(n), "size": np.full(n, 40, np.int32), "pos": np.zeros(n, np.int32),
         "last": np.zeros(n, np.uint32), "bits": bits}
    tracemalloc.start()
    total = sum(len(x) for x in jaccard_join.summed(jaccard_join._long_list(c, jaccard_join.Rule()), 100_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == n * (n - 1) // 2
    assert peak < 60e6


def test_links_at_the_threshold(spark):
    """17 of 20 shingles in common is 85 of 100; 16 of 20 isn't."""
    def text(k):
        return [f"w{i}" for i in range(20 - k)] + [f"v{k}_{i}" for i in range(k)]
    base = " ".join(f"w{i}" for i in range(20))
    rows = [base, " ".join(text(0)[:17]), " ".join(text(0)[:16])]
    got = joined(spark, docs_of(spark, rows, [5, 6, 7]), jaccard_join.Rule(1, 85))
    assert got == {5: (20, 5), 6: (17, 5), 7: (16, 5)}   # 16 of 17 links 7 to 6
    got = joined(spark, docs_of(spark, [rows[0], rows[2]], [5, 7]), jaccard_join.Rule(1, 85))
    assert got == {5: (20, 5), 7: (16, 7)}


def test_join_null_and_repeated_ids_and_empty_tables(spark):
    same, other = "a b c d e f g", "q r s t u v w"
    docs = docs_of(spark, [same, same, other, same, None], [4, 4, 4, None, None])
    rows = jaccard_join.join_components(docs, jaccard_join.Rule()).collect()
    assert sorted([(r.doc_id or -1, r.component_id or -1) for r in rows]) == [(-1, -1), (-1, -1), (4, 4), (4, 4), (4, 4)]
    # an id with two versions links what is like either
    docs = docs_of(spark, [same, other, same, other], [4, 4, 9, 8])
    assert {c for _, c in joined(spark, docs, jaccard_join.Rule()).values()} == {4}
    assert jaccard_join.join_components(docs.limit(0), jaccard_join.Rule()).count() == 0


def test_graph_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, 200), (500, 300)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in graph_components(frame, scratch).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent if x != 200}
    with Scratch(spark) as scratch:
        assert graph_components(frame.limit(0), scratch).count() == 0


def test_id_bitmap_holds_all_ids(spark):
    ids = spark.range(0, 100_000, 7)
    packed = id_bitmap(ids, "id", 20)
    assert maybe_in(packed, np.arange(0, 100_000, 7)).all()
    assert maybe_in(packed, np.arange(10 ** 9, 10 ** 9 + 10_000)).mean() < 0.01


def naive_order(t):
    ends = np.flatnonzero(t == 0)

    def key(i):
        end = int(ends[np.searchsorted(ends, i)])
        return [(1, int(c)) for c in t[i:end]] + [(0, end)]
    return sorted((i for i in range(len(t)) if t[i]), key=key)


@pytest.mark.parametrize("sweep", [1024, 0])
def test_suffix_order(monkeypatch, sweep):
    monkeypatch.setattr(suffix_array, "SWEEP_LETTERS", sweep)
    rng = np.random.default_rng(10)
    for trial in range(200):
        parts = [rng.integers(1, rng.integers(2, 6), rng.integers(1, 25)) for _ in range(rng.integers(1, 8))]
        if trial % 3 == 0:
            parts = [np.tile(x, rng.integers(1, 4)) for x in parts]
        if trial % 5 == 0:
            parts += [parts[0]]
        t = np.concatenate([np.append(x, 0) for x in parts]).astype(np.uint16)
        assert suffix_array.suffix_order(t, int(t.max()) + 1).tolist() == naive_order(t)


@pytest.mark.parametrize("length", [3, 8, 13, 50])
def test_common_prefixes(length):
    rng = np.random.default_rng(11)
    base = rng.integers(97, 99, 80).astype(np.uint8)
    raw = np.concatenate([np.append(base[rng.integers(0, 9):], 0) for _ in range(12)]).astype(np.uint8)
    t = np.where(raw == 0, 0, raw.astype(np.uint16) + 1)
    ends = np.flatnonzero(raw == 0)
    order = suffix_array.suffix_order(t, 257)
    order = order[ends[np.searchsorted(ends, order)] - order >= length]
    got = suffix_array.common_prefix_at_least(raw, order, length)
    want = [bytes(raw[a:a + length]) == bytes(raw[b:b + length]) for a, b in zip(order[:-1], order[1:], strict=True)]
    assert got.tolist() == want


def passages(seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(20, 200))) for _ in range(6)]
    texts = []
    for _ in range(40):
        text = ""
        for _ in range(rng.randrange(4)):
            own = rng.choice(shared)
            cut = rng.randrange(len(own))
            text += "".join(rng.choice("xyzuvw\n") for _ in range(rng.randrange(60))) + own[cut // 3:]
        texts.append(text)
    return texts


EDGE = [None, "", "short", "z" * 49, "z" * 50, "z" * 51, "z" * 400, "ab" * 100, "ba" * 90, "é" * 60, "ñ" + "é" * 40, "\x00" * 70, "\x00" * 55 + "q"]


@pytest.mark.parametrize("seed,length", [(1, 50), (2, 30), (3, 12)])
def test_removed_bytes(spark, monkeypatch, seed, length):
    monkeypatch.setattr(suffix_dedup, "UNIT_BYTES", 500)
    texts = passages(seed) + EDGE + [EDGE[6]] * 5
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    docs = docs_of(spark, texts, ids)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs, length=length).collect()}
    assert got == removed(list(zip(ids, texts, strict=True)), length)


def test_common_line_between_other_words_is_dealt_to_many_shards(spark, monkeypatch):
    for name, value in (("SHARD_TEXT", 8_000), ("HEAVY_BYTES", 3_000), ("UNIT_BYTES", 6_000), ("UNIT_STRINGS", 500)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng, line = random.Random(5), "a line of forty-six bytes that all documents have"[:46]
    word = lambda: "".join(rng.choice("bcdfghjklm") for _ in range(60))
    texts = [word() + line + word() for _ in range(600)]
    texts += [t[20:130] for t in texts[::9]] + [t[:100] + word() for t in texts[::13]]
    seen, answers = {}, suffix_dedup._answers

    def counted(cut, length):
        for r in cut.where("shard >= 0").select("shard", "sizes").collect():
            seen[r.shard] = seen.get(r.shard, 0) + int(np.frombuffer(r.sizes, "<u2").sum())
        return answers(cut, length)
    monkeypatch.setattr(suffix_dedup, "_answers", counted)
    docs = docs_of(spark, texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs).collect()}
    assert max(seen.values()) <= 3 * 8_000
    assert got == removed([(r.doc_id, r.text) for r in docs.collect()], 50)


def test_dedup_texts_null_and_repeated_ids(spark):
    line = "this line of more than fifty bytes stands in many documents. "
    docs = docs_of(spark, [line, line, line + "é", None, "own " + line], [1, 1, 2, 3, None])
    rows = sorted((r.doc_id or 0, r.text, r.size) for r in suffix_dedup.deduplicated(docs).collect() if r.doc_id != 3)
    # the null id is earlier than all; rows of one id aren't earlier than each other
    assert rows == [(0, "own " + line, 0), (1, "", 0), (1, "", 0), (2, "é", 0)]
    assert [r.text for r in suffix_dedup.deduplicated(docs).where("doc_id = 3").collect()] == [None]
    spans = suffix_dedup.deduplicated(docs, spans_col="cut").where("doc_id = 2").first().cut
    assert [(s.start, s.end) for s in spans] == [(0, len(line))]
    assert suffix_dedup.digests(docs.limit(0)).count() == 0


def test_cut_within_a_character(spark):
    shared = "q" * 48 + "é"                              # 50 bytes; the next ones differ in their second byte
    docs = docs_of(spark, ["q" * 48 + "éa" + "1" * 9, "q" * 49 + "b", "w" + "q" * 48 + "ê" + "2" * 9], [1, 2, 3])
    got = {r.doc_id: r.text for r in suffix_dedup.deduplicated(docs, length=49).collect()}
    want = removed([(r.doc_id, r.text) for r in docs.collect()], 49)
    assert got[3].encode().isascii() and len(got[3]) <= want[3][0] - want[3][1] and shared


def test_anchors_are_shared_by_equal_strings():
    rng = np.random.default_rng(12)
    text = rng.integers(97, 100, 300).astype(np.uint8)
    joined_text = np.concatenate([text, rng.integers(97, 123, 77).astype(np.uint8), text])
    offs = np.array([0, len(text), len(joined_text)])
    a, start = suffix_dedup.anchors(joined_text, offs, 50)
    assert (a[:251] == a[-251:]).all() and len(a) == 251 + 77 + 251 and (np.diff(start) >= 1).all()
    _, begin, end, doc = suffix_dedup.stretches(joined_text, offs, 50)
    assert (end - begin - 49).sum() == len(a) and (end - begin - 49).max() <= suffix_dedup.LONGEST and doc.max() == 1


def test_jaccard_sizes_come_before_bitmaps(spark):
    """Folded to a small set's width, a large set's bitmap differs in few places: pairs whose sizes can't link are neither a set's
    likeliest partner nor sent on with their whole sets."""
    from panelcast.llm import jaccard_join as J
    rule, rng = J.Rule(4, 85), np.random.default_rng(3)
    sizes = [40 + k % 4 for k in range(12)] + [5000 + 40 * k for k in range(12)]
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in sizes]
    n = len(sets)
    c = {"rep": np.arange(n), "size": np.array([len(x) for x in sets], np.int32), "own": np.arange(n), "bits": np.empty(n, object)}
    c["bits"][:] = [np.frombuffer(J.parity(x), np.uint8) for x in sets]
    some, partner, spare = J._best_in_long_list(c, rule)
    assert rule.sizes_fit(c["size"][some], c["size"][partner]).all()
    rows = [(k, len(x), J.parity(x, 4)) for k, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "rep long, size int, bits binary")
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(12, 24)] + [(0, 0)], "a long, b long")
    assert [tuple(r) for r in J._can_link(pairs, table, rule).collect()] == [(0, 0)]
