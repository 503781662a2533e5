"""Whitening and vector codes against exact plain versions."""

import hashlib
from fractions import Fraction

import numpy as np
import pytest

from panelcast.llm import vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string"
ODD = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5)]


def frame(spark, rows, labels=None):
    labels = labels or {}
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], labels.get(i), "clash")
                                  for i, v in rows], SCHEMA)


def floors(v, scale):
    return [int(x) for x in np.floor(scale * np.asarray(v, np.float32).astype(np.float64))]


def test_polarised_squares_give_the_exact_covariance():
    rng = np.random.default_rng(1)
    for size in (40, 10 ** 6, 2 ** 45):
        u = rng.integers(-size, size, (37, 5))
        n, total = len(u), [int(x) for x in u.astype(object).sum(0)]
        got = whitening.polarised(whitening.squares(u), n, total)
        centred = [[n * int(x) - s for x, s in zip(row, total)] for row in u]
        assert got == [[sum(r[i] * r[j] for r in centred) for j in range(5)] for i in range(5)]


def check_whitened(spark, rows, k):
    got = whitening.whiten(frame(spark, rows + ODD), k=k).collect()
    x = [[c + 1_000_000 for c in floors(v, 64)] for _, v in rows]
    n, dim = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(dim)]
    dev = {}
    for (i, _), r in zip(rows, x):
        dev.setdefault(i, []).append(sum((n * a - b) ** 2 for a, b in zip(r, s)))
    cov = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n ** 3) for j in range(dim)] for i in range(dim)]
    v = np.array(cov, float)
    e, vec = np.linalg.eigh(v)
    e, vec = e[::-1], vec[:, ::-1]
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(r, s)] for r in x])
    want = centred @ vec[:, :k] / np.sqrt(e[:k])
    assert {r.n for r in got} == {n} and len(got) == n * min(k, dim) and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-8
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    for c, own in by.items():
        a = sorted((r.vec_id, r.deviation) for r in own)
        assert a == sorted((i, d) for i, ds in dev.items() for d in ds)
        assert own[0].explained == pytest.approx(e[c - 1] / np.trace(v), rel=1e-9)
        mine = np.array([r.whitened for r in sorted(own, key=lambda r: (r.vec_id, r.whitened))])
        best = min(np.abs(mine - np.array([w for _, w in sorted((i, sign * z) for (i, _), z in zip(rows, want[:, c - 1]))])).max()
                   for sign in (1, -1))
        assert best < 1e-7


def test_whitened_rows_match_exact_arithmetic(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 6)) @ rng.normal(size=(6, 6))
    rows = [(i, v) for i, v in enumerate(x)] + [(5, x[7]), (5, x[7])]
    check_whitened(spark, rows, 4)
    check_whitened(spark, rows, 32)


def test_whitening_without_variance_short_and_empty(spark):
    flat = whitening.whiten(frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert {(r.whitened, r.explained, r.deviation, r.identity_error) for r in flat} == {(None, None, 0, 0.0)}
    part = whitening.whiten(frame(spark, [(0, [1.0, 2.0]), (1, [2.0]), (2, [3.0, 2.0]), (None, [4.0, 0.0])])).collect()
    assert len(part) == 8 and {r.vec_id for r in part} == {0, 1, 2, None} and all(r.whitened is not None for r in part)
    line = whitening.whiten(frame(spark, [(k, [float(k), 1.0]) for k in range(5)])).collect()
    assert {r.component for r in line if r.whitened is None} == {2} and line[0].identity_error < 1e-9
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, ODD)).count() == 0
    far = whitening.whiten(frame(spark, [(0, [1.1e7, 0]), (1, [-1.1e7, 0]), (2, [1.1e7, 0])]), k=1).collect()   # sums beyond 63 bits on the way
    xs = [floors([v], 64)[0] for v in (1.1e7, -1.1e7, 1.1e7)]
    assert [r.deviation for r in sorted(far, key=lambda r: r.vec_id)] == [(3 * x - sum(xs)) ** 2 for x in xs]


def plain_codes(rows, entries=256, rounds=4):
    """(codes, errors, codebooks) of (id, integers) rows by the definition."""
    width = -(-max(len(x) for _, x in rows) // 4)
    x = [list(v) + [0] * (4 * width - len(v)) for _, v in rows]
    parts = [[r[p * width:(p + 1) * width] for r in x] for p in range(4)]
    first = sorted((k for k in range(len(rows)) if rows[k][0] is not None), key=lambda k: (rows[k][0], x[k]))[:entries]
    books = [[parts[p][k] for k in first] for p in range(4)]

    def assign():
        out = []
        for p in range(4):
            out.append([min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(books[p])) for v in parts[p]])
        return out

    for _ in range(rounds):
        best = assign()
        for p in range(4):
            for e in range(len(books[p])):
                own = [v for v, (_, b) in zip(parts[p], best[p]) if b == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    best = assign()
    codes = ["".join("%02x" % best[p][k][1] for p in range(4)) for k in range(len(rows))]
    return codes, [sum(best[p][k][0] for p in range(4)) for k in range(len(rows))], books


def check_codes(spark, rows, labels, **options):
    got = vector_codes.compress(frame(spark, rows + ODD, labels), **options).collect()
    codes, errors, books = plain_codes([(i, floors(v, 1024)) for i, v in rows], **options)
    sums = {}
    for (i, _), e in zip(rows, errors):
        sums[labels.get(i)] = sums.get(labels.get(i), 0) + e
    text = ",".join(str(x) for b in books for c in b for x in c)
    want = [(i, c, e, sums[labels.get(i)], hashlib.sha256(text.encode()).hexdigest()) for (i, _), c, e in zip(rows, codes, errors)]
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_codes_by_definition_with_ties_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8) * 0.3) for i in range(330)]
    rows += [(400 + i, rows[9][1]) for i in range(30)] + [(3, rng.normal(size=8)), (3, rng.normal(size=8)), (None, rng.normal(size=8))]
    labels = {i: None if i % 4 == 0 else i % 3 for i, _ in rows if i is not None}
    monkeypatch.setattr(vector_codes, "_BLOCK", 40)
    check_codes(spark, rows, labels)
    check_codes(spark, rows, labels, entries=9, rounds=2)
    monkeypatch.setattr(vector_codes, "LABEL_ROWS", 0)
    check_codes(spark, rows, labels, entries=20, rounds=1)


def test_codes_of_short_wide_and_few_vectors(spark):
    check_codes(spark, [(0, [1.0, 2.0, 3.0]), (1, [1.0]), (2, []), (5, [0.5, 0, 0, 0, 0, -7.0])], {0: 1})
    check_codes(spark, [(i, [3e12 * i, -1e13, float(i)]) for i in range(5)], {})
    check_codes(spark, [(0, [0.0] * 4)], {})
    assert vector_codes.compress(frame(spark, [])).count() == 0 and vector_codes.compress(frame(spark, ODD)).count() == 0
    with pytest.raises(ValueError, match="256"):
        vector_codes.compress(frame(spark, [(0, [1.0])]), entries=300)


@pytest.mark.parametrize("spread", [0.0, 1.0, 40.0])
def test_equal_average_search_is_exact(spread):
    """Integers with many ties; where the sums differ much, most entries are never compared."""
    rng = np.random.default_rng(4)
    entries = rng.integers(-3, 4, (200, 5)) + (rng.integers(-50, 51, (200, 1)) * spread).astype(np.int64)
    x = rng.integers(-3, 4, (2000, 5)) + (rng.integers(-50, 51, (2000, 1)) * spread).astype(np.int64)
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    own, best = vector_codes.Codebook(entries).nearest(x)
    assert (best == d.min(1)).all() and (own == d.argmin(1)).all()


def test_decoded_codes_are_as_far_as_their_error_says(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    base = vector_codes.integers(rows, "embedding", 1024, ["vec_id"])
    books = vector_codes.fit(base, "vec_id", 16, rounds=2)
    out = vector_codes.decode(vector_codes.encode(base, books, 16, ["vec_id"]), books).join(base, "vec_id").collect()
    assert out and all(sum((a - b) ** 2 for a, b in zip(r.decoded, r["__v"])) == r.error for r in out)
