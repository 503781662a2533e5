"""Benchmark decontamination against a plain Python version."""

import hashlib
import re

from pyspark.sql import functions as F

from panelcast.llm import decontaminate

DOCS = "doc_id long, text string, n_hit string, contamination string"
ITEMS = "item_id long, text string, doc_id string"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + min(n, len(w))]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for size in {len(g) for g in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k:k + size])]
        out.append((d, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS),
            spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS))


def found(df):
    rows = df.select("doc_id", "contamination.*").collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in rows], key=repr)


PASSAGE = " ".join(f"word{k}" for k in range(24))
ITEM_ROWS = [(1, PASSAGE), (2, "Short, item!"), (3, None), (4, " .;- "), (5, PASSAGE.upper()), (6, "árbol Ünï 数 42"), (None, "nameless row here"),
             (7, "one"), (2, "short item"), (8, "a b " * 30), (10, PASSAGE[:70])]
DOC_ROWS = [
    (0, None), (1, ""), (2, "nothing to see"), (3, PASSAGE), (4, f"xx {PASSAGE.replace(' ', '--')} yy"), (5, " ".join(PASSAGE.split()[3:12])),
    (6, " ".join(PASSAGE.split()[3:13])), (7, "A short\titem and a SHORT item"), (8, "árbol ünï 数 42"), (8, "árbol Ünï 数 42 nameless row here"),
    (9, "a b " * 40), (10, "b " * 50), (11, "One, two; one"), (12, "short"), (13, "item"), (14, "ends in a short"), (15, "item starts"),
    (16, "word0 " * 30 + PASSAGE + " word1" * 30), (None, PASSAGE), (17, ("filler text " * 400 + PASSAGE + " ") * 3), (3, PASSAGE)]


def test_windows_items_and_odd_rows(spark):
    docs, items = frames(spark, DOC_ROWS, ITEM_ROWS)
    assert found(decontaminate.find(docs, items)) == brute(DOC_ROWS, ITEM_ROWS)
    assert found(decontaminate.find(docs, items, n=3)) == brute(DOC_ROWS, ITEM_ROWS, 3)
    assert decontaminate.find(docs, items).columns == docs.columns


def test_blocks_beyond_the_bound_and_cut_items(spark, monkeypatch):
    docs, items = frames(spark, DOC_ROWS, ITEM_ROWS)
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 7)
    assert found(decontaminate.find(docs, items)) == brute(DOC_ROWS, ITEM_ROWS)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    parts = decontaminate.blocks(items, 10, "item_id", "text")
    sizes = [p.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0 for p in parts]
    assert len(parts) > 2 and max(sizes) <= 400
    got = decontaminate.find(docs, items)
    assert found(got) == brute(DOC_ROWS, ITEM_ROWS) and got.columns == docs.columns


def test_empty_tables(spark):
    docs, items = frames(spark, DOC_ROWS, ITEM_ROWS)
    assert all(r[2] == 0 and r[3] == [] for r in found(decontaminate.find(docs, items.limit(0))))
    assert decontaminate.find(docs.limit(0), items).count() == 0
    assert [r[1] for r in found(decontaminate.find(docs, items.limit(0)))] == [r[1] for r in brute(DOC_ROWS, [])]


def test_equal_hashes_alone_are_no_hit(spark, monkeypatch):
    docs, items = frames(spark, DOC_ROWS, ITEM_ROWS)
    import numpy as np
    real = decontaminate.mix64
    monkeypatch.setattr(decontaminate, "mix64", lambda h: real(h) & np.uint64(0xC000000000000000))   # four hashes in all
    words_of = lambda rows: decontaminate.Words.of(*decontaminate.string_buffers(decontaminate.pa.array([t or "" for _, t in rows])))
    texts = decontaminate.pa.array([t or "" for _, t in ITEM_ROWS])
    index = decontaminate.build([None if i is None else str(i) for i, _ in ITEM_ROWS], texts, 10)
    w = words_of(DOC_ROWS)
    hit, lists = decontaminate.scan(w, len(DOC_ROWS), index)
    got = sorted([(d, int((w.doc == k).sum()), int(hit[w.doc == k].sum()), sorted(index.items[i] for i in lists[k]))
                  for k, (d, _) in enumerate(DOC_ROWS)], key=repr)
    assert got == brute(DOC_ROWS, ITEM_ROWS)


def test_removal_of_spans_and_documents(spark):
    docs, items = frames(spark, DOC_ROWS, ITEM_ROWS)
    kept = {r.doc_id for r in decontaminate.remove_documents(docs, items).collect()}
    assert kept == {d for d, _, hit, _ in brute(DOC_ROWS, ITEM_ROWS) if not hit}
    some = {r.doc_id for r in decontaminate.remove_documents(docs, items, share=0.5).collect()}
    assert 17 in some and 3 not in some
    out = decontaminate.remove_spans(docs, items)
    assert out.columns == docs.columns
    texts = {}
    for r in out.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[4] == ["xx  yy"] and texts[0] == [None] and texts[2] == ["nothing to see"] and texts[7] == ["A  and a "]
    assert texts[17] == [("filler text " * 400 + " ") * 3] and sorted(texts[8]) == ["", "árbol ünï 数 42"]


def test_query_on_the_given_tables(spark):
    from panelcast.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                  for r in QUERIES["op11_decontaminate"](spark, folder).collect()))
    want = sorted((d, n, hit, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), hit > 0) for d, n, hit, i in brute(docs, items))
    assert got == want and any(r[-1] for r in got)


def test_plan_has_no_shuffle(spark):
    from panelcast.llm.queries import QUERIES
    plan = QUERIES["op11_decontaminate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


