"""The registered queries against SQL, and the pipeline stage by stage against brute force."""

import duckdb
import pytest
from brute import components, removed
from test_tokens import check_pieces

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ["op1_topk", "op3_suffix_dedup", "op6_jaccard", "op8_arc"])
def test_query_matches_sql(spark, con, name):
    from panelcast.llm.queries import ORACLE, QUERIES
    want = con.execute(ORACLE[name])
    cols = [c[0] for c in want.description]
    got = QUERIES[name](spark, SMALL).select(cols).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_registered_names():
    import __spark_entry__ as E
    names = E.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    from panelcast.llm import toxicity
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    frames = [docs]
    for _, stage in P.STAGES:
        out = stage(spark, frames[-1], SMALL)
        frames.append(spark.createDataFrame(out.collect(), out.schema))
    assert all(f.columns == docs.columns for f in frames[:-1])
    rows = [{r.doc_id: r for r in f.collect()} for f in frames[:-1]]
    # 1: exactly the documents below 0.5 stay
    scores = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert set(rows[1]) == {r.doc_id for r in scores if r.toxicity < 0.5}
    # 2: the smallest of each component stays
    groups = components([(i, r.text) for i, r in rows[1].items()], 5, 80)
    assert set(rows[2]) == {c for _, c in groups.values()}
    # 3: the bytes that an earlier document has go
    want = removed([(i, r.text) for i, r in rows[2].items()], 50)
    assert set(rows[3]) == set(rows[2])
    for i, r in rows[3].items():
        size, cut, spans, _ = want[i]
        assert size - cut - 6 * spans <= len(r.text.encode()) <= size - cut and r.n_chars == len(r.text)
        if not spans:
            assert r == rows[2][i]
    # 4: nobody's numbers; what holds none stays
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        if not any(c in rows[3][i].text for c in "0123456789@=:"):
            assert r == rows[3][i]
    assert any(rows[4][i].text != rows[3][i].text for i in rows[4])
    # 5: every id of every text lies in one piece
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert check_pieces(frames[-1].collect(), {i: r.text for i, r in rows[4].items()}, library) > 0.9


def test_run(spark):
    import corpus_pipeline as P
    out = P.run(spark, SMALL)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_stages_on_empty_and_odd_documents(spark):
    import corpus_pipeline as P
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 30_000, "en", "s", 150_000)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), schema)
        assert P.STAGES[-1][1](spark, docs, SMALL).count() >= len({r[0] for r in rows})
