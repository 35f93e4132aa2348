"""The pipeline's stages, each on its own input, against the plain form of its rule."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from trivane.llm import mixing, pii, queries, toxicity
from trivane.llm.common import stored, table

sys.path.insert(0, str(Path(__file__).parent))
from test_documents import brute_join, check_packing


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near copies", "personal data", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        got = stored(stage(spark, docs, sf), "test")
        before = docs.collect()
        if name == "packing":
            check_packing(docs, got.collect())
            break
        assert got.columns == columns
        after = got.collect()
        if name == "toxicity":
            model = toxicity.fit(docs, table(spark, sf, "labels"), toxicity.not_held_out())
            bad = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] >= 0.5}
            assert sorted(map(tuple, after), key=repr) == sorted((tuple(r) for r in before if r["doc_id"] not in bad), key=repr)
        elif name == "near copies":
            joined = brute_join([(r["doc_id"], r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in after) == sorted({c for _, c, _ in joined})
        elif name == "personal data":
            text = {r["doc_id"]: r["text"] for r in before}
            assert len(after) == len(before)
            for r in after:
                assert r["text"] == pii.redact(text[r["doc_id"]], pii.all_spans(text[r["doc_id"]])[1]) and r["n_chars"] == len(r["text"])
        else:
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
            times = {}
            for r in after:
                times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
            assert times == {i: n for i, n in copies.items() if n}
        docs = got


def staged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "test")
    return docs


def pieces(df):
    return sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["source"]) for r in df.collect()), df.agg(F.sum("length")).first()[0]


def test_run_equals_its_stages(spark, sf):
    one, two = pieces(corpus_pipeline.run(spark, sf)), pieces(staged(spark, sf))
    # Where tasks cut the queues differs from run to run; what is packed doesn't.
    assert one[1] == two[1] and one[1] > 0
    ids = lambda rows: {(i, n, s): sum(k for j, _, k, _, m, t in rows if (j, m, t) == (i, n, s)) for i, n, s in {(r[0], r[4], r[5]) for r in rows}}
    assert ids(one[0]) == ids(two[0])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _h long, _row string, copies int, `a.b` string, score double"


def written(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline_of_odd_rows(spark, tmp_path):
    long = " ".join(f"w{k % 977}x{k}" for k in range(60000))
    texts = [None, "", " \n", long, "mail me at a.b@c.de please", *["same text of many words that is repeated here"] * 6, *[f"another text number {k} with words {k * 7} and {k * 13}" for k in range(30)]]
    rows = [(None if k % 9 == 4 else k % 31, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t), 1, "x", 2, "y", 0.5) for k, t in enumerate(texts)]
    d = written(spark, tmp_path, rows, [(1, 1, 0), (None, 0, 1), (2, None, None), (3, 0, 1)])
    docs = table(spark, d, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, d), "test")
        assert docs.columns == [c.strip("`") for c in ("doc_id", "text", "lang", "source", "n_chars", "_h", "_row", "copies", "a.b", "score")], name
    left = [r["text"] for r in docs.collect()]
    assert left.count("same text of many words that is repeated here") <= 3 and "mail me at a.b@c.de please" not in left
    got = corpus_pipeline.run(spark, d)
    check_packing(docs, got.collect())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [])).count() == 0


@pytest.mark.parametrize("kind", [0, 1])
def test_pipeline_with_labels_of_one_kind_keeps_the_rest(spark, tmp_path, kind):
    rows = [(k, f"text number {k} of {k * k} with its own words {k * 31}", "en", "a", 10, 1, "x", 1, "y", 0.5) for k in range(20)]
    d = written(spark, tmp_path, rows, [(k, 1, kind) for k in range(20)])
    assert corpus_pipeline.drop_toxic(spark, table(spark, d, "documents"), d).count() == 20
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()} == set(range(20))


def test_oracles_of_the_operators(spark, sf, duck):
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        want = duck.execute(sql)
        cols = [c[0] for c in want.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted((tuple(r[c] for c in sorted(cols)) for r in df.collect()), key=repr) == sorted((tuple(dict(zip(cols, r, strict=True))[c] for c in sorted(cols)) for r in want.fetchall()), key=repr)
