"""All five stages of the pipeline over odd and empty tables."""

from __future__ import annotations

import corpus_pipeline


def clean_text(i, n=40):
    return " ".join(f"the item{i}x{j} of place{i}y{j}" for j in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, label int, node long, component string, spans string, bins string"
LABELS = "doc_id long, quality int, toxic int"


def run(spark, tmp_path, rows, labels):
    folder = str(tmp_path)
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 7, 8, "c", "s", "b") for r in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    stage, seen = docs, []
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, stage, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{name}")
        stage = spark.read.parquet(f"{folder}/{name}")
        seen.append(stage)
    return seen


def test_odd_rows(spark, tmp_path):
    clean = [(i, clean_text(i), "en", "s") for i in range(12)]
    odd = [(100, None, None, None), (101, "", "en", "s"), (102, "  \n\t ", "en", None), (103, "short text", "en", "s")]
    long = (104, clean_text(104, 30_000), "en", "s")
    private = (105, clean_text(105) + " bob@mail.com " + clean_text(106, 10), "en", "s")
    copies = [clean[0]] * 3 + [(None, clean[1][1], "en", "s"), (106, clean[2][1], "de", "s")]
    labels = [(i, 1, 0) for i in range(12)] + [(None, 1, 1), (3, None, None), (100, 0, 1), (0, 1, 0), (0, 1, 0)]
    toxic, quality, near, masked, packed = run(spark, tmp_path, [*clean, *odd, long, private, *copies], labels)
    assert toxic.count() == 12 + 4 + 2 + 5
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect() if r.doc_id is not None)
    assert {104, 105} <= set(ids(quality)) and not {100, 101, 102, 103} & set(ids(quality))
    kept = ids(near)
    assert len(kept) == len(set(kept)) and 106 not in kept and near.count() == len(kept) and set(range(12)) <= set(kept)
    texts = {r.doc_id: r for r in masked.collect()}
    assert "<EMAIL>" in texts[105].text and "bob@" not in texts[105].text and texts[105].n_chars == len(texts[105].text)
    rows = packed.collect()
    assert {r.doc_id for r in rows} == set(texts) and all(0 < r.length <= 2048 for r in rows)
    assert all(sum(r.length for r in rows if r.doc_id == d) == next(r.doc_tokens for r in rows if r.doc_id == d) for d in texts)


def test_empty_tables(spark, tmp_path):
    assert [df.count() for df in run(spark, tmp_path, [], [])] == [0] * 5
