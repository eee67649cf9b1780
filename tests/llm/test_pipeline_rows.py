"""The whole pipeline on odd tables: nulls in any column, copies, long runs, extra columns with clashing names, no rows."""

import collections

import numpy as np

import corpus_pipeline
from flowlens.llm import best_fit_packing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, h string, _stats string, sequence_id string, key string, share string"


def rows_of(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 600 and 6000 and lang is not null").orderBy("doc_id").limit(90).collect()
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "p", "h", None, "s", "k", "x") for r in docs]


def run(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return corpus_pipeline.run(spark, str(path))


def test_odd_rows(spark, tmp_path):
    good = rows_of(spark)
    text = good[0][1]
    more = ["p", "h", None, "s", "k", "x"]
    odd = [
        (9001, None, "en", "a", None, *more), (9002, "", None, None, 0, *more), (9003, " \t\n", "en", "a", 3, *more), (9004, text, "en", None, None, *[None] * 6), (None, text + " x", None, "a", 1, *more),
        (9006, "zq " * 400, "en", "a", 1, *more), (9007, "lone words only here", "en", "a", 1, *more), (9008, " " * 300_000, "en", "a", 1, *more), (9009, text + "\n" + "　" * 50_000 + "\n", good[0][2], good[0][3], 1, *more),
    ]
    out = run(spark, tmp_path, good + odd).collect()
    pieces = collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id].append((r.start, r.length))
    copies = {good[0][0], 9004, 9009, None}
    assert len(copies & set(pieces)) == 1 and not {9001, 9002, 9003, 9006, 9007, 9008} & set(pieces)
    # clean documents stay, but for copies; of all that labels tell to be good most are there
    fine = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()} & {r[0] for r in good}
    assert len(set(pieces) & fine) >= 0.85 * len(fine) > 10
    ids = best_fit_packing._with_added(best_fit_packing._ids(best_fit_packing._public("byte_bpe_50k.tiktoken"), __import__("public_tokenizers").PATTERN), best_fit_packing.added_tokens())
    texts = {r[0]: r[1] for r in good}
    for doc_id, found in pieces.items():
        if doc_id in texts:
            assert sum(n for _, n in found) == len(np.frombuffer(ids(texts[doc_id]), "<u4")) + 1, doc_id


def test_no_rows(spark, tmp_path):
    assert run(spark, tmp_path / "none", []).count() == 0
    nulls = [(None,) * 11] * 3
    assert run(spark, tmp_path / "nulls", nulls).count() == 0
