"""Packing: ids of texts that hold the vocabulary's added tokens or very long runs, against the tokenizers library with its defaults."""

import zlib

import numpy as np

from flowlens.llm import best_fit_packing

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x  ", "one<|endoftext|>two three  four", "<|endoftext|", "plain text", "<|END|> <|endoftext|>\n"]


N = 2_000_000
RUNS = [
    "x" + " " * N + "y", "x" + "\n" * N, "\t" * N + "3", " " * N, "a" * N, "abcdefg" * (N // 7), "7" * N, "." * N + " <|endoftext|>" + " " * N + "<|endoftext|>",
    ("one" + "\u3000" * 12_000 + "\n two" + " \n" * 9_000 + " !" + "\u00a0" * 20_000 + "\u2003q") * 3, "y" + "\r\n" * 10_000 + "\x1c" * 15_000 + "z",
]


def test_ids_of_long_runs(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = best_fit_packing.packed_stage(spark, spark.createDataFrame(list(enumerate(RUNS)), "doc_id long, text string").repartition(4), "").collect()
    for i, text in enumerate(RUNS):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r.start, r.length, r.ids_crc32) for r in out if r.doc_id == i)
        assert sum(n for _, n, _ in mine) == len(ids), i
        assert all(zlib.crc32(ids[at : at + n].tobytes()) == crc for at, n, crc in mine), i


def test_ids_of_added_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, text in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want[i] = len(ids), zlib.crc32(ids.tobytes())
    for out in (best_fit_packing.op8_best_fit_packing(spark, str(tmp_path)), best_fit_packing.packed_stage(spark, docs, "")):
        assert {r.doc_id: (r.length, r.ids_crc32) for r in out.collect()} == want
    assert want[0][0] == 5  # 64, 220, 50256, 275 and the end
