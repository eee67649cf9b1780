"""Operator 12 against plain counting, and its defined results of odd rows."""

import collections
import random
import re

import duckdb
import pytest

from flowlens.llm import collocations as co

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, phrase string, a long, id long, block long, f long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 1, 2, 3, 4) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def plain(rows, longest=3, least=10, share=50, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    held = {x: c for x, c in f.items() if c >= least and len(x[1]) > 1}
    inner = collections.defaultdict(int)
    for (lang, w), c in held.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inner[lang, w[i : i + k]] = max(inner[lang, w[i : i + k]], c)
    by = collections.defaultdict(list)
    for (lang, w), a in held.items():
        if 100 * inner[lang, w] >= share * a:
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        by[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, x in by.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_query_against_plain_counting_and_sql(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = co.op12_collocations(spark, SF)
    assert [t for _, t in df.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    got = rows_of(df)
    assert got == plain(rows) and len(got) > 100
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    assert sorted(con.execute(co.ORACLE).fetchall()) == got


@pytest.mark.parametrize(("longest", "least", "share", "top"), [(2, 3, 50, 5), (3, 2, 60, 2000), (5, 2, 50, 40), (4, 4, 100, 1)])
def test_parameters(spark, monkeypatch, longest, least, share, top):
    monkeypatch.setattr(co, "BLOCK_BYTES", 300)
    rng = random.Random(longest)
    words = ["a", "B", "ç", "é", "中文", "d e", "|"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ", ", "\n", " ", ".\r\n"]) for _ in range(rng.randint(0, 60))), rng.choice(["x", "y", None, "und"])) for _ in range(60)]
    assert rows_of(co.collocations(docs(spark, rows), longest, least, share, top)) == plain(rows, longest, least, share, top)


def test_odd_rows(spark):
    hot = " ".join(["of the"] * 20_000)
    rows = [(None, "en"), ("", None), (" \t .,;:!?\n\x0b\x0c\r", "en"), (hot, "en"), ("one two three " * 12, None), ("one two three " * 12, "und"), ("A-B a-b! A-B a-b\x00 " * 10, "de"), ("İSTANBUL ẞ É " * 10, "tr"), ("x" * 200_000, "en"), (("y" * 70_000 + " z. ") * 11, "fr")]
    got = rows_of(co.collocations(docs(spark, rows)))
    assert got == plain(rows) and {g[0] for g in got} == {"en", "und", "de", "tr", "fr"}
    assert co.collocations(docs(spark, [])).count() == 0 and co.collocations(docs(spark, rows[:3])).count() == 0


def test_full_filter_gives_the_same(spark, monkeypatch):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    monkeypatch.setattr(co, "BITS", 64)
    assert rows_of(co.collocations(docs(spark, rows))) == plain(rows)


def test_scores_beyond_64_bits(spark):
    # f = 4 * 10^14: the square alone passes 64 bits
    big = 4 * 10**14
    row = spark.createDataFrame([(big, [big + 7, big], [big + 9, big])], "f long, firsts array<long>, lasts array<long>").select(co._cut(2).alias("c")).first().c
    assert (row.score, row.l, row.r) == (1_000_000 * big * big // ((big + 7) * (big + 9)), big + 7, big + 9)
