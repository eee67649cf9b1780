"""Operators on documents: brute force on small tables, and the defined results of odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import best_fit_packing, jaccard_join, language_id, media_archive, piece_sampling, quality_rules
from flowlens.llm._components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, cls string, size long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
ODD = [
    (1, None, "en", "a", None, "r", "c", 1), (2, "", "en", None, 0, "r", "c", 1), (3, " \n\t\x0b ", None, "a", 5, "r", "c", 1), (4, "one two three", "en", "a", 13, "r", "c", 1),
    (5, "One TWO three", "en", "a", 13, "r", "c", 1), (6, LONG, "en", "a", 1, "r", "c", 1), (6, LONG, "en", "a", 1, "r", "c", 1), (7, LONG + " tail", "en", "a", 1, None, None, None),
    (None, "one two three", None, None, None, None, None, None), (8, "ÄÖ  中文 ▁ 😀\r\n<|endoftext|> x\0y", "de", "b", 3, "r", "c", 1), (9, "one\u00a0two three", "en", "a", 3, "r", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def shingles(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def linked(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return sets, pairs


def roots(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard(spark, documents, odd, n, percent):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").limit(150).union(odd.select("doc_id", "text")).collect()]
    rows += [(10_000 + i, " ".join(f"k{j + 2 * i}" for j in range(60))) for i in range(30)]  # a chain: neighbours link, ends do not
    sets, pairs = linked(rows, n, percent)
    root = roots(len(rows), pairs)
    least = collections.defaultdict(list)
    for (doc_id, _), r in zip(rows, root, strict=True):
        least[r] += [doc_id] if doc_id is not None else []
    want = sorted(((d, len(s), (min(least[r]) if least[r] else None) if s else d) for (d, _), s, r in zip(rows, sets, root, strict=True)), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_join.jaccard_components(docs, n, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_jaccard_links(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").limit(200).collect()]
    sets, pairs = linked(rows, 4, 85)
    first = {}
    for (doc_id, _), s in sorted(zip(rows, sets, strict=True), key=lambda x: -x[0][0]):
        first[s] = doc_id
    want = {tuple(sorted((first[sets[i]], first[sets[j]]))) for i, j in pairs if sets[i] != sets[j]}
    got = jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {(r.doc_a, r.doc_b) for r in got} == want


def test_dedup_stage(spark, odd, empty):
    kept = jaccard_join.deduplicated(spark, odd, SF)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "6", "8", "9", "None"]
    assert jaccard_join.deduplicated(spark, empty, SF).count() == 0 and jaccard_join.jaccard_components(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[200] == got[201] != got[0] and len(set(got.values())) == 3


def plain_stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = [False] * len(words)
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered[i : i + 3] = [True] * 3
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, sum(covered)


def test_quality_stats(spark, documents, odd):
    rows = documents.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame([(20, "a\n\na\n a\na"), (21, "a b c d a b c"), (22, "x\r\nx\r\n")], "doc_id long, text string"))
    for r in quality_rules.with_stats(rows).collect():
        assert tuple(r._stats) == plain_stats(r.text), r.doc_id
        assert r._failed == (r._stats.n_words < 50 or 100 * r._stats.n_repeat_words > 50 * r._stats.n_words)


def credited(cov):
    """At least the variance of FEATURES in every direction."""
    unit = np.outer(quality_rules._LEAST, quality_rules._LEAST)
    values, vectors = np.linalg.eigh(cov / unit)
    return sum(max(w, 1.0) * np.outer(v, v) for w, v in zip(values, vectors.T, strict=True)) * unit


def robust(x):
    """The estimate of `fit` in plain numpy: three starts, concentration to the end, reweighting."""
    q = quality_rules
    n, p = x.shape
    middle = np.median(x, axis=0)
    sd = np.maximum(1.4826 * np.median(abs(x - middle), axis=0), q._LEAST)
    z = (x - middle) / sd
    t, u = np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    squared = lambda m, s: np.maximum(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m), 0)
    best = None
    for start in (np.diag(sd**2), credited(np.cov(t.T, bias=True) / 0.394 * np.outer(sd, sd)), credited(p * (u.T @ u / n) * np.outer(sd, sd))):
        mean, cov, last = middle, start, np.inf
        while True:
            bins = np.floor(q.BINS * np.log1p(squared(mean, cov)))
            kept = x[bins <= np.sort(bins)[(n + 6) // 2 - 1]]
            mean, cov = kept.mean(axis=0), credited(q.HALF * np.cov(kept.T, bias=True))
            now = np.linalg.slogdet(cov)[1]
            if best is None or now < best[0]:
                best = now, mean, cov
            if not now < last - q.FALL:
                break
            last = now
    kept = x[squared(*best[1:]) <= q.WEIGHED]
    return kept.mean(axis=0), credited(q.MOST * np.cov(kept.T, bias=True))


def test_quality_verdicts(spark):
    """Whole verdicts against brute force: counts, groups, estimates and distances in plain Python and numpy."""
    out = quality_rules.op3_quality_rules(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(out) == len(docs)
    vectors = {}
    for r in out:
        n, chars, symbols, lines, repeats = plain_stats(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        if not r.base_failed:
            vectors[r.doc_id] = np.rint(256 * np.array([np.log(n), np.log(chars / n), np.log1p(100 * symbols / chars), np.log1p(lines), repeats / n]))
    groups = collections.defaultdict(list)
    for d in vectors:
        for key in ((docs[d].lang, docs[d].source), docs[d].lang, None):
            groups[key].append(d)
    estimates = {k: robust(np.stack([vectors[d] for d in ids])) for k, ids in groups.items() if len(ids) >= (50 if k else 20)}
    for r in out:
        if r.base_failed:
            assert not r.kept
            continue
        mean, cov = next(estimates[k] for k in ((docs[r.doc_id].lang, docs[r.doc_id].source), docs[r.doc_id].lang, None) if k in estimates)
        v = vectors[r.doc_id] - mean
        distance = v @ np.linalg.inv(cov) @ v
        assert abs(distance - quality_rules.CUTOFF) < 1e-6 or r.kept == (distance <= quality_rules.CUTOFF), r.doc_id


def test_planted_outliers(spark):
    """Junk of one kind, up to nearly half of a group, goes; the rest of the group stays."""
    rng = np.random.default_rng(5)
    n, rows, groups = 600, [], {}
    good = np.stack([rng.normal(5.7, 0.9, n), rng.normal(1.61, 0.04, n), np.zeros(n), np.log1p(rng.random(n) < 0.05), np.where(rng.random(n) < 0.1, rng.random(n) / 5, 0)], axis=1)
    for share in (0.1, 0.3, 0.45):
        for feature, value in ((0, 11.5), (1, 2.3), (2, 2.5), (3, 2.2), (4, 0.6)):
            x = good.copy()
            x[: int(share * n), feature] = value
            groups[f"{share} {feature}"] = x = np.rint(quality_rules.SCALE * x)
            rows += [("en", f"{share} {feature}", *map(float, r)) for r in x]
    rows = spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double, x4 double").repartition(3)
    models = {r.key.source: r for r in quality_rules.fit(rows).where("key.level = 0").collect()}
    for source, x in groups.items():
        mean, cov = robust(x)
        assert np.allclose(models[source]["mean"], mean) and np.allclose(np.array(models[source]["inverse"]).reshape(5, 5), np.linalg.inv(cov)), source
        off = x - mean
        distance = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)
        junk = np.arange(n) < int(float(source[:-2]) * n)
        assert (distance[junk] > quality_rules.CUTOFF).mean() >= 0.95, source
        assert (distance[~junk] <= quality_rules.CUTOFF).mean() >= 0.99, source


def test_quality_stage(spark, odd, empty):
    good = spark.read.parquet(f"{SF}/documents.parquet").select("*", F.lit("r").alias("_row"), F.lit("c").alias("cls"), F.lit(1).cast("long").alias("size"))
    kept = quality_rules.quality_kept(spark, good.unionByName(odd), SF)
    assert kept.columns == good.columns
    verdicts = {r.doc_id: r.kept for r in quality_rules.op3_quality_rules(spark, SF).collect()}
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert {d for d, k in verdicts.items() if k} - {6, 7} <= set(ids) and None not in ids
    assert quality_rules.quality_kept(spark, empty, SF).count() == 0


def test_language(spark, odd, empty):
    out = language_id.op1_language_id(spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    profiles = language_id.learned(spark.read.parquet(f"{SF}/documents.parquet"))
    assert set(profiles) == {"en", "de", "fr", "es"} and all(len(p) <= language_id.LANGUAGE_GRAMS for p in profiles.values())
    got = {r.doc_id: r.p for r in odd.select("doc_id", language_id.predictor(odd, profiles)("text").alias("p")).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3)) and got[4].lang_pred != "und"
    assert language_id.learned(empty) == {}
    assert [r.p.lang_pred for r in odd.limit(3).select(language_id.predictor(odd, {})("text").alias("p")).collect()] == ["und"] * 3


def test_language_distance():
    """The vectorised grams and ranks against the plain definition."""
    import pyarrow as pa

    text = "Die Straße, DIE Größe — 42 x"
    words = re.findall(r"[^\W\d_]+", text.lower())
    plain = collections.Counter()
    for w in words:
        padded = f" {w} "
        plain.update(w)
        plain.update(padded[i : i + 2] for i in range(len(padded) - 1))
        plain.update(padded[i : i + 3] for i in range(len(padded) - 2))
    (_, grams), = language_id._grams(pa.array([text]))
    unpack = lambda g: "".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0) if g >> s & 0x1FFFFF)
    got = collections.Counter(map(unpack, grams.tolist()))
    assert got == plain


def plain_grams(text):
    grams = collections.Counter()
    word = ""
    for c in (text or "") + " ":
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            padded = f" {word} "
            grams.update(word)
            for k in (2, 3):
                grams.update(padded[i : i + k] for i in range(len(padded) - k + 1))
            word = ""
    return grams


def plain_ranks(grams, most):
    return {g: i for i, (g, _) in enumerate(sorted(grams.items(), key=lambda x: (-x[1], language_id_key(x[0])))[:most])}


def language_id_key(gram):
    """The packed number of a gram."""
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def test_language_predictions(spark, odd):
    """Ranks, distances, predictions and scores against the plain definition, with ties, long texts and high planes."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the hat sat on the mat", "en"), ("the dog and a fog", "en"), ("der Hund und die Katze", "de"), ("ÄÖÜ ßtraße", "de"), ("ab ab", "x"), ("ab ab", "y"), ("\U00030000\U00031000 \U00030000", "han")])]
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    profiles = language_id.learned(docs)
    grams = collections.defaultdict(collections.Counter)
    for _, t, lang in rows:
        grams[lang].update(plain_grams(t))
    want = {lang: plain_ranks(g, language_id.LANGUAGE_GRAMS) for lang, g in grams.items()}
    assert {k: [language_id_key(g) for g in sorted(v, key=v.get)] for k, v in want.items()} == profiles
    texts = odd.select("doc_id", "text").union(docs.select("doc_id", "text")).union(spark.createDataFrame([(50, "ba"), (51, "\U00031000"), (52, "the und " * 20_000)], "doc_id long, text string"))
    for r in texts.select("text", language_id.predictor(docs, profiles)("text").alias("p")).collect():
        own = plain_ranks(plain_grams(r.text), language_id.TEXT_GRAMS)
        if not own:
            assert (r.p.lang_pred, r.p.score) == ("und", 0)
            continue
        worst = language_id.LANGUAGE_GRAMS
        far = {lang: sum(min(abs(ranks[g] - i), worst) if g in ranks else worst for g, i in own.items()) for lang, ranks in want.items()}
        best = min(far, key=lambda lang: (far[lang], lang))  # x and y are equal: the first by name
        assert r.p.lang_pred == best and abs(r.p.score - (1 - far[best] / (worst * len(own)))) < 1e-12


def test_language_stage(spark, documents, odd, empty):
    import random

    rng = random.Random(3)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (80, 400, 3000)]
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä " * 4
    other = spark.createDataFrame([(9000 + i, t) for i, t in enumerate([*noise, finnish])], "doc_id long, text string")
    docs = documents.unionByName(other, allowMissingColumns=True)
    kept = language_id.language_kept(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.select("doc_id").collect())
    told = [r.doc_id for r in documents.where("text rlike '[A-Za-z]' and size(split(text, ' ')) >= 50").select("doc_id").collect()]
    assert not set(range(9000, 9004)) & set(ids) and set(told) <= set(ids)
    assert language_id.language_kept(spark, odd, SF).columns == odd.columns
    assert language_id.language_kept(spark, empty, SF).count() == 0


def test_packing(spark, documents, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a  b", " lead", "trail ", "x\n y", "don't  stop\t\tnow", "tab\t x\n\n  y", "  ", "é ü\u00a0 z"]
    extra = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(odd.select("doc_id", "text")).union(extra)
    out = best_fit_packing.packed(best_fit_packing.pieces(docs, added=best_fit_packing.added_tokens())).collect()
    ids = collections.defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append(np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4"))
    found, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    for doc_id, copies in ids.items():
        want = []
        for x in copies:
            first = len(x) % 1024 or min(len(x), 1024)
            cuts = [0, *range(first, len(x) + 1, 1024)]
            want += [(k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted(found[doc_id]) == sorted(want), doc_id
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in out)
    assert len(bins) <= -(-total // 1024) * 1.02 + 1


def test_packing_bounds():
    rng = np.random.default_rng(1)
    for high in (1023, 600, 400):
        for n in (1, 5, 12):
            sizes = rng.integers(1, high + 1, n)
            bins = best_fit_packing.best_fit_decreasing(sizes, 1024)
            fill = np.bincount(bins, sizes)
            assert fill.max() <= 1024 and fill.sum() == sizes.sum()
            assert best_fit_packing.lower_bound(sizes, 1024) <= len(fill)
    assert best_fit_packing.lower_bound(np.array([600] * 7), 1024) == 7  # none fits with another
    assert best_fit_packing.lower_bound(np.array([400] * 6), 1024) == 3


def test_packing_exchange(spark, monkeypatch, empty):
    monkeypatch.setattr(best_fit_packing, "PART_ROWS", 40)
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.pmod(F.xxhash64("id"), F.lit(700)) + 1).alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    out = best_fit_packing.packed(rows)
    got = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert out.count() == 400 and max(r.n for r in got) <= 1024
    # ten parts of forty pieces are far less than a part is meant to hold
    assert len(got) <= 1.03 * best_fit_packing.lower_bound(np.array([r.length for r in rows.collect()]), 1024)
    assert best_fit_packing.packed_stage(spark, empty, SF).count() == 0


def test_media(spark, odd, empty, tmp_path):
    folder = str(tmp_path / "media")
    archives = media_archive.write_archives(odd, folder, archive_bytes=20_000).collect()
    assert sum(a.members for a in archives) == len(ODD)
    out = media_archive.described(media_archive.read_archives(spark, folder, rangeBytes=4096)).collect()
    texts = collections.defaultdict(set)
    for row in ODD:
        texts[row[0]].add((row[1] or "").encode())
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(row[0] for row in ODD)
    for r in out:
        (data,) = texts[r.doc_id]
        payload = data.ljust(max(192, -(-len(data) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(media_archive.to_png(data)).hexdigest() and r.feature == media_archive.features_of(payload)
    none = str(tmp_path / "none")
    media_archive.write_archives(empty, none)
    assert media_archive.read_archives(spark, none).count() == 0


def test_media_damage(spark, odd, tmp_path):
    """A damaged member becomes a row with an error; the others come whole."""
    folder = tmp_path / "media"
    media_archive.write_archives(odd.coalesce(1), str(folder))
    archive = next(folder.glob("*.tar"))
    (folder / "part-000009-0000-late.tar").write_bytes(archive.read_bytes())  # left by a second try
    offsets = np.frombuffer(archive.with_suffix(".offsets").read_bytes(), "<i8")
    data = bytearray(archive.read_bytes())
    data[int(offsets[2]) + 540] ^= 255
    archive.write_bytes(data)
    rows = media_archive.read_archives(spark, str(folder)).collect()
    assert len(rows) == len(ODD) and [r.offset for r in rows if r.error] == [int(offsets[2])] and sum(r.media is None for r in rows) == 1
    with pytest.raises(Exception, match="at "):
        media_archive.described(media_archive.read_archives(spark, str(folder))).collect()


def test_pieces(spark, odd, documents, empty):
    docs = odd.select("doc_id", "text").union(documents.select("doc_id", "text").limit(60))
    coded = piece_sampling.encode(docs)
    texts = collections.defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text or "")
    rows = piece_sampling.decode(coded.withColumn("n", F.size("ids"))).collect()
    assert len(rows) == docs.count() and all(r.text in texts[r.doc_id] for r in rows)
    assert all(r.n == 0 for r in rows if r.text == "")
    again = piece_sampling.encode(docs.repartition(7))
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in coded.collect()) == sorted((str(r.doc_id), tuple(r.ids)) for r in again.collect())
    assert piece_sampling.encode(empty).count() == 0
    assert piece_sampling.decode(docs.sparkSession.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).orderBy("doc_id").collect() == [(1, None), (2, "")]


def test_piece_distribution():
    """Drawn segmentations come with the product of their pieces' weights."""
    pieces = piece_sampling.Pieces(piece_sampling._model(None))
    n = 60_000
    ids, ends = pieces.encode(["the nation"] * n, np.arange(n, dtype=np.uint64) * np.uint64(77))
    begin, count = 0, collections.Counter()
    for end in ends.tolist():
        count[tuple(ids[begin:end].tolist())] += 1
        begin = end

    def segmentations(word):
        if not word:
            yield (), 0.0
        for k in range(1, len(word) + 1):
            piece, weight = pieces.find(np.array([pieces._hash(word[:k])], np.uint64))
            if piece[0] >= 0:
                for rest, w in segmentations(word[k:]):
                    yield (int(piece[0]), *rest), w + float(weight[0])

    both = [(a + b, v + w) for a, v in segmentations("▁the") for b, w in segmentations("▁nation")]
    weight = np.exp([w for _, w in both])
    for (s, _), p in zip(both, weight / weight.sum(), strict=True):
        assert abs(count[s] / n - p) < 0.01
