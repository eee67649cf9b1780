"""Pieces that are runs of spaces take part in the lattice."""

import collections

import numpy as np
import pytest

from flowlens.llm import piece_sampling


@pytest.fixture(scope="module")
def pieces():
    return piece_sampling.Pieces(piece_sampling._model(None))


def test_every_piece_takes_part(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_sampling._model(None))
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
            assert pieces.find(np.array([pieces._hash(model.id_to_piece(i))], np.uint64))[0][0] == i


@pytest.mark.parametrize("text", ["a   is", "  on", "at    ", "to  be"])
def test_distribution_with_runs_of_spaces(pieces, text):
    n = 60_000
    ids, ends = pieces.encode([text] * n, np.arange(n, dtype=np.uint64) * np.uint64(77))
    begin, count = 0, collections.Counter()
    for end in ends.tolist():
        count[tuple(ids[begin:end].tolist())] += 1
        begin = end

    def segmentations(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            piece, weight = pieces.find(np.array([pieces._hash(rest[:k])], np.uint64))
            if piece[0] >= 0:
                for more, w in segmentations(rest[k:]):
                    yield (int(piece[0]), *more), w + float(weight[0])

    every = list(segmentations("▁" + text.replace(" ", "▁")))
    weight = np.exp([w for _, w in every])
    for (s, _), p in zip(every, weight / weight.sum(), strict=True):
        assert abs(count[s] / n - p) < 0.01
    assert sum(count.values()) == sum(count[s] for s, _ in every)


def test_lossless_with_spaces(pieces):
    texts = ["", " ", "  ", "a  b", "   lead", "trail   ", "x\n    y", "▁▁ ▁ a  ▁", " " * 300 + "x" + " " * 40, "one two"]
    ids, ends = pieces.encode(texts, np.arange(len(texts), dtype=np.uint64))
    begin = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert pieces.decode(ids[begin:end].astype(np.int64))[1:].decode() == text
        begin = end
