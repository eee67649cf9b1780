"""Operator 5, SentencePiece encoding and decoding: forward filtering, backward sampling over the piece lattice.

A text's lattice holds every vocabulary piece at every place where its characters stand. A segmentation's weight is
the product of its pieces' weights (rank + RANK) ** -THETA, the piece's rank being its place among the merges. One
pass forward sums the weights of all segmentations of each prefix; a pass backward draws the last piece, the one
before, and so on, each in proportion to the weight of all that it completes, so that segmentations come with their own
probability, to the precision of a draw: it has 24 bits and chances are 32-bit floats, so that a piece with a chance under
2^-24 at its place isn't drawn. No piece holds a space after another character (the vocabulary is checked for that), so words, with
the whole run of spaces before them, are drawn one by one.

The draw at a place of a row is a hash of the row's key, the place and SEED: the same row always gets the same ids,
in whatever batch or task. THETA = inf is the most probable path in effect; smaller values vary more.

Decoding joins pieces and bytes and drops the space in front. It is lossless: characters without a piece, and
U+2581 itself (which pieces use for the space), are spelled in byte pieces. Null texts are empty, empty texts have no
ids, a null key draws as NULL_KEY does, and null ids decode to a null text; repeated rows get equal ids. Other columns are ignored.

Work is by whole arrays: one lattice for each distinct word, one draw for each occurrence.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm._shared import read_table, small_batches
from flowlens.llm._words import mix, slices

THETA, RANK, SEED = 1.5, 50.0, 1
#: A number far from the ids that tables count up from.
NULL_KEY = -0x6E756C6C20646F63
#: Characters that one slice of texts has, about; bounds a worker's arrays.
SLICE = 1 << 20
#: Lattice slots (a character each, about) that a worker keeps for words that come again: 128 bytes a slot.
KEPT = 1_500_000
_SPACE, _PAD, _LITERAL = 0x2581, 0x7FFFFFFF, 0x110000
_BASE, _G = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 18


class Pieces:
    """The vocabulary as arrays: a two-choice hash table of substrings, and each id's bytes."""

    def __init__(self, model_path: str, theta: float = THETA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.vocab_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int64)
        keys, ids, rank = [], [], 0
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if "▁" in piece.lstrip("▁"):
                    raise ValueError(f"piece {i} holds a space after another character: words cannot be drawn apart")
                self.bytes_of[i] = piece.replace("▁", " ").encode()
                keys.append(piece)
                ids.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        self.longest = max(map(len, keys))
        order = sorted(range(len(keys)), key=lambda k: -model.get_score(ids[k]))
        weight = np.zeros(len(keys))
        for rank, k in enumerate(order):
            weight[k] = -theta * np.log(rank + RANK)
        self.byte_weight = float(-theta * np.log(len(keys) + RANK))
        hashes = np.array([self._hash(k) for k in keys], np.uint64)
        self.key = np.zeros((2, _SLOTS), np.uint64)
        self.id = np.full((2, _SLOTS), -1, np.int32)
        self.weight = np.full((2, _SLOTS), -np.inf, np.float32)
        self._fill(hashes, np.array(ids), weight)
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.all = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.kept: dict[str, int] = {}
        self.used = 0
        self.ids = np.empty((KEPT, self.longest), np.int32)
        self.chance = np.empty((KEPT, self.longest), np.float32)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return int(mix(np.array([h], np.uint64))[0])

    @staticmethod
    def _slot(hashes: np.ndarray, side: int) -> np.ndarray:
        return ((hashes >> np.uint64(20 if side else 44)) & np.uint64(_SLOTS - 1)).astype(np.int64)

    def _fill(self, hashes: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> None:
        where = {}
        slots = [self._slot(hashes, s).tolist() for s in (0, 1)]
        for k in range(len(hashes)):
            side = 0
            for _ in range(500):  # a piece may push another to its other place
                at = side, slots[side][k]
                k, where[at] = where.get(at), k
                if k is None:
                    break
                side = 1 - at[0]
            else:
                raise ValueError("the hash table is too small for the vocabulary")
        for (side, slot), k in where.items():
            self.key[side, slot], self.id[side, slot], self.weight[side, slot] = hashes[k], ids[k], weight[k]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, log weight) of substrings by hash."""
        a = self._slot(hashes, 0)
        hit = self.key[0][a] == hashes
        ids, weight = np.where(hit, self.id[0][a], -1), np.where(hit, self.weight[0][a], -np.inf).astype(np.float32)
        rest = np.flatnonzero(~hit)
        b = self._slot(hashes[rest], 1)
        hit = self.key[1][b] == hashes[rest]
        ids[rest[hit]], weight[rest[hit]] = self.id[1][b[hit]], self.weight[1][b[hit]]
        return ids, weight

    def lattice(self, words: list[str]):
        """(first slot of each word, ids and cumulated chances by slot and piece length). A word has a slot for its
        beginning, one for the space before it and one for each character, further spaces in front among them."""
        joined = "▁" + "".join([w + "￾▁" for w in words])  # U+FFFE stands where a word's first slot is
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)[:-1].astype(np.int64)
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        start = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        n = int((lengths + 1).sum())
        # points: space, word, mark for each word; slots: mark, space, word for each
        points = np.concatenate([[_PAD], points[: n - 1]])
        points[start] = _PAD
        literal = points == _SPACE
        literal[start + 1] = False
        points[literal] = _LITERAL
        points[points == 32] = _SPACE
        place = np.arange(n) - np.repeat(start, lengths + 1)
        most = min(self.longest, int(lengths.max()))
        ids = np.full((n, most), -1, np.int32)
        weight = np.full((n, most), -np.inf, np.float32)
        h = np.zeros(n, np.uint64)
        for k in range(1, most + 1):
            h[1:] = h[:-1] * _BASE + points[1:].astype(np.uint64) + np.uint64(1)
            h[0] = 0
            if k == 1:
                h[:] = points.astype(np.uint64) + np.uint64(1)
            at = np.flatnonzero(place >= k)
            ids[at, k - 1], weight[at, k - 1] = self.find(mix(h[at]))
        spelled = np.flatnonzero((place >= 1) & (ids[:, 0] < 0))
        code = points[spelled]
        ids[spelled, 0] = np.where(code < 128, self.byte_id[np.minimum(code, 127)], -2 - code)
        weight[spelled, 0] = self.byte_weight * np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where((code < 0x10000) | (code == _LITERAL), 3, 4)))
        self._forward(start, lengths, weight)
        return start, ids, weight

    @staticmethod
    def _forward(start: np.ndarray, lengths: np.ndarray, weight: np.ndarray) -> None:
        """Turns log weights of pieces that end at a slot into cumulated chances of being the last piece there."""
        n, most = weight.shape
        total = np.zeros(n)
        back = np.arange(1, most + 1)
        order = np.argsort(-lengths, kind="stable")
        start, lengths = start[order], lengths[order]
        active = np.searchsorted(-lengths, -np.arange(1, int(lengths.max()) + 1), "right")
        for p, m in enumerate(active.tolist(), 1):
            end, k = start[:m] + p, min(p, most)
            x = weight[end, :k] + total[end[:, None] - back[:k]]
            top = x.max(axis=1, keepdims=True)
            cumulated = np.cumsum(np.exp(x - top), axis=1)
            total[end] = np.log(cumulated[:, -1]) + top[:, 0]
            weight[end, :k] = cumulated / cumulated[:, -1:]
            weight[end, k:] = 2

    def _tables(self, words: list[str]):
        """(first slot of each word, ids, chances). Lattices are kept for words that come again, up to KEPT slots."""
        for _ in range(2):
            new = list({w for w in words if w not in self.kept})
            need = sum(map(len, new)) + 2 * len(new)
            if self.used + need <= KEPT:
                break
            self.kept.clear()
            self.used = 0
        if need > KEPT:
            start, ids, chance = self.lattice(new)
            known = dict(zip(new, start.tolist(), strict=True))
        else:
            known = self.kept
            if new:
                start, ids, chance = self.lattice(new)
                self.ids[self.used : self.used + need, : ids.shape[1]] = ids
                self.chance[self.used : self.used + need] = 2
                self.chance[self.used : self.used + need, : ids.shape[1]] = chance
                known.update(zip(new, (start + self.used).tolist(), strict=True))
                self.used += need
            ids, chance = self.ids, self.chance
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words)), ids, chance

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, each text's end in them); keys: an unsigned 64-bit number for each text."""
        words, count = [], []
        for text in texts:
            own = _words(text)
            words += own
            count.append(len(own))
        if not words:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        slot, ids, chance = self._tables(words)
        row = np.repeat(np.arange(len(texts)), count)
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        base = np.cumsum(length) - length
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        base -= np.concatenate([base, [0]])[first][row]
        seed = mix(keys + np.uint64(SEED) * _G)[row]
        left = length.copy()
        which, drawn = np.arange(len(words)), []
        while len(which):
            end = slot[which] + left[which]
            u = mix(seed[which] + (base[which] + left[which]).astype(np.uint64) * _G) >> np.uint64(40)
            k = (chance[end] <= (u.astype(np.float32) * np.float32(2.0**-24))[:, None]).sum(axis=1)
            drawn.append((which, ids[end, k]))
            left[which] -= k + 1
            which = which[left[which] > 0]
        pieces = np.zeros(len(words), np.int64)
        for which, _ in drawn:
            pieces[which] += 1
        ends = np.cumsum(pieces)
        out = np.zeros(int(ends[-1]), np.int64)
        for step, (which, found) in enumerate(drawn):
            out[ends[which] - 1 - step] = found
        rows = np.repeat(row, pieces)
        if (out < 0).any():
            out, rows = self._spelled(out, rows)
        return out.astype(np.uint32), np.searchsorted(rows, np.arange(len(texts)), "right")

    def _spelled(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replaces marks of characters without a piece by the ids of their bytes."""
        at = np.flatnonzero(ids < 0)
        spelled = [self.byte_id[list(chr(_SPACE if c == _LITERAL else c).encode("utf-8", "surrogatepass"))] for c in (-2 - ids[at]).tolist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[at] = [len(s) for s in spelled]
        out = np.repeat(ids, sizes)
        places = (np.cumsum(sizes) - sizes)[at]
        for place, s in zip(places.tolist(), spelled, strict=True):
            out[place : place + len(s)] = s
        return out, np.repeat(rows, sizes)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of one text, or of several with the space before each."""
        size = self.size[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.all[at].tobytes()


def _words(text: str) -> list[str]:
    """The text's words, each with the spaces before it but one; spaces at the end make a word of their own."""
    parts = text.split(" ") if text else []
    if "" not in parts:
        return parts
    words, spaces = [], 0
    for part in parts[:-1]:
        if part:
            words.append(" " * spaces + part)
            spaces = 0
        else:
            spaces += 1
    return [*words, " " * spaces + parts[-1]]


_loaded: dict[tuple, Pieces] = {}


def _pieces(model_path: str, theta: float) -> Pieces:
    if (model_path, theta) not in _loaded:
        _loaded[model_path, theta] = Pieces(model_path, theta)
    return _loaded[model_path, theta]


def _model(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _encoded(column: pa.Array, keys: np.ndarray, pieces: Pieces):
    """(row, ids) of each row."""
    for at, part in slices(column, SLICE):
        texts = [x or "" for x in part.to_pylist()]
        ids, ends = pieces.encode(texts, keys[at : at + len(texts)])
        begin = 0
        for i, end in enumerate(ends.tolist()):
            yield at + i, texts[i], ids[begin:end]
            begin = end


def _keys(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_KEY).to_numpy(zero_copy_only=False).astype(np.uint64)


def encode(docs: DataFrame, model_path: str | None = None, theta: float = THETA) -> DataFrame:
    """doc_id and ids (array<int>) of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    path = _model(model_path)

    @F.arrow_udf("array<int>")
    def sample(key: pa.Array, text: pa.Array) -> pa.Array:
        return pa.array([ids.astype(np.int32) for _, _, ids in _encoded(text, _keys(key), _pieces(path, theta))], pa.list_(pa.int32()))

    return docs.select("doc_id", sample(F.col("doc_id").cast("long"), "text").alias("ids"))


def decode(rows: DataFrame, model_path: str | None = None) -> DataFrame:
    """rows (any columns and ids) with the column text in place of ids."""
    small_batches(rows.sparkSession)
    path = _model(model_path)

    @F.arrow_udf("string")
    def join(ids: pa.Array) -> pa.Array:
        pieces = _pieces(path, THETA)
        return pa.array([None if x is None else pieces.decode(np.array(x, np.int64))[1:].decode() for x in ids.to_pylist()], pa.string())

    return rows.withColumn("text", join("ids")).drop("ids")


def op5_piece_sampling(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (unsigned little-endian 32-bit ids), n_bytes, lossless of every document."""
    docs = read_table(spark, sf_dir, "documents")
    small_batches(spark)
    path = _model(None)

    @F.arrow_udf("struct<n_ids:bigint,ids_crc32:bigint,n_bytes:bigint,lossless:boolean>")
    def digest(key: pa.Array, text: pa.Array) -> pa.Array:
        pieces, rows = _pieces(path, THETA), []
        for _, source, ids in _encoded(text, _keys(key), pieces):
            data = pieces.decode(ids.astype(np.int64))[1:]
            rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(data), data == source.encode()))
        names, kinds = ["n_ids", "ids_crc32", "n_bytes", "lossless"], [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return docs.select("doc_id", digest(F.col("doc_id").cast("long"), "text").alias("d")).select("doc_id", "d.*")
