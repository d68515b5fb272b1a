"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text is cut into words, each with the spaces before it; no piece of the model reaches from a
word into the next word's spaces, so words are encoded on their own, distinct ones once. Words of
equal length are rows of a matrix and advance together: the hashes of all substrings up to the
longest piece are looked up among the sorted hashes of the pieces, and from position to position
one vectorised maximum over all pieces that end there gives the best one and the back pointer.

What is maximised follows the model's type, so that the ids are the library's:
- unigram: the sum of piece scores, the longest last piece winning ties. Sums are of 64 bits and
  by word; the library's are of 32 bits, so where two differ by rounding alone it may choose the other.
- BPE: merging gives a text one segmentation, and this is the one in which every two neighbours
  are what merging makes of the two alone. So the last piece of each prefix is the one that may
  follow the last piece of the prefix before it: a pair scores 0 if it may stand and minus
  infinity if not. Whether it may is told by undoing the latest merges of both pieces step by
  step: no two parts that touch at the border at one time may be a piece that merges sooner.

A character that no piece covers becomes its UTF-8 bytes' ids, so decoding restores every text
exactly; the character U+2581, which stands for a space inside the model, is written as bytes as
well (there the library gives the ids of a space).

Defined results: a null or empty text has no ids; repeated rows each get a row; a null doc_id
stays null; there are no ties between segmentations of a BPE model; a very long text is encoded
whole, a word at a time, and a very long word in steps of CELLS positions; an empty table gives
an empty result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices, table

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: Words that a Python worker remembers; beyond that the cache starts anew. Longer words are not kept.
CACHE_WORDS, CACHE_CHARS = 400_000, 32
#: Bytes of text that are encoded at once: many words of a length make few, long steps.
SLICE = 1 << 22
#: Cells (words by positions) whose substrings are looked up at once.
CELLS = 150_000
#: What a character outside of all pieces costs beyond the worst piece.
PENALTY = 10.0

#: A cell without an id. The id of a character outside of all pieces, and what stands before a word.
_NONE = -(1 << 40)
_UNKNOWN, _START = -2, -3
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _U(_BASE)), np.full(n, _U(pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def is_bpe(model) -> bool:
    """Whether a model was made by merging: field 3 of its trainer's settings is 2."""
    from sentencepiece import sentencepiece_model_pb2

    settings = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
    return settings.trainer_spec.model_type == settings.trainer_spec.BPE


class Merges:
    """Which two pieces may stand side by side in what merging makes of a text."""

    def __init__(self, ids: dict[str, int], scores: dict[int, float]):
        self.ids, self.scores = ids, scores
        self.names = {i: name for name, i in ids.items()}
        if any(c not in ids for name in ids for c in name):
            raise ValueError("a piece holds a character that is no piece")
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True), 1)}  # the first merges first
        n = max(ids.values()) + 1
        # a piece's rank and its two parts; single characters are there from the start
        self.rank, self.left, self.right = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        # pieces told apart neither by score nor by order of their parts, and such that no text has
        self.odd, self.never = np.zeros(n, bool), np.zeros(n, bool)
        shared = Counter(scores.values())
        for name, i in ids.items():
            if len(name) > 1:
                self.rank[i] = rank[scores[i]]
                self.never[i] = not self.split(name, i)
                self.odd[i] = shared[scores[i]] > 1
        whole = np.flatnonzero(self.left >= 0)
        self.odd[whole] |= (self.rank[self.left[whole]] >= self.rank[whole]) | (self.rank[self.right[whole]] >= self.rank[whole])
        pairs = sorted((ids[name[:k]] << 32 | ids[name[k:]], i) for name, i in ids.items() for k in range(1, len(name)) if name[:k] in ids and name[k:] in ids)
        self.pairs, made = np.array([p for p, _ in pairs] or [0], np.int64), np.array([i for _, i in pairs] or [0], np.int64)
        self.made_rank = self.rank[made]
        self.first_bits = np.zeros(1 << 22, bool)
        self.first_bits[self.bits(self.pairs)] = True
        self.known: dict[tuple[int, int], bool] = {}
        # pairs walked of late, a place each by their bits, and what came of them
        self.seen, self.stood = np.full(1 << 22, -1, np.int64), np.zeros(1 << 22, bool)

    @staticmethod
    def bits(pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(_U) * _U(_BASE)) >> _U(42)).view(np.int64)

    def split(self, name: str, i: int) -> bool:
        """Set the parts of piece i; False if merging its characters does not lead to it."""
        parts = self.merge(name, stop=True)
        if len(parts) == 2:
            self.left[i], self.right[i] = (self.ids[p] for p in parts)
        return len(parts) == 2

    def merge(self, text: str, stop: bool = False) -> list[str]:
        """The pieces of a short text by plain merging; with stop, what the last merge to the whole joins."""
        parts = list(text)
        while len(parts) > 1:
            some = [(-self.scores[i], at) for at in range(len(parts) - 1) if (i := self.ids.get(parts[at] + parts[at + 1])) is not None]
            if not some or (stop and len(parts) == 2):
                break
            at = min(some)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_stand(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each pair of ids is what merging makes of the two."""
        out = ~self.never[np.maximum(second, 0)] | (second < 0)
        both = (first >= 0) & (second >= 0) & out
        odd = both & (self.odd[np.maximum(first, 0)] | self.odd[np.maximum(second, 0)])
        for at in np.flatnonzero(odd).tolist():
            pair = int(first[at]), int(second[at])
            if pair not in self.known:
                a, b = self.names[pair[0]], self.names[pair[1]]
                self.known[pair] = self.merge(a + b) == [a, b]
            out[at] = self.known[pair]
        at = np.flatnonzero(both & ~odd)
        key = first[at].astype(np.int64) << 32 | second[at]
        place = self.bits(key)
        seen = self.seen[place] == key
        out[at[seen]] = self.stood[place[seen]]
        at, key, place = at[~seen], key[~seen], place[~seen]
        out[at] = self.walk(key)
        self.seen[place] = key
        self.stood[place] = out[at]
        # two keys of one place may have been written at once: the place holds the last one's
        lost = self.seen[place] == key
        self.stood[place[lost]] = out[at[lost]]
        return out

    def walk(self, key: np.ndarray) -> np.ndarray:
        """Whether pairs (first id << 32 | second id) without odd pieces may stand."""
        out, at = np.ones(len(key), bool), np.arange(len(key))
        a, b = key >> 32, key & 0xFFFFFFFF
        limit = np.full(len(at), np.iinfo(np.int64).max)
        while len(at):
            key = a << 32 | b
            sooner = np.zeros(len(at), bool)
            some = np.flatnonzero(self.first_bits[self.bits(key)])  # most pairs are no piece; few are probed
            found = np.minimum(np.searchsorted(self.pairs, key[some]), len(self.pairs) - 1)
            sooner[some] = (self.pairs[found] == key[some]) & (self.made_rank[found] < limit[some])
            out[at[sooner]] = False
            # undo the later of the last merges on both sides; of equal ones the right one
            undo = self.rank[a] > self.rank[b]
            go = ~sooner & ((self.left[a] >= 0) | (self.left[b] >= 0))
            at, a, b, undo = at[go], a[go], b[go], undo[go]
            limit = np.where(undo, self.rank[a], self.rank[b] + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out


class Pieces:
    """The pieces of a model and what looking them up needs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        names = [model.id_to_piece(i) for i in ids]
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.bytes_of = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else names[i].replace(SPACE, " ").encode() for i in ids]
        self.byte_ids = np.zeros(256, np.int64)
        for i in ids:
            if model.is_byte(i):
                self.byte_ids[self.bytes_of[i][0]] = i
        self.is_byte = np.array([model.is_byte(i) for i in ids])
        self.longest = max(len(names[i]) for i in normal)
        self.unknown = min(model.get_score(i) for i in normal) - PENALTY
        spelled = [np.frombuffer(names[i].encode("utf-32-le"), np.uint32)[:, None] for i in normal]
        keys = np.array([self.hashes(c, len(c))[0, 0] for c in spelled], _U)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal)[order]
        self.first_bits = np.zeros(1 << 20, bool)
        self.first_bits[(self.keys >> _U(44)).astype(np.int64)] = True
        self.scores = np.array([model.get_score(i) for i in self.ids.tolist()])
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces with one hash")
        self.words: dict[str, bytes] = {}
        self.merges = Merges({names[i]: i for i in normal}, {i: model.get_score(i) for i in normal}) if is_bpe(model) else None

    @staticmethod
    def hashes(c: np.ndarray, n: int) -> np.ndarray:
        """The hash of each substring of n characters; words are the columns of c."""
        up, down = _powers(len(c) + 1)
        total = np.zeros((len(c) + 1, c.shape[1]), _U)
        np.cumsum((c.astype(_U) + _U(1)) * up[:-1, None], axis=0, out=total[1:])
        h = (total[n:] - total[:-n]) * down[: len(c) - n + 1, None] + _U(n)
        return (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)

    def look_up(self, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, piece numbers) of the substrings of n characters that are pieces.

        The first bits of a hash rule most substrings out before the sorted keys are probed.
        """
        h = self.hashes(c, n).ravel()
        at = np.flatnonzero(self.first_bits[(h >> _U(44)).astype(np.int64)])
        h = h[at]
        found = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[found] == h
        return at[hit], found[hit]

    def encode_equal(self, words: list[str]) -> list[bytes]:
        """The ids of words of equal length; within, -1 - code point is a character outside of all pieces."""
        n, size = len(words), len(words[0])
        k = min(self.longest, size)
        c = np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).T)
        back, chosen = np.zeros((size, n), np.int32), np.zeros((size, n), np.int32)
        columns = np.arange(n)
        best = np.full((k + size + 1, n), _NONE if self.merges else -np.inf, np.int64 if self.merges else np.float64)  # row k + j: of the first j characters
        best[k] = _START if self.merges else 0
        step = max(k, CELLS // n)
        for lo in range(0, size, step):
            hi = min(size, lo + step)
            # by end position and, from the longest piece on, by length
            found = np.full((hi - lo, k, n), -1, np.int32)
            for length in range(1, min(k, hi) + 1):
                first = max(lo, length - 1)
                at, piece = self.look_up(c[first - length + 1 : hi], length)
                row, column = np.divmod(at, n)
                found[row + (first - lo), k - length, column] = piece
            for j in range(lo, hi):
                before, piece = best[j + 1 : j + 1 + k], found[j - lo]
                ids = np.where(piece >= 0, self.ids[piece], -1)
                if self.merges:  # the piece that may follow; alone, a character outside of all pieces always may
                    ids[k - 1][ids[k - 1] < 0] = _UNKNOWN
                    some = np.flatnonzero((ids != -1) & (before != _NONE))
                    total = np.zeros(ids.size, bool)
                    total[some] = self.merges.may_stand(before.ravel()[some], ids.ravel()[some])
                    at = total.reshape(ids.shape).argmax(axis=0)
                    best[k + j + 1] = ids[at, columns]
                else:
                    total = before + np.where(piece >= 0, self.scores[piece], -np.inf)
                    alone = piece[k - 1] < 0
                    total[k - 1, alone] = before[k - 1, alone] + self.unknown
                    at = total.argmax(axis=0)
                    best[k + j + 1] = total[at, columns]
                back[j] = k - at
                chosen[j] = ids[at, columns]
        # from the end: each word's ids fill its row of a matrix from the right
        filled = np.full((n, size), _NONE, np.int64)
        at, column = np.full(n, size), size - 1
        while len(columns):
            last = at[columns] - 1
            ids_now = chosen[last, columns]
            filled[columns, column] = np.where(ids_now >= 0, ids_now, -1 - c[last, columns].astype(np.int64))
            at[columns] -= back[last, columns]
            columns, column = columns[at[columns] > 0], column - 1
        used = filled != _NONE
        raw, ends = filled[used].astype("<u4").tobytes(), (4 * np.cumsum(used.sum(axis=1))).tolist()
        out = [raw[b:e] for b, e in zip([0, *ends], ends)]  # noqa: B905
        for r in np.flatnonzero(((filled < 0) & used).any(axis=1)).tolist():
            out[r] = self.spelled(filled[r][used[r]].tolist())
        return out

    def spelled(self, ids: list[int]) -> bytes:
        """ids with the characters outside of all pieces as their bytes' ids."""
        parts = [[i] if i >= 0 else self.byte_ids[list(chr(-1 - i).encode("utf-8", "surrogatepass"))].tolist() for i in ids]
        return np.array([x for p in parts for x in p], "<u4").tobytes()

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words, by groups of equal length."""
        found: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            most = max(1, CELLS // length)
            for i in range(0, len(group), most):
                part = group[i : i + most]
                found.update(zip(part, self.encode_equal(part), strict=True))
        return found

    def split(self, text: str) -> list[str]:
        """A text's words; a character U+2581 is one of its own, as the empty word."""
        if not text:
            return []
        if SPACE not in text:
            return _WORDS.findall(SPACE + text.replace(" ", SPACE))
        out: list[str] = []
        for i, part in enumerate(text.split(SPACE)):
            out += [""] * (i > 0) + _WORDS.findall(SPACE * (not i) + part.replace(" ", SPACE))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [self.split(t or "") for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        self.words.setdefault("", self.byte_ids[list(SPACE.encode())].astype("<u4").tobytes())
        new = self.learn({w for words in split for w in words if w not in self.words})
        self.words.update(new)
        out = [b"".join(map(self.words.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > CACHE_CHARS:
                del self.words[w]
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def pieces(vocabulary: str = VOCABULARY) -> Pieces:
    """One per Python worker; its cache serves all tasks of that worker."""
    import public_tokenizers

    return Pieces(public_tokenizers.path(vocabulary))


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """(slice, texts, ids) of the batches."""
    model = pieces(vocabulary)
    for part in slices(batches, SLICE):
        texts = part["text"].to_pylist()
        yield part, texts, model.encode(texts)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text): ids as little-endian unsigned 32-bit numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, ids in _encoded(batches, vocabulary):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, decoded) of encoded (doc_id, ids)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(vocabulary)
        for part in slices(batches, text="ids"):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([model.decode(i) for i in part["ids"].to_pylist()], pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(each, "doc_id long, decoded string")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_crc32, restored) of docs (doc_id, text).

    Encoding and decoding share one pass and one worker a task, and no text goes back to the JVM.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_crc32", pa.int64()), ("restored", pa.bool_())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(vocabulary)
        for part, texts, ids in _encoded(batches, vocabulary):
            back = [model.decode(i) for i in ids]
            columns = [len(i) // 4 for i in ids], [zlib.crc32(i) for i in ids], [zlib.crc32(t.encode()) for t in back], [(t or "") == b for t, b in zip(texts, back, strict=True)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, t.type) for c, t in zip(columns, list(kinds)[1:], strict=True))], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, restored boolean")


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: counts and checksums, and whether it came back whole."""
    return round_trip(table(spark, sf_dir, "documents"))
