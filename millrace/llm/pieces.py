"""SentencePiece encoding and decoding by a forward pass over a trie of words.

A block of rows gives its distinct marked words (a space becomes the mark
U+2581 at the front of the word after it). Sorted, they are the trie's paths in
depth-first order: each word takes over the forward states of the prefix that
it shares with the word before it and computes only the rest. A back trace
from a word's end gives its pieces.

The state of a prefix depends on the model's kind. For a unigram model it is
the best score of any segmentation (Viterbi). For a merge (BPE) model the best
score doesn't give the merge order's segmentation, so the state is the last
piece of the prefix's own merge result: the one piece ending there that stays
apart from the last piece of the prefix before it. Runs of marks, whose pieces
tie in score, are merged directly.

Encoded words stay in a cache of bounded size in each Python worker, so rows
are never shuffled and memory doesn't grow with the corpus.

Edge cases: a null or empty text has no pieces. Characters outside the
vocabulary become byte pieces (the unknown piece, if the model has no bytes).
Decoding gives back the text exactly, but for texts that hold the mark itself
(it comes back as a space). Texts of any length are read whole; repeated rows
give repeated results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import table

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words kept encoded in a worker, and rows encoded at once.
CACHE, ROWS = 500_000, 1000
#: Words longer than this aren't kept.
LONG = 64


class Model:
    """Pieces of a SentencePiece model and the forward pass over them."""

    def __init__(self, pieces: Iterable[tuple[str, float]], kind: str = "bpe", byte_ids: dict[int, int] | None = None, unknown: int = 0, reserved: Iterable[str] = (), first_id: Iterable[int] | None = None):
        pieces = list(pieces)
        ids = list(first_id) if first_id is not None else range(len(pieces))
        self.ids = {p: i for i, (p, _) in zip(ids, pieces, strict=True)}
        self.score = dict(pieces)
        self.kind, self.bytes, self.unknown = kind, byte_ids or {}, unknown
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.newline_apart = not any("\n" in p for p in self.ids)
        self.table: dict[int, bytes] = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        self.table |= {i: bytes([b]) for b, i in self.bytes.items()}
        #: The id of every piece, and -1 for the other ends of pieces.
        self.tails = {p[i:]: -1 for p in self.ids for i in range(len(p))} | self.ids
        #: Neighbouring characters of pieces; no piece reaches over any other two.
        self.joints = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.spelled = {i: p for p, i in self.ids.items()}
        self.lowest = min(self.score.values(), default=0.0) - 10.0
        self._apart: dict[tuple[int, int], bool] = {}
        self._cache: dict[str, tuple[int, ...]] = {}
        self._parts: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        kind = {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
        spec = proto.normalizer_spec
        if not (spec.name == "identity" and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces):
            raise ValueError("only models that leave texts as they are, with a space put first, are supported")
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        if any(MARK in p.lstrip(MARK) for _, p, _ in normal):
            raise ValueError("pieces that reach over a space are not supported")
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        unknown = next((i for i, p in enumerate(proto.pieces) if p.type == 2), 0)
        return cls([(p, s) for _, p, s in normal], kind, byte_ids, unknown, first_id=[i for i, _, _ in normal])

    def merged(self, word: str) -> list[str]:
        """Merge neighbours, best score first and leftmost among equals, while their union is a piece."""
        part: list[str | None] = list(word)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        score, heap = self.score, []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(part) and (s := score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, part[i] + part[j]))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, union = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) >= len(part) or part[i] + part[j] != union:
                continue
            part[i], part[j] = union, None
            after[i] = after[j]
            if after[i] < len(part):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in part if p is not None]

    def apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces merge to just these two; a character without a piece (id below 0) never merges."""
        key = (left, right)
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= 4 * CACHE:
                self._apart.clear()
            ends = [self.spelled[i] for i in key if i >= 0]
            known = self._apart[key] = right < 0 or self.merged("".join(ends) if left >= 0 else ends[-1]) == (ends if left >= 0 else ends[-1:])
        return known

    def _walk_bpe(self, word: str, states: list, begin: int) -> None:
        """Add the states (last piece, where it begins) of the prefixes longer than begin."""
        tails, apart = self.tails, self._apart
        for end in range(begin + 1, len(word) + 1):
            at = end - 1
            piece = tails.get(word[at])
            found = [(-2 if piece is None or piece < 0 else piece, at)]
            while piece is not None and at:
                at -= 1
                piece = tails.get(word[at:end])
                if piece is not None and piece >= 0:
                    found.append((piece, at))
            for state in reversed(found):
                key = (states[state[1]][0], state[0])
                if apart[key] if key in apart else self.apart(*key):
                    states.append(state)
                    break
            else:
                raise ValueError(f"no piece ends at {end} of {word!r}")

    def _walk_unigram(self, word: str, states: list, begin: int) -> None:
        """Add the states (last piece, where it begins, best score) of the prefixes longer than begin."""
        for end in range(begin + 1, len(word) + 1):
            best = None
            for at in range(max(0, end - self.longest), end):
                piece = word[at:end]
                gain = self.score.get(piece)
                if gain is None and end - at == 1:
                    gain = self.lowest
                if gain is not None:
                    total = states[at][2] + gain
                    if best is None or total > best[2]:
                        best = (self.ids.get(piece, -2), at, total)
            states.append(best)

    def _unknown(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """All distinct words, sorted, by one depth-first walk of their trie."""
        walk = self._walk_bpe if self.kind == "bpe" else self._walk_unigram
        states: list[tuple] = [(-3, 0, 0.0)]
        last, out = "", {}
        for word in sorted(set(words)):
            if self.kind == "bpe" and MARK * 2 in word:
                out[word] = tuple(chain.from_iterable([self.ids[p]] if p in self.ids else self._unknown(p) for p in self.merged(word)))
                continue
            n, shared = min(len(word), len(last)), 0
            while shared < n and word[shared] == last[shared]:
                shared += 1
            del states[shared + 1 :]
            walk(word, states, shared)
            last, at, ids = word, len(word), []
            while at:
                piece, begin = states[at][:2]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids += reversed(self._unknown(word[begin:at]))
                at = begin
            out[word] = tuple(reversed(ids))
        return out

    def parts(self, word: str) -> list[str]:
        """The word cut where no piece can reach over."""
        joints = self.joints
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joints]
        if not cuts:
            return [word]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def marked(self, text: str) -> list[str]:
        """The marked words of a text, in order; line ends stand alone, and empty strings mean nothing."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if self.newline_apart and "  " not in text and text[0] != " ":
            return (MARK + text.replace(" ", " " + MARK)).replace("\n", " \n ").split(" ")
        words, run = [], ""
        for p in text.split(" "):
            run += MARK
            if p:
                words.append(run + p)
                run = ""
        if run:
            words.append(run)
        if self.newline_apart:
            return [x for w in words for x in w.replace("\n", " \n ").split(" ")]
        return words

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        listed = [self.marked(t) for t in texts]
        cache, known = self._cache, self._parts
        new = {w: self.parts(w) for w in set(chain.from_iterable(listed)).difference(cache)}
        known |= self.encode_words(set(chain.from_iterable(new.values())).difference(known))
        part = known.__getitem__
        cache.update((w, part(ps[0]) if len(ps) == 1 else tuple(chain.from_iterable(map(part, ps)))) for w, ps in new.items())
        get = cache.__getitem__
        out = [np.fromiter(chain.from_iterable(map(get, words)), np.int32) for words in listed]
        for w in new:
            if len(w) > LONG:
                del cache[w]
        for kept in (cache, known):
            if len(kept) > CACHE:
                kept.clear()
        return out

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.table.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model.load(path)
    return _models[path]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def encoded(docs: DataFrame, path: str = MODEL, check: bool = False) -> DataFrame:
    """docs with its columns, and ids array<int>; check adds round_trip: whether decoding gives the text."""
    kept = [c for c in docs.columns if c not in ("ids", "round_trip")]
    where = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or "" for t in part.column(where).to_pylist()]
                ids = m.encode(texts)
                cols, names = [*part.columns, _lists(ids)], [*kept, "ids"]
                if check:
                    cols.append(pa.array([m.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)], pa.bool_()))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(cols, names)

    from pyspark.sql import types as T

    fields = [docs.schema[c] for c in kept] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] + ([T.StructField("round_trip", T.BooleanType())] if check else [])
    return docs.select(*kept).mapInArrow(W.tidy(run), T.StructType(fields))


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """rows with ids array<int> -> the same rows and their text; null ids give null."""
    kept = [c for c in rows.columns if c != "text"]
    where = kept.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [None if i is None else m.decode(i) for i in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, "text"])

    from pyspark.sql import types as T

    return rows.select(*kept).mapInArrow(W.tidy(run), T.StructType([*(rows.schema[c] for c in kept), T.StructField("text", T.StringType())]))


def op8_sentencepiece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = encoded(docs, check=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
