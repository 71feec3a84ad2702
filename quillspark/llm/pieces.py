"""Encoding and decoding with a merge-type (BPE) SentencePiece vocabulary, in Arrow batches.

A normalized text is a row of symbols, at first its characters. An agenda holds every pair of neighbours that a piece
spells, best score first and of equal scores the leftmost; the best pair is merged, which puts its symbol's pairs with the
new neighbours on the agenda, until none is left. Symbols without a piece become bytes.

Merges never reach over a place where no piece of the vocabulary could stand. Where no piece holds a word mark behind
another character, that is before each run of word marks, so a text is cut there and a worker runs the agenda once for each
different segment. The sentencepiece library then encodes the batch's new segments too: a difference is an error.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

MARK = "▁"
#: Segments that a worker keeps; those of LONG characters and more are not kept, and have an agenda of their own.
CACHE, LONG = 800_000, 64
#: Segments whose agendas go in step.
BLOCK = 8192
NONE = 1 << 30


class Pieces:
    """A vocabulary's scores and ids, taken from the library, and the agenda over them."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as spec

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind, size = spec.ModelProto.FromString(m.serialized_model_proto()), m.get_piece_size()
        rules = kind.normalizer_spec
        if kind.trainer_spec.model_type != spec.TrainerSpec.BPE or any(p.type in (p.UNUSED, p.USER_DEFINED) for p in kind.pieces):
            raise ValueError("only merge-type vocabularies without unused and user-defined pieces are read")
        normal = [(m.id_to_piece(i), i) for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        self.ids = dict(normal)
        #: Place of each piece by falling score; pieces of equal score share one, and then the leftmost pair comes first.
        places = {s: k for k, s in enumerate(sorted({m.get_score(i) for _, i in normal}, reverse=True))}
        self.place = {p: places[m.get_score(i)] for p, i in normal if len(p) > 1}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(m.is_byte(i) for i in self.bytes)
        #: A mark leads the text and stands for each space, and that is all of the vocabulary's normalization.
        self.plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        #: Texts are cut before runs of marks if no piece holds a mark behind another character.
        self.separable = self.plain and not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.begin, self.end = m.bos_id(), m.eos_id()
        self.known: dict[str, bytes] = {}
        self.checked = 0
        # the same scores for the agenda over many segments: characters' ids, and pairs of ids in order with what they make
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in normal:
            if len(p) == 1:
                self.char[ord(p)] = i
        pairs = sorted((self.ids[p[:k]] * size + self.ids[p[k:]], r, self.ids[p]) for p, r in self.place.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.pairs, self.pair_place, self.pair_id = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ([-1], [0], [0])))
        self.size = size

    def merged(self, text: str) -> list[str]:
        """Symbols of a normalized text after all merges."""
        symbols, place = list(text), self.place
        n = len(symbols)
        agenda = [(r, i, p) for i in range(n - 1) if (r := place.get(p := symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, left, piece = heappop(agenda)
            right = after[left]
            if right >= n or not symbols[left] or symbols[left] + symbols[right] != piece:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = piece, ""
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                if (r := place.get(p := piece + symbols[nxt])) is not None:
                    heappush(agenda, (r, left, p))
            if (prev := before[left]) >= 0 and (r := place.get(p := symbols[prev] + piece)) is not None:
                heappush(agenda, (r, prev, p))
        return [s for s in symbols if s]

    def unspelled(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.fallback else [self.model.unk_id()]

    def one(self, text: str) -> bytes:
        """Ids of one segment of any length."""
        out: list[int] = []
        for s in self.merged(text):
            i = self.ids.get(s)
            out += self.unspelled(s) if i is None else [i]
        return np.array(out, "<u4").tobytes()

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place or NONE, id of the merged piece) of pairs of ids; -1 is a character without a piece."""
        key = np.where((left < 0) | (right < 0), -2, left * self.size + right)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[at] == key
        return np.where(hit, self.pair_place[at], NONE), self.pair_id[at]

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of many short segments: in each round the best pair of every segment is merged, of equal ones the leftmost."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        lengths = np.array([len(t) for t in texts])
        owner, start, symbol = np.repeat(np.arange(len(texts)), lengths), np.arange(len(codes)), self.char[codes].astype(np.int64)
        place, made = np.full(len(codes), NONE), np.zeros(len(codes), np.int64)
        if len(codes) > 1:
            place[:-1], made[:-1] = self._looked_up(symbol[:-1], symbol[1:])
            place[:-1][owner[:-1] != owner[1:]] = NONE
        done = []
        while len(owner):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(place * len(owner) + np.arange(len(owner)), heads)
            open_ = best < NONE * len(owner)
            if not open_.all():  # segments without a pair are ready
                going = np.repeat(open_, np.diff(np.append(heads, len(owner))))
                done.append((start[~going], symbol[~going]))
                owner, start, symbol, place, made = (x[going] for x in (owner, start, symbol, place, made))
                if not len(owner):
                    break
                heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                best = np.minimum.reduceat(place * len(owner) + np.arange(len(owner)), heads)
            left = best % len(owner)
            symbol[left] = made[left]
            keep = np.ones(len(owner), bool)
            keep[left + 1] = False
            left -= np.arange(len(left))  # each merge before it takes one symbol away
            owner, start, symbol, place, made = (x[keep] for x in (owner, start, symbol, place, made))
            for at in (left[left + 1 < len(owner)], left[left > 0] - 1):
                place[at], made[at] = self._looked_up(symbol[at], symbol[at + 1])
                place[at[owner[at] != owner[at + 1]]] = NONE
            place[-1] = NONE
        start, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(start)
        start, symbol = start[order], symbol[order]
        if (symbol < 0).any():
            spelled = [[s] if s >= 0 else self.unspelled(chr(codes[at])) for at, s in zip(start.tolist(), symbol.tolist(), strict=True)]
            start, symbol = np.repeat(start, [len(x) for x in spelled]), np.array([i for x in spelled for i in x])
        data, ends = symbol.astype("<u4").tobytes(), np.searchsorted(start, np.cumsum(lengths), "left").tolist()
        return [data[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new segments (their first mark left out) by the agenda; the library must give the same."""
        short = [s for s in new if len(s) < LONG]
        found = {}
        for at in range(0, len(short), BLOCK):
            block = short[at : at + BLOCK]
            found.update(zip(block, self.many([MARK + s for s in block]), strict=True))
        found |= {s: self.one(MARK + s) for s in new if len(s) >= LONG}
        asked = [s for s in new if s]  # the library reads an empty text as no mark, and else puts one in front
        for s, theirs in zip(asked, self.model.encode(asked, num_threads=1), strict=True):
            if np.array(theirs, "<u4").tobytes() != found[s]:
                raise AssertionError(f"agenda and library differ on {s[:200]!r}")
        self.checked += len(asked)
        return found

    def cut(self, text: str) -> list[str]:
        """Segments of a whole text, each without the mark that leads it."""
        if not text:
            return []
        words = text.replace(MARK, " ").split(" ")
        return words if "" not in words else [s[1:] for s in SEGMENT.findall(MARK + MARK.join(words))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts, without begin and end ids."""
        if not self.separable:
            out = [self.one(t) for t in self.model.normalize(texts)]
            if any(np.array(x, "<u4").tobytes() != y for x, y in zip(self.model.encode(texts, num_threads=1), out, strict=True)):
                raise AssertionError("agenda and library differ")
            return out
        if len(self.known) > CACHE:
            self.known.clear()
        known, out, open_, new = self.known, [b""] * len(texts), [], set()
        for k, text in enumerate(texts):
            cuts = self.cut(text)
            ids = [*map(known.get, cuts)]
            try:
                out[k] = b"".join(ids)
            except TypeError:  # None: a segment that is not known yet
                open_.append((k, cuts))
                new.update(s for s, x in zip(cuts, ids, strict=True) if x is None)
        if new:
            found = self.learn(list(new))
            known.update((s, x) for s, x in found.items() if len(s) < LONG)
            for k, cuts in open_:
                out[k] = b"".join([x if (x := known.get(s)) is not None else found[s] for s in cuts])
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.model.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1)


SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    """One for each Python worker, which Spark uses again for its next tasks, cache and all."""
    return Pieces(path)


def encode(df: DataFrame, model: str, ends: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ids: the ids of every text as little-endian unsigned 32-bit integers, with begin and end ids if ``ends``.

    Null and empty texts have no ids but those; texts of any length are encoded whole; repeated rows and null keys give
    a row each, other columns are ignored, an empty table gives none."""
    kind = df.schema[key].dataType

    def run(batches):
        p = pieces(model)
        head, tail = (np.array([x], "<u4").tobytes() if ends and x >= 0 else b"" for x in (p.begin, p.end))
        for part in text_slices(batches):
            ids = p.encode([x or "" for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([head + x + tail for x in ids], pa.binary())], [key, "ids"])

    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind.simpleString()}, ids binary")


def decode(df: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """``df`` (``key``, ids as ``encode`` gives them) with the text that the library decodes from them; null ids: empty."""
    kind = df.schema[key].dataType

    def run(batches):
        p = pieces(model)
        for part in text_slices(batches, most=1 << 21):
            ids = [x or b"" for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p.decode(ids), pa.string())], [key, "ids", "text"])

    return df.select(key, "ids").mapInArrow(run, f"{key} {kind.simpleString()}, ids binary, text string")
