"""Encoding whole texts with a public tokenizer inside Arrow batches.

A byte-level or word BPE encodes each pre-token on its own, and a pre-token never reaches over a single white-space
character between two others. So a text is cut there, each different cut is looked up once a call and encoded once a
worker, and the ids are joined. The ids are those of encoding the whole text: tests compare both on mixed scripts, runs of white space
and special tokens' strings.
"""

from __future__ import annotations

import os
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Before one space or line feed that stands between two characters that are no white space.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
RUN = re.compile(r"\s\s")
#: Marks that end a word; an apostrophe is none, since a pre-token can begin with it and go on.
MARKS = '.,!?;:|%$#*&")]}'
#: Memory of a worker's cache: entries after which it starts anew.
CACHE = 900_000
#: Characters of texts that are cut at a time (one text may be longer); more than an Arrow batch of 8 MB and its last text.
AT_ONCE = 9 << 20


class Encoder:
    """Texts to little-endian unsigned 16-bit ids; vocabularies over 65,536 ids are refused."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        if self.model.get_vocab_size() > 65_536:
            raise ValueError("ids do not fit 16 bits")
        marks = {t.content: i for i, t in self.model.get_added_tokens_decoder().items() if t.special and not t.normalized}
        #: A special token's string stands between the cuts of one call: the tokenizer parts its input there first.
        self.mark, self.mark_id = max(marks.items(), key=lambda x: x[1], default=("", -1))
        self.marks = re.compile("|".join(map(re.escape, marks)) or r"(?!)")
        normal = self.model.normalizer.normalize_str if self.model.normalizer else str
        cut = self.model.pre_tokenizer.pre_tokenize_str
        #: What the tokenizer's own normalizer and pre-tokenizer make of a Latin letter within a word, and of a space before one.
        self.letters = {ord(c): x[0][0][1:] for c in map(chr, range(0x130)) if c.isalpha() and len(x := cut(normal("a" + c))) == 1}
        self.word = re.compile("[" + re.escape("".join(map(chr, self.letters))) + "]+")
        self.space = cut(normal(" a"))[0][0][:-1]
        self.ascii = all(ord(c) in self.letters for c in string.ascii_letters)
        self.bytes = [k.to_bytes(2, "little") for k in range(1 << 16)]
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, known: dict[str, bytes], new: list[str], lead: str) -> None:
        """A word of Latin letters is one pre-token and goes to the model at once; the rest takes the whole way."""
        tokenize, space, two, rest = self.model.model.tokenize, self.space if lead else "", self.bytes, []
        for p in new:
            if self.ascii and p.isascii() and p.isalpha() or self.word.fullmatch(p):
                known[p] = b"".join([two[t.id] for t in tokenize(space + p.translate(self.letters))])
            else:
                rest.append(p)
        new, texts = rest, [p if p[:1] == "\n" else lead + p for p in rest]
        if not self.mark:
            known.update(zip(new, self._plain(texts), strict=True))
            return
        for at in range(0, len(new), 5000):
            ids = np.array(self.model.encode_batch_fast([self.mark.join(texts[at : at + 5000])], add_special_tokens=False)[0].ids, dtype="<u2")
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
            data, start = ids.tobytes(), 0
            for p, end in zip(new[at : at + 5000], ends, strict=True):
                known[p] = data[2 * start : 2 * end]
                start = end + 1

    def _cut(self, text: str) -> list[str]:
        """First cut, then the others without the space that leads them (one that a line feed leads keeps it)."""
        first, *rest = CUT.split(text)
        return [first, *(p[1:] if p[0] == " " else p for p in rest)]

    def _fill(self, known: dict[str, bytes], new: set[str] | list[str], lead: str) -> None:
        """Learn ``new``; a word and the marks behind it are two pre-tokens, so known words are not encoded again for each mark."""
        plain = [p for p in new if p.isalpha()]
        self._learn(known, plain, lead)
        new = [p for p in new if p not in known]
        tails = {p: at if (at := len(p.rstrip(MARKS))) < len(p) and p[0] != "\n" else 0 for p in new}
        stems = {p[:at] if at and p[at - 1].isalpha() else p for p, at in tails.items()}
        self._learn(known, [p for p in stems if p not in known], lead)
        self._learn(self.bare, [t for t in {p[at:] for p, at in tails.items() if at} if t not in self.bare], "")
        for p in [p for p in new if p not in known]:
            known[p] = known[p[: tails[p]]] + self.bare[p[tails[p] :]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes | None] = [b""] * len(texts)
        open_, heads, words, plain = [], set(), set(), []
        for known in (self.first, self.later):
            if len(known) > CACHE:
                known.clear()
        first, later = self.first, self.later
        for k, text in enumerate(texts):
            if not text:
                continue
            if self.marks.search(text):
                out[k] = self._plain([text])[0]
                continue
            if not RUN.search(text):
                plain.append(k)
                continue
            head, *rest = self._cut(text)
            ids = [first.get(head), *map(later.get, rest)]
            try:
                out[k] = b"".join(ids)
            except TypeError:  # None: a cut that is not known yet
                open_.append((k, head, rest))
                if ids[0] is None:
                    heads.add(head)
                words.update(p for p, x in zip(rest, ids[1:], strict=True) if x is None)
        self._fill(first, heads, "")
        self._fill(later, words, " ")
        for k, head, rest in open_:
            out[k] = b"".join((first[head], *map(later.__getitem__, rest)))
        while plain:
            sizes = np.cumsum([len(texts[k]) for k in plain])
            n = max(1, int(np.searchsorted(sizes, AT_ONCE, "right")))
            now, plain = plain[:n], plain[n:]
            for k, ids in zip(now, self._together([texts[k] for k in now]), strict=True):
                out[k] = ids
        return out

    def _together(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without runs of white space: all are cut at once, and each different cut is looked up once."""
        first, later = self.first, self.later
        cuts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        at = cuts.offsets.to_numpy()
        lead = np.zeros(len(cuts.values), bool)
        lead[at[:-1]] = True
        heads = cuts.values.filter(pa.array(lead)).to_pylist()
        rest = cuts.values.filter(pa.array(~lead)).dictionary_encode()
        words, place = rest.dictionary.to_numpy(zero_copy_only=False).tolist(), rest.indices.to_numpy()
        self._fill(first, {p for p in heads if p not in first}, "")
        ids = list(map(later.get, words))
        self._fill(later, [p for p, x in zip(words, ids, strict=True) if x is None], " ")
        ids = [later[p] if x is None else x for p, x in zip(words, ids, strict=True)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        begin, n = np.cumsum(sizes) - sizes, sizes[place]
        ends = np.append(0, np.cumsum(n))
        pool = np.frombuffer(b"".join(ids), "<u2")
        from_ = np.repeat(begin[place] - ends[:-1], n)
        from_ += np.arange(ends[-1])
        flat = pool[from_].tobytes()
        bounds = (2 * ends[at - np.arange(len(at))]).tolist()
        return [first[head] + flat[a:b] for head, a, b in zip(heads, bounds[:-1], bounds[1:], strict=True)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which Spark uses again for its next tasks, cache and all."""
    return Encoder(path)
