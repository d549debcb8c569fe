"""Whole-text encoding by the tokenizers library, piece by piece.

A text is cut where no token can span and no rule of the tokenizer looks across; pieces recur, so a
worker keeps the ids of those it has met, in two generations, and the library encodes only new ones.
Arrow numbers the different pieces of a batch, so each is looked up once, and lays out their ids.
A new piece of plain letters, with or without ASCII punctuation after them, is one or two words of the
tokenizer's own pattern and goes straight to the library's model; all others go through the whole
library. Ids are little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Pieces in a generation; a worker keeps two, and what it meets again moves to the younger one. Encoders that keep no shown tokens hold twice as many.
KEPT = 300_000
#: Pieces that go through the whole library as one text.
JOINED = 4096
#: In byte-level tokenizers a piece may start at a single space between visible characters, and a line feed between these is a piece.
_SPLIT = re.compile(r"(?<=\S)(?= \S)")
_BESIDE = re.compile(r"\s[ \n]|[ \n]\s|\x00")
#: White space but the space and the line feed; the last of Unicode is U+3000.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: ASCII punctuation but the apostrophe, which starts contractions, and letters of Latin-1 in UTF-8, which no normalisation composes.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTER = rb"(?:[A-Za-z]|\xc2[\xaa\xb5\xba]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
_is_plain = re.compile(rb"\x00?%s+[%s]*" % (_LETTER, re.escape(_MARKS))).fullmatch


def _byte_letters() -> dict[int, str]:
    """The visible character for each byte, as byte-level tokenizers have it: other bytes are numbered from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: chr(b if b in shown else next(others)) for b in range(256)}


_LETTERS = _byte_letters() | {10: "\n"}
#: Ends a piece among others; no byte of UTF-8.
_END = b"\xff"


def _beside(text: str) -> bool:
    """Whether _BESIDE is found; plain searches tell for texts with no other white space."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\0" in text:
        return True
    return any(map(text.__contains__, _OTHER_SPACE)) and _BESIDE.search(text) is not None


class PieceEncoder:
    """Encodes whole texts exactly as tokenizer.encode(text, add_special_tokens=False) does.

    Two kinds of tokenizer.json are known: those that drop white space (words end in a mark), whose
    pieces are the words, and byte-level ones without a prefix space. Others are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        parts = before.get("pretokenizers", [before])
        words = made["model"].get("end_of_word_suffix") and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed"
        level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not made.get("normalizer")
        self.kind = "words" if words else "level" if level else "whole"
        self.joined = made.get("decoder") is None
        self.names = {i: w.encode() for w, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.four = {i: i.to_bytes(4, "little") for i in self.names}
        #: The model alone, on a word a line: for byte-level tokenizers whose tokens hold every byte as one letter.
        self.lines = None
        if self.kind == "level" and not self.joined and not (made["model"].get("continuing_subword_prefix") or made["model"].get("end_of_word_suffix")) and made["model"]["vocab"].keys() >= set(_byte_letters().values()):
            self.lines = Tokenizer(self.tokenizer.model)
            self.lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
            self.lengths = np.zeros(max(self.names) + 1, np.int64)
            self.lengths[list(self.names)] = [len(w.decode()) for w in self.names.values()]
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.between, self.between_id = special[0] if special else (None, None)
        self.marks: dict[bytes, bytes] = {}
        self.ids: dict[bytes, bytes] = {}
        self.shown: dict[bytes, bytes] = {}
        self.old: tuple[dict, dict] = {}, {}

    def pieces(self, text: str) -> list[bytes]:
        """Keys of the pieces of a text; those of byte-level pieces leave out the space that most start with, and mark the others by a zero byte."""
        if self.kind == "words":
            return text.encode().split()
        if self.kind == "level":
            if _beside(text):
                first, *rest = _SPLIT.split(text)
                return [b"\0" + first.encode(), *((p[1:] if p[1] != "\0" else "\0" + p).encode() for p in rest)]
            found = text.encode().replace(b"\n", b" \0\n \0").split(b" ")
            if found[0]:
                found[0] = b"\0" + found[0]
                return found
            return found[1:]
        return [text.encode()]

    def _ended(self, text: str) -> bytes:
        """The keys of the pieces of a text, each with _END after it."""
        if self.kind != "level" or not text or _beside(text):
            return b"".join([p + _END for p in self.pieces(text)])
        data = text.encode().replace(b"\n", b" \0\n \0")
        data = data[1:] if data[:1] == b" " else b"\0" + data
        return data.replace(b" ", _END) + _END

    def _piece(self, key: bytes) -> bytes:
        return key if self.kind != "level" else key[1:] if key[:1] == b"\0" else b" " + key

    def encode_batch(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids and shown tokens of each text, from the library itself."""
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [(np.array(e.ids, "<u4").tobytes(), b" ".join(map(self.names.__getitem__, e.ids)) if self.joined else b"") for e in found]

    def _tokenized(self, words: list[bytes]) -> Iterator[list[int]]:
        """Ids of words of the tokenizer's pattern (keys of plain letters, or marks alone), from the library's model."""
        data = b"\n".join(words)
        if self.kind == "words":
            data = data.decode().lower().encode()
        tokenize = self.tokenizer.model.tokenize
        return ([t.id for t in tokenize(w)] for w in data.decode("latin-1").translate(_LETTERS).split("\n")) if words else iter(())

    def _line_by_line(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids of words as _tokenized has them, from the library's model many at a time; told apart by the bytes that tokens and words have."""
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            ids = np.array(self.lines.encode_batch_fast([b"\n".join(some).decode("latin-1").translate(_LETTERS)], add_special_tokens=False)[0].ids, "<u4")
            reached, ends = np.concatenate([[0], np.cumsum(self.lengths[ids])]), np.cumsum(list(map(len, some)))
            n_ids = np.searchsorted(reached, ends, side="right") - 1
            if reached[-1] != ends[-1] or not np.array_equal(reached[n_ids], ends):
                raise ValueError("tokens do not end where words do")
            data, cuts = ids.tobytes(), (4 * n_ids).tolist()
            yield from (data[x:y] for x, y in zip([0, *cuts], cuts))

    def _learn_plain(self, keys: list[bytes]) -> None:
        """Ids of pieces of plain letters, with or without marks after them."""
        ids, shown, four, names = self.ids, self.shown, self.four, self.names
        cores = [k.rstrip(_MARKS) for k in keys]
        for whole, words in ((ids, {c for c in cores if c not in ids}), (self.marks, {k[len(c) :] for k, c in zip(keys, cores)}.difference(self.marks))):
            some = list(words)
            spaced = [w[1:] if w[:1] == b"\0" else b" " + w for w in some] if self.kind == "level" and whole is ids else some
            if self.lines:
                whole.update(zip(some, self._line_by_line(spaced)))
                continue
            for w, found in zip(some, self._tokenized(spaced)):
                whole[w] = b"".join([four[i] for i in found])
                if self.joined:
                    shown[w] = b" ".join([names[i] for i in found])
        for k, c in zip(keys, cores):
            if k != c:
                after = k[len(c) :]
                ids[k] = ids[c] + self.marks[after]
                if self.joined:
                    shown[k] = shown[c] + b" " + shown[after]

    def through_library(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece; pieces with a special token between them are one text, which the library cuts there first."""
        if self.between is None:
            return [ids for ids, _ in self.encode_batch(pieces)]
        apart = self.between.encode()
        alone, together = [p for p in pieces if apart in p], [p for p in pieces if apart not in p]
        out = dict(zip(alone, (ids for ids, _ in self.encode_batch(alone)))) if alone else {}
        for at in range(0, len(together), JOINED):
            some = together[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([apart.join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(ids == self.between_id)).tolist()
            data = ids.tobytes()
            out.update(zip(some, (data[x:y] for x, y in zip([0, *(e + 4 for e in ends)], [*ends, len(data)]))))
        return [out[p] for p in pieces]

    def learn(self, keys: Iterable[bytes]) -> None:
        """Puts the ids of all of these pieces into the younger generation."""
        ids, (old_ids, old_shown) = self.ids, self.old
        absent = set(keys).difference(ids)
        new = absent.difference(old_ids)  # looks up the set's keys; an intersection with a dict would go through the whole dict
        for key in absent - new:
            ids[key] = old_ids[key]
            if self.joined:
                self.shown[key] = old_shown[key]
        plain = [k for k in new if k.isalpha() or _is_plain(k) and (k[0] or self.kind == "level")] if self.kind != "whole" else []
        self._learn_plain(plain)
        others = list(new.difference(plain))
        for key, found in zip(others, self.through_library([self._piece(k) for k in others])):
            ids[key] = found
            if self.joined:
                self.shown[key] = self.decode(found)

    def turn(self) -> None:
        """Before a batch: a full generation becomes the old one."""
        if len(self.ids) > (KEPT if self.joined else 2 * KEPT):
            self.old, self.ids, self.shown, self.marks = (self.ids, self.shown), {}, {}, {}

    def _known(self, texts: list[str]) -> list[list[bytes]]:
        self.turn()
        cut = [self.pieces(t) for t in texts]
        self.learn(chain.from_iterable(cut))
        return cut

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        self.turn()
        ended = [self._ended(t) for t in texts]
        data = b"".join(ended)
        if not data:
            return [b""] * len(texts)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == _END[0]) + 1
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        keys = [k[:-1] for k in found.dictionary.to_numpy(zero_copy_only=False)]
        self.learn(keys)
        laid = pa.array([self.ids[k] for k in keys], pa.large_binary()).take(found.indices)
        _, places, ids = laid.buffers()
        ids = ids.to_pybytes() if ids else b""
        last = np.searchsorted(ends, np.cumsum(list(map(len, ended))), side="right")
        cuts = np.frombuffer(places, np.int64)[last].tolist()
        return [ids[x:y] for x, y in zip([0, *cuts], cuts)]

    def encode_and_show(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of each text, and decode(ids, skip_special_tokens=False) as UTF-8."""
        if not self.joined:
            return [(i, self.decode(i)) for i in self.encode(texts)]
        cut = self._known(texts)
        return [(b"".join(map(self.ids.__getitem__, c)), b" ".join(filter(None, map(self.shown.__getitem__, c)))) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        """decode(ids, skip_special_tokens=False) as UTF-8; without a decoder, the tokens joined by spaces."""
        numbers = memoryview(ids).cast("I").tolist()
        return b" ".join([self.names[i] for i in numbers]) if self.joined else self.tokenizer.decode(numbers, skip_special_tokens=False).encode()


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process, which Spark uses for many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
