"""Token ids by a public tokenizer file, with each word's ids kept so that a repeated word is encoded once."""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillmark.llm.common import kept, only

END_ID = 2
STRETCH = 4 << 20  # bytes of text that are cut into pieces at once
_ENCODERS: dict[str, "WordEncoder"] = kept({})

_BLANK = re.compile(rb"[\x20\x09-\x0d]")
BLANK, LETTER, POINT, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[list(b"\t\n\v\f\r ")] = BLANK
KINDS[list(string.ascii_letters.encode())] = LETTER
KINDS[list(string.punctuation.encode())] = POINT
KINDS[list(b"'<")] = OTHER  # contractions and the names of special tokens are not cut
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SECOND = np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)])  # behind 0xC3: a letter
WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

#: Lower-case, drop white space, cut into contractions, words, digits and runs of all else, write bytes as characters.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_SHOWN = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x]
AS_CHARACTERS = {x: x for x in _SHOWN} | {x: 256 + k for k, x in enumerate(x for x in range(256) if x not in _SHOWN)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stretches(text: bytes, limit: int) -> Iterator[bytes]:
    """The text in parts of about ``limit`` bytes, cut at white space."""
    at = 0
    while at < len(text):
        stop = _BLANK.search(text, at + limit)
        to = stop.start() if stop else len(text)
        yield text[at:to]
        at = to


class WordEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)`` for tokenizers that drop white space.

    Such a tokenizer never joins across ASCII white space, so a text's ids are those of its chunks in turn. For tokenizers
    that normalise and split as ``NORMALIZER`` and ``PRE_TOKENIZER`` say, a chunk of ASCII and Latin-1 letters and ASCII
    punctuation is cut further, into lower-case words and runs of punctuation; words go straight to the model. All other
    chunks go to the library whole. Every different piece of a stretch of texts is looked up once. Of the pieces kept,
    those not seen for the longest go first: ``most`` in two halves, of which the older is dropped when the newer is full.
    """

    def __init__(self, path: str, most: int = 400_000, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        named = [x["content"] for x in made.get("added_tokens") or []]
        self.cuts = made.get("normalizer") == NORMALIZER and made.get("pre_tokenizer") == PRE_TOKENIZER and made["model"].get("type") == "BPE" and all("<" in x for x in named)
        self.cuts = self.cuts and not any(made.get(x) for x in ("truncation", "padding", "post_processor")) and not made["model"].get("dropout")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.most, self.longest = most, longest

    def alone(self, chunk: str) -> bytes:
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that are not kept."""
        out, words, ids, ends = [b""] * len(pieces), [], [], []
        for k, c in enumerate(pieces):
            if self.cuts and WORD.fullmatch(c):
                ids += [t.id for t in self.model.tokenize(c.decode() if c.isascii() else c.decode("latin-1").translate(AS_CHARACTERS))]
                words.append(k)
                ends.append(4 * len(ids))
            else:
                out[k] = self.alone(c.decode("utf-8", "replace"))
        raw, at = np.array(ids, "<u4").tobytes(), 0
        for k, to in zip(words, ends):
            out[k] = raw[at:to]
            at = to
        return out

    def found(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces; long ones are not kept."""
        known, older = self.known, self.older
        out = list(map(known.get, pieces))
        missed = [k for k, x in enumerate(out) if x is None]
        for k in missed:
            out[k] = older.get(pieces[k])
        unseen = [k for k in missed if out[k] is None]
        for k, x in zip(unseen, self.learn([pieces[k] for k in unseen])):
            out[k] = x
        known.update((pieces[k], out[k]) for k in missed if len(pieces[k]) <= self.longest)
        if 2 * len(known) > self.most:
            self.known, self.older = {}, known
        return out

    def pieces(self, data: bytes) -> tuple[np.ndarray, pa.LargeBinaryArray]:
        """Where the pieces of the data start, and the pieces."""
        raw = np.frombuffer(data, np.uint8)
        kinds, text = KINDS[raw], LOWER[raw]
        if not self.cuts:
            kinds[kinds != BLANK], text = OTHER, raw.copy()
        else:
            two = np.flatnonzero(raw[:-1] == 0xC3)
            two = two[SECOND[raw[two + 1]]]
            kinds[two] = kinds[two + 1] = LETTER
            text[two[raw[two + 1] < 0x9F] + 1] += 32
        runs = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(kinds[1:] != kinds[:-1]) + 1]) if len(raw) else np.zeros(0, np.int64)
        kind, lengths = kinds[runs], np.diff(runs, append=len(raw))
        blank = kind == BLANK
        first = np.concatenate([np.ones(1, bool), blank[:-1]]) if len(runs) else blank
        starts = ~blank
        if (kind == OTHER).any():
            chunk = np.cumsum(blank)
            whole = np.zeros(len(runs) + 1, bool)
            whole[chunk[kind == OTHER]] = True
            whole = whole[chunk]
            starts &= first | ~whole
            np.copyto(text, raw, where=np.repeat(whole, lengths))
        blanks = np.cumsum(np.where(blank, lengths, 0))
        text = text[kinds != BLANK]
        offsets = np.append((runs - blanks)[starts], len(text))
        return runs[starts], pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(text)])

    def _encode(self, documents: list[bytes], end: bytes) -> list[bytes]:
        starts, pieces = self.pieces(b"\n".join(documents))
        coded = pieces.dictionary_encode()
        ids = self.found(coded.dictionary.to_pylist())
        before = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in documents]))
        order = np.insert(coded.indices.to_numpy(), before, len(ids))
        made = pa.array([*ids, end], pa.large_binary()).take(pa.array(order))
        places = np.frombuffer(made.buffers()[1], np.int64)[before + np.arange(1, len(before) + 1)].tolist()
        data = memoryview(made.buffers()[2])
        return [bytes(data[a:b]) for a, b in zip([0, *places], places)]

    def encode(self, documents: list[bytes], end: bytes) -> list[bytes]:
        """Little-endian 32-bit ids of each document, with ``end`` behind."""
        out, some, held = [], [], 0
        for d in documents:
            if some and held + len(d) > STRETCH:
                out += self._encode(some, end)
                some, held = [], 0
            if len(d) > STRETCH:
                out.append(b"".join(x for s in stretches(d, STRETCH) for x in self._encode([s], b"")) + end)
            else:
                some.append(d)
                held += len(d)
        return out + self._encode(some, end) if some else out


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for the file; kept between tasks."""
    only(_ENCODERS)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
