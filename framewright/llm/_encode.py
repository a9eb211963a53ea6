"""Token ids of whole texts by the tokenizers library, with a cache of what stands between spaces.

Both vocabularies cut a text at spaces before anything else, so a text's ids are those of its parts, one after another. Texts
in which white space meets white space, where that isn't so, go to the library whole, and so do texts that hold the string of an added
token (such as ``<|endoftext|>``), which the library looks for first. The cache is used only if the file's normalizer and pre-tokenizer are
those that this holds for; with any other file all texts go to the library.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Parts kept, and words without their punctuation; some 200 bytes each. What comes later and isn't among them is encoded anew.
CACHE_PARTS, CACHE_WORDS = 100_000, 200_000
_TAIL = ".,;:!?"


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: the byte's own where that prints, else the next one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in own else next(spare)) for b in range(256)}


_LETTERS = _byte_letters()


def _packed(ids: Sequence[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


# The parts of the two kinds of file for which a text's ids are those of what stands between its spaces.
BYTE_LEVEL = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
WORD_ENDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, as ``encode(text, add_special_tokens=False)`` gives them.

    glue: a space belongs to the word after it (byte-level BPE); else white space is dropped. literal: the strings of added tokens are
    ordinary text, as they are with the library's ``encode_special_tokens``.
    """

    def __init__(self, path: str, glue: bool, literal: bool = False):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = literal
        parts = json.loads(self.library.to_str())
        self.added = [] if literal else [t["content"] for t in parts["added_tokens"]]
        self.known = {k: parts[k] for k in BYTE_LEVEL} == (BYTE_LEVEL if glue else WORD_ENDS)
        if not self.known:
            return
        self.glue = glue
        self.mark = "\n" if glue else " \x00 "
        # a part that stands first in its text has no space before it, so its cache differs
        self.spaced: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {} if glue else self.spaced
        self.line = _packed(self._ids("\n"))
        (self.mark_id,) = self._ids(self.mark)
        self.words: dict[str, bytes] = {}
        self.line_words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.spaced[""] = _packed(self._ids(" "))
        self.first[""] = b""

    @staticmethod
    def letters(text: str) -> str:
        return text.encode().decode("latin-1").translate(_LETTERS)

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, parts: list[str], lead: str) -> dict[str, bytes | None]:
        """The ids of parts; those without white space or the mark at one go, set apart by the mark. None: its text must go whole."""
        out: dict[str, bytes | None] = {}
        plain = []
        tails, tokenize, room = self.tails, self.library.model.tokenize, CACHE_WORDS - len(self.words) - len(self.line_words)
        space = self.letters(lead) if lead else ""
        for part in parts:
            line = self.glue and part[0] == "\n"
            body = part[1:] if line else part
            bare = body.rstrip(_TAIL)
            words = self.line_words if line else self.words
            found = words.get(bare)
            if found is None and bare.isalpha():
                # a word of Latin letters is one step of the model
                text = None
                if bare.isascii():
                    text = bare if self.glue else bare.lower()
                elif max(bare) < "\u0250" and "\u0130" not in bare:
                    text = self.letters(bare if self.glue else bare.lower())
                if text is not None:
                    found = array("I", [t.id for t in tokenize(text if line else space + text)]).tobytes()
                    if room > 0:
                        words[bare] = found
                        room -= 1
            if found is not None:
                if len(bare) < len(body):
                    tail = body[len(bare) :]
                    if tail not in tails:
                        tails[tail] = _packed(self._ids(tail))
                    found += tails[tail]
                out[part] = self.line + found if line else found
                continue
            body = body if line else lead + body
            own = part[1:] if line else part
            if self.glue and own and (own[0].isspace() or own[-1].isspace()):
                out[part] = None
            elif not body or "\x00" in body or any(c.isspace() for c in own):
                out[part] = (self.line if line else b"") + (_packed(self._ids(body)) if body else b"")
            else:
                plain.append((part, body, line))
        for k in range(0, len(plain), 20_000):
            some = plain[k : k + 20_000]
            ids = np.array(self._ids(self.mark.join(body for _, body, _ in some)), "<u4")
            at = np.flatnonzero(ids == self.mark_id)
            assert len(at) == len(some) - 1, "a part of a text has the id of the mark between parts"
            data, lo = ids.tobytes(), 0
            for (part, _, line), hi in zip(some, [*at.tolist(), len(ids)]):
                out[part] = (self.line if line else b"") + data[4 * lo : 4 * hi]
                lo = hi + 1
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, unsigned 32 bits; a null is empty.

        A batch is cut into parts and its distinct parts are found in Arrow, so that Python sees each of them but once.
        """
        texts = texts.fill_null("")
        n = len(texts)
        if not n:
            return []
        if not self.known:
            return [np.array(e.ids, "<u4") for e in self.library.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        given, whole = texts, np.zeros(n, bool)
        for content in self.added:
            whole |= np.asarray(pc.match_substring(texts, content))
        if whole.any():
            texts = pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts)
        if self.glue:
            whole |= np.asarray(pc.match_substring_regex(texts, "[ \\n][ \\n]"))
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        else:
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        bounds = np.asarray(cut.offsets).astype(np.int64)
        bounds -= bounds[0]
        flat = cut.flatten()
        coded = flat.dictionary_encode()
        code, parts = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        held: list[bytes | None] = list(map(self.spaced.get, parts))
        fresh = self._learn([p for p, x in zip(parts, held) if x is None and p], " " if self.glue else "")
        self._keep(self.spaced, fresh, CACHE_PARTS)
        held = [fresh.get(p) if x is None else x for p, x in zip(parts, held)]
        if self.glue:  # nothing stands before the first word
            heads = flat.take(pa.array(bounds[:-1])).to_numpy(zero_copy_only=False).tolist()
            own = {h for h in heads if h[:1] != "\n" and h not in self.first}
            made = {h: None if h[-1].isspace() else _packed(self._ids(h)) for h in own}
            for k, h in enumerate(heads):
                if h[:1] != "\n":
                    code[bounds[k]] = len(held)
                    held.append(made[h] if h in made else self.first[h])
            self._keep(self.first, made, CACHE_PARTS // 8)
        bad = np.array([x is None for x in held])
        if bad.any():
            whole |= np.add.reduceat(bad[code].astype(np.int64), bounds[:-1]) > 0
        size = np.array([len(x) // 4 if x else 0 for x in held], np.int64)
        ids = np.frombuffer(b"".join(x for x in held if x), "<u4")
        start = np.cumsum(size) - size
        count = size[code]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
        place = np.repeat(start[code] - ends[:-1], count)
        place += np.arange(ends[-1])
        ids = ids[place]
        out = [ids[x:y] for x, y in zip(ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist())]
        if whole.any():
            at = np.flatnonzero(whole).tolist()
            for k, e in zip(at, self.library.encode_batch(given.take(pa.array(at)).to_pylist(), add_special_tokens=False)):
                out[k] = np.array(e.ids, "<u4")
        return out

    @staticmethod
    def _keep(cache: dict[str, bytes], more: dict[str, bytes | None], most: int) -> None:
        if len(cache) < most:
            cache |= {p: x for p, x in more.items() if x is not None}


_OPEN: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, glue: bool) -> Encoder:
    """One encoder for each vocabulary in a worker."""
    if (path, glue) not in _OPEN:
        _OPEN[path, glue] = Encoder(path, glue)
    return _OPEN[path, glue]


def forget() -> None:
    """Drops the encoders of this worker and what they keep."""
    _OPEN.clear()
