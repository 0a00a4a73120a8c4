"""Token ids of whole texts from the `tokenizers` library, encoding each distinct piece of text once.

A text is cut only where the tokenizer itself always cuts (around white space), so joining the ids of the pieces gives the
ids of the text. Texts in which such a cut could differ (runs of white space, special strings) go to the library whole.
The piece cache is per worker process and emptied when it reaches `MAX_PIECES`; that bounds memory and changes no result.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from .common import WHITE_SPACE, trim

MAX_PIECES = 1_200_000
AT_ONCE = 256  # pieces encoded in one text; the tokenizer is slower a piece on longer ones
MARKS = frozenset(",.;:!?")
MARKS_RAW = frozenset(c.encode() for c in MARKS)
#: a tokenizer of words: composes, lower-cases and drops white space alone, then parts letters, digits and marks
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
COMPOSED = 0xCC  # bytes of UTF-8 below are of characters before U+0300, which composing leaves as they are
ODD = ["  ", " \n", "\n ", "\n\n", "\x00", *[c for c in WHITE_SPACE if c not in " \n"]]


class Encoder:
    """ids(texts) -> for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        #: the tokenizer drops white space, so that every stretch without it stands alone
        self.drops = not self.tool.encode(" \n", add_special_tokens=False).ids
        #: bytes of text behind each id, where every byte is one character of a token and a blank before a word parts tokens
        self.lengths: np.ndarray | None = None
        made = json.loads(self.tool.to_str())
        before = made["pre_tokenizer"] or {}
        if made["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
            words = self.tool.get_vocab(with_added_tokens=True)
            self.lengths = np.zeros(max(words.values()) + 1, np.int64)
            self.lengths[list(words.values())] = [len(w) for w in words]
        elif self.drops and self.parts_words(made):
            words, tail = self.tool.get_vocab(with_added_tokens=True), made["model"].get("end_of_word_suffix") or ""
            self.lengths = np.zeros(max(words.values()) + 1, np.int64)
            self.lengths[list(words.values())] = [len(w.removesuffix(tail)) for w in words]
            plain = {**made, "normalizer": None, "pre_tokenizer": {
                "type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, before["pretokenizers"][1]]}}
            #: the same model for lower-cased words of letters, which no step before it changes or cuts
            self.letters = Tokenizer.from_str(json.dumps(plain))
        self.cache: dict[str | bytes, bytes] = {}
        self.limit = MAX_PIECES

    @staticmethod
    def parts_words(made: dict) -> bool:
        """Whether words are lower-cased and encoded byte by byte, so that the lengths of tokens tell how far ids reach."""
        normal, before = made["normalizer"] or {}, made["pre_tokenizer"] or {}
        steps, cuts = normal.get("normalizers") or [], before.get("pretokenizers") or []
        return ([n["type"] for n in steps] == WORD_NORMALIZERS and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
                and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": WORD_SPLIT}
                and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
                and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
                and made["model"]["type"] == "BPE" and not made["model"].get("continuing_subword_prefix"))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes()
                for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def each(self, pieces: list[str]) -> list[bytes]:
        """Ids of many short pieces: a special string between two pieces parts them in the tokenizer itself."""
        mark = self.special[-1]
        sign = self.tool.token_to_id(mark)
        out: list[bytes] = []
        for at in range(0, len(pieces), AT_ONCE):
            some = pieces[at:at + AT_ONCE]
            ids = np.array(self.tool.encode_batch_fast([mark.join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == sign)
            data = ids.tobytes()
            begin, end = [0, *(4 * cut + 4).tolist()], [*(4 * cut).tolist(), len(data)]
            out += [data[a:b] for a, b in zip(begin, end, strict=True)]
        return out

    def parted(self, tool, text: str, ends: np.ndarray) -> list[bytes] | None:
        """Ids of the pieces of a text that end behind so many bytes, or None if no ids end there."""
        ids = np.array(tool.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        upto = np.cumsum(self.lengths[ids])
        cut = np.minimum(np.searchsorted(upto, ends), len(ids) - 1)
        if not len(ids) or upto[-1] != ends[-1] or not np.array_equal(upto[cut], ends):
            return None
        data, cut = ids.tobytes(), (4 * cut + 4).tolist()
        return [data[a:b] for a, b in zip([0, *cut], cut, strict=False)]

    def in_line(self, pieces: list[str]) -> list[bytes]:
        """Ids of many pieces that begin with a blank and hold no other white space: as they stand in a text, one behind the
        other, they are encoded without marks. Bytes behind the ids show where a piece ends."""
        out: list[bytes] = []
        for at in range(0, len(pieces), AT_ONCE):
            some = pieces[at:at + AT_ONCE]
            text = "".join(some)
            ends = np.cumsum(np.fromiter(map(len, some) if text.isascii() else (len(p.encode()) for p in some), np.int64, len(some)))
            found = self.parted(self.tool, text, ends)
            out += self.each(some) if found is None else found
        return out

    def words(self, pieces: list[bytes], tool) -> list[bytes]:
        """Ids of many words of composed characters, encoded with blanks between them, which the tokenizer drops."""
        out: list[bytes] = []
        for at in range(0, len(pieces), AT_ONCE):
            some = pieces[at:at + AT_ONCE]
            text = b" ".join(some).decode().lower()
            raw = np.frombuffer(text.encode(), np.uint8)
            ends = np.append(np.flatnonzero(raw == 32), len(raw)) - np.arange(len(some))
            found = self.parted(tool, text, ends)
            out += self.each([p.decode() for p in some]) if found is None else found
        return out

    def pieces(self, text: str) -> list | None:
        if any(s in text for s in self.special):
            return None
        if self.drops:
            return text.encode().split()  # ASCII white space
        if any(x in text for x in ODD):
            return None
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")

    def learn(self, new: set) -> None:
        """Encode pieces; the tokenizer parts a letter from a mark behind it, so a word with one last mark is two pieces."""
        marks = MARKS_RAW if self.drops else MARKS
        joined = {p for p in new if p[-1:] in marks and p[-2:-1].isalpha()}
        fresh = list((new - joined | {p[:-1] for p in joined} | {p[-1:] for p in joined}).difference(self.cache))
        if self.lengths is not None and self.drops:
            letters = [p for p in fresh if p.isalpha()
                       or (not p.isascii() and max(p) < COMPOSED and p.decode().lower().isalpha())]
            self.cache.update(zip(letters, self.words(letters, self.letters), strict=True))
            line = [p for p in fresh if p not in self.cache and (p.isascii() or max(p) < COMPOSED)]
            self.cache.update(zip(line, self.words(line, self.tool), strict=True))
            fresh = [p for p in fresh if p not in self.cache]
        elif self.lengths is not None:
            line = [p for p in fresh if p[:1] == " " and len(p) > 1]
            self.cache.update(zip(line, self.in_line(line), strict=True))
            fresh = [p for p in fresh if p[:1] != " " or len(p) == 1]
        plain = [x.decode() for x in fresh] if self.drops else fresh
        self.cache.update(zip(fresh, self.each(plain), strict=True))
        for p in joined:
            self.cache[p] = self.cache[p[:-1]] + self.cache[p[-1:]]

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 256):
            some = texts[at:at + 256]
            cut = [self.pieces(t) for t in some]
            if len(self.cache) > self.limit:
                self.cache.clear()
            new = set().union(*[c for c in cut if c is not None]).difference(self.cache)
            if new:
                self.learn(new)
            get = self.cache.__getitem__
            whole = iter(self.whole([t for t, c in zip(some, cut, strict=True) if c is None]))
            out += [next(whole) if c is None else b"".join(map(get, c)) for c in cut]
        return out


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def release() -> None:
    """Give back the pieces a worker has kept and memory that other work has freed; called where work without them begins."""
    encoder.cache_clear()
    trim()



