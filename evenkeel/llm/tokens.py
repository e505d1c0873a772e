"""Token ids of whole texts by the tokenizers library, with a bounded memory of pieces.

The library is asked once for each new piece of text; a text is cut into pieces before
spaces, where a cut cannot change its ids:

* byte-level files: no token crosses a place between a character that is not white space
  and a space, and the pre-split pattern looks ahead only inside white space. A cut is also
  safe before a single space that a word follows.
* word files drop white space, and neither their normal form nor their lower case depends
  on what lies over a space.

Texts with spaces next to other white space or to characters of unknown kind are cut only at
safe spaces, and texts that hold a special token go to the library whole.

Arrow cuts the texts of a batch, numbers the pieces that differ, and puts the ids of all pieces
in their places; only pieces that differ are looked up, and only new ones visit the library.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces remembered in each of two generations.
REMEMBERED = 450_000
#: Pieces longer than this are not remembered.
LONG = 200

# Fixed characters: printable ASCII and word characters are never white space.
_PLAIN = re.compile(r"[\x21-\x7e\w](?:.*[\x21-\x7e\w])?", re.DOTALL)
# Pieces of Latin letters, common signs and line breaks: their pre-split words can be told here.
LETTERS, SIGN = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[.,!?;:#$%&*|()\-]"
_SIGNS = f"{SIGN}+"
KNOWN = re.compile(f"(?:{LETTERS}(?:{_SIGNS})?|{_SIGNS})(?:\n(?:{LETTERS}(?:{_SIGNS})?|{_SIGNS}))*")
PARTS = re.compile(f"{LETTERS}|{_SIGNS}|\n")
_WORD = re.compile(f"({LETTERS})({_SIGNS})?")
_SAFE = re.compile(r"(?<=[\x21-\x7e\w])(?= )|(?<! )(?= [\x21-\x7e\w])")


# Fixed character: a space in byte-level vocabularies.
SPACE = "\u0120"


class PieceMemory:
    """Results by piece, in two generations: when the young one is full, the old one goes."""

    def __init__(self, limit: int = REMEMBERED):
        self.limit, self.young, self.old = limit, {}, {}

    def fetch(self, pieces: Iterable[str], make) -> dict:
        """A mapping that holds every piece; ``make`` gives the results of a list of new pieces."""
        wanted = set(pieces)
        missing = wanted.difference(self.young)
        if missing:
            if len(self.young) > self.limit:
                self.old, self.young = self.young, {}
                missing = wanted
            known = missing.intersection(self.old)
            for piece in known:
                self.young[piece] = self.old[piece]
            new = list(missing.difference(known))
            self.young.update(zip(new, make(new)))
        return self.young

    def results(self, pieces: list[str], make) -> list:
        """The result of each piece, in order. For pieces that differ; a result of None is made anew each time."""
        found = list(map(self.young.get, pieces))
        lacking = [i for i, x in enumerate(found) if x is None]
        if lacking:
            if len(self.young) > self.limit:
                self.old, self.young = self.young, {}
            asked = [pieces[i] for i in lacking]
            held = list(map(self.old.get, asked))
            new = [i for i, x in enumerate(held) if x is None]
            for i, x in zip(new, make([asked[i] for i in new])):
                held[i] = x
            self.young.update(zip(asked, held))
            for i, x in zip(lacking, held):
                found[i] = x
        return found


def lowered(text: str) -> str:
    """Lower case for files that make it anyway, so that fewer pieces are new.

    Such files also make line breaks spaces, so a text may be cut there in the same way.

    Only for texts of Latin-1 characters, where it is the same for each character alone and
    changes nothing about the normal form.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def is_word_file(told: dict) -> bool:
    """Whether a file makes words lower case, splits them by kind and drops white space."""
    steps = (told["normalizer"] or {}).get("normalizers", [])
    splits = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    return ([x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"]
            and splits[0]["behavior"] == "Removed")


class TextEncoder:
    """Ids of texts as the library's ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = "ByteLevel" in type(self.tokenizer.pre_tokenizer).__name__
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        #: Ids are kept as two bytes where they fit.
        self.kind, self.code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        # A new piece of known words is cheap to put together, so fewer are kept than words cost to find.
        self.memory = PieceMemory(REMEMBERED * 5 // 9)
        #: Words of letters that no space precedes, where that makes a difference.
        self.bare = PieceMemory(REMEMBERED // 16)
        self.loose = PieceMemory(REMEMBERED // 4)
        self.model, self.signs = self.tokenizer.model, {}
        self.lower = not self.spaced
        told = json.loads(self.tokenizer.to_str())
        #: Whether the file's rules are those that ``_told`` follows.
        self.plain = told["normalizer"] is None and self.spaced or is_word_file(told)
        #: Special tokens that a piece of known kind can hold.
        self.inside = [s for s in self.special if not PARTS.sub("", s)]

    def _ids(self, word: str, spaced: bool) -> bytes:
        """Ids of one pre-split word by the library's model."""
        text = word if self.spaced else word.lower()
        if not word.isascii():
            text = text.encode().decode("latin-1").translate(shown_bytes())
        elif word == "\n":
            text = shown_bytes()[10]
        return array.array(self.code, [t.id for t in self.model.tokenize(SPACE + text if spaced else text)]).tobytes()

    def _unspaced(self, words: list[str]) -> list[bytes]:
        return [self._ids(word, False) for word in words]

    def _part(self, word: str, spaced: bool) -> bytes:
        """Ids of one pre-split word, remembered."""
        if not word.isalpha():
            found = self.signs.get((word, spaced))
            if found is None:
                found = self._ids(word, spaced)
                if len(self.signs) < 10_000:
                    self.signs[(word, spaced)] = found
            return found
        if self.spaced and not spaced:
            return self.bare.young.get(word) or self.bare.results([word], self._unspaced)[0]
        # A word of letters is a piece as well.
        found = self.memory.young.get(word) or self.memory.old.get(word)
        if found is None:
            found = self.memory.young[word] = self._ids(word, spaced)
        return found

    def _told(self, piece: str) -> bytes:
        """Ids of a piece of known kind: letters, signs and line breaks are words of their own."""
        first = piece[:1] == " "
        if piece.isalpha():
            return self._part(piece, self.spaced)
        parts = PARTS.findall(piece)
        if not self.spaced:
            return b"".join([self._part(w, False) for w in parts if w != "\n"])
        return b"".join([self._part(w, i == 0 and not first) for i, w in enumerate(parts)])

    def _ask(self, texts: list[str]) -> list[bytes]:
        ids = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array(self.code, e.ids).tobytes() for e in ids]

    def _make(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of pieces between single spaces; None for those that must not be cut off there.

        A key that begins with a space stands for the text behind it at the start of a document.
        """
        out, asked, simple = [], [], self.plain and not self.inside
        for i, piece in enumerate(pieces):
            word = _WORD.fullmatch(piece) if simple and len(piece) <= LONG else None
            if word:  # most pieces; not the first one of a text
                letters, signs = word.groups()
                found = self._part(letters, self.spaced)
                out.append(found + self._part(signs, False) if signs else found)
                continue
            bare, found = piece[1:] if piece[:1] == " " else piece, None
            if len(bare) <= LONG:
                if self.plain and KNOWN.fullmatch(bare) and not any([s in bare for s in self.inside]):
                    found = self._told(piece)
                elif _PLAIN.fullmatch(bare) and not any([s in bare for s in self.special]):
                    asked.append(i)
            out.append(found)
        texts = [p[1:] if p[:1] == " " else " " + p if self.spaced else p for p in map(pieces.__getitem__, asked)]
        for i, ids in zip(asked, self._ask(texts) if texts else ()):
            out[i] = ids
        return out

    def _slow(self, text: str) -> bytes:
        """A text with odd spaces, very long pieces or special tokens: cut at safe spaces, if at all."""
        if any(s in text for s in self.special):
            return self._ask([text])[0]
        pieces = _SAFE.split(text)
        known = self.loose.fetch([p for p in pieces if len(p) <= LONG], self._ask)
        return b"".join([known[p] if len(p) <= LONG else self._ask([p])[0] for p in pieces])

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned integers."""
        if self.lower and self.plain:
            texts = [t if any(s in t for s in self.special) else lowered(t).replace("\n", " ") for t in texts]
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        starts, told = split.offsets.to_numpy(), split.values.dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(told.dictionary)], told.dictionary), pa.scalar(" ", pa.large_string()))
        pieces, codes = joined[0].as_py().split(" "), told.indices.to_numpy().copy()
        # The first piece of a text has a key of its own.
        first, n = [" " + pieces[c] for c in codes[starts[:-1]].tolist()], len(pieces)
        codes[starts[:-1]] = np.arange(n, n + len(texts))
        found = self.memory.results(pieces + first, self._make)
        for i, text in enumerate(texts):
            if not text:
                found[n + i] = b""
        placed = pa.array(found, pa.large_binary()).take(pa.array(codes))
        _, ends, held = placed.buffers()
        bounds = np.frombuffer(ends, np.int64)[starts] // self.kind.itemsize
        ids = np.frombuffer(held or b"", self.kind, bounds[-1])
        out = [ids[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
        if placed.null_count:  # pieces that must not be cut off
            lacking = np.flatnonzero(placed.is_null().to_numpy(zero_copy_only=False))
            for i in np.unique(np.searchsorted(starts, lacking, "right") - 1).tolist():
                out[i] = np.frombuffer(self._slow(texts[i]), self.kind)
        return out


@functools.lru_cache(maxsize=1)
def shown_bytes() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process and file."""
    return TextEncoder(path)


def groups(texts: list[str | None], most: int = 1 << 20):
    """Cut a list of texts into runs of about ``most`` characters: (first row, texts)."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        run.append(text or "")
        size += len(run[-1])
        if size >= most:
            yield first, run
            first, run, size = i + 1, [], 0
    if run:
        yield first, run
