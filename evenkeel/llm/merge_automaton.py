"""BPE by a deterministic automaton over tokens, compiled from the merges.

The automaton accepts exactly those token sequences that BPE makes. It starts as one state
that every base symbol loops on; each merge ``u v -> w``, in order, adds its gadget:

* ``w`` gets an arc from each state that ``u`` leaves, to where ``v`` goes at this time;
* the target of ``u`` becomes a copy of itself without the arc ``v``, so that ``u v`` can no
  longer be read in two steps.

All arcs of a token lead to one state, so a state is named by the token last read. Its missing
arcs are kept as ranges: if tokens are numbered along their left parts (a token, then those
that begin with it, the latest first), the removal of arc ``v`` at time ``k`` takes away ``v``
and all tokens that are built on it from time ``k`` on, which is one range. A state is the
ranges that it copied and those that its own gadgets added; a transition is a binary search.

A word is encoded by the one path of the automaton that spells it. The arcs that match at each
place of many words are found with a table of token prefixes, then places are settled from left
to right. Decoding emits the labels of the arcs.

Normal form and pre-split are the tokenizers library's own, asked once for each new piece. In word
files runs of Latin letters or of signs are words as they stand: the bytes of a batch are cut there,
Arrow numbers the pieces that differ, and only new ones visit the automaton.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from evenkeel.llm.shared import by_batch, documents, prepare
from evenkeel.llm.tokens import LETTERS, LONG, REMEMBERED, SIGN, PieceMemory, groups, is_word_file, lowered, shown_bytes

ROWS = "doc_id long, ids binary, decoded string"
_WIDE = 20  # bits for a token's number
_WORD = re.compile(f"{LETTERS}|{SIGN}+")


class MergeAutomaton:
    """Tables of the automaton of one vocabulary and its merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        made = {a + b: (a, b) for a, b in merges}
        if len(made) != len(merges):
            raise ValueError("two merges make one token")
        base = [t for t in vocab if t not in made]
        self.labels = base + [a + b for a, b in merges]
        number = {t: i for i, t in enumerate(self.labels)}
        self.ids = np.array([vocab[t] for t in self.labels], np.int64)
        n, first = len(self.labels), len(base)
        parts = [(number[a], number[b]) for a, b in merges]
        for k, (a, b) in enumerate(parts):
            if max(a, b) >= first + k:
                raise ValueError(f"merge {k} uses a token that a later merge makes")
        # Number tokens along their left parts, the latest first.
        children: list[list[int]] = [[] for _ in range(n)]
        for k, (a, _) in enumerate(parts):
            children[a].append(first + k)
        self.place, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = 0
        for root in range(first):
            stack = [(root, False)]
            while stack:
                token, done = stack.pop()
                if done:
                    last[token] = at
                    continue
                self.place[token] = at
                at += 1
                stack.append((token, True))
                stack.extend((c, False) for c in children[token])
        # The gadgets. Children were pushed in order of time, so the latest is numbered first.
        ranges: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        place, last = self.place.tolist(), last.tolist()
        opened: list[int] = [0] * n  # children made so far
        never = [False] * n  # tokens without an arc: an earlier merge always comes first
        for k, (u, v) in enumerate(parts):
            w = first + k
            if never[u] or never[v] or any(lo <= place[v] < hi for lo, hi in ranges[u]):
                never[w] = True
                opened[u] += 1
                continue
            ranges[w] = ranges[v].copy()
            later = children[v][opened[v]:]  # built on v from now on
            ranges[u].append((place[v], last[later[0]] if later else place[v] + 1))
            opened[u] += 1
        keys, ends = [], []
        for state, held in enumerate(ranges):
            held.sort()
            merged: list[list[int]] = []
            for lo, hi in held:
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            keys.extend(state << _WIDE | lo for lo, _ in merged)
            ends.extend(hi for _, hi in merged)
        self.keys, self.ends = np.array(keys, np.int64), np.array(ends, np.int64)
        self._prefixes(never)

    def _symbols(self, label: str) -> list[str]:
        if self.suffix and label.endswith(self.suffix) and len(label) > len(self.suffix):
            bare = label[:-len(self.suffix)]
            return [*bare[:-1], bare[-1] + self.suffix]
        return list(label)

    def _prefixes(self, never: list[bool]) -> None:
        """The table of token prefixes: (prefix, symbol) to a longer prefix, and its token."""
        spelled = [self._symbols(t) for t in self.labels]
        self.symbol: dict[str, int] = {}
        for symbols in spelled:
            for s in symbols:
                self.symbol.setdefault(s, len(self.symbol))
        nodes: dict[tuple[int, int], int] = {}
        token = [-1]
        for t, symbols in enumerate(spelled):
            node = 0
            for s in symbols:
                key = (node, self.symbol[s])
                if key not in nodes:
                    nodes[key] = len(token)
                    token.append(-1)
                node = nodes[key]
            token[node] = -1 if never[t] else t
        self.n_symbols = len(self.symbol) + 1
        step = np.array([(a * self.n_symbols + s, node) for (a, s), node in nodes.items()], np.int64).reshape(-1, 2)
        step = step[np.argsort(step[:, 0])]
        self.step_keys, self.step_to = step[:, 0].copy(), step[:, 1].copy()
        self.token = np.array(token, np.int64)
        # Symbols by character: inside a word, and at its end.
        top = max((ord(s[0]) for s in self.symbol), default=0)
        self.inside, self.at_end = np.full(top + 2, -1, np.int64), np.full(top + 2, -1, np.int64)
        for s, i in self.symbol.items():
            (self.inside if len(s) == 1 else self.at_end)[ord(s[0])] = i
        if not self.suffix:
            self.at_end = self.inside

    def allowed(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each state has an arc for each token; state -1 is the start, which has all."""
        places = self.place[tokens]
        at = np.searchsorted(self.keys, states << _WIDE | places, "right") - 1
        at0 = np.maximum(at, 0)
        hit = (at >= 0) & (self.keys[at0] >> _WIDE == states) & (places < self.ends[at0])
        return (states < 0) | ~hit

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Token numbers of pre-split words; a symbol outside the vocabulary is an error."""
        if not words:
            return []
        tokens, cuts = self.encode_flat(words)
        return np.split(tokens, cuts[1:-1])

    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for one word or more as one array, with the places where words begin and the end."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.concatenate([[0], np.cumsum(sizes)])
        shown = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        shown = np.minimum(shown, len(self.inside) - 1)  # the last place is for characters beyond the vocabulary's
        flat = self.inside[shown]
        flat[begin[1:] - 1] = self.at_end[shown[begin[1:] - 1]]
        if (flat < 0).any():
            raise KeyError("a symbol outside the vocabulary")
        stop = np.repeat(begin[1:], sizes)
        inner = np.arange(len(flat)) - np.repeat(begin[:-1], sizes)
        # All arcs that match: from each place, longer and longer prefixes.
        start = np.arange(len(flat))
        node, at = np.zeros(len(flat), np.int64), start
        arcs = []
        while len(start):
            keys = node * self.n_symbols + flat[at]
            found = np.minimum(np.searchsorted(self.step_keys, keys), len(self.step_keys) - 1)
            live = self.step_keys[found] == keys
            start, at, node = start[live], at[live], self.step_to[found[live]]
            tokens = self.token[node]
            hit = tokens >= 0
            arcs.append((start[hit], at[hit], tokens[hit]))
            at = at + 1
            live = at < stop[start]
            start, at, node = start[live], at[live], node[live]
        first, end, tokens = (np.concatenate(x) for x in zip(*arcs))
        order = np.argsort(inner[end].astype(np.min_scalar_type(sizes.max())), kind="stable")
        first, end, tokens = first[order], end[order], tokens[order]
        cuts = np.searchsorted(inner[end], np.arange(sizes.max() + 1))
        state = np.full(len(flat), -1, np.int64)  # the token that ends at each place
        origin = np.full(len(flat), -1, np.int64)
        for lo, hi in zip(cuts, [*cuts[1:], len(end)]):
            f, e, t = first[lo:hi], end[lo:hi], tokens[lo:hi]
            before = np.where(inner[f] > 0, state[np.maximum(f - 1, 0)], -1)
            good = self.allowed(before, t) & ((inner[f] == 0) | (before >= 0))
            state[e[good]], origin[e[good]] = t[good], f[good]
        # Walk back over all words at once.
        at, which, steps = begin[1:] - 1, np.arange(len(words)), []
        while len(at):
            steps.append((which, state[at]))
            back = origin[at] - 1
            live = back >= begin[which]
            at, which = back[live], which[live]
        owner = np.concatenate([w for w, _ in steps][::-1])
        taken = np.concatenate([t for _, t in steps][::-1])
        order = np.argsort(owner, kind="stable")
        return taken[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


class AutomatonTokenizer:
    """Whole texts to ids and back, as the library's file says, but by the automaton."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer, library.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest))})") if self.special else None
        self.bytes = told["decoder"] is not None and told["decoder"].get("type") == "ByteLevel"
        if told["decoder"] is not None and not self.bytes:
            raise ValueError("only byte-level decoders, or none")
        if not self.bytes and self.split is not None and told["pre_tokenizer"].get("type") == "ByteLevel":
            raise ValueError("spaces matter to this file, but its decoder drops them")
        self.plain = is_word_file(told)
        #: Tokens by piece, and by word of the pieces that the library splits.
        self.memory, self.words = PieceMemory(), PieceMemory(REMEMBERED // 4)
        # Special tokens are numbered behind the automaton's labels.
        labels = [*self.automaton.labels, *self.special]
        self.number = {s: len(self.automaton.labels) + i for i, s in enumerate(self.special)}
        self.ids = np.array([*self.automaton.ids, *self.special.values()], "<u4")
        self.spelled = pa.array([self._bytes(s) if self.bytes else s.encode() + b" " for s in labels], pa.large_binary())

    def _bytes(self, label: str) -> bytes:
        return label.encode() if label in self.special else bytes(byte_of()[c] for c in label)

    def _words(self, piece: str) -> list[str]:
        """The pre-split words of a piece, in the characters that stand for bytes."""
        text = self.normalize.normalize_str(piece) if self.normalize else piece
        return [w for w, _ in self.split.pre_tokenize_str(text)] if text else []

    def _encode(self, words: list[str]) -> list[bytes]:
        """The tokens of new words."""
        if not words:
            return []
        tokens, cuts = self.automaton.encode_flat(words)
        raw, cuts = tokens.astype("<u4").tobytes(), (4 * cuts).tolist()
        return [raw[a:b] for a, b in itertools.pairwise(cuts)]

    def _make(self, pieces: list[str]) -> list[bytes]:
        """The tokens of new pieces."""
        told = [self.plain and _WORD.fullmatch(p) is not None for p in pieces]
        words = [p.lower() for p in itertools.compress(pieces, told)]
        words = [w if w.isascii() else w.encode().decode("latin-1").translate(shown_bytes()) for w in words]
        split = [self._words(p) for p, x in zip(pieces, told) if not x]
        asked = list(dict.fromkeys(itertools.chain.from_iterable(split)))
        known = dict(zip(asked, self.words.results(asked, self._encode)))
        plain, others = iter(self._encode(words)), iter([b"".join([known[w] for w in x]) for x in split])
        return [next(plain) if x else next(others) for x in told]

    def _pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The texts cut into pieces, and the place of each text's first piece and the end.

        Word files: at spaces, and words of letters and of signs apart; byte files: not at all.
        """
        held = pa.array(texts, pa.large_string())
        if self.bytes:
            return held, np.arange(len(texts) + 1)
        if not self.plain:
            split = pc.split_pattern(held, " ")
            return split.values, split.offsets.to_numpy()
        _, offsets, data = held.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(texts) + 1)
        kind = byte_kinds()[np.frombuffer(data or b"", np.uint8, offsets[-1])]
        edge = np.ones(len(kind) + 1, bool)
        if (kind == _OTHER).any():  # other characters make a whole piece between spaces one for the library
            np.not_equal(kind[1:] == _SPACE, kind[:-1] == _SPACE, out=edge[1:-1])
            edge[offsets] = True
            begins = np.flatnonzero(edge)
            odd = np.maximum.reduceat(kind, begins[:-1]) == _OTHER
            kind[np.repeat(odd, np.diff(begins))] = _OTHER
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[offsets] = True
        begins = np.flatnonzero(edge)
        return pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), data), np.searchsorted(begins, offsets)

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of texts without special ones, and where each text begins and the end."""
        pieces, first = self._pieces(texts)
        told = pieces.dictionary_encode()
        new = told.dictionary.to_pylist()
        short = [p for p in new if len(p) <= LONG]
        found = self.memory.results(short, self._make)
        if len(short) < len(new):
            rest = iter(found)
            found = [next(rest) if len(p) <= LONG else self._make([p])[0] for p in new]
        placed = pa.array(found, pa.large_binary()).take(told.indices)
        _, ends, raw = placed.buffers()
        bounds = np.frombuffer(ends, np.int64, len(placed) + 1)[first] // 4
        return np.frombuffer(raw or b"", "<u4", bounds[-1]), bounds

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit numbers, and its decoded text.

        Texts are cut at spaces where the file drops white space, and always at special tokens.
        """
        if not texts:
            return []
        parts, special, first = [], [], [0]
        for text in texts:
            if self.cut is not None and any([s in text for s in self.special]):
                for i, part in enumerate(self.cut.split(text)):
                    special += [(len(parts), self.number[part])] if i % 2 else []
                    parts.append("" if i % 2 else part)
            else:
                parts.append(text)
            first.append(len(parts))
        tokens, bounds = self._tokens([lowered(p) for p in parts] if self.plain else parts)
        if special:
            at, numbers = np.array(special).T
            tokens = np.insert(tokens, bounds[at], numbers)
            bounds = bounds + np.searchsorted(at, np.arange(len(bounds)))
        bounds = bounds[first]
        spelled = self.spelled.take(pa.array(tokens))
        _, ends, data = spelled.buffers()
        ends = np.frombuffer(ends, np.int64, len(spelled) + 1)[bounds].tolist()
        ids, data, bounds = self.ids[tokens].tobytes(), memoryview(data or b""), (4 * bounds).tolist()
        out = []
        for a, b, c, d in zip(bounds, bounds[1:], ends, ends[1:]):
            text = str(data[c:d], "utf-8", "replace") if self.bytes else str(data[c:max(c, d - 1)], "utf-8")
            out.append((ids[a:b], text))
        return out


_SPACE, _LETTER, _SIGN, _OTHER = range(4)


@functools.lru_cache(maxsize=1)
def byte_kinds() -> np.ndarray:
    """Of each byte of UTF-8: space or line break, Latin letter (its second byte as well), sign, or other."""
    kinds = np.full(256, _OTHER, np.uint8)
    for code in range(256):
        if re.fullmatch(LETTERS, chr(code)):
            kinds[list(chr(code).encode())] = _LETTER
        elif re.fullmatch(SIGN, chr(code)):
            kinds[code] = _SIGN
    kinds[list(b" \n")] = _SPACE
    return kinds


@functools.lru_cache(maxsize=1)
def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level label stands for."""
    return {c: b for b, c in shown_bytes().items()}


@functools.lru_cache(maxsize=1)
def tokenizer(path: str) -> AutomatonTokenizer:
    """One compiled automaton for each worker process."""
    return AutomatonTokenizer(path)


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """Ids (binary, 4 bytes each) and decoded text of each document.

    Cases: null and empty texts give no ids and an empty text; repeated rows are encoded each;
    an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> list:
        found = [x for _, texts in groups(batch.column(1).to_pylist()) for x in tokenizer(path).encode(texts)]
        return [batch.column(0), pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.string())]

    return by_batch(documents(docs), work, ROWS)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The same, as counts and digests; the texts do not leave the worker."""
    prepare(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> list:
        found = [x for _, texts in groups(batch.column(1).to_pylist()) for x in tokenizer(path).encode(texts)]
        return [batch.column(0), pa.array([len(a) // 4 for a, _ in found], pa.int64()),
                pa.array([hashlib.sha256(a).hexdigest() for a, _ in found]),
                pa.array([hashlib.sha256(b.encode()).hexdigest() for _, b in found])]

    return by_batch(documents(docs), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
