"""BPE encoding and decoding by dynamic programming over the prefixes of each word.

For every prefix of a word exactly one token can be the last of its BPE encoding:
the longest vocabulary token that ends the prefix and is *compatible* with the
last token of the prefix before it (two tokens are compatible when merging their
joined text yields the same two tokens again).  A suffix-matching automaton lists
the tokens that end at each place; the compatibility test undoes merges on both
sides of the boundary until one would have been applied across it.  Following the
stored last tokens back from the end gives the exact ids.

Defined results: a null text is the empty text (no ids, empty decoded text); white
space only gives no ids; ties cannot arise (the last token is unique); rows are
treated one by one, so repeated rows repeat; a text's words are encoded one after the
other, and the results of one text are held together.  Other columns of the input are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text, tidy

#: White space in the sense of Unicode's White_Space property.
_WS = r"\t-\r \x85\xa0  -     　"
_SPACES = regex.compile(rf"[{_WS}]+")
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+")
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
_END = "\U0010ffff"  # stands for the word-end suffix; no byte maps to it


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte that byte-level BPE uses: printable Latin-1 is itself, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A tokenizer file of kind BPE with a word-end suffix: NFC, white space, lower case, then words."""

    def __init__(self, path: str, cache_words: int = 1 << 17):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.name = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        letters = _byte_letters()
        self.letter = {b: c for b, c in enumerate(letters)}
        vocab = {self._inner(t): i for t, i in model["vocab"].items()}
        # Rank orders tokens by the merge that makes them; single symbols come first.
        self.rank: dict[str, int] = {}
        self.parts: list[tuple[int, int] | None] = []
        self.ids: list[int] = []
        for t, i in vocab.items():
            if len(t.removesuffix(_END)) == 1:
                self._add(t, i, None)
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            a, b = self._inner(a), self._inner(b)
            if a in self.rank and b in self.rank:
                pair = (self.rank[a], self.rank[b])
                if a + b not in self.rank:
                    self._add(a + b, vocab[a + b], pair)
                self.merged.setdefault(pair, self.rank[a + b])
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, r in self.rank.items():
            self.matches.add_word(t, r)
        self.matches.make_automaton()
        self.sizes = [len(t.removesuffix(_END)) for t in self.rank]
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.whole: dict[str, tuple[int, str, str]] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.cache_words = cache_words

    def _inner(self, token: str) -> str:
        return token.removesuffix(self.suffix) + _END if self.suffix and token.endswith(self.suffix) and token != self.suffix else token

    def _add(self, token: str, i: int, parts: tuple[int, int] | None) -> None:
        self.rank[token] = len(self.parts)
        self.parts.append(parts)
        self.ids.append(i)

    def _fits(self, a: int, b: int) -> bool:
        """Whether BPE on the joined text of a and b keeps this boundary: undo the later merge next to it, again and again."""
        bound = len(self.parts)  # merges of this rank or later came after what was undone
        merged, parts = self.merged, self.parts
        while True:
            if merged.get((a, b), bound) < bound:
                return False
            pa_, pb = parts[a], parts[b]
            if pa_ is not None and (pb is None or a > b):
                bound, a = a, pa_[1]
            elif pb is not None:
                # at equal rank the left merge is made first
                bound, b = b + 1, pb[0]
            else:
                return True

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word, given in byte letters."""
        n = len(word)
        last = [-1] * (n + 1)
        sizes, compatible = self.sizes, self.compatible
        # The automaton tells, end by end and longest first, which tokens end there.  The
        # place after the last letter belongs to tokens with the word-end suffix alone.
        for e, r in self.matches.iter(word + _END):
            i = e + 1
            if i >= n:
                if e != n:
                    continue
                i = n
            if last[i] >= 0:
                continue
            j = i - sizes[r]
            if j == 0:
                last[i] = r
                continue
            p = last[j]
            if p < 0:
                continue
            ok = compatible.get((p, r))
            if ok is None:
                if len(compatible) >= 1 << 18:
                    compatible.clear()
                ok = compatible[p, r] = self._fits(p, r)
            if ok:
                last[i] = r
        out, i = [], n
        while i:
            r = last[i]
            out.append(self.ids[r])
            i -= sizes[r]
        return out[::-1]

    def _piece(self, piece: str) -> tuple[int, str, str]:
        letter = self.letter
        ids = self.word_ids("".join([letter[b] for b in piece.encode("utf-8")]))
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens joined by a space."""
        return " ".join([self.name[i] for i in ids])

    def normal(self, text: str) -> str:
        """NFC and lower case, each character by itself (no final sigma); white space only separates words."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def _run(self, run: str) -> tuple[int, str, str]:
        """One run of characters without white space: its words' results, joined."""
        cache, parts = self.cache, []
        for piece in _PIECES.findall(run):
            found = cache.get(piece)
            if found is None:
                if len(cache) >= self.cache_words:
                    cache.clear()
                found = self._piece(piece)
                if len(piece) <= 64:
                    cache[piece] = found
            parts.append(found)
        out = sum([x[0] for x in parts]), " ".join([x[1] for x in parts]), " ".join([x[2] for x in parts])
        if len(self.whole) >= self.cache_words:
            self.whole.clear()
        if len(run) <= 64:
            self.whole[run] = out
        return out

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        """(number of ids, ids, decoded text) of each run of characters in turn."""
        out: list[tuple[int, str, str]] = []
        get, one = self.whole.get, self._run
        for k, part in enumerate(self.special.split(text) if "<|" in text and self.special else [text]):
            if k % 2:
                out.append((1, str(self.added[part]), part))
                continue
            part = self.normal(part)
            # str.split() also splits at U+001C..U+001F, which are no white space here
            runs = part.split() if not _SEPARATORS.search(part) else [x for x in _SPACES.split(part) if x]
            out += [get(x) or one(x) for x in runs]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for _, ids, _ in self.pieces(text) for x in ids.split()]


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def _digests(bpe: WordBpe, text: str) -> tuple[int, str, str]:
    found = bpe.pieces(text)
    ids, decoded = " ".join([x[1] for x in found]), " ".join([x[2] for x in found])
    return sum([x[0] for x in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The operator's general form: doc_id, ids array<int>, decoded string for every document."""

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            for k in range(batch.num_rows):
                found = bpe.pieces(batch.column(1)[k].as_py() or "")
                ids = np.array(" ".join([x[1] for x in found]).split(), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([ids], pa.list_(pa.int32())), pa.array([" ".join([x[2] for x in found])])], names=["doc_id", "ids", "decoded"])

    return id_text(docs, doc_id, text).mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document; no shuffle."""

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [_digests(bpe, x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs, doc_id, text).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
