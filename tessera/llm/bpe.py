"""Byte-pair encoding by speculation and verification.

A tokenizer file is read as data (vocabulary, merges, splitting pattern); all
encoding happens here. For each distinct pre-token:

1. speculate: the greedy longest match against the vocabulary proposes tokens;
2. verify: every adjacent pair of all proposals of a batch is tested at once
   with numpy (could a merge have crossed the boundary between the two?);
3. only words with a failing pair are merged exactly, lowest rank first.

A proposal whose tokens can be produced and whose adjacent pairs all pass is the
sequence that exact merging gives, so the result never depends on the guess.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Regex
from tokenizers.normalizers import Lowercase
from tokenizers.pre_tokenizers import Split

#: Replaces a model's end-of-word mark: one character, so that positions stay simple.
END = "\x00"
NEVER = 1 << 40
INF, NO_PAIR = np.int64(NEVER), (NEVER, -1)
#: White space as the splitting patterns of the tokenizer files see it (fixed values).
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Distinct words remembered by a worker, beyond which the memory starts afresh; longer words are forgotten after each slice.
CACHE_WORDS, CACHE_CHARS = 150_000, 64


def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins for the 256 byte values of byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


ALPHABET = byte_alphabet()


class Merges:
    """Vocabulary and merges of one byte-level BPE model."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        def own(token: str) -> str:
            return token[: -len(suffix)] + END if suffix and token.endswith(suffix) and token != suffix else token

        self.suffix = END if suffix else ""
        self.ids = {own(t): i for t, i in vocab.items()}
        self.longest = max(map(len, self.ids))
        n = max(vocab.values()) + 1
        self.rank, self.left, self.right = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges, 1):
            i, j, k = self.ids[own(a)], self.ids[own(b)], self.ids[own(a + b)]
            if (i, j) in self.pairs:
                continue
            self.pairs[i, j] = (r, k)
            if not self.rank[k]:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        keys = np.array([(a << 32) | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array([r for r, _ in self.pairs.values()], np.int64)[order]
        made = np.flatnonzero(self.left >= 0)
        #: Tokens that merging their own text gives back; others may not be proposed.
        self.sound = np.ones(n, bool)
        a, b = self.left[made], self.right[made]
        own_rank = self.rank[made]
        bad = (self.rank[a] >= own_rank) | (self.rank[b] >= own_rank) | ~self.compatible(a, b, own_rank)
        self.sound[made[bad]] = False
        for k in made[np.argsort(own_rank)]:
            self.sound[k] &= self.sound[self.left[k]] and self.sound[self.right[k]]
        self.table = str.maketrans({chr(b): c for b, c in ALPHABET.items()})

    def symbols(self, word: str) -> str:
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) + self.suffix

    def compatible(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair: no merge of a rank below `until` joins the end of x to the start of y.

        Goes back in time along the right edge of x and the left edge of y and
        asks, for every two pieces that existed together, whether their merge
        came before the merges that used them up. On a tie the left one is first.
        """
        ok = np.ones(len(x), bool)
        at = np.arange(len(x))
        c, d = x.copy(), y.copy()
        used_c = np.full(len(x), INF) if until is None else until.copy()
        used_d = used_c.copy()
        if until is not None:
            used_d -= 1  # the pair itself is the merge at `until`, and no fault
        while len(at):
            key = (c << 32) | d
            i = np.searchsorted(self.keys, key)
            i[i == len(self.keys)] = 0
            q = np.where(self.keys[i] == key, self.key_rank[i], INF)
            bad = (q < used_c) & (q <= used_d)
            ok[at[bad]] = False
            rc, rd = self.rank[c], self.rank[d]
            go = ~bad & ((rc > 0) | (rd > 0))
            at, c, d, used_c, used_d, rc, rd = (v[go] for v in (at, c, d, used_c, used_d, rc, rd))
            back = rc > rd
            used_c, c = np.where(back, rc, used_c), np.where(back, self.right[c], c)
            used_d, d = np.where(back, used_d, rd), np.where(back, d, self.left[d])
        return ok

    def speculate(self, s: str) -> list[int] | None:
        out, i, n, ids = [], 0, len(s), self.ids
        while i < n:
            j = min(n, i + self.longest)
            while j > i and s[i:j] not in ids:
                j -= 1
            if j == i:
                return None
            out.append(ids[s[i:j]])
            i = j
        return out

    def exact(self, s: str) -> list[int]:
        """Merge the lowest rank first, the leftmost on a tie; a heap keeps long words fast."""
        base = list(s[:-2]) + [s[-2:]] if self.suffix and len(s) > 1 else list(s)
        word = [self.ids[c] for c in base if c in self.ids]
        pairs = self.pairs
        if len(word) <= 40:
            get = pairs.get
            ranks = [get(p, NO_PAIR)[0] for p in zip(word, word[1:], strict=False)]
            while ranks and (best := min(ranks)) != NEVER:
                i = ranks.index(best)
                k = pairs[word[i], word[i + 1]][1]
                word[i : i + 2] = [k]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((word[i - 1], k), NO_PAIR)[0]
                if i < len(ranks):
                    ranks[i] = get((k, word[i + 1]), NO_PAIR)[0]
            return word
        n = len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*pairs[word[i], word[i + 1]], i, word[i], word[i + 1]) for i in range(n - 1) if (word[i], word[i + 1]) in pairs]
        heap = [(r, i, a, b, k) for r, k, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, k = heapq.heappop(heap)
            j = after[i]
            if word[i] != a or j >= n or word[j] != b:
                continue
            word[i], word[j], after[i] = k, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for u in (before[i], i):
                if u >= 0 and (v := after[u]) < n and (word[u], word[v]) in pairs:
                    r, m = pairs[word[u], word[v]]
                    heapq.heappush(heap, (r, u, word[u], word[v], m))
        return [t for t in word if t >= 0]

    def proposed(self, words: list[str]) -> tuple[list[str], list[list[int] | None], np.ndarray, np.ndarray]:
        """(symbols, proposed tokens, their numbers, whether the proposal fails) of each word."""
        text = [self.symbols(w) for w in words]
        out = [self.speculate(s) for s in text]
        sizes = np.fromiter((0 if o is None else len(o) for o in out), np.int64, len(out))
        flat = np.fromiter((t for o in out if o for t in o), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(out)), sizes)
        failed = np.fromiter((o is None for o in out), bool, len(out))
        failed[owner[~self.sound[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        failed[owner[inside[~self.compatible(flat[inside], flat[inside + 1])]]] = True
        return text, out, sizes, failed

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word; words should be distinct."""
        text, out, _, failed = self.proposed(words)
        for i in np.flatnonzero(failed):
            out[i] = self.exact(text[i])
        return out

    def count_words(self, words: list[str]) -> list[int]:
        """Number of tokens of each word: that of the proposal, or of the exact merges where it fails."""
        text, _, sizes, failed = self.proposed(words)
        for i in np.flatnonzero(failed):
            sizes[i] = len(self.exact(text[i]))
        return sizes.tolist()


@lru_cache(maxsize=1)
def unassigned() -> str:
    """Letters and digits by the regex package's Unicode tables, but not by the tokenizers library's."""
    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    maybe = "".join(c for c in regex.findall(r"[\p{L}\p{N}]", text) if unicodedata.category(c)[0] not in "LN")
    known = Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str(maybe)
    new = sorted({*map(ord, maybe)} - {ord(c) for c, _ in known})
    edges = np.flatnonzero(np.diff(new) != 1)
    starts, stops = [new[0], *(new[i + 1] for i in edges)], [*(new[i] for i in edges), new[-1]]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, stops, strict=True))


BEYOND = regex.compile(r"[^\x00-\u04ff]").search


def lower_simple(text: str) -> str:
    """Lower case character by character, without the final-sigma rule."""
    if BEYOND(text):
        return Lowercase().normalize_str(text)
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


class Tokenizer:
    """A tokenizer file of the kinds this engine reads: byte-level BPE, with or without word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = Merges(model["vocab"], merges, self.suffix)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.bytes_of = {c: b for b, c in ALPHABET.items()}
        self.byte_decoder = bool(spec["decoder"])
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")
        self.folds = spec["normalizer"] is not None
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if self.folds and kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unknown normalizer: {kinds}")
        self.plain = self.splitter(r"\p{L}", r"\p{N}", r"\p{L}\p{N}")
        self.odd = regex.compile(f"[{unassigned()}]").search
        new = f"--[{unassigned()}]"
        self.careful = self.splitter(rf"[\p{{L}}{new}]", rf"[\p{{N}}{new}]", rf"[\p{{L}}\p{{N}}{new}]")

    def splitter(self, letter: str, digit: str, either: str):
        """findall of the file's splitting pattern, with the given classes of characters."""
        parts = r"'s|'t|'re|'ve|'m|'ll|'d|"
        other = rf"[^{SPACE}{either}]+"
        if self.folds:
            pattern = rf"{letter}+|{digit}|{other}"
        else:
            pattern = rf" ?{letter}+| ?{digit}+| ?{other}|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        return regex.compile(parts + pattern, regex.V1 if "--" in letter else 0).findall

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The text cut at special strings: (string, id) for those, (string, None) for the rest."""
        if "<|" not in text:
            return [(text, None)]
        return [(s, self.added.get(s)) for s in self.added_split.split(text) if s]

    def pretokens(self, text: str) -> list[str]:
        if self.folds:
            text = lower_simple(text if text.isascii() else unicodedata.normalize("NFC", text))
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.odd(text):
                return self.careful(text)
        return self.plain(text)

    def decode_words(self, ids: list[int]) -> str:
        """Tokens joined as the library's decoder does for this file, for the ids of one word."""
        if not self.byte_decoder:
            return " ".join(self.names[i] for i in ids)
        return bytes(self.bytes_of[c] for i in ids for c in self.names[i]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)
