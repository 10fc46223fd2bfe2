"""Exact and fast forms of two public BPE tokenizers, and tree concatenation.

``ByteBpe`` and ``WordBpe`` return what the tokenizers library returns for the
same file with ``add_special_tokens=False``, without truncation and padding.
Characters that this Python's Unicode tables don't know are left to the library
itself, since newer tables may class them differently.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer, models

#: The split of byte-level BPE before merges. A fixed value.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as Unicode has it; ``\s`` of Python also takes U+001C to U+001F. A fixed value.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fast splitting is linear but for very long runs of white space, which go to the library.
LONG_SPACE = re.compile(r"\s{2000}")
#: Entries of a worker's word cache; it is emptied when full, which bounds memory and not results.
CACHE = 400_000


def byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE shows for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


#: Characters met so far that this Python's Unicode tables know.
KNOWN: set[str] = set()


def well_known(text: str) -> bool:
    """Whether this Python's Unicode tables have every character of text."""
    if text.isascii():
        return True
    new = set(text) - KNOWN
    if any(unicodedata.category(c) == "Cn" for c in new):
        return False
    KNOWN.update(new)
    return True


def split_specials(text: str, finder: re.Pattern | None) -> list[str]:
    """Ordinary text at even places, special strings at odd ones."""
    return finder.split(text) if finder is not None else [text]


def special_finder(config: dict) -> tuple[re.Pattern | None, dict[str, int]]:
    added = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
    if not added:
        return None, added
    return re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")"), added


class ByteBpe:
    """Byte-level BPE from a tokenizers file; ids as uint32 arrays."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.finder, self.added = special_finder(config)
        model, pre = config["model"], config.get("pre_tokenizer") or {}
        place = {c: b for b, c in enumerate(byte_alphabet())}
        ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" ", 1))] for m in model["merges"]]
        plain = (
            model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and config.get("normalizer") is None
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and ids == sorted(set(ids)) and all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in config.get("added_tokens", []))
        )
        self.fast = None
        if plain:
            ranks = {bytes(place[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
            self.fast = tiktoken.Encoding(path, pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(BYTE_PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.sizes: dict[str, int] = {}

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or len(text) > 2000 and LONG_SPACE.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        parts = split_specials(text, self.finder)
        if len(parts) == 1:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
        return np.concatenate([np.array([self.added[p]], np.uint32) if k % 2 else self.fast.encode_to_numpy(p, disallowed_special=()).astype(np.uint32, copy=False) for k, p in enumerate(parts)])

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pieces of text that are merged by themselves, and how many special tokens stand between them."""
        parts = split_specials(text, self.finder)
        found: list[str] = []
        for part in parts[::2]:
            if self.fast is not None and well_known(part) and not (len(part) > 2000 and LONG_SPACE.search(part)):
                found += self.pattern.findall(part)
            elif part:
                found += [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return found, len(parts) // 2

    def n_pieces(self, pre_token: str) -> int:
        """Tokens of one pre-token."""
        if self.fast is not None:
            return len(self.fast._encode_single_piece(pre_token.encode()))
        shown = byte_alphabet()
        return len(self.library.model.tokenize("".join(shown[b] for b in pre_token.encode())))


class WordBpe:
    """BPE with word ends: normalised words, each encoded once and kept, long ones by tree concatenation."""

    def __init__(self, path: str, leaf: int = 256):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.finder, self.added = special_finder(config)
        model = config["model"]
        self.suffix, self.leaf = model["end_of_word_suffix"] or "", leaf
        self.shown = byte_alphabet()
        self.token = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        #: For a fragment that doesn't end its word.
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        steps = config["normalizer"]["normalizers"]
        splits = config["pre_tokenizer"]["pretokenizers"]
        self.known = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        pattern = splits[0]["pattern"]["Regex"].replace(r"\s", SPACE)
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, tuple[bytes, str]] = {}
        #: Which ids end a word.
        self.ends = np.array([self.token.get(i, "").endswith(self.suffix) for i in range(max(self.token) + 1)])

    def normalised(self, text: str) -> str:
        """Text without special strings as the file's normalizer leaves it, but for white space, which no word holds."""
        if self.known and well_known(text):
            # the library lowers character by character, so a last sigma is none
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.library.normalizer.normalize_str(text)

    def words(self, text: str) -> list[str]:
        """Words of text without special strings, normalised, as the file's pre-tokenizer cuts them."""
        if self.known and well_known(text):
            return self.pattern.findall(self.normalised(text))
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where the words of a normalised text begin and end; each is found from the end of the one before."""
        if self.known and well_known(text):
            return [m.span() for m in self.pattern.finditer(text)]
        return [at for _, at in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def fragment(self, shown: str, ends: bool) -> list[int]:
        """Ids of byte characters; ``ends`` if their word ends with them."""
        return [t.id for t in (self.library.model if ends else self.inner).tokenize(shown)] if shown else []

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """Ids of the text of ``left`` and ``right`` together, each the exact ids of its own text.

        A window around the join is encoded anew and grown until its first id is the one that
        ``left`` has there and its last the one that ``right`` has. All neighbours are then pairs
        that some exact encoding has side by side, which makes the whole exact.
        """
        if not left or not right:
            return left or right
        width = 4
        while True:
            a, b = left[-width:], right[:width]
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            text = "".join(self.token[i] for i in a + b)
            last = ends and whole_right
            ids = self.fragment(text.removesuffix(self.suffix) if last else text, last)
            if (whole_left or ids[0] == a[0]) and (whole_right or ids[-1] == b[-1]):
                return left[: len(left) - len(a)] + ids + right[len(b) :]
            width *= 2

    def tree(self, shown: str, ends: bool = True) -> list[int]:
        """Encode the halves of long byte characters, down to leaves, and join them."""
        if len(shown) <= self.leaf:
            return self.fragment(shown, ends)
        half = len(shown) // 2
        return self.join(self.tree(shown[:half], False), self.tree(shown[half:], ends), ends)

    def show(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() and " " not in word else "".join(self.shown[b] for b in word.encode())

    def encode_word(self, word: str) -> tuple[bytes, str]:
        """Little-endian 32-bit ids of a word and its decoded text."""
        kept = self.cache.get(word)
        if kept is None:
            kept = self.packed(self.tree(self.show(word)))
            if len(self.cache) >= CACHE:
                self.cache.clear()
            if len(word) <= 64:
                self.cache[word] = kept
        return kept

    def packed(self, ids: list[int]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.token[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, str]:
        """Little-endian 32-bit ids of a text and what decode(ids, skip_special_tokens=False) returns for them.

        The file has no decoder, so decoding puts a space between tokens.
        """
        found: list[tuple[bytes, str]] = []
        for k, part in enumerate(split_specials(text, self.finder)):
            if k % 2:
                found.append(self.packed([self.added[part]]))
            elif part:
                cached = self.cache
                found += [cached.get(w) or self.encode_word(w) for w in self.words(part)]
        return b"".join([x for x, _ in found]), " ".join([x for _, x in found])


@lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(2)
def word_bpe(path: str, leaf: int = 256) -> WordBpe:
    return WordBpe(path, leaf)

