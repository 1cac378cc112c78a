"""Byte-level byte-pair encoding with a segment tree over the ranks of adjacent pairs.

A pre-token starts as its bytes. The tree's leaves are the ranks of adjacent pairs, its root is the lowest
rank and, among equals, the leftmost; a merge changes at most three leaves. So a pre-token of n bytes
takes O(n log n) steps, however long it is. Short pre-tokens of a batch are merged side by side, a tree each, as
rows of numpy arrays; long ones one by one.

The vocabulary file is only read. Special tokens that occur in a text are their ids, as the library
does it unless told otherwise.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: How this vocabulary cuts text into pre-tokens. Fixed value.
PRE_TOKEN = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
#: Strings that are one pre-token of letters, whose kind never changed, and at most one of ASCII marks behind it.
WORD_AND_MARKS = r"^(?P<word> ?[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
#: A worker remembers the ids of so many pre-tokens, and as many before them. Only speed depends on it.
REMEMBERED = 100_000
#: Pre-tokens of at most so many bytes are merged side by side.
SHORT = 65

_NONE = 1 << 62
#: In trees of short words: leaves are ranks and places in 32 bits.
_PLACE_BITS = 7
_SHORT_NONE = np.int32(1 << 30)
_NO_SYMBOL = (1 << 20) - 1
_SPACE_AHEAD = re.compile(r" (?=\s|$)")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, and the byte."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [byte for byte in range(256) if byte not in set(printable)]
    return {chr(byte): byte for byte in printable} | {chr(256 + i): byte for i, byte in enumerate(others)}


class Memo:
    """Values of recently used keys: those of this generation and of the one before. Keys that were asked for stay at
    least until ``forget``, which starts a new generation once this one is full."""

    def __init__(self, limit: int):
        self.limit = limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new

    def unknown(self, keys: set[str]) -> set[str]:
        """The keys that have no value; the others are brought into this generation."""
        lacking, old = keys.difference(self.new), self.old
        if not old:
            return lacking
        kept = {key for key in lacking if key in old}  # intersection() would walk all of old
        self.new.update((key, old[key]) for key in kept)
        return lacking - kept


class Pieces:
    """Texts to ids by way of their different pieces, whose ids a subclass gives."""

    def __init__(self, special: dict[str, int], remembered: int = REMEMBERED):
        self.special = special
        self.split_special = (
            re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        )
        self._known = Memo(remembered)

    def _coded(self, words: list[str]) -> Iterable[tuple[str, bytes]]:
        """The ids of different pre-tokens as unsigned 32-bit integers."""
        raise NotImplementedError

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings that start and end where pre-tokens do, one after the other, and how many each has.

        A word with marks behind it is cut by Arrow, other strings one by one; each different pre-token is coded once.
        """
        parted = [self._has_special(unit) and self._with_special(unit) for unit in units.to_pylist()] if self._any_special(units) else []
        special = np.array([i for i, ids in enumerate(parted) if ids], np.int64)
        cut = pc.extract_regex(units, WORD_AND_MARKS)
        simple = np.asarray(cut.is_valid())
        simple[special] = False
        apart = ~simple
        apart[special] = False
        plain, odd = np.flatnonzero(simple), np.flatnonzero(apart)
        word, marks = (pc.struct_field(cut, name).filter(pa.array(simple)) for name in ("word", "marks"))
        marked = np.asarray(pc.not_equal(marks, ""))
        parts = [PRE_TOKEN.findall(unit) for unit in units.filter(pa.array(apart)).to_pylist()]
        many = np.fromiter(map(len, parts), np.int64, len(parts))
        coded = pa.concat_arrays(
            [word, marks.filter(pa.array(marked)), pa.array([part for some in parts for part in some], pa.string())]
        ).dictionary_encode()
        ids = self._words(coded.dictionary.to_pylist()) + [parted[i] for i in special.tolist()]
        owner = np.concatenate([plain, plain[marked], np.repeat(odd, many), special])
        codes = np.r_[np.asarray(coded.indices), len(coded.dictionary) + np.arange(len(special))]
        codes = codes[np.argsort(owner, kind="stable")]
        length = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        each = length[codes]
        total, ends = np.cumsum(np.r_[0, each]), np.cumsum(np.r_[0, np.bincount(owner, minlength=len(units))])
        return _gathered(np.frombuffer(b"".join(ids), np.uint32), (np.cumsum(length) - length)[codes], each), np.diff(total[ends])

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of different pre-tokens."""
        self._known.forget()
        self._known.new.update(self._coded(list(self._known.unknown(set(words)))))
        known = self._known.new
        return [known[word] for word in words]

    def _any_special(self, units: pa.Array) -> bool:
        return any(pc.any(pc.match_substring(units, token)).as_py() for token in self.special)

    def _has_special(self, text: str) -> bool:
        for token in self.special:
            if token in text:
                return True
        return False

    def _with_special(self, text: str) -> bytes:
        """The ids of a text with special tokens in it."""
        parts = [part for part in self.split_special.split(text) if part]
        plain = [part for part in dict.fromkeys(parts) if part not in self.special]
        flat, counts = self._units(pa.array(plain, pa.string()))
        ids = dict(zip(plain, (one.tobytes() for one in np.split(flat, np.cumsum(counts)[:-1]))))
        return b"".join(ids[part] if part in ids else array("I", [self.special[part]]).tobytes() for part in parts)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has.

        A space between two visible characters always starts a pre-token, so texts are cut there, and each
        different piece is looked up once. Where more white space follows a space, or a special token stands, that
        holds no longer: such a text is one piece.
        """
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = [bool(_SPACE_AHEAD.search(text)) or self._has_special(text) for text in texts]
        lists = pc.split_pattern(pa.array(["" if odd else text for odd, text in zip(whole, texts)], pa.string()), " ")
        starts = np.asarray(lists.offsets)[:-1]
        coded = lists.flatten().dictionary_encode()
        heads = [text if odd else text.split(" ", 1)[0] for odd, text in zip(whole, texts)]
        place = {head: i for i, head in enumerate(dict.fromkeys(heads))}
        pieces = pc.binary_join_element_wise(" ", coded.dictionary, "")
        codes = np.array(coded.indices)
        codes[starts] = np.array([place[head] for head in heads]) + len(pieces)
        flat, length = self._units(pa.concat_arrays([pieces, pa.array(list(place), pa.string())]))
        each = length[codes]
        return _gathered(flat, (np.cumsum(length) - length)[codes], each), np.add.reduceat(each, starts)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        flat, counts = self.encode_flat(texts)
        return np.split(flat, np.cumsum(counts)[:-1]) if texts else []

    def encode(self, text: str) -> list[int]:
        return self.encode_flat([text])[0].tolist()

    def counts(self, texts: list[str]) -> list[int]:
        return self.encode_flat(texts)[1].tolist()

    def leaf_counts(self, cuts: list[list[str]]) -> list[list[int]]:
        """Token counts of the leaves of texts; leaves start and end where pre-tokens do."""
        coded = pa.array([leaf for leaves in cuts for leaf in leaves], pa.string()).dictionary_encode()
        each = self._units(coded.dictionary)[1][np.asarray(coded.indices)]
        ends = np.cumsum([0, *map(len, cuts)]).tolist()
        return [each[a:b].tolist() for a, b in zip(ends, ends[1:])]

class BytePairs(Pieces):
    """One vocabulary: texts to ids and back."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        super().__init__({token["content"]: token["id"] for token in content["added_tokens"]})
        letters, vocabulary = byte_letters(), content["model"]["vocab"]
        self.of_byte = [0] * 256
        for letter, byte in letters.items():
            self.of_byte[byte] = vocabulary[letter]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(content["model"]["merges"]):
            self.rank[vocabulary[left] << 20 | vocabulary[right]] = rank
            self.made.append(vocabulary[left + right])
        self.bytes_of = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        pairs = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(pairs)
        self._pairs, self._ranks = pairs[order], np.arange(len(pairs), dtype=np.int32)[order] << _PLACE_BITS
        self._made, self._of_byte = np.array(self.made, np.int32), np.array(self.of_byte, np.int32)
        lengths = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self._token_bytes, self._token_length = np.frombuffer(b"".join(self.bytes_of), np.uint8), lengths
        self._token_start = np.cumsum(lengths) - lengths

    def __len__(self) -> int:
        return len(self.bytes_of)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        symbols = [self.of_byte[byte] for byte in word]
        n = len(symbols)
        if n < 2:
            return symbols
        rank_of, made = self.rank.get, self.made
        size = 1 << (n - 2).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            rank = rank_of(symbols[i] << 20 | symbols[i + 1])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for node in range(size - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree[1]) != _NONE:
            at = root & 0xFFFFFFFF
            gone = after[at]
            end = after[at] = after[gone]
            symbols[at] = symbol = made[root >> 32]
            symbols[gone] = -1
            changed = [(at, _NONE), (gone, _NONE)] if gone < n - 1 else [(at, _NONE)]
            if end < n:
                before[end] = at
                rank = rank_of(symbol << 20 | symbols[end])
                if rank is not None:
                    changed[0] = (at, rank << 32 | at)
            if at:
                start = before[at]
                rank = rank_of(symbols[start] << 20 | symbol)
                changed.append((start, _NONE if rank is None else rank << 32 | start))
            for leaf, value in changed:
                node = size + leaf
                if tree[node] == value:
                    continue
                tree[node] = value
                while node > 1:
                    other = tree[node ^ 1]
                    node >>= 1
                    if other < value:
                        value = other
                    if tree[node] == value:
                        break
                    tree[node] = value
        return [symbol for symbol in symbols if symbol >= 0]

    def _rank_of(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves for pairs of symbols at given places."""
        pairs = left.astype(np.int64) << 20 | right
        found = np.searchsorted(self._pairs, pairs)
        found[found == len(self._pairs)] = 0
        return np.where(self._pairs[found] == pairs, self._ranks[found] | at.astype(np.int32), _SHORT_NONE)

    def _merge_side_by_side(self, words: list[bytes], leaves: int) -> list[bytes]:
        """Ids of words of 2 to ``leaves`` + 1 bytes (a power of two, plus one), as 32-bit integers."""
        n, width = len(words), leaves + 1
        lengths = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(word.ljust(width, b"\0") for word in words), np.uint8).reshape(n, width)
        places = np.arange(width + 1, dtype=np.int32)
        symbols = np.full((n, width + 1), _NO_SYMBOL, np.int32)
        symbols[:, :width] = np.where(places[:width] < lengths[:, None], self._of_byte[data], _NO_SYMBOL)
        tree = np.full((n, 2 * leaves), _SHORT_NONE)
        tree[:, leaves:] = self._rank_of(symbols[:, :leaves], symbols[:, 1:width], places[:leaves])
        level = leaves
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.broadcast_to(places + 1, (n, width + 1)).copy()
        before = np.broadcast_to(places - 1, (n, width + 1)).copy()
        flat = tree.reshape(-1)

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray | int) -> None:
            node = rows * (2 * leaves) + (leaves + leaf)
            low = rows * (2 * leaves)
            flat[node] = value
            at = leaves + leaf
            for _ in range(leaves.bit_length() - 1):
                lesser = np.minimum(flat[node], flat[node ^ 1])
                at = at >> 1
                node = low + at
                flat[node] = lesser

        rows = np.flatnonzero(tree[:, 1] != _SHORT_NONE)
        while len(rows):
            root = tree[rows, 1]
            at = root & ((1 << _PLACE_BITS) - 1)
            gone = after[rows, at]
            end = after[rows, gone]
            after[rows, at], before[rows, end] = end, at
            symbol = self._made[root >> _PLACE_BITS]
            symbols[rows, at], symbols[rows, gone] = symbol, -1
            put(rows, at, self._rank_of(symbol, symbols[rows, end], at))
            inner = gone < leaves
            put(rows[inner], gone[inner], _SHORT_NONE)
            inner = at > 0
            some, start = rows[inner], before[rows[inner], at[inner]]
            put(some, start, self._rank_of(symbols[some, start], symbol[inner], start))
            rows = rows[tree[rows, 1] != _SHORT_NONE]
        live = (symbols >= 0) & (symbols < _NO_SYMBOL)
        ends = np.cumsum(live.sum(1)) * 4
        ids = symbols[live].astype(np.uint32).tobytes()
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _coded(self, words: list[str]) -> Iterable[tuple[str, bytes]]:
        """The ids of different pre-tokens."""
        by_size: dict[int, list[str]] = {}
        for word in words:
            size = len(word) if word.isascii() else len(word.encode())
            by_size.setdefault(1 << (size - 2).bit_length() if 2 <= size <= SHORT else 0, []).append(word)
        for leaves, some in by_size.items():
            for start in range(0, len(some), 20_000):
                part = some[start : start + 20_000]
                coded = [word.encode() for word in part]
                made = (
                    self._merge_side_by_side(coded, leaves)
                    if leaves
                    else [array("I", self.merge(word)).tobytes() for word in coded]
                )
                yield from zip(part, made)

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids that stand one after the other, ``counts`` for each text."""
        fine = (ids >= 0) & (ids < len(self.bytes_of))
        if not fine.all():
            keys = np.repeat(np.arange(len(counts)), counts)[fine]
            ids, counts = ids[fine], np.bincount(keys, minlength=len(counts))
        each = self._token_length[ids]
        data = _gathered(self._token_bytes, self._token_start[ids], each).tobytes()
        ends = np.cumsum(np.r_[0, each])[np.cumsum(np.r_[0, counts])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 read as the replacement character, unknown ids as nothing."""
        known, n = self.bytes_of, len(self.bytes_of)
        try:
            return b"".join([known[i] for i in ids]).decode("utf-8", "replace")
        except (IndexError, TypeError):
            return b"".join([known[i] for i in ids if i is not None and 0 <= i < n]).decode("utf-8", "replace")


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` with the given starts and lengths, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


@lru_cache(maxsize=2)
def load(path: str) -> BytePairs:
    """The vocabulary at ``path``, read once in each process."""
    return BytePairs(path)
