"""Byte-level BPE by forced boundaries.

A pair of adjacent bytes that occurs inside no token of the vocabulary can never be merged over,
so a text may be cut there: the fragments are encoded one by one and their ids concatenated.
Natural text has such a pair before nearly every space, so fragments are words, they repeat, and
each is encoded once per worker.

The splitting pattern of byte-level vocabularies looks only ahead, and only from white space
(``\\s+(?!\\S)``), and its contractions begin with an apostrophe.  Hence a cut is taken only where
the character before it is no white space and the one after it no apostrophe; then the pattern
splits the fragments exactly where it splits the whole text (or inside a piece, which merges
cannot cross).  Strings of added tokens are fragments of their own, as in the library.

Fragments of up to 16 bytes are looked up together: their first and last eight bytes and their
length name them exactly, and address a table of ids.  Longer and new ones take a dictionary.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

#: Fragments kept per worker; both caches hold results only, so their size never changes ids.
CACHE_FRAGMENTS = 400_000
SLOTS = 1 << 21
#: Ids in a slot of the table; a fragment of more stays in the dictionary.
WIDE = 8
#: Bytes with which a white-space character of more than one byte can end.
_SPACE_TAILS = [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ForcedBoundaryBPE:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        alphabet = byte_alphabet()
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens: list[bytes] = [b""] * (max(vocab.values()) + 1)
        inside = np.zeros(65536, bool)
        for token, i in vocab.items():
            if i in added:
                self.tokens[i] = token.encode()
                continue
            raw = self.tokens[i] = bytes(alphabet[c] for c in token)
            if len(raw) > 1:
                b = np.frombuffer(raw, np.uint8).astype(np.int32)
                inside[b[:-1] * 256 + b[1:]] = True
        left, right = np.divmod(np.arange(65536), 256)
        space = ((left >= 9) & (left <= 13)) | ((left >= 0x1C) & (left <= 0x20))
        mark = (right >= 0x80) & (right < 0xC0)
        #: Pairs that mark a certain cut, and those of them to check for wide white space.
        self.certain = ~inside & ~space & ~mark & (right != 0x27)
        self.tails = np.isin(np.arange(256), _SPACE_TAILS)
        self.cache: dict[bytes, np.ndarray] = {}
        self.first = np.zeros(SLOTS, np.uint64)
        self.last = np.zeros(SLOTS, np.uint64)
        self.size = np.zeros(SLOTS, np.uint8)  # 0: an empty slot
        self.ids = np.zeros((SLOTS, WIDE), np.uint16 if len(self.tokens) <= 65536 else np.uint32)
        self.count = np.zeros(SLOTS, np.uint8)
        names = sorted(map(re.escape, (t.encode() for t in self.added)), key=len, reverse=True)
        self.special = re.compile(b"|".join(names)) if names else None
        self.token_size = np.array([len(t) for t in self.tokens], np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def starts(self, raw: bytes, ends: np.ndarray) -> np.ndarray:
        """Where the fragments of texts joined in ``raw`` start; ``ends``: where the texts end."""
        b = np.frombuffer(raw, np.uint8)
        pair = b[:-1].astype(np.uint16)
        pair <<= 8
        pair |= b[1:]
        at = np.flatnonzero(self.certain[pair])
        wide = np.flatnonzero(self.tails[b[at]])  # maybe the end of a wide white space
        if len(wide):
            # that has the lead C2 and one byte more, or a lead from E1 on: no lead of C3 to DF
            before = b[np.maximum(at[wide] - 1, 0)]
            at = np.delete(at, wide[(before < 0xC3) | (before > 0xDF)])
        at += 1
        texts = np.concatenate([[0], ends[:-1]])
        if self.special:
            for m in self.special.finditer(raw):
                i, j = m.span()
                if not np.searchsorted(ends, j, "left") > np.searchsorted(ends, i, "right"):
                    at = at[(at <= i) | (at >= j)]
                    at = np.concatenate([at, [i, j]])
        begins = np.zeros(len(raw) + 1, bool)
        begins[at] = True
        begins[texts] = True
        return np.flatnonzero(begins[:-1])

    def _missing(self, parts: set[bytes]) -> None:
        new = [p for p in parts if p not in self.cache]
        if len(self.cache) + len(new) > CACHE_FRAGMENTS:
            self.cache.clear()
            new = list(parts)
        coded = self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)
        for p, e in zip(new, coded, strict=True):
            self.cache[p] = np.array(e.ids, np.uint32)

    def encode_many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8) in a row, and how many each text has."""
        ends = np.cumsum([len(t) for t in texts])
        raw = b"".join(texts)
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        start = self.starts(raw, ends)
        size = np.diff(np.append(start, len(raw)))
        short = size <= 16
        padded = b"\0" * 8 + raw + b"\0" * 8
        eight = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))  # the 8 bytes from i - 8 on
        lack = (8 * np.maximum(8 - size, 0)).astype(np.uint64)
        keep = np.uint64(0xFFFFFFFFFFFFFFFF)
        first = eight[start + 8] & (keep >> lack)
        last = eight[start + size] >> lack  # of a short fragment, without what stands before it
        slot = first * np.uint64(0x9E3779B97F4A7C15) ^ (last * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
        slot = ((slot * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(43)).astype(np.int64) & (SLOTS - 1)
        hit = short & (self.first[slot] == first) & (self.last[slot] == last) & (self.size[slot] == size)
        n = np.where(hit, self.count[slot], 0).astype(np.int64)
        rest = np.flatnonzero(~hit)
        found: list[np.ndarray] = []
        if len(rest):
            parts = [raw[i:j] for i, j in zip(start[rest].tolist(), (start[rest] + size[rest]).tolist(), strict=True)]
            if any(p not in self.cache for p in parts):
                self._missing(set(parts))
            found = [self.cache[p] for p in parts]
            n[rest] = [len(x) for x in found]
        at = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), np.uint32)
        good = np.flatnonzero(hit)
        for k in range(int(n[good].max(initial=0))):
            good = good[n[good] > k]
            out[at[good] + k] = self.ids[slot[good], k]
        if found:
            where = np.repeat(at[rest] - np.cumsum(n[rest]) + n[rest], n[rest]) + np.arange(n[rest].sum())
            out[where] = np.concatenate(found)
            own = [(r, x) for r, x in zip(rest.tolist(), found, strict=True) if short[r] and len(x) <= WIDE]
            if own:
                r = np.array([r for r, _ in own])
                s = slot[r]
                self.first[s], self.last[s] = first[r], last[r]
                self.size[s], self.count[s] = size[r], n[r]
                block = np.zeros((len(own), WIDE), self.ids.dtype)
                for row, (_, x) in zip(block, own, strict=True):
                    row[: len(x)] = x
                self.ids[s] = block
        bound = np.searchsorted(start, ends - np.array([len(t) for t in texts]), "left")
        total = np.append(at, len(out))
        first_id = total[bound]
        last_id = total[np.searchsorted(start, ends, "left")]
        return out, last_id - first_id

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text.encode()])[0]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        size = self.token_size[ids]
        skip = np.repeat(self.token_at[ids] - np.cumsum(size) + size, size)
        return self.token_bytes[skip + np.arange(len(skip))].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Special tokens are kept; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[str, ForcedBoundaryBPE] = {}


def encoder(path: str) -> ForcedBoundaryBPE:
    """One encoder per worker process; its caches outlive a task."""
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBPE(path)
    return _loaded[path]
