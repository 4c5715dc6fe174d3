"""Encoding of whole texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from .shingles import PAD, chunks, mix

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: what may follow a space or a line end that is a cut: no white space in any encoding of it
_SOLID = np.ones(256, bool)
_SOLID[:33] = False
_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False  # white space beyond ASCII begins with one of these
_MARK = np.zeros(256, bool)
_MARK[[ord("."), ord(",")]] = True
KEY = 16  # bytes of a piece that the table holds; as many ids at most
PROBES = 4


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where a pre-token surely begins, the texts' starts among them.

    They are: a space before a character that is no white space; a single
    line end between such characters, and what follows it; a full stop or
    comma between an ASCII letter or digit and a space or line end.
    """
    if not len(data):
        return starts
    solid = _SOLID[data]
    after = np.append(solid[1:], False)
    before = np.append(False, data[:-1] > 32) & np.append(False, data[:-1] < 128)
    cut = (data == 32) & after
    line = (data == 10) & after & before
    cut |= line
    cut[1:] |= line[:-1]
    gap = np.append((data[1:] == 32) | (data[1:] == 10), False)
    cut[1:] |= (_MARK[data] & gap)[1:] & _ALNUM[data][:-1]
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


class ChunkEncoder:
    """Ids of whole texts, equal to the tokenizers library's for the whole text.

    Byte-level BPE never merges across its pre-tokens. So texts are cut at
    places where a pre-token surely begins, each distinct piece is encoded once
    by the library, and a text's ids are the concatenation. A piece of up to
    ``KEY`` bytes is found again by all its bytes in a table of fixed size, for
    all pieces of many texts at once; a full table starts anew. Longer pieces
    are looked up one by one. Texts with an added token go to the library whole.
    """

    def __init__(self, path: str, slot_bits: int = 20):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.tokenize = self.tok.model.tokenize
        self.bits = slot_bits
        self.most = 3 << slot_bits - 2
        # the printable stand-ins of bytes in a byte-level vocabulary
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.shown = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self._clear()

    def _clear(self) -> None:
        self.keys = [np.zeros(1 << self.bits, np.uint64) for _ in range(0, KEY, 8)]
        self.size = np.zeros(1 << self.bits, np.uint8)  # bytes; 0: empty
        self.place = np.zeros(1 << self.bits, np.int32)
        self.count = np.zeros(1 << self.bits, np.uint8)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = self.entries = 0

    def vocabulary_size(self) -> int:
        return self.tok.get_vocab_size(with_added_tokens=True)

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def piece(self, raw: bytes) -> list[int]:
        """Latin letters after at most one space are one pre-token, which goes straight to the model."""
        text = raw.decode("utf-8", "surrogatepass")
        core = text[1:] if text[:1] == " " else text
        if core.isalpha() and max(core) <= "ɏ":
            if not core.isascii():
                core = core.encode().decode("latin-1").translate(self.shown)
            return [t.id for t in self.tokenize("Ġ" + core if text[0] == " " else core)]
        return self.whole(text)

    def _find(self, first: np.ndarray, key: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        """The slot of each piece, -1 where it is unknown."""
        found = np.full(len(first), -1)
        open_ = np.flatnonzero(size <= KEY)
        for step in range(PROBES):
            slot = (first[open_] + step) & ((1 << self.bits) - 1)
            same = (self.keys[0][slot] == key[0][open_]) & (self.size[slot] == size[open_])
            wide = np.flatnonzero(same & (size[open_] > 8))  # of short pieces, the other words are 0
            for k in range(1, len(key)):
                same[wide] &= self.keys[k][slot[wide]] == key[k][open_[wide]]
            found[open_[same]] = slot[same]
            open_ = open_[~same]
            if not len(open_):
                break
        return found

    def _add(self, first: np.ndarray, key: list[np.ndarray], size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Pieces of up to ``KEY`` bytes, each in the first free one of its slots; one that has none takes the place of another."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32))
        self.pool[self.used : self.used + len(ids)] = ids
        place = self.used + np.cumsum(count) - count
        left = np.arange(len(first))
        for step in [*range(PROBES), 0]:
            slot = (first[left] + step) & ((1 << self.bits) - 1)
            if step or len(left) == len(first):
                at = np.flatnonzero(self.size[slot] == 0)
                at = at[np.unique(slot[at], return_index=True)[1]]  # one a slot
            else:
                at = np.unique(slot, return_index=True)[1]
            own, slot = left[at], slot[at]
            for mine, k in zip(self.keys, key, strict=True):
                mine[slot] = k[own]
            self.size[slot], self.place[slot], self.count[slot] = size[own], place[own], count[own]
            left = np.delete(left, at)
            if not len(left):
                break
        self.used += len(ids)
        self.entries += len(first)

    def pieces(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, one behind the other, and how many each has.

        Pieces that surely begin and end a pre-token also next to others of
        their kind go to the library many at once, as one text: Latin letters
        are one word each, which it tells apart, with a space before or a line
        end between; other pieces with a space before are told by their
        characters' places. What is left goes to it one by one.
        """
        kinds: tuple[list[int], ...] = ([], [], [])
        texts = [b.decode("utf-8", "surrogatepass") for b in raw]
        for i, t in enumerate(texts):
            spaced = t[0] == " "
            core = t[1:] if spaced else t
            if core.isalpha() and max(core) <= "ɏ":
                kinds[spaced].append(i)
            elif spaced and core and not core[0].isspace() and not core[-1].isspace():
                kinds[2].append(i)
        count = np.full(len(raw), -1, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # pieces and their ids, in order
        for kind, members in enumerate(kinds):
            for k in range(0, len(members), 4096):
                some = members[k : k + 4096]
                text = ("" if kind else "\n").join([texts[i] for i in some])
                if any(a in text for a in self.added):
                    continue
                e = self.tok.encode(text, add_special_tokens=False)
                ids = np.array(e.ids, np.uint32)
                if kind == 2:
                    ends = np.cumsum([len(texts[i]) for i in some])
                    word = np.searchsorted(ends, np.array([a for a, _ in e.offsets], np.int64), "right")
                else:
                    word = np.array(e.word_ids, np.int64)
                if not kind:  # every second word is the line end between two
                    ids, word = ids[word % 2 == 0], word[word % 2 == 0] // 2
                n = np.bincount(word, minlength=len(some))
                if len(n) == len(some) and n.all():
                    at = np.array(some)
                    count[at] = n
                    parts.append((at, ids))
        for i in np.flatnonzero(count < 0).tolist():
            ids = np.array(self.piece(raw[i]), np.uint32)
            count[i] = len(ids)
            parts.append((np.array([i]), ids))
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.uint32)
        if parts:
            at = np.concatenate([a for a, _ in parts])
            n = count[at]
            out[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.concatenate([x for _, x in parts])
        return out, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as unsigned 32-bit integers, and where each text's end."""
        odd = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if odd:
            left = set(odd)
            ids, ends = self._encode([t for i, t in enumerate(texts) if i not in left])
            parts = iter(np.split(ids, ends[:-1]) if len(ends) else [])
            whole = {i: np.array(self.whole(texts[i]), np.uint32) for i in odd}
            found = [whole[i] if i in whole else next(parts) for i in range(len(texts))]
            return np.concatenate(found), np.cumsum([len(x) for x in found], dtype=np.int64)
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        start = cuts(data, np.append(0, ends[:-1]))
        stop = np.append(start[1:], len(data))
        size = stop - start
        padded = joined + PAD * (KEY // 8)
        key = [chunks(padded, start, size)]
        h = mix(key[0] ^ size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for k in range(8, KEY, 8):
            more = np.flatnonzero(size > k)
            key.append(np.zeros(len(size), np.uint64))
            key[-1][more] = chunks(padded, start[more] + k, size[more] - k)
            h[more] = mix(h[more] ^ key[-1][more])
        slot0 = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        if self.entries > self.most:
            self._clear()
        slot = self._find(slot0, key, size)
        own: dict[bytes, int] = {}
        lost = np.flatnonzero(slot < 0)
        new, many = np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(lost):
            lost = lost[np.unique(h[lost], return_index=True)[1]]
            raw_pieces = [joined[a:b] for a, b in zip(start[lost].tolist(), stop[lost].tolist(), strict=True)]
            own = {b: i for i, b in enumerate(raw_pieces)}
            new, many = self.pieces(raw_pieces)
            short = size[lost] <= KEY
            at = lost[short]
            self._add(slot0[at], [k[at] for k in key], size[at], new[np.repeat(short, many)], many[short])
            slot = self._find(slot0, key, size)
        place, count = self.place[slot].astype(np.int64), self.count[slot].astype(np.int64)
        rest = np.flatnonzero(slot < 0)  # long pieces and those that the table had no room for
        pool = self.pool
        if len(rest):
            begin, more = self.used + np.cumsum(many) - many, []
            at = self.used + len(new)
            for i in rest.tolist():
                b = joined[start[i] : stop[i]]
                if (j := own.get(b)) is not None:
                    place[i], count[i] = begin[j], many[j]
                else:  # known, but its slot was taken
                    ids = self.piece(b)
                    place[i], count[i] = at, len(ids)
                    more += ids
                    at += len(ids)
            pool = np.concatenate([pool[: self.used], new, np.array(more, np.uint32)])
        last = np.cumsum(count)
        ids = pool[np.repeat(place - (last - count), count) + np.arange(last[-1])]
        upto = np.searchsorted(start, ends)  # pieces before each text's end
        return ids, np.append(0, last)[upto]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One per Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ChunkEncoder(path)
