"""Removal of repeated passages by sliding sentence spans.

A text is cut into sentences: words up to one that ends in . ! or ?, or in such
a mark of another script, or up to a line end. One of more than ``LONGEST``
words is cut further, behind the word of least hash of every ``LONGEST`` - 1
neighbours, so that neither a long one nor a lack of marks hides a passage. In
scripts without spaces each character is cut like a word. A span is a run of
``RUN`` consecutive sentences; where a least number of words is asked for, the
shortest runs that hold it, from every sentence on and up to every sentence. All
are hashed. Spans that several documents have are first in the document of smallest
id, and in all others their sentences are removed. A later occurrence in the
same document is removed as well.

Of a repeated passage of n words with the same line ends, at most ``LONGEST``
words at each end fuse with what surrounds it; all n - 2 * ``LONGEST`` words or
more inside are cut alike everywhere, and are covered if they are 25 (which take
``RUN`` sentences) or as many as are asked for. So every passage of 49 words loses all but its
ends, but for stretches of one word ``LONGEST`` times over, which are not cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, per_slice, slices, spread_join
from .shingles import _SPACE, LOWER, PAD, mix, range_hashes

RUN = 3
LONGEST = 12  # words of a sentence
PART = 4  # a word's weight; characters of scripts without spaces weigh less
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True
_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))
_IDEOGRAPH, _LETTER, _MARK = 1, 2, 3  # about two characters a word, about four, and the end of a sentence
_KIND = np.zeros(0x40000, np.uint8)
for _a, _b in ((0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
    _KIND[_a : _b + 1] = _IDEOGRAPH
for _a, _b in ((0x0E01, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF)):  # Thai, Lao, Burmese, Khmer
    _KIND[_a : _b + 1] = _LETTER
_KIND[[ord(c) for c in "。！．？｡…‼⁇⁈⁉।॥။។៕؟۔։።፧፨"]] = _MARK
_WEIGHT = np.array([PART, PART // 2, PART // 4, PART])


class Cut(NamedTuple):
    """Sentences of several texts, in order: the text of each, its byte range there, its words in parts of ``PART`` and its hash."""

    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    words: np.ndarray
    hash: np.ndarray


def _kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, byte lengths and kinds of UTF-8 characters that are no ordinary part of a word; ASCII aside."""
    at = np.flatnonzero(data >= 0xCD)
    lead = data[at]
    size = 2 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
    code = (lead & (0xFF >> (size + 1))).astype(np.int64)
    for k in (1, 2, 3):
        inside = size > k
        code[inside] = code[inside] << 6 | data[at[inside] + k] & 63
    kind = np.where(code < len(_KIND), _KIND[np.minimum(code, len(_KIND) - 1)], 0)
    odd = kind > 0
    return at[odd], size[odd], kind[odd]


def _split(word: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words behind which long sentences are cut: of each ``LONGEST`` - 1 neighbours the last of least hash, with the word before it."""
    count = ends - begins + 1
    long = count > LONGEST
    if not long.any():
        return np.empty(0, np.int64)
    count, begins = count[long], begins[long]
    owner = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    at = np.arange(len(owner)) + np.repeat(begins - first, count)
    value = word[at]
    value[1:] += value[:-1] * _ODD[1]
    value[first] = word[begins]
    value = mix(value)
    width = LONGEST - 1
    n = len(value) - width + 1
    low, high, place = value[:n].copy(), value[:n].copy(), np.arange(n)
    for j in range(1, width):
        v = value[j : n + j]
        less = v <= low
        low[less] = v[less]
        place[less] = np.flatnonzero(less) + j
        np.maximum(high, v, out=high)
    return at[np.unique(place[(owner[:n] == owner[width - 1 :]) & (low < high)])]


def cut(texts: list[str]) -> Cut:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join([*raw, b""])
    data = np.frombuffer(joined, np.uint8)
    space = _SPACE[data]
    if space.all():
        none = np.empty(0, np.int64)
        return Cut(none, none, none, none, np.empty(0, np.uint64))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = np.concatenate([[0], edge]) if not space[0] else edge
    first, last = edge[::2], edge[1::2]
    weight = np.full(len(first), PART)
    at, size, kind = _kinds(data)
    marked = at[kind == _MARK] + size[kind == _MARK]
    if len(at):
        stay = space | _END[data]
        stay[at[kind == _MARK]] = True
        own = kind != _MARK
        first = np.unique(np.concatenate([first, at[own], (at + size)[~stay[at + size]]]))
        last = np.minimum(np.append(first[1:], len(data)), last[np.searchsorted(last, first, "right")])
        weight = np.full(len(first), PART)
        weight[np.searchsorted(first, at[own])] = _WEIGHT[kind[own]]
    word = range_hashes(joined.translate(LOWER) + PAD, first, last)
    lines = np.cumsum(_LINE[data])  # the separator of texts is a line end, too
    close = _END[data[last - 1]] | np.isin(last, marked) | (np.append(lines[first[1:]], lines[-1] + 1) != lines[last - 1])
    ends = np.flatnonzero(close)
    close[_split(word, np.concatenate([[0], ends[:-1] + 1]), ends)] = True
    ends = np.flatnonzero(close)
    begins = np.concatenate([[0], ends[:-1] + 1])
    # words of a sentence in order: a sum over powers of the word's place
    place = np.arange(len(word)) - np.repeat(begins, ends - begins + 1)
    mixed = mix(word + place.astype(np.uint64) * _ODD[0])
    total = np.add.reduceat(mixed, begins)
    offset = np.cumsum([0, *[len(r) + 1 for r in raw]])
    text = np.searchsorted(offset, first[begins], "right") - 1
    return Cut(text, first[begins] - offset[text], last[ends] - offset[text], np.add.reduceat(weight, begins), mix(total + (ends - begins + 1).astype(np.uint64)))


def spans(c: Cut, words: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, sentence behind the last, and hash of every span: ``RUN`` sentences, or more until they hold so many words."""
    n, least = len(c.hash), words * PART
    total = np.concatenate([[0], np.cumsum(c.words)])
    at = np.arange(n)
    stop = np.maximum(np.searchsorted(total, total[:-1] + least), at + RUN)
    fits = stop <= n
    ahead = np.stack([at[fits], stop[fits]])
    start = np.minimum(np.searchsorted(total, total[1:] - least, "right") - 1, at + 1 - RUN)
    fits = start >= 0
    behind = np.stack([start[fits], at[fits] + 1])
    start, stop = np.divmod(np.unique(np.concatenate([ahead[0] * (n + 1) + ahead[1], behind[0] * (n + 1) + behind[1]])), n + 1)
    whole = c.text[start] == c.text[stop - 1]
    start, stop = start[whole], stop[whole]
    h, open_ = np.zeros(len(start), np.uint64), np.arange(len(start))
    for k in range(int((stop - start).max(initial=0))):
        open_ = open_[stop[open_] - start[open_] > k]
        h[open_] = mix(h[open_] * _ODD[1] ^ c.hash[start[open_] + k])
    return start, stop, h


def _again(h: np.ndarray) -> np.ndarray:
    """Which values stand further ahead already."""
    out = np.ones(len(h), bool)
    out[np.unique(h, return_index=True)[1]] = False
    return out


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", words: int = 0) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed, text) of every row.

    A span is ``RUN`` sentences in a row, of any length; with ``words`` it goes
    on until it holds so many (up to 63), so that short phrases stay.

    ``removed`` lists start:end of what went, in code points of the given text;
    ``text`` is what stays. A null text stays null, and an empty one empty. Rows
    of one id count as one document: none loses a run to another of them. Null
    ids count as the largest.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("k"), F.col(text_col).alias("t"), F.xxhash64(F.col(text_col)).alias("x"))

    def emit(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch | None:
        c = cut(texts)
        start, stop, h = spans(c, words)
        if not len(h):
            return None
        first = np.searchsorted(c.text, np.arange(len(texts)))
        key, x = (np.array(part.column(n).to_pylist(), np.int64) for n in (0, 1))
        t = c.text[start]
        order = np.lexsort((start, h, t))  # one of a text's equal spans
        keep = np.ones(len(h), bool)
        keep[order[1:]] = (h[order][1:] != h[order][:-1]) | (t[order][1:] != t[order][:-1])
        start, stop, h, t = start[keep], stop[keep], h[keep], t[keep]
        place = (start - first[t]) << 8 | np.minimum(stop - start, 255)  # a span has at most words * PART sentences, or RUN
        return pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "k": pa.array(key[t]), "x": pa.array(x[t]), "at": pa.array(place)})

    texts = rows.where("t is not null").select("k", "x", "t")
    seen = scratch.save(texts.mapInArrow(per_slice(emit, "t"), "h long, k long, x long, at long"), "spans")
    several = seen.groupBy("h").agg(F.min("k").alias("first"), F.max("k").alias("other"), F.count(F.lit(1)).alias("w")).where("first < other").select("h", "first", "w")
    several = scratch.save(several, "several")
    later = spread_join(seen, several, ["h"], "w").where("k <> first").groupBy("k", "x").agg(F.collect_set("at").alias("ats"))
    later = scratch.save(later, "later")

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "t"):
                c = cut(texts)
                start, stop, h = spans(c, words)
                own = np.searchsorted(start, np.searchsorted(c.text, np.arange(len(texts) + 1))).tolist()
                bound = np.searchsorted(c.text, np.arange(len(texts) + 1)).tolist()
                null = part.column(1).is_null().to_pylist()
                out = []
                for n, (t, ats) in enumerate(zip(texts, part.column(2).to_pylist(), strict=True)):
                    i, j = bound[n], bound[n + 1]
                    covered = np.zeros(j - i, bool)
                    for at in ats or []:
                        covered[at >> 8 : (at >> 8) + (at & 255)] = True
                    mine = slice(own[n], own[n + 1])
                    for a, b in zip((start[mine] - i)[again := _again(h[mine])].tolist(), (stop[mine] - i)[again].tolist(), strict=True):
                        covered[a:b] = True
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                    gone, ranges = int(covered.sum()), [(int(c.start[i + a]), int(c.stop[i + b - 1])) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                    if not ranges:
                        out.append((j - i, 0, "", None if null[n] else t))
                        continue
                    raw = t.encode("utf-8", "surrogatepass")
                    kept, gaps, at, chars = [], [], 0, 0
                    for a, b in ranges:
                        kept.append(raw[at:a])
                        begin = chars + len(raw[at:a].decode("utf-8", "surrogatepass"))
                        chars = begin + len(raw[a:b].decode("utf-8", "surrogatepass"))
                        gaps.append(f"{begin}:{chars}")
                        while b < len(raw) and raw[b] in b" \t":
                            b += 1
                            chars += 1
                        at = b
                    kept.append(raw[at:])
                    out.append((j - i, gone, ",".join(gaps), b"".join(kept).decode("utf-8", "surrogatepass")))
                if out:
                    a, b, d, e = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.string()), pa.array(e, pa.string())], ["doc_id", "n_sentences", "n_removed", "removed", "text"])

    return rows.join(later, ["k", "x"], "left").select("doc_id", "t", "ats").mapInArrow(clean, "doc_id long, n_sentences long, n_removed long, removed string, text string")
