"""Language identification with language-bitmask n-gram filters.

A Bloom filter whose slots hold one bit a language: the bitwise and of an
n-gram's slots returns all languages that contain it. A text's hits are counted
by language, freed of the hits that the filter's fill makes by chance, and the
largest count decides.

Fitting takes labelled rows, at most about ``sample`` a language, chosen by a
hash of the id; prediction reads the text alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, per_slice, slices, trimmed

UNKNOWN = "und"
SIZES = (2, 4)  # characters of the n-grams
SAMPLE = 3000  # labelled rows a language, about
GRAMS = 100_000  # n-grams kept a language
PROBES = 3
LEAST_HITS = 0.25  # of a text's n-grams that its language has; random letters reach about 0.2, prose of the language 0.65 or more
CHARS = 1 << 17  # of texts looked at together
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Model(NamedTuple):
    languages: list[str]
    bits: int  # of a slot number
    slots: np.ndarray  # (2 ** bits, words) of the least unsigned type: bit l % width of word l // width is language l
    chance: np.ndarray  # by language: the share of unknown n-grams that hit
    blind: bool = False  # a labelled language, or all of them, taught nothing: a text without hits may be in it


def _letters() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _TABLE


_TABLE: np.ndarray | None = None


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the text of each, and which texts have a letter. Everything but letters parts words."""
    low = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    doc = np.repeat(np.arange(len(low)), [len(t) for t in low])
    has = np.zeros(len(low), bool)
    has[doc[letter]] = True
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[1:] |= letter[:-1]
    c = np.where(letter, codes, 32).astype(np.uint64)[keep]
    doc = doc[keep].astype(np.int32)
    hashes, docs = [], []
    for n in SIZES:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        for j in range(n):
            h = (h ^ c[j : len(c) - n + 1 + j]) * _ODD[j % 4]
            h ^= h >> np.uint64(29)
        whole = doc[: len(c) - n + 1] == doc[n - 1 :]
        hashes.append(h[whole])
        docs.append(doc[: len(c) - n + 1][whole])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int32), has
    return np.concatenate(hashes), np.concatenate(docs), has


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(PROBES):
        yield ((h * _ODD[k + 1]) >> np.uint64(64 - bits)).astype(np.int64)


def build(languages: list[str], found: dict[str, np.ndarray]) -> Model:
    """The filter over each language's n-gram hashes; 16 slots an n-gram or more."""
    total = sum(len(x) for x in found.values())
    bits = max(10, int(np.ceil(np.log2(max(1, total) * 16))))
    kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(languages) <= 8 * np.dtype(k).itemsize), np.uint64)
    width = 8 * np.dtype(kind).itemsize
    slots = np.zeros((1 << bits, -(-max(1, len(languages)) // width)), kind)
    chance = np.zeros(len(languages))
    for i, name in enumerate(languages):
        flag = kind(1 << i % width)
        for at in _probes(found[name], bits):
            slots[at, i // width] |= flag
        chance[i] = np.mean((slots[:, i // width] & flag) != 0) ** PROBES
    return Model(languages, bits, slots, chance)


def predict(model: Model, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
    """Of each text: language, score (the decided language's part of all corrected hits) and the part of its n-grams that hit, 0 to 1.

    No letter, or nothing learned: ``und`` and 0. No hit at all: the first
    language and 0. Equal counts: the first language by name.
    """
    h, doc, has = grams(texts)
    count = np.zeros((len(texts), len(model.languages)))
    n = np.bincount(doc, minlength=len(texts))
    if len(model.languages):
        slot = list(_probes(h, model.bits))
        kind, width = model.slots.dtype.type, 8 * model.slots.dtype.itemsize
        for w in range(model.slots.shape[1]):
            masks = model.slots[slot[0], w]
            for at in slot[1:]:
                masks &= model.slots[at, w]
            for i in range(w * width, min(len(model.languages), w * width + width)):
                hit = (masks & kind(1 << i % width)) != 0
                count[:, i] = np.bincount(doc[hit], minlength=len(texts))
        count = np.maximum(0.0, (count - n[:, None] * model.chance) / (1 - model.chance))
    total = count.sum(axis=1)
    names, scores, hits = [], [], []
    for i in range(len(texts)):
        k = int(np.argmax(count[i])) if has[i] and model.languages else None
        names.append(UNKNOWN if k is None else model.languages[k])
        scores.append(float(count[i, k] / total[i]) if k is not None and total[i] else 0.0)
        hits.append(float(count[i, k] / n[i]) if k is not None and n[i] else 0.0)
    return names, scores, hits


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that fitting leaves out; a null id is one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, sample: int = SAMPLE, max_grams: int = GRAMS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows that are not held out and whose text and language are not null.

    A language keeps n-grams that at least 3 texts (all, where it has fewer) and
    2 in 1000 have and whose rate is no less than half the highest rate that any
    language reaches with 3 texts or more. Only kept n-grams, at most
    ``max_grams`` a language, reach the driver.
    """
    bound_batches(docs.sparkSession)
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"), held_out(id_col).alias("held"))
    letter = F.col("t").rlike(r"\p{L}")
    found = labelled.groupBy("lang").agg(F.count_if(~F.col("held")).alias("n"), F.max(letter & ~F.col("held")).alias("letter")).collect()
    written = {r["lang"] for r in found if r["letter"]}
    rows, sizes = labelled.where("not held").drop("held"), {r["lang"]: r["n"] for r in found if r["n"]}
    if not sizes:
        return build([], {})._replace(blind=True)
    part = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < part * (1 << 20))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for part, texts in slices(batch, "t", CHARS):
                langs = np.array(part.column(1).to_pylist(), object)
                h, doc, _ = grams(texts)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                for name in set(langs):
                    held.setdefault(name, []).append(h[new & (langs == name)[doc]])
        for name, parts in held.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(keys)), "h": pa.array(keys.view(np.int64)), "n": pa.array(n, pa.int64())})

    seen = chosen.mapInArrow(trimmed(count), "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    learned = chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if(letter).alias("written"))
    rate = seen.join(F.broadcast(learned), "lang").where("n >= least(3, written)").withColumn("rate", F.col("n") / F.col("docs")).where("rate >= 0.002")
    best = rate.groupBy("h").agg(F.coalesce(F.max(F.when(F.col("n") >= 3, F.col("rate"))), F.lit(0.0)).alias("best"), F.collect_list(F.struct("lang", "rate")).alias("all"))
    kept = best.select("h", "best", F.explode("all").alias("x")).where("x.rate >= 0.5 * best").select("h", "x.lang", "x.rate")
    kept = kept.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "h"))).where(F.col("k") <= max_grams)
    table = kept.select("lang", "h").toPandas()
    languages = sorted(sizes)
    model = build(languages, {name: table.loc[table["lang"] == name, "h"].to_numpy(np.int64).view(np.uint64) for name in languages})
    return model._replace(blind=not written or bool(written - set(table["lang"])))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, repeated ones too. A null or empty text, and one without a letter, is ``und`` with score 0; of equal counts the first language by name counts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by languages and max_grams

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        names, scores, _ = predict(shared.value, texts)
        return pa.RecordBatch.from_pydict({"doc_id": part.column(0), "held_out": part.column(1), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("t"))
    return rows.mapInArrow(per_slice(run, "t", CHARS), "doc_id long, held_out boolean, lang_pred string, score double")


def known(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", least: float = LEAST_HITS) -> DataFrame:
    """Whole rows in a learned language: with a letter, and at least ``least`` of whose n-grams the decided one has. A null text has none.

    Where the model is blind to a labelled language, or no row is labelled, a
    letter is enough. A null language becomes the decided one; given languages
    stay. Repeated rows are decided alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(lang_col) if lang_col in docs.columns and docs.schema[lang_col].dataType == T.StringType() else None

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        names, _, hits = predict(shared.value, texts)
        if shared.value.blind:
            keep = [any(map(str.isalpha, t)) for t in texts]
        else:
            keep = [n != UNKNOWN and h >= least for n, h in zip(names, hits, strict=True)]
        if at is not None and part.column(at).null_count and not shared.value.blind:
            given = part.column(at)
            part = part.set_column(at, part.schema.field(at), pc.coalesce(given, pa.array(names, given.type)))
        return part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(per_slice(run, text_col, CHARS), docs.schema)
