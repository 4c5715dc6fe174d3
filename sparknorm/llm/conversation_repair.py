"""Cheapest repair of conversations by Dijkstra on an implicit edit lattice.

A node is (rows read, grammar state); its edges are the edits that a row and
the state allow, and the heap's key is (cost, audit), audit being the initials
of the edits so far. Two paths to one node of equal cost are no prefixes of
each other, since every edit reads a row or costs something, so the least key
of a node extends to the least keys behind it, and the first accepting end node
that is popped is the answer.

Rows are dealt by ranges of conversation and turn and stream by in chunks of
bounded size. A conversation that lies within one chunk and one partition is
done there. Of the others every chunk is searched by itself from each of the
four states, duplicates are found by grouped counts, and the chunks' sixteen
answers are folded in order, so a conversation of any length, or one that holds
a third of all rows, is cut over many tasks.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread_join

ROWS, CHARS = 256, 1 << 20  # of a chunk; its last text may go beyond
LEAD = 64  # characters of roles and texts by which rows are dealt
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
# The grammar (s?(ua)+)? as states 0 (nothing), 1 (s), 2 (a u is open), 3 (a pair is closed)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEEDS = ("user", "user", "assistant", "user")  # the role to insert or to change to in each state
AFTER = (2, 2, 3, 2)
ACCEPTS = (0, 3)
LEGAL = {"su", "ua", "au"}
RENAME, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3  # costs
GONE, CUT = 1, 2  # faults: to delete, to pay for
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
CHUNKS = "conv_id long, chunk long, open boolean, turns array<long>, roles array<string>, texts array<string>, audit string, cost long, blank long, duplicate long, truncated long, illegal long, gaps long, sha256 string, first string, last string"
NAMES = [c.split()[0] for c in CHUNKS.split(", ")]
TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def search(rows: list[tuple[str, int]], start: int = 0, every: bool = False) -> dict[int, tuple[int, str]]:
    """By end state: least cost and audit of rows (role's initial, fault). Only the first accepting end, or every end that can be reached."""
    heap, settled, ends, n = [(0, "", 0, start)], set(), {}, len(rows)
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in settled:
            continue
        settled.add((i, s))
        if i == n:
            if every:
                ends[s] = (cost, audit)
            elif s in ACCEPTS:
                return {s: (cost, audit)}
        else:
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, s))
            if fault != GONE:
                more = UNFINISHED if fault == CUT else 0
                if (to := STEP.get((s, initial))) is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to))
                heapq.heappush(heap, (cost + more + RENAME, audit + "R", i + 1, AFTER[s]))
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, AFTER[s]))
    return ends


def edited(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits; an audit and the state it starts from say all."""
    out_roles, out_texts, i = [], [], 0
    for edit in audit:
        if edit == "I":
            role, text = NEEDS[state], ""
        else:
            role, text = roles[i], texts[i]
            i += 1
            if edit == "D":
                continue
            if edit == "R":
                role = NEEDS[state]
        state = AFTER[state] if edit != "K" else STEP[state, role[:1]]
        out_roles.append(role)
        out_texts.append(text)
    return out_roles, out_texts


def faults(roles: list[str], texts: list[str], again: set[int] | None = None) -> tuple[list[tuple[str, int]], list[int]]:
    """Each row's initial and fault, and the counts of blank, duplicate and truncated rows and illegal neighbours. ``again``: the rows seen earlier, where that is known."""
    seen, rows, blank, duplicate, truncated = set(), [], 0, 0, 0
    for i, row in enumerate(zip(roles, texts, strict=True)):
        end = row[1].rstrip(SPACE)
        known = i in again if again is not None else row in seen
        seen.add(row)
        if not end:
            blank += 1
        elif known:
            duplicate += 1
        elif end[-1] not in ".!?":
            truncated += 1
        rows.append((row[0][:1], GONE if not end or known else CUT if end[-1] not in ".!?" else 0))
    illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    return rows, [blank, duplicate, truncated, illegal]


def _bytes(roles: list[str], texts: list[str]) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in zip(roles, texts, strict=True)).encode("utf-8", "surrogatepass")


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterable[tuple], schema: str, weight: Callable[[tuple], int] = lambda r: 1, most: int = 1024) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded weight."""
    fields = [f.split() for f in schema.split(", ")]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, TYPES[k]) for c, (_, k) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])

    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _heavy(row: tuple) -> int:
    return 256 + sum(map(len, row[5]))


def _done(conv: int, chunk: int, turns: list, roles: list[str], texts: list[str]) -> tuple:
    rows, counts = faults(roles, texts)
    ((_, (cost, audit)),) = search(rows).items()
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    out = edited(audit, 0, roles, texts)
    return conv, chunk, False, None, *out, audit, cost, *counts, gaps, hashlib.sha256(_bytes(*out)).hexdigest(), None, None


def _scan(rows: int, chars: int) -> Callable:
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows to chunks: done where the conversation lies inside, open where it may go on elsewhere."""

        def chunks() -> Iterator[tuple]:
            k = TaskContext.get().partitionId() << 32
            conv, border, held, size = None, True, ([], [], []), 0
            for c, turn, role, text in _records(batches):
                full = c == conv and (len(held[0]) >= rows or size >= chars)
                if held[0] and (c != conv or full):
                    yield (conv, k, True, *held, *[None] * 10) if border or full else _done(conv, k, *held)
                    k, border, held, size = k + 1, full, ([], [], []), 0
                conv = c
                for column, value in zip(held, (turn, role, text), strict=True):
                    column.append(value)
                size += len(text)
            if held[0]:
                yield (conv, k, True, *held, *[None] * 10)

        return _batches(chunks(), CHUNKS, _heavy, CHARS)

    return scan


SOLVED = "conv_id long, chunk long, roles array<string>, texts array<string>, costs array<long>, audits array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string"


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's answers from every state to every state."""

    def solved() -> Iterator[tuple]:
        for conv, chunk, roles, texts, again in _records(batches):
            rows, counts = faults(roles, texts, set(again or ()))
            ends = [search(rows, s, True) for s in range(4)]
            cells = [ends[s].get(t, (None, None)) for s in range(4) for t in range(4)]
            yield conv, chunk, roles, texts, [c for c, _ in cells], [a for _, a in cells], *counts, rows[0][0], rows[-1][0]

    return _batches(solved(), SOLVED, lambda r: 256 + sum(map(len, r[3])), CHARS)


PLAN = "conv_id long, chunk long, start int, cost long, audit string"


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, chunk, costs, audits) to the state that each chunk starts from, its cost and audit; common beginnings of the four answers are let go."""

    def plans() -> Iterator[tuple]:
        conv, best, steps = None, {}, []

        def walk() -> Iterator[tuple]:
            state = min((t for t in ACCEPTS if t in best), key=lambda t: best[t])
            for chunk, came, cells in reversed(steps):
                start = came[state]
                yield conv, chunk, start, *cells[start, state]
                state = start

        for c, chunk, costs, audits in _records(batches):
            if c != conv:
                if steps:
                    yield from walk()
                conv, best, steps = c, {0: (0, "")}, []
            cells = {(s, t): (costs[4 * s + t], audits[4 * s + t]) for s in best for t in range(4) if costs[4 * s + t] is not None}
            ways = {t: [((best[s][0] + cells[s, t][0], best[s][1] + cells[s, t][1]), s) for s in best if (s, t) in cells] for t in range(4)}
            found = {t: min(w) for t, w in ways.items() if w}
            common = len(os.path.commonprefix([key[1] for key, _ in found.values()]))
            best = {t: (key[0], key[1][common:]) for t, (key, _) in found.items()}
            came = {t: s for t, (_, s) in found.items()}
            steps.append((chunk, came, {(s, t): cells[s, t] for t, s in came.items()}))
        if steps:
            yield from walk()

    return _batches(plans(), PLAN)


def _apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def chunks() -> Iterator[tuple]:
        for conv, chunk, roles, texts, blank, duplicate, truncated, illegal, first, last, start, cost, audit in _records(batches):
            yield conv, chunk, True, None, *edited(audit, start, roles, texts), audit, cost, blank, duplicate, truncated, illegal, None, None, first, last

    return _batches(chunks(), CHUNKS, _heavy, CHARS)


def repair(rows: DataFrame, scratch: Scratch, chunk_rows: int = ROWS, chunk_chars: int = CHARS) -> tuple[DataFrame, DataFrame]:
    """Repaired conversations in chunks, and the gaps (conv_id, gaps) of those with an open one.

    ``rows`` has conv_id (rows without are left out), turn, role and text; null
    roles and texts count as one space. A conversation's rows are ordered by
    turn, null first, then role and text. Each row has the first fault that
    fits: blank (white space only), duplicate (role and text stood before),
    truncated (no end mark last). Blank and duplicate rows are deleted; roles
    then have to read (s?(ua)+)? by their initials, where an empty role and any
    other initial fit nowhere. A conversation may end up without rows.

    Chunks: conv_id, chunk (ordered in a conversation), roles and texts
    (repaired, ``spelled`` makes rows of them), audit, cost, counts of faults.
    """
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    flat = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    leads = [F.substring(c, 1, LEAD).alias(f"lead_{c}") for c in ("role", "text")]
    order = ["conv_id", "turn", "lead_role", "lead_text"]
    dealt = flat.select("*", *leads).repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")
    found = scratch.save(dealt.select("conv_id", "turn", "role", "text").mapInArrow(_scan(chunk_rows, chunk_chars), CHUNKS), "scanned")

    raw = found.where("open").select("conv_id", "chunk", "turns", "roles", "texts")
    pair = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.struct(F.xxhash64(x["roles"], x["texts"]).alias("k1"), F.xxhash64(x["texts"], F.lit("other"), x["roles"]).alias("k2")))
    items = scratch.save(raw.select("conv_id", "chunk", F.posexplode(pair).alias("i", "k")).select("conv_id", "chunk", "i", "k.k1", "k.k2"), "items")
    place = F.struct("chunk", "i")
    firsts = items.groupBy("conv_id", "k1", "k2").agg(F.min(place).alias("was"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = spread_join(items, scratch.save(firsts, "firsts"), ["conv_id", "k1", "k2"], "n").where(place > F.col("was"))
    again = later.groupBy("conv_id", "chunk").agg(F.collect_list("i").alias("again"))  # a chunk's rows at most
    solved = scratch.save(raw.join(again, ["conv_id", "chunk"], "left").select("conv_id", "chunk", "roles", "texts", "again").mapInArrow(_solve, SOLVED), "solved")
    plan = solved.select("conv_id", "chunk", "costs", "audits").repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_fold, PLAN)
    planned = solved.drop("costs", "audits").join(plan, ["conv_id", "chunk"]).mapInArrow(_apply, CHUNKS)
    turns = raw.select("conv_id", F.explode("turns").alias("turn"))
    gaps = turns.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return found.where("not open").unionByName(scratch.save(planned, "planned")), gaps


def spelled(chunks: DataFrame) -> DataFrame:
    """Repaired rows: conv_id, chunk, place in the chunk, role, text."""
    return chunks.select("conv_id", "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row")).select("conv_id", "chunk", "place", F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


TOTALS = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to one row a conversation; a digest's state, the sums and the audit are held."""

    def rows() -> Iterator[tuple]:
        conv = None
        for c, roles, texts, audit, cost, *counts, first, last in _records(batches):
            if c != conv:
                if conv is not None:
                    yield conv, *sums, total, "".join(audits), state.hexdigest()
                conv, sums, total, audits, state, wrote, before = c, [0] * 4, 0, [], hashlib.sha256(), False, None
            sums = [a + b for a, b in zip(sums, counts, strict=True)]
            sums[3] += before is not None and before + first not in LEGAL
            total, before = total + cost, last
            audits.append(audit)
            if roles:
                state.update((b"\n" if wrote else b"") + _bytes(roles, texts))
                wrote = True
        if conv is not None:
            yield conv, *sums, total, "".join(audits), state.hexdigest()

    return _batches(rows(), TOTALS)


def summaries(chunks: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    columns = ["conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256"]
    done = chunks.where("not open").withColumnRenamed("sha256", "repaired_sha256").select(columns)
    parts = chunks.where("open").select("conv_id", "chunk", "roles", "texts", "audit", "cost", *COUNTS, "first", "last")
    streamed = parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").drop("chunk").mapInArrow(_totals, TOTALS)
    return done.union(streamed.join(gaps, "conv_id").select(columns))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after a fault that crc32(conv_id:turn) % 20 chooses: 0 drops a row, 1 empties its text, 2 takes its end marks, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")
