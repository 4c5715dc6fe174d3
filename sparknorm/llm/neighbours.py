"""Approximate nearest neighbours: queries visit the partitions that a classifier names.

The partitions are learned on a bounded sample (``partitions``); every row is
indexed. Equal vectors are one class with its few smallest ids, so a vector
that fills a third of the table is one point of the index. Classes go to their
most probable partition, which is cut into blocks of bounded size; a query goes
to several partitions, and blocks of queries meet blocks of classes, each pair
a row of its own. A pair yields the best few classes of each query with cosines
in double precision, so reranking gathers little.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import partitions
from .common import Scratch, spread_join
from .embedding_dedup import even

SAMPLE = 8192  # vectors the partitions are fitted on, at most
FLOATS = 1 << 21  # and their numbers, at most
PER_PART = 256  # classes of a partition at least, up to 2 ** LEVELS partitions
LEVELS = 7
RECALL = 0.93  # of the sample's vectors set aside; denser rows have nearer neighbours, found sooner
BLOCK, QUERIES = 1 << 18, 256  # numbers of a block of classes; queries of a block


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def classes_of(rows: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Distinct vectors of rows (vec_id, v, k1, k2): k1, k2, ids (the k + 1 smallest, repeats counted), v, dim, cid."""
    first = Window.partitionBy("k1", "k2").orderBy("vec_id")  # a filter on row_number: only so many rows a task are shuffled
    few = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    found = few.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    return scratch.save(found.withColumns({"dim": F.size("v"), "cid": F.monotonically_increasing_id()}), "classes")


def learn(classes: DataFrame, recall: float = RECALL, sample: int = SAMPLE) -> tuple[int, partitions.Router | None]:
    """The commonest dimension and a router fitted on a sample of its vectors, chosen by hash."""
    common = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if not common:
        return 0, None
    dim, n = common
    most = max(64, min(sample, FLOATS // dim))
    # twice the sample by hash, of which the smallest hashes: the driver gets at most the sample
    near = classes.where((F.col("dim") == dim) & (F.pmod("k1", F.lit(1 << 30)) < min(1.0, 2 * most / n) * (1 << 30)))
    x = np.array([r["v"] for r in near.orderBy("k1", "k2").limit(most).select("v").collect()], float)
    levels = min(LEVELS, max(1, int(np.log2(max(2, n // PER_PART)))))
    return dim, partitions.fit(partitions.unit(even(x)), levels, recall)


def _matrix(column: pa.Array) -> np.ndarray:
    return even(np.stack([np.asarray(v, float) for v in column.to_numpy(zero_copy_only=False)]))


def nearest(vectors: DataFrame, queries: Column, scratch: Scratch, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` chooses, the k nearest found of all other rows.

    Nearness is the cosine; equal ones are ordered by id. Vectors that are null,
    empty, zero or hold null or non-finite components take no part, nor do rows
    without an id. Vectors of another dimension than the query's are no
    candidates; those of any but the commonest dimension are searched in full.
    Rows count, not ids: of two rows with one id each is the other's candidate.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit("second"), "v")})
    classes = classes_of(rows.select("vec_id", "v", "k1", "k2"), k, scratch)
    asking = scratch.save(rows.where("asks").select("k1", "k2", "vec_id"), "asking")
    main, router = learn(classes, recall, sample)

    def route(several: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
                own = np.flatnonzero(dims == main)
                parts = np.zeros((len(dims), 1), np.int64).tolist()
                if len(own):
                    x = partitions.unit(_matrix(batch.column(batch.schema.get_field_index("v")).take(pa.array(own))))
                    found = router.visited(x) if several else router.part(x)[:, None]
                    for i, p in zip(own.tolist(), found.tolist(), strict=True):
                        parts[i] = p
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int64()))], [*batch.schema.names, "parts"])

        return run

    def packed(df: DataFrame, per: Column, name: str) -> DataFrame:
        """Rows (cid, ids, v, dim, parts) as blocks: dim, part, a block id, and the block's columns as bytes."""
        flat = scratch.save(df.select("cid", "ids", "v", "dim", F.explode("parts").alias("part")), f"placed_{name}")
        counts = scratch.save(flat.groupBy("dim", "part").agg(F.count(F.lit(1)).alias("n")), f"counts_{name}")
        dealt = spread_join(flat, counts.withColumn("blocks", F.ceil(F.col("n") / per)), ["dim", "part"], "n")
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("blocks"))).drop("blocks")

        def gather(pdf: pd.DataFrame) -> pd.DataFrame:
            first = pdf.iloc[:1][["dim", "part"]]
            ids = pdf["ids"].to_list()
            return first.assign(cids=pdf["cid"].to_numpy("<i8").tobytes(), x=np.concatenate(pdf["v"].to_list()).astype("<f8").tobytes(), low=np.array([i[0] for i in ids], "<i8").tobytes())

        got = dealt.groupBy("dim", "part", "chunk").applyInPandas(gather, "dim int, part long, cids binary, x binary, low binary")
        return scratch.save(got.withColumn(f"{name}id", F.monotonically_increasing_id()), name)

    shape = "cid long, ids array<long>, v array<double>, dim int"
    base = classes.select("cid", "ids", "v", "dim")
    per = F.greatest(F.lit(64), F.expr(f"{block} div dim"))
    index = packed(base.mapInArrow(route(False), f"{shape}, parts array<long>"), per, "c")
    asked = classes.join(asking.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("cid", "ids", "v", "dim")
    wanted = packed(asked.mapInArrow(route(True), f"{shape}, parts array<long>"), F.lit(QUERIES), "q")

    pairs = wanted.select("dim", "part", "qid").join(index.select("dim", "part", "cid"), ["dim", "part"]).select("qid", "cid")
    met = pairs.join(wanted.select("qid", "dim", F.col("cids").alias("qs"), F.col("x").alias("qx")), "qid").join(index.select("cid", "cids", "x", "low"), "cid")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, c = (even(np.frombuffer(r[n]).reshape(-1, r["dim"])) for n in ("qx", "x"))
                low, qs, cs = (np.frombuffer(r[n], "<i8") for n in ("low", "qs", "cids"))
                nq, nc = (np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (q, c))
                s = (q / nq[:, None]) @ (c / nc[:, None]).T
                most = min(k + 1, len(c))  # the query's own class may be one of them
                i, j = np.nonzero(s >= np.partition(s, len(c) - most, axis=1)[:, len(c) - most, None] - 1e-12)
                for m in range(0, len(i), 1 << 16):  # scores of equal vectors are equal whatever the block
                    a, b = i[m : m + (1 << 16)], j[m : m + (1 << 16)]
                    s[a, b] = (q[a] * c[b]).sum(axis=1) / (nq[a] * nc[b])
                order = np.lexsort((low[j], -s[i, j], i))
                i, j = i[order], j[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < most
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array(qs[i]), pa.array(cs[j]), pa.array(low[j]), pa.array(s[i, j])], ["qid", "cid", "low", "score"])

    found = met.select("qs", "qx", "dim", "cids", "x", "low").mapInArrow(compare, "qid long, cid long, low long, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "low")
    few = scratch.save(found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n", "low"), "few")
    spelled = few.join(classes.select("cid", "ids"), "cid").select("qid", "score", (F.col("qid") == F.col("cid")).alias("own"), F.explode("ids").alias("id"))
    lists = spelled.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "id", "own"))).alias("hits"))  # (k + 1) ** 2 at most
    lists = lists.join(classes.select(F.col("cid").alias("qid"), "k1", "k2"), "qid").join(asking.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")), ["k1", "k2"])
    answered = spread_join(asking, scratch.save(lists.select("k1", "k2", "hits", "n"), "lists"), ["k1", "k2"], "n")
    itself = F.array_position(F.transform("hits", lambda h: h["own"] & (h["id"] == F.col("vec_id"))), F.lit(True))
    others = answered.withColumn("at", itself).withColumn("hits", F.slice(F.filter("hits", lambda h, i: i + 1 != F.col("at")), 1, k))
    return others.select(F.col("vec_id").alias("query_id"), F.posexplode("hits").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
