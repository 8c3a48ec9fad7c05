"""Exact nearest neighbours of 64-bit codes by incremental multi-index hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallycast.llm.graph import written

BITS = 64
K = 10
SCAN_BLOCK = 256
KEY = ["query", "several", "own"]


def sign_codes(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``[id, code]``: bit i is set if the components i, i + 64, i + 128 ... sum to more than zero.

    Null or empty vectors and ones with null or non-finite components, and rows without an id, have no code and are left out.
    """
    vector = F.col(vector_column).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(F.col(id_column).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)))
    turns = F.sequence(F.lit(0), F.ceil((F.size(vector) - 1) / BITS).cast("int"))
    zeros = F.array_repeat(F.lit(0.0), BITS)
    totals = F.aggregate(turns, zeros, lambda sums, i: F.zip_with(
        sums, F.slice(vector, i * BITS + 1, BITS), lambda a, x: a + F.coalesce(x, F.lit(0.0))))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bits = F.transform(totals, lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(none))
    code = F.aggregate(bits, none, lambda a, b: a.bitwiseOR(b))
    return good.select(F.col(id_column).cast("long").alias("id"), code.alias("code"))


def segments_for(n: int) -> int:
    """The number of segments: 8, 4 or 2, near 64 bits over the logarithm of the number of codes."""
    return 8 if n < 1 << 11 else 4 if n < 1 << 22 else 2


def _segment(code: Column, i: Column, width: int) -> Column:
    return F.call_function("shiftrightunsigned", code, (i * width).cast("int")).bitwiseAND(F.lit((1 << width) - 1))


def _slot(segment: Column, value: Column, width: int) -> Column:
    return F.call_function("shiftleft", segment.cast("long"), F.lit(width)).bitwiseOR(value)


def _probes(queries: DataFrame, m: int, width: int, radius: int) -> DataFrame:
    """``queries [*KEY, within]`` with every ``segment`` and every ``slot`` whose value has ``radius`` bits unlike the query's.

    Bits are turned one after another, each above the last, so the masks are rows that Spark makes as it goes, in as many tasks
    as a shuffle has.
    """
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = queries.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).repartition(tasks, *KEY, "segment")
    rows = segments.select("*", _segment(F.col("query"), F.col("segment"), width).alias("value"), F.lit(0).alias("next"))
    for _ in range(radius):
        later = F.when(F.col("next") < width, F.sequence(F.col("next"), F.lit(width - 1)))
        turned = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
        rows = rows.withColumn("bit", F.explode(later)).select(
            *KEY, "within", "segment", F.col("value").bitwiseXOR(turned).alias("value"), (F.col("bit") + 1).alias("next"))
    return rows.select(*KEY, "within", "segment", _slot(F.col("segment"), F.col("value"), width).alias("slot"))


def _usable(met: DataFrame) -> DataFrame:
    """Codes met by queries: without those that hold only the query's own id, which never counts as first."""
    own = F.col("several") & (F.col("first") == F.col("own"))
    found = met.withColumn("first", F.when(own, F.col("second")).otherwise(F.col("first"))).where("first is not null")
    return found.select(*KEY, "code", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).alias("distance"), "first",
                        F.when(F.col("several"), F.lit(1)).otherwise(F.col("n")).alias("n"))


def _best(pool: DataFrame, wanted: int) -> DataFrame:
    """The ``wanted`` codes of each query that come first by distance, then smallest id: its first rows are among them."""
    order = W.partitionBy(*KEY).orderBy("distance", "first")
    return pool.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted).drop("place")


def _scanned(queries: DataFrame, entries: DataFrame, wanted: int) -> DataFrame:
    """The best codes of each query by comparing it with all codes, in blocks of 256 queries.

    A query ``[*KEY, within]`` needs no code beyond ``within``. The first pass only counts codes by distance and finds the
    distance within which a query has enough; the second keeps the codes within it.
    """
    n = queries.count()
    blocks = -(-n // SCAN_BLOCK)
    groups = written(queries.withColumn("block", F.pmod(F.xxhash64(*KEY), F.lit(blocks)).cast("int")).groupBy("block").agg(
        F.collect_list(F.struct(*KEY, "within")).alias("queries")), "blocks")

    def met(held: DataFrame) -> DataFrame:
        pairs = entries.crossJoin(held).withColumn("q", F.explode("queries")).select("code", "first", "second", "n", "q.*")
        near = pairs.where(F.bit_count(F.col("query").bitwiseXOR(F.col("code"))) <= F.col("within"))
        return _usable(near)

    counts = met(groups).groupBy(*KEY, "distance").agg(F.count(F.lit(1)).alias("codes"))
    running = F.sum("codes").over(W.partitionBy(*KEY).orderBy("distance"))
    within = counts.withColumn("running", running).groupBy(*KEY).agg(
        F.coalesce(F.min(F.when(F.col("running") >= wanted, F.col("distance"))), F.lit(BITS)).alias("within"))
    nearer = within.withColumn("block", F.pmod(F.xxhash64(*KEY), F.lit(blocks)).cast("int")).groupBy("block").agg(
        F.collect_list(F.struct(*KEY, "within")).alias("queries"))
    return _best(met(written(nearer, "blocks")), wanted)


def hamming_top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``[query_id, rank, id, distance]``: the k nearest other rows of every query ``[id, code]`` among ``codes [id, code]``.

    Order is by distance, then id; fewer than k rows come back only where the table has fewer. Rows with the query's id
    are not its neighbours. Equal codes are one entry with its k + 1 smallest different ids, each as often as it occurs, up to
    k + 1 times, and equal queries are searched once; a query whose id has several rows is searched on its own, without them.
    Rows of the queries that share an id give one list, as pairs in SQL would.

    Each code stands once per segment of its bits in an index without ids. Round r looks up all segment values at distance r
    from the query's, in every segment. A code is taken only in the first (radius, segment) that meets it, so none comes twice,
    and only if it is no farther than the last of the k + 1 codes the query already has.
    After round r every code within m r + m - 1 (m segments) has been met; a query is finished when the distance of its last
    wanted row is within that. Only the unfinished go on, as long as a round looks up fewer values than there are codes;
    what is left then is compared with all codes. Each round keeps the best k + 1 codes of a query, limited before the
    shuffle; ids are joined to them at the end. Values and index meet by a sort-merge join: Spark's size check takes the queries'
    size for that of the values made of them, and would send all of these through the driver.
    """
    wanted = k + 1
    small = W.partitionBy("code").orderBy("id")
    known = codes.where("id is not null and code is not null")
    counted = known.groupBy("code", "id").agg(F.count(F.lit(1)).alias("n"))
    ids = counted.withColumn("place", F.row_number().over(small)).where(F.col("place") <= wanted).groupBy("code").agg(
        F.array_sort(F.collect_list(F.struct("id", F.least("n", F.lit(wanted)).cast("int").alias("n")))).alias("ids"))
    ids = written(ids, "codes")
    rows_held = F.aggregate("ids", F.lit(0), lambda a, x: a + x["n"])
    entries = ids.select("code", F.col("ids")[0]["id"].alias("first"), F.get("ids", F.lit(1))["id"].alias("second"),
                         F.least(rows_held, F.lit(wanted)).alias("n"))
    several = known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(True).alias("several"))
    n_codes, n_rows = entries.count(), known.count()
    m = segments_for(n_codes)
    width = BITS // m
    index = written(entries.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select(
        _slot(F.col("segment"), _segment(F.col("code"), F.col("segment"), width), width).alias("slot"), "code", "first", "second", "n"), "segments")
    asked = queries.where("id is not null and code is not null").select("id", F.col("code").alias("query"))
    asked = asked.join(several, "id", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    asked = written(asked.withColumn("own", F.when(F.col("several"), F.col("id")).otherwise(F.lit(0).cast("long"))), "asked")
    open_ = written(asked.select(*KEY).distinct().withColumn("within", F.lit(BITS)), "queries")
    best, results, radius = None, [], 0
    while radius <= width and m * math.comb(width, radius) < n_codes and not open_.isEmpty():
        met = _probes(open_, m, width, radius).join(index.hint("merge"), "slot")
        differ = F.col("query").bitwiseXOR(F.col("code"))
        near = [F.bit_count(_segment(differ, F.lit(i), width)) for i in range(m)]
        earlier = [(d < radius) | ((d == radius) & (F.col("segment") > i)) for i, d in enumerate(near)]
        first = ~earlier[0]
        for condition in earlier[1:]:
            first = first & ~condition
        found = _usable(met.where(first & (F.bit_count(differ) <= F.col("within"))))
        best = written(_best(found if best is None else found.unionByName(best), wanted), "best")
        running = F.sum("n").over(W.partitionBy(*KEY).orderBy("distance", "first").rowsBetween(W.unboundedPreceding, 0))
        last = best.withColumn("running", running).where(F.col("running") >= min(wanted, n_rows)).groupBy(*KEY).agg(F.min("distance").alias("far"))
        finished = written(last.where(F.col("far") <= m * radius + m - 1).select(*KEY), "finished")
        results.append(best.join(finished, KEY, "left_semi"))
        best = best.join(finished, KEY, "left_anti")
        known_far = best.groupBy(*KEY).agg(F.count(F.lit(1)).alias("codes"), F.max("distance").alias("far"))
        within = F.when(F.col("codes") >= wanted, F.col("far")).otherwise(F.lit(BITS)).alias("within")
        open_ = open_.select(*KEY).join(finished, KEY, "left_anti").join(known_far, KEY, "left")
        open_ = written(open_.select(*KEY, F.coalesce(within, F.lit(BITS)).alias("within")), "queries")
        radius += 1
    if not open_.isEmpty():
        results.append(_scanned(open_, entries, wanted))
    if not results:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0).alias("distance")).limit(0)
    lists = results[0]
    for more in results[1:]:
        lists = lists.unionByName(more)
    held = lists.select(*KEY, "code", "distance").join(ids, "code").select(*KEY, "distance", F.explode("ids").alias("row"))
    copies = F.explode(F.array_repeat(F.lit(True), F.col("row.n")))
    held = held.select(*KEY, "distance", "row.id", copies.alias("copy")).where(~F.col("several") | (F.col("id") != F.col("own"))).drop("copy")
    order = W.partitionBy(*KEY).orderBy("distance", "id")
    held = held.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near"))
    own = asked.withColumnRenamed("id", "query_id").join(written(held, "neighbours"), KEY)
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    hits = own.select("query_id", F.explode(others).alias("hit")).select("query_id", "hit.id", "hit.distance")
    best_first = W.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def embedding_top_k(vectors: DataFrame, k: int = K, every: int = 50) -> DataFrame:
    """The k nearest codes of every vector whose id is divisible by ``every``, as ``[query_id, rank, vec_id, distance]``."""
    codes = written(sign_codes(vectors), "codes")
    return hamming_top_k(codes, codes.where(F.col("id") % every == 0), k).withColumnRenamed("id", "vec_id")


TOP_K = """
WITH codes AS (
    SELECT vec_id, list_sum([CASE WHEN x > 0 THEN (1::HUGEINT << (i - 1)::INT) ELSE 0::HUGEINT END FOR x, i IN embedding])::UBIGINT AS code
    FROM embeddings
), pairs AS (
    SELECT q.vec_id AS query_id, v.vec_id, bit_count(xor(q.code, v.code))::INT AS distance
    FROM codes q JOIN codes v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""
