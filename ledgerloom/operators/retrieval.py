"""Retrieval of memories by vector: top-k, greedy diversity re-ranking, per-tier quotas.

`nearest`, `mmr_over` and `tiered_over` take queries and items and never build
their pairs: each task multiplies its batches of items with a block of queries
of bounded bytes, and hands on only the best of each query. Re-ranking is lazy:
once something is picked, the score of a candidate can only fall, so a pool of
the POOL best by their last score is enough until a pick would score below the
pool's last; then one more pass fills the pool again. So picks are exact over
all items, in a few passes however many are asked for.

The other functions work on scored pairs.

A batch of queries is one plan: the queries' side is small by contract and
checked before it is broadcast (`QUERY_LIMIT` rows); beyond it, blocks of
queries are joined one after the other. Candidates are cut to the best `pool`
of each query before any list is built, so a list is bounded by the pool.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.kernels import RETRIEVAL_ORDER, as_doubles, dot, norm

QUERY_LIMIT = 4096
# Default weights of relevance against redundancy, and quotas.
LAMBDAS = {"tip": 0.65, "skill": 0.80, "tool": 0.85, "trajectory": 0.75}
GLOBAL_LAMBDA = 0.75
QUOTAS = {"tip": 18, "skill": 18, "tool": 6, "trajectory": 4}


def scored(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Every query (query_id, vector) with every item (id, vector, ...): similarity; vectors of both are valid and of one dimension.

    Queries are dealt in blocks of QUERY_LIMIT by rank, so that what is sent to
    every task is bounded.
    """
    n = queries.count()
    unit = lambda v: F.transform(v, lambda x: x / norm(v))
    items = items.withColumn("vector", unit(as_doubles(F.col("vector"))))
    queries = queries.select("query_id", unit(as_doubles(F.col("vector"))).alias("query_vector"))
    if n > QUERY_LIMIT:
        blocks = -(-n // QUERY_LIMIT) * 2
        queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        sides = [queries.where(F.col("block") == b).drop("block") for b in range(blocks)]
    else:
        sides = [queries]
    out = None
    for side in sides:
        one = items.join(F.broadcast(side), F.lit(True)).withColumn("similarity", dot(F.col("query_vector"), F.col("vector"))).drop("query_vector")
        out = one if out is None else out.unionByName(one)
    return out


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar items of each query, by similarity and then id, with rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pick(chosen: Column, pool: Column, k: Column, weight: float) -> Column:
    """Greedily adds up to k of the pool to `chosen` (array of structs id, similarity, vector): best weight * similarity - (1 - weight) * redundancy."""

    def step(state: Column, _: Column) -> Column:
        rest = F.filter(pool, lambda c: ~F.exists(state, lambda s: s["id"] == c["id"]))

        def ranked(c: Column) -> Column:
            near = F.array_max(F.transform(state, lambda s: dot(s["vector"], c["vector"])))
            score = F.lit(weight) * c["similarity"] - F.lit(1 - weight) * F.coalesce(near, F.lit(0.0))
            return F.struct((-score).alias("a"), (-c["similarity"]).alias("b"), c["id"].alias("c"), c.alias("item"))

        return F.when(F.size(rest) > 0, F.concat(state, F.array(F.array_min(F.transform(rest, ranked))["item"]))).otherwise(state)

    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(steps, chosen, step)


def mmr(candidates: DataFrame, k: int, weight: float) -> DataFrame:
    """Greedy re-ranking of each query's candidates (query_id, id, similarity, vector): query_id, id, rank."""
    item = F.struct("id", "similarity", "vector")
    pools = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("pool"))
    empty = F.filter("pool", lambda c: F.lit(False))
    picked = pools.select("query_id", F.posexplode(_pick(empty, F.col("pool"), F.lit(k), weight)).alias("pos", "c"))
    return picked.select("query_id", F.col("c.id").alias("id"), (F.col("pos") + 1).alias("rank"))


def scaled_quotas(quotas: dict[str, int], top: int) -> dict[str, int]:
    """Largest-remainder scaling where the quotas exceed the total; ties by tier name."""
    total = sum(quotas.values())
    if total <= top:
        return dict(quotas)
    out = {t: q * top // total for t, q in quotas.items()}
    by_rest = sorted(quotas, key=lambda t: (-(quotas[t] * top % total), t))
    for tier in by_rest[: top - sum(out.values())]:
        out[tier] += 1
    return out


def scaled_quota_table(quotas: DataFrame, top: int) -> DataFrame:
    """The same for a table (tier, quota): tier, scaled."""
    total = F.col("total")
    whole = quotas.crossJoin(quotas.agg(F.sum("quota").alias("total")))  # one row
    whole = whole.withColumn("base", F.floor(F.col("quota") * top / total)).withColumn("rest", F.pmod(F.col("quota") * top, total))
    left = whole.crossJoin(whole.agg((F.lit(top) - F.sum("base")).alias("left")))
    place = F.row_number().over(Window.orderBy(F.desc("rest"), "tier"))
    scaled = F.when(total <= top, F.col("quota")).otherwise(F.col("base") + (place <= F.col("left")).cast("int"))
    return left.select("tier", scaled.cast("long").alias("scaled"))


def _of_tier(pool: Column, tier: str) -> Column:
    return F.filter(pool, lambda c: c["tier"] == tier)


def tiered(candidates: DataFrame, top: int, quotas: dict[str, int] = QUOTAS, lambdas: dict[str, float] = LAMBDAS, overall: float = GLOBAL_LAMBDA) -> DataFrame:
    """Per-tier picks in retrieval order, each tier on its own, then a global fill that compares with all picks: query_id, id, rank."""
    item = F.struct("id", "similarity", "vector", "tier")
    pools = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("pool"))
    quota = scaled_quotas(quotas, top)
    picks = F.filter("pool", lambda c: F.lit(False))
    for tier in RETRIEVAL_ORDER:
        own = _of_tier(F.col("pool"), tier)
        none = F.filter("pool", lambda c: F.lit(False))
        picks = F.concat(picks, _pick(none, own, F.lit(quota.get(tier, 0)), lambdas.get(tier, 0.75)))
    pools = pools.withColumn("picks", picks)
    filled = _pick(F.col("picks"), F.col("pool"), F.lit(top) - F.size("picks"), overall)
    return pools.select("query_id", F.posexplode(filled).alias("pos", "c")).select("query_id", F.col("c.id").alias("id"), (F.col("pos") + 1).alias("rank"))


def _round(candidates: DataFrame, picks: dict, quota: dict, weights: dict) -> list:
    """The best further candidate of each (query_id, part), given all picks so far: one pass, one row for each."""
    spark = candidates.sparkSession
    kinds = dict(candidates.dtypes)
    rows = [(q, part, [p.id for p in own], [p.vector for p in own]) for (q, part), own in picks.items()]
    held = spark.createDataFrame(rows, f"query_id {kinds['query_id']}, part string, ids array<{kinds['id']}>, vectors array<array<double>>")
    limits = spark.createDataFrame([(part, n, weights[part]) for part, n in quota.items()], "part string, quota int, weight double")
    joined = candidates.join(F.broadcast(limits), "part").join(F.broadcast(held), ["query_id", "part"], "left")
    joined = joined.where(F.coalesce(F.size("ids"), F.lit(0)) < F.col("quota")).where(~F.coalesce(F.array_contains("ids", F.col("id")), F.lit(False)))
    near = F.coalesce(F.array_max(F.transform("vectors", lambda v: dot(v, F.col("vector")))), F.lit(0.0))
    score = F.col("weight") * F.col("similarity") - (1 - F.col("weight")) * near
    order = F.struct((-score).alias("a"), (-F.col("similarity")).alias("b"), F.col("id").alias("c"))
    best = joined.groupBy("query_id", "part").agg(F.min_by(F.struct("id", "vector"), order).alias("p"))
    return best.select("query_id", "part", "p.id", "p.vector").collect()


def _greedy(candidates: DataFrame, quota: dict, weights: dict, picks: dict) -> dict:
    """Rounds until every part has its quota or no candidate is left; picks: (query_id, part) to rows in order.

    The scored candidates are kept for the rounds; what an executor loses is computed again.
    """
    candidates = candidates.persist()
    for _ in range(max(quota.values(), default=0)):
        found = _round(candidates, picks, quota, weights)
        if not found:
            break
        for row in found:
            picks.setdefault((row.query_id, row.part), []).append(row)
    candidates.unpersist()
    return picks


def _as_ranks(candidates: DataFrame, picks: dict) -> DataFrame:
    kinds = dict(candidates.dtypes)
    rows = [(q, row.id, i + 1) for (q, _), own in picks.items() for i, row in enumerate(own)]
    return candidates.sparkSession.createDataFrame(rows, f"query_id {kinds['query_id']}, id {kinds['id']}, rank int")


def mmr_rounds(candidates: DataFrame, k: int, weight: float) -> DataFrame:
    """`mmr` over any number of candidates (query_id, id, similarity, vector), without a pool.

    Each pick is one pass over the candidates that ends in one row for each
    query; what is broadcast and comes back is k picks of each query at most.
    For more queries than QUERY_LIMIT call it block by block.
    """
    rows = candidates.withColumn("part", F.lit("all"))
    return _as_ranks(candidates, _greedy(rows, {"all": k}, {"all": weight}, {}))


def tiered_rounds(candidates: DataFrame, top: int, quotas: dict[str, int] = QUOTAS, lambdas: dict[str, float] = LAMBDAS, overall: float = GLOBAL_LAMBDA) -> DataFrame:
    """`tiered` over any number of candidates (query_id, id, similarity, vector, tier): all tiers advance in the same rounds, then the global fill."""
    quota = {t: n for t, n in scaled_quotas(quotas, top).items() if n > 0}
    own = _greedy(candidates.withColumnRenamed("tier", "part"), quota, {t: lambdas.get(t, 0.75) for t in quota}, {})
    whole: dict = {}
    for tier in RETRIEVAL_ORDER:
        for (q, part), rows in own.items():
            if part == tier:
                whole.setdefault((q, "all"), []).extend(rows)
    rest = candidates.drop("tier").withColumn("part", F.lit("all"))
    return _as_ranks(candidates, _greedy(rest, {"all": top}, {"all": overall}, whole))


#: Candidates that one pass keeps for each query, and bytes of queries and picks that are sent to every task.
POOL, HELD_BYTES = 64, 32 << 20


def _units(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype(float)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _blocks(queries: DataFrame, held: int) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and unit vectors of the queries, in blocks of at most HELD_BYTES with `held` vectors for each."""
    facts = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dimension")).first()
    n = -(-facts.n * (facts.dimension or 0) * 8 * (held + 1) // HELD_BYTES)
    for b in range(n):
        rows = queries.select("query_id", as_doubles(F.col("vector")).alias("vector")).where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).orderBy("query_id").toPandas()
        if len(rows):
            yield rows["query_id"].tolist(), _units(rows["vector"])


def _first(score: np.ndarray, similarity: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
    """Places of the m best: by score, then similarity, then id; minus infinity is never one."""
    at = np.flatnonzero(score > -np.inf)
    if len(at) > m:
        at = at[score[at] >= np.partition(score[at], len(at) - m)[len(at) - m]]
    return at[np.lexsort((ids[at], -similarity[at], -score[at]))][:m]


def _schema(items: DataFrame, queries: DataFrame) -> tuple[str, str]:
    return dict(queries.dtypes)["query_id"], dict(items.dtypes)["id"]


def nearest(queries: DataFrame, items: DataFrame, k: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """The k most similar items (id, vector) of each query (query_id, vector), by similarity and then id: query_id, id, carried columns, similarity, rank."""
    query_kind, id_kind = _schema(items, queries)
    kinds = dict(items.dtypes)
    schema = ", ".join([f"query_id {query_kind}", f"id {id_kind}", *(f"{c} {kinds[c]}" for c in carry), "similarity double"])
    rows, out = items.select("id", "vector", *carry), None

    def over(names: list, matrix: np.ndarray):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    similarity, ids = matrix @ _units(frame["vector"]).T, frame["id"].to_numpy()
                    best = [_first(row, row, ids, k) for row in similarity]
                    at, q = np.concatenate(best), np.repeat(np.arange(len(names)), [len(b) for b in best])
                    yield pd.DataFrame({"query_id": [names[i] for i in q], "id": ids[at], **{c: frame[c].to_numpy()[at] for c in carry}, "similarity": similarity[q, at]})

        return run

    for names, matrix in _blocks(queries, 0):
        one = rows.mapInPandas(over(names, matrix), schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = items.sparkSession.createDataFrame([], schema)
    return top_k(out, k)


class _Held:
    """Picks of a block of queries so far: ids and vectors by query and part, and what each part still wants."""

    def __init__(self, names: list, matrix: np.ndarray, quota: dict[str, int], weights: dict[str, float]) -> None:
        self.names, self.matrix, self.quota, self.weights = names, matrix, quota, weights
        self.picks: dict[tuple, list[tuple]] = {}
        self.closed: set[tuple] = set()

    def open(self, key: tuple) -> int:
        return 0 if key in self.closed else self.quota[key[1]] - len(self.picks.get(key, ()))

    def scores(self, key: tuple, similarity: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        own, weight = self.picks.get(key, ()), self.weights[key[1]]
        if not own:
            return weight * similarity
        near = (np.stack([v for _, v in own]) @ vectors.T).max(0)
        return np.where(np.isin(ids, [i for i, _ in own]), -np.inf, weight * similarity - (1 - weight) * near)


def _pass(items: DataFrame, held: _Held, schema: str) -> DataFrame:
    """Of each open query and part the POOL best candidates (only one while nothing is picked), best first."""
    size = lambda key: POOL if held.picks.get(key) else 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            vectors, ids, parts = _units(frame["vector"]), frame["id"].to_numpy(), frame["part"].to_numpy()
            for part in held.quota:
                mine = np.flatnonzero(parts == part) if part != "all" else np.arange(len(ids))
                for q, name in enumerate(held.names):
                    if len(mine) and held.open((name, part)) > 0:
                        similarity = vectors[mine] @ held.matrix[q]
                        score = held.scores((name, part), similarity, vectors[mine], ids[mine])
                        best = _first(score, similarity, ids[mine], size((name, part)))
                        yield pd.DataFrame({"query_id": [name] * len(best), "part": part, "id": ids[mine][best], "similarity": similarity[best], "score": score[best], "vector": pd.Series(list(vectors[mine][best]), dtype=object)})

    found = items.mapInPandas(run, schema)
    order = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), F.desc("similarity"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= POOL)


def _settle(pools: DataFrame, held: _Held, query_kind: str, id_kind: str) -> list:
    """The picks that the pools decide, in order: each beats whatever was left out of its pool."""

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("place", kind="stable")
        key = (pool["query_id"].iloc[0], pool["part"].iloc[0])
        key = (key[0].item() if hasattr(key[0], "item") else key[0], key[1])
        ids, similarity, vectors = pool["id"].to_numpy(), pool["similarity"].to_numpy(), np.stack(pool["vector"].to_numpy())
        whole = len(pool) < POOL and bool(held.picks.get(key))  # nothing was left out
        bound = (-pool["score"].iloc[-1], -similarity[-1], ids[-1])
        own = _Held([key[0]], held.matrix[:0], held.quota, held.weights)
        own.picks[key] = list(held.picks.get(key, ()))
        out = []
        for _ in range(held.open(key)):
            score = own.scores(key, similarity, vectors, ids)
            best = _first(score, similarity, ids, 1)
            if not len(best) or not whole and (-score[best[0]], -similarity[best[0]], ids[best[0]]) > bound:
                break
            own.picks[key].append((ids[best[0]], vectors[best[0]]))
            out.append(best[0])
            if not held.picks.get(key):
                break  # the first pick's pool is itself
        n = len(out)
        return pd.DataFrame({"query_id": [key[0]] * n, "part": [key[1]] * n, "place": range(n), "id": ids[out], "vector": pd.Series(list(vectors[out]), dtype=object), "last": [whole] * n})

    found = pools.groupBy("query_id", "part").applyInPandas(run, f"query_id {query_kind}, part string, place int, id {id_kind}, vector array<double>, last boolean")
    return found.orderBy("query_id", "part", "place").collect()  # at most what a block of queries may hold


def _picked(items: DataFrame, held: _Held, query_kind: str, id_kind: str) -> None:
    schema = f"query_id {query_kind}, part string, id {id_kind}, similarity double, score double, vector array<double>"
    while any(held.open((n, p)) > 0 for n in held.names for p in held.quota):
        found = _settle(_pass(items, held, schema), held, query_kind, id_kind)
        seen = set()
        for row in found:
            held.picks.setdefault((row.query_id, row.part), []).append((row.id, np.asarray(row.vector)))
            seen.add((row.query_id, row.part))
            if row.last:
                held.closed.add((row.query_id, row.part))
        held.closed |= {(n, p) for n in held.names for p in held.quota if (n, p) not in seen}


def _ranks(spark, rows: list[tuple], query_kind: str, id_kind: str) -> DataFrame:
    return spark.createDataFrame(rows, f"query_id {query_kind}, id {id_kind}, rank int")


def mmr_over(queries: DataFrame, items: DataFrame, k: int, weight: float) -> DataFrame:
    """`mmr` of every query (query_id, vector) over all items (id, vector): query_id, id, rank."""
    query_kind, id_kind = _schema(items, queries)
    rows, out = items.select("id", "vector", F.lit("all").alias("part")), []
    for names, matrix in _blocks(queries, k):
        held = _Held(names, matrix, {"all": k}, {"all": weight})
        _picked(rows, held, query_kind, id_kind)
        out.append([(n, i, r + 1) for n in names for r, (i, _) in enumerate(held.picks.get((n, "all"), ()))])
    return _ranks(items.sparkSession, [row for block in out for row in block], query_kind, id_kind)


def tiered_over(queries: DataFrame, items: DataFrame, top: int, quotas: dict[str, int] = QUOTAS, lambdas: dict[str, float] = LAMBDAS, overall: float = GLOBAL_LAMBDA) -> DataFrame:
    """`tiered` of every query over all items (id, vector, tier): the tiers pick side by side, then the global fill."""
    query_kind, id_kind = _schema(items, queries)
    quota = {t: n for t, n in scaled_quotas(quotas, top).items() if n > 0}
    rows, out = items.select("id", "vector", F.col("tier").alias("part")), []
    for names, matrix in _blocks(queries, 2 * top):
        own = _Held(names, matrix, quota, {t: lambdas.get(t, 0.75) for t in quota})
        _picked(rows, own, query_kind, id_kind)
        fill = _Held(names, matrix, {"all": top}, {"all": overall})
        fill.picks = {(n, "all"): [p for t in RETRIEVAL_ORDER for p in own.picks.get((n, t), ())] for n in names}
        _picked(rows, fill, query_kind, id_kind)
        out += [(n, i, r + 1) for n in names for r, (i, _) in enumerate(fill.picks[n, "all"])]
    return _ranks(items.sparkSession, out, query_kind, id_kind)


def cache_lookup(texts: DataFrame, cache: DataFrame, revision: str) -> tuple[DataFrame, DataFrame]:
    """Texts (pos, text) against a cache (cache_key, embedding): hits in input order (pos, text, embedding), and distinct misses (cache_key, text)."""
    keyed = texts.withColumn("cache_key", F.sha2(F.concat(F.lit(revision), F.lit("\0"), F.col("text")), 256))
    found = keyed.join(cache, "cache_key", "left")
    misses = keyed.join(cache, "cache_key", "left_anti").select("cache_key", "text").distinct()
    return found.select("pos", "text", "embedding"), misses
