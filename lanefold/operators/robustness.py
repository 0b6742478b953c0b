"""How far search degrades under noisy queries, and rank verdicts between retrievers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanefold.embedding.pseudo import PseudoEmbedder, mean_pool
from lanefold.functions import noise as N
from lanefold.operators import sparse
from lanefold.operators.search import top_k
from lanefold.operators.sizing import spread, written

# The ship gate's target, and the depth at which an answer is of use.
SHIP_GATE_TARGET = 0.85
USEFUL_K = 10

Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]


def dense_retriever(encode: Callable[[Column], Column]) -> Retriever:
    """Search by one vector per text. Takes queries (qid, text) and documents (did, text)."""

    def search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
        q = queries.select("qid", encode(F.col("text")).alias("qvec"))
        d = spread(docs).select("did", encode(F.col("text")).alias("vec"))
        return top_k(d, q, k, key="did")

    return search


def late_interaction_retriever(encode_tokens: Callable[[Column], Column]) -> Retriever:
    """Search by token vectors."""

    def search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
        q = queries.select("qid", encode_tokens(F.col("text")).alias("qvec")).where(F.size("qvec") > 0)
        d = spread(docs).select("did", encode_tokens(F.col("text")).alias("vec"))
        return top_k(d, q, k, key="did", scorer="late_interaction")

    return search


def pooled_retriever(embedder: PseudoEmbedder) -> Retriever:
    return dense_retriever(lambda text: mean_pool(embedder.encode_tokens(text), embedder.dim))


def sparse_retriever(terms: Callable[[Column], Column]) -> Retriever:
    """Search by weighted terms of texts; exact, without encoding anything."""

    def search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
        return sparse.search(queries, docs, terms, k)

    return search


def degradation_at_k(
    queries: DataFrame,
    retrieve: Retriever,
    *,
    k: int = 10,
    modes: Sequence[str] = N.MODES,
    seed: int = 0,
    others: DataFrame | None = None,
) -> DataFrame:
    """(mode, degradation) per mode and ``overall``; the clean queries are documents, and so are ``others`` (did, text).

    Recall at k of the noisy queries over that of the clean ones, each query's own text
    being its target; 0 when the clean recall is 0. All modes are searched together.
    """
    if k <= 0:
        raise ValueError(f"k must be positive; got {k}")
    docs = queries.select(F.col("qid").alias("did"), "text")
    if others is not None:
        docs = docs.unionByName(others.select("did", "text"))
    n = queries.count()
    if n == 0:
        raise ValueError("no queries")
    kinds = ["clean", *modes]
    queries = spread(queries)
    noisy = queries.select("qid", "text", F.inline(N.variants(F.col("text"), seed=seed))).where(
        F.col("mode").isin(list(modes))
    )
    code = F.element_at(
        F.create_map(*[x for i, m in enumerate(kinds) for x in (F.lit(m), F.lit(i))]), F.col("mode")
    )
    asked = queries.select("qid", F.lit("clean").alias("mode"), "text").unionByName(
        noisy.select("qid", "mode", F.col("noisy").alias("text"))
    )
    width = F.lit(len(kinds)).cast("long")
    asked = written(asked.select((F.col("qid") * width + code).alias("qid"), "text"), "noisy")
    hits = retrieve(asked, docs, k).select(
        F.floor(F.col("qid") / width).alias("own"), (F.col("qid") % width).alias("kind"), "did"
    )
    found = hits.where(F.col("own") == F.col("did")).groupBy("kind").agg(
        (F.count(F.lit(1)) / float(n)).alias("recall")
    )
    # One row per kind at most: from here on everything is one small row, and the search runs once.
    rates = found.agg(F.map_from_entries(F.collect_list(F.struct("kind", "recall"))).alias("m"))

    def rate(kind: int) -> Column:
        return F.coalesce(F.try_element_at("m", F.lit(kind).cast("long")), F.lit(0.0))

    kept = [F.when(rate(0) > 0, rate(i) / rate(0)).otherwise(0.0) for i in range(1, len(kinds))]
    rows = [F.struct(F.lit(m).alias("mode"), d.alias("degradation")) for m, d in zip(modes, kept)]
    mean = sum(kept[1:], kept[0]) / float(len(kept))
    return rates.select(
        F.inline(F.array(*rows, F.struct(F.lit("overall").alias("mode"), mean.alias("degradation"))))
    )


def ship_gate(
    candidate: DataFrame, token_baseline: DataFrame, dense_baseline: DataFrame, target: float = SHIP_GATE_TARGET
) -> DataFrame:
    """One row: overall degradations and whether the candidate reaches the target and beats both."""

    named = {"overall": candidate, "baseline_maxsim": token_baseline, "baseline_dense": dense_baseline}
    rows = [
        df.where(F.col("mode") == "overall").select(F.lit(name).alias("name"), "degradation")
        for name, df in named.items()
    ]
    joined = reduce(DataFrame.unionByName, rows).agg(
        *[F.max(F.when(F.col("name") == name, F.col("degradation"))).alias(name) for name in named]
    )
    c = F.col("overall")
    passes = [c >= target, c > F.col("baseline_maxsim"), c > F.col("baseline_dense")]
    return joined.select(
        F.lit(target).alias("target"),
        "overall",
        "baseline_maxsim",
        "baseline_dense",
        passes[0].alias("passes_absolute"),
        passes[1].alias("beats_maxsim"),
        passes[2].alias("beats_dense"),
        (passes[0] & passes[1] & passes[2]).alias("passes_ship_gate"),
    )


def verdict(candidate: Column, best_baseline: Column, useful_k: int = USEFUL_K) -> Column:
    """Rank of the gold answer against the best baseline's, seen at depth ``useful_k``."""
    return (
        F.when(candidate.isNull() | best_baseline.isNull(), "n/a")
        .when(candidate > best_baseline, "loss")
        .when(candidate == best_baseline, "tie")
        .when((candidate <= useful_k) & (best_baseline > useful_k), "clean_win")
        .when(candidate > useful_k, "graceful")
        .otherwise("tie")
    )


def verdicts(ranks: DataFrame, candidate: str, useful_k: int = USEFUL_K) -> DataFrame:
    """(example_id, candidate_rank, best_baseline, verdict) from (example_id, retriever, rank)."""
    mine = F.col("retriever") == candidate
    return ranks.groupBy("example_id").agg(
        F.min(F.when(mine, F.col("rank"))).alias("candidate_rank"),
        F.min(F.when(~mine, F.col("rank"))).alias("best_baseline"),
    ).withColumn("verdict", verdict(F.col("candidate_rank"), F.col("best_baseline"), useful_k))


def tally(judged: DataFrame) -> DataFrame:
    """One row: number of each verdict; ``n/a`` is not counted."""
    names = {"clean_win": "clean_wins", "tie": "ties", "graceful": "graceful", "loss": "losses"}
    return judged.agg(*[F.count_if(F.col("verdict") == v).alias(n) for v, n in names.items()])


def best_seed(judged: DataFrame, by: Sequence[str], seed: str = "seed", useful_k: int = USEFUL_K) -> DataFrame:
    """Per group the seed to show: a clean win with the widest gap, else the best graceful rank,
    else the best rank; the lowest seed among equals. ``judged`` has candidate_rank, best_baseline.
    """
    kind = verdict(F.col("candidate_rank"), F.col("best_baseline"), useful_k)
    gap = F.col("best_baseline") - F.col("candidate_rank")
    clean = kind == "clean_win"
    priority = F.struct(
        F.when(clean, 0).when(kind == "graceful", 1).otherwise(2).alias("class"),
        F.when(clean, -gap).otherwise(F.lit(0)).cast("long").alias("gap"),
        F.col("candidate_rank").cast("long").alias("rank"),
        F.col(seed).alias(seed),
    )
    return judged.groupBy(*by).agg(F.min(priority).alias("_best")).select(
        *by, F.col(f"_best.{seed}").alias(seed), F.col("_best.rank").alias("candidate_rank")
    )


def gold_ranks(scores: DataFrame, gold: DataFrame, key: str = "did") -> DataFrame:
    """(qid, rank): place of the gold document among scored ones, ties by key.

    Documents ahead of the gold one are counted per query, on the map side first; nothing is sorted.
    """
    target = scores.join(gold.select("qid", F.col("gold").alias(key)), ["qid", key]).select(
        "qid", F.col("score").alias("_s"), F.col(key).alias("_k")
    )
    ahead = (F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col(key) < F.col("_k")))
    return scores.join(target, "qid").groupBy("qid").agg(
        (F.count_if(ahead) + 1).alias("rank")
    )
