"""Command line: ``python -m lanefold.cli <command>``."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold import plans
from lanefold.embedding.pseudo import PseudoEmbedder
from lanefold.operators import corpus as C, evaluation as E, frames as K, ledger as L, profiling as R
from lanefold.operators import robustness as B, search, stub
from lanefold.operators.sizing import written
from lanefold.schemas import LANE_DIMS
from lanefold.service import QueryRequest, open_service
from lanefold.session import build_session
from lanefold.sinks import reports, tables
from lanefold.sources import ledger as ledger_source, tasks as task_source, texts, vectors

RESERVED = ("baseline", "slice", "mode", "operator", "time_budget", "dres_url")


def lanes_of(csv: str, dim: int | None = None) -> dict[str, int]:
    """Declared lanes named in a comma-separated list, in declared order; an unknown one is an error."""
    wanted = [s.strip() for s in csv.split(",") if s.strip()]
    unknown = sorted(set(wanted) - set(LANE_DIMS))
    if unknown:
        raise ValueError(f"unknown field(s) {unknown}; known: {', '.join(LANE_DIMS)}")
    return {n: dim or d for n, d in LANE_DIMS.items() if n in wanted}


def _encoders(lanes: dict[str, int]) -> dict[str, PseudoEmbedder]:
    return {lane: PseudoEmbedder(dim) for lane, dim in lanes.items()}


def _print(document) -> None:
    print(json.dumps(document, ensure_ascii=False, indent=2, default=str))


def cmd_eval(spark: SparkSession, a: argparse.Namespace) -> None:
    given = [n for n in RESERVED if getattr(a, n) is not None]
    if given:
        raise ValueError(f"--{given[0].replace('_', '-')} is reserved")
    stamp = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    out = a.output or f"eval-results/{a.system}/{stamp}"
    tasks = task_source.read_tasks(spark, a.tasks)
    answers = stub.answer(tasks, a.seed)
    timed = tasks.join(answers.groupBy("task_id").agg(F.max("elapsed_ms").alias("elapsed_ms")), "task_id", "left")
    scores = E.score_tasks(timed, answers.drop("elapsed_ms"), E.truth_of(tasks))
    document = reports.write_evaluation(scores, out, a.system, stamp, a.tasks)
    _print({"output": out, "overall": document["overall"]})


def cmd_ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    dims = lanes_of(a.fields, a.dim)
    lanes = vectors.read_index(spark, a.index_root, dims)
    if a.video:
        lanes = lanes.where(F.col("video_id") == a.video)
    frames = K.align_lanes(lanes, dims)
    meta = vectors.read_metadata(spark, a.metadata) if a.metadata else spark.createDataFrame(
        [], "pk string, youtube_url string, description string, od_tags array<string>"
    )
    frames = K.checked_strings(K.enrich(frames, meta))
    tables.write_index(frames, a.uri)
    _print({"collection": a.uri, "n_rows": spark.read.parquet(a.uri).count(), "fields": list(dims)})


def cmd_search(spark: SparkSession, a: argparse.Namespace) -> None:
    index = spark.read.parquet(a.uri)
    encoder = PseudoEmbedder(a.dim or LANE_DIMS[a.field])
    asked = spark.createDataFrame([(0, a.query)], "qid long, text string").select(
        "qid", encoder.encode_text(F.col("text")).alias("qvec")
    )
    where = search.filter_sql(a.expr, index.columns) if a.expr else None
    hits = search.top_k(index, asked, a.top_k, vec=a.field, carry=("video_id", "frame_id"), where=where, dim=encoder.dim)
    for row in hits.orderBy("rank").collect():
        print(f"{row['rank']:4d} {row['score']:.6f} {row['pk']}")


def cmd_query(spark: SparkSession, a: argparse.Namespace) -> None:
    lanes = lanes_of(a.lanes, a.dim)
    service = open_service(spark, a.uri, _encoders(lanes))
    _print(service.respond(QueryRequest(a.query, tuple(lanes), a.top_k, a.fusion, a.rrf_k)))


def cmd_frame(spark: SparkSession, a: argparse.Namespace) -> None:
    _print(open_service(spark, a.uri, _encoders(lanes_of("siglip2"))).frame_detail(a.pk))


def cmd_embed(spark: SparkSession, a: argparse.Namespace) -> None:
    listing = spark.read.format("binaryFile").load(a.input).select("path", "content")
    images = listing.where(F.lower(F.substring_index("path", ".", -1)).isin(*texts.IMAGE_SUFFIXES))
    _print({"rows": tables.write_vectors(images, PseudoEmbedder(a.dim), a.output)})


def cmd_corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    named = [(p, lambda p=p: _ordered(texts.read_strings(spark, p))) for p in a.sources]
    rows, used, skipped = C.union_sources(named)
    if rows is None:
        raise ValueError(f"no clean strings collected; skipped {skipped}")
    clean = C.first_spellings(rows, "text", ["source_ord", "ord"])
    clean = clean.select(C.seeded_order(F.concat_ws("|", "source_ord", "ord"), a.seed).alias("ord"), "text")
    n = tables.write_pairs(
        C.contrastive_pairs(clean, k=a.k, hard_negatives_per_anchor=a.hard_negatives, seed=a.seed), a.output
    )
    _print({"pairs": n, "used": used, "skipped": skipped})


def _ordered(rows: DataFrame) -> DataFrame:
    place = F.concat_ws("|", "path", F.lpad(F.col("block").cast("string"), 20, "0"), F.lpad(F.col("at").cast("string"), 20, "0"), F.lpad(F.col("pos").cast("string"), 10, "0"))
    return rows.select(place.alias("ord"), "text")


def cmd_robustness(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = texts.held_out_or_file(spark, a.queries, None)
    asked = rows.select(F.monotonically_increasing_id().alias("qid"), "text").limit(a.max_queries)
    asked = written(asked, "queries")  # keeps the ids the same in every search
    wide, narrow = PseudoEmbedder(64), PseudoEmbedder(16)
    scored = {
        "tokens": B.degradation_at_k(asked, B.late_interaction_retriever(wide.encode_tokens), k=a.k, seed=a.seed),
        "tokens_narrow": B.degradation_at_k(asked, B.late_interaction_retriever(narrow.encode_tokens), k=a.k, seed=a.seed),
        "pooled": B.degradation_at_k(asked, B.pooled_retriever(wide), k=a.k, seed=a.seed),
    }
    document = {n: {r["mode"]: r["degradation"] for r in df.collect()} for n, df in scored.items()}
    document["ship_gate"] = B.ship_gate(*scored.values(), a.target).first().asDict()
    reports.write_json(document, a.output) if a.output else _print(document)


def cmd_calibrate(spark: SparkSession, a: argparse.Namespace) -> None:
    def profile(path: str | None) -> DataFrame | None:
        return R.require_strings(R.profile_text(texts.read_strings(spark, path), [], "text")) if path else None

    anchors = None
    synthetic = None
    if a.pairs:
        pairs = texts.read_pairs(spark, a.pairs).select("anchor_clean").distinct()
        anchors = R.profile_text(pairs, [], "anchor_clean")
        noisy = R.profile_noise(pairs, "anchor_clean", "anchor_clean", seed=a.seed)
        synthetic = noisy.where(F.col("mode") == "mixed_ocr")
    row = R.calibration_flags(anchors, profile(a.queries), synthetic, profile(a.ocr)).first()
    document = {"flags": row["flags"], "verdict": row["verdict"]}
    reports.write_json(document, a.output) if a.output else _print(document)


def cmd_ledger(spark: SparkSession, a: argparse.Namespace) -> None:
    for row in ledger_source.read_ledger(spark, a.ledger, a.limit, a.job).collect():
        print(row["started_at"], row["run_id"], row["exit_code"])


def cmd_preflight(spark: SparkSession, a: argparse.Namespace) -> None:
    L.require_prefixes(ledger_source.object_keys(spark, a.root), a.prefixes)
    print("ok")


def cmd_run(spark: SparkSession, a: argparse.Namespace) -> None:
    plans.resolve(a.name)(spark, a.tables).show(a.rows, truncate=80)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lanefold")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, fn, *arguments):
        p = sub.add_parser(name)
        p.set_defaults(fn=fn)
        for flags, options in arguments:
            p.add_argument(*flags.split(), **options)

    need = {"required": True}
    number = {"type": int}
    command(
        "eval", cmd_eval, ("--tasks", need), ("--system", need), ("--output", {}), ("--seed", {"type": int, "default": 42}),
        *[(f"--{n.replace('_', '-')}", {}) for n in RESERVED],
    )
    fields = {"default": ",".join(LANE_DIMS)}
    command("ingest", cmd_ingest, ("--uri", need), ("--index-root", need), ("--video", {}), ("--fields", fields), ("--metadata", {}), ("--dim", number))
    command("search", cmd_search, ("--uri", need), ("--field", {"default": "siglip2"}), ("--query", need), ("--top-k", {"type": int, "default": 10}), ("--expr", {}), ("--dim", number))
    command(
        "query", cmd_query, ("--uri", need), ("--query", need), ("--lanes", {"default": "siglip2"}), ("--top-k", {"type": int, "default": 48}),
        ("--fusion", {"default": "single"}), ("--rrf-k", {"type": int, "default": 60}), ("--dim", number),
    )
    command("frame", cmd_frame, ("--uri", need), ("--pk", need))
    command("embed", cmd_embed, ("--input", need), ("--output", need), ("--dim", {"type": int, "default": 64}))
    command(
        "corpus", cmd_corpus, ("--sources", {"nargs": "+", **need}), ("--output", need), ("--k", number),
        ("--hard-negatives", {"type": int, "default": 7}), ("--seed", {"type": int, "default": 0}),
    )
    command(
        "robustness", cmd_robustness, ("--queries", need), ("--output", {}), ("--k", {"type": int, "default": 10}),
        ("--max-queries", {"type": int, "default": 5000}), ("--seed", {"type": int, "default": 0}), ("--target", {"type": float, "default": B.SHIP_GATE_TARGET}),
    )
    command("calibrate", cmd_calibrate, ("--queries", {}), ("--ocr", {}), ("--pairs", {}), ("--output", {}), ("--seed", {"type": int, "default": 0}))
    command("ledger", cmd_ledger, ("--ledger", need), ("--limit", {"type": int, "default": 100}), ("--job", {}))
    command("preflight", cmd_preflight, ("--root", need), ("prefixes", {"nargs": "*"}))
    command("run", cmd_run, ("name", {"choices": plans.known(), "metavar": "NAME"}), ("--tables", need), ("--rows", {"type": int, "default": 20}))
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build_session()
    try:
        a.fn(spark, a)
    except (ValueError, FileNotFoundError, KeyError, L.PreflightError) as exc:
        print(f"error: {exc}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
