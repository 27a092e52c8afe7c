"""Command line: collections under --root, results as JSON."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import SparkSession

from .operators.filters import parse_filter
from .sources.database import Database
from .sources.payloads import from_json
from .types import HybridQuery, InvalidArgument, Metric, SearchQuery, VectariaError, plain_payload, point_id


def vector(text: str) -> list[float]:
    try:
        return [float(x.strip()) for x in text.split(",")]
    except ValueError:
        raise InvalidArgument(f"not a vector: {text!r}") from None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vectaria", description=__doc__)
    p.add_argument("--root", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("create-collection")
    c.add_argument("name"), c.add_argument("--metric", required=True), c.add_argument("--dimension", type=int, required=True), c.add_argument("--index", default="flat")
    for flag in ("--m", "--ef-construction", "--ef-search", "--seed"):
        c.add_argument(flag, type=int)
    sub.add_parser("list")
    for name in ("describe", "drop", "compact"):
        sub.add_parser(name).add_argument("name")
    u = sub.add_parser("upsert")
    u.add_argument("name"), u.add_argument("--id", required=True), u.add_argument("--vector", required=True), u.add_argument("--document"), u.add_argument("--payload")
    d = sub.add_parser("delete")
    d.add_argument("name"), d.add_argument("--id"), d.add_argument("--filter")
    for name in ("search", "search-hybrid"):
        s = sub.add_parser(name)
        s.add_argument("name"), s.add_argument("--vector", required=name == "search"), s.add_argument("-k", type=int, default=10)
        s.add_argument("--metric"), s.add_argument("--filter")
        if name == "search-hybrid":
            s.add_argument("--text"), s.add_argument("--rrf-k", type=float, default=60.0), s.add_argument("--overfetch", type=int, default=4)
    return p


def _hits(df: Any) -> list[dict[str, Any]]:
    return [{"id": r.id, "score": r.score, "payload": plain_payload(r.payload)} for r in df.collect()]  # k rows


def execute(spark: SparkSession, args: argparse.Namespace) -> Any:
    db = Database(spark, args.root)
    node = parse_filter(json.loads(args.filter)) if getattr(args, "filter", None) else None
    match args.command:
        case "create-collection":
            given = {"m": args.m, "ef_construction": args.ef_construction, "ef_search": args.ef_search, "seed": args.seed}
            hnsw = {k: v for k, v in given.items() if v is not None} or None
            return db.create_collection(args.name, args.metric, args.dimension, args.index, hnsw).to_json()
        case "list":
            return db.list_collections()
        case "describe":
            return db.describe_collection(args.name)
        case "drop":
            return {"existed": db.drop_collection(args.name)}
        case "compact":
            return {"points": db.compact(args.name)}
        case "upsert":
            db.upsert(args.name, {"id": point_id(args.id), "vector": vector(args.vector), "document": args.document, "payload": from_json(args.payload) if args.payload else None})
            return {"upserted": 1}
        case "delete":
            if node is not None:
                return {"deleted": db.delete_by_filter(args.name, node)}
            return {"existed": db.delete(args.name, point_id(args.id))}
        case "search":
            return _hits(db.search(args.name, SearchQuery(vector(args.vector), args.k, args.metric and Metric.of(args.metric), node)))
    q = HybridQuery(args.k, args.vector and vector(args.vector), args.text, args.metric and Metric.of(args.metric), node, args.rrf_k, args.overfetch)
    return _hits(db.search_hybrid(args.name, q))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print(json.dumps(execute(spark or SparkSession.builder.getOrCreate(), args)))
    except VectariaError as e:
        print(json.dumps({"error": e.code, "message": str(e)}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
