"""Command line: ``run``, a command a stage, ``query``, ``named`` and ``list``."""

from __future__ import annotations

import argparse
import importlib
import json

from .plans import catalogue
from .plans.engine import STAGES, QueryRequest, run_query, run_stages
from .session import session
from .sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerlark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", *STAGES, "embed"):
        stage = sub.add_parser(name, help="run pipeline stages over a tree of files" if name == "run" else f"the stage {name} alone")
        stage.add_argument("--source", required=name != "embed")
        stage.add_argument("--out", required=True)
        stage.add_argument("--overwrite", action="store_true")
        stage.add_argument("--encoder", help="module:function, texts to vectors")
        if name == "run":
            stage.add_argument("--stages", default="listing,chunks")
    q = sub.add_parser("query", help="hybrid query over stored chunks")
    q.add_argument("query")
    q.add_argument("--chunks", required=True)
    q.add_argument("--index", help="folder of a dense index; needs an encoder")
    for name, what in (("encoder", "texts to vectors"), ("scorer", "pairs to relevance"), ("answerer", "prompt to answer")):
        q.add_argument(f"--{name}", help=f"module:function, {what}")
    q.add_argument("--ticker")
    q.add_argument("--form")
    for name, default in (("year", None), ("topk", 8), ("bm25-topk", 200), ("dense-topk", 200), ("ce-candidates", 256), ("max-context-tokens", 2400), ("snippet-chars", 240)):
        q.add_argument(f"--{name}", default=default, type=int)
    for name, default in (("ce-weight", 0.5), ("rrf-k", 60.0), ("w-bm25", 2.0), ("w-dense", 2.0)):
        q.add_argument(f"--{name}", default=default, type=float)
    q.add_argument("--loose", help="apply no filter", action="store_true")
    q.add_argument("--json", action="store_true")
    n = sub.add_parser("named", help="run a registered query")
    n.add_argument("name")
    n.add_argument("--tables", required=True)
    n.add_argument("--limit", type=int, default=20)
    sub.add_parser("list", help="names of registered queries")
    return p


def loaded(name: str | None):
    """The callable that ``module:function`` names."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def request(a: argparse.Namespace) -> QueryRequest:
    return QueryRequest(
        a.query, a.ticker, a.form, a.year, a.topk, a.bm25_topk, a.dense_topk, a.ce_candidates, a.rrf_k, a.w_bm25, a.w_dense, a.ce_weight,
        not a.loose, a.max_context_tokens, loaded(a.encoder), loaded(a.scorer), loaded(a.answerer),
    )


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    spark = session()
    if a.command == "run" or a.command in STAGES or a.command == "embed":
        stages = [s.strip() for s in a.stages.split(",") if s.strip()] if a.command == "run" else [a.command]
        print(json.dumps(run_stages(spark, stages, a.source, a.out, a.overwrite, loaded(a.encoder))))
    elif a.command == "query":
        r = request(a)
        vectors = sinks.read_index(spark, a.index)[0] if a.index else None
        got = run_query(spark.read.parquet(a.chunks), vectors, r)
        if a.json:
            print(json.dumps({"records": [json.loads(x) for x in got.records.toJSON().collect()], "answer": got.answer}, ensure_ascii=False))
        else:
            got.records.show(a.topk, a.snippet_chars)
            if got.answer:
                print(got.answer["answer"])
    else:
        catalogue.QUERIES[a.name](spark, a.tables).show(a.limit, 80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
