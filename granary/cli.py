"""Command line: datasets, drift, indexes and searches."""

from __future__ import annotations

import argparse
import json
import sys

from granary import session
from granary.sources import connectors, dataset, datasets_dir, files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="granary", description=__doc__)
    p.add_argument("--cores", default="*")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("list", help="registered connectors")
    d = sub.add_parser("dataset").add_subparsers(dest="what", required=True)
    x = d.add_parser("build")
    x.add_argument("--folder", required=True), x.add_argument("--out", required=True), x.add_argument("--name", default="corpus")
    x.add_argument("--chunk-size", type=int, default=1000), x.add_argument("--chunk-overlap", type=int, default=200)
    for name in ("export", "audit", "check", "sync"):
        x = d.add_parser(name)
        x.add_argument("--connector", default="table"), x.add_argument("--params", type=json.loads, default={})
        if name != "export":
            x.add_argument("--dataset", required=True)
        if name in ("export", "sync"):
            x.add_argument("--out", required=True), x.add_argument("--name", default="corpus")
        if name in ("audit", "sync"):
            x.add_argument("--label", default=""), x.add_argument("--host", default="")
        if name == "check":
            x.add_argument("--snapshot-at", help="an ISO-8601 time with a zone")
            x.add_argument("--sample-percent", type=float, default=0), x.add_argument("--seed", type=int, default=0)
        if name == "sync":
            x.add_argument("--audit")
        if name == "audit":
            x.add_argument("--no-record", action="store_true")
    for name in ("audits", "verify"):
        d.add_parser(name).add_argument("--dataset", required=True)
    d.add_parser("list").add_argument("--dir")
    x = sub.add_parser("datasets-dir")
    x.add_argument("--set"), x.add_argument("--unset", action="store_true"), x.add_argument("--json", action="store_true")
    x = sub.add_parser("validate", help="conformance of a backend")
    x.add_argument("--connector", default="table"), x.add_argument("--params", type=json.loads, default={}), x.add_argument("--vector", type=json.loads), x.add_argument("--skip-stability", action="store_true"), x.add_argument("--top-k", type=int, default=5)
    x = sub.add_parser("provision", help="build a table store from a dataset")
    x.add_argument("--dataset", required=True), x.add_argument("--store", required=True), x.add_argument("--embedder", required=True, help="module:function"), x.add_argument("--append", action="store_true")
    i = sub.add_parser("index").add_subparsers(dest="what", required=True)
    x = i.add_parser("prepare")
    x.add_argument("--dataset", required=True), x.add_argument("--stopword", action="append", default=[])
    i.add_parser("status").add_argument("--dataset", required=True)
    for name, args in {"search": (), "neighbors": ("chunk",), "outline": ("doc",), "copies": ("chunk",), "sql": ("statement",), "lookup": ("query",), "signal-lookup": ("query",)}.items():
        x = i.add_parser(name)
        for a in args:
            x.add_argument(a, nargs="?" if name == "sql" else None)
        if name == "sql":
            x.add_argument("--schema", action="store_true", help="list tables and columns"), x.add_argument("--full", action="store_true", help="do not shorten cells")
        x.add_argument("--dataset", required=True), x.add_argument("--filter", type=json.loads), x.add_argument("--json", action="store_true"), x.add_argument("--limit", type=int, default=20)
        if name == "search":
            for flag in ("term", "any", "not", "phrase", "regex", "substring", "module", "doc", "exclude-doc", "type"):
                x.add_argument(f"--{flag}", action="append", default=[])
            x.add_argument("--near", nargs="+", action="append", default=[]), x.add_argument("--within", type=int, default=10)
            x.add_argument("--titles", action="store_true"), x.add_argument("--general", action="store_true"), x.add_argument("--substring-terms", action="store_true")
        if name == "neighbors":
            x.add_argument("--radius", type=int, default=1)
    return p


def show(df, as_json: bool, limit: int | None = None) -> None:
    rows = df.limit(limit).collect() if limit is not None else df.collect()
    for r in rows:
        print(json.dumps(r.asDict(True), ensure_ascii=False, default=str) if as_json else " | ".join("" if v is None else str(v) for v in r))


def _index(spark, a):
    from granary.operators.search import SearchIndex

    data = dataset.read(spark, a.dataset, verify=False)
    return data, SearchIndex.open(spark, f"{a.dataset}/analysis/search/tables", data.manifest["core_sha256"], getattr(a, "filter", None))


def run(a: argparse.Namespace) -> int:
    if a.verb == "list":
        connectors.discover()
        for s in connectors.specs().values():
            print(json.dumps(s.public()))
        return 0
    if a.verb == "datasets-dir":
        if a.set or a.unset:
            datasets_dir.set_dir(a.set)
        path, why = datasets_dir.resolve()
        print(json.dumps({"path": str(path), "source": why}) if a.json else path)
        return 0
    if a.verb == "dataset" and a.what == "list":
        for e in datasets_dir.entries(a.dir):
            print(e["folder"], e["dataset_id"] or "-", e["chunk_count"] if e["problem"] is None else e["problem"])
        return 0
    spark = session.local_session(a.cores)
    session.ship(spark)
    if a.verb == "dataset":
        return _dataset(spark, a)
    if a.verb == "validate":
        from granary.operators import checks

        queries = spark.createDataFrame([("probe", [float(v) for v in a.vector])], "query_id string, vector array<double>") if a.vector else None
        connect = lambda: connectors.connect(spark, a.connector, a.params)
        report = checks.validate_connector(connect(), queries, a.top_k, a.params, None if a.skip_stability else connect, not a.skip_stability)
        show(report.orderBy("n"), False)
        return 0 if checks.ready(report) else 2
    if a.verb == "provision":
        from importlib import import_module

        module, _, name = a.embedder.partition(":")
        print(connectors.provision(dataset.read(spark, a.dataset).chunks, a.store, getattr(import_module(module), name), a.append).count())
        return 0
    from granary.operators import book, search
    from granary.plans.sql_surface import SqlSurface

    if a.what == "prepare":
        data = dataset.read(spark, a.dataset)
        search.build(data.chunks, f"{a.dataset}/analysis/search/tables", data.manifest["core_sha256"])
        dataset.write_envelope(data, "analysis", "search", {"artifact": "tables"})
        book.BookIndex(data.chunks, tuple(a.stopword)).write(f"{a.dataset}/analysis/book/tables", data.manifest["core_sha256"])
        dataset.write_envelope(data, "analysis", "book", {"artifact": "tables", "stopwords": a.stopword})
        return 0
    if a.what == "status":
        core = dataset.read(spark, a.dataset, verify=False).manifest["core_sha256"]
        for name, opened in (("search", lambda: _index(spark, a)), ("book", lambda: book.BookIndex.open(spark, f"{a.dataset}/analysis/book/tables", core))):
            try:
                opened()
                print(f"{name}: current")
            except search.SearchIndexMissing:
                print(f"{name}: missing")
            except search.StaleSearchIndex:
                print(f"{name}: stale")
        return 0
    if a.what == "signal-lookup":
        from granary.operators import signals

        show(signals.find(spark.read.parquet(f"{a.dataset}/analysis/signals/results"), a.query), a.json, a.limit)
        return 0
    data, index = _index(spark, a)
    if a.what == "search":
        near = [(*terms, a.within) for terms in a.near]
        found = index.search(
            a.term, a.any, a.__dict__["not"], a.phrase, near, a.regex, a.substring, not a.substring_terms, a.module, a.general, a.doc, a.exclude_doc, a.type, a.titles, a.limit,
        )
        print(f"{found.shown} of {found.total} hits", file=sys.stderr)
        show(found.hits, a.json)
    elif a.what == "neighbors":
        show(index.neighbors(a.chunk, a.radius), a.json)
    elif a.what == "outline":
        show(index.outline(a.doc), a.json)
    elif a.what == "copies":
        show(index.copies(a.chunk), a.json)
    elif a.what == "lookup":
        scope = index.chunks.select("chunk_id") if index.scope else None
        opened = book.BookIndex.open(spark, f"{a.dataset}/analysis/book/tables", data.manifest["core_sha256"])
        show(opened.lookup(a.query, scope), a.json)
        show(opened.lookup_threads(a.query, scope), a.json)
    else:
        tables = {t: index.table(t) for t in ("chunks", "copy_groups", "overlap_pairs")}
        if a.schema or not a.statement:
            for name, table in tables.items():
                print(name, ", ".join(f"{c} {t}" for c, t in table.dtypes))
            return 0
        found = SqlSurface(spark, tables, index).run(a.statement, a.limit, shorten=not a.full)
        print("\t".join(found.columns))
        for r in found.rows:
            print("\t".join("" if v is None else str(v) for v in r))
    return 0


def _dataset(spark, a) -> int:
    from pyspark.sql import functions as F

    from granary.operators import audit, chunker

    if a.what == "build":
        chunks = chunker.number_globally(chunker.chunk_documents(files.load_documents(spark, a.folder), a.chunk_size, a.chunk_overlap))
        made = dataset.write(chunks, a.out, a.name, {"method": "separators", "chunk_size": a.chunk_size, "chunk_overlap": a.chunk_overlap})
        print(made.dataset_id, made.manifest["chunk_count"])
        return 0
    if a.what in ("audits", "verify"):
        data = dataset.read(spark, a.dataset)
        print(json.dumps(dataset.list_audits(data) if a.what == "audits" else {"dataset_id": data.dataset_id, "verified": data.verified}))
        return 0
    backend = connectors.connect(spark, a.connector, a.params)
    if a.what == "export":
        made = dataset.write(backend.chunks(), a.out, a.name, {"method": "exported"})
        print(made.dataset_id)
        return 0
    data = dataset.read(spark, a.dataset)
    if a.what == "audit":
        found = audit.audit(data.chunks, backend.chunks())
        recorded = None if a.no_record else dataset.record_audit(data, found, a.connector, a.label, a.host)
        print(json.dumps({"in_sync": found.in_sync, "signals": found.signals, "audit_id": recorded}))
    elif a.what == "check":
        kinds = {r[0]: r[1] for r in audit.structure(data.chunks, backend.chunks()).groupBy("difference").count().collect()}
        out = {"dataset_chunks": data.chunks.count(), "backend_chunks": backend.count(), "structure": kinds}
        if a.sample_percent:
            drawn = audit.sampled_text_changes(data.chunks, backend.chunks(), a.sample_percent, a.seed)
            out["sample"] = {r[0]: r[1] for r in drawn.groupBy("state").agg(F.count("*")).collect()}
        if a.snapshot_at:
            state = backend.check_snapshot(a.snapshot_at)
            out["snapshot"] = {"status": state.status, "detail": state.detail}
        print(json.dumps(out))
    else:
        print(dataset.sync(data, backend.chunks(), a.out, a.audit, a.name, {"label": a.label, "host": a.host}).dataset_id)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return run(a)
    except (ValueError, RuntimeError, OSError) as e:
        print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
