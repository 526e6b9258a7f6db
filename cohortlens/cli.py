"""Command line: build an index from documents, query it, print its funnel."""

from __future__ import annotations

import argparse
from pathlib import Path

from cohortlens.functions.lexicon import Lexicon
from cohortlens.plans import analytics, normalize, serving, views
from cohortlens.session import session
from cohortlens.sources import records, registry

#: Mechanism tables, empty unless a deployment loads them (plans/enrich.py).
MECHANISMS = {
    "chembl_moa": "asset_id string, mechanism_of_action string, action_type string, target_symbols array<string>, moa_key string",
    "asset_curated_moa": "asset_id string, moa_label string, action string, target_symbols array<string>, modality string, moa_key string",
    "asset_enrichment": "asset_id string, moa_class string, action string, targets_canonical array<string>, targets_raw array<string>, modality string, abstained boolean, moa_key string",
}


def load(spark, folder: str) -> dict:
    return registry.read_tables(spark, folder, sorted(p.name for p in Path(folder).iterdir() if p.is_dir()))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cohortlens")
    parser.add_argument("--master", default="local[*]")
    todo = parser.add_subparsers(dest="todo", required=True)
    build = todo.add_parser("build", help="documents (a zip archive or folder) to an index")
    build.add_argument("documents")
    build.add_argument("index")
    build.add_argument("--lexicons")
    build.add_argument("--limit", type=int)
    sql = todo.add_parser("sql", help="one SELECT over the views")
    sql.add_argument("index")
    sql.add_argument("text")
    sql.add_argument("--format", choices=["table", "csv"], default="table")
    funnel = todo.add_parser("funnel", help="what is left after each step")
    funnel.add_argument("index")
    args = parser.parse_args(argv)
    spark = session(args.master)
    if args.todo == "build":
        raw = registry.flatten(registry.parse(registry.read_members(spark, args.documents, args.limit)).persist())
        registry.write_tables(raw, args.index)
        raw = registry.read_tables(spark, args.index, list(raw))
        registry.check_counts(registry.read_members(spark, args.documents, args.limit), raw)
        made = normalize.normalize(raw, Lexicon.from_folder(args.lexicons) if args.lexicons else None)
        new = {k: v for k, v in made.items() if k not in raw} | {"build_meta": registry.snapshot_date(raw["studies"])}
        registry.write_tables(new | {name: spark.createDataFrame([], schema) for name, schema in MECHANISMS.items()}, args.index)
        print(records.as_text(registry.drop_census(raw)))
        return 0
    tables = load(spark, args.index)
    if args.todo == "funnel":
        print(records.as_text(analytics.funnel(tables)))
        return 0
    for name, view in views.VIEWS.items():
        view(tables).createOrReplaceTempView(name)
    print(records.as_text(spark.sql(serving.validate_sql(spark, args.text, views.VIEWS)), args.format))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
