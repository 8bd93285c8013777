"""Command line: ``python -m lattica VERB INPUT [OUTPUT] [--option value ...]`` over mesh files.

Verbs are the steps of the pipeline, which write a mesh, and the reports, which
print a table or write it. Values are read as JSON where they can be, else as
text. ``verbs`` lists them all with their options.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .mesh import MeshFrame
from .operators.shapes import PRIMITIVES, generate
from .plans.pipeline import STEPS, apply_step, run_pipeline
from .plans.reports import REPORTS, report
from .sources.files import encoded, graph_format_for_path, read_index, read_indexed, read_mesh, read_metadata, write_graph, write_tables
from .sources.raw import FORMATS, by_path, sniff

INDEXES = (".pvd", ".pvtu", ".pvtp", ".pvti", ".pvtr", ".pvts", ".vtm")


def value(text: str):
    """JSON where it is JSON, else the text."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


def options_of(words: list[str]) -> dict:
    """``--name value`` pairs; a name alone is true, dashes in names are underscores."""
    out: dict = {}
    k = 0
    while k < len(words):
        if not words[k].startswith("--"):
            raise SystemExit(f"{words[k]!r} is no option")
        name = words[k][2:].replace("-", "_")
        if k + 1 < len(words) and not words[k + 1].startswith("--"):
            out[name] = value(words[k + 1])
            k += 2
        else:
            out[name] = True
            k += 1
    return out


def table_of_verbs() -> list[str]:
    """One line for each verb: its name, what must be given, and what may be."""
    rows = {n: (s[0], s[1]) for n, s in STEPS.items()} | {n: (r[0], r[1]) for n, r in REPORTS.items()}
    return [f"{n}: {' '.join(f'--{o}' for o in sorted(rows[n][0]))} {' '.join(f'[--{o}]' for o in sorted(rows[n][1]))}".rstrip() for n in sorted(rows)]


def loaded(spark: SparkSession, path: str, format_: str | None, whole: bool = False) -> MeshFrame:
    mesh = read_indexed(spark, path) if path.endswith(INDEXES) else read_mesh(spark, path, format_, points_only=not whole)
    return mesh.with_(regions=None)


def shown(df: DataFrame, output: str | None) -> None:
    if output:
        df.write.parquet(output)
    else:
        df.show(100, False)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lattica", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("verb", choices=sorted({*STEPS, *REPORTS, "info", "convert", "run", "graph_file", "detect", "formats", "index", "generate", "verbs", "completion"}))
    parser.add_argument("input", nargs="?")
    parser.add_argument("output", nargs="?")
    parser.add_argument("settings", nargs="?")
    parser.add_argument("--format", choices=sorted(FORMATS))
    parser.add_argument("--to", choices=sorted(FORMATS))
    a, rest = parser.parse_known_args(argv)
    options = options_of(rest)
    if a.verb == "verbs":
        print("\n".join(table_of_verbs()))
        return
    if a.verb == "completion":
        print(f"complete -W '{' '.join(sorted({*STEPS, *REPORTS}))}' lattica")
        return
    if a.verb == "formats":
        print("\n".join(f"{n}\t{' '.join(f.extensions)}\t{'r' if f.read else '-'}{'w' if f.write else '-'}" for n, f in sorted(FORMATS.items())))
        return
    if a.input is None:
        parser.error("an input is needed")
    if a.verb == "detect":
        with open(a.input, "rb") as f:
            head = f.read(200)
        named, seen = by_path(a.input), sniff(head)
        ranked = [(n, 1.0) for n in named if n in seen] + [(n, 0.6) for n in seen if n not in named] + [(n, 0.4) for n in named if n not in seen]
        print("\n".join(f"{n}\t{c}\t{'extension and content' if c == 1 else 'content' if c == 0.6 else 'extension'}" for n, c in ranked))
        return
    spark = SparkSession.builder.appName("lattica").getOrCreate()
    if a.verb == "info":
        shown(read_metadata(spark, a.input, a.format), a.output)
    elif a.verb == "index":
        shown(read_index(spark, a.input), a.output)
    elif a.verb == "generate":
        if a.input not in PRIMITIVES:
            parser.error(f"{a.input!r} is none of {', '.join(sorted(PRIMITIVES))}")
        mesh = generate(spark, a.input, **{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()})
        write_tables(mesh, a.output or a.input)
    elif a.verb == "convert":
        if a.to is None or a.output is None:
            parser.error("convert needs an output and --to")
        encoded(loaded(spark, a.input, a.format), a.to).write.parquet(a.output)
    elif a.verb == "graph_file":
        graph = report(loaded(spark, a.input, a.format), "graph", {k: v for k, v in options.items() if k == "kind"})
        n = loaded(spark, a.input, a.format).points.count()
        write_graph(graph, n, a.output, options.get("dialect") or graph_format_for_path(a.output))
    elif a.verb == "run":
        write_tables(run_pipeline(loaded(spark, a.input, a.format), Path(a.settings or "settings.json").read_text()), a.output)
    elif a.verb in REPORTS:
        shown(report(loaded(spark, a.input, a.format), a.verb, options), a.output)
    else:
        write_tables(apply_step(loaded(spark, a.input, a.format), {"op": a.verb, **options}), a.output)


if __name__ == "__main__":
    main()
