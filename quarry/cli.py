"""Command line: python -m quarry.cli index ROOT STORE | search|pack|symbols|imports|cards|map|related|affected|graph|stats|audit|repair STORE [TEXT]."""

from __future__ import annotations

import argparse
import json
import sys


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices="index search pack symbols imports cards map related affected graph stats audit repair".split())
    p.add_argument("place")
    p.add_argument("text", nargs="*")
    p.add_argument("--limit", type=int, default=5)
    p.add_argument("--mode", default="")
    p.add_argument("--languages", default="all")
    a = p.parse_args(args)

    from pyspark.sql import SparkSession

    from .operators.memory import Memory
    from .sources import files

    spark = SparkSession.builder.appName("quarry").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "index":
        files.build(files.crawl(spark, a.place, files.Options(languages=a.languages))).save(a.text[0])
        return 0
    m, said = Memory(files.Index.load(spark, a.place)), " ".join(a.text)
    found = {
        "search": lambda: m.search(said, a.mode, a.limit),
        "pack": lambda: m.pack(said, a.mode, a.limit),
        "symbols": lambda: m.symbol_context(said, a.limit)[0],
        "imports": lambda: m.import_context(said, a.limit),
        "cards": lambda: m.cards(said, a.limit),
        "map": lambda: m.repo_map(a.limit),
        "related": lambda: m.related(said, a.limit),
        "affected": lambda: m.affected(a.text, a.limit),
        "graph": lambda: m.dependency_graph(said)["imports"],
        "stats": m.stats,
        "audit": m.audit,
        "repair": lambda: m.repair_pack(sys.stdin.read(), said, a.limit),
    }[a.command]()
    for row in found.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
