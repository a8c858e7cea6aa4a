"""python -m chronoweave DATA_DIR COMMAND [ARGUMENT...]"""

from __future__ import annotations

import sys

from chronoweave.api import FactGraph, as_json
from chronoweave.session import build_session

COMMANDS = {
    "health": lambda g: g.health(), "query": lambda g, text, repo=None: g.query(text, repo), "brief": lambda g, repo=None: g.brief(repo), "entity": lambda g, name: g.entity(name)["facts"],
    "fact": lambda g, i: g.fact(int(i)), "graph": lambda g, i: g.graph(int(i)), "metrics": lambda g, name=None: g.metrics(name), "narrative": lambda g, repo: g.narrative(repo),
}


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggestion(word: str) -> str | None:
    best = min(COMMANDS, key=lambda c: edit_distance(word, c))
    return best if edit_distance(word, best) < 3 else None


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__, "\nCommands:", *COMMANDS)
        return 2
    if args[1] not in COMMANDS:
        near = suggestion(args[1])
        print(f"No command {args[1]}" + (f"; did you mean {near}?" if near else ""))
        return 2
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    print("\n".join(as_json(COMMANDS[args[1]](FactGraph(spark, args[0]), *args[2:]))))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
