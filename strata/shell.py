"""A line shell over a store: python -m strata.shell [folder]."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from strata.plans.store import Options, Store

DEFAULT_FOLDER, DEFAULT_FLUSH = "./data/strata", 4 * 1024
HELP = """put KEY VALUE    store a value
get KEY          show a value
del KEY          remove a key (also: remove)
exists KEY       whether a key is there
size | keys      count or list the keys
clear            remove everything
flush | compact  write a run, merge runs
wal | sstables | manifest   show log, runs, versions
help | exit | quit"""


def answers(store: Store, lines: Iterable[str]) -> Iterator[str]:
    """The answer to each line. Words are split at white space, so values hold none, and further words are ignored."""
    for line in lines:
        words = line.split()
        if not words:
            continue
        verb, args = words[0], words[1:]
        if verb in ("exit", "quit"):
            return
        if verb == "help":
            yield HELP
        elif verb == "put" and len(args) >= 2:
            yield "OK" if store.put(args[0], args[1]) else "ERR"
        elif verb == "get" and args:
            value = store.get(args[0])
            yield "(nil)" if value is None else value
        elif verb in ("del", "remove") and args:
            yield "OK" if store.remove(args[0]) else "ERR"
        elif verb == "exists" and args:
            yield "1" if store.exists(args[0]) else "0"
        elif verb == "size":
            yield str(store.size())
        elif verb == "keys":
            yield "\n".join(r.k for r in store.keys().toLocalIterator())
        elif verb in ("clear", "flush", "compact"):
            getattr(store, verb)()
            yield "OK"
        elif verb == "wal":
            yield "\n".join(r.text for r in store.wal_table().select("text").toLocalIterator())
        elif verb == "sstables":
            yield "\n".join(f"L{r.level}-{r.number} {r.k}:{r.v}" for r in store.runs_table().toLocalIterator())
        elif verb == "manifest":
            yield "\n".join([f"last_seq {store.last_seq()}", *(f"L{r.level} {r.path}" for r in store.manifest_table().collect())])
        else:
            yield "unknown command; help lists the commands"


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    store = Store(spark, sys.argv[1] if len(sys.argv) > 1 else DEFAULT_FOLDER, Options(flush_entries=DEFAULT_FLUSH))
    for answer in answers(store, iter(sys.stdin.readline, "")):
        print(answer, flush=True)


if __name__ == "__main__":
    main()
