"""``python -m arkloom.cli OPERATOR NAME=VALUE...``: a named operator from the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from arkloom.operators import registry
from arkloom.session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arkloom", description=__doc__)
    sub = p.add_subparsers(dest="operator", required=True)
    for name, op in sorted(registry.REGISTRY.items()):
        s = sub.add_parser(name, help=(op.run.__doc__ or "").strip().split("\n")[0])
        for k in op.required:
            s.add_argument(f"--{k}", required=True)
        for k, default in op.optional.items():
            s.add_argument(f"--{k}", default=default)
        for k in op.dest:
            s.add_argument(f"--{k}")
        s.add_argument("-n", "--rows", type=int, default=20, help="rows to show if there is no destination")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = vars(parser().parse_args(args))
    name, rows = given.pop("operator"), given.pop("rows")
    params = {k: v for k, v in given.items() if v is not None}
    try:
        out = registry.run(spark or session(), name, params)
        if not any(params.get(d) for d in registry.REGISTRY[name].dest):
            for df in out if isinstance(out, tuple) else (out,):
                df.show(rows, False)
    except registry.OperatorError as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
