"""Command line: list the registered queries, run one over a folder of tables, or render a demonstration set of notes."""

from __future__ import annotations

import argparse
from pathlib import Path

from rateloom import catalog
from rateloom.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rateloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="run a query and write its rows as Parquet")
    run.add_argument("query", choices=sorted(catalog.QUERIES))
    run.add_argument("tables")
    run.add_argument("out")
    synth = sub.add_parser("synth", help="render a grid of notes as WAV files")
    synth.add_argument("archetype", choices=["sustained", "piano"])
    synth.add_argument("out")
    synth.add_argument("--pitches", type=int, nargs="+", default=[48, 60, 72])
    synth.add_argument("--velocities", type=int, nargs="+", default=[64, 112])
    synth.add_argument("--seconds", type=float, default=1.0)
    synth.add_argument("--rate", type=int, default=22_050)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
    elif args.command == "run":
        spark = local_session()
        catalog.QUERIES[args.query](spark, args.tables).write.mode("overwrite").parquet(args.out)
    else:
        from rateloom.functions.synth import render
        from rateloom.sources.recordings import encode_wav

        out = Path(args.out)
        out.mkdir(parents=True, exist_ok=True)
        grid = [(p, v) for p in args.pitches for v in args.velocities]
        for k, (p, v) in enumerate(grid, 1):
            (out / f"{k:04d}_p{p:03d}_v{v:03d}.wav").write_bytes(encode_wav(render(args.archetype, p, v, args.seconds, args.rate), args.rate))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
