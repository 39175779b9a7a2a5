"""Run every query against its SQL on DuckDB: ``python -m checks.compare FOLDER [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks.oracles import ORACLES  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from riskloom.session import local_session  # noqa: E402


def canonical(rows, names) -> list[tuple]:
    """Rows with columns in name order, sorted."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def main(folder: str, wanted: list[str]) -> int:
    spark = local_session(8)
    engine = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        engine.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    bad = 0
    for name in wanted or QUERIES:
        start = time.time()
        try:
            frame = QUERIES[name](spark, folder)
            mine = canonical(frame.collect(), frame.columns)
        except Exception as problem:
            print(f"{name:28} ERROR {str(problem)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if name not in ORACLES:
            print(f"{name:28} rows {len(mine):7} {took:6.1f}s  {mine[:4]}", flush=True)
            continue
        result = engine.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        other = canonical(result.fetchall(), names)
        same = sorted(names) == sorted(frame.columns) and mine == other
        bad += not same
        print(f"{name:28} {'ok  ' if same else 'DIFF'} {len(mine):7} {took:6.1f}s", flush=True)
        if not same:
            print("   columns", sorted(frame.columns), sorted(names))
            only = [(a, b) for a, b in zip(mine, other) if a != b][:3]
            print("   sizes", len(mine), len(other), *[f"\n   {a}\n   {b}" for a, b in only], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
