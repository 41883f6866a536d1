"""The library's extractors as a program for :func:`spanloom.operators.guarded.guarded`."""

import json
import sys

from spanloom.sources.extractors import rows_of


def main() -> None:
    for line in sys.stdin:
        asked = json.loads(line)
        rows = [r[2:] for r in rows_of(asked["path"], asked["text"])]
        print(json.dumps({"id": asked["id"], "rows": rows}), flush=True)


if __name__ == "__main__":
    main()
