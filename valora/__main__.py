"""python -m valora version | queries | run NAME SF_DIR"""

from __future__ import annotations

import sys

VERSION = "0.1.0"


def main(argv: list[str]) -> int:
    command = argv[0] if argv else "version"
    if command == "version":
        print(f"valora {VERSION}")
        return 0
    from valora.plans import registry

    if command == "queries":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    if command == "run" and len(argv) == 3 and argv[1] in registry.QUERIES:
        from pyspark.sql import SparkSession

        registry.QUERIES[argv[1]](SparkSession.builder.getOrCreate(), argv[2]).show(50, truncate=False)
        return 0
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
