"""Command line: python -m evidentia.cli STORE check, or STORE query point|trend|trajectory|causal ..."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from evidentia import schema
from evidentia.operators.checks import Inconsistent
from evidentia.plans.engine import Engine, OverLimit, UnknownEntity
from evidentia.plans.request import BadRequest, parse
from evidentia.sources.health import CHECKS, readiness
from evidentia.sources.store import Store

TABLES = {name: table for name, (table, _) in schema.TABLES.items()}


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    try:
        if argv[1:] != ["check"] and (len(argv) < 3 or argv[1] != "query"):
            raise BadRequest(__doc__)
        request, output = parse(argv[2:]) if argv[1] == "query" else (None, "")  # before any table is read
        spark = spark or SparkSession.builder.appName("evidentia").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if request is None:
            found = readiness(Store(spark, argv[0], TABLES))
            for check, ok, detail in found:
                print(f"{check}: {'ok' if ok else 'failed'} ({detail})")
            return 0 if len(found) == len(CHECKS) and found[-1][1] else 1
        engine = Engine(spark, Store(spark, argv[0], TABLES).snapshot())
        result = engine.query(request)
        print(engine.envelope(result).first()["json"] if output == "json" else engine.text(result))
    except (BadRequest, UnknownEntity, OverLimit, Inconsistent) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
