"""Makes reports in a session of its own and counts, from its event log, who read which table.

    python reads.py TABLES LOG [FOLDER]
"""

import json
import sys
from collections import Counter
from pathlib import Path


def scans_in(node):
    if node["nodeName"].startswith("Scan "):
        yield node
    for child in node["children"]:
        yield from scans_in(child)


def reads(log):
    """How often each table under a path was read: scans that opened files, each once."""
    table_of, read = {}, set()
    for file in sorted(p for p in Path(log).rglob("*") if p.is_file() and not p.name.startswith(".")):
        for line in file.read_text().splitlines():
            event = json.loads(line) if line.startswith("{") else {}
            for node in scans_in(event["sparkPlanInfo"]) if "sparkPlanInfo" in event else ():
                where = node["metadata"].get("Location", "")
                for metric in node["metrics"]:
                    if metric["name"] == "number of files read":
                        table_of[metric["accumulatorId"]] = where.rstrip("]").rsplit("/", 1)[-1]
            read |= {a for a, _ in event.get("accumUpdates", ())} if "Driver" in event.get("Event", "") else set()
    return Counter(table_of[a] for a in read if a in table_of)


def main(tables, log, folder=None):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]").config(map={
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "4", "spark.eventLog.enabled": "true",
        "spark.eventLog.dir": f"file://{log}", "spark.eventLog.compress": "false",
        "spark.sql.maxMetadataStringLength": "2000",
    })
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    spark = builder.getOrCreate()
    from statline import FieldingWinShares, Tables
    from statline.sources import durable

    if not folder:  # whatever folder the installation's own settings name
        durable.named_folder = lambda spark: None
    counts = [
        FieldingWinShares(Tables.from_directory(spark, tables, declared=True)).report().count()
        for _ in range(2)
    ]
    held = {type(s.path) for same in durable.store_of(spark).stages.values() for s in same}
    assert held == {str if folder else type(None)}
    spark.stop()
    print(json.dumps({"rows": counts, "reads": reads(log)}))


if __name__ == "__main__":
    main(*sys.argv[1:])
