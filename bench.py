"""Headline timings: prints one JSON line.

``BENCH_SF_DIR`` names the table directory, ``BENCH_CPUS`` the local cores.  The corpus is
derived from the tables and written once; the other figures start from that copy.  A pass over
the smallest tables warms up the JVM and the Python workers first and is reported apart.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from debtscope.operators import hotspots, profile, ranking, smells, syntax  # noqa: E402
from debtscope.plans import report, summary  # noqa: E402
from debtscope.plans.profile_table import read_profile, write_profile  # noqa: E402
from debtscope.session import configure  # noqa: E402
from debtscope.sources import corpus, tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", str(4 * int(CPUS))).config("spark.driver.memory", "16g")
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    work = tempfile.mkdtemp(prefix="bench-")
    seconds: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        result = action()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    try:
        start = time.perf_counter()
        small = Path(SF_DIR).with_name("sf0.001")
        if small.exists():
            write_profile(tables.all_files(spark, str(small)), f"{work}/warm")
        warm_up = round(time.perf_counter() - start, 3)
        files_path, profile_path = f"{work}/files", f"{work}/profile"
        timed("corpus", lambda: tables.all_files(spark, SF_DIR).repartition(4 * int(CPUS)).write.parquet(files_path))
        files = spark.read.parquet(files_path)
        sources = corpus.source_files(files)
        python = sources.filter(F.col("lang") == "Python")
        timed("file_metrics", lambda: drain(profile.file_metrics(sources)))
        timed("syntax_nodes", lambda: drain(python.select("file_id", syntax.syntax_nodes("strict_text").alias("nodes"))))
        timed("smells", lambda: drain(smells.smell_rows(sources)))
        timed("functions", lambda: drain(hotspots.function_rows(sources)))
        timed("classes", lambda: drain(hotspots.class_rows(sources)))
        timed("profile_table", lambda: write_profile(files, profile_path))
        table = read_profile(spark, profile_path)
        timed("language_table", lambda: summary.language_table(table).collect())
        timed("top_files", lambda: ranking.top_files(table).collect())
        timed("csv_report", lambda: report.export(table, f"{work}/report.csv"))
        timed("advice_report", lambda: report.export(table, f"{work}/report", include_advice=True))
        size = files.agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars")).first()
        lines = table.agg(F.sum("total")).first()[0]
    finally:
        spark.stop()
        shutil.rmtree(work, ignore_errors=True)
    rate = {"warm_up": warm_up, "files": size["n"], "chars": size["chars"], "lines": lines, "metric_lines_per_sec": round(lines / seconds["file_metrics"])}
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR, "cpus": int(CPUS), **rate}))


if __name__ == "__main__":
    main()
