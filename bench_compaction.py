
import json
import os
import shutil
import statistics
import tempfile
import time

import pyspark
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidefold.config import ExecutionConfig, Strategy
from tidefold.functions.metrics import least_greatest_average
from tidefold.plans.table import Table

ROWS, FILES, RUNS = 350_000, 5, 3


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took, root = [], tempfile.mkdtemp()
    for run in range(RUNS):
        rows = spark.range(0, ROWS * FILES, 1, FILES).select("id", (F.lit(1_700_000_000_000) + F.col("id") * 1000).alias("timestamp"), (F.col("id") * 0.123456789).alias("value"), F.concat(F.lit("cat_"), F.lpad((F.col("id") % 10_000).cast("string"), 5, "0")).alias("category"), F.concat(F.lit("a line of text that describes row "), F.col("id"), F.lit(" of "), F.lpad((F.col("id") % 1_000_000).cast("string"), 10, "0")).alias("description"))
        table = Table.create(spark, f"{root}/{run}", rows.schema)
        table.append(rows)
        table.append(spark.range(0, ROWS * FILES, 100).select("id").coalesce(1), "equality_deletes", [1])
        before = table.state().files
        start = time.monotonic()
        done = table.compact(Strategy.FULL, execution=ExecutionConfig(compression="uncompressed"))
        took.append(time.monotonic() - start)
        after = [f for f in table.state().files if f.content == "data"]
    shutil.rmtree(root)
    size = sum(f.size for f in before)
    least, greatest, mean = least_greatest_average(took)
    median = statistics.median(took)
    print(json.dumps({"input_bytes": size, "files_in": len(before), "files_out": done.files_added, "rows_in": ROWS * FILES, "rows_out": sum(f.rows for f in after), "cores": int(cpus), "spark": pyspark.__version__, "runs": RUNS, "median_s": round(median, 2), "min_s": round(least, 2), "max_s": round(greatest, 2), "mean_s": round(mean, 2), "mb_per_s": round(size / median / 1e6, 1)}))


if __name__ == "__main__":
    main()
