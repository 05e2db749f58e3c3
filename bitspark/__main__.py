"""``python -m bitspark train EXPONENT FILE | perf EXPONENT OUT | plot SCALE RECORDS OUT.svg``"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    if len(args) < 3 or args[0] not in ("train", "perf", "plot"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("bitspark").getOrCreate()
    if args[0] == "train":
        from bitspark.plans.train import train_file

        for r in train_file(spark, args[2], 1 << int(args[1]))[1]:
            print(f"layer {r.layer}: accuracy {100 * r.accuracy:.3f}%, sparsity {100 * r.sparsity:.3f}%")
    elif args[0] == "perf":
        from bitspark.plans.perf import run_tests
        from bitspark.sources.bits import write_perf

        write_perf(run_tests(spark, int(args[1])), args[2])
    else:
        from bitspark.plans.perf import perf_points, render_svg
        from bitspark.sources.bits import read_perf

        spark.createDataFrame([(render_svg(perf_points(read_perf(spark, args[2])), float(args[1])),)], "value string").coalesce(1).write.mode("overwrite").text(args[3])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
