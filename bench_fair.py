"""The same validation three ways over ten times the events: a schema, hand-written built-ins, a Python validator.

One JSON line: rows a second of each, best of three. BENCH_SF_DIR names the tables, BENCH_CPUS the cores. All three
parse `props`, keep rows whose k is a whole number from 0 to 99, and sum it per event type.
"""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


def main() -> None:
    import pandas as pd
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tessera import operators as O
    from tessera import schema as S

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "props").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(10)))).repartition(cpus * 2).cache()
    n = events.count()

    @F.pandas_udf("long")
    def validated(texts: pd.Series) -> pd.Series:
        def one(text: str) -> int | None:
            try:
                k = json.loads(text)["k"]
            except (ValueError, KeyError, TypeError):
                return None
            return int(k) if isinstance(k, (int, float)) and not isinstance(k, bool) and k == int(k) and 0 <= k <= 99 else None

        return texts.map(one).astype("Int64")

    parsed = F.from_json("props", "k double")["k"]
    ways = {
        "schema": lambda: O.parse(events, "props", S.object_({"k": S.int32.gte(0).lte(99)}), into="v", mode="drop_invalid").select("event_type", F.col("v.k").alias("k")),
        "built_ins": lambda: events.select("event_type", parsed.alias("k")).filter("k is not null and k = floor(k) and k between 0 and 99").select("event_type", F.col("k").cast("int").alias("k")),
        "python": lambda: events.select("event_type", validated("props").alias("k")).filter("k is not null"),
    }
    rates, answers = {}, set()
    for name, way in ways.items():
        best = None
        for _ in range(3):
            began = time.time()
            answers.add(tuple(sorted(map(tuple, way().groupBy("event_type").agg(F.sum("k")).collect()))))
            best = min(best or 1e9, time.time() - began)
        rates[name] = round(n / best)
    print(json.dumps({"metric": "rows a second", "rows": n, "cores": cpus, "same_answers": len(answers) == 1, **rates}))


if __name__ == "__main__":
    main()
