"""Run queries against their SQL: python tests/sweep.py FOLDER [name …]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession

from tests.compare import connect, differences
from workload import QUERIES

if __name__ == "__main__":
    folder, *names = sys.argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names or QUERIES:
        query = QUERIES[name]
        start = time.time()
        try:
            if query.sql is None:
                problems = [] if query.run(spark, folder).collect() else ["no rows"]
            else:
                problems = differences(query.run(spark, folder), con, query.sql)
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", *problems, sep="\n     ", flush=True)
    print(f"{bad} failing")
