"""Compare queries with their SQL: python tools/check.py <sf_dir> [name ...]"""

import os
import sys
import time
import traceback

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from stratafold.registry.oracles import ORACLES  # noqa: E402
from stratafold.registry.queries import QUERIES  # noqa: E402
from stratafold.session import build_session  # noqa: E402
from tests.compare import connect, differences  # noqa: E402

sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
spark = build_session(master="local[8]", conf={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir)
bad = 0
for name in names:
    start = time.time()
    try:
        problem = differences(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
    except Exception as error:
        problem = f"{name}: {type(error).__name__}: {str(error)[:1500]}"
        if len(names) == 1:
            traceback.print_exc()
    bad += problem is not None
    print(f"{time.time() - start:6.2f}s", problem or f"{name} ok", flush=True)
print("failures:", bad)
sys.exit(bool(bad))
