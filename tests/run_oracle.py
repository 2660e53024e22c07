"""Run every registered query against its oracle: python tests/run_oracle.py [sf_dir] [names...]"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

import __spark_entry__ as E  # noqa: E402
from oracle import compare, duck  # noqa: E402
from packetlens.session import get_spark  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = get_spark()
con = duck(sf)
qs, sql = E.queries(), E.oracle_sql()
ok_all = True
for name, fn in qs.items():
    if names and name not in names:
        continue
    t0 = time.time()
    if name not in sql:
        n = fn(spark, sf).count()
        print(f"ROWS  {name}: {n} rows ({time.time()-t0:.1f}s)")
        continue
    try:
        ok, msg = compare(spark, con, sf, name, fn, sql[name])
    except Exception as e:  # noqa: BLE001
        ok, msg = False, f"error: {type(e).__name__}: {str(e)[:400]}"
    ok_all &= ok
    print(f"{'PASS' if ok else 'FAIL'}  {name}: {msg} ({time.time()-t0:.1f}s)")
print("ALL PASS" if ok_all else "SOME FAILED")
