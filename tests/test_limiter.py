"""The request limiter: the earliest requests of a client and window pass, across batches and restarts."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

from ledgerline.streaming import rates as XR

SCHEMA = "ip string, ts timestamp, n int"
T0 = datetime(2024, 1, 1, 12, 0)


def _send(spark, base, part, rows, limit):
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.repartition(3).write.parquet(os.path.join(base, "log", f"part={part}"))
    XR.stream_rate_decisions(spark, os.path.join(base, "log", "*"), frame.schema, os.path.join(base, "out"),
                             os.path.join(base, "ckpt"), max_requests=limit).awaitTermination()
    return {r.n: r.position for r in spark.read.parquet(os.path.join(base, "out")).collect()}


def test_one_hundred_in_fifteen_minutes(spark, tmp_path):
    # a hot client: 250 in one window in reverse order, a quiet one, one without an address, one without a time
    rows = [("hot", T0 + timedelta(seconds=3 * (249 - i)), i) for i in range(250)]
    rows += [("quiet", T0 + timedelta(minutes=5 * i), 1000 + i) for i in range(6)]
    rows += [(None, T0, 2000), ("hot", None, 2001)]
    got = _send(spark, str(tmp_path), 0, rows, 100)
    assert len(got) == len(rows)
    assert {n: p for n, p in got.items() if n < 250} == {i: 250 - i if i >= 150 else None for i in range(250)}
    assert [got[1000 + i] for i in range(6)] == [1, 2, 3, 1, 2, 3] and got[2000] == got[2001] == 1
    # after a restart the window is still full, also for an earlier request; the next window is free
    more = [("hot", T0, 3000), ("hot", T0 + timedelta(minutes=15), 3001), ("quiet", T0 + timedelta(minutes=14), 3002)]
    later = _send(spark, str(tmp_path), 1, more, 100)
    assert {n: later[n] for n in got} == got
    assert (later[3000], later[3001], later[3002]) == (None, 1, 4)
