import datetime as dt
import random

from acervo.operators import sequences


def test_places_without_a_window_over_a_vessel(spark):
    r = random.Random(3)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randint(0, 3000))
    points = [(None if k % 9 == 0 else k % 4 // 2, None if k % 31 == 0 else at(), k) for k in range(300)]
    data = spark.createDataFrame(points, "v long, ts timestamp, id long").repartition(4)
    numbered = sequences._numbered(data, "v", "ts", "id")
    got = {x.id: (x._n, x._i) for x in numbered.collect()}
    want = {}
    for v in (None, 0, 1):
        own = sorted((p for p in points if p[0] == v), key=lambda p: (p[1] is not None, p[1] or dt.datetime.min, p[2]))
        want |= {p[2]: (len(own), i) for i, p in enumerate(own, 1)}
    assert got == want
    assert "row_number() windowspecdefinition(v#" in (plan := numbered._jdf.queryExecution().toString()) and "_b#" in plan
