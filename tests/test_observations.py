import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from palisade.operators import observations as O
from palisade.thresholds import DEFAULTS

T0 = dt.datetime(2024, 1, 1)


def log(spark, rows):
    """rows: (ip, uri, status, seconds)."""
    data = [("l", ip, "h", uri, "GET", status, 512, 0.01, T0 + dt.timedelta(seconds=s)) for ip, uri, status, s in rows]
    return spark.createDataFrame(data, "log_id string, source string, host string, uri string, method string, status int, size long, duration double, ts timestamp_ntz")


def test_anchored_window_closes_at_its_width(spark):
    out = O.anchored_windows(log(spark, [("1.2.3.4", "/a", 200, 100), ("1.2.3.4", "/b", 404, 110), ("1.2.3.4", "/c", 200, 120), ("1.2.3.4", "/d", 200, 161)]), 60).orderBy("ts").collect()
    assert len(out) == 2
    first = out[0]
    assert first["request_rate"] == pytest.approx(3 / 60) and first["error_rate_4xx"] == pytest.approx(1 / 3)
    assert (first["path_diversity"], first["method_diversity"], first["ports_accessed"]) == (3, 1, [443])


def test_aligned_windows_divide_by_the_whole_width(spark):
    out = O.aggregate_windows(log(spark, [("a", "/x", 200, 1), ("a", "/y", 500, 2)]), "60 seconds").collect()
    assert len(out) == 1 and out[0]["error_rate_5xx"] == 0.5 and out[0]["connection_rate"] == pytest.approx(2 / 60)
    assert out[0]["avg_payload_bytes"] == 512 and out[0]["traffic_volume"] == 1024 // 60


def test_no_rows_no_windows(spark):
    assert O.aggregate_windows(log(spark, []), "60 seconds").count() == 0
    assert O.anchored_windows(log(spark, []), 60).count() == 0


def observed(spark, rows):
    """rows: (rate, volume, ports), a minute apart."""
    data = [("s", float(r), v, p, None, None, None, T0 + dt.timedelta(minutes=i)) for i, (r, v, p) in enumerate(rows)]
    return spark.createDataFrame(data, "source string, connection_rate double, traffic_volume long, ports_accessed array<int>, request_rate double, path_diversity int, error_rate_4xx double, ts timestamp_ntz")


SEED = [(3.2, 2048, [9750]), (2.8, 1536, [9750, 0]), (4.1, 3072, [9750]), (3.5, 2560, [9750, 0]), (5.0, 4096, [9750]), (2.1, 1024, [0]), (4.8, 3584, [9750, 0]), (3.9, 2816, [9750]), (2.5, 1280, [0]), (4.3, 3328, [9750]), (3.0, 2048, [9750, 0]), (5.2, 4352, [9750])]
ATTACKS = [(150, 8192, list(range(20)), 3), (5, 10485760, [9750], 1), (500, 512, [9750], 1), (45, 4096, list(range(6)), 2), (80, 128, [9750], 1), (25, 2048, [9750, 0], 1), (30, 6144, [22, 53, 139, 445, 3306, 5432], 3)]


def test_seed_baseline_numbers(spark):
    s = {r["dimension"]: r for r in O.baseline_stats(observed(spark, SEED)).collect()}
    assert s["connection_rate"]["mean"] == pytest.approx(3.7) and s["connection_rate"]["std_dev"] == pytest.approx(0.970395, abs=1e-6)
    assert s["traffic_volume"]["std_dev"] == pytest.approx(1041.626079, abs=1e-6) and s["port_diversity"]["std_dev"] == pytest.approx(0.471405, abs=1e-6)
    assert "request_rate" not in s  # no HTTP rows


def test_seed_is_calm_and_attacks_fire(spark):
    obs = observed(spark, SEED)
    stats = O.baseline_stats(obs)
    assert O.score_against(obs, stats).count() == 0
    found = O.score_against(observed(spark, [a[:3] for a in ATTACKS]), stats).groupBy("ts").count().orderBy("ts").collect()
    assert [r["count"] for r in found] == [a[3] for a in ATTACKS]


def test_nine_rows_are_no_baseline(spark):
    obs = observed(spark, [(1, 1, [1])] * 9 + [(99, 1, [1])])
    assert O.anomalies(O.rolling_score(obs, include_self=False)).count() == 0
    assert O.baseline_stats(observed(spark, SEED[:9])).where("mean is not null").count() == 0


def test_no_spread_is_infinite_and_certain(spark):
    out = O.anomalies(O.rolling_score(observed(spark, [(10, 1000, [1])] * 20 + [(10, 100000000, [1])]), include_self=False)).collect()
    assert len(out) == 1 and out[0]["is_infinite"] and out[0]["deviation"] == -1 and out[0]["confidence"] == 1.0


def test_drop_fires_too(spark):
    rows = [(100 + i % 2, 1, [1]) for i in range(20)] + [(1, 1, [1])]
    assert O.anomalies(O.rolling_score(observed(spark, rows), include_self=False)).where("dimension = 'connection_rate'").count() == 1


def test_inclusive_z_is_bounded(spark):
    z = O.rolling_score(observed(spark, [(1, 1, [1])] * 9 + [(1e9, 1, [1])])).agg(F.max("connection_rate_z")).first()[0]
    assert z == pytest.approx(math.sqrt(9))


def test_blocks_equal_plain_windows(spark):
    rows = [((i * 37) % 23 + 1, i % 7, [i % 3]) for i in range(400)]
    obs = observed(spark, rows)
    plain = O.rolling_score(obs).select("ts", F.round("connection_rate_z", 9).alias("z")).orderBy("ts").collect()
    cut = O.rolling_score(obs, block=120).select("ts", F.round("connection_rate_z", 9).alias("z")).orderBy("ts").collect()
    assert plain == cut


def test_counter_rate_guards(spark):
    rows = [("h", T0, 10), ("h", T0 + dt.timedelta(seconds=2), 110), ("h", T0 + dt.timedelta(seconds=4), 5), ("h", T0 + dt.timedelta(seconds=4), 50)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "host string, ts timestamp_ntz, forks_total long, id int")
    assert [r["rate"] for r in O.counter_rate(df, order=("ts", "id")).orderBy("id").collect()] == [0.0, 50.0, 0.0, 0.0]


def test_defaults():
    assert DEFAULTS.sigma == 2.5 and DEFAULTS.window == 100
