import math
import random
import statistics as st

import pytest
from pyspark.sql import functions as F
from tidewatch.operators.features import flow_features
from tidewatch.operators.sequences import bursts, gaps
from tidewatch.schema import FEATURES, OPS_KEY, FeatureParams


def one(events, times, sizes=None, **kw):
    sizes = sizes or [100] * len(times)
    rows = [("a", "b", t, s) for t, s in zip(times, sizes)]
    return flow_features(events(rows), FeatureParams(**kw)).first()


def from_gaps(values):
    out = [0.0]
    for v in values:
        out.append(out[-1] + v)
    return out


def test_three_events(events):
    r = one(events, [0, 10, 30])
    assert r["mean_interarrival_seconds"] == 15 and r["median_interarrival_seconds"] == 15
    assert r["std_interarrival_seconds"] == 5
    assert (r["min_interarrival_seconds"], r["max_interarrival_seconds"]) == (10, 20)
    assert r["interarrival_iqr_seconds"] == 10 and r["interarrival_mad_seconds"] == 5
    assert r["near_median_interarrival_fraction"] == 0
    assert r["dominant_interval_fraction"] == 0.5 and r["interval_bin_count"] == 2
    assert r["adjacent_gap_similarity_fraction"] == 0 and r["longest_similar_gap_run"] == 1
    assert r["gap_range_median_ratio"] == pytest.approx(2 / 3)


def test_one_outlying_gap(events):
    r = one(events, from_gaps([60, 62, 59, 61, 240]))
    assert r["near_median_interarrival_fraction"] == 0.8 and r["dominant_interval_fraction"] == 0.8
    assert r["adjacent_gap_similarity_fraction"] == 0.75 and r["longest_similar_gap_run"] == 4
    assert r["gap_range_median_ratio"] == pytest.approx(181 / 61)
    assert r["trimmed_interarrival_cv"] < 0.75
    assert r["interarrival_median_absolute_percentage_deviation"] < 0.04


def test_bins(events):
    r = one(events, from_gaps([60, 61, 63, 180]))
    assert r["interval_bin_count"] == 2 and r["dominant_interval_bin_fraction"] == 0.75


def test_single_event(events):
    r = one(events, [5], [250])
    assert r["event_count"] == 1 and r["flow_duration_seconds"] == 0
    assert all(r[f] is None for f in FEATURES if "interarrival" in f)
    assert r["events_per_second"] is None and r["size_cv"] == 0 and r["near_median_size_fraction"] == 1
    assert r["burst_count"] == 0 and r["avg_burst_size"] is None


def test_two_events(events):
    r = one(events, [0, 55])
    assert r["interarrival_within_10pct_median_fraction"] == 1
    assert r["adjacent_gap_similarity_fraction"] is None and r["longest_similar_gap_run"] == 1
    assert r["gap_range_median_ratio"] == 0 and r["interarrival_iqr_seconds"] is None


def test_bursts(events):
    r = one(events, [0, 1, 3, 33, 34], burst_threshold_seconds=5.0)
    assert (r["burst_count"], r["avg_burst_size"], r["max_burst_size"]) == (2, 2.5, 3)
    assert r["burst_size_variance"] == 0.25 and r["burst_size_cv"] == pytest.approx(0.2)
    assert r["avg_sleep_duration_seconds"] == 30
    assert r["within_burst_gap_consistency"] == pytest.approx(2 / 3)
    assert r["burst_to_idle_ratio"] == pytest.approx(4 / 30)


def test_burst_rows(events):
    rows = [("a", "b", t, 1) for t in from_gaps([1, 2, 30, 1])]
    sizes = [r["burst_size"] for r in bursts(events(rows), OPS_KEY, 5.0).orderBy("burst_start_us").collect()]
    assert sizes == [3, 2]


def plain(times, sizes, p):
    """The same features in plain Python, straight from their definitions."""
    ts = sorted(times)
    g = [(b - a) / 1e6 for a, b in zip(ts, ts[1:])]

    def cv(v):
        m = sum(v) / len(v)
        return None if m == 0 else st.pstdev(v) / m

    def near(v, tol):
        m = st.median(v)
        return sum(abs(x - m) <= abs(m) * tol for x in v) / len(v)

    def bins(v):
        w = max(1.0, abs(st.median(v)) * 0.2)
        b = [round(x / w) for x in v]
        return max(map(b.count, b)) / len(b), len(set(b))

    out = {"event_count": len(ts), "size_cv": cv(sizes)}
    out["near_median_size_fraction"] = near(sizes, 0.2)
    out["dominant_size_bin_fraction"], out["size_bin_count"] = bins(sizes)
    if g:
        out["median_interarrival_seconds"] = st.median(g)
        out["near_median_interarrival_fraction"] = near(g, p.timing_tolerance)
        out["dominant_interval_fraction"] = max(sum(abs(v - c) <= abs(c) * 0.2 for v in g) for c in g) / len(g)
        out["dominant_interval_bin_fraction"], out["interval_bin_count"] = bins(g)
        run = best = 1
        for a, b in zip(g, g[1:]):
            run = run + 1 if abs(a - b) / max(abs(a), abs(b), 1e-12) <= 0.3 else 1
            best = max(best, run)
        out["longest_similar_gap_run"] = best
        sizes_, cur = [], 1
        for x in g:
            if x <= p.burst_threshold_seconds:
                cur += 1
            else:
                sizes_ += [cur] if cur > 1 else []
                cur = 1
        sizes_ += [cur] if cur > 1 else []
        out["burst_count"] = len(sizes_)
        out["avg_burst_size"] = sum(sizes_) / len(sizes_) if sizes_ else None
    if len(g) > 1:
        o = sorted(g)
        h = len(o) // 2
        out["interarrival_iqr_seconds"] = st.median(o[len(o) - h :]) - st.median(o[:h])
        m = st.median(g)
        out["interarrival_mad_seconds"] = st.median([abs(x - m) for x in g])
        t = int(len(o) * 0.1)
        if t and len(o) - 2 * t >= 2:
            o = o[t:-t]
        out["trimmed_interarrival_cv"] = cv(o)
    return out


def random_rows(seed, flows=12):
    rng = random.Random(seed)
    rows = []
    for f in range(flows):
        t = 0.0
        for _ in range(rng.choice([1, 2, 3, 8, 40])):
            rows.append((f"s{f}", "d", round(t, 6), rng.choice([100, 100, 120, rng.randint(1, 5000)])))
            t += rng.choice([0, 0, 1, 1.25, 5, 60, 60.000001, rng.uniform(0, 300)])
    return rows


@pytest.mark.parametrize("threshold", [1_000_000, 1])
def test_against_plain_python(events, threshold):
    """Both the window path and the sliced path (threshold 1 sends every flow there)."""
    p = FeatureParams()
    rows = random_rows(7)
    got = flow_features(events(rows), p, hot_threshold=threshold).collect()
    assert len(got) == 12
    for r in got:
        mine = [x for x in rows if x[0] == r["src_ip"]]
        want = plain([int(round(x[2] * 1e6)) for x in mine], [x[3] for x in mine], p)
        for k, v in want.items():
            same = r[k] is None if v is None else math.isclose(r[k], v, rel_tol=1e-9, abs_tol=1e-9)
            assert same, (r["src_ip"], k, r[k], v)


def test_paths_agree_and_order_does_not_matter(events, monkeypatch):
    from tidewatch.operators import hot_flows

    rows = random_rows(11)
    # one flow with a third of all rows, many of them at one time
    rows += [("hot", "d", float(i % 7) * 60, 100 + i % 3) for i in range(len(rows) // 2)]
    e = events(rows)
    a = flow_features(e)
    monkeypatch.setattr(hot_flows, "CELL_EVENTS", 3)  # several time cells per flow
    b = flow_features(e.orderBy(F.rand(3)).repartition(5), hot_threshold=5)
    cols = [*OPS_KEY, *FEATURES]
    x = {r["src_ip"]: r for r in a.select(cols).collect()}
    y = {r["src_ip"]: r for r in b.select(cols).collect()}
    assert x.keys() == y.keys()
    for k in x:
        for f in FEATURES:
            u, v = x[k][f], y[k][f]
            assert (u is None and v is None) or math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9), (k, f, u, v)


def test_sliced_gaps_and_bursts(events, monkeypatch):
    from tidewatch.operators import hot_flows

    monkeypatch.setattr(hot_flows, "CELL_EVENTS", 3)
    e = events(random_rows(3))
    for run in (lambda t: gaps(e, OPS_KEY, t), lambda t: bursts(e, OPS_KEY, 10.0, t)):
        a, b = run(1_000_000), run(2)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_flows_are_dealt_to_tasks_by_their_events(events, monkeypatch):
    """More events mean more tasks, with one exchange though a part of the key is a constant."""
    from tidewatch.operators import hot_flows

    e = events(random_rows(3)).withColumn("direction", F.lit("->"))
    cols = [*OPS_KEY, *FEATURES]
    whole = {r["src_ip"]: r for r in flow_features(e).select(cols).collect()}
    monkeypatch.setattr(hot_flows, "TASK_EVENTS", 7)
    for threshold in (hot_flows.HOT_EVENTS, None):
        f = flow_features(e, hot_threshold=threshold)
        plan = f._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and f"{max(-(-e.count() // 7), 4)}), REPARTITION_BY_NUM" in plan
        assert {r["src_ip"]: r for r in f.select(cols).collect()} == whole


def test_the_survey_counts_events_and_lists_busy_keys(events):
    from tidewatch.operators.hot_flows import survey

    e = events([("a", "b", i, 1) for i in range(5)] + [("c", "b", 1, 1)]).withColumn("dst_port", F.lit(None).cast("int"))
    total, busy = survey(e, list(OPS_KEY), 3)
    assert total == 6 and [(r["src_ip"], r["event_count"], r["end_us"]) for r in busy.collect()] == [("a", 5, 4_000_000)]
    assert survey(e, list(OPS_KEY), 5) == (6, None) and survey(e.limit(0), list(OPS_KEY), 5) == (0, None)


def test_one_exchange(events):
    plan = flow_features(events([("a", "b", 0, 1), ("a", "b", 5, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_mixed_labels(events):
    e = events([("a", "b", 0, 1)], "benign").unionByName(events([("a", "b", 9, 1)], "beacon"))
    assert flow_features(e, mixed="drop").count() == 0
    assert flow_features(e, mixed="keep").first()["label"] is None
    with pytest.raises(Exception, match="Mixed-label flow"):
        flow_features(e, mixed="reject").collect()


def test_a_dense_burst_is_spread(events, monkeypatch):
    """99% of a flow's events in one burst: no slice above three times the target."""
    from tidewatch.operators import hot_flows

    monkeypatch.setattr(hot_flows, "CELL_EVENTS", 50)
    rows = [("h", "d", i * 0.001, 100) for i in range(990)] + [("h", "d", 1000.0 * i, 100) for i in range(1, 11)]
    busy = hot_flows.with_hot_keys(events(rows), hot_flows.find_hot_keys(events(rows), list(OPS_KEY), 10), list(OPS_KEY))
    runs = hot_flows._gap_runs(busy, list(OPS_KEY))
    assert max(r["count"] for r in runs.groupBy("slice").count().collect()) <= 150


def test_many_hot_keys(events, monkeypatch):
    """More hot flows than are broadcast take the sliced path as well."""
    from tidewatch.operators import hot_flows

    e = events(random_rows(5))

    def run():
        return flow_features(e, hot_threshold=2).select(*OPS_KEY, *FEATURES).orderBy(*OPS_KEY).collect()

    want = run()
    monkeypatch.setattr(hot_flows, "BROADCAST_KEYS", 1)
    for a, b in zip(run(), want, strict=True):
        for u, v in zip(a, b):
            assert u == v or math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9)
