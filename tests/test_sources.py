import pytest
from pyspark.sql import functions as F
from tidewatch.plans import jobs
from tidewatch.schema import ALERT_COLUMNS, SCORED_COLUMNS
from tidewatch.sources import bidirectional as bi
from tidewatch.sources import flowlogs as fg
from tidewatch.sources import normalized as nm
from tidewatch.sources import sinks as sk

NORM = "timestamp,src_ip,src_port,direction,dst_ip,dst_port,protocol,total_bytes,duration_seconds,total_packets,label\n"
ZEEK = "#separator \\x09\n#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tduration\torig_bytes\tresp_bytes\torig_pkts\tresp_pkts\n"
FLOW = "first_switched,last_switched,srcaddr,srcport,dstaddr,dstport,proto,bytes,pkts\n"
IPFIX = (
    "flowStartMilliseconds,flowEndMilliseconds,sourceIPv6Address,sourceTransportPort,destinationIPv6Address,"
    "destinationTransportPort,protocolIdentifier,octetDeltaCount,packetDeltaCount\n"
)
BIDIR = ",".join(bi.BIDIR_COLUMNS) + "\n"


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return write


def stamp(seconds):
    return f"2026-01-01T00:{seconds // 60:02d}:{seconds % 60:02d}Z"


def score_sample():
    a = [(0, 128, 1111), (60, 128, 2222), (120, 128, 3333), (180, 128, 4444), (240, 128, 5555)]
    b = [(7, 400, 4100), (43, 900, 4101), (210, 120, 4102), (211, 1800, 4103), (360, 260, 4104)]
    rows = [f"{stamp(t)},10.0.0.5,{p},->,203.0.113.10,443,tcp,{n},,,\n" for t, n, p in a]
    rows += [f"{stamp(t)},10.0.0.50,{p},->,198.51.100.20,443,tcp,{n},,,\n" for t, n, p in b]
    return NORM + "".join(rows)


def train_sample():
    flows = [
        ("10.0.0.5", "203.0.113.10", 443, "tcp", "beacon", [(t, 128) for t in (0, 60, 120, 180, 240)]),
        ("10.0.0.6", "203.0.113.11", 443, "tcp", "beacon", [(75 * i, 96) for i in range(5)]),
        ("10.0.0.50", "198.51.100.20", 443, "tcp", "benign", [(7, 400), (43, 900), (210, 120), (211, 1800), (360, 260)]),
        ("10.0.0.51", "198.51.100.21", 53, "udp", "benign", [(3, 60), (19, 120), (47, 80), (180, 240), (262, 90)]),
    ]
    return NORM + "".join(
        f"{stamp(t)},{s},,->,{d},{port},{proto},{n},,,{label}\n" for s, d, port, proto, label, ev in flows for t, n in ev
    )


def test_score_job(spark, put, tmp_path):
    out = str(tmp_path / "out")
    run = jobs.score(spark, put("score.csv", score_sample()), "normalized-csv", output=out, run_date="2026-01-01")
    alerts = run.alerts.collect()
    assert len(alerts) == 1 and alerts[0]["src_ports_seen"] == "1111;2222;3333;4444;5555"
    assert run.alerts.columns == ALERT_COLUMNS and alerts[0]["first_seen"] == "2026-01-01T00:00:00+00:00"
    s = run.summary.first()
    assert (s["input_event_count"], s["scored_flow_count"], s["alert_count"], s["mode"]) == (10, 2, 1, "rules_only")
    assert spark.read.parquet(f"{out}/alerts").filter("run_date = '2026-01-01'").count() == 1
    assert set(SCORED_COLUMNS) <= set(spark.read.parquet(f"{out}/scored_flows").columns)
    assert spark.read.json(f"{out}/run_summary").first()["alert_count"] == 1


def test_header_problems(spark, put):
    rows = nm.read_rows(spark, put("bad.csv", "timestamp,src_ip\n1,2\n"))
    issues, counts = nm.validate_normalized(rows)
    assert [r["message"] for r in issues.collect()] == [
        f"Missing required column: {c}" for c in ("direction", "dst_ip", "dst_port", "protocol", "total_bytes")
    ]
    assert counts.first()["row_count"] == 0
    with pytest.raises(ValueError, match="at header: Missing required column: direction"):
        nm.read_normalized(spark, put("bad2.csv", "timestamp,src_ip\n1,2\n"))


def test_first_bad_row(spark, put):
    text = NORM + f"{stamp(0)},a,1,->,b,443,tcp,5,,,\n{stamp(1)},a,1,->,b,443,icmp,5,,,\n{stamp(2)},a,1,->,b,x,tcp,5,,,\n"
    path = put("rows.csv", text)
    with pytest.raises(ValueError, match="row 3: Unsupported protocol: icmp"):
        nm.read_normalized(spark, path)
    issues, counts = nm.validate_normalized(nm.read_rows(spark, path))
    assert sorted((r["row_number"], r["message"]) for r in issues.collect()) == [
        (3, "Unsupported protocol: icmp"),
        (4, "dst_port must be an integer."),
    ]
    assert tuple(counts.first()) == (3, 1)
    with pytest.raises(ValueError, match="no data rows"):
        nm.read_normalized(spark, put("empty.csv", NORM))
    with pytest.raises(ValueError, match="label is required"):
        nm.read_normalized(spark, put("nolabel.csv", NORM + f"{stamp(0)},a,1,->,b,443,tcp,5,,,\n"), require_label=True)


def test_globs(spark, put, tmp_path):
    put("t1.csv", train_sample())
    put("t2.csv", train_sample())
    assert nm.read_normalized(spark, str(tmp_path / "t*.csv"), require_label=True).count() == 40


def zeek_parity():
    return ZEEK + "".join(
        f"176722{t}.0\tC\t10.0.0.5\t{p}\t203.0.113.10\t443\ttcp\t1.0\t100\t50\t2\t1\n" for t, p in ((5600, 1111), (5660, 2222))
    )


def flow_parity():
    return FLOW + "".join(
        f"176722{t},176722{t + 1},10.0.0.5,{p},203.0.113.10,443,6,150,3\n" for t, p in ((5600, 1111), (5660, 2222))
    )


def test_formats_agree(spark, put):
    z = fg.read_events(spark, put("z.log", zeek_parity()), "zeek-conn")
    n = fg.read_events(spark, put("n.csv", flow_parity()), "netflow-ipfix-csv")
    cols = ["ts", "src_ip", "direction", "dst_ip", "dst_port", "protocol", "total_bytes", "src_port", "duration_seconds", "total_packets"]
    a, b = (sorted(map(tuple, x.select(cols).collect())) for x in (z, n))
    assert a == b and len(a) == 2 and a[0][6] == 150 and a[0][9] == 3
    sa, sb = (sorted(map(tuple, jobs.score_events(fg.loaded(x)).select("src_ip", "score", "event_count").collect())) for x in (z, n))
    assert sa == sb
    with pytest.raises(ValueError, match="Unsupported operational input format"):
        fg.read_events(spark, "x", "pcap")


def test_zeek_skips_and_failures(spark, put):
    rows = "176722.0\tC\ta\t1\tb\t443\ticmp\t-\t-\t-\t-\t-\n176722.5\tC\ta\t1\tb\t443\tudp\t-\t(empty)\t7\t-\t-\n"
    e = fg.read_zeek_conn(spark, put("s.log", ZEEK + rows))
    d = fg.ingest_diagnostics(e).first()
    assert (d["input_row_count"], d["loaded_event_count"], d["skipped_row_reasons"]) == (2, 1, {"unsupported_protocol": 1})
    assert fg.loaded(e).first()["total_bytes"] == 7
    with pytest.raises(ValueError, match="contains no data rows"):
        fg.read_zeek_conn(spark, put("h.log", ZEEK))
    with pytest.raises(ValueError, match="row 2: Zeek conn.log row is missing id.orig_h"):
        bad = "1\tC\ta\t1\tb\t4\tudp\t-\t1\t1\t1\t1\n1\tC\t-\t1\tb\t4\tudp\t-\t1\t1\t1\t1\n"
        fg.read_zeek_conn(spark, put("m.log", ZEEK + bad))


def test_zeek_files_with_different_layouts(spark, put):
    other = "#fields\tid.resp_h\tid.resp_p\tproto\tts\tid.orig_h\nq\t80\ttcp\t5.0\tp\n"
    paths = [put("a.log", zeek_parity()), put("b.log", other)]
    got = fg.read_zeek_conn(spark, paths).orderBy("src_ip").collect()
    assert [(r["src_ip"], r["dst_ip"], r["dst_port"]) for r in got][-1] == ("p", "q", 80) and len(got) == 3


def test_ipfix(spark, put):
    text = IPFIX + (
        "1767225600000,1767225601000,2001:db8::5,1,2001:db8::9,443,6,100,1\n"
        "1767225660000,1767225660500,2001:db8::5,2,2001:db8::9,443,17,100,1\n"
    )
    rows = fg.read_netflow(spark, put("i.csv", text)).orderBy("ts").collect()
    assert [(r["src_ip"], r["protocol"], r["duration_seconds"]) for r in rows] == [
        ("2001:db8::5", "tcp", 1.0),
        ("2001:db8::5", "udp", 0.5),
    ]
    iso = "start_time,end_time,source_ip,destination_ip,dst_port,protocol,total_bytes\n"
    iso += "2026-01-01T00:00:00Z,2026-01-01T00:00:02Z,a,b,1,tcp,5\n2026-01-01T00:00:00+00:00,2026-01-01T00:00:03+00:00,a,b,1,tcp,5\n"
    assert sorted(r["duration_seconds"] for r in fg.read_netflow(spark, put("iso.csv", iso)).collect()) == [2.0, 3.0]
    one = "flowStartSeconds,sourceAddress,destinationAddress,dstport,transportProtocol,octetTotalCount,packetTotalCount,durationSecs\n1767225600,a,b,9,17,512,6,2.0\n"
    r = fg.read_netflow(spark, put("one.csv", one)).first()
    assert (r["total_bytes"], r["total_packets"], r["duration_seconds"]) == (512, 6, 2.0)


@pytest.mark.parametrize(
    "row,message",
    [
        ("1,2,a,1,,443,6,5,1", "row 2 is missing one of: dst_ip, destination_ip"),
        ("1,2,a,1,b,70000,6,5,1", "row 2: dst_port must be between 0 and 65535"),
        ("1,2,a,1,b,443,6,-5,1", "row 2: total_bytes must be non-negative"),
    ],
)
def test_netflow_failures(spark, put, row, message):
    with pytest.raises(ValueError, match=message):
        fg.read_netflow(spark, put("f.csv", FLOW + row + "\n"))


def test_netflow_other_failures(spark, put):
    with pytest.raises(ValueError, match="contains no data rows"):
        fg.read_netflow(spark, put("e.csv", FLOW))
    with pytest.raises(ValueError, match="duration_seconds must be non-negative"):
        fg.read_netflow(spark, put("d.csv", "first,srcaddr,dstaddr,dstport,proto,bytes,duration\n1,a,b,1,6,5,-1.0\n"))
    e = fg.read_netflow(spark, put("s.csv", FLOW + "1,2,a,1,b,443,1,5,1\n1,2,a,1,b,443,tcp,5,1\n"))
    assert fg.loaded(e).count() == 1


def bidir_row(label, sport="1000", dport="80", start="2011/08/10 09:46:59.607825", arrow="->", total=550, proto="tcp"):
    return f"{start},1.0,{proto},10.0.0.1,{sport},{arrow},10.0.0.2,{dport},CON,0,0,4,{total},300,{label}\n"


def test_bidirectional(spark, put):
    text = BIDIR + "".join(
        [
            bidir_row("flow=From-Botnet-V42"),
            bidir_row("flow=From-Botnet-V42", start="2011/08/10 09:47:59"),
            bidir_row("flow=From-Normal-V42", sport="2", dport="http"),
            bidir_row("flow=Background", sport="3"),
            bidir_row("flow=To-Botnet-V42", sport="4"),
        ]
    )
    p = bi.read_binetflow(spark, put("c.binetflow", text), "s1")
    assert bi.records(p).groupBy("label").count().orderBy("label").collect()[0]["count"] == 2
    s = {(r["kind"], r["key"]): r["count"] for r in bi.parse_summary(p).collect()}
    assert s["parsed_events", ""] == 3 and s["skip_reason", "label:ctu13_background"] == 1 and s["total_rows", ""] == 5
    from tidewatch.operators.bidir import bidir_features

    f = bidir_features(bi.records(p)).collect()
    assert sorted(r["total_bytes"] for r in f) == [550, 1100]


def test_bidirectional_identity_and_mixed(spark, put):
    from tidewatch.operators.bidir import bidir_features

    three = BIDIR + bidir_row("flow=From-Botnet") + bidir_row("flow=From-Botnet", sport="9") + bidir_row("flow=From-Botnet", arrow="<->")
    p = bi.records(bi.read_binetflow(spark, put("a.binetflow", three), "s"))
    assert bidir_features(p).count() == 3
    mixed = BIDIR + bidir_row("flow=From-Botnet") + bidir_row("flow=From-Normal")
    p = bi.records(bi.read_binetflow(spark, put("b.binetflow", mixed), "s"))
    assert bidir_features(p).count() == 0


def test_service_ports(spark):
    pairs = {"http": 80, "DNS": 53, " 443 ": 443, "0x1bb": 443, "0o17": 15, "0b11": 3, "080": None, "-": None, "nan": None, "": None, "x": None}
    d = spark.createDataFrame([(k,) for k in pairs], "p string")
    assert {r["p"]: r["v"] for r in d.select("p", bi.service_port(F.col("p")).alias("v")).collect()} == pairs


def test_native_row(spark, put):
    from tidewatch.operators.bidir import native_features

    text = BIDIR + "2011/08/10 09:46:59.607825,10.0,tcp,a,1,->,b,443,CON,0,0,5,1000,300,flow=From-Normal\n"
    r = native_features(bi.records(bi.read_binetflow(spark, put("n.binetflow", text), "s"))).first()
    assert (r["dst_bytes"], r["src_byte_ratio"], r["bytes_per_second"], r["packets_per_second"]) == (700, 0.3, 100.0, 0.5)


def test_research_events(spark, put):
    head = "timestamp,src_ip,dst_ip,dst_port,protocol,size_bytes,label,scenario_name\n"
    ok = head + "2026-01-01T00:00:00Z,10.10.10.5,203.0.113.10,443,tcp,120,beacon,fixed_periodic\n2026-01-01T00:00:43Z,a,b,443,tcp,120,beacon,\n"
    rows = bi.read_research_events(spark, put("r.csv", ok)).orderBy("t_us").collect()
    assert [r["scenario_name"] for r in rows] == ["fixed_periodic", "unknown"] and rows[0]["src_port"] is None
    with pytest.raises(ValueError, match="Unsupported label"):
        bi.read_research_events(spark, put("r2.csv", head + "2026-01-01T00:00:00Z,a,b,1,tcp,1,odd,x\n"))


def test_write_and_read_back(spark, events, tmp_path):
    e = events([("a", "b", 0, 1), ("a", "b", 1.5, 2)])
    sk.write_events(e, str(tmp_path / "ev"))
    back = bi.read_research_events(spark, str(tmp_path / "ev")).orderBy("t_us")
    assert [r["t_us"] for r in back.collect()] == [0, 1_500_000]
    sk.to_normalized(e).write.option("header", True).csv(str(tmp_path / "nm"))
    assert nm.read_normalized(spark, str(tmp_path / "nm"), require_label=True).count() == 2


def test_snapshot_states(spark, tmp_path):
    root, make = str(tmp_path), lambda: spark.range(3).withColumnRenamed("id", "x")

    def get(config, version="v1", where=root):
        return sk.feature_snapshot(spark, make, where, "features", "n", 1, config, version)[1]

    assert get({"a": 1}) == "miss" and get({"a": 1}) == "hit" and get({"a": 2}) == "miss"
    assert get({"a": 1}, "v2") == "stale" and get({"a": 1}, "v2") == "hit" and get({}, where=None) == "disabled"


def test_train_save_load_score(spark, put, tmp_path):
    from tidewatch.schema import ModelParams

    out = str(tmp_path / "model")
    jobs.train_model(spark, put("train.csv", train_sample()), out, folds=5, p=ModelParams(trees=10))
    a = jobs.load_model(spark, out)
    m = a.metadata
    assert m["validation"]["executed_folds"] == 2 and m["training_data"]["training_flow_count"] == 4
    assert set(m["threshold_profiles"]) == {"conservative", "balanced", "sensitive"}
    run = jobs.score(spark, put("score.csv", score_sample()), "normalized-csv", model_path=out, profile="balanced")
    s = run.summary.first()
    assert s["mode"] == "rules_random_forest_hybrid" and s["threshold_profile"]["profile"] == "balanced"
    assert run.scored.filter("rf_score IS NOT NULL").count() == 2


def test_quoted_fields_and_headers_of_their_own(spark, put):
    """Doubled quotes, a backslash at the end of a field, another column order, a file without a label."""
    quoted = put("q1.csv", NORM + f'{stamp(0)},"a ""x"", b",1,->,d,443,tcp,10,,,\n{stamp(1)},c\\,1,->,d,443,tcp,10,,,\n')
    put("q2.csv", f"total_bytes,protocol,dst_port,dst_ip,direction,src_ip,timestamp\n7,udp,53,e,->,z,{stamp(2)}\n")
    got = nm.read_normalized(spark, [quoted, quoted.replace("q1", "q2")]).orderBy("ts").collect()
    assert [(r["src_ip"], r["total_bytes"], r["dst_port"]) for r in got] == [('a "x", b', 10, 443), ("c\\", 10, 443), ("z", 7, 53)]
    assert nm.read_rows(spark, quoted.replace("q1", "q*")).count() == 3


def test_many_zeek_layouts(spark, put):
    one = ZEEK + "1767225600.0\tC1\t10.0.0.5\t1111\t203.0.113.10\t443\ttcp\t1.0\t100\t50\t2\t1\n"
    paths = [put("z0.log", one)]
    for i in range(3):
        names = ["x%d" % i, "proto", "id.resp_p", "id.resp_h", "id.orig_h", "ts"]
        paths.append(put(f"y{i}.log", "#fields\t" + "\t".join(names) + f"\nv\tudp\t53\t10.1.1.1\t10.0.0.{i}\t1767225660.0\n"))
    got = fg.read_zeek_conn(spark, paths).orderBy("src_ip").collect()
    assert [(r["src_ip"], r["dst_port"], r["total_bytes"]) for r in got] == [("10.0.0.0", 53, 0), ("10.0.0.1", 53, 0), ("10.0.0.2", 53, 0), ("10.0.0.5", 443, 150)]


def test_long_prefixed_port(spark):
    rows = spark.createDataFrame([("0x" + "0" * 60 + "50",), ("0o" + "0" * 50 + "17",)], "p string")
    assert [r[0] for r in rows.select(bi.service_port(F.col("p"))).collect()] == [80, 15]


def test_long_binary_ports(spark):
    d = spark.createDataFrame([("0b" + "0" * 90 + "1010000",), ("0b" + "1" * 4,)], "p string")
    assert [r[0] for r in d.select(bi.service_port(F.col("p"))).collect()] == [80, 15]


@pytest.mark.parametrize("few", [1, 64])
def test_headers_read_in_tasks(spark, tmp_path, monkeypatch, few):
    """Files of two layouts, one compressed, one empty, one with a byte-order mark and a quoted name."""
    import gzip

    monkeypatch.setattr(nm, "DRIVER_HEADERS", few)
    for i in range(6):
        (tmp_path / f"a {i}.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text('﻿"y","z, w"\r\n3,4\r\n')
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"x,y\n5,6\n"))
    (tmp_path / "d.csv").write_text("")
    files = spark.read.text(str(tmp_path)).inputFiles()
    found = nm.headers(spark, files)
    assert {k: len(v) for k, v in found.items()} == {("x", "y"): 7, ("y", "z, w"): 1} | ({(): 1} if any("d.csv" in f for f in files) else {})
    rows = nm.read_rows(spark, str(tmp_path)).select("x", "y", "`z, w`").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [("1", "2", None)] * 6 + [("5", "6", None), (None, "3", "4")]))


def test_headers_of_a_store_that_tasks_cannot_open(spark, monkeypatch):
    monkeypatch.setattr(nm, "DRIVER_HEADERS", 1)
    monkeypatch.setattr(nm, "header", lambda s, file: (file,))
    assert nm.headers(spark, ["viewfs://store/a.csv", "viewfs://store/b.csv"]) == {(f,): [f] for f in ("viewfs://store/a.csv", "viewfs://store/b.csv")}


def test_scoring_reads_the_files_once(spark, tmp_path, put):
    """After the events are loaded nothing opens the files again; bad rows still fail by number."""
    import os

    rows = "".join(f"2026-01-01T00:{i // 60:02}:{i % 60:02}Z,10.0.0.1,,->,10.0.0.2,443,tcp,{100 + i % 3},,,\n" for i in range(0, 600, 30))
    file = put("once.csv", NORM + rows)
    events = fg.load_events(spark, file, "normalized-csv", str(tmp_path / "events"))
    want = fg.read_events(spark, file, "normalized-csv").orderBy("ts").collect()
    os.remove(file)
    assert events.select(*fg.read_events(spark, put("head.csv", NORM + rows), "normalized-csv").columns).orderBy("ts").drop("source_file").collect() == [
        r for r in spark.createDataFrame(want, events.schema).drop("source_file").collect()
    ]
    assert jobs.score_events(fg.loaded(events)).count() == 1
    diagnostics = fg.ingest_diagnostics(events).first()
    assert (diagnostics.input_row_count, diagnostics.loaded_event_count) == (20, 20)
    bad = put("bad.csv", NORM + rows + "2026-01-01T00:00:00Z,10.0.0.1,,->,10.0.0.2,x,tcp,1,,,\n")
    with pytest.raises(ValueError, match="row 22: dst_port must be an integer"):
        fg.load_events(spark, bad, "normalized-csv", str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="no data rows"):
        fg.load_events(spark, put("none.csv", NORM), "normalized-csv", str(tmp_path / "none"))
