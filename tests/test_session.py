import pytest

from binframe.operators import dissect
from binframe.operators import layers as L
from binframe.sources import encode
from binframe.sources.framing import Memory
from binframe.sources.pcap import read_capture
from binframe.sources.session import Session, parquet_scan


def name_packet(k, cut=0):
    body = encode.ethernet(encode.ipv4(encode.udp(encode.dns(k, f"n{k}.example"), 9, 53), 17, "10.0.0.1", "10.0.0.2"))
    return (k * 1000, body[: len(body) - cut])


@pytest.fixture
def session(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/loads")
    yield s
    s.close()


def test_loads_are_swapped_and_files_taken_back(spark, tmp_path, session):
    (tmp_path / "in").mkdir()
    for f in ("a", "b"):
        (tmp_path / "in" / f"{f}.pcap").write_bytes(encode.pcap([name_packet(k) for k in range(10)], nano=True))
    (tmp_path / "in" / "c.pcap").write_bytes(encode.pcapng([], [])[:8] + b"\x1a\x2b\x3c\x4d" + b"\xff" * 20)
    (tmp_path / "in" / "d.txt").write_bytes(b"text")
    session.load(f"{tmp_path}/in")
    status = {r.file: (r.status, r.error) for r in session.query("select * from _files").collect()}
    assert status["a.pcap"] == ("ok", None) and status["c.pcap"][0] == "failed" and status["d.txt"][0] == "skipped"
    joined = session.query("select p.ts_ns, d.query_name, p._src_file from packets p join dns d using (packet_id, _src_file)")
    assert sorted((r.ts_ns, r.query_name, r._src_file) for r in joined.collect()) == sorted((k * 1000, f"n{k}.example", f) for k in range(10) for f in ("a.pcap", "b.pcap"))
    assert session.query("select count(*) as n from tcp").first().n == 0  # a table without rows is there
    with pytest.raises(PermissionError):
        session.query("insert into packets select * from packets")
    session.discard("a.pcap")
    assert {r._src_file for r in session.query("select _src_file from packets").collect()} == {"b.pcap"}
    first = session.path
    session.load(spark.createDataFrame([("x", encode.pcap([name_packet(1)]))], "name string, content binary"))
    assert session.query("select count(*) as n from packets").first().n == 1 and session.path != first
    with pytest.raises(ValueError):
        session.load(spark.createDataFrame([("y", b"junk")], "name string, content binary"))
    assert session.query("select count(*) as n from packets").first().n == 1


def test_other_formats(spark, session):
    session.load(spark.createDataFrame([("s.mid", encode.smf([[(0, b"\xff\x51\x03\7\xa1\x20"), (5, b"\x90\x3c\x40"), (9, b"\x3c\0")]]))], "name string, content binary"))
    assert [(r.event_id, r.tick, r.event) for r in session.query("select * from events order by 1").collect()] == [(1, 5, "note_on"), (2, 14, "note_off")]
    assert session.query("select us_per_quarter from tempo").first()[0] == 500_000 and "dns" not in session.views
    session.load(spark.createDataFrame([("z.zip", encode.zip_stored([("a.txt", b"hello")]))], "name string, content binary"))
    assert session.query("select file_name, crc32 from local_files").first() == ("a.txt", 907060870) and "events" not in session.views
    assert session.query("select num_entries from end_of_central_dir").first()[0] == 1


def test_streams_of_a_load(spark, session):
    name = encode.dns(7, "t.example")
    data = len(name).to_bytes(2, "big") + name
    packets = [(k, encode.ethernet(encode.ipv4(encode.tcp(d, 5, 53, q, f), 6, "10.0.0.1", "10.0.0.2"))) for k, (q, f, d) in enumerate([(0, "SYN", b""), (11, "ACK", data[10:]), (1, "ACK", data[:10])])]
    session.load(spark.createDataFrame([("t", encode.pcap([*packets, name_packet(9)]))], "name string, content binary"))
    rows = session.query("select dns_id, packet_id, stream_id, query_name, _src_ranges from dns order by 1").collect()
    assert [(r.dns_id, r.packet_id, r.stream_id, r.query_name) for r in rows] == [(1, 3, 1, "t.example"), (2, 4, None, "n9.example")] and len(rows[0]._src_ranges) == 2
    assert session.query("select status, message_count from streams").first() == ("complete", 1)
    assert session.query("select count(*) from stream_segments").first()[0] == 3


def test_only_the_wanted_columns_are_read(spark, tmp_path, session):
    session.load(spark.createDataFrame([("x", encode.pcap([name_packet(k) for k in range(50)]))], "name string, content binary"))
    plan = session.query("select ts, caplen, len from packets where caplen > 900")._jdf.queryExecution().executedPlan().toString()
    assert "payload" not in plan and "GreaterThan(caplen,900)" in plan
    paths = spark.read.parquet(session.path).inputFiles()
    assert parquet_scan(spark, list(paths)).count() == 51
    with pytest.raises(ValueError):
        parquet_scan(spark, [])


def test_layers_at_once_equal_layers_one_by_one():
    """Damaged and cut packets of all kinds: many in one call give what each gives alone."""
    import random

    import numpy as np

    r = random.Random(5)
    kinds = [
        lambda: (1, name_packet(r.randrange(99))[1]), lambda: (1, encode.ethernet(encode.ipv4(encode.tcp(b"abc", 1, 443, 5, "SYN|ACK"), 6, "1.2.3.4", "5.6.7.8"), vlan=3)),
        lambda: (1, encode.ethernet(encode.ipv6(b"\x80\0\0\0\0\1\0\2", 58, bytes(16), bytes(16)), 0x86DD)), lambda: (228, encode.ipv4(b"\x08\0\0\0\0\7\0\x09", 1, "1.1.1.1", "2.2.2.2")),
        lambda: (229, encode.ipv6(encode.udp(b"x", 1, 2), 17, bytes(16), bytes(16))), lambda: (113, bytes(14) + b"\x08\0" + encode.ipv4(b"", 99, "1.1.1.1", "2.2.2.2")), lambda: (7, b"abc"), lambda: (1, b""),
    ]
    packets = []
    for _ in range(600):
        link, body = r.choice(kinds)()
        body = bytearray(body[: r.randrange(len(body) + 1)] if r.random() < 0.4 else body)
        for _ in range(r.randrange(3)):
            if body:
                body[r.randrange(len(body))] = r.randrange(256)
        packets.append((link, bytes(body)))
    buf = np.frombuffer(b"".join(b for _, b in packets), np.uint8)
    ends = np.cumsum([len(b) for _, b in packets])
    starts = ends - [len(b) for _, b in packets]
    all_ = L.layers(buf, starts, ends, np.array([x for x, _ in packets]), np.zeros(600, np.int64), {})
    counts = {}
    for k, (link, body) in enumerate(packets):
        one = L.layers(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]), np.array([link]), starts[k : k + 1], counts)
        for c, _ in L.COLUMNS:
            assert one[c][0].as_py() == all_[c][k].as_py(), (k, c)


@pytest.mark.parametrize("cut", [0, 1, 9, 16, 17])
def test_quick_reading_equals_the_framer(cut):
    data = encode.pcap([name_packet(k) for k in range(5)] + [(9, b"")], nano=True)
    data = data[: len(data) - cut]
    got = [r for b in dissect.decode_file("f", data) for r in b.to_pylist()]
    want = list(read_capture(Memory(data)))
    names = ("kind", "code", "linktype", "ts_us", "ts_ns", "caplen", "len", "_src_start", "_src_end")
    assert [[r.get(n) for n in names] for r in got] == [[r.get(n) for n in names] for r in want]
    assert [r["ordinal"] for r in got] == list(range(len(got)))


def test_unreadable_and_missing_content(spark):
    df = spark.createDataFrame([("a", b""), ("b", None), ("c", b"junk")], "name string, content binary")
    assert sorted((r._src_file, r.kind) for r in dissect.decode(df).collect()) == [("a", "fatal"), ("c", "fatal")]
    assert dissect.capture_tables(dissect.decode(df))["packets"].count() == 0
