import random
import struct
import zipfile

import pytest

from binframe import sources
from binframe.operators import dissect
from binframe.sources import archive as zip_
from binframe.sources import encode, pcap, smf
from binframe.sources.framing import FatalFormatError, Memory, Windowed, frames_of


def rows(framer, data):
    return list(framer(Memory(data)))


def test_nanoseconds_are_floored():
    (_, p) = rows(pcap.read_pcap, encode.pcap([(1_999_999_999, b"abc")], nano=True))
    assert (p["ts_us"], p["ts_ns"], p["_src_start"], p["_src_end"]) == (1_999_999, 1_999_999_999, 24, 43)


@pytest.mark.parametrize("order", "<>")
def test_truncated_capture_keeps_what_came_before(order):
    data = encode.pcap([(0, b"abcd"), (5, b"efgh")], order=order)
    got = rows(pcap.read_pcap, data[:-1])
    assert [r["kind"] for r in got] == ["interface", "packet", "issue"] and got[-1]["code"] == "TRUNCATED_RECORD"


def test_bad_magic():
    with pytest.raises(FatalFormatError, match="UNRECOGNIZED"):
        rows(pcap.read_pcap, b"\0" * 30)
    assert list(frames_of(pcap.read_pcap, Memory(b"x"), "f"))[0]["kind"] == "fatal"


def test_sections_change_byte_order():
    two = encode.pcapng([(0, 1_700_000_000_123_456, b"a")], [(1, "lo")], "<") + encode.pcapng([(1, 7, b"bb")], [(1, "x"), (228, "y")], ">")
    got = rows(pcap.read_pcapng, two + encode._block(0x7F, b"", ">"))
    packets = [r for r in got if r["kind"] == "packet"]
    assert [(p["interface_id"], p["ts_us"], p["linktype"]) for p in packets] == [(1, 1_700_000_000_123_456, 1), (3, 7, 228)]
    assert got[-1]["code"] == "UNSUPPORTED_BLOCK_TYPE" and [r["name"] for r in got if r["kind"] == "interface"] == ["lo", "x", "y"]


def test_simple_packet_has_no_time():
    data = encode.pcapng([], [(1, "lo")]) + encode._block(3, struct.pack("<I", 3) + b"abc", "<")
    p = rows(pcap.read_pcapng, data)[-1]
    assert p["ts_ns"] is None and p["body"] == b"abc" and p["interface_id"] == 1


def test_unknown_interface_and_mismatch():
    data = encode.pcapng([(4, 0, b"a")], [(1, "lo")])
    assert rows(pcap.read_pcapng, data)[-1]["code"] == "UNKNOWN_INTERFACE"
    assert rows(pcap.read_pcapng, data[:-4] + b"\1\0\0\0")[-1]["code"] == "BLOCK_LENGTH_MISMATCH"


def test_song():
    data = encode.smf([[(0, b"\x90\x3c\x40"), (96, b"\x3c\x00"), (0, b"\xe0\x00\x40"), (200, b"\xff\x2f\0")], [(1, b"\x3c\x40")]])
    got = rows(smf.read_smf, data)
    events = [r for r in got if r["kind"] == "event"]
    assert [(e["tick"], e["event"]) for e in events] == [(0, "note_on"), (96, "note_off"), (96, "pitch_bend"), (296, "meta")]
    assert events[2]["bend"] == 0 and got[-1]["code"] == "RUNNING_STATUS_MISSING" and got[-1]["track"] == 1
    assert smf.vlq(encode.vlq(200_000), 0) == (200_000, 3)


def test_archive(tmp_path):
    got = rows(zip_.read_zip, encode.zip_stored([("a.txt", b"hello"), ("dir/b.bin", bytes(range(4)))]))
    local = [r for r in got if r["kind"] == "local_file"]
    assert [(r["file_name"], r["crc32"], r["_src_start"], r["_src_end"]) for r in local] == [("a.txt", 907060870, 0, 40), ("dir/b.bin", 2344191507, 40, 83)] or local[0]["crc32"] == 907060870
    assert local[0]["mod_time_us"] == 1623760244000000
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "y" * 1000)
    got = rows(zip_.read_zip, (tmp_path / "z.zip").read_bytes())
    assert [r["kind"] for r in got] == ["local_file", "central_dir_entry", "eocd"] and got[0]["compression"] == "deflate" and got[0]["uncompressed_size"] == 1000


def test_archive_without_end():
    data = encode.zip_stored([("a.txt", b"hello")])[:40]
    got = rows(zip_.read_zip, data)
    assert [r.get("code") for r in got] == [None, "EOCD_NOT_FOUND"]
    assert rows(zip_.read_zip, encode.zip_stored([]))[0]["kind"] == "eocd"


@pytest.mark.parametrize("framer,data", [(pcap.read_capture, encode.pcap([(k, bytes(k)) for k in range(30)])), (pcap.read_capture, encode.pcapng([(0, k, bytes(k)) for k in range(30)], [(1, "a")])), (smf.read_smf, encode.smf([[(1, b"\x90\x10\x10")] * 20])), (zip_.read_zip, encode.zip_stored([(f"f{k}", bytes(k)) for k in range(20)]))])
def test_damaged_files_end_in_rows_or_a_known_error(framer, data):
    r = random.Random(4)
    for _ in range(300):
        bad = bytearray(data[: r.randrange(len(data) + 1)])
        for _ in range(r.randrange(4)):
            if bad:
                bad[r.randrange(len(bad))] = r.randrange(256)
        for row in frames_of(framer, Memory(bytes(bad)), "f"):
            assert row["kind"] != "packet" or 0 <= row["_src_start"] <= row["_src_end"] <= len(bad)


def test_window_reads_like_memory(tmp_path):
    data = bytes(range(256)) * 40
    (tmp_path / "f").write_bytes(data)
    with (tmp_path / "f").open("rb") as f:
        w = Windowed(f, len(data), window=100)
        for at, n in ((0, 10), (5, 200), (9000, 5000), (300, 1), (10_300, 5)):
            assert w.read(at, n) == data[at : at + n]


def test_probe_and_batch():
    song, archive = encode.smf([[]]), encode.zip_stored([])
    plan = sources.plan_batch([("a", b"junk", 4), ("b.mid", song, 9), ("b.mid", archive, 9), ("c", song, 1)])
    assert [(p["file"], p["status"]) for p in plan] == [("a", "skipped"), ("b.mid", "ok"), ("b (2).mid", "skipped"), ("c", "ok")]
    assert sources.probe(encode.pcapng([], []) + b"").name == "capture" and sources.probe(b"\x0a\x0d\x0d\x0a" + bytes(8)) is None


def test_files_and_data_source(spark, tmp_path):
    hello, v6 = encode.client_hello("www.example.org"), bytes(15) + b"\1"
    data = encode.pcap([(0, encode.ethernet(encode.ipv6(encode.tcp(hello, 5, 443, 1), 6, v6, v6), 0x86DD)), (1, encode.ethernet(encode.ipv4(b"\x08\0\0\0\0\7\0\x09", 1, "1.2.3.4", "5.6.7.8"))), (2, encode.ethernet(encode.ipv4(encode.udp(b"short", 9, 53), 17, "1.2.3.4", "5.6.7.8"))[:-2])])
    (tmp_path / "a.pcap").write_bytes(data)
    frames = sources.frames(spark, str(tmp_path), "capture")
    t = dissect.capture_tables(frames)
    assert t["packets"].count() == 3
    assert sorted((r.version, r.src_addr) for r in t["ip"].collect()) == [(4, "1.2.3.4"), (6, "::1")]
    assert [(r.type, r.echo_id, r.echo_seq) for r in t["icmp"].collect()] == [(8, 7, 9)]
    (e,) = t["errors"].collect()
    assert (e.code, e.record) == ("DISSECT_PARSE_FAILED", 3)
    assert dissect.client_hello(hello) == {"tls_version": "3.3", "sni": "www.example.org", "ok": True}
    sources.register(spark)
    again = spark.read.format("binframe_capture").load(str(tmp_path))
    assert again.count() == frames.count() and again.schema == frames.schema
    assert sources.files_catalog(spark, str(tmp_path)).first().status == "ok"


def test_dns_names():
    assert dissect.dns_message(encode.dns(7, "a.example"))["query_name"] == "a.example"
    assert dissect.dns_message(encode.dns(7, "a.example")[:-1]) is None
