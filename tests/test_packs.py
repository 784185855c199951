import pytest
from pyspark.sql import types as T

from binframe.operators import library as lib
from binframe.plans import packs as p
from binframe.sources import encode
from binframe.sources.session import Session

GOOD = {"version": "0.1", "id": "x", "title": "X", "containers": [{"id": "c", "framer": "f", "probe": {"magic": [{"at": 1, "hex": "ff00", "confidence": 0.5}]}}], "queries": [{"id": "q", "title": "Q", "sql": "with w as (select * from t) select * from w join _files on true"}]}


def test_manifest():
    pack = p.from_mapping(GOOD, ["t"])
    assert pack.probe(b"a\xff\0b") == ("c", 0.5) and pack.probe(b"a\xff") is None
    for change in ({"version": "0.2"}, {"id": "a-b"}, {"title": ""}, {"containers": []}, {"containers": GOOD["containers"] * 2}, {"extra": 1}, {"containers": [{"id": "c", "framer": "f", "probe": {"hook": "h"}}]}, {"containers": [{"id": "c", "framer": "f", "probe": {"magic": [{"at": 0, "hex": "f", "confidence": 1}]}}]}, {"containers": [{"id": "c", "framer": "f", "probe": {"magic": [{"at": 0, "hex": "ff", "confidence": 0}]}}]}, {"containers": [{"id": "c"}]}):
        with pytest.raises(p.PackError):
            p.from_mapping(GOOD | change, ["t"])


def test_lint():
    q = lambda **k: p.Query(**({"id": "a", "title": "A", "sql": "select 1 from t"} | k))
    assert len(p.lint([q(), q(id="b", sql="select * from range(3) join `T` on true")], ["t"])) == 2
    for bad in ([q(), q()], [q(kind="chart")], [q(kind="playback")], [q(sql="select * from u")], [q(sql=None)], [q(sql="select * from t join \"u\" using (k)")]):
        with pytest.raises(p.PackError):
            p.lint(bad, ["t"])
    assert p.lint([q(kind="playback")], ["t"], ["audio"])


def test_choice():
    assert p.choose(encode.pcap([]))[1] == "pcap" and p.choose(encode.pcapng([], []))[1] == "pcapng" and p.choose(encode.smf([[]]))[0].id == "midi" and p.choose(encode.zip_stored([]))[1] == "zip" and p.choose(b"junk") is None


@pytest.mark.parametrize(("pack", "content"), [(p.CAPTURE, encode.pcap([(5, encode.ethernet(encode.ipv4(encode.udp(encode.dns(7, "a.example"), 9, 53), 17, "10.0.0.1", "10.0.0.2")))])), (p.MIDI, encode.smf([[(0, b"\xff\x51\x03\7\xa1\x20"), (480, b"\xff\x51\x03\3\xd0\x90")], [(0, b"\x90\x3c\x40"), (480, b"\x3c\0"), (480, b"\x3c\x40")]])), (p.ZIP, encode.zip_stored([("a", b"b")]))])
def test_every_query_of_a_pack_runs(spark, tmp_path, pack, content):
    s = Session(spark, f"file://{tmp_path}/loads")
    s.load(spark.createDataFrame([("f", content)], "name string, content binary"))
    try:
        for q in pack.queries:
            df = s.query(q.sql)
            rows = df.collect()
            assert q.kind == "grid" or lib.playable(df.schema, pack.capabilities)
            if q.id == "overview":
                assert {r.table_name for r in rows} == set(pack.tables) and sum(r.row_count for r in rows) > 0
            if q.id == "play_all":
                assert [(r.seconds, r.kind) for r in rows] == [(0.0, "note_on"), (0.5, "note_off"), (0.75, "note_on")]
    finally:
        s.close()


def test_library(tmp_path):
    clock = iter(range(100))
    x = lib.Library(f"{tmp_path}/l.json", limit=2, now=lambda: next(clock))
    a, b = x.save("pcap", " a  b ", "select 1"), x.save("midi", "", "select 2")
    assert a["name"] == "a b" and b["name"] == "untitled" and [q["id"] for q in x.of("pcap")] == [a["id"]]
    x.update(a["id"], sql="select 3;")
    gone = x.remove(a["id"])
    x.restore(gone)
    assert [q["id"] for q in x.saved] == [a["id"], b["id"]] and x.update("no") is None and x.remove("no") is None
    assert x.take_in("pcap", [("a b", "select 3 ;\n"), ("a b", "select 4"), ("a b", "select 4")]) == (1, 2)
    for sql in ("s", "s", " ", "t", "u"):
        x.ran("pcap", sql, "ok", 1)
    assert [h["sql"] for h in x.history] == ["u", "t"]
    assert lib.Library(f"{tmp_path}/l.json").history == [] and len(lib.Library(f"{tmp_path}/l.json").saved) == 3
    x.keep(True)
    assert len(lib.Library(f"{tmp_path}/l.json").history) == 2
    x.keep(False)
    assert lib.Library(f"{tmp_path}/l.json").history == []
    x.clear()
    assert x.history == []


def test_playable():
    schema = lambda text: T.StructType.fromDDL(text)
    good = "seconds double, note int, velocity smallint, kind string"
    assert lib.playable(schema(good), ["audio"]) and not lib.playable(schema(good), [])
    for bad in (good.replace("double", "string"), good.replace("kind string", "kind int"), good + ", channel string", "seconds double"):
        assert not lib.playable(schema(bad), ["audio"])
    assert not lib.playable(T.StructType([*schema(good), *schema("note int")]), ["audio"])


def test_bytes(spark, tmp_path):
    (tmp_path / "f").write_bytes(bytes(range(200)))
    assert lib.read_bytes(spark, f"file://{tmp_path}/f", 5, 9) == bytes(range(5, 9)) and lib.read_bytes(spark, f"{tmp_path}/f", 190, 500) == bytes(range(190, 200)) and lib.read_bytes(spark, f"{tmp_path}/f", 900, 901) == b""
    with pytest.raises(ValueError):
        lib.read_bytes(spark, f"{tmp_path}/f", 5, 4)
    spark.range(1000).selectExpr("id", "id as other", "uuid() as text").coalesce(1).write.parquet(f"{tmp_path}/p")
    files = spark.read.parquet(f"{tmp_path}/p").inputFiles()
    assert 0 < lib.parquet_bytes(files, ["id"]) < lib.parquet_bytes(files) / 4
