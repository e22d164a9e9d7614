"""Headers of hand-made files of each kind, and what a catalogue keeps of them."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from medialake.functions import columns as C
from medialake.sources import headers as H


def tiff(order="<", time="2024:05:01 10:20:30", offset="+08:00", lat=((25, 1), (2, 1), (3030, 100)), refs=("N", "W"), altitude=(12, 1, 1), size=(40, 30)):
    """Directories one behind the other, values behind them."""

    def ifd(at, tags):
        data_at = at + 2 + 12 * len(tags) + 4
        head, data = struct.pack(order + "H", len(tags)), b""
        for tag, kind, n, value in tags:
            if len(value) <= 4:
                head += struct.pack(order + "HHI", tag, kind, n) + value.ljust(4, b"\0")
            else:
                head += struct.pack(order + "HHII", tag, kind, n, data_at + len(data))
                data += value
        return head + b"\0" * 4 + data

    p = lambda f, *v: struct.pack(order + f, *v)
    text = lambda s: (2, len(s) + 1, s.encode() + b"\0")
    ratios = lambda rs: (5, len(rs), b"".join(p("II", *r) for r in rs))
    exif = [(0x9003, *text(time))] + [(0x9011, *text(offset))] * bool(offset)
    gps = [(1, *text(refs[0])), (2, *ratios(lat)), (3, *text(refs[1])), (4, *ratios(lat)), (5, 1, 1, bytes([altitude[2]])), (6, *ratios([altitude[:2]]))]
    main = lambda a, b: [(0x0100, 4, 1, p("I", size[0])), (0x0101, 4, 1, p("I", size[1])), (0x0112, 3, 1, p("H", 6)), (0x8769, 4, 1, p("I", a)), (0x8825, 4, 1, p("I", b))]
    first = len(ifd(8, main(0, 0)))
    second = len(ifd(8 + first, exif))
    return (b"II*\0" if order == "<" else b"MM\0*") + p("I", 8) + ifd(8, main(8 + first, 8 + first + second)) + ifd(8 + first, exif) + ifd(8 + first + second, gps)


def segment(marker, body):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(block=None, filler=0):
    body = segment(0xE0, b"JFIF\0") + segment(0xE2, b"x" * 60_000) * filler
    if block is not None:
        body += segment(0xE1, b"Exif\0\0" + block)
    return b"\xff\xd8" + body + segment(0xC0, struct.pack(">BHHB", 8, 480, 640, 3)) + segment(0xDA, b"") + b"\x12" * 5000


def atom(kind, body=b""):
    return struct.pack(">I", len(body) + 8) + kind + body


def movie(keys=True, created="2024-05-01T10:20:30+0800", spot="+25.0339+121.5645+010.0/", rotated=True, late=0):
    mvhd = atom(b"mvhd", bytes(12) + struct.pack(">II", 600, 3000) + bytes(80))
    matrix = (0, 65536, 0, -65536, 0) if rotated else (65536, 0, 0, 0, 65536)
    tkhd = atom(b"tkhd", bytes(40) + struct.pack(">5i", *matrix) + bytes(16) + struct.pack(">II", 1920 << 16, 1080 << 16))
    stsd = atom(b"stsd", struct.pack(">II", 0, 1) + atom(b"hvc1", bytes(20)))
    mdia = atom(b"mdia", atom(b"hdlr", bytes(8) + b"vide" + bytes(12)) + atom(b"minf", atom(b"stbl", stsd)))
    sound = atom(b"trak", atom(b"mdia", atom(b"hdlr", bytes(8) + b"soun" + bytes(12)) + atom(b"minf", atom(b"stbl", atom(b"stsd", struct.pack(">II", 0, 1) + atom(b"mp4a"))))))
    if keys:
        names = [b"com.apple.quicktime.make", b"com.apple.quicktime.location.ISO6709", b"com.apple.quicktime.creationdate"]
        values = [b"Maker", spot.encode(), created.encode()]
        table = atom(b"keys", struct.pack(">II", 0, 3) + b"".join(atom(b"mdta", n) for n in names))
        lists = atom(b"ilst", b"".join(atom(struct.pack(">I", i), atom(b"data", struct.pack(">II", 1, 0) + v)) for i, v in enumerate(values, 1)))
        more = atom(b"meta", atom(b"hdlr", bytes(8) + b"mdta" + bytes(12)) + table + lists)
    else:
        text = lambda s: struct.pack(">HH", len(s), 0) + s.encode()
        more = atom(b"udta", atom(b"\xa9xyz", text(spot)) + atom(b"\xa9day", text(created)))
    return atom(b"ftyp", b"qt  " + bytes(4)) + atom(b"mdat", b"\0" * late) + atom(b"moov", mvhd + sound + atom(b"trak", tkhd + mdia) + more)


def heic(block, version=0):
    infe = atom(b"infe", bytes([2, 0, 0, 0]) + struct.pack(">HH", 7, 0) + b"Exif" + b"\0")
    iinf = atom(b"iinf", bytes(4) + struct.pack(">H", 1) + infe)
    ispe = lambda w, h: atom(b"ispe", struct.pack(">III", 0, w, h))
    iprp = atom(b"iprp", atom(b"ipco", ispe(512, 512) + ispe(4032, 3024)))
    item = struct.pack(">I", 6) + b"Exif\0\0" + block

    def meta(at):
        iloc = atom(b"iloc", bytes([version, 0, 0, 0, 0x44, 0x00]) + struct.pack(">HH", 1, 7) + (b"\0\0" if version else b"") + struct.pack(">HHII", 0, 1, at, len(item)))
        return atom(b"meta", bytes(4) + atom(b"hdlr", bytes(8) + b"pict" + bytes(12)) + iinf + iloc + iprp)

    head = atom(b"ftyp", b"heic" + bytes(4))
    return head + meta(len(head) + len(meta(0)) + 8) + atom(b"mdat", item)


def element(name, body):
    size = len(body)
    return bytes.fromhex(name) + (bytes([0x80 | size]) if size < 127 else struct.pack(">Q", size | 1 << 56)) + body


def matroska(codec=b"V_AV1", unknown=False):
    info = element("1549A966", element("2AD7B1", (1_000_000).to_bytes(3, "big")) + element("4489", struct.pack(">d", 2500.0)))
    audio = element("AE", element("83", b"\x02") + element("86", b"A_OPUS"))
    video = element("AE", element("83", b"\x01") + element("86", codec) + element("E0", element("B0", struct.pack(">H", 1280)) + element("BA", struct.pack(">H", 720))))
    body = info + element("1654AE6B", audio + video) + element("1F43B675", b"\0" * 100_000)
    segment_ = bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + body if unknown else element("18538067", body)
    return element("1A45DFA3", element("4282", b"webm")) + segment_


def walked(content):
    reads = []

    def read(at, n):
        reads.append(n)
        return content[at : at + n]

    out = H.walk(read, len(content))
    assert out["bytes_read"] <= H.MOST_BYTES and sum(reads) >= out["bytes_read"]
    return out


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("wrap", ["tiff", "jpeg", "png", "webp", "heic", "heic1"])
def test_pictures(order, wrap):
    block = tiff(order)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    riff = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    content = {
        "tiff": block,
        "jpeg": jpeg(block, filler=3),
        "png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 640, 480) + bytes(5)) + chunk(b"IDAT", bytes(50_000)) + chunk(b"eXIf", block) + chunk(b"IEND", b""),
        "webp": b"RIFF" + bytes(4) + b"WEBP" + riff(b"VP8X", bytes(4) + (639).to_bytes(3, "little") + (479).to_bytes(3, "little")) + riff(b"VP8 ", bytes(9001)) + riff(b"EXIF", block),
        "heic": heic(block),
        "heic1": heic(block, 1),
    }[wrap]
    out = walked(content)
    assert (out["exif_time"], out["exif_offset"]) == ("2024:05:01 10:20:30", "+08:00")
    assert out["latitude"] == pytest.approx(25 + 2 / 60 + 30.3 / 3600) and out["longitude"] == pytest.approx(-out["latitude"]) and out["altitude"] == -12
    assert (out["width"], out["height"]) == {"tiff": (40, 30), "heic": (4032, 3024), "heic1": (4032, 3024)}.get(wrap, (640, 480))
    assert out["orientation"] == 6 and out["complete"]
    if wrap == "jpeg":
        assert out["bytes_read"] < len(content) / 3


def test_movies():
    for keys in (True, False):
        out = walked(movie(keys, late=3_000_000))
        assert (out["created"], out["location"]) == ("2024-05-01T10:20:30+0800", "+25.0339+121.5645+010.0/")
        assert (out["container"], out["duration"], out["codec"], out["width"], out["height"]) == ("qt", 5.0, "hvc1", 1080, 1920)
        assert out["bytes_read"] < 40_000
    assert (walked(movie(rotated=False))["width"], walked(movie(rotated=False))["height"]) == (1920, 1080)


def test_matroska():
    for unknown in (False, True):
        out = walked(matroska(unknown=unknown))
        assert (out["container"], out["codec"], out["width"], out["height"], out["duration"]) == ("webm", "V_AV1", 1280, 720, 2.5)
        assert out["bytes_read"] < 20_000


def test_broken_files():
    whole = [jpeg(tiff()), movie(), matroska(), heic(tiff()), tiff(">")]
    for content in whole:
        for cut in range(0, len(content), max(1, len(content) // 97)):
            assert walked(content[:cut])["bytes_read"] <= cut + H.BLOCK
    assert walked(b"")["complete"] and "container" not in walked(b"plain text, no header")
    loop = atom(b"ftyp", b"isom") + atom(b"free", b"") * 300_000
    assert not walked(loop)["complete"]  # nothing but small atoms: the most bytes are read, then it ends
    assert walked(b"\0\0\0\0moov" + bytes(100))["complete"]


def test_as_a_data_source(spark, tmp_path):
    (tmp_path / "trip" / "day").mkdir(parents=True)
    (tmp_path / ".hidden").mkdir()
    files = {"DJI_20240601101112_0001_D.jpg": jpeg(), "trip/a.JPG": jpeg(tiff()), "trip/day/b.mov": movie(), "trip/day/c.webm": matroska(), "trip/note.txt": b"x", ".hidden/d.jpg": jpeg(tiff()), "trip/_e.jpg": jpeg(tiff())}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = H.media_headers(spark, str(tmp_path), parts=3)
    assert rows.rdd.getNumPartitions() == 9  # three folders in three shares
    found = {r["path"]: r for r in rows.collect()}
    assert set(found) == {"DJI_20240601101112_0001_D.jpg", "trip/a.JPG", "trip/day/b.mov", "trip/day/c.webm", "trip/_e.jpg"}
    assert found["trip/a.JPG"]["size"] == len(files["trip/a.JPG"]) and found["trip/day/c.webm"]["codec"] == "V_AV1"
    kept = H.captures(rows.withColumn("modified", F.timestamp_seconds(F.lit(1_700_000_000))), today=F.lit(dt.date(2024, 12, 31)))
    got = {r["path"]: (r["captured_at"].isoformat(), r["captured_local"], r["has_zone"], r["captured_source"], r["latitude"] and round(r["latitude"], 4), r["altitude"], r["gps_source"]) for r in kept.withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz")).collect()}
    assert got["trip/a.JPG"] == ("2024-05-01T02:20:30", "2024-05-01T10:20:30", True, "header", 25.0418, -12.0, "header")
    assert got["trip/day/b.mov"] == ("2024-05-01T02:20:30", None, True, "header", 25.0339, 10.0, "header")
    assert got["DJI_20240601101112_0001_D.jpg"] == ("2024-06-01T10:11:12", "2024-06-01T10:11:12", False, "dji_filename", None, None, None)
    assert got["trip/day/c.webm"] == ("2023-11-14T22:13:20", None, True, "file_date", None, None, None)


def test_headers_of_contents(spark):
    rows = spark.createDataFrame([(1, bytearray(jpeg(tiff()))), (2, None), (3, bytearray(b"?"))], "id long, content binary")
    assert {r["id"]: r["container"] for r in H.headers_of(rows).collect()} == {1: "jpeg", 2: None, 3: None}
    assert H.headers_of(rows.limit(0)).count() == 0


def test_clocks_and_codecs(spark):
    cases = [
        ("2024:05:01 10:20:30", "+08:00", "2024-05-01 02:20:30", True), ("2024:05:01 10:20:30", "-0330", "2024-05-01 13:50:30", True), ("2024:05:01 10:20:30", "Z", "2024-05-01 10:20:30", True),
        ("2024:05:01 10:20:30", None, "2024-05-01 10:20:30", False), ("2024:05:01 10:20:30", "eight", "2024-05-01 10:20:30", True), ("2024:05:01 10:20:30", "+ab:cd", "2024-05-01 10:20:30", False),
        ("2024:05:01 10:20", None, "2024-05-01 10:20:00", False), ("2024:05:01 10:20:30.75", None, "2024-05-01 10:20:30", False), ("2024:13:01 10:20:30", "+08:00", "2025-01-01 10:20:30", False),
        ("2024-05-01 10:20:30", None, None, None), ("2024:05:01", None, None, None), (None, "Z", None, None),
    ]
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, raw string, off string").select("i", C.exif_capture(F.col("raw"), F.col("off")).alias("c")).select("i", F.date_format("c.at", "yyyy-MM-dd HH:mm:ss").alias("at"), "c.has_zone")
    assert {r["i"]: (r["at"], r["has_zone"]) for r in rows.collect()} == {i: c[2:] for i, c in enumerate(cases)}
    dates = [("2024-05-01T10:20:30+0800", "2024-05-01 02:20:30", True, None), ("2024-05-01T10:20:30.5Z", "2024-05-01 10:20:30", True, None), ("2024-05-01 10:20:30", "2024-05-01 10:20:30", False, "2024-05-01T10:20:30"), ("May", None, None, None)]
    got = spark.createDataFrame([(d[0],) for d in dates], "t string").select("t", C.metadata_capture(F.col("t")).alias("c")).select("t", F.date_format("c.at", "yyyy-MM-dd HH:mm:ss"), "c.has_zone", "c.local").collect()
    assert {tuple(r) for r in got} == set(dates)
    codecs = [(bytearray(b"..V_VP9..V_AV1"), "av1"), (bytearray(b"V_VP8 V_VP9"), "vp9"), (bytearray(b"xV_VP8"), "vp8"), (bytearray(b""), "other"), (None, "other")]
    assert [r[0] for r in spark.createDataFrame([(c[0],) for c in codecs], "h binary").select(C.matroska_codec(F.col("h"))).collect()] == [c[1] for c in codecs]
    lines = [("  Duration: 01:02:03.50, start", 3723.5, None), ("frame=1 time=00:00:04.25 bitrate", None, 4.25), ("time=N/A Duration: 1:2", None, None)]
    got = spark.createDataFrame([(x[0],) for x in lines], "l string").select("l", C.encode_progress(F.col("l")).alias("p")).select("l", "p.*").collect()
    assert {tuple(r) for r in got} == set(lines)
