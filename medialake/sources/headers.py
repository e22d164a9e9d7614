"""Media headers: a data source that walks the structure of files and reads only the ranges it needs.

``spark.read.format("media_headers").load(root)`` gives a row for each media file
below ``root``. Folders are dealt to partitions, each in ``parts`` shares by a hash of the
file's path, so a folder with a third of all files is many tasks' work, and the driver
holds names of folders, not of files. A task lists its folders and walks
its own files by blocks of ``BLOCK`` bytes, at most ``MOST_BYTES`` of each (``complete`` is
false if that wasn't enough): picture and sound data are stepped over.

``headers_of`` does the same for contents in a column. ``captures`` makes of either what a
catalogue keeps: when, from what, and where.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from medialake.functions import columns as C

BLOCK = 8192
MOST_BYTES = 1 << 20
#: Folders below the root that are partitions of their own, at most.
MOST_FOLDERS = 4096

FIELDS = {
    "container": "string", "exif_time": "string", "exif_offset": "string", "latitude": "double", "longitude": "double", "altitude": "double", "location": "string", "created": "string",
    "width": "long", "height": "long", "orientation": "int", "duration": "double", "codec": "string", "bytes_read": "long", "complete": "boolean",
}
_DDL = ", ".join(f"{k} {v}" for k, v in FIELDS.items())
_ARROW = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


class Enough(Exception):
    """The most bytes of a file have been read."""


class Ranges:
    """Ranges of a file, by blocks; only the last block is kept."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size, self.bytes_read, self.first, self.block = read, size, 0, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        """Up to ``n`` bytes, fewer at the end of the file."""
        n = min(n, self.size - offset)
        if n <= 0:
            return b""
        if not self.first <= offset <= offset + n <= self.first + len(self.block):
            want = min(max(n, BLOCK), self.size - offset)
            if self.bytes_read + want > MOST_BYTES:
                raise Enough
            self.first, self.block = offset, self.read(offset, want)
            self.bytes_read += len(self.block)
        return self.block[offset - self.first : offset - self.first + n]

    def number(self, offset: int, n: int, order: str = "big") -> int:
        got = self.at(offset, n)
        if len(got) < n:
            raise ValueError("the file ends here")
        return int.from_bytes(got, order)


# -- EXIF directories ---------------------------------------------------------------------------------------------------
_WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _directory(f: Ranges, base: int, at: int, order: str, end: int) -> dict[int, list | str]:
    """Tags of one directory: ASCII values as text, numbers and ratios as lists."""
    found: dict[int, list | str] = {}
    for i in range(f.number(base + at, 2, order)):
        entry = base + at + 2 + 12 * i
        tag, kind, n = f.number(entry, 2, order), f.number(entry + 2, 2, order), f.number(entry + 4, 4, order)
        width = _WIDTHS.get(kind)
        if not width or n > 4096:
            continue
        place = entry + 8 if width * n <= 4 else base + f.number(entry + 8, 4, order)
        if place + width * n > end:
            continue
        if kind == 2:
            found[tag] = f.at(place, n).split(b"\0")[0].decode("utf-8", "replace")
        elif width == 8:
            pairs = [(f.number(place + 8 * j, 4, order), f.number(place + 8 * j + 4, 4, order)) for j in range(n)]
            found[tag] = [a / b if b else 0.0 for a, b in pairs]
        else:
            found[tag] = [f.number(place + width * j, width, order) for j in range(n)]
    return found


def _exif(f: Ranges, base: int, end: int, out: dict) -> None:
    order = {b"II": "little", b"MM": "big"}.get(f.at(base, 2))
    if not order:
        return
    first = lambda tags, *names: next((tags[t] for t in names if tags.get(t)), None)
    main = _directory(f, base, f.number(base + 4, 4, order), order, end)
    for name, tag in (("width", 0x0100), ("height", 0x0101), ("orientation", 0x0112)):
        if main.get(tag) and name not in out:
            out[name] = main[tag][0]
    if 0x8769 in main:
        tags = _directory(f, base, main[0x8769][0], order, end)
        out["exif_time"] = first(tags, 0x9003, 0x9004)
        out["exif_offset"] = first(tags, 0x9011, 0x9012, 0x9010)
    if 0x8825 in main:
        gps = _directory(f, base, main[0x8825][0], order, end)
        for name, ref, value, negative in (("latitude", 1, 2, "S"), ("longitude", 3, 4, "W")):
            if len(gps.get(value, ())) == 3:
                degrees = sum(x / 60**i for i, x in enumerate(gps[value]))
                out[name] = -degrees if str(gps.get(ref, "")).upper() == negative else degrees
        if gps.get(6):
            out["altitude"] = -gps[6][0] if gps.get(5) == [1] else gps[6][0]


# -- pictures -------------------------------------------------------------------------------------------------------------
def _jpeg(f: Ranges, out: dict) -> None:
    at = 2
    while f.at(at, 1) == b"\xff":
        marker = f.number(at + 1, 1)
        if marker in (0xD9, 0xDA):
            return
        if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 1:
            at += 1 if marker == 0xFF else 2
            continue
        size = f.number(at + 2, 2)
        if marker == 0xE1 and f.at(at + 4, 6) == b"Exif\0\0":
            _exif(f, at + 10, at + 2 + size, out)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            out["height"], out["width"] = f.number(at + 5, 2), f.number(at + 7, 2)
        at += 2 + size


def _png(f: Ranges, out: dict) -> None:
    at = 8
    while at + 8 <= f.size:
        size, kind = f.number(at, 4), f.at(at + 4, 4)
        if kind == b"IHDR":
            out["width"], out["height"] = f.number(at + 8, 4), f.number(at + 12, 4)
        elif kind == b"eXIf":
            _exif(f, at + 8, at + 8 + size, out)
        elif kind == b"IEND":
            return
        at += 12 + size


def _webp(f: Ranges, out: dict) -> None:
    at = 12
    while at + 8 <= f.size:
        kind, size = f.at(at, 4), f.number(at + 4, 4, "little")
        if kind == b"VP8X":
            out["width"], out["height"] = f.number(at + 12, 3, "little") + 1, f.number(at + 15, 3, "little") + 1
        elif kind == b"EXIF":
            _exif(f, at + 8 + 6 * (f.at(at + 8, 6) == b"Exif\0\0"), at + 8 + size, out)
        at += 8 + size + size % 2


# -- atoms ------------------------------------------------------------------------------------------------------------------
def _atoms(f: Ranges, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, begin, end) of the bodies of the atoms in a range."""
    while at + 8 <= end:
        size, kind, head = f.number(at, 4), f.at(at + 4, 4), 8
        if size == 1:
            size, head = f.number(at + 8, 8), 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        yield kind, at + head, min(at + size, end)
        at += size


def _full(f: Ranges, a: int) -> int:
    """Where a meta atom's own atoms begin: behind a version, which QuickTime leaves out."""
    return a if f.at(a + 4, 4) == b"hdlr" else a + 4


def _keyed(f: Ranges, a: int, b: int, out: dict) -> None:
    names: list[str] = []
    wanted = {"com.apple.quicktime.location.ISO6709": "location", "com.apple.quicktime.creationdate": "created"}
    for kind, x, y in _atoms(f, _full(f, a), b):
        if kind == b"keys":
            at = x + 8
            while at + 8 <= y:
                size = max(8, f.number(at, 4))
                names.append(f.at(at + 8, size - 8).decode("utf-8", "replace"))
                at += size
        elif kind == b"ilst":
            for index, c, d in _atoms(f, x, y):
                i = int.from_bytes(index, "big")
                name = wanted.get(names[i - 1]) if 0 < i <= len(names) else None
                for inner, e, g in _atoms(f, c, d):
                    if name and inner == b"data":
                        out[name] = f.at(e + 8, min(g - e - 8, 1024)).decode("utf-8", "replace")


def _track(f: Ranges, a: int, b: int, out: dict) -> None:
    size = handler = codec = None
    for kind, x, y in _atoms(f, a, b):
        if kind == b"tkhd":
            matrix = x + (52 if f.number(x, 1) == 1 else 40)
            ma, mb, _, mc, md = struct.unpack(">5i", f.at(matrix, 20))
            w, h = f.number(matrix + 36, 4) / 65536, f.number(matrix + 40, 4) / 65536
            size = [round(abs(p * w + q * h) / 65536) for p, q in ((ma, mc), (mb, md))]
        elif kind == b"mdia":
            for inner, c, d in _atoms(f, x, y):
                if inner == b"hdlr":
                    handler = f.at(c + 8, 4)
                elif inner == b"minf":
                    tables = [z for k, *z in _atoms(f, c, d) if k == b"stbl"]
                    for t in tables:
                        codec = next((f.at(e + 12, 4).decode("latin-1") for k, e, _ in _atoms(f, *t) if k == b"stsd"), codec)
    if handler == b"vide" and "codec" not in out:
        out["codec"] = codec
        if size and all(size):
            out["width"], out["height"] = size


def _movie(f: Ranges, a: int, b: int, out: dict) -> None:
    for kind, x, y in _atoms(f, a, b):
        if kind == b"mvhd":
            wide = f.number(x, 1) == 1
            scale, length = (f.number(x + 20, 4), f.number(x + 24, 8)) if wide else (f.number(x + 12, 4), f.number(x + 16, 4))
            out["duration"] = length / scale if scale else None
        elif kind == b"trak":
            _track(f, x, y, out)
        elif kind == b"meta":
            _keyed(f, x, y, out)
        elif kind == b"udta":
            for inner, c, d in _atoms(f, x, y):
                if inner in (b"\xa9xyz", b"\xa9day"):
                    text = f.at(c + 4, min(f.number(c, 2), d - c - 4)).decode("utf-8", "replace")
                    out.setdefault("location" if inner == b"\xa9xyz" else "created", text)
                elif inner == b"meta":
                    _keyed(f, c, d, out)


def _still(f: Ranges, a: int, b: int, out: dict) -> None:
    """A picture in atoms: the item of type Exif is looked up by its place."""
    exif, places = None, {}
    for kind, x, y in _atoms(f, _full(f, a), b):
        if kind == b"iinf":
            at = x + (8 if f.number(x, 1) else 6)
            for inner, c, _ in _atoms(f, at, y):
                version = f.number(c, 1)
                if inner == b"infe" and version >= 2:
                    n = 2 if version == 2 else 4
                    if f.at(c + 4 + n + 2, 4) == b"Exif":
                        exif = f.number(c + 4, n)
        elif kind == b"iloc":
            version, sizes = f.number(x, 1), f.number(x + 4, 2)
            o, n, base_n, index_n = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, (sizes & 15) * (version > 0)
            wide = 4 if version == 2 else 2
            at = x + 6 + wide
            for _ in range(f.number(x + 6, wide)):
                item = f.number(at, wide)
                method = f.number(at + wide, 2) & 15 if version else 0
                at += wide + (2 if version else 0) + 2
                base = f.number(at, base_n) if base_n else 0
                extents = f.number(at + base_n, 2)
                at += base_n + 2
                if extents and not method:
                    places[item] = base + (f.number(at + index_n, o) if o else 0), f.number(at + index_n + o, n)
                at += extents * (index_n + o + n)
        elif kind == b"iprp":
            shown = [(f.number(e + 4, 4), f.number(e + 8, 4)) for k, c, d in _atoms(f, x, y) if k == b"ipco" for p, e, _ in _atoms(f, c, d) if p == b"ispe"]
            if shown:
                out["width"], out["height"] = max(shown, key=lambda s: s[0] * s[1])
    if exif in places:
        at, n = places[exif]
        begin = at + 4 + f.number(at, 4)
        _exif(f, begin, at + n, out)


def _atomic(f: Ranges, out: dict) -> None:
    for kind, a, b in _atoms(f, 0, f.size):
        if kind == b"moov":
            _movie(f, a, b, out)
        elif kind == b"meta":
            _still(f, a, b, out)


# -- EBML -------------------------------------------------------------------------------------------------------------------
def _elements(f: Ranges, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of the bodies of the elements in a range."""
    while at < end:
        first = f.number(at, 1)
        n = 9 - first.bit_length()
        if n > 4:
            return
        name, at = f.number(at, n), at + n
        first = f.number(at, 1)
        m = 9 - first.bit_length()
        if m > 8:
            return
        size = f.number(at, m) & (1 << 7 * m) - 1
        at += m
        stop = end if size == (1 << 7 * m) - 1 else min(at + size, end)
        yield name, at, stop
        at = stop


def _ebml(f: Ranges, out: dict) -> None:
    for name, a, b in _elements(f, 0, f.size):
        if name == 0x1A45DFA3:
            out["container"] = next((f.at(c, d - c).decode("latin-1") for k, c, d in _elements(f, a, b) if k == 0x4282), "matroska")
        elif name == 0x18538067:
            for part, c, d in _elements(f, a, b):
                if part == 0x1549A966:
                    scale, length = 1_000_000, None
                    for k, x, y in _elements(f, c, d):
                        if k == 0x2AD7B1:
                            scale = f.number(x, y - x)
                        elif k == 0x4489:
                            length = struct.unpack(">f" if y - x == 4 else ">d", f.at(x, y - x))[0]
                    out["duration"] = length * scale / 1e9 if length is not None else None
                elif part == 0x1654AE6B:
                    for k, x, y in _elements(f, c, d):
                        if k == 0xAE and "codec" not in out:
                            track = {t: (p, q) for t, p, q in _elements(f, x, y)}
                            if 0xE0 in track and 0x86 in track:
                                out["codec"] = f.at(track[0x86][0], track[0x86][1] - track[0x86][0]).decode("latin-1")
                                size = {t: f.number(p, q - p) for t, p, q in _elements(f, *track[0xE0]) if t in (0xB0, 0xBA)}
                                out["width"], out["height"] = size.get(0xB0), size.get(0xBA)
                elif part == 0x1F43B675:
                    return


def walk(read: Callable[[int, int], bytes], size: int) -> dict:
    """The header fields of one file; what can't be parsed is left out."""
    f, out = Ranges(read, size), {}
    complete = True
    try:
        head = f.at(0, 16)
        if head[:2] == b"\xff\xd8":
            out["container"] = "jpeg"
            _jpeg(f, out)
        elif head[:8] == b"\x89PNG\r\n\x1a\n":
            out["container"] = "png"
            _png(f, out)
        elif head[:4] in (b"II*\0", b"MM\0*"):
            out["container"] = "tiff"
            _exif(f, 0, size, out)
        elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            out["container"] = "webp"
            _webp(f, out)
        elif head[:4] == b"\x1aE\xdf\xa3":
            _ebml(f, out)
        elif head[4:8] in (b"ftyp", b"moov", b"wide", b"mdat", b"free", b"skip"):
            out["container"] = head[8:12].decode("latin-1").strip() if head[4:8] == b"ftyp" else "qt"
            _atomic(f, out)
    except Enough:
        complete = False
    except (ValueError, struct.error, IndexError, OverflowError):
        pass
    return out | {"bytes_read": f.bytes_read, "complete": complete}


# -- as tables --------------------------------------------------------------------------------------------------------------
def headers_of(files: DataFrame, content: str = "content") -> DataFrame:
    """The other columns of ``files`` with the header fields of a binary column, which may be null."""
    kept = [c for c in files.columns if c != content]
    given = files.select(*kept, content)
    schema = ", ".join([*[f"`{n}` {t}" for n, t in given.dtypes[:-1]], _DDL])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(batch.num_columns - 1):
                whole = value.as_py() or b""
                found.append(walk(lambda at, n, w=whole: w[at : at + n], len(whole)))
            columns = [pa.array([x.get(name) for x in found], _ARROW[t]) for name, t in FIELDS.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*kept, *FIELDS])

    return given.mapInArrow(run, schema)


class Share(InputPartition):
    """The files of a folder, or of the whole tree below it, whose path's hash falls to ``part`` of ``parts``."""

    def __init__(self, folder: str, below: bool, part: int, parts: int):
        self.folder, self.below, self.part, self.parts = folder, below, part, parts


def _system(root: str) -> tuple[pa_fs.FileSystem, str]:
    if "://" not in root and not root.startswith("file:"):
        return pa_fs.LocalFileSystem(), root
    if root.startswith("file:"):
        return pa_fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    return pa_fs.FileSystem.from_uri(root)


class HeaderReader(DataSourceReader):
    def __init__(self, root: str, parts: int):
        self.root, self.parts = root, parts

    def partitions(self) -> list[Share]:
        system, top = _system(self.root)
        if not self.parts > 0:
            raise ValueError("parts must be positive")
        inner, level = [], [top]
        while level and len(inner) + len(level) < MOST_FOLDERS:
            below = [i.path for folder in level for i in system.get_file_info(pa_fs.FileSelector(folder)) if i.type == pa_fs.FileType.Directory and not i.base_name.startswith(".")]
            inner, level = inner + level, below
        folders = [(f, False) for f in inner] + [(f, True) for f in level]
        return [Share(f, below, i, self.parts) for f, below in folders for i in range(self.parts)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        system, top = _system(self.root)
        rows: list[dict] = []
        names = ["path", "size", *FIELDS]
        types = [pa.string(), pa.int64(), *[_ARROW[t] for t in FIELDS.values()]]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)
        wanted = set(C.VIDEO + C.IMAGE + C.AUDIO)
        for info in system.get_file_info(pa_fs.FileSelector(share.folder, recursive=share.below)):
            relative = info.path[len(top.rstrip("/")) + 1 :]
            hidden = any(p.startswith(".") for p in relative.split("/"))
            if info.type != pa_fs.FileType.File or hidden or info.extension.lower() not in wanted or zlib.crc32(relative.encode()) % share.parts != share.part:
                continue
            with system.open_input_file(info.path) as f:
                rows.append({"path": relative, "size": info.size} | walk(lambda at, n, f=f: f.read_at(n, at), info.size))
            if len(rows) >= 1000:
                yield batch()
                rows.clear()
        yield batch()


class MediaHeaders(DataSource):
    """``path, size`` and the header fields of media files. Options: ``path``, ``parts`` (shares of a folder, 4)."""

    @classmethod
    def name(cls) -> str:
        return "media_headers"

    def schema(self) -> str:
        return f"path string, size long, {_DDL}"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options["path"], int(self.options.get("parts", 4)))


def media_headers(spark: SparkSession, root: str, parts: int = 4) -> DataFrame:
    spark.dataSource.register(MediaHeaders)
    return spark.read.format("media_headers").option("parts", parts).load(root)


def captures(headers: DataFrame, path: str = "path", modified: str = "modified", today: Column | None = None) -> DataFrame:
    """Adds ``captured_at``, ``captured_local``, ``has_zone``, ``captured_source``, ``latitude``, ``longitude``, ``altitude`` and ``gps_source``.

    The header's time (EXIF of pictures, the creation date of others) counts if it's plausible, then the clock in
    the file's name, then the file's own date (``modified``). Positions that can't be are left out.
    """
    image = C.media_kind(F.col(path)) == "image"
    header = F.when(image, C.exif_capture(F.col("exif_time"), F.col("exif_offset"))).otherwise(C.metadata_capture(F.col("created")))
    name = C.filename(F.col(path))
    dji = C.dji_clock(name)
    day = today if today is not None else F.current_date()
    plausible = lambda at, year=None: F.coalesce(C.plausible_capture(at, day, year), F.lit(False))
    none = F.lit(None).cast("string")
    clock = lambda at, local, zone, source: F.struct(at.alias("at"), local.alias("local"), zone.alias("zone"), F.lit(source).alias("source"))
    own = F.col("_header")
    chosen = F.when(plausible(own["at"], F.substring(own["local"], 1, 4).try_cast("int")), clock(own["at"], own["local"], own["has_zone"], "header"))
    chosen = chosen.when(plausible(dji), clock(dji, F.date_format(dji, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(False), "dji_filename"))
    chosen = chosen.when(F.col(modified).isNotNull(), clock(F.col(modified).cast("timestamp"), none, F.lit(True), "file_date"))
    spot = C.iso6709(F.trim(F.translate("location", "/", " ")))
    at = {c: F.when(image, F.col(c)).otherwise(spot[c]) for c in ("latitude", "longitude", "altitude")}
    rest = [c for c in headers.columns if c not in at]
    usable = C.usable_gps(F.col("_at.latitude"), F.col("_at.longitude"))
    out = headers.select(*rest, header.alias("_header"), F.struct(*[v.alias(c) for c, v in at.items()]).alias("_at")).withColumn("_clock", chosen)
    where = [F.when(usable, F.col(f"_at.{c}")).alias(c) for c in at]
    return out.select(*rest, F.col("_clock.at").alias("captured_at"), F.col("_clock.local").alias("captured_local"), F.col("_clock.zone").alias("has_zone"), F.col("_clock.source").alias("captured_source"), *where, F.when(usable, "header").alias("gps_source"))
