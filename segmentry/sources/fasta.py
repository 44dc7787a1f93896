"""Reference letters of FASTA files by byte ranges.

Lines of a record have one length, so a letter's byte follows from an index of records: where
the letters begin, how many there are, and letters and bytes of a line. The index is made by
a scan in byte ranges of its own, whose summaries are put together in file order; files with
an index beside them (`.fai`) are not scanned. A record is then as many partitions as its
letters need, and a task reads and holds the bytes of one.

Files are opened by pyarrow, from any store that it knows; other stores, compressed files and
records of uneven lines are read by `text.read_reference`, a record a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Letters of a partition; bytes of a range of the scan; rows of a batch.
LETTERS, SCAN_BYTES, BATCH = 1 << 24, 1 << 26, 256
CHUNK, TAIL = 1000, 200
NEWLINE, HEAD = 10, 62


@dataclass(frozen=True)
class Record:
    """A record of a file: its name, letters, byte of the first letter, letters of a line and bytes of a line."""

    file: str
    name: str
    length: int
    offset: int
    line: int
    width: int

    def byte(self, letter: int) -> int:
        return self.offset + letter // self.line * self.width + letter % self.line


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, or of a folder without its hidden files and indexes."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(at)) if x.is_file]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else path.split(":")[0] + "://"
    return sorted((prefix + x.path, x.size) for x in found if not x.base_name.startswith(("_", ".")) and not x.base_name.endswith((".fai", ".crc")))


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class ScanReader(DataSourceReader):
    """Runs of lines of one record in each byte range; a line is of the range that its first byte is in."""

    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("scanbytes", SCAN_BYTES))

    def partitions(self) -> list[Range]:
        return [Range(f, at, min(at + self.step, size)) for f, size in files(self.path) for at in range(0, size, self.step)]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # There are no bytes.
            return
        store, at = opened(partition.file)
        with store.open_input_file(at) as f:
            back = min(1, partition.start)
            f.seek(partition.start - back)
            raw = f.read(partition.end - partition.start + back)
            # The last line goes on to its end.
            while not raw.endswith(b"\n") and (more := f.read(1 << 12)):
                cut = more.find(b"\n") + 1
                raw += more[: cut or len(more)]
        # What comes before the first line that begins here is of the range before.
        begin = raw.find(b"\n") + 1 if back else 0
        if begin or not back:
            yield from ((partition.file, *row) for row in runs_of(raw[begin:], partition.start - back + begin))


def runs_of(raw: bytes, base: int) -> list[tuple]:
    """(offset, name, lines, letters, first line's letters and bytes, last line's letters, even, blank): a header opens a run; a run without
    a name goes on with the record before. `even`: all lines but the last are as long as the first; `blank`: empty lines follow."""
    if not raw:
        return []
    data = np.frombuffer(raw, dtype=np.uint8)
    ends = np.flatnonzero(data == NEWLINE) + 1
    ends = ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    widths = ends - starts
    # Without line feed and carriage return.
    letters = widths - (data[ends - 1] == NEWLINE)
    letters = letters - ((letters > 0) & (data[np.maximum(starts + letters - 1, 0)] == 13))
    heads = np.flatnonzero(data[starts] == HEAD)
    out = []
    for lo, hi, named in zip([0, *(heads + 1)], [*heads, len(starts)], [False, *[True] * len(heads)]):
        n, w = letters[lo:hi], widths[lo:hi]
        while len(n) and n[-1] == 0:
            n, w = n[:-1], w[:-1]
        blank = len(n) < hi - lo
        if lo == hi and not named:
            continue
        name = raw[starts[lo - 1] + 1 : ends[lo - 1]].split() if named else None
        even = bool(len(n) < 3 or ((n[:-1] == n[0]) & (w[:-1] == w[0])).all())
        offset = base + int(starts[lo]) if lo < len(starts) else base + len(raw)
        first = (int(n[0]), int(w[0]), int(n[-1])) if len(n) else (0, 0, 0)
        out.append((offset, (name[0].decode() if name else "") if named else None, len(n), int(n.sum()), *first, even, blank))
    return out


class ScanSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segmentry_fasta_scan"

    def schema(self) -> str:
        return "file string, offset long, name string, lines long, letters long, line long, width long, last long, even boolean, blank boolean"

    def reader(self, schema) -> ScanReader:
        return ScanReader(self.options)


def records_of(runs: list) -> list[Record]:
    """Records from the runs of all ranges; one whose lines differ before the last is an error."""
    out: list[Record] = []
    open_: list = []

    def close():
        held = [r for r in open_ if r["lines"]]
        if open_:
            first = held[0] if held else open_[0]
            line, width = max(1, first["line"]), max(1, first["width"])
            # Empty lines may only end a record.
            late = [r for r in open_ if r["blank"] and held and r["offset"] < held[-1]["offset"]]
            for r, following in zip(held, [*held[1:], None]):
                full = r["line"] == line and r["width"] == width or (following is None and r["lines"] == 1 and r["line"] <= line)
                ends = r["last"] == line if following is not None else r["last"] <= line
                if not (r["even"] and full and ends) or late:
                    raise ValueError(f"{open_[0]['file']}: lines of record {open_[0]['name']} differ in length; read it by read_reference")
            out.append(Record(open_[0]["file"], open_[0]["name"] or "", sum(r["letters"] for r in held), first["offset"], line, width))
        open_.clear()

    for r in sorted(runs, key=lambda r: (r["file"], r["offset"], r["name"] is None)):
        if r["name"] is not None or (open_ and open_[0]["file"] != r["file"]):
            close()
        if r["name"] is None and not open_:
            raise ValueError(f"{r['file']}: letters before the first header")
        open_.append(r)
    close()
    return out


def listed(path: str) -> list[Record] | None:
    """Records by the indexes beside the files; None if one has none."""
    out = []
    for file, _ in files(path):
        store, at = opened(file + ".fai")
        if store.get_file_info(at).type == fs.FileType.NotFound:
            return None
        with store.open_input_stream(at) as f:
            for line in f.read().decode().splitlines():
                name, *numbers = line.split("\t")[:5]
                out.append(Record(file, name, *map(int, numbers)))
    return out


def index(spark: SparkSession, path: str, scan_bytes: int = SCAN_BYTES) -> list[Record]:
    """The records of FASTA files: from their indexes, else by a scan, of which a row for each record and range reaches the driver."""
    if (held := listed(path)) is not None:
        return held
    spark.dataSource.register(ScanSource)
    runs = spark.read.format(ScanSource.name()).options(path=path, scanBytes=scan_bytes).load()
    return records_of(runs.collect())


def write_index(records: list[Record]) -> None:
    """An index beside each file."""
    by_file: dict[str, list[Record]] = {}
    for r in records:
        by_file.setdefault(r.file, []).append(r)
    for file, own in by_file.items():
        store, at = opened(file + ".fai")
        with store.open_output_stream(at) as f:
            f.write("".join(f"{r.name}\t{r.length}\t{r.offset}\t{r.line}\t{r.width}\n" for r in own).encode())


class Letters(InputPartition):
    def __init__(self, record: Record, start: int, end: int):
        self.record, self.start, self.end = record, start, end


class FastaReader(DataSourceReader):
    """Chunks of letters with those that follow them; a partition is a range of a record's chunks."""

    def __init__(self, options):
        self.records = [Record(**r) for r in json.loads(options["records"])]
        self.chunk, self.tail = int(options["chunk"]), int(options["tail"])
        self.step = max(1, int(options["letters"]) // self.chunk) * self.chunk

    def partitions(self) -> list[Letters]:
        return [Letters(r, at, min(at + self.step, r.length)) for r in self.records for at in range(0, max(r.length, 1), self.step)]

    def read(self, partition: Letters) -> Iterator[pa.RecordBatch]:
        r, last = partition.record, min(partition.end + self.tail, partition.record.length)
        text = ""
        if partition.start < last:
            store, at = opened(r.file)
            with store.open_input_file(at) as f:
                f.seek(r.byte(partition.start))
                text = f.read(r.byte(last - 1) + 1 - r.byte(partition.start)).translate(None, b"\r\n").upper().decode("ascii")
        places = range(partition.start, max(partition.end, partition.start + 1), self.chunk)
        for at in range(0, len(places), BATCH):
            part = places[at : at + BATCH]
            seqs = [text[p - partition.start : p - partition.start + self.chunk + self.tail] for p in part]
            columns = [pa.array([r.name] * len(part)), pa.array([p // self.chunk for p in part], pa.int32()), pa.array(seqs)]
            yield pa.RecordBatch.from_arrays(columns, ["chrom", "chunk", "seq"])


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segmentry_fasta"

    def schema(self) -> str:
        return "chrom string, chunk int, seq string"

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK, tail: int = TAIL, chroms: list[str] | None = None, letters: int = LETTERS, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """(chrom, chunk, seq) of FASTA files, upper case, each chunk with the `tail` letters that follow it in its record.

    A record without letters gives one empty chunk, a file without records no rows. Only the
    bytes of the records named in `chroms` are read, if it is given. Names end at white space.
    """
    held = index(spark, path, scan_bytes)
    held = [r for r in held if chroms is None or r.name in chroms]
    if not held:
        return spark.createDataFrame([], "chrom string, chunk int, seq string")
    spark.dataSource.register(FastaSource)
    told = json.dumps([asdict(r) for r in held])
    return spark.read.format(FastaSource.name()).options(records=told, chunk=chunk, tail=tail, letters=letters).load()


def write_fasta(rows: DataFrame, path: str, name: str, order: str, seq: str, line: int) -> None:
    """A record for each name, of the sequences in order; each sequence is to be whole lines of `line` letters, but for a record's last.

    Records are dealt over files by name and streamed in order; none is split over files.
    """
    width = F.lit(line)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(seq) - 1) / line).cast("int"))), lambda i: F.substr(F.col(seq), i * width + 1, width))
    body = rows.select(F.col(name).alias("n"), F.lit(1).alias("k"), F.col(order).alias("o"), F.array_join(cut, "\n").alias("value"))
    head = rows.groupBy(F.col(name).alias("n")).agg(F.min(order).alias("o")).select("n", F.lit(0).alias("k"), "o", F.concat(F.lit(">"), "n").alias("value"))
    head.union(body).repartitionByRange("n").sortWithinPartitions("n", "k", "o").select("value").write.text(path)
