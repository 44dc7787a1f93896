"""The FASTA source by byte ranges against the reader of whole records, at every edge."""

import random

import pytest

from segmentry.sources import fasta
from segmentry.sources import text as T


def written(path, records, line, end="\n", last=True):
    rng = random.Random(line)
    with open(path, "w", newline="") as f:
        for k, (name, n) in enumerate(records):
            s = "".join(rng.choice("ACGTacgtN") for _ in range(n))
            lines = [s[i : i + line] for i in range(0, n, line)]
            f.write(f">{name} about it{end}" + end.join(lines) + (end if lines and (last or k < len(records) - 1) else ""))


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize(("line", "end", "last"), [(60, "\n", True), (7, "\r\n", True), (50, "\n", False), (1, "\n", True)])
def test_equals_the_reader_of_whole_records(spark, tmp_path, line, end, last):
    path = str(tmp_path / "r.fa")
    written(path, [("chr1", 5003), ("chr2", line), ("empty", 0), ("chrM", 1), ("chr3", 10 * line), ("chr4", 777)], line, end, last)
    for chunk, tail in ((100, 20), (64, 0), (7, 300))[: 3 if line == 7 else 1]:
        want = rows(T.read_reference(spark, path, chunk, tail))
        for scan, letters in ((37, 64), (311, 1000))[: 2 if line == 7 else 1]:
            frame = fasta.read_fasta(spark, path, chunk, tail, letters=letters, scan_bytes=scan)
            assert rows(frame) == want
        if chunk == 100:
            assert fasta.read_fasta(spark, path, chunk, tail, letters=500).rdd.getNumPartitions() >= 5003 // 500


def test_index_is_used_and_names_prune(spark, tmp_path):
    written(tmp_path / "a.fa", [("chr1", 950), ("chr2", 30)], 60)
    written(tmp_path / "b.fa", [("chr3", 410)], 50)
    at = f"file://{tmp_path}"
    made = fasta.index(spark, at, 40)
    assert [(r.name, r.length, r.line, r.width) for r in made] == [("chr1", 950, 60, 61), ("chr2", 30, 30, 31), ("chr3", 410, 50, 51)]
    fasta.write_index(made)
    assert fasta.index(spark, at) == made and (tmp_path / "a.fa.fai").read_text().startswith("chr1\t950\t15\t60\t61\n")
    got = fasta.read_fasta(spark, at, 100, 0, ["chr3"])
    assert {r["chrom"] for r in got.collect()} == {"chr3"} and got.rdd.getNumPartitions() == 1
    assert fasta.read_fasta(spark, at, 100, 0, ["none"]).count() == 0


@pytest.mark.parametrize("text", [">a\nACGT\nAC\nACGT\n", ">a\nACGT\n\nACGT\n", ">a\nAC\nACGT\n", "ACGT\n>a\nAC\n"])
def test_uneven_lines_are_an_error(spark, tmp_path, text):
    (tmp_path / "r.fa").write_text(text)
    for scan in (1 << 20, 5):
        with pytest.raises(ValueError, match="differ in length|before the first"):
            fasta.index(spark, str(tmp_path / "r.fa"), scan)


def test_empty_file_and_round_trip(spark, tmp_path):
    (tmp_path / "e.fa").write_text("")
    assert fasta.read_fasta(spark, str(tmp_path / "e.fa")).count() == 0
    with pytest.raises(FileNotFoundError):
        fasta.index(spark, str(tmp_path / "absent.fa"))
    data = [(f"chr{c}", i, "ACGTTGCA"[(i + c) % 5 :][:4] * 5) for c in range(5) for i in range(40)]
    at = str(tmp_path / "out")
    fasta.write_fasta(spark.createDataFrame(data, "c string, i int, s string").repartition(3), at, "c", "i", "s", 10)
    got = {(r["chrom"], r["chunk"]): r["seq"] for r in fasta.read_fasta(spark, at, 1000, 0, letters=1000).collect()}
    assert got == {(f"chr{c}", 0): "".join(s for n, _, s in data if n == f"chr{c}") for c in range(5)}
