"""Token ids in flat binary files with 64-bit document offsets.

Documents are range-partitioned by id, by as many partitions as their bytes need, so
partition k holds the k-th run of ids; rows that share an id are dealt further by their text,
and equal rows, which the files cannot tell apart, by their place. Each task
encodes its documents and writes three files for its partition: `.ids`, unsigned little-
endian integers (16 bits wide if the vocabulary allows, else 32); `.off`, int64 offsets of
the documents inside it and its end; `.doc`, their int64 ids. A file is written under a
name of the attempt and then renamed, so a task that runs again leaves the same result.
Bases of the partitions are prefix sums of their token counts, kept in a manifest; readers
map the files into memory where the file system is local or mounted.

Texts are encoded by the tokenizers library. Byte-level BPE with its usual word pattern
never joins a piece across a space that has no white space beside it, so such texts are
encoded unit by unit (a word and the space before it), and a worker keeps the ids of units
in a bounded table; other tokenizers and texts with added tokens in them are encoded whole.
A new unit of Latin letters and the marks after them, in one line or several, is pieces of
that pattern, which the library's model merges as they are; other units go through the
library's whole path.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Units whose ids a worker keeps, about 250 bytes each.
KEPT_UNITS = 600_000
#: The letter that stands for the space byte in byte-level vocabularies.
SPACE = "\u0120"
#: Letters that make one piece with the space before them, and marks after them that make another.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+)([!-&(-/:-@[-`{-~]*)")
#: Letters for bytes in byte-level vocabularies; those not listed stand for themselves.
BYTE_LETTERS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: Runs of marks whose ids a worker keeps.
KEPT_MARKS = 4096
#: Bytes of text for which there is a partition.
PART_BYTES = 32 << 20
#: Characters of text whose words a worker holds apart at once, unless one text has more.
SLICE_CHARS = 1_000_000
NO_ID = np.iinfo(np.int64).min


class Encoder:
    """Texts to little-endian ids by one tokenizer file."""

    def __init__(self, path: str, end_id: int = END_ID, kept_units: int = KEPT_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], dtype=self.dtype).tobytes()
        before = spec["pre_tokenizer"] or {}
        self.by_unit = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec["normalizer"]
        self.added = [t["content"] for t in spec["added_tokens"]]
        # In byte-level vocabularies only pieces that begin with the space byte hold this letter first.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True
        self.kept: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.newline = self.whole("\n")
        self.most = kept_units

    def splits(self, text: str) -> bool:
        return self.by_unit and not any(t in text for t in self.added)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def piece(self, letters: str) -> bytes:
        """Ids of what the word pattern takes as one piece, given in byte-level letters."""
        return array(self.dtype.char, [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def plain(self, word: str) -> bytes | None:
        """Ids of a space and lines of letters with the marks after them; None of another word."""
        out, before = [], SPACE
        for line in word.split("\n"):
            m = PLAIN.fullmatch(line)
            if not m:
                return None
            letters, marks = m.groups()
            head, tail = self.kept.get(letters) if before else None, self.marks.get(marks)
            if head is None:
                head = self.piece(before + (letters if letters.isascii() else letters.encode().decode("latin-1").translate(BYTE_LETTERS)))
            if tail is None:
                tail = self.piece(marks)
                if len(self.marks) < KEPT_MARKS:
                    self.marks[marks] = tail
            out += [head, tail] if before else [self.newline, head, tail]
            before = ""
        return b"".join(out)

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that each have a space before them."""
        found = {w: self.plain(w) for w in words}
        if others := [w for w, ids in found.items() if ids is None]:
            found.update(self.joined(others))
        if len(self.kept) < self.most:
            self.kept.update(found)
        return found

    def joined(self, words: list[str]) -> dict[str, bytes]:
        """As `learn`, of any words: they are encoded as one text and cut where pieces begin with the space."""
        ids = np.array(self.tokenizer.encode(" " + " ".join(words), add_special_tokens=False).ids, dtype=self.dtype)
        starts = np.flatnonzero(self.begins[ids]) * self.dtype.itemsize
        raw, ends = ids.tobytes(), [*starts[1:].tolist(), len(ids) * self.dtype.itemsize]
        return {w: raw[s:e] for w, s, e in zip(words, starts.tolist(), ends, strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id."""
        known, cut, new = self.kept.get, [], {}
        for text in texts:
            first, *words = text.split(" ") if self.splits(text) else [text]
            parts = list(map(known, words))
            if None in parts:
                fresh = [w for w, p in zip(words, parts) if p is None]
                if any(not w or w[0].isspace() or w[-1].isspace() for w in fresh):
                    first, words, parts = text, [], []
                else:
                    new.update(dict.fromkeys(fresh))
            if words and (not first or first[-1].isspace()):
                first, words, parts = text, [], []
            cut.append((first, words, parts))
        order = list(new)
        for at in range(0, len(order), 256):
            new.update(self.learn(order[at : at + 256]))
        out = []
        for first, words, parts in cut:
            head = b"".join(map(self.whole, units(first) if self.splits(first) else [first])) if first else b""
            filled = [new[w] if p is None else p for w, p in zip(words, parts)] if None in parts else parts
            out.append(b"".join([head, *filled, self.end]))
        return out


def units(text: str) -> list[str]:
    """The text cut before each space that has no white space beside it."""
    out: list[str] = []
    glued = False
    for k, word in enumerate(text.split(" ")):
        piece = " " + word if k else word
        if out and (glued or not word or word[0].isspace()):
            out[-1] += piece
        else:
            out.append(piece)
        glued = not word or word[-1].isspace()
    return out


def slices(texts: Iterable[str | None], most: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The texts in order, nulls as empty, in lists that end where they reach so many characters."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


@cache
def encoder(path: str, end_id: int) -> Encoder:
    """One for each worker process."""
    return Encoder(path, end_id)


def folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder; s3a is Spark's name for what Arrow calls s3."""
    uri = uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def put(fs: pafs.FileSystem, path: str, data) -> None:
    """Write under a name of this attempt, then rename."""
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    settle(fs, own, path)


def settle(fs: pafs.FileSystem, own: str, path: str) -> None:
    """Give an attempt's file its name; where another attempt has done so, that one stays, as both hold the same."""
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(own)
        return
    try:
        fs.move(own, path)
    except OSError:
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(own)


def part_name(root: str, part: int, kind: str) -> str:
    return f"{root}/part-{part:06d}.{kind}"


def write_tokens(spark: SparkSession, docs: DataFrame, uri: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Write docs (doc_id, text) to the folder `uri` in ascending doc_id order, nulls first.

    Null and empty texts are the end id alone. Documents that share an id keep a row each,
    ordered by a hash of the text and by the text. An empty table leaves a manifest without documents.
    """
    path = path or public_tokenizer()
    fs, root = folder(uri)
    fs.create_dir(root, recursive=True)

    def write(batches):
        fs, root = folder(uri)
        encode, part = encoder(path, end_id), TaskContext.get().partitionId()
        counts, ids, own = [0], [], f"{part_name(root, part, 'ids')}.{uuid.uuid4().hex}"
        out = None
        for batch in batches:
            out = out or fs.open_output_stream(own)
            for texts in slices(batch["text"]):
                for data in encode.encode(texts):
                    counts.append(len(data) // encode.dtype.itemsize)
                    out.write(data)
            ids += [NO_ID if pd.isna(i) else int(i) for i in batch["doc_id"].array]
        if out is None:
            return
        out.close()
        put(fs, part_name(root, part, "off"), np.cumsum(counts, dtype="<i8").tobytes())
        put(fs, part_name(root, part, "doc"), np.array(ids, dtype="<i8").tobytes())
        settle(fs, own, part_name(root, part, "ids"))
        yield pd.DataFrame({"part": [part], "docs": [len(ids)], "tokens": [int(sum(counts))], "width": [encode.dtype.itemsize]})

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-size // PART_BYTES), spark.sparkContext.defaultParallelism)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.select("doc_id", "text").repartitionByRange(n, *order, F.monotonically_increasing_id().asc())
    dealt = dealt.sortWithinPartitions(*order, "text")
    parts = dealt.mapInPandas(write, "part int, docs long, tokens long, width int").collect()
    base, manifest = 0, []
    for p in sorted(parts, key=lambda p: p["part"]):
        manifest.append({"part": p["part"], "docs": p["docs"], "tokens": p["tokens"], "width": p["width"], "base": base})
        base += p["tokens"]
    put(fs, f"{root}/manifest.json", json.dumps({"end_id": end_id, "parts": manifest}).encode())


def mapped(fs: pafs.FileSystem, path: str) -> pa.Buffer:
    """A file's bytes, mapped into memory where the file system allows it."""
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def read_manifest(uri: str) -> list[dict]:
    fs, root = folder(uri)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())["parts"]


def read_tokens(spark: SparkSession, uri: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, and its ids if asked for."""
    n = len(read_manifest(uri))

    def read(batches):
        fs, root = folder(uri)
        parts = read_manifest(uri)
        for batch in batches:
            for k in batch["id"]:
                part = parts[k]
                docs = np.frombuffer(mapped(fs, part_name(root, part["part"], "doc")), dtype="<i8")
                offsets = np.frombuffer(mapped(fs, part_name(root, part["part"], "off")), dtype="<i8")
                ids = np.frombuffer(mapped(fs, part_name(root, part["part"], "ids")), dtype=f"<u{part['width']}")
                for at in range(0, len(docs), 2048):
                    some = range(at, min(at + 2048, len(docs)))
                    rows = [ids[offsets[i] : offsets[i + 1]].astype("<u4") for i in some]
                    out = pd.DataFrame(
                        {
                            "doc_id": pd.array([None if docs[i] == NO_ID else int(docs[i]) for i in some], dtype="Int64"),
                            "start": part["base"] + offsets[some.start : some.stop],
                            "n_tokens": [len(r) for r in rows],
                            "ids_crc32": [zlib.crc32(r.tobytes()) for r in rows],
                        }
                    )
                    yield out.assign(ids=[r.astype("int64") for r in rows]) if with_ids else out

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return spark.range(0, n, 1, max(n, 1)).mapInPandas(read, schema)


def public_tokenizer(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents to token files, and what the files hold.

    Nulls, empty texts, repeats and an empty table are as in `write_tokens`.
    """
    uri = scratch(spark, "tokens")
    write_tokens(spark, docs, uri)
    return read_tokens(spark, uri)


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document in the token files. Edges as in `token_files`."""
    return token_files(spark, table(spark, sf_dir, "documents"), sf_dir)
