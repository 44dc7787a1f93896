"""Exact repeats of at least a length of bytes by a hash-compared suffix sort.

Only places that can repeat are sorted. In every window of that length the gram with the
smallest hash is its anchor, so equal windows share an anchor at the same place. A window
holds all of a string that reaches half of its other bytes left of its anchor or, if it begins nearer,
one that reaches as far right; anchors where neither string occurs twice are dropped.
Texts that equal another one whole are found by their digest and stand aside, but for one
of them.

Around each remaining anchor a context is kept: the bytes of the windows that have it, so
every window of a text is in one context.
Contexts of one gram are sorted as suffixes from the anchor to the right, and as reversed
prefixes to the left, by mergesort; a comparison finds the common extension of two
suffixes by binary search over prefix polynomial hashes, so it takes logarithmically many
steps. Windows with l bytes left of the anchor are equal exactly within runs of both
orders whose common extensions reach length - l and l; every such run is verified by its
bytes. All windows of an anchor overlap in it, so its repeated bytes are one interval.

Grams with over `crowded` different contexts are not sorted in one task. The windows of such a
group are halved by how many bytes lie left of the anchor: those of a half all hold a longer
string around it, and equal windows hold the same, so the contexts, cut to each half, are
grouped again by the hash of that string. This goes on until no group is crowded; at last a
group has windows of one place only, which are equal, so it always ends.

Equal texts are known by SHA-256 and equal contexts by BLAKE2b; what is hashed shorter
(anchors, strings, groups) only brings candidates together, which bytes then decide.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from functools import cmp_to_key

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stored, table

LENGTH, GRAM = 400, 64
#: Passages: repeated runs of over so many words, in strings of so many bytes.
PASSAGE_WORDS, PASSAGE_LENGTH = 50, 256
CROWDED = 2048
#: Longest piece of a text whose anchors are found at once; pieces overlap by length - 1.
PIECE = 1 << 19
#: Contexts that a task remembers as sent, 16 bytes each.
SEEN = 500_000
#: Keys of texts that stand aside that are broadcast at most, about 25 MB.
FEW = 1 << 18
#: Columns of an anchor.
ANCHOR = {"pos": "int64", "low": "int16", "high": "int16", "gram": "int64", "left": "int64", "right": "int64", "to": "int64"}
BASE = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1


class Powers:
    """Powers of the odd hash base and of its inverse modulo 2**64, as far as they are needed."""

    def __init__(self):
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 4096)
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.up = np.concatenate([[np.uint64(1)], np.full(size - 1, BASE, dtype=np.uint64)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([[np.uint64(1)], np.full(size - 1, inverse, dtype=np.uint64)]).cumprod(dtype=np.uint64)


POWERS = Powers()


def prefixes(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of bytes times powers: the polynomial hash of [i, j) is their difference times BASE ** -i."""
    POWERS.reach(len(raw) + 1)
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * POWERS.up[: len(raw)], dtype=np.uint64, out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes spread over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def anchors(raw: bytes, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Places of the anchors of all windows of a text: `pos`, the least and most bytes (`low`, `high`) that their
    windows hold left of them, the hash of the `gram`, and hashes of the strings that reach left and right; 0: none.

    Where a text repeats itself at once, as in a run of one letter, an anchor whose windows all equal those of the
    anchor before is left out: another occurrence of such a window is found by the one that stays. The bytes from
    `pos` to `to` of such windows are repeated; `to` is 0 for anchors."""
    found = [anchors_of_piece(raw, at, length) for at in range(0, max(len(raw) - length + 1, 0), PIECE)]
    return {name: np.concatenate([x[name] for x in found]) if found else np.zeros(0, dtype=np.int64) for name in ANCHOR}


def anchors_of_piece(raw: bytes, at: int, length: int) -> dict[str, np.ndarray]:
    span = length - GRAM + 1
    half = span // 2
    piece = np.frombuffer(raw, dtype=np.uint8, count=min(PIECE + length - 1, len(raw) - at), offset=at)
    sums = prefixes(piece)
    n = len(piece) - GRAM + 1
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * POWERS.down[:n])
    bits = np.uint64((1 << 20) - 1)
    # The smallest hash of a window and, of equal ones, the leftmost.
    ranked = (grams & ~bits) | np.arange(n, dtype=np.uint64)
    rows = -(-n // span)
    padded = np.full(rows * span, MASK, dtype=np.uint64)
    padded[:n] = ranked
    blocks = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - span + 1
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [windows]]) - 1
    place = (least[first] & bits).astype(np.int64)
    low, high = place - last, place - first

    again = repeated_at_once(piece, place, low, high, grams[place], length)
    begin, end = (place - high)[again] - np.diff(place, prepend=0)[again], (place - low)[again] + length
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])) if len(begin) else np.zeros(0, dtype=np.int64)
    runs = {"pos": begin[first] + at, "to": end[np.append(first[1:], len(end)) - 1] + at if len(first) else first}
    place, low, high = place[~again], low[~again], high[~again]

    def hashes(begin: np.ndarray, end: np.ndarray, there: np.ndarray, side: int) -> np.ndarray:
        out = np.zeros(len(place), dtype=np.int64)
        b, e = begin[there], end[there]
        out[there] = (mixed((sums[e] - sums[b]) * POWERS.down[b] + np.uint64(side)) | np.uint64(1)).view(np.int64)
        return out

    left = hashes(place - half, place + GRAM, high >= half, 1)
    right = hashes(place, place + length - half + 1, low < half, 2)
    out = {"pos": place + at, "low": low, "high": high, "gram": grams[place].view(np.int64), "left": left, "right": right, "to": np.zeros(len(place), dtype=np.int64)}
    none = np.zeros(len(first), dtype=np.int64)
    return {name: np.concatenate([out[name], runs.get(name, none)]) for name in ANCHOR}


def repeated_at_once(piece: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, grams: np.ndarray, length: int) -> np.ndarray:
    """Which anchors have only windows that equal those as far before them as the anchor before is."""
    out, gap = np.zeros(len(place), dtype=bool), np.diff(place, prepend=0)
    alike = np.flatnonzero(grams[1:] == grams[:-1]) + 1
    for p in np.unique(gap[alike]).tolist():
        at = alike[gap[alike] == p]
        differ = np.concatenate([[0], np.cumsum(piece[:-p] != piece[p:])])
        begin, end = place[at] - high[at] - p, place[at] - low[at] - p + length
        out[at] = (begin >= 0) & (differ[end] == differ[np.maximum(begin, 0)])
    return out


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def find_anchors(length: int):
    def found_in(batches):
        for batch in batches:
            found = [anchors(utf8(t), length) for t in batch["text"]]
            at = np.repeat(np.arange(len(batch)), [len(x["pos"]) for x in found])
            out = batch[["key", "h"]].iloc[at].reset_index(drop=True)
            for name, kind in ANCHOR.items():
                out[name] = np.concatenate([x[name] for x in found]).astype(kind) if found else np.zeros(0, dtype=kind)
            yield out

    return found_in


def digest(left: int, context: bytes) -> bytes:
    return hashlib.blake2b(b"%d:" % left + context, digest_size=16).digest()


def cut_contexts(length: int):
    """For texts with their repeated anchors: a row for each place, with its context where the task meets it first."""

    def cut(batches):
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            if len(seen) > SEEN:
                seen.clear()
            for doc, h, text, *marks in zip(*(batch[x] for x in ("key", "h", "text", "places", "lows", "highs", "grams"))):
                raw = utf8(text)
                for pos, low, high, gram in zip(*(x.tolist() for x in marks)):
                    context = raw[pos - high : pos - low + length]
                    cid = digest(high, context)
                    rows.append((doc, h, pos, gram, cid, high, None if cid in seen else context))
                    seen.add(cid)
            out = pd.DataFrame(rows, columns=["key", "h", "pos", "gram", "cid", "left", "context"])
            yield out.astype({"h": "int64", "pos": "int64", "gram": "int64", "left": "int32"})

    return cut


def halved(length: int):
    """Contexts of crowded groups, whose windows have `first` to `last` bytes left of the anchor, cut to either half of those."""

    def halves(batches):
        for batch in batches:
            rows = []
            for gram, cid, left, first, last, context, n in batch[["gram", "cid", "left", "first", "last", "context", "n"]].itertuples(index=False, name=None):
                low, middle = max(0, left + length - len(context)), (first + last + 1) // 2
                for a, b in ((first, middle - 1), (middle, last)):
                    lo, hi = max(low, a), min(left, b)
                    if lo <= hi:
                        part = context[left - hi : left - lo + length]
                        core = hashlib.blake2b(b"%d:%d:%d:" % (gram, a, b) + context[left - a : left - b + length], digest_size=8).digest()
                        rows.append((gram, cid, int.from_bytes(core, "little", signed=True), digest(hi, part), hi, a, b, part, n))
            out = pd.DataFrame(rows, columns=["up_gram", "up_cid", "gram", "cid", "left", "first", "last", "context", "n"])
            yield out.astype({"up_gram": "int64", "gram": "int64", "left": "int32", "first": "int32", "last": "int32", "n": "int64"})

    return halves


class Sorted:
    """Suffixes of one direction in order, with the common extensions of neighbours."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        # Every suffix has its own prefix hashes, so equal beginnings have equal entries.
        self.sums = [array("Q", prefixes(np.frombuffer(t, dtype=np.uint8)).tobytes()) for t in texts]
        self.order = sorted(range(len(texts)), key=cmp_to_key(self.compare))
        self.common = np.array([self.extension(a, b) for a, b in zip(self.order, self.order[1:])], dtype=np.int64)

    def extension(self, a: int, b: int) -> int:
        """Bytes that both begin with, by binary search over prefix hashes."""
        one, two = self.sums[a], self.sums[b]
        low, high = 0, min(len(one), len(two)) - 1
        while low < high:
            middle = (low + high + 1) // 2
            if one[middle] == two[middle]:
                low = middle
            else:
                high = middle - 1
        return low

    def compare(self, a: int, b: int) -> int:
        n = self.extension(a, b)
        x, y = self.texts[a][n : n + 1], self.texts[b][n : n + 1]
        return -1 if x < y else x > y

    def longest(self) -> np.ndarray:
        """For each suffix the most that it shares with any other: with a neighbour in the order."""
        out = np.empty(len(self.order), dtype=np.int64)
        ends = np.concatenate([[0], self.common, [0]])
        out[self.order] = np.maximum(ends[:-1], ends[1:])
        return out

    def runs(self, least: int) -> np.ndarray:
        """For each suffix the run of the order in which neighbours share `least` bytes."""
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.concatenate([[0], np.cumsum(self.common < least)])
        return out


def intervals(contexts: list[bytes], lefts: list[int], counts: list[int], length: int = LENGTH) -> list[tuple[int, int] | None]:
    """For each context the least and most bytes left of the anchor over its repeated windows, or none.

    Bytes beyond what a context shares with any other on a side are cut first; contexts
    that are then equal are one, so a passage in many texts is few contexts.
    """
    found: list[tuple[int, int] | None] = [None] * len(contexts)
    if len(contexts) > 1:
        right = Sorted([c[left:] for c, left in zip(contexts, lefts)]).longest()
        behind = Sorted([c[:left][::-1] for c, left in zip(contexts, lefts)]).longest()
        cut: dict[tuple[bytes, bytes], list[int]] = {}
        for i, (c, left, r, b) in enumerate(zip(contexts, lefts, right.tolist(), behind.tolist())):
            if r + b >= length:
                cut.setdefault((c[left - b : left][::-1], c[left : left + r]), []).append(i)
        for members, mark in zip(cut.values(), shared([*cut], [len(x) for x in cut.values()], length)):
            for i in members:
                found[i] = mark
    for i, (c, left, n) in enumerate(zip(contexts, lefts, counts)):
        if n > 1 and len(c) >= length:
            found[i] = (max(0, left + length - len(c)), left)
    return found


def shared(sides: list[tuple[bytes, bytes]], counts: list[int], length: int) -> list[tuple[int, int] | None]:
    """Of different (reversed left, right) sides, each held `counts` times: least and most left bytes of repeated windows."""
    m = len(sides)
    found: list[tuple[int, int] | None] = [(length - len(r), len(b)) if n > 1 else None for (b, r), n in zip(sides, counts)]
    found = [(max(0, x[0]), x[1]) if x else None for x in found]
    if m < 2:
        return found
    right, behind = Sorted([r for _, r in sides]), Sorted([b for b, _ in sides])
    for l in sorted({x for x in [*behind.common.tolist(), *(length - right.common).tolist()] if 0 <= x <= length - GRAM}):
        ids = right.runs(length - l) * m + behind.runs(l)
        _, inverse, sizes = np.unique(ids, return_inverse=True, return_counts=True)
        windows = {}
        for i in np.flatnonzero(sizes[inverse] > 1).tolist():
            b, r = sides[i]
            if len(b) >= l and len(r) >= length - l:
                windows[i] = b[:l][::-1] + r[: length - l]
        # Collisions of hashes: only windows whose bytes are held twice count.
        held = Counter(windows.values())
        for i, w in windows.items():
            if held[w] > 1:
                low, high = found[i] or (l, l)
                found[i] = (min(low, l), max(high, l))
    return found


def sort_groups(length: int):
    """Contexts in order of their gram to (gram, cid, low, high)."""

    def grouped(batches):
        gram, held = None, []

        def done():
            marks = intervals([r[3] for r in held], [r[2] for r in held], [r[4] for r in held], length)
            return [(gram, r[1], *mark) for r, mark in zip(held, marks) if mark]

        def frame(rows):
            return pd.DataFrame(rows, columns=["gram", "cid", "low", "high"])

        for batch in batches:
            rows = []
            for row in batch[["gram", "cid", "left", "context", "n"]].itertuples(index=False, name=None):
                if row[0] != gram:
                    rows += done() if held else []
                    gram, held = row[0], []
                held.append(row)
            yield frame(rows)
        yield frame(done() if held else [])

    return grouped


def merge(lows: list[int], highs: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(zip(lows, highs)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def spans_of(raw: bytes, length: int, copied, starts, ends) -> list[tuple[int, int]]:
    if copied and len(raw) >= length:
        return [(0, len(raw))]
    return merge(list(starts), list(ends)) if starts is not None else []


def remove(length: int, passage_length: int, passage_words: int):
    """Texts with the intervals of their repeated bytes to what is left, and to their passages."""

    def removed(batches):
        for batch in batches:
            rows = []
            for doc, text, copied, starts, ends, begins, stops in zip(*(batch[x] for x in ("doc_id", "text", "copied", "starts", "ends", "passage_starts", "passage_ends"))):
                raw = utf8(text)
                spans = spans_of(raw, length, copied, starts, ends)
                passages = [(s, e) for s, e in spans_of(raw, passage_length, copied, begins, stops) if len(raw[s:e].split(None, passage_words)) > passage_words]
                kept, at = [], 0
                for s, e in spans:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                width = lambda x: sum(e - s for s, e in x)
                sides = [[s for s, _ in spans], [e for _, e in spans], [s for s, _ in passages], [e for _, e in passages]]
                rows.append((doc, len(raw), width(spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), *sides, width(passages)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "passage_starts", "passage_ends", "n_passage_bytes"])
            yield out.astype({"doc_id": batch["doc_id"].dtype})

    return removed


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key: ids as text, so that rows without an id are joined too; with the hash a key is one text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", key.alias("key"), F.xxhash64("text").alias("h"), "text")


def covered(spark: SparkSession, rows: DataFrame, aside: DataFrame, length: int, crowded: int) -> DataFrame:
    """(key, h, starts, ends): intervals of the repeated bytes of texts that do not stand aside, overlapping as found."""
    schema = "key string, h long, pos long, low short, high short, gram long, left long, right long, to long"
    found, found_path = stored(spark, rows.mapInPandas(find_anchors(length), schema), "anchors")
    found = found.join(aside, ["key", "h"], "left_anti")
    runs, runs_path = stored(spark, found.where("to > 0").select("key", "h", "pos", "to"), "runs")
    sides = found.select("key", "h", F.struct("pos", "low", "high", "gram").alias("a"), F.explode(F.array("left", "right")).alias("side")).where("side <> 0")
    # As a table, the counted strings join in a way that Spark can split where one string is very frequent.
    several, several_path = stored(spark, sides.groupBy("side").count().where("count > 1").select("side"), "several")
    listed = sides.join(several, "side").groupBy("key", "h").agg(F.collect_set("a").alias("a"))
    listed = listed.select("key", "h", F.col("a.pos").alias("places"), F.col("a.low").alias("lows"), F.col("a.high").alias("highs"), F.col("a.gram").alias("grams"))
    texts = rows.select("key", "h", "text").join(listed, ["key", "h"]).dropDuplicates(["key", "h"])
    schema = "key string, h long, pos long, gram long, cid binary, left int, context binary"
    contexts, contexts_path = stored(spark, texts.mapInPandas(cut_contexts(length), schema), "contexts")
    drop(spark, found_path, several_path)

    paths, marks, ups = [runs_path, contexts_path], [], []
    work = contexts.select("gram", "cid", "left", F.lit(0).alias("first"), F.lit(length - GRAM).alias("last"), "context", F.lit(1).cast("long").alias("n"))
    while True:
        counts = work.groupBy("gram", "cid").count().groupBy("gram").count()
        large, path = stored(spark, counts.where(F.col("count") > crowded).select("gram"), "large")
        paths.append(path)
        last = large.isEmpty()
        any_of = [F.any_value(c, F.lit(True)).alias(c) for c in ("left", "first", "last", "context")]
        different = work.groupBy("gram", "cid").agg(*any_of, F.sum("n").alias("n"))
        sortable = different if last else different.join(large, "gram", "left_anti")
        sorted_ = sortable.repartition("gram").sortWithinPartitions("gram").mapInPandas(sort_groups(length), "gram long, cid binary, low int, high int")
        sorted_, path = stored(spark, sorted_, "marks")
        marks.append(sorted_)
        paths.append(path)
        if last:
            break
        schema = "up_gram long, up_cid binary, gram long, cid binary, left int, first int, last int, context binary, n long"
        work, path = stored(spark, different.join(large, "gram").mapInPandas(halved(length), schema), "halves")
        ups.append(work.select("up_gram", "up_cid", "gram", "cid"))
        paths.append(path)
    every = marks[-1]
    for mark, up in zip(marks[-2::-1], ups[::-1]):
        every = mark.union(every.join(up, ["gram", "cid"]).select("up_gram", "up_cid", "low", "high"))
    placed = contexts.select("key", "h", "pos", "gram", "cid").join(every, ["gram", "cid"])
    each = placed.select("key", "h", (F.col("pos") - F.col("high")).alias("s"), (F.col("pos") + length - F.col("low")).alias("e"))
    each = each.union(runs)
    spans = each.groupBy("key", "h").agg(F.collect_list(F.struct("s", "e")).alias("x"))
    out, _ = stored(spark, spans.select("key", "h", F.col("x.s").alias("starts"), F.col("x.e").alias("ends")), "spans")
    drop(spark, *paths)
    return out


def repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, passage_length: int = PASSAGE_LENGTH, passage_words: int = PASSAGE_WORDS, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends, passage_starts, passage_ends, n_passage_bytes) for each row of docs (doc_id, text).

    Bytes of strings of `length` that occur again are removed. Passages are reported beside
    that, and removed only so far as they are as long: runs of bytes of repeated strings of
    passage_length that hold over passage_words words.

    Null and empty texts have no bytes and lose none; rows that repeat, with the same id or
    another, are removed whole if they have that many bytes; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = keyed(docs)
    whole = rows.select("key", "h", F.sha2("text", 256).alias("digest")).where("digest is not null")
    copies = whole.groupBy("digest").agg(F.min(F.struct("key", "h")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Of equal texts the first stands for all; what says so are keys, never texts.
    copied = whole.join(copies.select("digest", "first"), "digest").groupBy("key", "h").agg(F.max(F.struct("key", "h") == F.col("first")).alias("first"))
    copied, copies_path = stored(spark, copied, "copies")
    aside = copied.where("not first").select("key", "h")
    # While they are few their keys go to all tasks, so that anchors are not shuffled for them.
    aside = F.broadcast(aside) if aside.limit(FEW + 1).count() <= FEW else aside
    spans = covered(spark, rows, aside, length, crowded)
    passages = covered(spark, rows, aside, passage_length, crowded)
    marked = spans.join(passages.withColumnsRenamed({"starts": "passage_starts", "ends": "passage_ends"}), ["key", "h"], "full")
    marked, _ = stored(spark, marked.join(copied.select("key", "h", F.lit(True).alias("copied")), ["key", "h"], "full"), "marked")
    drop(spark, copies_path)
    ready = rows.join(marked, ["key", "h"], "left").select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "starts", "ends", "passage_starts", "passage_ends")
    arrays = ", ".join(f"{c} array<long>" for c in ("starts", "ends", "passage_starts", "passage_ends"))
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, {arrays}, n_passage_bytes long"
    return ready.mapInPandas(remove(length, passage_length, passage_words), schema)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the bytes of passages of over PASSAGE_WORDS words, which are often under LENGTH bytes."""
    found = repeats(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes")
