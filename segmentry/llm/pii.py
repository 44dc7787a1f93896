"""Personal data by bootstrapped contextual extraction. DataFrame functions only.

Seeds are what the base patterns match, and long hexadecimal words as seeds of secrets. Their
contexts (the two words before; the word before and the word after) are lexical patterns.
Patterns and instances form a bipartite graph, in which Spark scores in turn: a pattern's
confidence for a kind is the mean score of its different instances, damped by one; an
instance's score is the chance that any of its supported patterns is right, and seeds keep 1.
Instances of a high score support patterns as seeds do, so what is found in one round gives
patterns to the next. Patterns of high confidence and enough support then give new spans to
what stands in their slot: identifier-like words, groups of digits with spaces, brackets, dots
or hyphens between them, and addresses with the at sign spelled out. New spans carry kinds of
their own (`ctx_email` and so on), so counts and digests of base spans stay as the contract
has them. A secret is reported only where a pattern of high confidence holds it.

Contexts of seeds and of candidates are cut alike, from the text around the span: the last
LEFT_CHARS characters before it and the first RIGHT_CHARS after it, whole words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, let, stored, table

# The base patterns, spelled so that no repetition backtracks over a long run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
KINDS = tuple(PATTERNS)
#: Kinds of the spans that contexts add.
FOUND_KINDS = (*KINDS, "secret")
BYTE_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A word that holds a digit or an at sign.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Groups of digits with marks between them, and addresses with the at sign spelled out.
GROUPS = r"(?<![^\x20\x09-\x0D(\[])[+(\[]?[0-9]{1,6}[)\]]?(?:[\x20./-]{1,2}[(]?[0-9]{1,6}[)]?){1,7}(?![0-9A-Za-z@])"
SPELLED = r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,64}){1,4}"
AT_SPELLED = r"[\[(]at[\])]"
SECRET = "^[0-9a-f]{32,}$"
EDGE = "\"'`.,;:!?()[]{}<>|*#$%&=_~"
LEFT_CHARS, RIGHT_CHARS = 80, 40
LEAST_SEEDS, LEAST_CONFIDENCE, ROUNDS, DAMPING = 4, 0.75, 3, 1.0
SPAN = "array<struct<s:int,e:int,m:string,l:string,r:string>>"
CHUNK = 128


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (s, e, m, l, r), l and r being what stands before and after.

    Ends follow from the lengths of gaps and matches in turn. Pieces are taken in chunks,
    so that a text with very many matches costs in proportion to them.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    empty = F.expr(f"cast(array() as {SPAN})")
    return F.coalesce(let(parts, lambda p: let(pieces(p["gaps"], p["found"]), lambda q: let(chunks(q), placed))), empty)


def pieces(gaps: Column, found: Column) -> Column:
    """(l, m, r) for each match: the gap before it, the match, and what stands after it."""
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("l"), m.alias("m")))
    # After a match come the gap and, where that is short, the next match and the gap after it.
    short = lambda x: F.coalesce(F.left(x, F.lit(RIGHT_CHARS)), F.lit(""))
    right = F.transform(F.slice(gaps, 2, 1 << 30), lambda g, i: F.left(F.concat(short(g), short(F.get(found, i + 1)), short(F.get(gaps, i + 2))), F.lit(RIGHT_CHARS)))
    triples = F.zip_with(pairs, right, lambda p, r: F.struct(p["l"].alias("l"), p["m"].alias("m"), r.alias("r")))
    return F.filter(triples, lambda p: p["m"].isNotNull())


def chunks(q: Column) -> Column:
    """The pieces in runs of CHUNK; null without pieces."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(q) - 1) / CHUNK).cast("int"))
    return F.when(F.size(q) > 0, F.transform(numbers, lambda i: F.slice(q, i * CHUNK + 1, CHUNK)))


def placed(runs: Column) -> Column:
    """Spans of all runs: bases of the runs by their lengths, then places inside each."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("bases"))
    length = lambda run: F.aggregate(run, F.lit(0), lambda n, p: n + F.length(p["l"]) + F.length(p["m"]))
    bases = F.aggregate(runs, start, lambda acc, c: F.struct((acc["at"] + length(c)).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases")), lambda acc: acc["bases"])

    def step(acc: Column, p: Column) -> Column:
        s = acc["at"] + F.length(p["l"])
        e = s + F.length(p["m"])
        before = F.right(F.concat(acc["tail"], p["l"]), F.lit(LEFT_CHARS))
        one = F.struct(s.alias("s"), e.alias("e"), p["m"].alias("m"), before.alias("l"), p["r"].alias("r"))
        return F.struct(e.alias("at"), F.right(F.concat(before, p["m"]), F.lit(LEFT_CHARS)).alias("tail"), F.concat(acc["out"], F.array(one)).alias("out"))

    def within(run: Column, at: Column) -> Column:
        first = F.struct(at["base"].alias("at"), at["tail"].alias("tail"), F.expr(f"cast(array() as {SPAN})").alias("out"))
        return F.aggregate(run, first, step, lambda acc: acc["out"])

    def last(i: Column) -> Column:
        """What stands before a run: the end of the run ahead of it."""
        ahead = F.try_element_at(F.get(runs, i - 1), F.lit(-1))
        return F.coalesce(F.right(F.concat(ahead["l"], ahead["m"]), F.lit(LEFT_CHARS)), F.lit(""))

    starts = F.transform(bases, lambda b, i: F.struct(b.alias("base"), last(i).alias("tail")))
    return F.flatten(F.zip_with(runs, starts, within))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits pass: from the right, every second digit is doubled and its digits summed."""
    d = F.reverse(digits(m))
    value = lambda i: F.substr(d, i, F.lit(1)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, value(i)).when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2),
    )
    return total % 10 == 0


def passes(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return m.rlike(rf"^{BYTE_PART}(?:\.{BYTE_PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), luhn(m)).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def spans(text: Column, kind: str) -> Column:
    """Base spans of a kind; the pattern runs only over texts that hold what it needs."""
    found = F.filter(matches(text, PATTERNS[kind]), lambda x: passes(kind, x["m"]))
    needed = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(NEEDED[kind])
    return F.when(needed, found).otherwise(F.expr(f"cast(array() as {SPAN})"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def each(spans: Column, make, kind: str | None) -> Column:
    """make(kind, span) of each span."""
    return F.transform(spans, lambda x: make(F.lit(kind).cast("string"), x))


def mention(kind: Column, x: Column) -> Column:
    """A span with its patterns: the two words before it, the word before and the word after."""
    # A word that the bound cuts is no word of the context.
    left = let(words(x["l"]), lambda w: F.when(F.length(x["l"]) >= LEFT_CHARS, F.slice(w, 2, LEFT_CHARS)).otherwise(w))
    right = let(words(x["r"]), lambda w: F.when(F.length(x["r"]) >= RIGHT_CHARS, F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))).otherwise(w))
    l1, l2, r1 = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2)), F.get(right, F.lit(0))
    return F.struct(
        kind.alias("kind"),
        x["s"].alias("s"),
        x["e"].alias("e"),
        F.lower(x["m"]).alias("value"),
        F.array_compact(F.array(F.concat(l2, F.lit(" "), l1, F.lit(" _")), F.concat(l1, F.lit(" _ "), r1))).alias("patterns"),
    )


def trimmed(x: Column) -> Column:
    """A candidate without punctuation at its edges, but for the bracket or sign that a group of digits begins with."""
    grouped = x["m"].rlike(r"^[(\[][0-9]+[)\]]")
    begun = F.when(grouped, x["m"]).otherwise(F.ltrim(x["m"], F.lit(EDGE)))
    core = F.rtrim(begun, F.lit(EDGE))
    s = x["s"] + F.length(x["m"]) - F.length(begun)
    return F.struct(s.cast("int").alias("s"), (s + F.length(core)).cast("int").alias("e"), core.alias("m"), x["l"].alias("l"), x["r"].alias("r"))


def candidates(text: Column) -> Column:
    """What may be an identifier: it has five digits, an at sign, or one spelled out."""
    empty = F.expr(f"cast(array() as {SPAN})")
    plain, spelled = f"{GROUPS}|{CANDIDATE}", f"{SPELLED}|{GROUPS}|{CANDIDATE}"
    near = F.when(text.rlike(AT_SPELLED), matches(text, spelled)).when(text.rlike("[0-9@]"), matches(text, plain)).otherwise(empty)
    return F.filter(F.transform(near, trimmed), lambda c: (F.length(digits(c["m"])) >= 5) | F.contains(c["m"], F.lit("@")) | c["m"].rlike(AT_SPELLED))


def base(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a row key, the base spans of each kind, and the mentions of seeds and candidates."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text"))
    rows = rows.select("*", *(spans(F.col("text"), k).alias(k) for k in KINDS))
    taken = F.concat(*KINDS)
    secret = lambda c: c["m"].rlike(SECRET)
    near = let(taken, lambda held: F.filter(candidates(F.col("text")), lambda c: secret(c) | ~F.exists(held, lambda t: (t["s"] < c["e"]) & (c["s"] < t["e"]))))
    seeds = [each(F.col(k), mention, k) for k in KINDS]
    rest = F.transform(near, lambda x: mention(F.when(secret(x), "secret"), x))
    flat = [F.transform(F.col(k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in KINDS]
    return rows.select("doc_id", "row", *flat, F.concat(*seeds, rest).alias("mentions"))


def scored(spark: SparkSession, mentions: DataFrame) -> DataFrame:
    """(pattern, kind): patterns of high confidence with enough support."""
    edges, edges_path = stored(spark, mentions.select(F.explode("patterns").alias("pattern"), "value", "kind").distinct(), "edges")
    different = edges.groupBy("pattern").agg(F.countDistinct("value").alias("instances"))
    seeds = edges.where("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    others = edges.where("kind is null").select("pattern", "value").distinct()
    scores, path = stored(spark, seeds, "scores")
    for _ in range(ROUNDS):
        held = edges.select("pattern", "value").distinct().join(scores, "value")
        support = F.count_if(F.col("score") >= LEAST_CONFIDENCE)
        sums = held.groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), support.alias("support")).where(F.col("support") >= LEAST_SEEDS)
        confident = sums.join(different, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("instances") + DAMPING)).alias("confidence"))
        known, known_path = stored(spark, confident, "confidence")
        any_right = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12)))))
        found = others.join(known, "pattern").groupBy("value", "kind").agg(any_right.alias("score"))
        new, new_path = stored(spark, seeds.union(found.join(seeds.select("value", "kind"), ["value", "kind"], "left_anti")), "scores")
        drop(spark, path)
        scores, path = new, new_path
    sure, _ = stored(spark, known.where(F.col("confidence") >= LEAST_CONFIDENCE).select("pattern", "kind"), "sure")
    drop(spark, path, edges_path, known_path)
    return sure


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with base spans by kind and context spans.

    Null and empty texts have no spans; repeated rows are each described; an empty table
    gives no rows. A span found for several kinds takes the first of them by name.
    """
    rows, _ = stored(spark, base(docs), "base")
    mentions = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    sure = scored(spark, mentions)
    open_ = mentions.where("kind is null or kind = 'secret'").select("row", "s", "e", F.col("kind").alias("own"), F.explode("patterns").alias("pattern"))
    new = open_.join(sure, "pattern").where("own is null or own = kind").groupBy("row", "s", "e").agg(F.min("kind").alias("kind"))
    new = new.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "s", "e"))).alias("context"))
    found = rows.drop("mentions").join(new, "row", "left")
    return found.withColumn("context", F.coalesce("context", F.expr("cast(array() as array<struct<kind:string,s:int,e:int>>)")))


def place(kind: Column, x: Column) -> Column:
    return F.concat_ws(":", kind, x["s"].cast("string"), x["e"].cast("string"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of personal data in every document. Edges as in `find`."""
    found = find(spark, table(spark, sf_dir, "documents"))
    listed = F.concat(*(each(F.col(k), place, k) for k in KINDS))
    more = [each(F.expr(f"filter(context, c -> c.kind = '{k}')"), place, f"ctx_{k}") for k in FOUND_KINDS]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(listed, ","), 256).alias("base_sha256"), F.array_join(F.concat(listed, *more), ",").alias("spans"), F.size("context").cast("long").alias("n_context")
    )
