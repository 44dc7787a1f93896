"""Corpus queries: segments to a labelled, filtered, split and sampled corpus, with its quality tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixtures import ctes, frame
from ..functions import sequence as S
from ..operators import intervals as I
from ..operators import sampling as P
from ..schema import BIN, CAP, CHROMOSOMES, MINORITY, SEED, TEST, VALIDATION

QUERIES: dict = {}
SQL: dict[str, str] = {}
NAMES = ",".join(f"'{c}'" for c in CHROMOSOMES)
SPLIT = "case when chrom in ('chr18','chr19') then 'val' when chrom in ('chr20','chr21','chr22') then 'test' else 'train' end"


def query(name: str, body: str, views=("states", "segments"), steps=()):
    """Register a query with its SQL: views, then the named steps of the pipeline, then the body."""

    def add(fn):
        QUERIES[name] = fn
        SQL[name] = ctes(views, {s: STEPS[s] for s in steps}) + body
        return fn

    return add


#: The pipeline's steps in DuckDB's dialect.
STEPS = {
    "norm": f"""select eid, c as chrom, start_pos, end_pos, state_name, seg_key, state_int, family, family_id, subcluster,
  case when state_int is null then 'invalid_state' when c not in ({NAMES}) then 'non_canonical'
       when end_pos-start_pos<=0 or (end_pos-start_pos)%200<>0 then 'bad_length' end as drop_reason
from (select s.*, case when s.chrom like 'chr%' then s.chrom else 'chr'||s.chrom end as c, t.state_int, t.family, t.family_id, t.subcluster
      from segments s left join states t on s.state_name=t.state_name)""",
    "bins": """select eid, chrom, state_name, seg_key, state_int, family, family_id, subcluster, s as "start", s+200 as "end"
from (select *, cast(unnest(range(start_pos, end_pos, 200)) as int) as s from norm where drop_reason is null)""",
    "lift": """select p.chrom, p."start", p."end", case when covered is null then 'deleted' when covered<190 then 'partial' when nt>1 or covered>200 then 'split' else 'lifted' end as status,
  q_chrom, q_start, q_end from (select distinct chrom, "start", "end" from bins) p left join (
  select chrom, "start", "end", sum(w) as covered, count(distinct q_chrom||strand) as nt, min(q_chrom) as q_chrom, min(q) as q_start, max(q+w) as q_end from (
    select p.chrom, p."start", p."end", b.q_chrom, b.strand, least("end",t_end)-greatest("start",t_start) as w,
      q_start+case when strand='+' then greatest("start",t_start)-t_start else t_end-least("end",t_end) end as q
    from (select distinct chrom, "start", "end" from bins) p join chain_blocks b on p.chrom=b.chrom and p."start"<b.t_end and p."end">b.t_start)
  group by all) m on p.chrom=m.chrom and p."start"=m."start" and p."end"=m."end\"""",
    "onlift": """select b.eid, coalesce(l.q_chrom,b.chrom) as chrom, l.q_start as "start", l.q_end as "end", b.state_name, b.seg_key, b.state_int, b.family, b.subcluster, b."start" as source_start,
  case when l.status<>'lifted' then 'lift_'||l.status when z.size is null then 'non_canonical' when l.q_end-l.q_start<>200 then 'not_200' when l.q_end>z.size then 'out_of_bounds' end as reason
from bins b join lift l on b.chrom=l.chrom and b."start"=l."start" and b."end"=l."end" left join chrom_sizes z on z.chrom=l.q_chrom""",
    "kept": """select * exclude (o, n, island) from (
  select *, count(*) over (partition by eid, chrom, island) as size, row_number() over (partition by eid, chrom, island order by "start" desc, "end" desc, state_int desc, seg_key desc, source_start desc) as back from (
    select *, sum(case when o then 0 else 1 end) over (partition by eid, chrom order by n) as island from (
      select *, coalesce("start" < lag("end") over w, false) as o, row_number() over w as n from onlift where reason is null
      window w as (partition by eid, chrom order by "start", "end", state_int, seg_key, source_start)))) where size%2=1 and back=1""",
    "fetched": """select k.eid, k.chrom, k."start", k."end", k.state_name, k.seg_key, k.state_int, k.family, k.subcluster, k.source_start, substr(r.seq, cast(k."start"%1000+1 as bigint), 200) as seq
from kept k left join ref_chunks r on r.chrom=k.chrom and r.chunk=k."start"//1000""",
    "corpus": f"""select *, {SPLIT} as split, seg_key||'-'||source_start as bin_key, length(regexp_replace(seq,'[^GC]','','g'))/200.0 as gc from (
  select *, case when seq is null or length(seq)<>200 then 'bad_sequence_length' when seq like '%N%' then 'contains_n' when regexp_matches(seq,'[^ACGT]') then 'non_acgt'
  when -list_sum(list_transform(['A','C','G','T'], lambda b: case when contains(seq,b) then length(regexp_replace(seq,'[^'||b||']','','g'))/200.0*log2(length(regexp_replace(seq,'[^'||b||']','','g'))/200.0) else 0 end))<=0.5 then 'low_complexity' end as seq_reason
  from fetched)""",
    "clean": "select * from corpus where seq_reason is null",
    "sampled": f"""select * from (select *, row_number() over (partition by split, eid, state_int order by md5('{SEED}|'||bin_key), bin_key) as rk from clean) where split<>'train' or rk<=greatest(1,{CAP}//(select count(distinct eid) from segments))""",
}
ALL_VIEWS = ("states", "segments", "chain_blocks", "chrom_sizes", "ref_chunks")
TO_KEPT = ("norm", "bins", "lift", "onlift", "kept")
TO_CLEAN = (*TO_KEPT, "fetched", "corpus", "clean")


def norm(spark: SparkSession, sf: str) -> DataFrame:
    return I.normalised(frame(spark, sf, "segments"), frame(spark, sf, "states"))


def bins(spark: SparkSession, sf: str) -> DataFrame:
    return I.bins(norm(spark, sf).where("drop_reason is null"))


def on_lift(spark: SparkSession, sf: str) -> DataFrame:
    """Bins at their lifted places, with the first check they fail: distinct places are lifted once and joined back."""
    b = bins(spark, sf)
    lift = I.lifted(b.select("chrom", "start", "end").distinct(), frame(spark, sf, "chain_blocks"))
    sizes = F.broadcast(frame(spark, sf, "chrom_sizes").withColumnRenamed("chrom", "q_chrom"))
    out = b.join(lift, ["chrom", "start", "end"]).join(sizes, "q_chrom", "left").withColumn("source_start", F.col("start"))
    reason = (
        F.when(F.col("status") != "lifted", F.concat(F.lit("lift_"), "status"))
        .when(F.col("size").isNull(), "non_canonical")
        .when(F.col("q_end") - F.col("q_start") != BIN, "not_200")
        .when(F.col("q_end") > F.col("size"), "out_of_bounds")
    )
    out = out.withColumn("reason", reason).withColumn("chrom", F.coalesce("q_chrom", "chrom")).drop("start", "end", "q_chrom", "status", "size")
    return out.withColumnRenamed("q_start", "start").withColumnRenamed("q_end", "end")


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return I.without_overlaps(on_lift(spark, sf).where("reason is null").drop("reason"), ties=("state_int", "seg_key", "source_start"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Every fetched bin with its letters, split, features and the first sequence check it fails."""
    out = I.with_reference(kept(spark, sf), frame(spark, sf, "ref_chunks"))
    s = F.col("seq")
    out = out.withColumn("seq_reason", I.sequence_reason(s)).withColumn("split", P.split_of(F.col("chrom")))
    return out.withColumn("bin_key", F.concat_ws("-", "seg_key", F.col("source_start").cast("string"))).withColumn("gc", S.gc_fraction(s))


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).where("seq_reason is null")


def sampled(spark: SparkSession, sf: str, cap: int = CAP) -> DataFrame:
    """The cap is shared by the sources of the segments, whose number is read from their one column."""
    return P.capped(clean(spark, sf), cap, frame(spark, sf, "segments").select("eid").distinct().count(), "bin_key")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    splits = spark.createDataFrame([("train",), ("val",), ("test",)], "split string")
    return splits.crossJoin(F.broadcast(frame(spark, sf, "states").select("state_int", "state_name")))


@query("rows_by_split_state", f"select {SPLIT} as split, state_name, count(*) as n from bins group by all", steps=("norm", "bins"))
def rows_by_split_state(spark, sf):
    return bins(spark, sf).groupBy(P.split_of(F.col("chrom")).alias("split"), "state_name").agg(F.count("*").alias("n"))


@query(
    "normalisation_metrics",
    """select eid, count(*) as segments, count(*) filter (drop_reason='invalid_state') as invalid_state, count(*) filter (drop_reason='non_canonical') as non_canonical,
  count(*) filter (drop_reason='bad_length') as bad_length, count(*) filter (drop_reason is null) as kept,
  cast(coalesce(sum((end_pos-start_pos)//200) filter (drop_reason is null),0) as bigint) as bins,
  coalesce(array_to_string(list_sort(list(distinct chrom) filter (drop_reason is null)),','),'') as chromosomes from norm group by eid""",
    steps=("norm",),
)
def normalisation_metrics(spark, sf):
    ok = F.col("drop_reason").isNull()
    counts = [F.count_if(F.col("drop_reason") == r).alias(r) for r in ("invalid_state", "non_canonical", "bad_length")]
    size = ((F.col("end_pos") - F.col("start_pos")) / BIN).cast("long")
    chroms = F.array_join(F.sort_array(F.collect_set(F.when(ok, F.col("chrom")))), ",")
    return norm(spark, sf).groupBy("eid").agg(F.count("*").alias("segments"), *counts, F.count_if(ok).alias("kept"), F.coalesce(F.sum(F.when(ok, size)), F.lit(0)).alias("bins"), chroms.alias("chromosomes"))


@query("lift_places", 'select chrom, "start", status, q_chrom, q_start, q_end from lift', ("states", "segments", "chain_blocks"), ("norm", "bins", "lift"))
def lift_places(spark, sf):
    b = bins(spark, sf).select("chrom", "start", "end").distinct()
    return I.lifted(b, frame(spark, sf, "chain_blocks")).select("chrom", "start", "status", "q_chrom", "q_start", "q_end")


@query("lift_reasons", "select eid, coalesce(reason,'kept') as reason, count(*) as n from onlift group by all", ALL_VIEWS, ("norm", "bins", "lift", "onlift"))
def lift_reasons(spark, sf):
    return on_lift(spark, sf).groupBy("eid", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("overlap_removal", 'select eid, chrom, "start", state_int, seg_key from kept', ALL_VIEWS, TO_KEPT)
def overlap_removal(spark, sf):
    return kept(spark, sf).select("eid", "chrom", "start", "state_int", "seg_key")


@query("order_violations", """select eid, count(*) filter (v) as sort_order_violations from (
  select eid, coalesce((chrom, start_pos) < lag((chrom, start_pos)) over (partition by eid order by seg_key), false) as v from norm where drop_reason is null) group by eid""", steps=("norm",))
def order_violations(spark, sf):
    return I.order_violations(norm(spark, sf).where("drop_reason is null"), "seg_key")


@query("corpus_rows", 'select bin_key, eid, chrom, "start", state_int, family, subcluster, split, seq, round(gc,6) as gc from clean', ALL_VIEWS, TO_CLEAN)
def corpus_rows(spark, sf):
    return clean(spark, sf).select("bin_key", "eid", "chrom", "start", "state_int", "family", "subcluster", "split", "seq", F.round("gc", 6).alias("gc"))


@query("extraction_metrics", "select eid, state_int, split, coalesce(seq_reason,'kept') as reason, count(*) as n, round(sum(case when seq_reason is null then cast(round(gc*200) as bigint) end)/(count(*) filter (seq_reason is null))/200.0,12) as mean_gc from corpus group by all", ALL_VIEWS, TO_CLEAN[:-1])
def extraction_metrics(spark, sf):
    fine = F.when(F.col("seq_reason").isNull(), F.round(F.col("gc") * BIN).cast("long"))
    gc = F.round(F.try_divide(F.sum(fine), F.count(fine)) / BIN, 12).alias("mean_gc")
    return corpus(spark, sf).groupBy("eid", "state_int", "split", F.coalesce("seq_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), gc)


QC_SQL = """select e.eid, e.name, e.grp, coalesce(b.n,0) as bins, coalesce(c.kept,0) as kept, round(coalesce(c.quies,0)/greatest(1,coalesce(c.kept,0)),6) as quiescent_fraction,
  round(coalesce(c.tss,0)/greatest(1,coalesce(c.kept,0)),6) as tss_fraction, round((coalesce(b.n,0)-coalesce(c.kept,0))/greatest(1,coalesce(b.n,0)),6) as drop_fraction
from epigenomes e left join (select eid, count(*) as n from bins group by eid) b on e.eid=b.eid
left join (select eid, count(*) as kept, count(*) filter (state_int=18) as quies, count(*) filter (state_int=1) as tss from clean group by eid) c on e.eid=c.eid"""


@query("qc_summary", QC_SQL, (*ALL_VIEWS, "epigenomes"), TO_CLEAN)
def qc_summary(spark, sf):
    b = bins(spark, sf).groupBy("eid").agg(F.count("*").alias("n"))
    c = clean(spark, sf).groupBy("eid").agg(F.count("*").alias("kept"), F.count_if(F.col("state_int") == 18).alias("quies"), F.count_if(F.col("state_int") == 1).alias("tss"))
    out = F.broadcast(frame(spark, sf, "epigenomes").select("eid", "name", "grp")).join(b, "eid", "left").join(c, "eid", "left").fillna(0, ["n", "kept", "quies", "tss"])
    part = lambda a, n: F.round(a / F.greatest(F.lit(1), n), 6)
    return out.select(
        "eid", "name", "grp", F.col("n").alias("bins"), "kept", part(F.col("quies"), F.col("kept")).alias("quiescent_fraction"), part(F.col("tss"), F.col("kept")).alias("tss_fraction"), part(F.col("n") - F.col("kept"), F.col("n")).alias("drop_fraction")
    )


@query("qc_flags", f"""select eid, cast(bins>0 as boolean) as has_bins, quiescent_fraction between 0.3 and 0.9 as quiescent_in_range, tss_fraction between 0.005 and 0.05 as tss_in_range, drop_fraction<=0.15 as drop_in_range
from ({QC_SQL})""", (*ALL_VIEWS, "epigenomes"), TO_CLEAN)
def qc_flags(spark, sf):
    q = qc_summary(spark, sf)
    return q.select("eid", (F.col("bins") > 0).alias("has_bins"), F.col("quiescent_fraction").between(0.3, 0.9).alias("quiescent_in_range"), F.col("tss_fraction").between(0.005, 0.05).alias("tss_in_range"), (F.col("drop_fraction") <= 0.15).alias("drop_in_range"))


@query("capped_sample", "select bin_key, split, eid, state_int from sampled", ALL_VIEWS, (*TO_CLEAN, "sampled"))
def capped_sample(spark, sf):
    return sampled(spark, sf).select("bin_key", "split", "eid", "state_int")


@query("merged_counts", """select g.split, g.state_name, count(s.bin_key) as n from (select split, state_int, state_name from states, (values ('train'),('val'),('test')) as t(split)) g
left join sampled s on s.split=g.split and s.state_int=g.state_int group by all""", ALL_VIEWS, (*TO_CLEAN, "sampled"))
def merged_counts(spark, sf):
    s = sampled(spark, sf).groupBy("split", "state_int").agg(F.count("*").alias("n"))
    return grid(spark, sf).join(s, ["split", "state_int"], "left").select("split", "state_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("missing_states", """select split, string_agg(state_name, ',' order by state_int) as missing from (select g.split, g.state_int, g.state_name, count(s.bin_key) as n
from (select split, state_int, state_name from states, (values ('train'),('val'),('test')) as t(split)) g left join sampled s on s.split=g.split and s.state_int=g.state_int group by all) where n=0 group by split""", ALL_VIEWS, (*TO_CLEAN, "sampled"))
def missing_states(spark, sf):
    s = sampled(spark, sf).select("split", "state_int").distinct()
    gone = grid(spark, sf).join(s, ["split", "state_int"], "left_anti")
    return gone.groupBy("split").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("state_int", "state_name"))), lambda x: x["state_name"]), ",").alias("missing"))


@query("strand_duplicates", f"""select bin_key, strand, s as seq from (select bin_key, unnest(case when m then ['+','-'] else ['+'] end) as strand,
  unnest(case when m then [seq, reverse(translate(seq,'ACGT','TGCA'))] else [seq] end) as s from (select *, split='train' and state_int in {MINORITY} as m from sampled))""", ALL_VIEWS, (*TO_CLEAN, "sampled"))
def strand_duplicates(spark, sf):
    s = F.col("seq")
    plus, minus = F.struct(F.lit("+").alias("strand"), s.alias("seq")), F.struct(F.lit("-").alias("strand"), S.reverse_complement(s).alias("seq"))
    both = (F.col("split") == "train") & F.col("state_int").isin(*MINORITY)
    return sampled(spark, sf).select("bin_key", F.explode(F.when(both, F.array(plus, minus)).otherwise(F.array(plus))).alias("x")).select("bin_key", "x.*")


@query("format_check", "select split, bool_and(length(seq)=200) as length_ok, bool_and(not regexp_matches(seq,'[^ACGT]')) as letters_ok, bool_and(state_int between 1 and 18) as label_ok from sampled group by split", ALL_VIEWS, (*TO_CLEAN, "sampled"))
def format_check(spark, sf):
    s = F.col("seq")
    return sampled(spark, sf).groupBy("split").agg(F.bool_and(F.length(s) == BIN).alias("length_ok"), F.bool_and(~s.rlike("[^ACGT]")).alias("letters_ok"), F.bool_and(F.col("state_int").between(1, 18)).alias("label_ok"))


@query("strand_spot_check", """select k.bin_key, reverse(translate(reverse(translate(k.seq,'ACGT','TGCA')),'ACGT','TGCA'))=k.seq as twice_same, substr(r.seq, cast(k."start"%1000+1 as bigint), 200)=k.seq as same_as_reference
from (select * from clean order by md5('7|'||bin_key), bin_key limit 1000) k join ref_chunks r on r.chrom=k.chrom and r.chunk=k."start"//1000""", ALL_VIEWS, TO_CLEAN)
def strand_spot_check(spark, sf):
    rows = P.overall(clean(spark, sf), "bin_key", 1000, 7).select("bin_key", "chrom", "start", F.col("seq").alias("held"))
    again = I.with_reference(rows, frame(spark, sf, "ref_chunks"))
    twice = S.reverse_complement(S.reverse_complement(F.col("held"))) == F.col("held")
    return again.select("bin_key", twice.alias("twice_same"), (F.col("seq") == F.col("held")).alias("same_as_reference"))


PRIORITY = "case when family in ('promoter','enhancer','transcribed') then 0 when family in ('polycomb','heterochromatin') then 1 else 2 end"


@query("locus_plurality", f"""select chrom, "start", state_int, n from (select *, row_number() over (partition by chrom, "start" order by n desc, p, state_int) as rk from (
  select chrom, "start", state_int, min({PRIORITY}) as p, count(*) as n from bins group by chrom, "start", state_int)) where rk=1""", steps=("norm", "bins"))
def locus_plurality(spark, sf):
    counts = bins(spark, sf).groupBy("chrom", "start", "state_int").agg(F.min(F.expr(PRIORITY)).alias("p"), F.count("*").alias("n"))
    return counts.groupBy("chrom", "start").agg(F.min_by(F.struct("state_int", "n"), F.struct(-F.col("n"), "p", "state_int")).alias("x")).select("chrom", "start", "x.*")


@query("locus_agreement", 'select chrom, "start", min(state_int) as state_int, count(distinct eid) as sources from bins group by chrom, "start" having count(distinct state_int)=1 and count(distinct eid)>1', steps=("norm", "bins"))
def locus_agreement(spark, sf):
    return bins(spark, sf).groupBy("chrom", "start").agg(F.min("state_int").alias("state_int"), F.max("state_int").alias("hi"), F.countDistinct("eid").alias("sources")).where("state_int = hi and sources > 1").drop("hi")


@query("class_weights", "select state_int, count(*) as n, round(sum(count(*)) over ()/(18*count(*)),6) as weight from bins group by state_int", steps=("norm", "bins"))
def class_weights(spark, sf):
    counts = bins(spark, sf).groupBy("state_int").agg(F.count("*").alias("n"))
    return counts.withColumn("weight", F.round(F.sum("n").over(W.partitionBy()) / (18 * F.col("n")), 6))


@query("capped_with_fill", f"""select bin_key from (select *, row_number() over (partition by state_int order by case when rk>{CAP}//20 then 1 else 0 end, case when rk>{CAP}//20 then n end desc nulls last, eid, rk) as fill from (
  select *, row_number() over (partition by eid, state_int order by md5('{SEED}|'||bin_key), bin_key) as rk, count(*) over (partition by eid, state_int) as n from (select *, seg_key||'-'||"start" as bin_key from bins))) where fill<={CAP}""", steps=("norm", "bins"))
def capped_with_fill(spark, sf):
    rows = bins(spark, sf).withColumn("bin_key", F.concat_ws("-", "seg_key", F.col("start").cast("string")))
    return P.capped_with_fill(rows, CAP, 20, "bin_key").select("bin_key")


@query("group_consistency", """select a.grp, a.state_int, a.eid as eid_a, b.eid as eid_b, round(abs(a.g-b.g),6) as gap from (
  select e.grp, c.eid, c.state_int, avg(gc) as g from clean c join epigenomes e on e.eid=c.eid group by all) a join (
  select e.grp, c.eid, c.state_int, avg(gc) as g from clean c join epigenomes e on e.eid=c.eid group by all) b
on a.grp=b.grp and a.state_int=b.state_int and a.eid<b.eid where abs(a.g-b.g)>0.05""", (*ALL_VIEWS, "epigenomes"), TO_CLEAN)
def group_consistency(spark, sf):
    g = clean(spark, sf).groupBy("eid", "state_int").agg(F.avg("gc").alias("g")).join(F.broadcast(frame(spark, sf, "epigenomes").select("eid", "grp")), "eid")
    a, b = g.alias("a"), g.alias("b")
    met = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.state_int") == F.col("b.state_int")) & (F.col("a.eid") < F.col("b.eid")))
    gap = F.abs(F.col("a.g") - F.col("b.g"))
    return met.where(gap > 0.05).select("a.grp", "a.state_int", F.col("a.eid").alias("eid_a"), F.col("b.eid").alias("eid_b"), F.round(gap, 6).alias("gap"))


@query("stratified_folds", f"select seq_key, (row_number() over (partition by label order by md5('{SEED}|'||seq_key), seq_key)-1)%5+1 as fold from sequences", ("sequences",))
def stratified_folds(spark, sf):
    return P.folds(frame(spark, sf, "sequences"), "label", "seq_key").select("seq_key", F.col("fold").cast("long").alias("fold"))


@query("sample_per_label", f"select seq_key, label from (select *, row_number() over (partition by label order by md5('{SEED}|'||seq_key), seq_key) as rk from sequences) where rk<=100", ("sequences",))
def sample_per_label(spark, sf):
    return P.per_group(frame(spark, sf, "sequences").where("label between 1 and 18"), ["label"], "seq_key", 100).select("seq_key", "label")


@query("sample_overall", f"select seq_key from sequences order by md5('{SEED}|'||seq_key), seq_key limit 500", ("sequences",))
def sample_overall(spark, sf):
    return P.overall(frame(spark, sf, "sequences"), "seq_key", 500).select("seq_key")


@query("first_per_label", "select seq_key, label from (select *, row_number() over (partition by label order by seq_key) as rk from sequences) where rk<=20", ("sequences",))
def first_per_label(spark, sf):
    return P.first_in_order(frame(spark, sf, "sequences"), ["label"], "seq_key", 20).select("seq_key", "label")


@query("picked_rows", f"select s.seq_key, s.label, s.eid from sequences s where seq_key in (select seq_key from (select *, row_number() over (partition by label order by md5('{SEED}|'||seq_key), seq_key) as rk from sequences) where rk<=50)", ("sequences",))
def picked_rows(spark, sf):
    rows = frame(spark, sf, "sequences")
    return rows.join(P.per_group(rows, ["label"], "seq_key", 50).select("seq_key"), "seq_key", "left_semi").select("seq_key", "label", "eid")


@query("holdout_split", f"select seq_key, cast('0x'||substr(md5('{SEED}|'||seq_key),1,8) as bigint) < 858993459 as held_out from sequences", ("sequences",))
def holdout_split(spark, sf):
    return frame(spark, sf, "sequences").select("seq_key", P.holdout("seq_key").alias("held_out"))


@query("total_order", 'select eid, chrom, "start", seg_key, row_number() over (partition by eid, chrom order by "start", seg_key) as place from bins', steps=("norm", "bins"))
def total_order(spark, sf):
    return bins(spark, sf).select("eid", "chrom", "start", "seg_key", F.row_number().over(W.partitionBy("eid", "chrom").orderBy("start", "seg_key")).alias("place"))


@query("by_source", "select seq_key, eid from sequences where eid in ('E001','E003','E007')", ("sequences",))
def by_source(spark, sf):
    return frame(spark, sf, "sequences").where(F.col("eid").isin("E001", "E003", "E007")).select("seq_key", "eid")


@query("sources_without_metadata", "select distinct eid from segments where eid not in (select eid from epigenomes)", ("states", "segments", "epigenomes"))
def sources_without_metadata(spark, sf):
    return frame(spark, sf, "segments").select("eid").distinct().join(frame(spark, sf, "epigenomes").select("eid"), "eid", "left_anti")


@query("hierarchy_labels", "select s.seq_key, t.family_id, t.subcluster-1 as subcluster_id, s.label-1 as class_id from sequences s join states t on s.label=t.state_int", ("states", "sequences"))
def hierarchy_labels(spark, sf):
    states = F.broadcast(frame(spark, sf, "states").select(F.col("state_int").alias("label"), "family_id", "subcluster"))
    return frame(spark, sf, "sequences").join(states, "label").select("seq_key", "family_id", (F.col("subcluster") - 1).alias("subcluster_id"), (F.col("label") - 1).alias("class_id"))


@query("hierarchy_audit", "select count(*) as rows_that_differ from clean c join states t on c.state_int=t.state_int where c.family<>t.family or c.subcluster<>t.subcluster", ALL_VIEWS, TO_CLEAN)
def hierarchy_audit(spark, sf):
    held = clean(spark, sf).select("bin_key", "state_int", "family", "subcluster")
    told = held.select("bin_key", "state_int").join(F.broadcast(frame(spark, sf, "states")), "state_int").select("bin_key", "state_int", "family", "subcluster")
    return held.exceptAll(told).union(told.exceptAll(held)).agg(F.count("*").alias("rows_that_differ"))


@query("family_members", "select family, string_agg(distinct cast(state_int-1 as varchar), ',' order by cast(state_int-1 as varchar)) as classes, string_agg(distinct cast(subcluster as varchar), ',' order by cast(subcluster as varchar)) as subclusters, count(*) as n from bins group by family", steps=("norm", "bins"))
def family_members(spark, sf):
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c.cast("string"))), ",")
    return bins(spark, sf).groupBy("family").agg(listed(F.col("state_int") - 1).alias("classes"), listed(F.col("subcluster")).alias("subclusters"), F.count("*").alias("n"))


@query("label_distribution", "select label, count(*) as n, min(seq_key) as first_key, max(seq_key) as last_key, (select count(distinct label) from sequences) as labels from sequences group by label", ("sequences",))
def label_distribution(spark, sf):
    rows = frame(spark, sf, "sequences")
    each = rows.groupBy("label").agg(F.count("*").alias("n"), F.min("seq_key").alias("first_key"), F.max("seq_key").alias("last_key"))
    return each.withColumn("labels", F.count("*").over(W.partitionBy()))


@query("distinct_chromosomes", "select chrom, count(distinct eid) as sources from bins group by chrom", steps=("norm", "bins"))
def distinct_chromosomes(spark, sf):
    return bins(spark, sf).groupBy("chrom").agg(F.countDistinct("eid").alias("sources"))
