"""Queries that describe labels and match them to states."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixtures import ctes, frame
from ..functions import sequence as S
from ..operators import matching as M
from ..operators.ranges import stored
from ..schema import PAIRS, PROTOTYPES, SAFE
from .features import CG, KNOWN, entropy_sql, matched_sql, n

QUERIES: dict = {}
SQL: dict[str, str] = {}
PAIR_SQL = f"least(({'+'.join(matched_sql(p) for p in [*(b + '{4,}' for b in 'ACGT'), *(f'(?:{p}){{4,}}' for p in PAIRS)])})/length(seq),1)"
RUN_SQL = "list_max(list_transform(regexp_extract_all(seq,'A+|C+|G+|T+'), lambda x: length(x)))"
STEPS = {
    "feats": f"""select seq_key, label, eid, seq, {n('GC')}/length(seq) as gc_content, 1-{n('GC')}/length(seq) as at_content, case when {n('C')}*{n('G')}=0 then 0 else {CG}/({n('C')}*{n('G')}/length(seq)) end as cpg_ratio,
  {CG}/(length(seq)-1) as cpg_freq, {PAIR_SQL} as repeat_density, {entropy_sql(KNOWN)} as entropy from sequences""",
    "prof": " union all ".join(f"select label, '{f}' as feature, avg({f}) as value from feats group by label" for f in SAFE),
    "scale": "select feature, avg(value) as mu, stddev_pop(value)+1e-8 as sd from prof group by feature",
    "sims": "select p.label, q.state, 0-sqrt(sum(((p.value-mu)/sd-(q.value-mu)/sd)*((p.value-mu)/sd-(q.value-mu)/sd))) as sim from prof p join scale using(feature) join prototypes q on q.feature=p.feature group by p.label, q.state",
    "best": "select label, state, sim, row_number() over (partition by label order by round(sim,9) desc, state) as place, sim-lead(sim) over (partition by label order by round(sim,9) desc, state) as margin from sims",
    "wide": "select label, " + ", ".join(f"max(value) filter (feature='{f}') as {f}" for f in SAFE) + " from prof group by label",
}
ALL = tuple(STEPS)


def query(name: str, body: str | None, steps=ALL, views=("sequences", "prototypes", "states")):
    def add(fn):
        QUERIES[name] = fn
        if body is not None:
            SQL[name] = ctes(views, {s: STEPS[s] for s in steps}) + body
        return fn

    return add


def feats(spark, sf):
    cols = S.stable_features(F.col("seq"))
    return frame(spark, sf, "sequences").select("seq_key", "label", "eid", "seq", *(c.alias(f) for c, f in zip(cols, SAFE)))


def profiles(spark, sf, *by):
    """(by, feature, value): one aggregation of all features, stored as it is read several times, then long form over its few rows."""
    means = stored(feats(spark, sf).groupBy(*by, "label").agg(*(F.avg(f).alias(f) for f in SAFE)), "profiles")
    return means.unpivot([*by, "label"], list(SAFE), "feature", "value")


def states(spark, sf):
    return frame(spark, sf, "prototypes")


def sims(spark, sf, found=None):
    return M.similarity(profiles(spark, sf) if found is None else found, states(spark, sf))


@query("label_profiles", "select label, feature, round(value,9) as value from prof", ("feats", "prof"))
def label_profiles(spark, sf):
    return profiles(spark, sf).withColumn("value", F.round("value", 9))


@query("state_similarity", "select label, state, round(sim,6) as sim from sims", ("feats", "prof", "scale", "sims"))
def state_similarity(spark, sf):
    return sims(spark, sf).withColumn("sim", F.round("sim", 6))


@query("state_similarity_own_scale", """select p.label, q.state, round(0-sqrt(sum(((p.value-s.mu)/s.sd-(q.value-t.mu)/t.sd)*((p.value-s.mu)/s.sd-(q.value-t.mu)/t.sd))),6) as sim from prof p join scale s using(feature) join prototypes q on q.feature=p.feature
join (select feature, avg(value) as mu, stddev_pop(value)+1e-8 as sd from prototypes group by feature) t on t.feature=p.feature group by p.label, q.state""", ("feats", "prof", "scale"))
def state_similarity_own_scale(spark, sf):
    return M.similarity(profiles(spark, sf), states(spark, sf), own_scale=True).withColumn("sim", F.round("sim", 6))


@query("best_states", "select label, place, state, round(sim,6) as sim, round(margin,6) as margin, margin<0.5 as low_margin from best where place<=3")
def best_states(spark, sf):
    return M.best_states(sims(spark, sf)).select("label", "place", "state", F.round("sim", 6).alias("sim"), F.round("margin", 6).alias("margin"), (F.col("margin") < 0.5).alias("low_margin"))


GAP = lambda s: "round(sqrt(" + "+".join(f"({f}-{PROTOTYPES[s][i]})*({f}-{PROTOTYPES[s][i]})" for i, f in enumerate(SAFE)) + "),9)"
A1 = "select label from wide order by round(cpg_ratio,9) desc, round(cpg_freq,9) desc, round(gc_content,9) desc, label limit 1"
A2 = f"select label from (select * from wide where label not in ({A1}) order by round(gc_content,9), label limit 4) order by round(repeat_density-0.1*entropy,9) desc, round(gc_content,9), label limit 1"
A3 = f"select label from wide where label not in ({A1}) and label not in ({A2}) order by {GAP('Quies')}, label limit 1"
A4 = f"select label from wide where label not in ({A1}) and label not in ({A2}) and label not in ({A3}) order by {GAP('ZnfRpts')}, label limit 1"


@query("anchors", " union all ".join(f"select '{s}' as state, label from ({q})" for s, q in (("TssA", A1), ("Het", A2), ("Quies", A3), ("ZnfRpts", A4))), ("feats", "prof", "wide"))
def anchors(spark, sf):
    return M.anchors(profiles(spark, sf), states(spark, sf), SAFE)


@query("assignments", None)
def assignments(spark, sf):
    """One-to-one assignment in each source, anchors fixed over all; 18 labels a group by construction."""
    fixed = {r["state"]: r["label"] for r in anchors(spark, sf).collect()}
    matrix = pd.DataFrame.from_dict(PROTOTYPES, orient="index", columns=list(SAFE))
    return M.assignments(profiles(spark, sf, "eid"), matrix, fixed, SAFE)


@query("threshold_states", """select * from (select max_by(label,(cpg_ratio,-label)) as label, 'TssA' as hint from wide where cpg_ratio>0.5 and gc_content>0.55 union all select min_by(label,(gc_content,label)), 'Het' from wide where gc_content<0.4
union all select max_by(label,(repeat_density,-label)), 'high_repeats' from wide union all select min_by(label,((gc_content-0.41)*(gc_content-0.41)+(cpg_ratio-0.25)*(cpg_ratio-0.25),label)), 'Quies' from wide where gc_content between 0.38 and 0.44 and cpg_ratio<0.35) where label is not null""", ("feats", "prof", "wide"))
def threshold_states(spark, sf):
    w = M.wide(profiles(spark, sf), SAFE)
    gc, cpg = F.col("gc_content"), F.col("cpg_ratio")
    off = (gc - 0.41) * (gc - 0.41) + (cpg - 0.25) * (cpg - 0.25)
    rules = (
        (F.max_by(F.when((cpg > 0.5) & (gc > 0.55), F.col("label")), F.when((cpg > 0.5) & (gc > 0.55), F.struct(cpg, -F.col("label")))), "TssA"),
        (F.min_by(F.when(gc < 0.4, F.col("label")), F.when(gc < 0.4, F.struct(gc, F.col("label")))), "Het"),
        (F.max_by("label", F.struct("repeat_density", -F.col("label"))), "high_repeats"),
        (F.min_by(F.when(gc.between(0.38, 0.44) & (cpg < 0.35), F.col("label")), F.when(gc.between(0.38, 0.44) & (cpg < 0.35), F.struct(off, F.col("label")))), "Quies"),
    )
    picked = w.agg(F.array(*(F.struct(e.alias("label"), F.lit(h).alias("hint")) for e, h in rules)).alias("x"))
    return picked.select(F.explode("x").alias("x")).select("x.*").where("label is not null")


@query("extremes", "select 'highest_cpg' as extreme, label, state from best where place=1 and label=(select max_by(label,(round(cpg_ratio,9),-label)) from wide) union all select 'lowest_gc', label, state from best where place=1 and label=(select min_by(label,(round(gc_content,9),label)) from wide) union all select 'highest_repeats', label, state from best where place=1 and label=(select max_by(label,(round(repeat_density,9),-label)) from wide)")
def extremes(spark, sf):
    found = profiles(spark, sf)
    w = M.wide(found, SAFE)
    r = lambda c: F.round(c, 9)
    ends = w.agg(
        F.array(
            F.struct(F.lit("highest_cpg").alias("extreme"), F.max_by("label", F.struct(r("cpg_ratio"), -F.col("label"))).alias("label")),
            F.struct(F.lit("lowest_gc").alias("extreme"), F.min_by("label", F.struct(r("gc_content"), F.col("label"))).alias("label")),
            F.struct(F.lit("highest_repeats").alias("extreme"), F.max_by("label", F.struct(r("repeat_density"), -F.col("label"))).alias("label")),
        ).alias("x")
    )
    return ends.select(F.explode("x").alias("x")).select("x.*").join(M.best_states(sims(spark, sf, found), 1).select("label", "state"), "label").select("extreme", "label", "state")


@query("family_candidates", """select label, state, round(sim,6) as sim, row_number() over (partition by label order by round(sim,9) desc, state) as place from sims
where (select family from states s where s.state_int=label)=(select min(family) from states s where case substr(s.state_name, strpos(s.state_name,'_')+1) when 'ZNF/Rpts' then 'ZnfRpts' else substr(s.state_name, strpos(s.state_name,'_')+1) end=state)""", ("feats", "prof", "scale", "sims"))
def family_candidates(spark, sf):
    """States of the label's own family, ranked."""
    s = frame(spark, sf, "states")
    short = F.regexp_replace(F.substring_index("state_name", "_", -1), "^ZNF/Rpts$", "ZnfRpts")
    own = F.broadcast(s.select(F.col("state_int").alias("label"), "family"))
    named = F.broadcast(s.select(short.alias("state"), "family"))
    kept = sims(spark, sf).join(own, "label").join(named, ["state", "family"])
    return kept.select("label", "state", F.round("sim", 6).alias("sim"), F.row_number().over(W.partitionBy("label").orderBy(F.round("sim", 9).desc(), "state")).alias("place"))


@query("label_ranks", "select label, row_number() over (order by round(gc_content,9) desc, label) as by_gc, row_number() over (order by round(cpg_ratio,9) desc, label) as by_cpg, row_number() over (order by round(repeat_density,9) desc, label) as by_repeats, case when cpg_ratio>0.6 then 'CpG island' when row_number() over (order by round(cpg_ratio,9) desc, label)<=3 then 'likely TssA/TssBiv' else '' end as hint from wide", ("feats", "prof", "wide"))
def label_ranks(spark, sf):
    w = M.wide(profiles(spark, sf), SAFE)
    rank = lambda c: F.row_number().over(W.orderBy(F.round(c, 9).desc(), "label"))
    ranked = w.select("label", rank("gc_content").alias("by_gc"), rank("cpg_ratio").alias("by_cpg"), rank("repeat_density").alias("by_repeats"), "cpg_ratio")
    return ranked.withColumn("hint", F.when(F.col("cpg_ratio") > 0.6, "CpG island").when(F.col("by_cpg") <= 3, "likely TssA/TssBiv").otherwise("")).drop("cpg_ratio")


@query("family_confusion_share", """select round(sum(case when fa=fb then w else 0 end)/nullif(sum(w),0),6) as share, sum(w) as total from (select a.label as la, b.label as lb, round(1/(1+abs(a.value-b.value)),9) as w from prof a join prof b on a.feature='gc_content' and b.feature='gc_content' and a.label<b.label) p
join (select label, case when state like 'Tss%' or state like 'ReprPC%' then 'p' when state like 'Enh%' then 'e' when state like 'Tx%' then 't' else 'o' end as fa from best where place=1) x on x.label=la join (select label, case when state like 'Tss%' or state like 'ReprPC%' then 'p' when state like 'Enh%' then 'e' when state like 'Tx%' then 't' else 'o' end as fb from best where place=1) y on y.label=lb""".replace("sum(w) as total", "round(sum(w),6) as total"))
def family_confusion_share(spark, sf):
    """Weighted share of label pairs whose states are of one coarse family; weights are closeness in GC."""
    found = profiles(spark, sf)
    gc = found.where("feature = 'gc_content'").select("label", "value")
    a, b = gc.alias("a"), gc.alias("b")
    w = F.round(1 / (1 + F.abs(F.col("a.value") - F.col("b.value"))), 9)
    pairs = a.join(b, F.col("a.label") < F.col("b.label")).select(F.col("a.label").alias("la"), F.col("b.label").alias("lb"), w.alias("w"))
    best = M.best_states(sims(spark, sf, found), 1).select("label", S.state_family(F.col("state")).alias("f"))
    met = pairs.join(best.select(F.col("label").alias("la"), F.col("f").alias("fa")), "la").join(best.select(F.col("label").alias("lb"), F.col("f").alias("fb")), "lb")
    same = F.sum(F.when(F.col("fa") == F.col("fb"), F.col("w")).otherwise(0.0))
    return met.agg(F.round(F.try_divide(same, F.sum("w")), 6).alias("share"), F.round(F.sum("w"), 6).alias("total"))


@query("metric_rollup", "select label, round(avg(gc_content),9) as mean, round(stddev_pop(gc_content),6) as std, min(gc_content) as least, max(gc_content) as most, max_by(gc_content, seq_key) as last, count(*) as n from feats group by label", ("feats",))
def metric_rollup(spark, sf):
    g = F.col("gc_content")
    return feats(spark, sf).groupBy("label").agg(F.round(F.avg(g), 9).alias("mean"), F.round(F.stddev_pop(g), 6).alias("std"), F.min(g).alias("least"), F.max(g).alias("most"), F.max_by(g, "seq_key").alias("last"), F.count("*").alias("n"))


@query("extended_profiles", f"""select family, subcluster, count(*) as labels, round(avg(run_mean),6) as run_mean, round(avg(tgcag),6) as tgcag, sum(n) as n from (select label, avg({RUN_SQL}) as run_mean, avg(len(regexp_extract_all(seq,'TGCAG'))) as tgcag, count(*) as n from feats group by label) p
join states s on s.state_int=p.label group by family, subcluster""", ("feats",))
def extended_profiles(spark, sf):
    s = F.col("seq")
    each = feats(spark, sf).groupBy("label").agg(F.avg(S.longest_run(s)).alias("run_mean"), F.avg(S.motif_count(s, "KRAB_ZNF")).alias("tgcag"), F.count("*").alias("n"))
    st = F.broadcast(frame(spark, sf, "states").select(F.col("state_int").alias("label"), "family", "subcluster"))
    out = each.join(st, "label").groupBy("family", "subcluster").agg(F.count("*").alias("labels"), F.avg("run_mean").alias("run_mean"), F.avg("tgcag").alias("tgcag"), F.sum("n").alias("n"))
    return out.withColumn("run_mean", F.round("run_mean", 6)).withColumn("tgcag", F.round("tgcag", 6))


@query("label_diagnosis", f"select label, round(avg(case when cpg_ratio>0.6 then 1.0 else 0.0 end),6) as island_share, round(avg({RUN_SQL}),6) as mean_run, round(avg({matched_sql('A{6,}|C{6,}|G{6,}|T{6,}')}),6) as in_six_runs from feats where label in (1,2,12,18) group by label", ("feats",))
def label_diagnosis(spark, sf):
    s = F.col("seq")
    rows = feats(spark, sf).where("label in (1, 2, 12, 18)")
    six = S.matched(s, "A{6,}|C{6,}|G{6,}|T{6,}")
    return rows.groupBy("label").agg(F.round(F.avg((F.col("cpg_ratio") > 0.6).cast("double")), 6).alias("island_share"), F.round(F.avg(S.longest_run(s)), 6).alias("mean_run"), F.round(F.avg(six), 6).alias("in_six_runs"))
