"""Queries over embeddings and classifier outputs: class geometry, evaluation, sweeps, dictionaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixtures import ctes, frame
from ..functions import arrays as A
from ..functions import sequence as S
from ..operators import classes as C
from ..operators import components
from ..operators import evaluation as E
from ..operators import neighbours as N
from ..operators.ranges import stored
from ..operators.sampling import per_group
from ..schema import SEED

QUERIES: dict = {}
SQL: dict[str, str] = {}
N_CLASSES, ALPHAS, PAIRS = 12, (-2.0, -1.0, 0.0, 1.0, 2.0), 10

STEPS = {
    "v": "select row_key, class_id, pos, cast(v as double) as v from values_long",
    "cent": "select class_id, pos, avg(v) as m from v group by all",
    "centre": "select pos, avg(v) as g from v group by pos",
    "dirs": "select class_id, pos, m, m-g as d from cent join centre using(pos)",
    "prob": "select row_key, class_id, k, logit, exp(logit-max(logit) over (partition by row_key))/sum(exp(logit)) over (partition by row_key)*exp(max(logit) over (partition by row_key)) as p from logits",
    "prob_rc": "select row_key, class_id, k, logit, exp(logit)/sum(exp(logit)) over (partition by row_key) as p from logits_rc",
    "pred": "select row_key, class_id, arg_max(k, (logit, -k)) as pred, max(p) as conf from prob group by all",
    "pred_rc": "select row_key, class_id, arg_max(k, (logit, -k)) as pred from prob_rc group by all",
    "conf": "select class_id, pred, count(*) as n, count(*)/sum(count(*)) over (partition by class_id) as share from pred group by class_id, pred",
    "rel": "select cast(greatest(ceil(conf*15),1) as int) as bin, count(*) as n, avg(case when pred=class_id then 1.0 else 0.0 end) as accuracy, avg(conf) as confidence from pred group by all",
    "pairs": "select * from (select least(class_id,pred) as a, greatest(class_id,pred) as b, sum(share)/2 as score from conf where class_id<>pred group by all) order by round(score,9) desc, a, b limit 10",
    "swept": f"select l.row_key, l.class_id, t.target, a.alpha, l.k, l.logit+a.alpha*s.shift as logit from logits l, (select distinct class_id as target from head) t, (select unnest({list(ALPHAS)}) as alpha) a, (select d.class_id as target, h.class_id as k, 10*sum(d.d*h.w) as shift from dirs d join head h using(pos) group by all) s where s.target=t.target and s.k=l.k",
    "sweep": "select target, alpha, row_key, class_id, arg_max(k,(round(logit,9),-k)) as pred from swept group by all",
    "sweep_rows": "select target, alpha, avg(case when pred=class_id then 1.0 else 0.0 end) as accuracy, avg(case when class_id=target then case when pred=target then 1.0 else 0.0 end end) as target_accuracy, avg(case when pred=target then 1.0 else 0.0 end) as share_target from sweep group by all",
    "emb": "select 'raw' as method, row_key, class_id, pos, v from v union all select 'pooled', row_key, class_id, pos//4, avg(v) from v group by row_key, class_id, pos//4 union all select 'logits', row_key, class_id, k, logit from logits",
    "sil": """select method, row_key, class_id, coalesce((b-a)/greatest(a,b),0) as s from (select method, row_key, class_id, max(case when class_id=other then x end) as a, min(case when class_id<>other then x end) as b from (
  select method, row_key, class_id, other, avg(x) as x from (select a.method, a.row_key, a.class_id, b.class_id as other, b.row_key as k, sqrt(sum((a.v-b.v)*(a.v-b.v))) as x from emb a join emb b on a.method=b.method and a.pos=b.pos and a.row_key<>b.row_key group by all) group by all) group by all)""",
    "ec": "select method, class_id, pos, avg(v) as m from emb group by all",
    "enc": "select * from (select row_key, class_id, f, x, row_number() over (partition by row_key order by round(x,9) desc, f) as rk from (select row_key, class_id, d.f, sum(v*d.w) as x from v join dictionary d using(pos) group by all)) where rk<=16 and x>0",
}
DEEP = {"v": (), "cent": ("v",), "centre": ("v",), "dirs": ("v", "cent", "centre"), "prob": (), "prob_rc": (), "pred": ("prob",), "pred_rc": ("prob_rc",), "conf": ("prob", "pred"), "rel": ("prob", "pred"), "pairs": ("prob", "pred", "conf"), "swept": ("v", "cent", "centre", "dirs"), "sweep": ("v", "cent", "centre", "dirs", "swept"), "sweep_rows": ("v", "cent", "centre", "dirs", "swept", "sweep"), "enc": ("v",), "emb": ("v",), "sil": ("v", "emb"), "ec": ("v", "emb")}


def query(name: str, body: str | None, steps=(), views=("values_long", "head", "logits", "logits_rc", "dictionary")):
    def add(fn):
        QUERIES[name] = fn
        if body is not None:
            every = list(dict.fromkeys(x for s in steps for x in (*DEEP[s], s)))
            SQL[name] = ctes(views, {s: STEPS[s] for s in every}) + body
        return fn

    return add


def acts(spark, sf):
    return frame(spark, sf, "activations")


def logits(spark, sf, name="logits"):
    return frame(spark, sf, name)


def pred(spark, sf):
    return E.predictions(logits(spark, sf))


def rounded(df, *cols, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns))


@query("class_directions", f"""select c.class_id, p.pos, coalesce(n,0) as n, round(coalesce(m,0),6) as centroid, round(coalesce(m,0)-g,6) as direction
from (select cast(unnest(range(0,{N_CLASSES})) as int) as class_id) c cross join (select pos, g from centre) p left join cent on cent.class_id=c.class_id and cent.pos=p.pos
left join (select class_id, count(distinct row_key) as n from v group by class_id) k on k.class_id=c.class_id""", ("v", "cent", "centre"))
def class_directions(spark, sf):
    d = C.directions(acts(spark, sf), N_CLASSES)
    each = d.select("class_id", "n", F.posexplode(F.arrays_zip("c", "d")).alias("pos", "x"))
    return each.select("class_id", "pos", "n", F.round("x.c", 6).alias("centroid"), F.round("x.d", 6).alias("direction"))


@query("centroid_spread", """select class_id, count(*) as n, round(avg(x),6) as mean, round(stddev_pop(x),6) as std, round(max(x),6) as most from (
  select v.row_key, v.class_id, sqrt(sum((v.v-m)*(v.v-m))) as x from v join cent on v.class_id=cent.class_id and v.pos=cent.pos group by all) group by class_id""", ("v", "cent"))
def centroid_spread(spark, sf):
    return rounded(C.spread(acts(spark, sf)), "mean", "std", "most")


DIST = "select a.class_id as a, b.class_id as b, sqrt(sum((a.m-b.m)*(a.m-b.m))) as x from cent a join cent b on a.class_id<b.class_id and a.pos=b.pos group by all"


@query("centroid_distances", f"select a, b, round(x,6) as x from ({DIST})", ("v", "cent"))
def centroid_distances(spark, sf):
    return rounded(C.distances(acts(spark, sf)), "x")


@query("closest_pairs", f"select a, b, round(x,6) as x from ({DIST}) order by round(x,9), a, b limit 5", ("v", "cent"))
def closest_pairs(spark, sf):
    return rounded(C.distances(acts(spark, sf)).orderBy(F.round("x", 9), "a", "b").limit(5), "x")


@query("family_distances", f"select a%3=b%3 as within, count(*) as n, round(avg(x),6) as mean, round(median(x),6) as middle from ({DIST}) group by all", ("v", "cent"))
def family_distances(spark, sf):
    d = C.distances(acts(spark, sf)).withColumn("within", F.col("a") % 3 == F.col("b") % 3)
    return d.groupBy("within").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.median("x"), 6).alias("middle"))


PER = 5000
SAMPLE = f"select * from (select row_key, class_id, row_number() over (partition by class_id order by md5('{SEED}|'||row_key), row_key) as rk from (select distinct row_key, class_id from v)) where rk<={PER}"
SIL = f"""select row_key, class_id, coalesce((b-a)/greatest(a,b),0) as s from (select row_key, class_id, max(case when class_id=other then x end) as a, min(case when class_id<>other then x end) as b from (
  select row_key, class_id, other, avg(x) as x from (select p.row_key, p.class_id, q.class_id as other, q.row_key as k, sqrt(sum((a.v-b.v)*(a.v-b.v))) as x from ({SAMPLE}) p join v a on a.row_key=p.row_key join ({SAMPLE}) q on p.row_key<>q.row_key
  join v b on b.row_key=q.row_key and b.pos=a.pos group by all) group by all) group by all)"""


@query("silhouette_by_class", f"select class_id, count(*) as n, round(avg(s),6) as mean, row_number() over (order by round(avg(s),9) desc, class_id)<=3 as among_best, row_number() over (order by round(avg(s),9), class_id)<=3 as among_worst from ({SIL}) group by class_id", ("v",))
def silhouette_by_class(spark, sf):
    """Exact over a seeded sample of PER rows of each class, as many as the score is defined on."""
    rows = per_group(acts(spark, sf), ["class_id"], "row_key", PER)
    s = C.silhouettes(rows).groupBy("class_id").agg(F.count("*").alias("n"), F.avg("s").alias("mean"))
    rank = lambda *o: F.row_number().over(W.orderBy(*o)) <= 3
    return s.select("class_id", "n", F.round("mean", 6).alias("mean"), rank(F.round("mean", 9).desc(), "class_id").alias("among_best"), rank(F.round("mean", 9), "class_id").alias("among_worst"))


@query("adjusted_rand", """select round((s-o*t/(n*(n-1)/2))/((o+t)/2-o*t/(n*(n-1)/2)),6) as ari from (select sum(n*(n-1)/2) as s, sum(n) as n from conf), (select sum(n*(n-1)/2) as o from (select class_id, sum(n) as n from conf group by 1)),
  (select sum(n*(n-1)/2) as t from (select pred, sum(n) as n from conf group by 1))""", ("conf",))
def adjusted_rand(spark, sf):
    return rounded(C.adjusted_rand(pred(spark, sf), "class_id", "pred"), "ari")


@query("knn_classes", """select row_key, arg_min(class_id,(-n,class_id)) as pred from (select row_key, class_id, count(*) as n from (select q.row_key, r.row_key as other, r.class_id, row_number() over (partition by q.row_key order by round(sqrt(sum((q.v-r.v)*(q.v-r.v))),9), r.row_key) as rk
  from v q join v r on q.pos=r.pos where q.row_key%10=0 and r.row_key%10<>0 group by q.row_key, r.row_key, r.class_id) where rk<=30 group by all) group by row_key""", ("v",))
def knn_classes(spark, sf):
    rows = acts(spark, sf)
    near, _ = N.nearest(rows.where("row_key % 10 = 0"), rows.where("row_key % 10 <> 0"), 30)
    return C.majority(near)


@query("knn_cost", None)
def knn_cost(spark, sf):
    """Pairs that the search of `knn_classes` compares, of queries times known rows."""
    rows = acts(spark, sf)
    return N.nearest(rows.where("row_key % 10 = 0"), rows.where("row_key % 10 <> 0"), 30)[1]


@query("confusion", "select class_id, pred, n, round(share,6) as share from conf", ("conf",))
def confusion(spark, sf):
    return rounded(E.confusion(pred(spark, sf)), "share")


@query("confused_pairs", "select a, b, round(score,6) as score from pairs", ("pairs",))
def confused_pairs(spark, sf):
    return rounded(E.confused_pairs(pred(spark, sf), PAIRS), "score")


@query("accuracy_by_class", f"""select c.class_id, coalesce(n,0) as n, round(coalesce(acc,0),6) as accuracy, round((select avg(case when pred=class_id then 1.0 else 0.0 end) from pred),6) as overall,
  round((select sum(acc) from (select class_id, avg(case when pred=class_id then 1.0 else 0.0 end) as acc from pred group by 1))/{N_CLASSES},6) as macro
from (select cast(unnest(range(0,{N_CLASSES})) as int) as class_id) c left join (select class_id, count(*) as n, avg(case when pred=class_id then 1.0 else 0.0 end) as acc from pred group by 1) p using(class_id)""", ("pred",))
def accuracy_by_class(spark, sf):
    hit = (F.col("pred") == F.col("class_id")).cast("double")
    p = pred(spark, sf)
    each = p.groupBy("class_id").agg(F.count("*").alias("n"), F.sum(hit).alias("hits"))
    grid = spark.range(N_CLASSES).select(F.col("id").cast("int").alias("class_id")).join(F.broadcast(each), "class_id", "left").fillna(0)
    acc, all_ = F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)), W.partitionBy()
    return grid.select("class_id", "n", F.round(acc, 6).alias("accuracy"), F.round(F.sum("hits").over(all_) / F.sum("n").over(all_), 6).alias("overall"), F.round(F.avg(acc).over(all_), 6).alias("macro"))


@query("correct_rows", "select row_key, class_id from pred where pred=class_id", ("pred",))
def correct_rows(spark, sf):
    return pred(spark, sf).where("pred = class_id").select("row_key", "class_id")


@query("confused_rows", "select p.row_key, a, b from pred p join pairs on p.class_id=a and p.pred=b", ("pred", "pairs"))
def confused_rows(spark, sf):
    p = pred(spark, sf)
    return p.join(F.broadcast(E.confused_pairs(p, PAIRS).select("a", "b")), (F.col("class_id") == F.col("a")) & (F.col("pred") == F.col("b"))).select("row_key", "a", "b")


@query("calibration_error", "select round(sum(n*abs(accuracy-confidence))/sum(n),6) as ece from rel", ("rel",))
def calibration_error(spark, sf):
    return rounded(E.calibration_error(pred(spark, sf)), "ece")


@query("reliability", "select bin, n, round(accuracy,6) as accuracy, round(confidence,6) as confidence from rel", ("rel",))
def reliability(spark, sf):
    return rounded(E.reliability(pred(spark, sf)), "accuracy", "confidence")


@query("temperature", None)
def temperature(spark, sf):
    """Fitted temperature, and the calibration error before and after."""
    z = logits(spark, sf)
    t = E.fit_temperature(z)
    after = z.withColumn("logit", F.col("logit") / F.lit(t))
    return E.calibration_error(E.predictions(z)).withColumnRenamed("ece", "before").crossJoin(E.calibration_error(E.predictions(after)).withColumnRenamed("ece", "after")).withColumn("temperature", F.lit(t))


@query("strand_consistency", """select p.class_id, count(*) as n, round(avg(case when p.pred=r.pred then 1.0 else 0.0 end),6) as agree, round(avg(d.kl),6) as mean_kl from pred p join pred_rc r using(row_key)
join (select a.row_key, sum(greatest(a.p,1e-12)*ln(greatest(a.p,1e-12)/greatest(b.p,1e-12))) as kl from prob a join prob_rc b on a.row_key=b.row_key and a.k=b.k group by 1) d using(row_key) group by p.class_id""", ("pred", "pred_rc"))
def strand_consistency(spark, sf):
    both = E.strands(logits(spark, sf), logits(spark, sf, "logits_rc"))
    same = (E.predicted(F.col("p")) == E.predicted(F.col("q"))).cast("double")
    out = both.groupBy("class_id").agg(F.count("*").alias("n"), F.avg(same).alias("agree"), F.avg(E.divergence(F.col("p"), F.col("q"))).alias("mean_kl"))
    return rounded(out, "agree", "mean_kl")


@query("strand_average", "select row_key, arg_max(k,(round(p,12),-k)) as pred from (select a.row_key, a.k, (a.p+b.p)/2 as p from prob a join prob_rc b on a.row_key=b.row_key and a.k=b.k) group by 1", ("prob", "prob_rc"))
def strand_average(spark, sf):
    mean = F.zip_with("p", "q", lambda x, y: F.round((x + y) / 2, 12))
    return E.strands(logits(spark, sf), logits(spark, sf, "logits_rc")).select("row_key", E.predicted(mean).alias("pred"))


def shifts(spark, sf):
    """(target, k, shift): what a step along a class direction adds to each logit of the linear head."""
    d = C.directions(acts(spark, sf), 10).select(F.col("class_id").alias("target"), F.posexplode("d").alias("pos", "d"))
    return d.join(F.broadcast(frame(spark, sf, "head")), "pos").groupBy("target", F.col("class_id").alias("k")).agg((10 * F.sum(F.col("d") * F.col("w"))).alias("shift"))


def swept(spark, sf):
    """Predictions for every row, target and alpha: shifts are a table of classes squared, broadcast by its fixed size."""
    z = E.vectors(logits(spark, sf))
    s = shifts(spark, sf).groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "shift"))), lambda x: x["shift"]).alias("shift"))
    grid = s.select("target", "shift", F.explode(F.array(*map(F.lit, ALPHAS))).alias("alpha"))
    out = z.crossJoin(F.broadcast(grid)).withColumn("z", F.expr("zip_with(z, shift, (x, y) -> round(x + alpha * y, 9))"))
    return out.select("target", "alpha", "row_key", "class_id", E.predicted(F.col("z")).alias("pred"))


def sweep_rows(spark, sf):
    share = lambda c: F.avg(c.cast("double"))
    own = F.when(F.col("class_id") == F.col("target"), F.col("pred") == F.col("target"))
    return swept(spark, sf).groupBy("target", "alpha").agg(share(F.col("pred") == F.col("class_id")).alias("accuracy"), share(own).alias("target_accuracy"), share(F.col("pred") == F.col("target")).alias("share_target"))


@query("alpha_sweep", "select target, alpha, round(accuracy,6) as accuracy, round(target_accuracy,6) as target_accuracy, round(share_target,6) as share_target from sweep_rows", ("sweep_rows",))
def alpha_sweep(spark, sf):
    return rounded(sweep_rows(spark, sf), "accuracy", "target_accuracy", "share_target")


@query("best_alpha", "select target, alpha, round(target_accuracy,6) as target_accuracy from (select *, row_number() over (partition by target order by round(target_accuracy,9) desc, alpha) as rk from sweep_rows) where rk=1", ("sweep_rows",))
def best_alpha(spark, sf):
    best = F.min_by(F.struct("alpha", "target_accuracy"), F.struct(-F.round("target_accuracy", 9), "alpha"))
    return rounded(sweep_rows(spark, sf).groupBy("target").agg(best.alias("x")).select("target", "x.*"), "target_accuracy")


@query("contrastive_recovery", f"""select a, b, alpha, count(*) as n, round(avg(case when pred=a then 1.0 else 0.0 end),6) as recovered from (select p.a, p.b, e.alpha, l.row_key, arg_max(l.k,(round(l.logit+e.alpha*s.shift,9),-l.k)) as pred
from pairs p join pred r on r.class_id=p.a and r.pred=p.b join logits l on l.row_key=r.row_key cross join (select unnest({list(ALPHAS)}) as alpha) e
join (select x.class_id as a, y.class_id as b, h.class_id as k, 10*sum((x.d-y.d)*h.w) as shift from dirs x join dirs y on x.pos=y.pos join head h on h.pos=x.pos group by all) s on s.a=p.a and s.b=p.b and s.k=l.k group by all) group by a,b,alpha""", ("pairs", "dirs"))
def contrastive_recovery(spark, sf):
    p = pred(spark, sf)
    rows = p.join(F.broadcast(E.confused_pairs(p, PAIRS).select("a", "b")), (F.col("class_id") == F.col("a")) & (F.col("pred") == F.col("b"))).select("row_key", "a", "b")
    s = shifts(spark, sf)
    z = logits(spark, sf).join(rows, "row_key").join(F.broadcast(s.select(F.col("target").alias("a"), "k", F.col("shift").alias("sa"))), ["a", "k"]).join(F.broadcast(s.select(F.col("target").alias("b"), "k", F.col("shift").alias("sb"))), ["b", "k"])
    z = z.withColumn("alpha", F.explode(F.array(*map(F.lit, ALPHAS)))).withColumn("logit", F.round(F.col("logit") + F.col("alpha") * (F.col("sa") - F.col("sb")), 9))
    best = z.groupBy("a", "b", "alpha", "row_key").agg(F.max_by("k", F.struct("logit", -F.col("k"))).alias("pred"))
    return best.groupBy("a", "b", "alpha").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("a")).cast("double")), 6).alias("recovered"))


PATCH_N, LEAST_ROWS = 200, 3
PATCH = f"""select p.a, p.b, x.row_key as row_a, y.row_key as row_b from pairs p join (select *, row_number() over (partition by class_id order by md5('1|'||row_key), row_key) as rk from pred where pred=class_id) x on x.class_id=p.a
join (select *, row_number() over (partition by class_id order by md5('2|'||row_key), row_key) as rk from pred where pred=class_id) y on y.class_id=p.b and y.rk=x.rk where x.rk<={PATCH_N}"""


@query("patch_recovery", f"""select a, b, count(*) as n, round(avg(ca-pa),6) as mean_drop, round(avg(case when ca-cb>0 then (ca-pa)/(ca-cb) end),6) as recovery, round(avg(ca-cb),6) as baseline_gap from (
  select t.a, t.b, la.logit as ca, lb.logit as cb, lp.logit as pa from ({PATCH}) t join logits la on la.row_key=t.row_a and la.k=t.a join logits lb on lb.row_key=t.row_b and lb.k=t.a join logits_rc lp on lp.row_key=t.row_a and lp.k=t.a) group by a,b""", ("pairs",))
def patch_recovery(spark, sf):
    """Three recorded logit tables joined: clean rows of a and of b, and the patched run of a (here the reversed strand)."""
    t = patched_rows(spark, sf)
    z = logits(spark, sf)
    of = lambda src, row, name: src.select(F.col("row_key").alias(row), F.col("k").alias("a"), F.col("logit").alias(name))
    j = t.join(of(z, "row_a", "ca"), ["row_a", "a"]).join(of(z, "row_b", "cb"), ["row_b", "a"]).join(of(logits(spark, sf, "logits_rc"), "row_a", "pa"), ["row_a", "a"])
    gap, drop = F.col("ca") - F.col("cb"), F.col("ca") - F.col("pa")
    out = j.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg(drop).alias("mean_drop"), F.avg(F.when(gap > 0, drop / gap)).alias("recovery"), F.avg(gap).alias("baseline_gap"))
    return rounded(out, "mean_drop", "recovery", "baseline_gap")


def patched_rows(spark, sf):
    """(a, b, row_a, row_b): rows predicted right of both classes of the confused pairs, matched by seeded order."""
    p = pred(spark, sf)
    right = p.where("pred = class_id").select("row_key", "class_id")
    rank = lambda seed: F.row_number().over(W.partitionBy("class_id").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("row_key").cast("string"))), "row_key"))
    a = right.select(F.col("class_id").alias("a"), F.col("row_key").alias("row_a"), rank(1).alias("rk")).where(F.col("rk") <= PATCH_N)
    b = right.select(F.col("class_id").alias("b"), F.col("row_key").alias("row_b"), rank(2).alias("rk")).where(F.col("rk") <= PATCH_N)
    return F.broadcast(E.confused_pairs(p, PAIRS).select("a", "b")).join(a, "a").join(b, ["b", "rk"])


@query("patch_by_hook", f"""select hook, count(*) as class_pairs, round(avg(r),6) as mean_recovery, round(median(r),6) as median_recovery from (
  select a, b, hook, round(sum(d)/nullif(any_value(gap),0),9) as r from (select t.a, t.b, x.pos//16 as hook, sum((x.v-y.v)*h.w) as d, any_value(t.n) as n from (select *, count(*) over (partition by a, b) as n from ({PATCH})) t join v x on x.row_key=t.row_a join v y on y.row_key=t.row_b and y.pos=x.pos join head h on h.class_id=t.a and h.pos=x.pos group by t.a, t.b, hook)
  join (select t.a as ga, t.b as gb, sum((x.v-y.v)*h.w) as gap from ({PATCH}) t join v x on x.row_key=t.row_a join v y on y.row_key=t.row_b and y.pos=x.pos join head h on h.class_id=t.a and h.pos=x.pos group by t.a, t.b) on a=ga and b=gb where n>={LEAST_ROWS} group by a, b, hook) group by hook""", ("pairs", "v"))
def patch_by_hook(spark, sf):
    """A hook is a part of the vector: a row's part is replaced by the other row's, and the head's loss is its recovery.

    Class pairs with fewer than LEAST_ROWS matched rows are skipped.
    """
    t = patched_rows(spark, sf)
    enough = t.groupBy("a", "b").count().where(F.col("count") >= LEAST_ROWS).select("a", "b")
    t = t.join(F.broadcast(enough), ["a", "b"])
    v = acts(spark, sf).select("row_key", "h")
    met = t.join(v.toDF("row_a", "x"), "row_a").join(v.toDF("row_b", "y"), "row_b")
    each = met.select("a", "b", F.posexplode(F.zip_with("x", "y", lambda x, y: x.cast("double") - y.cast("double"))).alias("pos", "d"))
    sums = each.groupBy("a", "b", "pos").agg(F.sum("d").alias("d"))
    parts = sums.join(F.broadcast(frame(spark, sf, "head").withColumnRenamed("class_id", "a")), ["a", "pos"]).groupBy("a", "b", F.floor(F.col("pos") / 16).alias("hook")).agg(F.sum(F.col("d") * F.col("w")).alias("d"))
    r = F.round(F.try_divide("d", F.sum("d").over(W.partitionBy("a", "b"))), 9)
    return parts.withColumn("r", r).groupBy("hook").agg(F.count("*").alias("class_pairs"), F.round(F.avg("r"), 6).alias("mean_recovery"), F.round(F.median("r"), 6).alias("median_recovery"))


@query("alpha_monotonicity", "select target, count(*) as steps, count(*) filter (share_target>=before-1e-12) as rising, round(avg(case when share_target>=before-1e-12 then 1.0 else 0.0 end),6) as share from (select target, share_target, lag(share_target) over (partition by target order by alpha) as before from sweep_rows) where before is not null group by target", ("sweep_rows",))
def alpha_monotonicity(spark, sf):
    """Share of steps in strength over which the share of rows predicted as the target does not fall."""
    before = F.lag("share_target").over(W.partitionBy("target").orderBy("alpha"))
    steps = sweep_rows(spark, sf).withColumn("before", before).where("before is not null").withColumn("up", F.col("share_target") >= F.col("before") - 1e-12)
    return steps.groupBy("target").agg(F.count("*").alias("steps"), F.count_if("up").alias("rising"), F.round(F.avg(F.col("up").cast("double")), 6).alias("share"))


COARSE_SQL = "case when n like 'Tss%' or n like 'ReprPC%' then 'p' when n like 'Enh%' then 'e' when n like 'Tx%' then 't' else 'o' end"


@query("confusion_family_share", f"select round(sum(case when fa=fb then w else 0 end)/nullif(sum(w),0),6) as share, sum(w) as mistakes from (select class_id, pred, n as w from conf where class_id<>pred) join (select state_int-1 as ka, {COARSE_SQL} as fa from (select state_int, substr(state_name, strpos(state_name,'_')+1) as n from states)) on ka=class_id join (select state_int-1 as kb, {COARSE_SQL} as fb from (select state_int, substr(state_name, strpos(state_name,'_')+1) as n from states)) on kb=pred", ("conf",), ("values_long", "head", "logits", "states"))
def confusion_family_share(spark, sf):
    """Of the classifier's mistakes, the share whose two states are of one coarse family."""
    states = frame(spark, sf, "states").select((F.col("state_int") - 1).alias("k"), S.state_family(F.substring_index("state_name", "_", -1)).alias("family"))
    wrong = E.confusion(pred(spark, sf)).where("class_id <> pred")
    met = wrong.join(F.broadcast(states.toDF("class_id", "fa")), "class_id").join(F.broadcast(states.toDF("pred", "fb")), "pred")
    same = F.sum(F.when(F.col("fa") == F.col("fb"), F.col("n")).otherwise(0))
    return met.agg(F.round(F.try_divide(same, F.sum("n")), 6).alias("share"), F.sum("n").alias("mistakes"))


@query("embedding_report", """select method, round(silhouette,6) as silhouette, round(nearest,6) as nearest_centroids, round(spread,6) as spread, row_number() over (order by round(silhouette,9) desc, method) as place from (select method, avg(s) as silhouette from sil group by method)
join (select method, min(x) as nearest from (select a.method, a.class_id as ka, b.class_id as kb, sqrt(sum((a.m-b.m)*(a.m-b.m))) as x from ec a join ec b on a.method=b.method and a.pos=b.pos and a.class_id<b.class_id group by all) group by method) using(method)
join (select method, avg(x) as spread from (select e.method, e.row_key, sqrt(sum((e.v-m)*(e.v-m))) as x from emb e join ec using(method, class_id, pos) group by all) group by method) using(method)""", ("emb", "sil", "ec"))
def embedding_report(spark, sf):
    """Each embedding's silhouette, nearest centroids and spread over all rows, and its rank by silhouette."""
    a = acts(spark, sf).select("row_key", "class_id", F.transform("h", lambda x: x.cast("double")).alias("h"))
    pooled = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.aggregate(F.slice("h", i * 4 + 1, 4), F.lit(0.0), lambda s, x: s + x) / 4)
    z = stored(E.vectors(logits(spark, sf)).where("row_key is not null").select("row_key", "class_id", F.col("z").alias("h")), "logits")
    out = None
    for method, rows in (("raw", a), ("pooled", a.withColumn("h", pooled)), ("logits", z)):
        mean = C.silhouettes(rows).agg(F.avg("s").alias("silhouette"))
        near = C.distances(rows).agg(F.min("x").alias("nearest_centroids"))
        wide = C.spread(rows).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("spread"))
        each = mean.crossJoin(near).crossJoin(wide).withColumn("method", F.lit(method))
        out = each if out is None else out.unionByName(each)
    out = out.withColumn("place", F.row_number().over(W.orderBy(F.round("silhouette", 9).desc(), "method")))
    return rounded(out, "silhouette", "nearest_centroids", "spread")


@query("layer_projections", "select class_id, part, round(avg(x),6) as projection from (select v.row_key, v.class_id, v.pos//16 as part, sum(v.v*d.d/nullif(u.len,0)) as x from v join dirs d on d.class_id=v.class_id and d.pos=v.pos join (select class_id, sqrt(sum(d*d)) as len from dirs group by 1) u on u.class_id=v.class_id group by all) group by all", ("dirs",))
def layer_projections(spark, sf):
    """Mean projection of each row's parts (layers) on the unit direction of its true class."""
    d = C.directions(acts(spark, sf), 10).select("class_id", F.posexplode("unit").alias("pos", "u"))
    x = C.long_form(acts(spark, sf)).join(F.broadcast(d), ["class_id", "pos"]).groupBy("row_key", "class_id", F.floor(F.col("pos") / 16).alias("part")).agg(F.sum(F.col("v") * F.col("u")).alias("x"))
    return x.groupBy("class_id", "part").agg(F.round(F.avg("x"), 6).alias("projection"))


@query("activation_statistics", "select count(*) as n, round(avg(v),9) as mean, round(stddev_pop(v),6) as std, round(avg(case when v=0 then 1.0 else 0.0 end),6) as zero_share from v", ("v",))
def activation_statistics(spark, sf):
    v = C.long_form(acts(spark, sf))
    return v.agg(F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.round(F.avg((F.col("v") == 0).cast("double")), 6).alias("zero_share"))


@query("position_profiles", "select class_id, pos, round(avg(v),6) as mean, round(stddev_pop(v),6) as std from v group by all", ("v",))
def position_profiles(spark, sf):
    return rounded(C.long_form(acts(spark, sf)).groupBy("class_id", "pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")), "mean", "std")


FEATURES, KEPT = 256, 16


def encoded(spark, sf):
    """(row_key, class_id, f, x): the largest KEPT activations of each row that are positive, from a fixed dictionary of 256 x 64."""
    f, pos = np.meshgrid(np.arange(FEATURES), np.arange(64), indexing="ij")
    weights = ((f * 17 + pos * 29) % 23 - 11) / 23.0

    def encode(h: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in h]) @ weights.T if len(h) else np.zeros((0, FEATURES))
        ranked = np.argsort(-np.round(x, 9), axis=1, kind="stable")[:, :KEPT]
        return pd.Series([[{"f": int(j), "x": float(row[j])} for j in top if row[j] > 0] for row, top in zip(x, ranked)])

    encode.__annotations__ = {"h": pd.Series, "return": pd.Series}
    kind = T.ArrayType(T.StructType().add("f", T.IntegerType()).add("x", T.DoubleType()))
    return acts(spark, sf).select("row_key", "class_id", F.explode(F.pandas_udf(encode, kind)("h")).alias("e")).select("row_key", "class_id", "e.*")


@query("feature_rates", f"select d.f, count(e.row_key) as n, round(count(e.row_key)/(select count(distinct row_key) from v),6) as rate, round(coalesce(avg(e.x),0),6) as mean_on from (select distinct f from dictionary) d left join enc e using(f) group by d.f", ("enc",))
def feature_rates(spark, sf):
    e = encoded(spark, sf).groupBy("f").agg(F.count("*").alias("n"), F.avg("x").alias("mean_on"))
    rows = acts(spark, sf).agg(F.count("*").alias("rows"))
    grid = spark.range(FEATURES).select(F.col("id").cast("int").alias("f")).join(F.broadcast(e), "f", "left").fillna(0).crossJoin(F.broadcast(rows))
    return grid.select("f", "n", F.round(F.col("n") / F.col("rows"), 6).alias("rate"), F.round("mean_on", 6).alias("mean_on"))


TOP = "select *, count(*) over (partition by f) as m from (select f, row_key, class_id, row_number() over (partition by f order by round(x,9) desc, row_key) as place from enc) where place<=20"


@query("feature_dictionary", f"""select f, sum(n) as rows, round(0-sum(n/m*log2(n/m)),6) as entropy, round(1-(0-sum(n/m*log2(n/m)))/log2(10),6) as specificity, string_agg(cast(class_id as varchar), ',' order by n desc, class_id) filter (place<=4) as top_classes
from (select f, class_id, m, count(*) as n, row_number() over (partition by f order by count(*) desc, class_id) as place from ({TOP}) group by f, class_id, m) group by f""", ("enc",))
def feature_dictionary(spark, sf):
    top = encoded(spark, sf).withColumn("place", F.row_number().over(W.partitionBy("f").orderBy(F.round("x", 9).desc(), "row_key"))).where("place <= 20")
    n = top.groupBy("f", "class_id").agg(F.count("*").alias("n")).withColumn("m", F.sum("n").over(W.partitionBy("f")))
    part = F.col("n") / F.col("m")
    h = -F.sum(part * F.log2(part))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "class_id"))), 1, 4)
    out = n.groupBy("f").agg(F.sum("n").alias("rows"), h.alias("entropy"), (1 - h / F.log2(F.lit(10.0))).alias("specificity"), F.array_join(F.transform(best, lambda x: x["class_id"].cast("string")), ",").alias("top_classes"))
    return rounded(out, "entropy", "specificity")


@query("feature_examples", f"""select f, m as rows, examples, family as top_family, round(n/m,6) as family_share, families from (select f, m, string_agg(cast(row_key as varchar), ',' order by place) as examples from ({TOP}) group by f, m)
join (select f, family, n, count(*) over (partition by f) as families, row_number() over (partition by f order by n desc, family) as rk from (select f, class_id%3 as family, count(*) as n from ({TOP}) group by all)) using(f) where rk=1""", ("enc",))
def feature_examples(spark, sf):
    """Ids of each feature's strongest rows in order, and the leading family with its share."""
    top = encoded(spark, sf).withColumn("place", F.row_number().over(W.partitionBy("f").orderBy(F.round("x", 9).desc(), "row_key"))).where("place <= 20")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "row_key"))), lambda x: x["row_key"].cast("string")), ",")
    listed = top.groupBy("f").agg(F.count("*").alias("rows"), ids.alias("examples"))
    families = top.groupBy("f", (F.col("class_id") % 3).alias("family")).agg(F.count("*").alias("n"))
    best = families.groupBy("f").agg(F.min_by(F.struct("family", "n"), F.struct(-F.col("n"), "family")).alias("x"), F.count("*").alias("families"))
    return listed.join(best, "f").select("f", "rows", "examples", F.col("x.family").alias("top_family"), F.round(F.col("x.n") / F.col("rows"), 6).alias("family_share"), "families")


@query("dictionary_summary", f"""select count(*) as features, count(*) filter (s is null) as dead, round(count(*) filter (s is null)/count(*),6) as dead_share, round(median(coalesce(s,0)),6) as median_specificity from (select distinct f from dictionary)
left join (select f, round(1-(0-sum(n/m*log2(n/m)))/log2(10),9) as s from (select f, class_id, m, count(*) as n from ({TOP}) group by f, class_id, m) group by f) using(f)""", ("enc",))
def dictionary_summary(spark, sf):
    """Features that never fire, and the median specificity, a dead one's being 0."""
    d = feature_dictionary(spark, sf).select("f", F.col("specificity").alias("s"))
    every = frame(spark, sf, "dictionary").select("f").distinct().join(d, "f", "left")
    dead = F.count_if(F.col("s").isNull())
    return every.agg(F.count("*").alias("features"), dead.alias("dead"), F.round(dead / F.count("*"), 6).alias("dead_share"), F.round(F.median(F.coalesce("s", F.lit(0.0))), 6).alias("median_specificity"))


@query("feature_classes", "select f, class_id, count(*) as n from enc group by all", ("enc",))
def feature_classes(spark, sf):
    return encoded(spark, sf).groupBy("f", "class_id").agg(F.count("*").alias("n"))


@query("feature_pairs", "select a.f as a, b.f as b, count(*) as n from enc a join enc b on a.row_key=b.row_key and a.f<b.f group by all having count(*)>=3", ("enc",))
def feature_pairs(spark, sf):
    """Pairs come from each row's few kept features, inside the row."""
    held = encoded(spark, sf).groupBy("row_key").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    pairs = held.select("fs", F.explode("fs").alias("a")).select("a", F.explode(F.filter("fs", lambda x: x > F.col("a"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 3")


@query("reconstruction", """select round(avg(err),6) as error, round(1-avg(err)/avg(var),6) as r2, round(avg(l0),6) as mean_l0 from (select v.row_key, sum((v.v-coalesce(r.y,0))*(v.v-coalesce(r.y,0))) as err, sum((v.v-g)*(v.v-g)) as var from v join centre using(pos)
left join (select e.row_key, d.pos, sum(e.x*d.w)/64 as y from enc e join dictionary d using(f) group by all) r on r.row_key=v.row_key and r.pos=v.pos group by 1) join (select row_key, count(*) as l0 from enc group by 1) using(row_key)""", ("enc", "centre"))
def reconstruction(spark, sf):
    e, v = encoded(spark, sf), C.long_form(acts(spark, sf))
    y = e.join(F.broadcast(frame(spark, sf, "dictionary")), "f").groupBy("row_key", "pos").agg((F.sum(F.col("x") * F.col("w")) / 64).alias("y"))
    g = v.groupBy("pos").agg(F.avg("v").alias("g"))
    sq = lambda c: F.sum(c * c)
    rows = v.join(F.broadcast(g), "pos").join(y, ["row_key", "pos"], "left").groupBy("row_key").agg(sq(F.col("v") - F.coalesce("y", F.lit(0.0))).alias("err"), sq(F.col("v") - F.col("g")).alias("var"))
    out = rows.join(e.groupBy("row_key").agg(F.count("*").alias("l0")), "row_key").agg(F.avg("err").alias("error"), (1 - F.avg("err") / F.avg("var")).alias("r2"), F.avg("l0").alias("mean_l0"))
    return rounded(out, "error", "r2", "mean_l0")


def as_vectors(spark, sf):
    from pyspark.ml.functions import array_to_vector

    return acts(spark, sf).select("row_key", "class_id", "family_id", array_to_vector(F.transform("h", lambda x: x.cast("double"))).alias("x"))


@query("principal_variance", None)
def principal_variance(spark, sf):
    """Standardise and fit principal components; explained and cumulative variance of each."""
    rows = acts(spark, sf).select("h")

    def dense(batch):
        return batch.column("h").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)

    # As many directions as a vector has numbers: one pass is exact.
    made = components.fit(rows, dense, 64, 1)
    shares = made.shares()[:10].tolist() if made else []
    out = spark.createDataFrame([(i + 1, float(s)) for i, s in enumerate(shares)], "component int, share double")
    return out.withColumn("cumulative", F.sum("share").over(W.orderBy("component")))


@query("cluster_agreement", None)
def cluster_agreement(spark, sf):
    """k-means with several seeds, the cheapest kept; agreement with the classes."""
    from pyspark.ml.clustering import KMeans

    rows = as_vectors(spark, sf).persist()
    models = [KMeans(k=10, seed=s, featuresCol="x", predictionCol="cluster").fit(rows) for s in range(3)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    out = C.adjusted_rand(best.transform(rows), "class_id", "cluster").withColumn("inertia", F.lit(float(best.summary.trainingCost)))
    return out


@query("linear_probes", None)
def linear_probes(spark, sf):
    """Held-out accuracy of multinomial logistic probes for class and family."""
    from pyspark.ml.classification import LogisticRegression

    from ..operators.sampling import holdout

    rows = as_vectors(spark, sf).withColumn("held", holdout("row_key"))
    out = None
    for target in ("class_id", "family_id"):
        model = LogisticRegression(featuresCol="x", labelCol=target, maxIter=30, family="multinomial").fit(rows.where("not held"))
        acc = model.transform(rows.where("held")).agg(F.lit(target).alias("target"), F.avg((F.col("prediction") == F.col(target)).cast("double")).alias("accuracy"))
        out = acc if out is None else out.union(acc)
    return out
