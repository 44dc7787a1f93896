"""Views over the given tables in the shapes that the operators read, in both SQL dialects.

Each view is one SQL text over the tables; only the series generator differs. `frame`
gives it as a Spark DataFrame and `ctes` as common table expressions for DuckDB.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from .schema import CHROMOSOMES, PROTOTYPES, SAFE, STATES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
MIXED = "||".join(f"md5(concat(o_orderkey,'|{i}'))" for i in range(7))


def letters(to: str) -> str:
    return f"substr(translate({MIXED},'0123456789abcdef','{to}'),1,"


def values(rows) -> str:
    return "(values " + ",".join("(" + ",".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


def body(chrom: str, chunk: str) -> str:
    """1000 letters of a chromosome chunk."""
    return "substr(translate(" + "||".join(f"md5(concat({chrom},':',{chunk},':',{j}))" for j in range(32)) + ",'0123456789abcdef','AACCCGGGTTACGTAT'),1,1000)"


VIEWS = {
    "states": f"select * from {values(STATES)} as t(state_int, state_name, family, family_id, subcluster)",
    "chrom_sizes": f"select * from {values((c, 780000 + 1000 * i) for i, c in enumerate(CHROMOSOMES, 1))} as t(chrom, size)",
    "prototypes": f"select state, feature, cast(value as double) as value from {values((s, f, v) for s, vs in PROTOTYPES.items() for f, v in zip(SAFE, vs))} as t(state, feature, value)",
    "segments": """
select 'E'||lpad(cast(l_suppkey%20+1 as string),3,'0') as eid,
  case when l_partkey%26<22 then 'chr'||cast(l_partkey%26+1 as string)
       when l_partkey%26=22 then 'chrX' when l_partkey%26=23 then 'chrY'
       when l_partkey%26=24 then 'chrUn_1' else '7' end as chrom,
  cast(200*(l_orderkey%4000) as int) as start_pos,
  cast(200*(l_orderkey%4000) + case when l_linenumber=7 then 150 else 200*(cast(l_quantity as int)%4) end as int) as end_pos,
  coalesce(state_name, '7_Enh') as state_name,
  concat(l_orderkey,'-',l_partkey,'-',l_suppkey,'-',l_linenumber) as seg_key
from lineitem left join states on state_int = cast((l_orderkey+l_partkey)%19+1 as int)""",
    "sequences": f"""
select o_orderkey as seq_key, cast(o_orderkey%18+1 as int) as label,
  'E'||lpad(cast(o_custkey%20+1 as string),3,'0') as eid,
  case when o_custkey%24<22 then 'chr'||cast(o_custkey%24+1 as string) when o_custkey%24=22 then 'chrX' else 'chrY' end as chrom,
  case when o_orderkey%97=0 then repeat('A',200)
       when o_orderkey%50=0 then 'N'||{letters('AACCCGGGTTACGTAT')}199)
       when o_orderkey%71=0 then 'R'||{letters('AACCCGGGTTACGTAT')}199)
       when o_orderkey%18 in (0,1,2,3,13) then {letters('ACCCCGGGGCGCGTAT')}200)
       when o_orderkey%18 in (11,12,17) then {letters('AAAAAATTTTTTACGT')}200)
       else {letters('AACCCGGGTTACGTAT')}200) end as seq
from orders""",
    "epigenomes": """
select 'E'||lpad(cast(s_suppkey+1 as string),3,'0') as eid, s_name as name, r_name as grp, n_name as anatomy
from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey where s_suppkey<20""",
    "chain_blocks": """
select chrom, 8000*i as t_start, 8000*i+7900 as t_end, chrom as q_chrom, 8000*i+1000-350*(i%3) as q_start,
  case when i%10=9 then '-' else '+' end as strand
from (select chrom, {series:101} as i from chrom_sizes) b""",
    "ref_chunks": f"""
select chrom, c as chunk, case when c%40=7 then 'N'||substr(s,2) else s end as seq
from (select chrom, c, {body('chrom', 'c')}||substr({body('chrom', 'c+1')},1,200) as s
      from (select chrom, {{series:805}} as c from chrom_sizes) a) b""",
    "activations": "select vec_id as row_key, cast(label as int) as class_id, cast(label%3 as int) as family_id, embedding as h from embeddings where embedding is not null",
    "values_long": "select row_key, class_id, {series:64} as pos, {unnest:h} as v from activations",
    "head": "select class_id, pos, round(avg(cast(v as double)),6) as w from values_long group by class_id, pos",
    "logits": "select a.row_key, a.class_id, h.class_id as k, round(10*sum(cast(a.v as double)*h.w),9) as logit from values_long a join head h on a.pos=h.pos group by a.row_key, a.class_id, h.class_id",
    "logits_rc": "select a.row_key, a.class_id, h.class_id as k, round(10*sum(cast(a.v as double)*h.w),9) as logit from values_long a join head h on 63-a.pos=h.pos group by a.row_key, a.class_id, h.class_id",
    "filters": """
select f, off, b as base, (case b when 'A' then 0 when 'C' then 1 when 'G' then 2 else 3 end) as channel,
  (((f*31+off*7+(case b when 'A' then 0 when 'C' then 1 when 'G' then 2 else 3 end)*13)%11)-5)/5.0e0 as w
from (select f, off, {letters4} as b from (select f, {series:19} as off from (select {series:8} as f) x) y) z""",
    "dictionary": "select f, pos, (((f*17+pos*29)%23)-11)/23.0e0 as w from (select f, {series:64} as pos from (select {series:256} as f) x) y",
}
NEEDS = {name: [v for v in [*VIEWS, *TABLES] if v != name and re.search(rf"\b(?:from|join) {v}\b", text)] for name, text in VIEWS.items()}


def spelled(text: str, spark: bool) -> str:
    """The text in the dialect of Spark or of DuckDB."""
    text = re.sub(r"\{unnest:(\w+)\}", (lambda m: f"h[{{pos}}]") if spark else r"unnest(\1)", text)
    text = re.sub(r"\{series:(\d+)\}", (lambda m: f"explode(sequence(0,{int(m[1]) - 1}))") if spark else r"cast(unnest(range(0,\1)) as int)", text)
    return text.replace("{letters4}", "explode(array('A','C','G','T'))" if spark else "unnest(['A','C','G','T'])")


#: Rows of a table that a task takes, where few bytes expand to much work.
SPREAD = 1 << 16


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table dealt over the cores, and into tasks of about SPREAD rows if there are more: few bytes that expand to much work."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SPREAD))
    return rows.repartition(parts, key) if rows.rdd.getNumPartitions() < parts else rows


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame; nothing is registered that outlives the call."""
    if name in TABLES:
        return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if name == "values_long":
        return frame(spark, sf_dir, "activations").selectExpr("row_key", "class_id", "posexplode(h) as (pos, v)")
    text = spelled(VIEWS[name], True)
    for used in NEEDS[name]:
        text = re.sub(rf"\b(from|join) {used}\b", rf"\1 {{{used}}}", text)
    frames = {used: frame(spark, sf_dir, used) for used in NEEDS[name]}
    if name == "sequences":
        frames["orders"] = spread(frames["orders"].select("o_orderkey", "o_custkey"), "o_orderkey")
    if name == "ref_chunks":
        frames["chrom_sizes"] = frames["chrom_sizes"].repartition(len(CHROMOSOMES), "chrom", "size")
    return spark.sql(text, **frames)


def ordered(names) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in out:
            for used in NEEDS[name]:
                add(used)
            out.append(name)

    for name in names:
        add(name)
    return out


def ctes(names, more: dict[str, str] | None = None) -> str:
    """`with` clause of the views and of further named texts, in DuckDB's dialect."""
    parts = [f"{n} as ({spelled(VIEWS[n], False)})" for n in ordered(names)]
    parts += [f"{n} as ({text})" for n, text in (more or {}).items()]
    return "with " + ",\n".join(parts) + "\n"
