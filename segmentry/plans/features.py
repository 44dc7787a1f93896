"""Queries of the sequence functions: composition, repeats, motifs, words, strands."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixtures import ctes, frame
from ..functions import sequence as S
from ..operators import encoding as E
from ..operators import kmers as K
from ..operators import profiles as P
from ..operators import raw as R
from ..operators.ranges import stored
from ..schema import MOTIFS, OVERLAPPING, PAIRS, REPEATS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, body: str | None, views=("sequences",), steps=None):
    def add(fn):
        QUERIES[name] = fn
        if body is not None:
            SQL[name] = ctes(views, steps) + body
        return fn

    return add


def n(letters: str, s: str = "seq") -> str:
    return f"length(regexp_replace({s},'[^{letters}]','','g'))"


KNOWN, CG = n("ACGT"), "((length(seq)-length(replace(seq,'CG','')))//2)"


def entropy_sql(total: str) -> str:
    return "(0-(" + "+".join(f"case when {n(b)}>0 then {n(b)}/{total}*log2({n(b)}/{total}) else 0 end" for b in "ACGT") + "))"


def matched_sql(pattern: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all(seq,'{pattern}'), lambda x: length(x))),0)"


RUNS = "list_transform(regexp_extract_all(seq,'A+|C+|G+|T+'), lambda x: length(x))"
PAIRS_EXPECTED = f"greatest(({KNOWN}-1)*({n('C')}/{KNOWN})*({n('G')}/{KNOWN}),1e-8)"


@query("composition", f"""select seq_key, round({n('GC')}/length(seq),9) as gc, round({n('GC')}/{KNOWN},9) as gc_known,
  round(case when {n('C')}*{n('G')}=0 then 0 else {CG}/({n('C')}*{n('G')}/length(seq)) end,9) as cpg_ratio, round({CG}/{PAIRS_EXPECTED},6) as cpg_pairs,
  round({CG}/(length(seq)-1),9) as cpg_freq, round({entropy_sql('length(seq)')},9) as entropy, round({entropy_sql(KNOWN)},9) as entropy_known from sequences""")
def composition(spark, sf):
    s = F.col("seq")
    r = lambda c, d, name: F.round(c, d).alias(name)
    return frame(spark, sf, "sequences").select(
        "seq_key", r(S.gc_fraction(s), 9, "gc"), r(S.gc_of_known(s), 9, "gc_known"), r(S.cpg_ratio(s), 9, "cpg_ratio"), r(S.cpg_of_pairs(s), 6, "cpg_pairs"), r(S.cpg_frequency(s), 9, "cpg_freq"), r(S.entropy(s), 9, "entropy"), r(S.entropy_of_known(s), 9, "entropy_known")
    )


@query("runs", f"""select seq_key, greatest(1, list_max({RUNS})) as longest, round(coalesce(list_sum(list_filter({RUNS}, lambda x: x>=3)),0)/length(seq),9) as in_runs,
  {", ".join(f"(length(seq)-length(replace(seq,'{b * 4}','')))//4 as poly_{b.lower()}, coalesce(list_max(list_transform(regexp_extract_all(seq,'{b}+'), lambda x: length(x))),0) as longest_{b.lower()}" for b in "ACGT")} from sequences""")
def runs(spark, sf):
    s = F.col("seq")
    each = [c for b in "ACGT" for c in (S.homopolymers(s, b).alias(f"poly_{b.lower()}"), S.longest_run_of(s, b).alias(f"longest_{b.lower()}"))]
    return frame(spark, sf, "sequences").select("seq_key", S.longest_run(s).alias("longest"), F.round(S.repeats_in_runs(s), 9).alias("in_runs"), *each)


@query("repeat_densities", f"""select seq_key, round(least(({'+'.join(matched_sql(p) for p in REPEATS)})/length(seq),1),9) as by_patterns,
  round(least(({'+'.join(matched_sql(p) for p in [*(b + '{4,}' for b in 'ACGT'), *(f'(?:{p}){{4,}}' for p in PAIRS)])})/length(seq),1),9) as by_pairs from sequences""")
def repeat_densities(spark, sf):
    s = F.col("seq")
    return frame(spark, sf, "sequences").select("seq_key", F.round(S.repeats_by_patterns(s), 9).alias("by_patterns"), F.round(S.repeats_of_pairs(s), 9).alias("by_pairs"))


@query("engineered_vector", f"""select seq_key, case when {KNOWN}=0 then 0.5 else round({n('GC')}/{KNOWN},9) end as gc, case when {KNOWN}=0 then 1 else round({CG}/{PAIRS_EXPECTED},6) end as cpg,
  case when {KNOWN}=0 then 2 else round({entropy_sql(KNOWN)},9) end as entropy, cast(greatest(1,list_max({RUNS})) as double) as longest, round(coalesce(list_sum(list_filter({RUNS}, lambda x: x>=3)),0)/length(seq),9) as in_runs from sequences""")
def engineered_vector(spark, sf):
    v = frame(spark, sf, "sequences").select("seq_key", S.engineered(F.col("seq")).alias("v"))
    return v.select("seq_key", *(F.round(F.col("v")[i], d).alias(c) for i, (c, d) in enumerate((("gc", 9), ("cpg", 6), ("entropy", 9), ("longest", 9), ("in_runs", 9)))))


@query("gc_windows", f"select seq_key, i as window_id, round({n('GC', 'substr(seq,i*20+1,20)')}/20.0,9) as gc from (select *, cast(unnest(range(0,10)) as int) as i from sequences)")
def gc_windows(spark, sf):
    each = frame(spark, sf, "sequences").select("seq_key", F.posexplode(S.windows(F.col("seq"), 10)).alias("window_id", "w"))
    return each.select("seq_key", "window_id", F.round(S.gc_fraction(F.col("w")), 9).alias("gc"))


@query("motif_counts", f"select seq_key, {', '.join(f'''cast(len(regexp_extract_all(seq,'{p}')) as bigint) as {m.lower()}''' for m, p in MOTIFS.items())} from sequences")
def motif_counts(spark, sf):
    return frame(spark, sf, "sequences").select("seq_key", *(S.motif_count(F.col("seq"), m).alias(m.lower()) for m in MOTIFS))


WIDTHS = {"TATA_box": 7, "GC_box": 6, "AP1": 7, "ETS": 6, "CTCF_core": 12, "Inr": 7, "CpG_dense": 4, "KRAB_ZNF": 5}


@query("motif_rates", "select seq_key, " + ", ".join(f"round(len(list_filter(range(1,length(seq)-{WIDTHS[m]}+2), lambda i: regexp_full_match(substr(seq,i,{WIDTHS[m]}),'{MOTIFS[m]}')))/(length(seq)/200.0),9) as {m.lower()}" for m in OVERLAPPING) + " from sequences")
def motif_rates(spark, sf):
    return frame(spark, sf, "sequences").select("seq_key", *(F.round(S.motif_rate(F.col("seq"), m), 9).alias(m.lower()) for m in OVERLAPPING))


def kmer_sql(k: int, rows: str = "sequences", key: str = "seq_key", s: str = "seq") -> str:
    return f"""select {key}, kmer, count(*) as n, round(count(*)/sum(count(*)) over (partition by {key}),9) as freq from (
  select {key}, substr({s},i,{k}) as kmer from (select *, unnest(range(1,length({s})-{k}+2)) as i from {rows})) where not regexp_matches(kmer,'[^ACGT]') group by {key}, kmer"""


@query("kmer_frequencies", kmer_sql(5))
def kmer_frequencies(spark, sf):
    return K.frequencies(frame(spark, sf, "sequences"), ["seq_key"], "seq", 5).withColumn("freq", F.round("freq", 9))


@query("dinucleotides", kmer_sql(2))
def dinucleotides(spark, sf):
    return K.frequencies(frame(spark, sf, "sequences"), ["seq_key"], "seq", 2).withColumn("freq", F.round("freq", 9))


@query("positional_kmers", kmer_sql(4, "(select seq_key, cast(unnest(range(0,10)) as int) as slice, substr(seq,slice*20+1,20) as w from sequences)", "seq_key, slice", "w"))
def positional_kmers(spark, sf):
    return K.positional(frame(spark, sf, "sequences"), ["seq_key"], "seq", 4, 10).withColumn("freq", F.round("freq", 9))


@query("kmer_class_profile", f"select label, kmer, sum(n) as n, round(sum(n)/sum(sum(n)) over (partition by label),9) as freq from ({kmer_sql(3)}) k join sequences using(seq_key) group by label, kmer")
def kmer_class_profile(spark, sf):
    """Words are counted inside rows, then by class: tasks send 18 * 64 partial sums."""
    counts = K.totals(frame(spark, sf, "sequences"), ["label"], "seq", 3)
    return counts.withColumn("freq", F.round(F.col("n") / F.sum("n").over(W.partitionBy("label")), 9))


VOCAB = "select (a*4+b)*4+c as idx, substr('ACGT',cast(a+1 as int),1)||substr('ACGT',cast(b+1 as int),1)||substr('ACGT',cast(c+1 as int),1) as kmer from range(0,4) x(a), range(0,4) y(b), range(0,4) z(c)"


@query("kmer_vocabulary_use", f"select idx, v.kmer, count(k.seq_key) as rows_with from ({VOCAB}) v left join ({kmer_sql(3)}) k on k.kmer=v.kmer group by idx, v.kmer")
def kmer_vocabulary_use(spark, sf):
    words = F.array_distinct(S.kmers(F.col("seq"), 3))
    used = frame(spark, sf, "sequences").select(F.explode(words).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("rows_with"))
    return K.vocabulary(spark, 3).join(used, "kmer", "left").select("idx", "kmer", F.coalesce("rows_with", F.lit(0)).alias("rows_with"))


@query("valid_rows", "select count(*) as n_rows, count(*) filter (length(seq)>=5) as valid, count(*) filter (seq is null or length(seq)<5) as invalid, count(*) filter (regexp_matches(seq,'[^ACGT]')) as with_other from sequences")
def valid_rows(spark, sf):
    s = F.col("seq")
    return frame(spark, sf, "sequences").agg(F.count("*").alias("n_rows"), F.count_if(F.length(s) >= 5).alias("valid"), F.count_if(s.isNull() | (F.length(s) < 5)).alias("invalid"), F.count_if(s.rlike("[^ACGT]")).alias("with_other"))


@query("reverse_complements", "select seq_key, reverse(translate(seq,'ACGT','TGCA')) as rc, reverse(translate(lower(seq),'acgtn','tgcan')) as rc_lower from sequences")
def reverse_complements(spark, sf):
    s = F.col("seq")
    return frame(spark, sf, "sequences").select("seq_key", S.reverse_complement(s).alias("rc"), S.reverse_complement_any(F.lower(s)).alias("rc_lower"))


@query("one_hot_long", None)
def one_hot_long(spark, sf):
    """Every sequence as (pos, channel, v). Held against brute force in the tests; SQL compares its sums below."""
    return E.long_rows(frame(spark, sf, "sequences"), "seq_key", "seq", 210)


def one_hot_sums_sql(s: str, length: int) -> str:
    share = f"case when substr(w,i,1)=substr('ACGT',j+1,1) then 1.0 when substr(w,i,1) in ('A','C','G','T') then 0.0 else 0.25 end"
    return f"select seq_key, cast(j as int) as channel, sum(v) as total, sum(v*i) as placed from (select seq_key, i, j, {share} as v from (select seq_key, w, i, unnest(range(0,4)) as j from (select seq_key, w, unnest(range(1,{length}+1)) as i from (select seq_key, rpad(substr({s},1,{length}),{length},'N') as w from sequences)))) group by all"


@query("one_hot_channels", one_hot_sums_sql("seq", 210))
def one_hot_channels(spark, sf):
    """By row and channel the sum of shares and that of shares times places, inside the row."""
    return E.channel_sums(frame(spark, sf, "sequences"), "seq_key", "seq", 210)


@query("one_hot_reversed", one_hot_sums_sql("reverse(translate(seq,'ACGT','TGCA'))", 200))
def one_hot_reversed(spark, sf):
    """The encoding with rows and channels reversed is that of the reverse complement."""
    return E.channel_sums(frame(spark, sf, "sequences"), "seq_key", "seq", 200, reverse=True)


U = lambda *p: "cast('0x'||substr(md5(concat_ws('|'," + ",".join(p) + ")),1,8) as bigint)/4294967296.0"


@query("augmented", f"""select seq_key, case when {U("seq_key", "'strand'")}<0.5 then '-' else '+' end as strand, cast(150+floor({U("seq_key", "'crop'")}*51) as int) as valid_len,
  rpad(substr(case when {U("seq_key", "'strand'")}<0.5 then reverse(translate(seq,'ACGT','TGCA')) else seq end,1,cast(150+floor({U("seq_key", "'crop'")}*51) as int)),200,'N') as view_seq from sequences""")
def augmented(spark, sf):
    """A strand flip and a crop by seeded hashes; valid_len tells padding from masked letters."""
    s, flip = F.col("seq"), S.uniform(F.col("seq_key"), "strand") < 0.5
    size = (F.lit(150) + F.floor(S.uniform(F.col("seq_key"), "crop") * 51)).cast("int")
    view = F.rpad(F.substr(F.when(flip, S.reverse_complement(s)).otherwise(s), F.lit(1), size), 200, "N")
    return frame(spark, sf, "sequences").select("seq_key", F.when(flip, "-").otherwise("+").alias("strand"), size.alias("valid_len"), view.alias("view_seq"))


@query("state_families", "select state, case when state like 'Tss%' or state like 'ReprPC%' then 'promoter_polycomb' when state like 'Enh%' then 'enhancer' when state like 'Tx%' then 'transcribed' else 'other' end as coarse, count(*) as n from (select substr(state_name, strpos(state_name,'_')+1) as state from states join sequences on label=state_int) group by all", ("states", "sequences"))
def state_families(spark, sf):
    states = frame(spark, sf, "states").select(F.col("state_int").alias("label"), F.substring_index("state_name", "_", -1).alias("state"))
    joined = frame(spark, sf, "sequences").groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(states), "label")
    return joined.select("state", S.state_family(F.col("state")).alias("coarse"), "n")


def index_sql(k: int) -> str:
    return "(" + "+".join(f"(strpos('ACGT',substr(kmer,{i + 1},1))-1)*{4 ** (k - 1 - i)}" for i in range(k)) + ")"


GC_PARTS = "(select seq_key, cast(unnest(range(0,10)) as int) as i, seq from sequences)"
RUN_PARTS = " union all ".join(f"select seq_key, {i} as i, cast(coalesce(list_max(list_transform(regexp_extract_all(seq,'{b}+'), lambda x: length(x))),0) as double) as v from sequences" for i, b in enumerate("ACGT"))


@query("raw_vector_blocks", f"""select seq_key, block, count(*) filter (v<>0) as nonzero, round(sum(v),6) as total, round(sum(v*(i+1)),6) as placed from (
  select seq_key, 0 as block, {index_sql(5)} as i, n/sum(n) over (partition by seq_key) as v from ({kmer_sql(5)})
  union all select seq_key, 1, slice*256+{index_sql(4)}, n/sum(n) over (partition by seq_key, slice) from ({kmer_sql(4, "(select seq_key, cast(unnest(range(0,10)) as int) as slice, substr(seq,slice*20+1,20) as w from sequences)", "seq_key, slice", "w")})
  union all select seq_key, 2, i, {n('GC', 'substr(seq,i*20+1,20)')}/20.0 from {GC_PARTS}
  union all select seq_key, 3, {index_sql(2)}, n/sum(n) over (partition by seq_key) from ({kmer_sql(2)})
  union all select seq_key, 4, i, v from ({RUN_PARTS})) where v<>0 group by seq_key, block""")
def raw_vector_blocks(spark, sf):
    """Of each of the five blocks of the raw vector: entries, their sum, and their sum weighted by place."""
    each = R.block_sums(frame(spark, sf, "sequences"), "seq_key", "seq")
    return each.select("seq_key", "block", "nonzero", F.round("total", 6).alias("total"), F.round("placed", 6).alias("placed"))


@query("raw_vectors", None)
def raw_vectors(spark, sf):
    """(seq_key, x): the 3 614 numbers of the raw vector, sparse."""
    return frame(spark, sf, "sequences").select("seq_key", R.sparse(F.col("seq")).alias("x"))


@query("svd_projection", None)
def svd_projection(spark, sf):
    """Standardisation and truncated decomposition fitted on all rows; every row is projected."""
    rows = stored(R.blocks(frame(spark, sf, "sequences"), "seq"), "raw", large=True)
    return R.project(rows, R.fit(rows))


@query("word_entropy", f"select label, count(*) as n, round(avg(h),6) as entropy from (select label, seq_key, 0-sum(f*log2(f)) as h from (select seq_key, n/sum(n) over (partition by seq_key) as f from ({kmer_sql(3)})) k join sequences using(seq_key) group by all) group by label")
def word_entropy(spark, sf):
    """Mean entropy of the three-letter words of a row by label; each row's is made where the row is read."""
    each = K.entropies(frame(spark, sf, "sequences"), ["label"], "seq", 3)
    return each.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("h"), 6).alias("entropy"))


PATTERNS = "+".join(matched_sql(p) for p in REPEATS)
PAIR_SHARES = ", ".join(f"round(coalesce(max(n) filter (kmer='{p}')/sum(n),0),9) as dinuc_{p}" for p in P.PAIRS)


@query("full_profile", f"""select seq_key, round({n('GC')}/length(seq),9) as gc_content, round(1-{n('GC')}/length(seq),9) as at_content, round(case when {n('C')}*{n('G')}=0 then 0 else {CG}/({n('C')}*{n('G')}/length(seq)) end,9) as cpg_ratio,
  round(least(({PATTERNS})/length(seq),1),9) as repeat_density, {", ".join(f"coalesce(dinuc_{p},0) as dinuc_{p}" for p in P.PAIRS)}, coalesce(dinuc_CG,0) as cpg_freq,
  (length(seq)-length(replace(seq,'AAAA','')))//4 as poly_A, (length(seq)-length(replace(seq,'TTTT','')))//4 as poly_T, {"+".join(f"(length(seq)-length(replace(seq,'{b * 4}','')))//4" for b in "ACGT")} as total_homopolymers,
  {", ".join(f"cast(len(regexp_extract_all(seq,'{x}')) as bigint) as motif_{m}" for m, x in MOTIFS.items())}
from sequences left join (select seq_key, {PAIR_SHARES} from ({kmer_sql(2)}) group by seq_key) using(seq_key)""")
def full_profile(spark, sf):
    """Every feature of a sequence from one scan, without a join or a shuffle."""
    f = frame(spark, sf, "sequences").select("seq_key", P.full_profile(F.col("seq")).alias("f"))
    names = [c.name for c in f.schema["f"].dataType]
    shares = {"gc_content", "at_content", "cpg_ratio", "repeat_density", "cpg_freq"}
    return f.select("seq_key", *((F.round(F.col(f"f.{c}"), 9) if c in shares or c.startswith("dinuc_") else F.col(f"f.{c}").cast("long")).alias(c) for c in names))


@query("extended_label_profiles", f"""select label, n, round(max_run,6) as max_run, round(h3,6) as h3, {", ".join(f"round(motif_{m},6) as motif_{m}" for m in P.MEANS)} from (
  select label, count(*) as n, avg(greatest(1, coalesce(list_max({RUNS}),1))) as max_run, avg(coalesce(h,0)) as h3, {", ".join(f"avg(len(regexp_extract_all(seq,'{MOTIFS[m]}'))) as motif_{m}" for m in P.MEANS)}
  from sequences left join (select seq_key, 0-sum(n/t*log2(n/t)) as h from (select seq_key, n, sum(n) over (partition by seq_key) as t from ({kmer_sql(3)})) group by seq_key) using(seq_key) group by label)""")
def extended_label_profiles(spark, sf):
    """Rows and means of each label: longest run, entropy of three-letter words, motifs; of one scan with label_components."""
    names, labels, means, _ = P.label_profiles(frame(spark, sf, "sequences"))
    rows = [(int(c), *(int(v) if k == "n" else round(float(v), 6) for k, v in zip(names, row))) for c, row in zip(labels, means)]
    return spark.createDataFrame(rows, "label int, " + ", ".join(f"{k} {'long' if k == 'n' else 'double'}" for k in names))


@query("label_components", None)
def label_components(spark, sf):
    """Mean place of each label's rows on the leading components of three-letter words."""
    _, labels, _, places = P.label_profiles(frame(spark, sf, "sequences"))
    rows = [(int(c), k + 1, float(v)) for c, row in zip(labels, places) for k, v in enumerate(row)]
    return spark.createDataFrame(rows, "label int, component int, value double")
