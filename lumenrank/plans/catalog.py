"""The registered queries of the relational, ranking, metric and curation operators, each with its DuckDB form.

Roles on the driver's tables: documents with labels are the ranked, labelled items (score: n_chars);
events and lineitem are long predictions; documents and benchmark are an evaluation and a training set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.functions import constants as K
from lumenrank.functions import scalar, sequence
from lumenrank.operators import aggregates, curation, governance, metrics, ml, ranking, relational, stats
from lumenrank.operators.backends import HashBackend
from lumenrank.plans import proteome
from lumenrank.sources.scratch import stored
from lumenrank.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, score (double), label of the labelled documents."""
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("score"))
    return d.join(t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


LABELLED = "labelled AS (SELECT d.doc_id, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS score, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"
HASH = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"


# --- sources and projections -------------------------------------------------------------------

PROTEINS = "upper(replace(p_name, ' ', ''))"
KMERS = f"""
p AS (SELECT CAST(p_partkey AS VARCHAR) AS protein_id, {PROTEINS} AS seq FROM part),
l AS (SELECT * FROM (VALUES (8), (9), (10), (11)) AS v(length)),
k AS (SELECT protein_id, length, unnest(range(1, length(seq) - length + 2)) AS start, seq FROM p, l WHERE length(seq) >= length),
kmers AS (SELECT protein_id, substr(seq, start, length) AS peptide, length, start, start + length - 1 AS "end" FROM k)"""


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("protein_id"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("seq"))


@query(f"WITH {KMERS} SELECT protein_id, peptide, CAST(length AS BIGINT) AS length, CAST(start AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS \"end\" FROM kmers WHERE NOT regexp_matches(peptide, '[^ACDEFGHIKLMNPQRSTVWY]')")
def kmer_explode(spark, sf_dir):
    out = proteome.peptides(proteins(spark, sf_dir))
    return out.select("protein_id", "peptide", *[F.col(c).cast("long").alias(c) for c in ("length", "start", "end")])


@query(f"WITH {KMERS} SELECT CAST(length AS BIGINT) AS length, count(*) AS n_rows, count(DISTINCT peptide) AS n_distinct FROM kmers GROUP BY length")
def kmer_distinct_count(spark, sf_dir):
    k = sequence.kmers(proteins(spark, sf_dir))
    return k.groupBy(F.col("length").cast("long").alias("length")).agg(F.count("*").alias("n_rows"), F.countDistinct("peptide").alias("n_distinct"))


@query("""SELECT p_partkey, p_name, coalesce(length(trim(p_name)) BETWEEN 8 AND 11 AND NOT regexp_matches(upper(trim(p_name)), '[^ACDEFGHIKLMNPQRSTVWY]'), false) AS valid,
  coalesce(NOT regexp_matches(p_brand, '^(HLA-DR|HLA-DP|HLA-DQ)'), false) AS class_one, NOT regexp_matches(p_type, '[^A-Z ]') AS standard FROM part""")
def validity_filter(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", "p_name", sequence.valid_peptide(F.col("p_name")).alias("valid"), sequence.class_one(F.col("p_brand")).alias("class_one"), (~F.col("p_type").rlike("[^A-Z ]")).alias("standard"))


@query("""SELECT event_id, event_type, value, CAST(event_type = 'purchase' AS INT) AS label FROM events
  WHERE event_type = 'purchase' OR (event_type <> 'purchase' AND try_cast(CAST(value AS VARCHAR) AS DOUBLE) <= 250.0)""")
def mining_filter(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "event_type", "value", (F.col("event_type") == "purchase").cast("int").alias("label"), F.col("value").cast("string").alias("affinity"))
    return curation.mine_negatives(e, most=250.0).drop("affinity")


@query("""SELECT p_partkey, try_cast(p_name AS DOUBLE) AS name_number, try_cast(split_part(p_brand, '#', 2) AS DOUBLE) AS brand_number FROM part""")
def safe_cast(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.expr("try_cast(p_name AS DOUBLE)").alias("name_number"), F.expr("try_cast(split_part(p_brand, '#', 2) AS DOUBLE)").alias("brand_number"))


def _urgent(spark, sf_dir):
    return t(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def holdout_split_train(spark, sf_dir):
    return relational.holdout_split(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), _urgent(spark, sf_dir), "o_custkey")[0]


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def holdout_split_held(spark, sf_dir):
    return relational.holdout_split(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), _urgent(spark, sf_dir), "o_custkey")[1]


@query("SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL AND lang IS NOT NULL")
def null_drop_intersection(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return d.na.drop(subset=["quality", "toxic", "lang"]).select("doc_id", "lang", "quality", "toxic")


EVENT_TYPES = ("view", "click", "purchase", "signup", "error")
_WIDE = "SELECT user_id, " + ", ".join(f"max(CASE WHEN event_type = '{e}' THEN value END) AS {e}" for e in EVENT_TYPES) + " FROM events GROUP BY user_id"


def _wide(spark, sf_dir):
    return aggregates.pivot_values(t(spark, sf_dir, "events"), ["user_id"], "event_type", "value", {e: e for e in EVENT_TYPES})


@query(_WIDE)
def pivot_first(spark, sf_dir):
    return _wide(spark, sf_dir)


@query(f"WITH w AS ({_WIDE}) SELECT user_id, " + ", ".join(f"coalesce({e}, 0.0) AS {e}" for e in EVENT_TYPES) + " FROM w")
def pivot_with_default(spark, sf_dir):
    return aggregates.pivot_values(t(spark, sf_dir, "events"), ["user_id"], "event_type", "value", {e: e for e in EVENT_TYPES}, 0.0)


@query(f"WITH w AS ({_WIDE}), g AS (SELECT *, greatest({', '.join(EVENT_TYPES)}) AS best FROM w) SELECT user_id, best, CASE {' '.join(f'WHEN {e} = best THEN {chr(39)}{e}{chr(39)}' for e in EVENT_TYPES)} END AS best_type FROM g")
def rowwise_max_argmax(spark, sf_dir):
    return _wide(spark, sf_dir).select("user_id", scalar.row_max(EVENT_TYPES).alias("best"), scalar.row_arg_max(EVENT_TYPES).alias("best_type"))


_SIZES = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3}


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 ELSE 0 END AS urgency FROM orders")
def map_lookup_default(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(sequence.lookup(_SIZES)[F.col("o_orderpriority")], F.lit(0)).alias("urgency"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS status FROM orders")
def strict_map_lookup(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", scalar.strict_lookup(F.col("o_orderstatus"), {"F": "finished", "O": "open", "P": "partial"}, "status").alias("status"))


@query("SELECT doc_id, CASE WHEN n_chars >= 2000 THEN 1 ELSE 0 END AS is_long, CASE WHEN n_chars BETWEEN 1000 AND 1999 THEN 'usual' ELSE 'other' END AS stratum FROM documents")
def bucket_flag(spark, sf_dir):
    n = F.col("n_chars")
    return t(spark, sf_dir, "documents").select("doc_id", F.when(n >= 2000, 1).otherwise(0).alias("is_long"), F.when(n.between(1000, 1999), "usual").otherwise("other").alias("stratum"))


# --- joins -------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, o_orderstatus, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def inner_join_enrich(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_custkey")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").join(o, "l_orderkey")


@query("""SELECT c_custkey, c_mktsegment, coalesce(n_orders, 0) AS n_orders, coalesce(spent, 0.0) AS spent, n_name FROM customer
  LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey""")
def left_join_chain(spark, sf_dir):
    o = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("spent"))
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = relational.left_with_defaults(t(spark, sf_dir, "customer"), o, ["c_custkey"], {"n_orders": 0, "spent": 0.0})
    return c.join(n, "c_nationkey", "left").select("c_custkey", "c_mktsegment", "n_orders", "spent", "n_name")


@query("SELECT d.doc_id, d.lang, d.source, l.lang AS lang_dup, l.n FROM documents d LEFT JOIN (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) l ON d.source = l.source AND l.lang = 'en'")
def left_join_suffix(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    g = d.groupBy("lang", "source").agg(F.count("*").alias("n")).filter("lang = 'en'")
    return relational.left_suffixed(d, g, ["source"]).select("doc_id", "lang", "source", "lang_dup", "n")


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text) OR contains(b.text, d.text))")
def containment_semi_join(spark, sf_dir):
    return relational.contained_in_any(t(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "text", t(spark, sf_dir, "benchmark"), "text", key="doc_id").select("doc_id", "lang")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def containment_pairs(spark, sf_dir):
    d, b = t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    return d.select("doc_id", "text").join(b, F.col("text").contains(F.col("needle"))).select("doc_id", "item_id")


@query("SELECT b.item_id, min(d.doc_id) AS doc_id FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def first_containing_parent(spark, sf_dir):
    b = t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    return relational.first_parent(b, "item_id", "needle", t(spark, sf_dir, "documents"), "doc_id", "text", F.col("doc_id")).select("item_id", "doc_id")


@query("SELECT p_partkey, concat(repeat('G', CAST(floor((31 - length(p)) / 2) AS INT)), p, repeat('G', CAST(31 - length(p) - floor((31 - length(p)) / 2) AS INT))) AS context FROM (SELECT p_partkey, replace(p_brand, '#', '') AS p FROM part)")
def synthetic_parent(spark, sf_dir):
    p = F.replace("p_brand", F.lit("#"), F.lit(""))
    return t(spark, sf_dir, "part").select("p_partkey", relational.synthetic_context(p).alias("context"))


@query("SELECT n_name, event_type FROM nation, (SELECT DISTINCT event_type FROM events)")
def cross_join_pairs(spark, sf_dir):
    return relational.cross_pairs(t(spark, sf_dir, "nation").select("n_name"), t(spark, sf_dir, "events").select("event_type").distinct())


@query("""WITH g AS (SELECT l_returnflag, l_linestatus, avg(l_discount) AS rate, avg(l_extendedprice) AS price FROM lineitem GROUP BY ALL)
  SELECT l_returnflag, l_linestatus, round(rate - max(CASE WHEN l_linestatus = 'F' THEN rate END) OVER w, 8) AS delta_rate, round(price - max(CASE WHEN l_linestatus = 'F' THEN price END) OVER w, 4) AS delta_price,
         CASE WHEN max(CASE WHEN l_linestatus = 'F' THEN rate END) OVER w > 0.05 THEN round(rate / max(CASE WHEN l_linestatus = 'F' THEN rate END) OVER w, 8) END AS ratio
  FROM g WINDOW w AS (PARTITION BY l_returnflag)""")
def baseline_delta(spark, sf_dir):
    g = t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("rate"), F.avg("l_extendedprice").alias("price"))
    d = relational.baseline_delta(g, ["l_returnflag"], F.col("l_linestatus") == "F", ["rate", "price"])
    ratio = scalar.guarded_ratio(F.col("rate"), F.col("rate") - F.col("delta_rate"))
    return d.select("l_returnflag", "l_linestatus", F.round("delta_rate", 8).alias("delta_rate"), F.round("delta_price", 4).alias("delta_price"), F.round(ratio, 8).alias("ratio"))


# --- aggregations ------------------------------------------------------------------------------


@query("SELECT user_id, max(value) AS value_max, avg(value) AS value_mean FROM events GROUP BY user_id")
def group_max_mean_collapse(spark, sf_dir):
    return aggregates.collapse_max_mean(t(spark, sf_dir, "events"), ["user_id"], "value")


_VOTES = "v AS (SELECT user_id, CAST(value >= 250 AS INT) AS label FROM events)"


def _votes(spark, sf_dir):
    return t(spark, sf_dir, "events").select("user_id", (F.col("value") >= 250).cast("int").alias("label"))


@query(f"WITH {_VOTES} SELECT user_id, CASE WHEN avg(label) >= 0.5 THEN 1 ELSE 0 END AS label, count(label) AS n_votes FROM v GROUP BY user_id")
def majority_vote(spark, sf_dir):
    return aggregates.majority_vote(_votes(spark, sf_dir), ["user_id"], "label")


@query(f"WITH {_VOTES} SELECT user_id, CASE WHEN avg(label) >= 0.5 THEN 1 ELSE 0 END AS label, count(label) AS n_votes FROM v GROUP BY user_id HAVING avg(label) <> 0.5")
def consensus_drop_ties(spark, sf_dir):
    return aggregates.majority_vote(_votes(spark, sf_dir), ["user_id"], "label", tie="drop")


@query("SELECT user_id, arg_min(CASE WHEN value > 100 THEN value END, event_id) FILTER (value > 100) AS first_large, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id")
def first_non_null_by_order(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 100, F.col("value")).alias("first_large"), F.col("event_type").alias("first_type"))
    return aggregates.first_non_null(e, ["user_id"], ["first_large", "first_type"], "event_id")


@query("""WITH s AS (SELECT l_partkey, list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))) AS s FROM lineitem GROUP BY l_partkey)
  SELECT l_partkey, s[1] AS first_value, array_to_string(s, '|') AS all_values, CAST(len(s) AS BIGINT) AS n_values FROM s""")
def sorted_set_concat(spark, sf_dir):
    return aggregates.sorted_set(t(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def provenance_counts(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy("lang", "source")


@query("SELECT l_partkey, l_suppkey, count(DISTINCT l_returnflag) AS n_labels, count(*) AS n_rows FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(DISTINCT l_returnflag) > 1")
def label_conflicts(spark, sf_dir):
    return aggregates.conflicts(t(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag")


@query("SELECT text, count(*) AS n_rows FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_rows(spark, sf_dir):
    return aggregates.duplicates(t(spark, sf_dir, "documents"), ["text"])


@query("""SELECT count(*) AS n_rows, count(*) FILTER (quality = 1) AS n_positive, count(*) FILTER (quality = 0) AS n_negative, count(*) FILTER (quality IS NULL) AS n_unlabelled,
  count(DISTINCT text) AS n_distinct, min(length(text)) AS min_length, max(length(text)) AS max_length, avg(length(text)) AS mean_length FROM documents LEFT JOIN labels USING (doc_id)""")
def dataset_audit(spark, sf_dir):
    return curation.audit(t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left"), "text", "quality")


@query(f"""WITH {LABELLED}, q AS (SELECT quantile_cont(score, 0.75) AS cut FROM labelled), p AS (SELECT *, CAST(score >= cut AS INT) AS predicted FROM labelled, q)
  SELECT lang, count(*) AS total, count(*) FILTER (predicted = 1 AND label = 0) AS fp, count(*) FILTER (predicted = 0 AND label = 1) AS fn,
         round(count(*) FILTER (predicted = 1 AND label = 0) / count(*), 4) AS fp_rate, round(count(*) FILTER (predicted = 0 AND label = 1) / count(*), 4) AS fn_rate FROM p GROUP BY lang""")
def error_taxonomy(spark, sf_dir):
    d = labelled(spark, sf_dir)
    cut = d.agg(F.percentile("score", F.lit(0.75)).alias("cut"))
    return aggregates.error_taxonomy(d.crossJoin(F.broadcast(cut)).withColumn("predicted", (F.col("score") >= F.col("cut")).cast("int")), ["lang"], "label", "predicted")


_FOLDS = f"folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY {HASH.format('concat_ws(chr(124), 42, doc_id)')}, doc_id) - 1) % 5 AS INT) AS fold FROM labelled)"


@query(f"WITH {LABELLED}, {_FOLDS} SELECT doc_id, label, fold FROM folds")
def stratified_folds(spark, sf_dir):
    return ml.stratified_folds(labelled(spark, sf_dir), "doc_id", ["label"]).select("doc_id", "label", "fold")


@query(f"""WITH {LABELLED}, {_FOLDS}, f AS (SELECT lang, fold, avg(label) AS rate, avg(score) AS size FROM folds GROUP BY ALL)
  SELECT lang, count(*) AS n_folds, round(avg(rate), 8) AS rate_mean, round(stddev_pop(rate), 8) AS rate_std_pop, round(stddev_samp(rate), 8) AS rate_std,
         round(avg(size), 6) AS size_mean, round(stddev_pop(size), 6) AS size_std_pop, round(stddev_samp(size), 6) AS size_std FROM f GROUP BY lang""")
def fold_mean_std(spark, sf_dir):
    f = ml.stratified_folds(labelled(spark, sf_dir), "doc_id", ["label"]).groupBy("lang", "fold").agg(F.avg("label").alias("rate"), F.avg("score").alias("size"))
    s = aggregates.fold_summary(f, ["lang"], ["rate", "size"])
    return s.select("lang", "n_folds", *[F.round(c, 8 if c[0] == "r" else 6).alias(c) for c in s.columns[2:]])


@query("""WITH g AS (SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean FROM orders GROUP BY o_orderstatus)
  SELECT o_orderstatus, n, round(total, 2) AS total, round(mean, 6) AS mean FROM g UNION ALL SELECT 'ALL', CAST(sum(n) AS BIGINT), round(sum(total), 2), round(avg(mean), 6) FROM g""")
def combined_rollup_rows(spark, sf_dir):
    return aggregates.with_total(t(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice").select("o_orderstatus", "n", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"))


@query(f"WITH {LABELLED} SELECT round(0.5 * avg(label) FILTER (lang = 'en') + 0.5 * avg(label) FILTER (lang = 'fr'), 8) AS weighted FROM labelled")
def weighted_group_avg(spark, sf_dir):
    at = lambda v: F.avg(F.when(F.col("lang") == v, F.col("label")))
    return labelled(spark, sf_dir).agg(F.round(0.5 * at("en") + 0.5 * at("fr"), 8).alias("weighted"))


@query("""WITH j AS (SELECT quality, toxic, lang FROM documents LEFT JOIN labels USING (doc_id)),
  u AS (SELECT 'quality' AS tool, count(quality) AS present, count(*) AS n FROM j UNION ALL SELECT 'toxic', count(toxic), count(*) FROM j UNION ALL SELECT 'lang', count(lang), count(*) FROM j)
  SELECT tool, present, n - present AS missing, present * 100.0 / n AS coverage_pct FROM u""")
def coverage_unpivot(spark, sf_dir):
    j = t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return aggregates.coverage(j, ["quality", "toxic", "lang"])


@query("""WITH d AS (SELECT doc_id, lang, coalesce(n_chars >= 1000, false) AS usual FROM documents), n AS (SELECT count(*) AS n, count(DISTINCT lang) AS g, avg(CAST(usual AS INT)) AS f FROM d),
  w AS (SELECT doc_id, (0.5 + 0.5 / g / greatest(count(*) OVER (PARTITION BY lang) / n, 1e-6)) * (0.5 + 0.5 * 0.5 / CASE WHEN usual THEN f ELSE 1 - f END) AS w FROM d, n)
  SELECT doc_id, round(w / avg(w) OVER (), 8) AS weight FROM w""")
def sample_weights(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return aggregates.sample_weights(d, "lang", F.col("n_chars") >= 1000).select("doc_id", F.round("weight", 8).alias("weight"))


@query(f"WITH {LABELLED} SELECT count(*) FILTER (label = 0) / count(*) FILTER (label = 1) AS pos_weight FROM labelled")
def class_weight(spark, sf_dir):
    return ml.positive_weight(labelled(spark, sf_dir), "label")


@query("SELECT DISTINCT p_brand FROM part")
def distinct_values(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_brand").distinct()


@query("SELECT lang, median(n_chars) AS median, quantile_cont(n_chars, 0.75) AS q75, quantile_cont(n_chars, 0.9) AS q90 FROM documents GROUP BY lang")
def quantiles(spark, sf_dir):
    q = F.percentile("n_chars", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    return t(spark, sf_dir, "documents").groupBy("lang").agg(q.alias("q")).select("lang", F.col("q")[0].alias("median"), F.col("q")[1].alias("q75"), F.col("q")[2].alias("q90"))


# --- ranks -------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def rank_contiguous(spark, sf_dir):
    return ranking.rank_contiguous(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("""WITH r AS (SELECT event_id, rank() OVER (ORDER BY round(value) DESC) AS rank_min, count(*) OVER (PARTITION BY round(value)) AS n FROM events)
  SELECT event_id, rank_min, rank_min + (n - 1) / 2.0 AS rank_average, CAST(floor(rank_min + (n - 1) / 2.0) AS BIGINT) AS rank_average_floor FROM r""")
def rank_flavours(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.round("value").alias("v"))
    return ranking.rank_ties(e, "v").select("event_id", "rank_min", "rank_average", "rank_average_floor")


@query("SELECT o_orderkey, round(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) * 100.0 / count(*) OVER (), 6) AS rank_pct FROM orders")
def rank_percent(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranking.rank_percent(ranking.rank_contiguous(o, "o_totalprice", "o_orderkey"), "rank", o.count()).select("o_orderkey", F.round("rank_pct", 6).alias("rank_pct"))


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1")
def best_per_key(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")  # noqa: E741
    return relational.best_per_key(l, ["l_partkey"], F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"))


@query("""WITH r AS (SELECT o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER () AS n FROM orders),
  h AS (SELECT * FROM r WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')), g AS (SELECT count(DISTINCT c_custkey) AS gs_total FROM customer WHERE c_mktsegment = 'BUILDING')
  SELECT max(gs_total) AS gs_total, count(*) AS gs_found, count(*) FILTER (rank <= n * 0.1) AS gs_in_top_10pct, count(*) FILTER (rank <= n * 0.25) AS gs_in_top_25pct,
    count(*) FILTER (rank <= n * 0.1) / max(gs_total) AS gs_recovery_top10, count(*) FILTER (rank <= n * 0.25) / max(gs_total) AS gs_recovery_top25,
    round(avg(rank * 100.0 / n), 6) AS mean_rank_pct, round(median(rank * 100.0 / n), 6) AS median_rank_pct FROM h, g""")
def gold_recovery(spark, sf_dir):
    r = ranking.rank_contiguous(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", "o_orderkey")
    gold = t(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    out = ranking.recovery(r, gold, "o_custkey")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_rank_pct", "median_rank_pct")})


def _push(scope: str) -> str:
    src = "neg" if scope == "subset" else "l"
    return f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag = 'R' AS neg FROM lineitem), neg AS (SELECT * FROM l WHERE neg),
  r AS (SELECT *, rank() OVER (ORDER BY l_quantity DESC) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS model_rank, rank() OVER (ORDER BY l_discount DESC) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS binding_rank FROM {src})
  SELECT l_orderkey * 10 + l_linenumber AS k, model_rank, binding_rank, model_rank > binding_rank AS pushed_down FROM r WHERE neg"""


def _push_down(spark, sf_dir, scope):
    l = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_quantity", "l_discount", "l_returnflag")  # noqa: E741
    return ranking.push_down(l, "k", "l_quantity", "l_discount", F.col("l_returnflag") == "R", scope)


@query(_push("population"))
def push_down_population(spark, sf_dir):
    return _push_down(spark, sf_dir, "population")


@query(_push("subset"))
def push_down_subset(spark, sf_dir):
    return _push_down(spark, sf_dir, "subset")


@query("SELECT p_brand, p_partkey, CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / 25) AS INT) AS batch FROM part")
def batch_assign(spark, sf_dir):
    return relational.batches(t(spark, sf_dir, "part").select("p_brand", "p_partkey"), 25, F.asc("p_partkey"), group=["p_brand"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def topk(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER w AS INT) AS rank_in_group FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) QUALIFY rank_in_group <= 3")
def topn_per_group(spark, sf_dir):
    return relational.top_per_group(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], 3, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("""WITH f AS (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50 AND l_discount = 0)
  SELECT o_orderstatus, o_orderkey, o_totalprice, o_orderkey IN (SELECT l_orderkey FROM f) AS is_forced FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= 50 OR is_forced""")
def topn_union_forced(spark, sf_dir):
    forced = t(spark, sf_dir, "lineitem").filter("l_quantity >= 50 AND l_discount = 0").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.top_or_forced(t(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), ["o_orderstatus"], 50, forced, "o_orderkey", F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT o_orderstatus, max(CASE WHEN rn = 50 THEN o_totalprice END) AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) GROUP BY o_orderstatus")
def nth_cutoff(spark, sf_dir):
    return relational.nth_value(t(spark, sf_dir, "orders"), ["o_orderstatus"], 50, "o_totalprice", F.desc("o_totalprice"), F.asc("o_orderkey"))


@query(f"SELECT p_partkey FROM part ORDER BY {HASH.format('concat_ws(chr(124), 42, p_partkey)')}, p_partkey LIMIT 100")
def seeded_sample(spark, sf_dir):
    return relational.hash_sample(t(spark, sf_dir, "part"), 100, "p_partkey").select("p_partkey")


@query("SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) AS p_partkey FROM part GROUP BY p_brand")
def arg_min_row(spark, sf_dir):
    return t(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("p_partkey"))


# --- sets --------------------------------------------------------------------------------------


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(t(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")).subtract(t(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT 'customer' AS kind, c_nationkey AS nationkey, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def union_tagged(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(t(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("balance")))


@query("""WITH u AS (SELECT s_nationkey AS nationkey, 0 AS source_order, max(s_acctbal) AS balance FROM supplier GROUP BY 1 UNION ALL SELECT c_nationkey, 1, max(c_acctbal) FROM customer GROUP BY 1)
  SELECT nationkey, source_order, balance FROM u QUALIFY row_number() OVER (PARTITION BY nationkey ORDER BY source_order) = 1""")
def union_distinct_first(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.max("s_acctbal").alias("balance"))
    c = t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.max("c_acctbal").alias("balance"))
    return relational.union_first([s, c], ["nationkey"])


# --- scalar functions and features -------------------------------------------------------------


@query("SELECT s_suppkey, regexp_replace(s_name, '[^a-zA-Z0-9_-]', '_', 'g') AS name FROM supplier")
def sanitise_names(spark, sf_dir):
    return t(spark, sf_dir, "supplier").select("s_suppkey", scalar.sanitise(F.col("s_name")).alias("name"))


_ALLELES = " UNION ALL ".join(f"SELECT '{a}' AS raw" for a in (*K.ALLELES, "A0201", "HLA-B0702", "A*02:01", "B*2705", "HLA-C*0401"))
_STANDARD = r"""regexp_replace(regexp_replace(CASE WHEN starts_with(raw, 'HLA-') THEN raw ELSE 'HLA-' || raw END, '^(HLA-[ABC])([0-9])', '\1*\2'), '^([^*]*\*)([0-9]{2})([0-9]{2})$', '\1\2:\3')"""


@query(f"""WITH a AS ({_ALLELES}), s AS (SELECT raw, {_STANDARD} AS standard FROM a)
  SELECT n_nationkey, raw, standard, 'bind_' || regexp_replace(replace(standard, 'HLA-', ''), '[^A-Za-z0-9]', '', 'g') AS "column", regexp_replace(standard, 'HLA-|[*:]', '', 'g') AS compact FROM s, nation""")
def allele_normalise(spark, sf_dir):
    raw = spark.createDataFrame([(a,) for a in (*K.ALLELES, "A0201", "HLA-B0702", "A*02:01", "B*2705", "HLA-C*0401")], "raw string")
    s = t(spark, sf_dir, "nation").select("n_nationkey").crossJoin(raw).withColumn("standard", scalar.standard_allele(F.col("raw")))
    return s.select("n_nationkey", "raw", "standard", scalar.allele_column(F.col("standard")).alias("column"), scalar.compact_allele(F.col("standard")).alias("compact"))


def _case(text: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({text}), '{p}') THEN '{m}'" for p, m in rules if m) + " END"


@query(f"SELECT doc_id, {_case('text', [('license', 'license'), ('reserved', 'rights'), ('the ', 'english'), ('der ', 'german')])} AS topic, {_case('source', [('src1', 'one'), ('src', 'other')])} AS family FROM documents")
def text_rules(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", scalar.first_match(F.col("text"), [("license", "license"), ("reserved", "rights"), ("the ", "english"), ("der ", "german")]).alias("topic"), scalar.first_match(F.col("source"), [("src1", "one"), ("src", "other")]).alias("family"))


_PEPTIDES = f"p AS (SELECT p_partkey, substr({PROTEINS}, 1, 8 + CAST(p_size % 4 AS INT)) AS peptide FROM part)"


def _peptides(spark, sf_dir):
    s = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    return t(spark, sf_dir, "part").select("p_partkey", F.substring(s, F.lit(1), 8 + (F.col("p_size") % 4).cast("int")).alias("peptide"))


@query(f"""WITH {_PEPTIDES}, n AS (SELECT p_partkey, length(peptide) AS n FROM p)
  SELECT p_partkey, CASE WHEN n > 3 THEN 3 END AS p4, CASE WHEN n > 4 THEN 4 END AS p5, CASE WHEN n > 5 THEN 5 END AS p6, CASE WHEN n - 3 > 5 THEN n - 3 END AS p7, CASE WHEN n - 3 > 5 THEN n - 2 END AS p8 FROM n""")
def contact_positions(spark, sf_dir):
    n = F.length("peptide")
    return _peptides(spark, sf_dir).select("p_partkey", *[sequence.contact_index(p, n).alias(p) for p in K.POSITIONS])


def _property_sql() -> str:
    at = {"p4": "4", "p5": "5", "p6": "6", "p7": "CASE WHEN n - 3 > 5 THEN n - 2 END", "p8": "CASE WHEN n - 3 > 5 THEN n - 1 END"}
    columns = []
    for s, table in K.SCALES.items():
        cases = " ".join(f"WHEN '{a}' THEN {float(v)}" for a, v in table.items())
        columns += [f"CAST(coalesce(CASE substr(peptide, {at[p]}, 1) {cases} ELSE 0.0 END, 0.0) AS DOUBLE) AS {p}_{s}" for p in K.POSITIONS]
    for p in K.POSITIONS:
        columns.append("CAST(CASE n " + " ".join(f"WHEN {n} THEN {v[p]}" for n, v in K.UPWARD.items()) + f" ELSE {K.UPWARD[9][p]} END AS DOUBLE) AS {p}_upward_prob")
    return f"WITH {_PEPTIDES}, n AS (SELECT *, length(peptide) AS n FROM p) SELECT p_partkey, peptide, {', '.join(columns)}, CAST(0.0 AS DOUBLE) AS binding_score, n AS peptide_length FROM n"


@query(_property_sql())
def property_features(spark, sf_dir):
    return sequence.features(_peptides(spark, sf_dir))


@query(f"WITH {_PEPTIDES} SELECT p_partkey, i AS src, i + 1 AS dst FROM (SELECT p_partkey, unnest(range(0, length(peptide) - 1)) AS i FROM p) UNION ALL SELECT p_partkey, i + 1, i FROM (SELECT p_partkey, unnest(range(0, length(peptide) - 1)) AS i FROM p)")
def chain_edges(spark, sf_dir):
    return sequence.chain_edges(_peptides(spark, sf_dir), "p_partkey")


@query("SELECT event_id, round(1 / (1 + exp(-(value - 250) / 100)), 10) AS sigmoid, round(ln((value / 500) / (1 - value / 500)), 10) AS logit, round(1 - value / 500 * 100 / 100, 10) AS inverted FROM events")
def numeric_functions(spark, sf_dir):
    v = F.col("value")
    return t(spark, sf_dir, "events").select("event_id", F.round(scalar.sigmoid((v - 250) / 100), 10).alias("sigmoid"), F.round(scalar.log_odds(v / 500), 10).alias("logit"), F.round(scalar.inverted_percent(v / 500 * 100), 10).alias("inverted"))


@query("SELECT n_nationkey, sha256(concat_ws('|', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR))) AS row_hash FROM nation")
def row_hashes(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")), 256).alias("row_hash"))


_PIECES = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS HUGEINT)) AS VARCHAR)" for i in range(4))


@query(f"""WITH r AS (SELECT sha256('{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}') AS h FROM orders)
  SELECT count(*) AS n_rows, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {_PIECES})) AS digest FROM r""")
def content_hash(spark, sf_dir):
    return governance.content_hash(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


# --- metrics -----------------------------------------------------------------------------------


def metrics_sql(source: str, by: str, with_tables: str) -> str:
    """Row-level windows over ``source`` (by, score, label, doc_id): the same definitions, computed another way."""
    p = f"PARTITION BY {by}"
    return f"""WITH {with_tables}, r AS (SELECT {by}, score, label,
    row_number() OVER ({p} ORDER BY score DESC, doc_id) AS rn, rank() OVER ({p} ORDER BY score) AS lo, count(*) OVER (PARTITION BY {by}, score) AS ties,
    sum(label) OVER ({p} ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp, count(*) OVER ({p} ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen,
    avg(label) OVER (PARTITION BY {by}, score) AS mean, count(*) OVER ({p}) AS n, sum(label) OVER ({p}) AS pos FROM {source}),
  k AS (SELECT *, greatest(1, floor(n * 10 / 100)) AS k10, greatest(1, floor(n * 25 / 100)) AS k25 FROM r),
  a AS (SELECT {by}, count(*) AS n, CAST(max(pos) AS BIGINT) AS n_positive, max(k10) AS k10, max(k25) AS k25,
    sum(CASE WHEN label = 1 THEN lo + (ties - 1) / 2.0 ELSE 0 END) AS ranks, sum(label * tp / seen) AS ap,
    sum(label) FILTER (rn <= k10) AS h10, sum(label) FILTER (rn <= k25) AS h25,
    sum(mean / log2(rn + 1)) FILTER (rn <= k10) AS d10, sum(mean / log2(rn + 1)) FILTER (rn <= k25) AS d25,
    sum(1 / log2(rn + 1)) FILTER (rn <= least(k10, pos)) AS i10, sum(1 / log2(rn + 1)) FILTER (rn <= least(k25, pos)) AS i25 FROM k GROUP BY {by})
  SELECT {by}, n, n_positive,
    round(CASE WHEN n_positive > 0 AND n > n_positive THEN (ranks - n_positive * (n_positive + 1) / 2.0) / (n_positive * (n - n_positive)) END, 8) AS auc_roc,
    round(CASE WHEN n_positive > 0 AND n > n_positive THEN ap / n_positive END, 8) AS auc_pr,
    round(h10 / k10, 8) AS issr_10, round(h25 / k25, 8) AS issr_25, round(h10 / k10, 8) AS precision_10, round(h25 / k25, 8) AS precision_25,
    round(h10 / greatest(1, n_positive), 8) AS recall_10, round(h25 / greatest(1, n_positive), 8) AS recall_25,
    round(CASE WHEN n_positive > 0 THEN d10 / i10 ELSE 0.0 END, 8) AS ndcg_10, round(CASE WHEN n_positive > 0 THEN d25 / i25 ELSE 0.0 END, 8) AS ndcg_25 FROM a"""


def _rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, k in df.dtypes if k == "double"})


@query(metrics_sql("(SELECT *, 'all' AS scope FROM labelled)", "scope", LABELLED))
def ranked_metrics_global(spark, sf_dir):
    return _rounded(metrics.ranked_metrics(labelled(spark, sf_dir).withColumn("scope", F.lit("all")), ["scope"], "score", "label", "doc_id"))


@query(metrics_sql("labelled", "lang", LABELLED))
def ranked_metrics_by_group(spark, sf_dir):
    return _rounded(metrics.ranked_metrics(labelled(spark, sf_dir), ["lang"], "score", "label", "doc_id"))


@query(metrics_sql("folds", "fold", f"{LABELLED}, {_FOLDS}"))
def ranked_metrics_by_fold(spark, sf_dir):
    return _rounded(metrics.ranked_metrics(ml.stratified_folds(labelled(spark, sf_dir), "doc_id", ["label"]), ["fold"], "score", "label", "doc_id"))


_SUB = "u AS (SELECT doc_id, score, label, 'overall' AS subgroup_key, 'all' AS subgroup_value FROM labelled UNION ALL SELECT doc_id, score, label, 'lang', coalesce(lang, 'missing') FROM labelled UNION ALL SELECT doc_id, score, label, 'source', coalesce(source, 'missing') FROM labelled)"


@query(f"SELECT * FROM ({metrics_sql('u', 'subgroup_key, subgroup_value', f'{LABELLED}, {_SUB}')}) WHERE n >= 15")
def subgroup_metrics(spark, sf_dir):
    return _rounded(metrics.subgroup_metrics(labelled(spark, sf_dir), [], ["lang", "source"], "score", "label", "doc_id"))


_TOOLS = "tl AS (SELECT doc_id, label, 'length' AS tool, score FROM labelled UNION ALL SELECT doc_id, label, 'inverse', 1e6 / (1 + score) FROM labelled)"


@query(metrics_sql("tl", "tool", f"{LABELLED}, {_TOOLS}"))
def tool_metrics(spark, sf_dir):
    d = labelled(spark, sf_dir).withColumns({"length": F.col("score"), "inverse": F.lit(1e6) / (1 + F.col("score"))})
    return _rounded(metrics.tool_metrics(d, ["length", "inverse"], "label", "doc_id"))


_UNIT = f"{LABELLED}, m AS (SELECT min(score) AS lo, max(score) AS hi FROM labelled), unit AS (SELECT doc_id, lang, label, (score - lo) / (hi - lo) AS p FROM labelled, m)"


def _unit(spark, sf_dir):
    d = labelled(spark, sf_dir)
    m = d.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return d.crossJoin(F.broadcast(m)).select("doc_id", "lang", "label", ((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("p"))


@query(f"WITH {_UNIT}, b AS (SELECT avg((p - label) ** 2) AS brier, avg(label) AS m FROM unit) SELECT round(brier, 10) AS brier, round(m * (1 - m), 10) AS brier_trivial, round(1 - brier / (m * (1 - m)), 10) AS brier_skill FROM b")
def brier_calibration(spark, sf_dir):
    return _rounded(metrics.brier(_unit(spark, sf_dir), "p", "label"), 10)


@query(f"WITH {_UNIT} SELECT CAST(greatest(0, ceil(p * 10) - 1) AS INT) AS bin, round(avg(p), 10) AS mean_predicted, round(avg(label), 10) AS observed, count(*) AS n FROM unit GROUP BY 1")
def reliability_bins(spark, sf_dir):
    return _rounded(metrics.reliability(_unit(spark, sf_dir), "p", "label"), 10)


@query(f"""WITH {LABELLED}, g AS (SELECT score AS threshold, count(*) AS c, sum(label) AS p FROM labelled GROUP BY 1),
  s AS (SELECT threshold, sum(p) OVER w AS tp, sum(c - p) OVER w AS fp, sum(p) OVER () AS pos, sum(c - p) OVER () AS neg FROM g WINDOW w AS (ORDER BY threshold DESC))
  SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / pos, 10) AS tpr, round(fp / neg, 10) AS fpr, round(tp / (tp + fp), 10) AS "precision", round(tp / pos, 10) AS recall FROM s""")
def curve_points(spark, sf_dir):
    return _rounded(metrics.curve_points(labelled(spark, sf_dir), "score", "label"), 10)


@query("""WITH e AS (SELECT value, min(value) OVER () AS lo, max(value) OVER () AS hi FROM events) SELECT CAST(least(49, floor((value - lo) * 50 / (hi - lo))) AS INT) AS bin, count(*) AS n FROM e GROUP BY 1""")
def histogram_bins(spark, sf_dir):
    return metrics.histogram(t(spark, sf_dir, "events"), "value", 50)


_NUM = ("l_quantity", "l_discount", "l_tax")
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]
_RANKED = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _NUM)


@query(f"WITH r AS (SELECT {_RANKED} FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS rho, count(*) AS n FROM r" for a, b in _PAIRS))
def spearman_matrix(spark, sf_dir):
    return _rounded(metrics.spearman(t(spark, sf_dir, "lineitem"), _PAIRS))


_GRID = ", ".join(f"{0.05 + 0.01 * i:.2f}" for i in range(91))
_THRESHOLDS = f"""WITH {LABELLED}, q AS (SELECT DISTINCT unnest(quantile_cont(score, [{_GRID}])) AS threshold FROM labelled),
  g AS (SELECT threshold, lang, sum(label) FILTER (score >= threshold) AS tp0, count(*) FILTER (score >= threshold) AS pp, sum(label) AS pos, count(*) AS n FROM labelled, q GROUP BY ALL),
  h AS (SELECT *, coalesce(tp0, 0) AS tp FROM g),
  f AS (SELECT *, CASE WHEN n >= 15 THEN CASE WHEN tp > 0 THEN 2.0 * tp / (pp + pos) ELSE 0.0 END END AS gf FROM h),
  s AS (SELECT threshold, sum(tp) AS tp, sum(pp) AS pp, sum(pos) AS pos, min(gf) AS gf FROM f GROUP BY threshold),
  c AS (SELECT threshold, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS overall_precision, tp / pos AS overall_recall, CASE WHEN tp > 0 THEN 2.0 * tp / (pp + pos) ELSE 0.0 END AS overall_f1, gf AS min_subgroup_f1 FROM s)
  SELECT threshold, round(overall_precision, 8) AS overall_precision, round(overall_recall, 8) AS overall_recall, round(overall_f1, 8) AS overall_f1, round(min_subgroup_f1, 8) AS min_subgroup_f1 FROM c"""


@query(_THRESHOLDS)
def threshold_candidates(spark, sf_dir):
    out = metrics.threshold_candidates(labelled(spark, sf_dir), "score", "label", "lang")
    return out.select("threshold", *[F.round(c, 8).alias(c) for c in out.columns[1:]])


@query(f"SELECT * FROM ({_THRESHOLDS}) ORDER BY min_subgroup_f1 DESC, overall_f1 DESC, overall_recall DESC, threshold LIMIT 1")
def threshold_search(spark, sf_dir):
    out = metrics.pick_threshold(metrics.threshold_candidates(labelled(spark, sf_dir), "score", "label", "lang"))
    return out.select("threshold", *[F.round(c, 8).alias(c) for c in out.columns[1:]])


# --- resampling, tests, rules ------------------------------------------------------------------

def _boot_sql(replicates: int) -> str:
    return f"""{LABELLED}, numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS slot, count(*) OVER () AS n FROM labelled),
  draws AS (SELECT b, slot, {HASH.format('concat_ws(chr(124), 42, b, slot)')} % n AS pick FROM numbered, (SELECT unnest(range(0, {replicates})) AS b)),
  rs AS (SELECT draws.b, draws.slot AS doc_id, a.score, a.label, a.lang FROM draws JOIN numbered a ON a.slot = draws.pick)"""


_ISSR = "SELECT b, avg(CASE WHEN rn <= k THEN label END) AS issr, avg(label) AS rate FROM (SELECT b, label, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id) AS rn, greatest(1, floor(count(*) OVER (PARTITION BY b) * 10 / 100)) AS k FROM rs) GROUP BY b"


def _boot(spark, sf_dir, replicates):
    return stats.resampled_top(labelled(spark, sf_dir), "doc_id", "score", "label", replicates).withColumnRenamed("share", "issr")


@query(f"""WITH {_boot_sql(2000)}, m AS ({_ISSR}), d AS (SELECT issr - rate AS d FROM m)
  SELECT count(*) AS n_boot, round(avg(d), 8) AS mean, round(quantile_cont(d, 0.025), 8) AS ci_low, round(quantile_cont(d, 0.975), 8) AS ci_high,
         least(1.0, 2 * least(avg(CAST(d <= 0 AS INT)), avg(CAST(d >= 0 AS INT)))) AS p_value FROM d""")
def bootstrap_diff_ci(spark, sf_dir):
    return _rounded(stats.interval(_boot(spark, sf_dir, 2000).withColumn("d", F.col("issr") - F.col("rate")), "d", every=True))


@query(f"""WITH {_boot_sql(5000)}, m AS ({_ISSR}), d AS (SELECT issr / rate AS d FROM m WHERE rate > 0)
  SELECT count(*) AS n_boot, round(avg(d), 8) AS mean, round(quantile_cont(d, 0.025), 8) AS ci_low, round(quantile_cont(d, 0.975), 8) AS ci_high FROM d""")
def bootstrap_ratio_ci(spark, sf_dir):
    m = _boot(spark, sf_dir, 5000).filter("rate > 0")
    return _rounded(stats.interval(m.withColumn("d", F.col("issr") / F.col("rate")), "d", every=True).drop("p_value"))


_P = f"p AS (SELECT event_type, user_id, CAST(({HASH.format('concat_ws(chr(124), event_type, user_id)')} + 1) / 4294967297.0 AS DOUBLE) AS p FROM (SELECT DISTINCT event_type, user_id FROM events))"


@query(f"""WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM p)
  SELECT event_type, user_id, round(p, 10) AS p, round(least(1.0, min(p * n / r) OVER (PARTITION BY event_type ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 10) AS p_value_fdr FROM r""")
def bh_fdr(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    e = e.withColumn("p", (scalar.hash_unit(F.col("event_type"), F.col("user_id")) + 1) / F.lit(4294967297.0))
    return _rounded(stats.benjamini_hochberg(e, "p", ["event_type"]), 10)


@query(f"""WITH {LABELLED}, {_FOLDS}, d AS (SELECT lang, fold, avg(CASE WHEN score >= 1500 THEN label END) - avg(label) AS d FROM folds GROUP BY ALL), g AS (SELECT lang, list(d) AS d, avg(d) AS m, count(*) AS c FROM d WHERE d IS NOT NULL GROUP BY lang),
  f AS (SELECT lang, m, c, d, unnest(range(0, CAST(2 ** c AS BIGINT))) AS bits FROM g), v AS (SELECT lang, m, list_sum(list_transform(d, lambda x, i: CASE WHEN (bits >> CAST(i - 1 AS BIGINT)) & 1 = 1 THEN -x ELSE x END)) / c AS v FROM f)
  SELECT lang, round(m, 8) AS mean_delta, CASE WHEN m <= 0 THEN 1.0 ELSE avg(CAST(v >= m - 1e-12 AS INT)) END AS p_value FROM v GROUP BY lang, m""")
def sign_flip(spark, sf_dir):
    f = ml.stratified_folds(labelled(spark, sf_dir), "doc_id", ["label"])
    d = f.groupBy("lang", "fold").agg((F.avg(F.when(F.col("score") >= 1500, F.col("label"))) - F.avg("label")).alias("d")).filter("d IS NOT NULL")
    return stats.sign_flip(d, "d", ["lang"]).withColumn("mean_delta", F.round("mean_delta", 8))


@query("""WITH e AS (SELECT DISTINCT upper(text) AS k FROM documents), b AS (SELECT DISTINCT upper(text) AS o FROM benchmark),
  x AS (SELECT k, k IN (SELECT o FROM b) AS exact, EXISTS (SELECT 1 FROM b WHERE contains(k, o) OR contains(o, k)) AS part FROM e)
  SELECT count(*) AS n_eval, count(*) FILTER (exact) AS n_exact, count(*) FILTER (part AND NOT exact) AS n_substring, round(count(*) FILTER (part) * 100.0 / count(*), 4) AS overlap_pct,
    CASE WHEN count(*) FILTER (part) * 100.0 / count(*) > 50 THEN 'contaminated' WHEN count(*) FILTER (part) * 100.0 / count(*) > 30 THEN 'contaminated_cap' ELSE 'acceptable' END AS status FROM x""")
def overlap_bands(spark, sf_dir):
    return stats.overlap(t(spark, sf_dir, "documents"), "text", t(spark, sf_dir, "benchmark"), "text")


_V = "v AS (SELECT p_partkey, (p_size - 25) / 50.0 AS a, (p_partkey % 7 - 3) / 10.0 AS i, p_partkey % 2 = 0 AS af, p_partkey % 3 = 0 AS xf, p_partkey % 5 = 0 AS ac, p_partkey % 11 = 0 AS xc, p_size * 1.0 AS o FROM part)"


@query(f"""WITH {_V}, d AS (SELECT *, o > 30 AS dirty, CASE WHEN a > 0 AND i > 0 AND (ac OR af) THEN 'Worse' WHEN a < 0 AND i < 0 AND af AND xf AND NOT o > 30 THEN 'Strongly Better' WHEN a < 0 AND i < 0 AND NOT o > 30 THEN 'Comparable'
  WHEN (a > 0 AND i < 0) OR (a < 0 AND i > 0) THEN 'Comparable' WHEN NOT ac AND NOT xc THEN 'Inconclusive' WHEN a > 0 AND i > 0 THEN 'Worse' WHEN a > 0 OR i > 0 THEN 'Comparable' ELSE 'Inconclusive' END AS v FROM v)
  SELECT p_partkey, CASE WHEN dirty AND v = 'Comparable' THEN 'Comparable – Contaminated' ELSE v END AS verdict FROM d""")
def verdict_case(spark, sf_dir):
    k = F.col("p_partkey")
    p = t(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") - 25) / 50.0).alias("a"), ((k % 7 - 3) / 10.0).alias("i"), (k % 2 == 0).alias("af"), (k % 3 == 0).alias("xf"), (k % 5 == 0).alias("ac"), (k % 11 == 0).alias("xc"), F.col("p_size").cast("double").alias("o"))
    return p.select("p_partkey", stats.verdict(*[F.col(c) for c in ("a", "i", "af", "xf", "ac", "xc", "o")]).alias("verdict"))


_SEGMENTS = ("BUILDING", "MACHINERY", "HOUSEHOLD")


@query("""WITH r AS (SELECT o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER () AS n FROM orders), s AS (SELECT c_mktsegment AS set_name, c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')),
  g AS (SELECT set_name, count(*) AS found, count(*) FILTER (rank <= n * 0.1) / count(*) AS top10, count(*) FILTER (rank <= n * 0.25) / count(*) AS top25 FROM r JOIN s ON c_custkey = o_custkey GROUP BY set_name)
  SELECT set_name, found, round(top10, 8) AS top10, round(top25, 8) AS top25, round(top10 - max(CASE WHEN set_name = 'BUILDING' THEN top10 END) OVER (), 8) AS delta_top10, round(top25 - max(CASE WHEN set_name = 'BUILDING' THEN top25 END) OVER (), 8) AS delta_top25 FROM g""")
def set_sensitivity(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    r = ranking.rank_contiguous(o, "o_totalprice", "o_orderkey").crossJoin(F.broadcast(o.agg(F.count("*").alias("n"))))
    s = t(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin(*_SEGMENTS)).select(F.col("c_mktsegment").alias("set_name"), F.col("c_custkey").alias("o_custkey"))
    share = lambda q: F.count_if(F.col("rank") <= F.col("n") * q) / F.count("*")
    g = r.join(s, "o_custkey").groupBy("set_name").agg(F.count("*").alias("found"), share(0.1).alias("top10"), share(0.25).alias("top25")).withColumn("_all", F.lit(1))
    return _rounded(relational.baseline_delta(g, ["_all"], F.col("set_name") == "BUILDING", ["top10", "top25"]).drop("_all"))


# --- curation and pipelines --------------------------------------------------------------------


@query("""SELECT count(*) AS n_rows, count(*) FILTER (regexp_matches(text, '[|%#]')) AS n_bad_alphabet, count(*) FILTER (quality = 1) AS n_positive, count(*) FILTER (quality = 0) AS n_negative,
  (SELECT count(*) FROM (SELECT 1 FROM documents JOIN labels USING (doc_id) GROUP BY text, quality HAVING count(*) > 1)) AS n_duplicates,
  (SELECT count(*) FROM (SELECT 1 FROM documents JOIN labels USING (doc_id) GROUP BY text HAVING count(DISTINCT quality) > 1)) AS n_conflicts,
  count(*) FILTER (quality = 1) / count(*) FILTER (quality = 0) AS class_ratio FROM documents JOIN labels USING (doc_id)""")
def qc_gate(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "text").join(t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return curation.violations(d, "text", "quality", "[|%#]")


_PROTEOME = f"""{KMERS}, k2 AS (SELECT DISTINCT peptide FROM kmers WHERE NOT regexp_matches(peptide, '[^ACDEFGHIKLMNPQRSTVWY]')), al AS (SELECT unnest({list(K.ALLELES)}) AS allele),
  long AS (SELECT peptide, allele, {HASH.format("concat_ws('|', peptide, allele)")} / 4294967296.0 AS s FROM k2, al),
  best AS (SELECT peptide, allele, s FROM long QUALIFY row_number() OVER (PARTITION BY peptide ORDER BY s DESC, allele) = 1),
  src AS (SELECT peptide, list_sort(list(DISTINCT protein_id)) AS ids FROM kmers GROUP BY peptide)"""


@query(f"WITH {_PROTEOME} SELECT b.peptide, b.allele, round(b.s, 10) AS presentation_score, ids[1] AS protein_id, CAST(len(ids) AS BIGINT) AS source_protein_count, row_number() OVER (ORDER BY b.s DESC, b.peptide) AS rank FROM best b JOIN src USING (peptide)")
def proteome_pipeline(spark, sf_dir):
    """Stages 1, 2 and 4 with the synthetic backend: windows, best allele and wide scores, source proteins, rank."""
    bound = proteome.binding(proteome.peptides(proteins(spark, sf_dir)), HashBackend())
    return proteome.ranked(bound, "presentation_score").select("peptide", "allele", F.round("presentation_score", 10).alias("presentation_score"), "protein_id", "source_protein_count", "rank")


#: Rows of a partition that models are fitted on: each holds the statistics of all nodes, so few are better.
_FIT_ROWS = 1 << 15


def _model_rows(spark, sf_dir):
    """Features, label and fold of the labelled documents. Fits read them many times, the texts once."""
    rest = lambda c: F.length("text") - F.length(c)
    spaces, symbols = rest(F.replace(F.col("text"), F.lit(" "), F.lit(""))), rest(F.regexp_replace("text", "[|%#*&$!]", ""))
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("double").alias("n"), spaces.cast("double").alias("spaces"), symbols.cast("double").alias("symbols"))
    d = d.select("doc_id", "lang", F.log1p("n").alias("size"), (F.col("spaces") / F.greatest(F.lit(1.0), "n")).alias("space_rate"), (F.col("symbols") / F.greatest(F.lit(1.0), "n")).alias("symbol_rate"))
    labels = t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = ml.stratified_folds(d.join(labels, "doc_id"), "doc_id", ["label"])
    parts = max(1, min(spark.sparkContext.defaultParallelism, labels.count() // _FIT_ROWS))
    return stored(rows.repartition(parts, "doc_id").sortWithinPartitions("doc_id"), "model_rows")


_INPUTS = ("size", "space_rate", "symbol_rate")


@query()
def rf_oof_score(spark, sf_dir):
    return ml.out_of_fold(_model_rows(spark, sf_dir), ml.forest(_INPUTS), "RandomForest").select("doc_id", "label", "fold", "score", "method")


@query()
def gbt_oof_score(spark, sf_dir):
    return ml.out_of_fold(_model_rows(spark, sf_dir), ml.boosted(_INPUTS), "GradientBoosting").select("doc_id", "label", "fold", "score", "method")


@query()
def feature_ablation(spark, sf_dir):
    groups = {"size": ("size",), "rates": ("space_rate", "symbol_rate"), "all": _INPUTS}
    out = ml.ablation(_model_rows(spark, sf_dir), groups, ml.forest)
    return metrics.ranked_metrics(out, ["method"], "score", "label", "doc_id")


@query()
def transfer_matrix(spark, sf_dir):
    """Every language's model on every other language, and the pooled out-of-fold scores as All on All.

    A language of one class neither trains nor is tested; rows without a language are in the pooled row only.
    """
    rows = _model_rows(spark, sf_dir)
    both = rows.filter("lang IS NOT NULL").groupBy("lang").agg(F.count_distinct("label").alias("n")).filter("n > 1")
    langs = sorted(r.lang for r in both.collect())
    out = ml.out_of_fold(rows, ml.forest(_INPUTS), "All").withColumns({"trained_on": F.lit("All"), "tested_on": F.lit("All")}).drop("method")
    if len(langs) > 1:
        out = ml.transfer(rows.filter(F.col("lang").isin(langs)), "lang", langs, lambda: ml.forest(_INPUTS)).unionByName(out)
    return metrics.ranked_metrics(out, ["trained_on", "tested_on"], "score", "label", "doc_id")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm, CAST(len(embedding) AS BIGINT) AS dims FROM embeddings")
def vector_norms(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    return t(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x)), 6).alias("norm"), F.size("embedding").cast("long").alias("dims"))


# --- event-time windows (an extension; the streaming forms are tested against these) ------------


@query("""SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_window(spark, sf_dir):
    return windows.tumbling(t(spark, sf_dir, "events"), "event_type", "1 hour").withColumn("total", F.round("total", 4))


@query("""WITH s AS (SELECT event_type, value, time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * i AS window_start FROM events, (VALUES (0), (1)) AS v(i))
  SELECT event_type, window_start, window_start + INTERVAL '1 hour' AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL""")
def sliding_window(spark, sf_dir):
    return windows.sliding(t(spark, sf_dir, "events"), "event_type", "1 hour", "30 minutes").withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS s FROM g)
  SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '2 hours' AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s""")
def session_window(spark, sf_dir):
    return windows.sessions(t(spark, sf_dir, "events"), "user_id", "2 hours").withColumn("total", F.round("total", 4))


import lumenrank.plans.exchange  # noqa: E402, F401  adds the queries of sources and sinks to this registry
import lumenrank.plans.reports  # noqa: E402, F401
