"""Registered queries of sources, sinks and small functions: each writes a driver table in a format and reads it back.

A result equals the table itself, so a reader or writer that loses, adds or changes a value shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.functions import constants as K
from lumenrank.functions import scalar, sequence
from lumenrank.operators import curation, ml, stats
from lumenrank.plans.catalog import LABELLED, labelled, query, t
from lumenrank.sources import readers, writers
from lumenrank.sources.scratch import scratch_folder


def _as_one_file(spark: SparkSession, lines: DataFrame, head: list[str], name: str) -> str:
    """A text file of some head lines and the column ``line`` in order; for dimension tables."""
    body = lines.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("b"))
    path = scratch_folder(spark, name)
    body.select(F.concat_ws("\n", *map(F.lit, head), "b")).write.text(path)
    return path


@query("SELECT 'sp|P' || p_partkey || '|N' || p_partkey AS protein_id, 'N' || p_partkey AS name, 'sp|P' || p_partkey || '|N' || p_partkey || ' ' || p_name AS header, upper(replace(p_name, ' ', '')) AS seq FROM part")
def fasta_round_trip(spark, sf_dir):
    """Sequences on two lines each."""
    k, seq = F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit(""))
    text = F.concat(F.lit(">sp|P"), k, F.lit("|N"), k, F.lit(" "), "p_name", F.lit("\n"), F.substring(seq, 1, 5), F.lit("\n"), F.expr("substring(replace(p_name, ' ', ''), 6)"))
    path = scratch_folder(spark, "fasta")
    t(spark, sf_dir, "part").select(text).write.text(path)
    return readers.fasta(spark, path)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    d, path = t(spark, sf_dir, "customer"), scratch_folder(spark, "csv")
    writers.delimited(d, path)
    return readers.table(spark, path, schema=d.schema)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def csv_subset_round_trip(spark, sf_dir):
    path = scratch_folder(spark, "csv-subset")
    writers.delimited(t(spark, sf_dir, "orders"), path, columns=["o_orderkey", "o_totalprice"])
    return readers.table(spark, path, schema="o_orderkey long, o_totalprice double")


@query("SELECT n_name, n_nationkey, n_regionkey FROM nation WHERE n_regionkey <> 0")
def tsv_comment_round_trip(spark, sf_dir):
    """Rows that begin with the comment sign do not come back."""
    d, path = t(spark, sf_dir, "nation"), scratch_folder(spark, "tsv")
    writers.delimited(d.select(F.when(F.col("n_regionkey") == 0, F.concat(F.lit("! "), "n_name")).otherwise(F.col("n_name")).alias("n_name"), "n_nationkey", "n_regionkey"), path, sep="\t")
    return readers.table(spark, path, schema="n_name string, n_nationkey int, n_regionkey int", sep="\t", comment="!")


def _nation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "nation").select(F.concat_ws(",", F.format_string("%03d", "n_nationkey"), "n_name", F.col("n_regionkey").cast("string")).alias("line"))


_NATION_SQL = "printf('%03d', n_nationkey)"


@query(f"SELECT {_NATION_SQL} AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def header_on_second_line(spark, sf_dir):
    path = _as_one_file(spark, _nation_lines(spark, sf_dir), ["an export", "key,name,region"], "second-line")
    return readers.table_below(spark, path, 1)


@query(f'SELECT {_NATION_SQL} AS "id.key", n_name AS "id.name", CAST(n_regionkey AS VARCHAR) AS "place.region" FROM nation')
def two_level_header(spark, sf_dir):
    path = _as_one_file(spark, _nation_lines(spark, sf_dir), ["id,,place", "key,name,region"], "two-levels")
    return readers.table_below(spark, path, 0, levels=2)


@query(f"SELECT n_name AS name, {_NATION_SQL} AS key FROM nation")
def positional_columns(spark, sf_dir):
    path = _as_one_file(spark, _nation_lines(spark, sf_dir), ["x,y", "p,q,r"], "positional")
    return readers.positional(spark, path, {1: "name", 0: "key"}, skip=2)


@query("SELECT 'tcell_assay' AS kind, 2 AS header_lines UNION ALL SELECT 'epitope_table', 1")
def format_sniffing(spark, sf_dir):
    lines = t(spark, sf_dir, "region").select(F.concat_ws(",", F.col("r_regionkey").cast("string"), "r_name").alias("line"))
    found = [readers.sniff(spark, _as_one_file(spark, lines, head, "sniff")) for head in (["An export", "Key,Qualitative Measure"], ["key,name"])]
    return spark.createDataFrame(found, "kind string, header_lines int")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_document_round_trip(spark, sf_dir):
    path = scratch_folder(spark, "json-document")
    whole = t(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("value"))
    whole.write.text(path)
    return readers.json_document(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def json_lines_round_trip(spark, sf_dir):
    d, path = t(spark, sf_dir, "supplier"), scratch_folder(spark, "json-lines")
    writers.json_lines(d, path)
    return spark.read.schema(d.schema).json(path)


@query("SELECT DISTINCT upper(p_brand) AS peptide FROM part")
def item_list_round_trip(spark, sf_dir):
    path = scratch_folder(spark, "items")
    writers.item_list(t(spark, sf_dir, "part"), "p_brand", path)
    return readers.lines(spark, path)


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def partitioned_parquet(spark, sf_dir):
    """The filter reaches the folders, so the other partitions are not read."""
    path = scratch_folder(spark, "partitioned")
    writers.parquet(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), path, partition_by=("o_orderstatus",))
    return spark.read.parquet(path).filter("o_orderstatus = 'F'")


@query("SELECT r_name, count(*) AS n FROM region WHERE r_regionkey < 0 GROUP BY r_name")
def optional_file(spark, sf_dir):
    """A file that is not there is an empty table of its schema."""
    return readers.read_or_empty(spark, scratch_folder(spark, "missing"), "r_name string, n long").groupBy("r_name").agg(F.count("*").alias("n"))


@query("SELECT n_name AS exact, n_regionkey AS fuzzy FROM nation")
def resolved_columns(spark, sf_dir):
    d = t(spark, sf_dir, "nation")
    return d.select(F.col(readers.resolve_column(d, ["missing", "N_NAME"])).alias("exact"), F.col(readers.resolve_column(d, ["region"], "regionkey")).alias("fuzzy"))


_ORGANISMS = ("Human herpesvirus 4 strain B95-8", "Epstein-Barr virus", "Human papillomavirus type 16", "HPV-16", "HPV11 isolate", "Influenza A")


@query("WITH o AS (SELECT p_partkey, (['Human herpesvirus 4 strain B95-8', 'Epstein-Barr virus', 'Human papillomavirus type 16', 'HPV-16', 'HPV11 isolate', 'Influenza A'])[p_partkey % 6 + 1] AS organism FROM part) SELECT p_partkey, CASE WHEN regexp_matches(lower(organism), 'herpesvirus 4|epstein') THEN 'EBV' WHEN regexp_matches(lower(organism), 'type 16|hpv-16') THEN 'HPV16' WHEN contains(lower(organism), 'hpv11') THEN 'HPV11' END AS virus, CASE WHEN regexp_matches(lower(organism), 'herpesvirus 4|epstein') THEN 'EBV' WHEN regexp_matches(lower(organism), 'type 16|hpv-16') THEN 'HPV16' END AS without_hpv11 FROM o")
def organism_to_virus(spark, sf_dir):
    organism = F.element_at(F.array(*map(F.lit, _ORGANISMS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t(spark, sf_dir, "part").select("p_partkey", scalar.virus(organism).alias("virus"), scalar.virus(organism, hpv11=False).alias("without_hpv11"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 END AS label FROM events")
def assay_labels(spark, sf_dir):
    text = F.when(F.col("event_type") == "purchase", " Positive-High ").when(F.col("event_type") == "error", "NEGATIVE").otherwise(F.col("event_type"))
    return t(spark, sf_dir, "events").select("event_id", scalar.assay_label(text).alias("label"))


@query("SELECT page_id, regexp_full_match('/' || regexp_replace(url, '^https?://', ''), '/[A-Za-z0-9_./-]+') AND NOT contains(url, '..') AS safe FROM pages")
def safe_paths(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", scalar.safe_path(F.concat(F.lit("/"), F.regexp_replace("url", "^https?://", ""))).alias("safe"))


@query(f"SELECT p_partkey, [[CASE WHEN substr(upper(p_name), i, 1) = r THEN 1 ELSE 0 END FOR r IN {list(K.RESIDUES)}] FOR i IN range(1, 12)]::VARCHAR AS hot FROM part")
def one_hot_residues(spark, sf_dir):
    hot = F.transform(sequence.one_hot(F.upper("p_name")), lambda row: F.concat(F.lit("["), F.array_join(F.transform(row, lambda v: v.cast("string")), ", "), F.lit("]")))
    return t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(hot, ", "), F.lit("]")).alias("hot"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / (10 + 1e-10) AS a, (l_discount - 0.05) / (0.02 + 1e-10) AS b FROM lineitem),
  h AS (SELECT *, greatest(0, 0.5 * a - 0.25 * b + 0.1) AS h1, greatest(0, -0.75 * a + 0.5 * b - 0.2) AS h2 FROM x)
  SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(1.5 * h1 - 0.5 * h2 + 0.05))), 8) AS score FROM h""")
def network_scores(spark, sf_dir):
    layers = [([[0.5, -0.75], [-0.25, 0.5]], [0.1, -0.2]), ([[1.5], [-0.5]], [0.05])]
    d = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return ml.dense_scores(d, ["l_quantity", "l_discount"], layers, [25.0, 0.05], [10.0, 0.02]).select("l_orderkey", "l_linenumber", F.round("score", 8).alias("score"))


@query(f"WITH {LABELLED} SELECT doc_id, CASE WHEN score >= (SELECT median(score) FROM labelled) THEN 1 ELSE 0 END AS label FROM labelled")
def prototype_labels(spark, sf_dir):
    return ml.prototype_labels(labelled(spark, sf_dir).drop("label"), "score").select("doc_id", "label")


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(0.8 * ln(q / (1 - q)) - 0.3))), 8) AS p FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, l_discount * 10)) AS q FROM lineitem)")
def calibrated_scores(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(ml.calibrated(F.col("l_discount") * 10, 0.8, -0.3), 8).alias("p"))


@query("SELECT p_partkey, p_size / 10.0 >= 2 AND (p_partkey % 20) / 100.0 >= 0.08 AND (p_size - 5) / 10.0 >= 2 AS supported FROM part")
def ratio_decision(spark, sf_dir):
    size, rate = F.col("p_size"), (F.col("p_partkey") % 20) / 100.0
    return t(spark, sf_dir, "part").select("p_partkey", stats.ratio_supported(size / 10.0, rate, (size - 5) / 10.0).alias("supported"))


@query("""WITH m AS (SELECT min(n_name) IS NOT NULL AND bool_and(n_nationkey % 2 = 1 OR 0.5 + n_regionkey / 10.0 >= 0.55) AS a FROM nation), b AS (SELECT bool_and(0.6 >= 0.55) AS b FROM region), c AS (SELECT bool_and(-r_regionkey / 25.0 > -0.20) AS c FROM region), d AS (SELECT bool_and(n > 0) AS d FROM (SELECT count(*) AS n FROM nation GROUP BY n_regionkey))
  SELECT a AS no_severe_subgroup_underperformance, b AS acceptable_threshold_tradeoff, c AS gold_standard_not_brittle, d AS dataset_provenance_complete, a AND b AND c AND d AS all_passed FROM m, b, c, d""")
def release_decision(spark, sf_dir):
    nation, region = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    m = nation.select(F.when(F.col("n_nationkey") % 2 == 0, "virus").otherwise("fold").alias("subgroup_key"), (0.5 + F.col("n_regionkey") / 10.0).alias("auc_pr"))
    counts = nation.groupBy("n_regionkey").agg(F.count("*").alias("n_total"), F.count("*").alias("raw_n_records"))
    return curation.release_gates(m, region.select(F.lit(0.6).alias("overall_precision"), F.lit(0.6).alias("overall_recall")), region.select((-F.col("r_regionkey") / 25.0).alias("delta_recovery_top25")), counts)


@query("""WITH r AS (SELECT c_nationkey AS pool, c_custkey, c_acctbal, c_mktsegment = 'BUILDING' AND c_custkey % 50 = 0 AS gold, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer)
  SELECT pool, count(DISTINCT c_custkey) AS n_unique, count(*) FILTER (rn <= 10 OR gold) AS pool_size, 10 AS top_n, max(CASE WHEN rn = 10 THEN c_acctbal END) AS value_at_rank_n, count(*) FILTER (gold) AS gold_in_pool, count(*) FILTER (gold AND rn > 10) AS gold_forced FROM r GROUP BY pool""")
def pool_manifest(spark, sf_dir):
    d = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("pool"), "c_custkey", "c_acctbal", ((F.col("c_mktsegment") == "BUILDING") & (F.col("c_custkey") % 50 == 0)).alias("gold"))
    return curation.pool_manifest(d, "pool", "c_custkey", "c_acctbal", F.col("gold"), 10)
