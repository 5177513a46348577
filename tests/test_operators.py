"""Reference-style unit tests of functions and operators on small frames."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lumenrank.functions import constants as K
from lumenrank.functions import scalar, sequence
from lumenrank.operators import aggregates, curation, governance, metrics, ml, ranking, relational, stats
from lumenrank.operators.backends import HashBackend, LookupBackend, ModelBackend
from lumenrank.plans import proteome
from lumenrank.sources import readers, writers
from lumenrank.streaming import windows


def one(df):
    return df.first().asDict()


# --- sequences ---------------------------------------------------------------------------------


def test_kmers_have_coordinates_and_skip_long_windows(spark):
    df = spark.createDataFrame([("a", "ABCDEFGHIJ"), ("b", "ABC"), ("c", "")], "protein_id string, seq string")
    got = {(r.protein_id, r.peptide, r.start, r.end) for r in sequence.kmers(df).collect()}
    want = {("a", "ABCDEFGHIJ"[i : i + n], i + 1, i + n) for n in K.LENGTHS for i in range(10 - n + 1)}
    assert got == want


def test_features_of_hand_checked_peptides(spark):
    df = spark.createDataFrame([("CLGGLLTMV", 0.5), ("RAKFKQLL", 0.0), ("TIHDIILECV", 0.3), ("HPVGEADYFEY", 0.7)], "peptide string, presentation_score double")
    got = {r.peptide: r.asDict() for r in sequence.features(df).collect()}
    a = got["CLGGLLTMV"]
    assert [a[f"{p}_hydrophobicity"] for p in K.POSITIONS] == [-0.4, 3.8, 3.8, -0.7, 1.9] and a["binding_score"] == 0.5 and a["peptide_length"] == 9
    b = got["RAKFKQLL"]
    assert [b[f"{p}_vdw_volume"] for p in K.POSITIONS] == [135.0, 135.0, 114.0, 0.0, 0.0] and b["p4_aromaticity"] == 1 and b["p5_charge"] == 1
    assert [b[f"{p}_upward_prob"] for p in K.POSITIONS] == [0.8, 0.9, 0.8, 0.0, 0.0]
    c = got["TIHDIILECV"]
    assert [c[f"{p}_charge"] for p in K.POSITIONS] == [-1.0, 0.0, 0.0, -1.0, 0.0]
    assert got["HPVGEADYFEY"]["p8_hydrophobicity"] == -3.5 and len(a) == 2 + 42


@pytest.mark.parametrize("n,want", [(8, [3, 4, 5, None, None]), (9, [3, 4, 5, 6, 7]), (10, [3, 4, 5, 7, 8]), (11, [3, 4, 5, 8, 9]), (3, [None] * 5), (0, [None] * 5)])
def test_contact_positions(spark, n, want):
    assert list(spark.range(1).select(*[sequence.contact_index(p, F.lit(n)).alias(p) for p in K.POSITIONS]).first()) == want


def test_feature_sets():
    assert [len(sequence.model_columns(n)) for n in (21, 22, 30, 31, 50, 166)] == [21, 22, 30, 31, 50, 166]
    with pytest.raises(ValueError):
        sequence.model_columns(7)


def test_any_text_and_number_is_accepted(spark):
    rows = [("", float("nan")), ("é日本", float("inf")), ("A" * 100, None), (None, 0.0), ("x|%'\"\n", -1.0)]
    assert sequence.features(spark.createDataFrame(rows, "peptide string, presentation_score double")).count() == 5


def test_alleles(spark):
    df = spark.createDataFrame([("A0201",), ("HLA-A0201",), ("A*02:01",), ("HLA-A*0201",), (" HLA-A*02:01 ",), (None,)], "a string")
    assert {r[0] for r in df.select(scalar.standard_allele(F.col("a"))).collect()} == {"HLA-A*02:01", None}
    r = spark.range(1).select(scalar.allele_column(F.lit("HLA-B*44:02")).alias("c"), scalar.allele_of_column(F.lit("bind_B4402")).alias("a"), scalar.compact_allele(F.lit("HLA-B*44:02")).alias("s")).first()
    assert tuple(r) == ("bind_B4402", "HLA-B*44:02", "B4402")
    assert {c for (c,) in spark.createDataFrame([(a,) for a in K.ALLELES], "a string").select(scalar.allele_column(F.col("a"))).collect()} == set(K.ALLELE_COLUMNS)


@pytest.mark.parametrize("name,virus,want", [("Latent membrane protein 2", "EBV", "LMP2A"), ("EBNA3B", "EBV", "EBNA3A"), ("EBNA-3B", "EBV", "EBNA3B"), ("Nuclear antigen 3C", "EBV", "EBNA3C"), ("Nuclear antigen", "EBV", "EBNA"), ("Protein E7", "HPV16", "E7"), (" Other ", "EBV", "Other"), ("X", "Z", "X"), (None, "EBV", None)])
def test_genes(spark, name, virus, want):
    df = spark.createDataFrame([(name, virus)], "n string, v string")
    assert df.select(scalar.gene(F.col("n"), F.col("v"))).first()[0] == want


def test_text_rules(spark):
    s = lambda c: spark.range(1).select(c).first()[0]
    assert s(scalar.strain(F.lit("Human herpesvirus 4 strain B95-8"), F.lit("EBV"))) == "B95-8"
    assert s(scalar.strain(F.lit("Human papillomavirus type 18"), F.lit("HPV16"))) == "HPV18"
    assert s(scalar.file_virus(F.lit("HVP16_tcell_positive.csv"))) == "HPV16" and s(scalar.file_label(F.lit("x_negative.csv"))) == 0
    assert s(scalar.assay_label(F.lit("Positive-High"))) == 1 and s(scalar.assay_label(F.lit("unknown"))) is None
    assert s(scalar.canonical(F.lit("HPV_8_FASTAs"))) == "HPV16_18_panel8" and s(scalar.sanitise(F.lit("a b/c-d_e"))) == "a_b_c-d_e"
    assert s(scalar.sigmoid(F.lit(1e9))) == 1.0 and s(scalar.guarded_ratio(F.lit(1.0), F.lit(0.05))) is None and s(scalar.close(F.lit(1.0), F.lit(1.000001)))
    assert s(scalar.safe_path(F.lit("/a/b.txt"))) and not s(scalar.safe_path(F.lit("/a/../b")))
    with pytest.raises(Exception, match="unknown"):
        s(scalar.strict_lookup(F.lit("z"), {"a": "b"}))


# --- metrics -----------------------------------------------------------------------------------


def scored(spark, y, s):
    return spark.createDataFrame([(i, int(a), float(b), "g") for i, (a, b) in enumerate(zip(y, s))], "k long, y int, s double, g string")


def brute_metrics(y, s):
    n, p = len(y), sum(y)
    order = sorted(range(n), key=lambda i: (-s[i], i))
    out = {}
    pairs = [(1.0 if s[i] > s[j] else 0.5 if s[i] == s[j] else 0.0) for i in range(n) if y[i] for j in range(n) if not y[j]]
    out["auc_roc"] = sum(pairs) / len(pairs) if pairs else None
    ap = 0.0
    for v in sorted(set(s), reverse=True):
        at = [i for i in range(n) if s[i] >= v]
        ap += sum(y[i] for i in range(n) if s[i] == v) * sum(y[i] for i in at) / len(at)
    out["auc_pr"] = ap / p if p and p < n else None
    mean = {v: sum(y[i] for i in range(n) if s[i] == v) / s.count(v) for v in set(s)}
    for q in (10, 25):
        k = max(1, int(n * q / 100))
        hits = sum(y[i] for i in order[:k])
        out |= {f"issr_{q}": hits / k, f"recall_{q}": hits / max(1, p)}
        ideal = sum(1 / math.log2(i + 2) for i in range(min(k, p)))
        out[f"ndcg_{q}"] = sum(mean[s[i]] / math.log2(r + 2) for r, i in enumerate(order[:k])) / ideal if p else 0.0
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("spread", [True, False])
def test_metrics_equal_brute_force(spark, seed, spread):
    rng = random.Random(seed)
    n = rng.choice([1, 7, 90])
    y, s = [rng.randint(0, 1) for _ in range(n)], [float(rng.randint(0, 12)) for _ in range(n)]
    got = one(metrics.ranked_metrics(scored(spark, y, s), ["g"], "s", "y", "k", spread=spread))
    for m, v in brute_metrics(y, s).items():
        assert got[m] == (None if v is None else pytest.approx(v)), m


def test_perfect_and_one_class_rankings(spark):
    got = one(metrics.ranked_metrics(scored(spark, [0, 0, 0, 1, 1, 1], [0.1, 0.2, 0.3, 0.7, 0.8, 0.9]), [], "s", "y", "k"))
    assert got["auc_roc"] == 1 and got["auc_pr"] == pytest.approx(1)
    top = one(metrics.ranked_metrics(scored(spark, [0] * 90 + [1] * 10, range(100)), [], "s", "y", "k"))
    assert top["issr_10"] == 1 and top["ndcg_10"] == pytest.approx(1)
    single = one(metrics.ranked_metrics(scored(spark, [1, 1], [1, 2]), [], "s", "y", "k"))
    assert single["auc_roc"] is None and single["issr_10"] == 1


def test_subgroups_below_the_least_size_are_left_out(spark):
    df = scored(spark, [0, 1] * 20, range(40)).withColumn("v", F.when(F.col("k") < 30, "big").when(F.col("k") < 35, "small"))
    got = {(r.subgroup_key, r.subgroup_value): r.n for r in metrics.subgroup_metrics(df, [], ["v"], "s", "y", "k", least=5).collect()}
    assert got == {("overall", "all"): 40, ("v", "big"): 30, ("v", "small"): 5, ("v", "missing"): 5}


# --- ranks, picks, votes -----------------------------------------------------------------------


def test_rank_flavours(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0), (4, 1.0)], "k long, s double")
    r = {x.k: x for x in ranking.rank_ties(df, "s").collect()}
    assert [r[k].rank_min for k in (1, 2, 3, 4)] == [2, 2, 1, 4] and r[1].rank_average == 2.5 and r[1].rank_average_floor == 2
    assert {x.k: x["rank"] for x in ranking.rank_contiguous(df, "s", "k").collect()} == {3: 1, 1: 2, 2: 3, 4: 4}


@pytest.mark.parametrize("n", [1, 1000])
def test_prefix_sums_equal_a_window(spark, n):
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 37 % 101).cast("double").alias("s"), (F.col("id") % 7).alias("w"))
    got = {r.k: r.b for r in ranking.prefix_sums(df, "s", {"b": "w"}, descending=True, ties=[F.col("k").asc()]).collect()}
    rows = sorted(((k, float(k * 37 % 101), k % 7) for k in range(n)), key=lambda r: (-r[1], r[0]))
    total = 0
    for k, _, w in rows:
        assert got[k] == total
        total += w


def test_votes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("b", 1), ("b", 0), ("c", 0)], "p string, label int")
    assert {r.p: r.label for r in aggregates.majority_vote(df, ["p"], "label").collect()} == {"a": 1, "b": 1, "c": 0}
    assert {r.p: r.label for r in curation.consensus(df, "p").collect()} == {"b": 1, "c": 0}
    with pytest.raises(curation.GateError):
        curation.consensus(df, "p", gates=curation.ConsensusGates(conflict_ratio=0.1))
    with pytest.raises(curation.GateError):
        curation.consensus(df, "p", gates=curation.ConsensusGates(least_yield=0.9))


def test_gates(spark):
    ok = spark.createDataFrame([("CLGGLLTMV", 1), ("RAKFKQLL", 0)], "peptide string, label int")
    assert curation.gate(ok)["warning"] is None
    for bad in ([("CLGGXLTMV", 1)], [("CLGGLLTMV", 1)] * 2, [("CLGGLLTMV", 1), ("CLGGLLTMV", 0)]):
        with pytest.raises(curation.GateError):
            curation.gate(spark.createDataFrame(bad, "peptide string, label int"))
    dirty = spark.createDataFrame([(" clggllTMV ", 1), ("SHORT", 1), ("CLGGLLTMV", 5), (None, 1)], "peptide string, label int")
    assert [r.peptide for r in curation.sanitise(dirty).collect()] == ["CLGGLLTMV"]
    with pytest.raises(curation.GateError):
        curation.sanitise(dirty.drop("label"))


def test_containment_by_seeds_equals_the_nested_loop(spark):
    rng = random.Random(0)
    texts = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    needles = [(i, "".join(rng.choice("ab") for _ in range(rng.choice([1, 5, 9, 20])))) for i in range(30)]
    d, n = spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame(needles, "i long, needle string")
    got = {tuple(r) for r in relational.seeded_containment(d, "k", "t", n, "i", "needle", seed=6).collect()}
    assert got == {(k, i) for k, t in texts for i, s in needles if s in t}
    want = {k for k, t in texts if any(s in t or t in s for _, s in needles)}
    for most in (1 << 20, 0):  # the nested loop, and the hash form
        assert {r.k for r in relational.contained_in_any(d, "t", n, "needle", key="k", most_bytes=most).collect()} == want


def test_row_arg_max_prefers_the_first_column_and_skips_nan(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (float("nan"), 2.0, 3.0), (None, None, None)], "a double, b double, c double")
    assert [tuple(r) for r in df.select(scalar.row_max(["a", "b", "c"]), scalar.row_arg_max(["a", "b", "c"])).collect()] == [(1.0, "a"), (3.0, "c"), (None, None)]


def test_weights_have_mean_one(spark):
    df = spark.createDataFrame([("x", 9)] * 6 + [("y", 8)] * 2 + [(None, 9)], "v string, n int")
    got = [r.weight for r in aggregates.sample_weights(df, "v", F.col("n") == 9).collect()]
    assert sum(got) / len(got) == pytest.approx(1) and max(got) > 1 > min(got)


# --- tests and rules ---------------------------------------------------------------------------


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (1.056,)], "p double")
    got = {r.p: r.p_value_fdr for r in stats.benjamini_hochberg(df, "p").collect()}
    assert got == {0.01: pytest.approx(0.04), 0.03: pytest.approx(0.16 / 3), 0.04: pytest.approx(0.16 / 3), 1.056: 1.0}


def test_sign_flip(spark):
    d = [0.1, 0.2, -0.05, 0.3, 0.15]
    want = sum(sum(x if m >> i & 1 else -x for i, x in enumerate(d)) >= sum(d) - 1e-12 for m in range(32)) / 32
    assert one(stats.sign_flip(spark.createDataFrame([(x,) for x in d], "d double"), "d"))["p_value"] == want
    assert one(stats.sign_flip(spark.createDataFrame([(-1.0,), (0.5,)], "d double"), "d"))["p_value"] == 1.0


def test_overlap_counts_both_directions(spark):
    e = spark.createDataFrame([("abc",), ("xabcx",), ("q",), ("zz",)], "k string")
    t = spark.createDataFrame([("ABC",), ("zzz",)], "o string")
    got = one(stats.overlap(e, "k", t, "o"))
    assert (got["n_eval"], got["n_exact"], got["n_substring"], got["status"]) == (4, 1, 2, "contaminated")


def test_brier_and_reliability(spark):
    df = spark.createDataFrame([(0.0, 0), (0.1, 0), (0.11, 1), (1.0, 1)], "p double, y int")
    assert one(metrics.brier(df, "p", "y"))["brier_trivial"] == 0.25
    assert {r.bin: r.n for r in metrics.reliability(df, "p", "y").collect()} == {0: 2, 1: 1, 9: 1}


# --- pipeline, backends, models ----------------------------------------------------------------

FASTA = ">sp|P1|ONE some words\nMKTAYIAKQR\nQISFVKSHFS\n>second\nmkxtayiakqrqis\n"


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(FASTA)
    got = {r.protein_id: r for r in readers.fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got["sp|P1|ONE"].seq == "MKTAYIAKQRQISFVKSHFS" and got["sp|P1|ONE"].name == "ONE" and got["second"].seq == "MKXTAYIAKQRQIS"


def test_proteome_to_ranked(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(FASTA)
    found = proteome.peptides(readers.fasta(spark, str(tmp_path / "a.fasta")))
    assert found.filter("peptide LIKE '%X%'").count() == 0
    bound = proteome.binding(found, HashBackend())
    assert bound.count() == found.select("peptide").distinct().count()
    for r in bound.collect():
        wide = [r[c] for c in K.ALLELE_COLUMNS]
        assert r.presentation_score == max(wide)
    assert {r.source_protein_count for r in bound.collect()} == {1, 2}
    final = proteome.ranked(proteome.features(bound).withColumn("immunogenicity_score", proteome.linear_score(bound, {"presentation_score": 2.0}, -1.0)), threshold=0.5)
    ranks = [r["rank"] for r in final.collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))
    gold = spark.createDataFrame([("MKTAYIAK",), ("WWWWWWWW",)], "peptide string")
    got = {r.peptide: r for r in proteome.stage_recovery(gold, found, bound, final).collect()}
    assert got["MKTAYIAK"].stage4_found and not got["WWWWWWWW"].stage1_found and got["WWWWWWWW"]["rank"] is None


def test_backends(spark):
    peptides = spark.createDataFrame([("AAAAAAAA",), ("CCCCCCCC",)], "peptide string")
    table = spark.createDataFrame([("AAAAAAAA", "x", 0.5)], "peptide string, allele string, presentation_score double")
    assert {(r.peptide, r.presentation_score) for r in LookupBackend(table).predict(peptides, ["x"]).collect()} == {("AAAAAAAA", 0.5), ("CCCCCCCC", None)}
    got = ModelBackend(lambda: lambda p, a: p.str.len() / 10.0).predict(peptides, ["x", "y"]).collect()
    assert len(got) == 4 and {r.presentation_score for r in got} == {0.8}


def test_folds_models_and_calibration(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([(i, float(x := rng.random()), rng.random(), int(x + rng.random() * 0.4 > 0.7)) for i in range(200)], "k long, a double, b double, label int")
    df = ml.stratified_folds(df, "k", ["label"], k=3).cache()
    sizes = {r.fold: (r.n, r.p) for r in df.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()}
    assert len(sizes) == 3 and max(n for n, _ in sizes.values()) - min(n for n, _ in sizes.values()) <= 2
    oof = ml.out_of_fold(df, ml.forest(["a", "b"], trees=10), "rf", k=3)
    assert oof.count() == 200 and one(metrics.ranked_metrics(oof, [], "score", "label", "k"))["auc_roc"] > 0.85
    model = ml.forest(["a", "b"], trees=10).fit(df)
    top = ml.importances(model, ["a", "b"]).first()
    assert top.feature == "a"
    slope, intercept = ml.platt(oof)
    assert slope > 0 and 0 < one(spark.range(1).select(ml.calibrated(F.lit(0.5), slope, intercept).alias("c")))["c"] < 1
    dense = ml.dense_scores(df.select("k", "a", "b"), ["a", "b"], [([[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0]), ([[1.0], [1.0]], [0.0])], [0.5, 0.5], [1.0, 1.0], passes=5, dropout=0.5)
    assert dense.filter("score BETWEEN 0 AND 1 AND uncertainty_std >= 0").count() == 200
    with pytest.raises(RuntimeError):
        ml.prototype_labels(df, "a", frozen=True)


# --- sources, sinks, governance ----------------------------------------------------------------


def test_tables_with_odd_headers(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('Epitope,Epitope,Assay\nName,Type,Qualitative Measurement\n"AB,C",linear,Positive\nDEF,linear,Negative\n')
    two = readers.table_below(spark, str(f), 0, levels=2)
    assert two.columns == ["Epitope.Name", "Epitope.Type", "Assay.Qualitative Measurement"] and {r[0] for r in two.collect()} == {"AB,C", "DEF"}
    assert readers.table_below(spark, str(f), 1).columns == ["Name", "Type", "Qualitative Measurement"]
    assert {tuple(r) for r in readers.positional(spark, str(f), {0: "a", 2: "c"}, skip=2).collect()} == {("AB,C", "Positive"), ("DEF", "Negative")}
    assert readers.sniff(spark, str(f)) == ("tcell_assay", 2)
    g = tmp_path / "c.tsv"
    g.write_text("# note\na\tb\n1\t2\n")
    assert one(readers.table(spark, str(g), "a int, b int", sep="\t", comment="#")) == {"a": 1, "b": 2}
    assert readers.read_or_empty(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    assert readers.resolve_column(two, ["assay.qualitative measurement"]) == "Assay.Qualitative Measurement" and readers.resolve_column(two, ["x"], "type") == "Epitope.Type"


def test_folder_names_tell_label_and_virus(spark, tmp_path):
    for name in ("EBV_tcell_positive.csv", "HVP16_tcell_negative.csv"):
        (tmp_path / name).write_text("p\nX\n")
    got = {(r.file_label, r.file_virus) for r in readers.folder(spark, str(tmp_path), "*.csv").collect()}
    assert got == {(1, "EBV"), (0, "HPV16")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    writers.delimited(df, str(tmp_path / "csv"), ["v"], sep="\t")
    assert readers.table(spark, str(tmp_path / "csv"), "v int", sep="\t").count() == 2
    writers.parquet(df, str(tmp_path / "p"), ("k",))
    writers.item_list(df, "k", str(tmp_path / "l"))
    assert [r.peptide for r in readers.lines(spark, str(tmp_path / "l")).collect()] == ["A", "B"]
    writers.json_report({"a": 1}, tmp_path / "r.json")
    assert one(readers.json_document(spark, str(tmp_path / "r.json"))) == {"a": 1}
    assert (writers.run_folder(tmp_path, "run_1") / "manifests").is_dir()


def test_content_hash_ignores_order(spark):
    rows = [(i, None if i % 7 == 0 else f"x{i}") for i in range(50)]
    make = lambda r: one(governance.content_hash(spark.createDataFrame(r, "a long, b string")))
    assert make(rows) == make(rows[::-1]) != make(rows[:-1] + [(49, "y")])
    assert make(rows + rows[:1]) != make(rows)


def test_manifests(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    governance.update_manifest(tmp_path / "m.json", [tmp_path / "a.txt"], tmp_path, version="v1")
    assert governance.verify_manifest(tmp_path / "m.json", tmp_path, ["a.txt"]) == []
    (tmp_path / "a.txt").write_text("two")
    assert governance.verify_manifest(tmp_path / "m.json", tmp_path, ["a.txt", "b"]) == ["b: not in the manifest", "a.txt: checksum differs"]
    assert one(governance.file_hashes(spark, str(tmp_path / "a.txt")))["sha256"] == governance.file_sha256(tmp_path / "a.txt")
    with pytest.raises(FileNotFoundError):
        governance.bundle(tmp_path / "z.zip", [tmp_path / "none"], tmp_path)
    assert set(governance.bundle(tmp_path / "z.zip", [tmp_path / "a.txt"], tmp_path)) == {"a.txt"}


def test_publishing_is_all_or_nothing(tmp_path):
    def fail(_):
        raise ValueError("broken")

    with pytest.raises(ValueError):
        governance.publish(tmp_path, {"one": lambda d: (d / "one.txt").write_text("1"), "two": fail})
    assert not (tmp_path / "one.txt").exists() and json.loads((tmp_path / "status.json").read_text())["step"] == "two"
    governance.publish(tmp_path, {"one": lambda d: (d / "one.txt").write_text("1")})
    assert (tmp_path / "one.txt").read_text() == "1"


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5), ("c", None)], "k string, v double")
    assert governance.markdown_table(df, ["k"]).splitlines()[2] == "| a\\|b | 0.5000 |"
    once = governance.replace_section("# R\n", "<!-- x -->", "one")
    assert governance.replace_section(once, "<!-- x -->", "two").count("<!-- x -->") == 1
    assert governance.name_candidates("HPV_8_FASTAs") == ["HPV16_18_panel8", "HPV_8_FASTAs"]
    (tmp_path / "a").write_text("")
    (tmp_path / "b").write_text("")
    assert governance.first_existing(tmp_path, ["x", "b"]).name == "b"
    with pytest.raises(ValueError):
        governance.first_existing(tmp_path, ["a", "b"], strict=True)


# --- streams -----------------------------------------------------------------------------------


def test_a_stream_gives_the_table_s_windows(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 60 % 24:02d}:{i % 60:02d}:00", "ab"[i % 2], float(i)) for i in range(0, 600, 7)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    windows.to_parquet(windows.tumbling(stream, "event_type", "1 hour", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in windows.tumbling(df, "event_type", "1 hour").collect()}
    assert got <= want and len(got) >= len(want) - 2  # the last windows stay open until the watermark passes them
