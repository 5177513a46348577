"""The model queries over small tables."""

import random

from lumenrank.plans import catalog


def tables(spark, folder):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["ab", "c|", "d%%", "efgh"]) for _ in range(rng.randint(1, 40))), ["de", "en", "es", "fr", "it"][i % 5] if i != 7 else None) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    # one class only in "it"
    spark.createDataFrame([(i, 1 if i % 5 == 4 else rng.randrange(2), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_transfer_covers_every_language_and_the_pool(spark, tmp_path, monkeypatch):
    tables(spark, tmp_path)
    forest = catalog.ml.forest
    monkeypatch.setattr(catalog.ml, "forest", lambda features, **_: forest(features, trees=2))
    got = {(r.trained_on, r.tested_on): r.n for r in catalog.transfer_matrix(spark, str(tmp_path)).collect()}
    langs = ["de", "en", "es", "fr"]
    assert set(got) == {("All", "All"), *((a, b) for a in langs for b in langs if a != b)}
    assert got["All", "All"] == 150 and got["en", "es"] == 29 and got["de", "fr"] == 30


def test_models_are_of_full_size(spark, tmp_path, monkeypatch):
    tables(spark, tmp_path)
    fits = []

    def scored(df, pipeline, method, k=5):
        model = pipeline.getStages()[-1]
        fits.append((k, model.getNumTrees() if hasattr(model, "getNumTrees") else model.getMaxIter(), df.agg({"fold": "max"}).first()[0]))
        return df.withColumns({"score": catalog.F.lit(0.5), "method": catalog.F.lit(method)})

    def moved(df, by, values, make):
        fits.append((5, make().getStages()[-1].getNumTrees(), 4))
        return df.withColumns({"score": catalog.F.lit(0.5), "trained_on": catalog.F.lit("x"), "tested_on": catalog.F.col(by)})

    monkeypatch.setattr(catalog.ml, "out_of_fold", scored)
    monkeypatch.setattr(catalog.ml, "transfer", moved)
    for query in (catalog.rf_oof_score, catalog.gbt_oof_score, catalog.feature_ablation, catalog.transfer_matrix):
        query(spark, str(tmp_path))
    assert len(fits) == 7 and set(fits) == {(5, 200, 4)}
