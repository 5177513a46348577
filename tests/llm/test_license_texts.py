"""Whole licence texts and wrapped notices are found wherever their lines break."""

import textwrap

from lumenrank.llm import license
from tests.llm.test_media_quality_license import docs


def test_wrapped_texts(spark):
    own = " ".join(f"own{i}" for i in range(700))
    rows = []
    for k, (_, text) in enumerate(license.TEMPLATES):
        rows.append((k, f"{own}\n" + "\n".join(" * " + line for line in textwrap.wrap(text, 72)) + f"\n{own}"))
        rows.append((100 + k, "\n".join(textwrap.wrap(text, 30)).upper()))
    rows += [(900, own), (901, None), (902, "\n".join("Licensed under the Apache License, Version 2.0".split()))]
    got = {r.doc_id: r for r in license.scan(docs(spark, rows)).collect()}
    for k, (label, text) in enumerate(license.TEMPLATES):
        for r in (got[k], got[100 + k]):
            assert label in r.labels.split(",") and r.score == 1, (label, r)
        n = len(license.words(text))
        assert any(b.label == label and b.containment == 1 and b.first <= 700 and b.first + b.size >= 700 + n for b in got[k].blocks)
    assert got[900].labels == got[901].labels == "" and got[902].labels == "apache-2.0"


def test_no_python_in_the_plan(spark):
    plan = license.scan(docs(spark, [(1, "mit")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
