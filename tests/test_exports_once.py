"""The report over files ingests them once."""

from compare import compare

import __spark_entry__ as entry
from talkframe.plans import analyze


def test_scoring_reads_ingested_messages(spark, sf_dir, duck, monkeypatch):
    given, score = [], analyze.score
    monkeypatch.setattr(analyze, "score", lambda df, model: given.append(df) or score(df, model))
    out = entry.queries()["analyze_exports"](spark, sf_dir)
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\n") == 1 and plan.startswith("Relation")
    assert compare(out, duck, entry.oracle_sql()["analyze_exports"]) is None
