"""Lines are split, counted and judged without functions over arrays of structs or of words: these are interpreted, and took half of op3's CPU seconds."""

import pytest
from pyspark.sql import functions as F

lines = pytest.importorskip("trellis.llm.lines")


def test_has_words(spark):
    texts = ["", " ", "a", " a b ", "\t\x0b a b c\x0c", "x " * 9, "x " * 10, "x\t\n\r" * 11 + "y", "\x1f  ", "y" * 50_000, " " * 50_000 + "z z", "é ü " * 5, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for least in (0, 1, 2, 3, 10, 11):
        count = F.regexp_count("t", F.lit(lines.WORD)) >= least
        for r in df.where("t IS NOT NULL").select("t", lines.has_words("t", least).alias("got"), count.alias("want")).collect():
            assert r.got == r.want, (r.t[:20], least)
    assert df.where("false").select(lines.has_words("t", 3)).count() == 0


def test_plan(spark, monkeypatch):
    plans = []
    kept = lines.staged

    def staged(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name)

    monkeypatch.setattr(lines, "staged", staged)
    monkeypatch.setattr(lines.in_order.__globals__["F"], "regexp_count", None)
    docs = spark.createDataFrame([(i, "one\ntwo\nthree words here\nfour\n" + "w " * 12) for i in range(5)], "doc_id long, text string")
    assert lines.dedup(docs).where("__line_kept <> text").count() == 4
    by_name = dict(plans)
    assert "transform(" not in by_name["ids"] + by_name["lines"] and "SortAggregate" not in by_name["ids"]
