"""Values given to plans as SQL text."""

import pytest

from quern.functions.literals import double_sql, text_sql

TEXTS = ["plain", "it's", "back\\slash", 'q"uote', "é-😀", "a\nb", "%_", ""]


@pytest.mark.parametrize("raw", ["true", "false"])
def test_texts_under_both_escaping_rules(spark, tmp_path, raw):
    spark.createDataFrame([(t,) for t in TEXTS], "term string").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.parser.escapedStringLiterals", raw)
    try:
        found = df.where(f"term IN ({', '.join(map(text_sql, TEXTS[1:]))})")
        assert sorted(r.term for r in found.collect()) == sorted(TEXTS[1:])
        assert "PushedFilters: [In(term" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.parser.escapedStringLiterals")


def test_doubles(spark):
    values = [1.0, 0.1, 1.542488304274832, 123456789.123, 1e22, 1e-300, 5e-324]
    row = spark.sql(f"SELECT {', '.join(map(double_sql, values))}").first()
    assert list(row) == values
