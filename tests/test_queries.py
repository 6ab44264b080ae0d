import duckdb
import pytest
from conftest import SF, same_rows

import __spark_entry__
from deltaloom.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck.execute(SQL[name]))


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, capsys):
    QUERIES["flow_filter"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "GreaterThan(value" in plan and "props" not in plan


def test_text_tokens_of_odd_texts_and_ids_are_those_of_the_sql(spark, tmp_path):
    texts = [(0, None), (1, ""), (2, " -\n"), (3, "..."), (4, "the"), (5, "cat\vdog owl"), (6, "\v"), (7, "cat dog"), (7, "cat"), (7, None), (None, "cat"), (None, "a dog"), (8, "(cat)\u0085 caf\u00e9")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["text_tokens"](spark, str(tmp_path))
    same_rows(df, duck.execute(SQL["text_tokens"]))
    assert {r.doc_id: r.n for r in df.collect()} == {3: 0, 4: 0, 5: 2, 6: 0, 7: 3, None: 2, 8: 2}
