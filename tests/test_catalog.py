"""The catalog surface: names, statements, scripts, files, bounded results."""

import pandas as pd
import pytest

from cairn.sources import catalog

TANKS = [("north", 40, 12.25), ("south", 55, 3.5), ("west", 55, None), ("east", 7, 88.0)]


@pytest.fixture
def tanks(spark):
    df = spark.createDataFrame(TANKS, "site string, depth int, level double")
    return catalog.load_dataframe(spark, df, "tanks")


def test_the_session_can_checkpoint(spark):
    assert spark.sparkContext.getCheckpointDir()


def test_registered_frames_answer_statements(spark, tanks):
    rows = catalog.query(spark, "SELECT depth, count(level) AS known, sum(level) AS total FROM tanks GROUP BY depth")
    assert {r["depth"]: (r["known"], r["total"]) for r in rows.collect()} == {40: (1, 12.25), 55: (1, 3.5), 7: (1, 88.0)}
    best = catalog.query(spark, "SELECT site, dense_rank() OVER (ORDER BY depth DESC) AS place FROM tanks")
    assert sorted(r["site"] for r in best.collect() if r["place"] == 1) == ["south", "west"]
    assert catalog.table(spark, "tanks").columns == ["site", "depth", "level"]


def test_parameters_and_replacement(spark, tanks):
    deep = catalog.query(spark, "SELECT site FROM tanks WHERE depth > :least", {"least": 50})
    assert {r["site"] for r in deep.collect()} == {"south", "west"}
    catalog.load_dataframe(spark, pd.DataFrame({"site": ["only"], "depth": [1], "level": [0.5]}), "tanks")
    assert [r["site"] for r in catalog.table(spark, "tanks").collect()] == ["only"]


def test_scripts_run_in_order(spark, tanks):
    done = catalog.run_sql_script(spark, "CREATE OR REPLACE TEMP VIEW low AS SELECT * FROM tanks WHERE level < 20; "
                                         "SELECT count(*) AS n FROM low -- the end;")
    assert len(done) == 2 and done[-1].first()["n"] == 2
    assert catalog.run_sql_script(spark, " ; -- nothing") == []


def test_split_statements_respects_quotes_and_comments():
    script = """-- a comment; with a semicolon
    SELECT 'a;b' AS x;   /* block; comment */
    SELECT "c;d" AS y;;
    SELECT 1 -- trailing; comment
    """
    parts = catalog.split_statements(script)
    assert len(parts) == 3
    assert "'a;b'" in parts[0]
    assert '"c;d"' in parts[1]


def test_csv_types_and_script_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("site;depth;built\nnorth;40;2001-05-06\nsouth;;1999-12-31\n")
    df = catalog.load_csv(spark, str(tmp_path / "t.csv"), "built", sep=";")
    assert dict(df.dtypes) == {"site": "string", "depth": "int", "built": "date"}
    (tmp_path / "q.sql").write_text("SELECT max(built) AS last FROM built WHERE depth IS NOT NULL;")
    assert str(catalog.run_sql_file(spark, str(tmp_path / "q.sql"))[0].first()["last"]) == "2001-05-06"
    text = catalog.load_csv(spark, str(tmp_path / "t.csv"), "raw", sep=";", infer_schema=False)
    assert set(dict(text.dtypes).values()) == {"string"}


def test_to_pandas_bounded_refuses_large(spark):
    with pytest.raises(ValueError):
        catalog.to_pandas_bounded(spark.range(100), limit=10)


def test_logical_views_answer_sql(spark, sf_small):
    from pyspark.sql import functions as F

    from cairn.operators import sales
    from cairn.sources.tables import DriverTables, register_views
    register_views(spark, sf_small)
    got = catalog.query(spark, """
        SELECT DATE_TRUNC('month', o.order_date) AS month, COUNT(DISTINCT o.order_id) AS total_orders
        FROM orders o JOIN order_items oi ON o.order_id = oi.order_id
        WHERE o.status = 'completed' GROUP BY 1""").orderBy("month").toPandas()
    t = DriverTables(spark, sf_small)
    exp = sales.monthly_revenue(t.orders(), t.order_items()).select(
        F.col("month").cast("timestamp"), "total_orders").toPandas()
    assert list(got.total_orders) == list(exp.total_orders)
