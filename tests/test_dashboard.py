"""The page of the dashboard: marked-up cells, order, and what is written."""

from pyspark.sql import functions as F

from taktwerk.sources import dashboard


def test_cells_escape_and_leave_gaps_empty(spark):
    rows = [("b<i>&\"'", 3, 0.125, 2.5e7, 1), (None, None, None, None, 2), ("", 0, float("nan"), float("nan"), 3), ("x" * 5000, -4, 1.5, -150000.0, 4)]
    df = spark.createDataFrame(rows, "`a.b` string, n long, s double, m double, i int")
    got = [r.html for r in dashboard.tab(df, {"a.b": "text", "n": "count", "s": "share", "m": "money"}, [F.col("i")]).orderBy("place").collect()]
    assert got[0] == '<tr><td>b&lt;i&gt;&amp;&quot;&#39;</td><td>3</td><td><i style="width:13px"></i> 12.5 %</td><td>2.5 cr</td></tr>'
    assert got[1] == "<tr><td></td><td></td><td></td><td></td></tr>" and got[2] == "<tr><td></td><td>0</td><td></td><td></td></tr>"
    assert got[3] == f'<tr><td>{"x" * 5000}</td><td>-4</td><td><i style="width:100px"></i> 150.0 %</td><td>-1.5 L</td></tr>'


def test_the_first_rows_of_many(spark):
    got = dashboard.tab(spark.range(10_000), {"id": "count"}, [F.col("id").desc()], top=7).collect()
    assert sorted((r.place, r.html) for r in got) == [(i + 1, f"<tr><td>{9999 - i}</td></tr>") for i in range(7)]


def test_page_is_one_file_in_order(spark, tmp_path):
    some = dashboard.tab(spark.range(12), {"id": "count"}, [F.col("id")])
    none = dashboard.tab(spark.range(0), {"id": "count"}, [F.col("id")])
    dashboard.write_page("A & B", {"One": (["id"], some), "Two <2>": (["id"], none)}, str(tmp_path / "page"))
    files = list((tmp_path / "page").glob("part-*"))
    lines = files[0].read_text().splitlines()
    assert len(files) == 1 and "<title>A &amp; B</title>" in lines[0] and len(lines) == 1 + (1 + 12 + 1) + (1 + 1 + 1)
    assert lines[2:14] == [f"<tr><td>{i}</td></tr>" for i in range(12)]
    assert "Two &lt;2&gt;" in lines[15] and lines[16] == "<tr><td>nothing yet</td></tr>" and lines[17] == "</table></details>"
