"""A dashboard as one page of HTML: each tab is the first rows of a table, made into marked-up text by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.sources.lines import inr

TEXT, COUNT, SHARE, MONEY = "text", "count", "share", "money"
STYLE = "body{font:14px sans-serif}table{border-collapse:collapse}td,th{padding:3px 9px;text-align:left}i{display:inline-block;height:9px;background:#37a}"


def escaped(text: Column) -> Column:
    """The text with the five characters that mean something in HTML as references."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def cell(value: Column, kind: str) -> Column:
    """A cell: text escaped, a count as a whole number, a share as a bar and its per cent, money in lakh and crore; null and NaN give an empty one."""
    if kind == SHARE:
        part = F.round(value * 100, 1)
        wide = F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 100).cast("long")
        inner = F.when(~F.isnan(value), F.concat(F.lit('<i style="width:'), wide.cast("string"), F.lit('px"></i> '), part.cast("string"), F.lit(" %")))
    elif kind == MONEY:
        inner = F.when(~F.isnan(value), inr(value))
    else:
        inner = escaped((value.cast("long") if kind == COUNT else value).cast("string"))
    return F.concat(F.lit("<td>"), F.coalesce(inner, F.lit("")), F.lit("</td>"))


def tab(df: DataFrame, columns: dict[str, str], order: list[Column], top: int = 200) -> DataFrame:
    """(place, html): the first `top` rows by `order`, which must be total, as table rows from place 1 on.

    columns gives each shown column its kind: text, count, share (of 1) or money. The limit is what a page shows; each task keeps its own first rows,
    so only parts * top rows meet, and `top` of them are numbered.
    """
    first = df.orderBy(*order).limit(top)
    number = F.row_number().over(Window.orderBy(*order)).cast("long")  # over `top` rows
    cells = F.concat(F.lit("<tr>"), *(cell(F.col(f"`{c}`"), kind) for c, kind in columns.items()), F.lit("</tr>"))
    return first.select(number.alias("place"), cells.alias("html"))


def page(title: str, tabs: dict[str, tuple[list[str], DataFrame]]) -> DataFrame:
    """(value): the lines of the page in order, in one part: tabs gives each name its headers and the rows of `tab`; an empty one says so."""
    spark = next(iter(tabs.values()))[1].sparkSession

    def line(section: int, place: int, html: Column) -> DataFrame:
        return spark.range(1).select(F.lit(section).alias("section"), F.lit(place).cast("long").alias("place"), html.alias("value"))

    head = [F.lit("<!doctype html><meta charset=utf-8><title>"), escaped(F.lit(title)), F.lit(f"</title><style>{STYLE}</style>")]
    out = line(-1, 0, F.concat(*head))
    last = 2**62
    for i, (name, (headers, rows)) in enumerate(tabs.items()):
        open_ = F.concat(F.lit("<details open><summary>"), escaped(F.lit(name)), F.lit("</summary><table><tr>"), *(F.concat(F.lit("<th>"), escaped(F.lit(h)), F.lit("</th>")) for h in headers), F.lit("</tr>"))
        shown = rows.select(F.lit(i).alias("section"), "place", F.col("html").alias("value"))
        nothing = rows.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(i).alias("section"), F.lit(1).cast("long").alias("place"), F.lit("<tr><td>nothing yet</td></tr>").alias("value"))
        out = out.union(line(i, 0, open_)).union(shown).union(nothing).union(line(i, last, F.lit("</table></details>")))
    return out.repartition(1).sortWithinPartitions("section", "place").select("value")


def write_page(title: str, tabs: dict[str, tuple[list[str], DataFrame]], path: str) -> None:
    """The page as one text file in the folder `path`, written by an executor."""
    page(title, tabs).write.mode("overwrite").text(path)
