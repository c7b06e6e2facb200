"""Table functions for SQL users: page links and text snippets."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from policyspark.functions.html import read_page


@udtf(returnType="pos int, href string, url string, anchor string", useArrow=True)
class PageLinks:
    """page_links(html, base_url): one row per a[href]."""

    def eval(self, html: str, base_url: str):
        for link in read_page(html, base_url, ["links"])["links"] or ():
            yield link["pos"], link["href"], link["url"], link["anchor"]


def register_sql_functions(spark: SparkSession) -> None:
    """Register ``page_links`` and the SQL function ``snippets(text)`` (array of snippets)."""
    from policyspark.vocabulary import MAX_SNIPPET_CHARS

    spark.udtf.register("page_links", PageLinks)
    edge = r"(?:(?<=[.!?])(?= )|$)"
    pattern = rf"(?s)(.{{1,{MAX_SNIPPET_CHARS}}}{edge}|.+?{edge}) ?"
    gap = r"(?U)[\s\x1c-\x1f]"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION snippets(t STRING) RETURNS ARRAY<STRING> RETURN "
        rf"flatten(transform(filter(transform(split(t, r'{gap[:4]}\n{gap[4:]}*\n'), "
        rf"p -> trim(regexp_replace(p, r'{gap}+', ' '))), p -> p != ''), "
        rf"p -> regexp_extract_all(p, r'{pattern}', 1)))"
    )
