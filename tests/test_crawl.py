"""A crawl's work on pages of like names."""

from __future__ import annotations

from factloom.plans import catalog, crawl
from tests.oracle import rows, sql_rows


def test_links_of_like_pages_are_not_formed(spark, tmp_path, monkeypatch):
    """What is written on the way has no more rows than there are pages and names, though every page links to every other."""
    pages = [(i, f"https://a.example.org/{['en', 'fr', 'de'][i % 3]}/{i}", "") for i in range(300)] + [(300 + i, f"https://a.example.org/{n}", "") for i, n in enumerate(["", "english", "french", "xyz"])] + [(400, None, "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    written, keep = [], crawl.cut
    monkeypatch.setattr(crawl, "cut", lambda df: written.append(keep(df)) or written[-1])
    got = rows(catalog.QUERIES["s07_crawl_order"](spark, str(tmp_path)).toPandas())
    (tmp_path / "sql").mkdir()
    spark.createDataFrame(pages, "page_id long, url string, html string").toPandas().to_parquet(tmp_path / "sql" / "pages.parquet")
    assert got == sql_rows(catalog.ORACLE_SQL["s07_crawl_order"], str(tmp_path / "sql"))
    assert len(got[1]) > 200 and max(df.count() for df in written) <= 2 * len(pages)
