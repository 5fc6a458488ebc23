"""Page queries against their SQL on pages that the given tables do not hold."""

import duckdb
import pandas as pd
import pytest
from newsloom.plans import QUERIES, SQL

PARAGRAPH = "One two three four five six seven eight nine ten."
HTML = [
    f"<h1>A &amp;&amp; B&amp</h1><article><p>{PARAGRAPH} &amp;&amp</p><p>{PARAGRAPH} &eacute;&#8212;&copy; x</p></article>",
    f"<title>T</title><body><p>{PARAGRAPH}</p></body>",
    f"<ARTICLE class='x'><p>{PARAGRAPH}\x01 a\x0bb\xa0c &lt;i&gt;  </p><br/>{PARAGRAPH} ",
    f"<articleé><h2>{PARAGRAPH}</h2><pé>{PARAGRAPH}</article \x0b> {PARAGRAPH}</article> after",
    f"<article><nav>menu</nav><p>{PARAGRAPH}<!-- no --> &amp;lt; &quot;q&quot; &#39;</p><h1\n>H &nbsp; 1</h1>",
    "", "<article></article>",
    None,
]
LONG = "https://example.com/" + "x" * 500


@pytest.mark.parametrize("name", ["html_article", "html_paragraphs", "html_titles", "normalized_pages", "longest_extraction"])
def test_odd_pages_agree_with_sql(spark, tmp_path, name):
    urls = [LONG if i % 3 == 1 else f"https://example.com/a b/{i} " for i in range(len(HTML))]
    pd.DataFrame({"page_id": range(len(HTML)), "url": urls, "html": HTML}).to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet')")
    query = f"SELECT * FROM ({SQL[name]}) ORDER BY page_id"
    want, names = con.execute(query).fetchall(), [c[0] for c in con.description]
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*names).orderBy("page_id").collect()]
    assert got == want
