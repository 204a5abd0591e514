"""What the contracts fix, of the queries themselves."""

import duckdb

from curatrix.llm import queries


def test_op3_verdicts_of_the_contract(spark, tmp_path):
    """Each rule of the contract, its host's subdomain and its neighbours; SQL says the same."""
    want = {
        "https://shop.com/en/1": ("com/en/", "block"),
        "https://www.example.com/en/77": ("example.com/en/7", "allow"),
        "https://example.com/en/6": ("com/en/", "block"),
        "https://shop.net/de/8": ("net/de/", "allow"),
        "https://example.net/de/1": ("net/de/", "allow"),
        "https://example.net/de/8": ("example.net/de/8", "block"),
        "https://www.Example.NET/de/80": ("example.net/de/8", "block"),
        "https://a.org/es/x": ("org/es/", "block"),
        "https://a.org/en/x": (None, "allow"),
    }
    spark.createDataFrame([(i, u, "") for i, u in enumerate(want)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op3_url_filter(spark, str(tmp_path)).select("page_id", "rule", "verdict").collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == dict(enumerate(want.values()))
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    told = db.sql(queries.oracle_sql()["op3_url_filter"]).fetchall()
    assert {r[0]: (r[3], r[4]) for r in told} == dict(enumerate(want.values()))
