import oracle
import pytest
from oracle import SF, compare, connection

import __spark_entry__
from forumlens.plans import registry


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    compare(spark, con, registry.QUERIES[name], registry.ORACLES[name])


def test_public_records_of_null_and_empty_columns(spark, tmp_path, monkeypatch):
    """What a document or a page lacks is lacking in its record, as in the SQL; an address is found whatever letter follows."""
    texts = [None, "", "mail jo@x.org", "jo@x.orgé, jo@x.org_", "x" * 10001]
    rows = [(n, t, x, s, n) for n, (t, x, s) in enumerate((t, x, s) for t in texts for x in (None, "", "en") for s in (None, "", "by @jo"))]
    docs = spark.createDataFrame([*rows, (None, "a", "en", "s", None), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id AS page_id", "source AS url", "text AS html").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(oracle, "SF", str(tmp_path))
    for name in ("public_record", "public_posts", "redact_pii"):
        compare(spark, connection(), registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
