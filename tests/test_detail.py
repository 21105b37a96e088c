import pytest

from labelweave.functions.responses import classification, first_object, references
from labelweave.plans import detail
from tests.test_relational import _rows, db  # noqa: F401


@pytest.mark.parametrize("name", list(detail.SQL))
def test_query_is_its_sql(spark, sf, db, name):  # noqa: F811
    assert _rows(detail.QUERIES[name](spark, sf).toPandas()) == _rows(db.execute(detail.SQL[name]).df())


def test_answers():
    labels = ("malicious", "benign")
    assert first_object("a { b {\"x\": [1]} {\"y\": 2}") == {"x": [1]}
    assert first_object("none") is None and first_object(None) is None
    assert classification('{"label": "BENIGN", "confidence": "0.5", "rationale": "r"}', labels) == ("benign", 0.5, "r", None)
    assert classification('{"label": "benign", "confidence": 2, "rationale": "r"}', labels)[3] == "confidence"
    assert classification('{"label": "benign", "confidence": NaN, "rationale": "r"}', labels)[3] == "confidence"
    assert classification('{"label": "benign", "confidence": 1, "rationale": " "}', labels)[3] == "rationale"
    assert references({"a": [{"evidence_ids": [1, "b"]}], "evidence_edges": ["c"], "evidence_ids": "d"}) == {"1", "b", "c"}


def test_edges_of_value_nought_have_negative_weights_too(spark, tmp_path):
    """y1_edge_decode against its SQL where the value is 0: minus nought isn't negative, so the edge that must be is written as another number."""
    import duckdb

    spark.sql("SELECT id AS event_id, timestamp'2024-01-01' AS ts, id AS user_id, 'view' AS event_type, double(id DIV 4) AS value, '{\"k\": 1}' AS props FROM range(8)").write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(tuple(r) for r in detail.y1_edge_decode(spark, str(tmp_path)).collect())
    assert got == sorted(db.execute(detail.SQL["y1_edge_decode"]).fetchall())
