from evidentia import session
from evidentia.session import sized


def test_exchanges_have_more_parts_for_larger_tables(spark, monkeypatch):
    key = session._PARTS_KEY
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        monkeypatch.setattr(session, "PART_ROWS", 100)
        sized(spark.range(400))
        assert spark.conf.get(key, None) is None  # the session's own 4 are enough
        assert sized(spark.range(2050)).count() == 2050 and spark.conf.get(key) == "21"
        assert all(spark.conf.get(each) == size for each, size in session.PART_BYTES.items())
        sized(spark.range(500))
        assert spark.conf.get(key) == "21"  # never fewer
    finally:
        for each in session.PART_BYTES:
            spark.conf.unset(each)
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
