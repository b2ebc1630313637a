import pytest

from tramline.llm.common import components


def test_unfinished_rounds_fail(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(chain, max_rounds=1)
    assert {r["component"] for r in components(chain).collect()} == {0}
