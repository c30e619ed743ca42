import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from weaklabel.session import get_spark
    scratch = tempfile.mkdtemp(prefix="weaklabel-test-")
    s = get_spark(master="local[4]", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def mini_corpus(spark):
    rows = [(1, "apple banana apple apple apple", "a"), (2, "apple cherry", "a"),
            (3, "banana dog", "b"), (4, "dog dog eel", "b"), (5, "fig apple", "c")]
    return spark.createDataFrame(rows, "doc_id bigint, sentence string, label string")
