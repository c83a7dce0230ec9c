import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tracefeat.session import get_spark
    s = get_spark(shuffle_partitions=8, app="tracefeat-tests")
    yield s
    s.stop()


LOG_SCHEMA = ("row_id long, user_id long, timestamp long, content_id int, content_type_id int, "
              "task_container_id int, user_answer int, answered_correctly int, prior_question_elapsed_time double, "
              "prior_question_had_explanation boolean, part int, tags string")


def make_log(spark, rows):
    """rows: dicts with at least row_id, user_id, timestamp; the rest defaults."""
    base = dict(content_id=1, content_type_id=0, task_container_id=0, user_answer=0, answered_correctly=1,
                prior_question_elapsed_time=1000.0, prior_question_had_explanation=False, part=1, tags="1")
    full = []
    for r in rows:
        d = {**base, **r}
        full.append(tuple(d[c.split()[0]] for c in LOG_SCHEMA.split(", ")))
    return spark.createDataFrame(full, LOG_SCHEMA)
