import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

HOUR, MINUTE, DAY0 = 3_600_000, 60_000, 1_759_000_000_000


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def iso(ms):
    from datetime import datetime, timezone

    return datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"


def edit(ms, rev, **extra):
    return {
        "meta": {"id": f"rc-{rev}", "dt": iso(ms), "stream": "mediawiki.recentchange"}, "type": "edit", "wiki": "enwiki", "namespace": 0,
        "title": f"Page {rev}", "user": "Someone", "bot": False, "timestamp": ms // 1000, "revision": {"old": rev - 1, "new": rev}, **extra,
    }


def tags(ms, rev, tags=("mw-reverted",), prior=(), **extra):
    return {
        "meta": {"id": f"tc-{rev}-{ms}", "dt": iso(ms), "stream": "mediawiki.revision-tags-change"}, "database": "enwiki", "rev_id": rev,
        "rev_timestamp": iso(ms), "page_namespace": 0, "tags": list(tags), "prior_state": {"tags": list(prior)}, **extra,
    }


def tick(ms):
    return edit(ms, 10**9 + ms % 10**9, wiki="dewiki")


def ticks(start, end, step=MINUTE):
    return [tick(ms) for ms in range(start, end + 1, step)]


def raw(spark, events):
    """Events in log order as (offset, value)."""
    rows = [(i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, "offset bigint, value string")
