"""Small message frames for tests, from plain dicts through JSON."""

import json

from pyspark.sql import functions as F

from relaygrid import schemas


def binary(**changes):
    """A plain sourced message; nested values are replaced as given."""
    event = {
        "model_version": 6, "kafka_key": "k1", "timestamp": "2024-01-10T00:00:00Z",
        "author": {"name": "generic", "version": "1", "category": "plugin"},
        "source": {
            "name": "testing", "timestamp": "2024-01-10T00:00:00Z",
            "path": [{"author": {"name": "generic"}, "action": "sourced", "sha256": "aa"}],
        },
        "action": "sourced",
        "entity": {"sha256": "aa", "datastreams": [{"label": "content", "size": 1024, "file_format": "text/plain"}]},
        "flags": {"bypass_cache": False, "expedite": False, "retry": False},
    }
    event.update(changes)
    return event


def frame(spark, events, schema=schemas.BINARY, model="binary"):
    """Rows numbered by ``seq`` in the order given."""
    rows = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(events)], "seq bigint, body string")
    parsed = rows.select("seq", F.from_json("body", schema).alias("e"))
    return parsed.select("seq", F.lit(model).alias("model"), "e.*")


def statuses(spark, events):
    """Status rows with their payload in ``status``."""
    return frame(spark, events, schemas.STATUS, "status").withColumnRenamed("entity", "status")


def path_of(n, **last):
    nodes = [{"author": {"name": f"a{i}"}, "action": "extracted", "sha256": f"s{i}"} for i in range(n)]
    if nodes:
        nodes[-1].update(last)
    return nodes


def kept(df, reason):
    """seq of the rows a reason expression keeps."""
    return [r.seq for r in df.where(reason.isNull()).orderBy("seq").collect()]
