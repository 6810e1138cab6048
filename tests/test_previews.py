"""Previews of files with their status."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docloom.sources import files


def plain_notebook(text, n):
    parts = []
    for cell in json.loads(text)["cells"]:
        s = cell.get("source", [])
        parts.append("".join(s) if isinstance(s, list) else s)
        if len("\n".join(parts)) >= n:
            break
    return " ".join("\n".join(parts).split())[:n]


def shown(spark, rows, n=4000):
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, kind string, t string")
    return [tuple(r.p) for r in frame.select("k", files.preview(F.col("kind"), F.col("t"), n).alias("p")).orderBy("k").collect()]


def test_notebooks_stop_at_the_cell_that_fills_the_preview(spark):
    books = [
        {"cells": []},
        {"cells": [{"source": ["a\n", "b"]}, {"source": "c"}, {"cell_type": "raw"}, {"source": ["d"]}], "nbformat": 4},
        {"cells": [{"source": ["x" * 30]}, {"source": ["y" * 30]}]},
        {"cells": [{"source": "1234"}, {"source": ""}, {"source": "5678"}, {"source": "9"}]},
    ]
    for n in (5, 10, 40, 4000):
        assert shown(spark, [("ipynb", json.dumps(b)) for b in books], n) == [(plain_notebook(json.dumps(b), n), "success") for b in books]


def test_statuses(spark):
    rows = [("txt", " a\x00 b "), ("csv", "\n".join(map(str, range(40)))), ("mp4", "x"), (None, "x"), ("ipynb", "{"), ("ipynb", "[]"), ("ipynb", None), ("ipynb", "{}"), ("md", None)]
    assert shown(spark, rows) == [
        ("a b", "success"), (" ".join(map(str, range(30))), "success"), ("", "unsupported_extension"), ("", "unsupported_extension"),
        ("", "ipynb_error"), ("", "ipynb_error"), ("", "ipynb_error"), ("", "success"), ("", "success"),
    ]
