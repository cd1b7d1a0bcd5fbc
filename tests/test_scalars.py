"""Scalar expressions and the schema ladder against plain Python."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.functions.json_schema import schema_error
from sessionloom.operators import state


def test_durations_are_pythons(spark):
    got = dict(spark.range(-3, 60_300).select("id", T.duration(F.col("id"))).collect())
    for ms, text in got.items():
        seconds = ms / 1000
        plain = "—" if ms <= 0 else f"{seconds:.1f}s" if seconds < 60 else f"{ms // 60_000}m{ms // 1000 % 60:02d}s"
        assert text == plain, ms
    odd = spark.createDataFrame([(None,), (2**62,)], "ms bigint").select(T.duration(F.col("ms"))).collect()
    assert odd[0][0] == "—" and odd[1][0].endswith("s")


def test_ladder(spark):
    store = {"runs": spark.createDataFrame([("a", 1)], "id string, n int")}
    done, version = state.migrate(spark, store, 1, [(2, "runs", "host", "string"), (2, "runs", "n", "string")])
    assert version == 2 and [tuple(r) for r in done["runs"].collect()] == [("a", 1, None)]
    with pytest.raises(ValueError, match="no pins"):
        state.migrate(spark, store, 1, [(3, "pins", "seen", "int")])
    assert list(store) == ["runs"] and store["runs"].columns == ["id", "n"]


def test_schema_odd_rows(spark):
    schema = {"properties": {"a": {"type": "number"}, "b": {"items": {"items": {"type": "integer"}}}}, "required": ["a"], "oneOf": []}
    told = {None: "$: no JSON", "": "$: no JSON", "{}": "$: no key a", '{"a": null}': "$.a: expected number, got null", '{"a": 1, "b": [[1], [2, "x"]]}': "$.b[1][1]: expected integer, got string", '{"a": 1e300, "b": 5}': None}
    rows = spark.createDataFrame([(t,) for t in told], "t string").select("t", schema_error(F.col("t"), schema)).collect()
    assert dict(map(tuple, rows)) == told


def test_id_shaped_keys_are_told_without_their_marks(spark):
    """One search tells what taking - and _ out, small letters and a search for id at the end tell, line ends included."""
    keys = ["".join(k) for n in range(6) for k in itertools.product("iDx-_\n\r"[: 7 if n < 5 else 4], repeat=n)] + ["id ", "ID_\u0085-", "İd", "ıd", "i_d\r_\n-", "id ", "idé"]
    k = F.col("k")
    off = spark.createDataFrame([(x,) for x in keys], "k string").where(T.id_shaped(k) != F.lower(F.regexp_replace(k, "[_-]", "")).rlike("id$"))
    assert off.collect() == []
