"""Descriptors compared path by path, and representations looked up."""

import pytest

from lexloom.operators import descriptors, vectors


def test_compare(spark):
    rows = [(1, '{"x":{"y":1,"z":[1,2]},"n":null,"a.b":1,"o":{}}', '{"o":{},"x":{"z":[2,1],"y":1},"n":2,"a":{"b":1}}'), (2, None, '{"p":true}'), (3, '{"q":1}', '{"q":{"r":1}}'), (4, '{"f":{"b":1,"a":2}}', '{"f":{"a":2,"b":1}}')]
    got = {(r.id, tuple(r.path)): (r.in_a, r.in_b, r.equal) for r in descriptors.compare(spark.createDataFrame(rows, "id long, a string, b string")).collect()}
    assert got == {
        (1, ("x", "y")): (True, True, True), (1, ("x", "z")): (True, True, False), (1, ("n",)): (True, True, None), (1, ("a.b",)): (True, False, None), (1, ("a", "b")): (False, True, None), (1, ("o",)): (True, True, True),
        (2, ("p",)): (False, True, None), (3, ("q",)): (True, True, False), (3, ("q", "r")): (False, True, None), (4, ("f", "a")): (True, True, True), (4, ("f", "b")): (True, True, True),
    }
    deep = spark.createDataFrame([(1, '{"a":{"b":{"c":1}}}')], "id long, json string")
    with pytest.raises(ValueError):
        descriptors.paths(deep, depth=3)
    assert descriptors.paths(deep, depth=4).count() == 4
    assert descriptors.paths(deep.limit(0)).isEmpty()


def test_lookup(spark):
    wanted = spark.createDataFrame([(1,), (2,), (9,), (1,), (3,)], "representation_id long")
    own = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "representation_id long, artifact_id string")
    parts = spark.createDataFrame([(1, "c"), (1, "a"), (2, "gone")], "representation_id long, artifact_id string")
    stored = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "artifact_id string, dim int")
    got = {r.representation_id: (r.fault, r.artifacts and [tuple(x) for x in r.artifacts]) for r in vectors.lookup(wanted, own, parts, stored).collect()}
    assert got == {1: (None, [("a", 1), ("c", 3)]), 2: ("incomplete", [("b", 2)]), 3: (None, []), 9: ("missing", None)}
