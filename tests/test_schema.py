"""Errors and collection declarations."""

import pytest

from keelstate import errors
from keelstate.errors import Invalid
from keelstate.schema import CollectionSpec, StateSchema, collection, derive, state


@pytest.mark.parametrize(
    "error, text",
    [
        (errors.IoError("disk full"), "I/O error: disk full"),
        (errors.CodecError("short"), "codec error: short"),
        (errors.NotFound("user", "u1"), "user not found: u1"),
        (errors.AlreadyExists("user", "u1"), "user already exists: u1"),
        (errors.Invalid("email", "no @"), "invalid email: no @"),
        (errors.LogCorrupted(7, "bad magic"), "WAL corrupted at offset 7: bad magic"),
        (errors.SnapshotVersion(9, 1), "snapshot version mismatch: got 9, expected 1"),
    ],
)
def test_texts(error, text):
    assert str(error) == text and isinstance(error, errors.StoreError)


@pytest.mark.parametrize(
    "args",
    [
        (256, "a", "k string", "v string"),
        (-1, "a", "k string", "v string"),
        (True, "a", "k string", "v string"),
        (0, "a b", "k string", "v string"),
        (0, "_a", "k string", "v string"),
        (0, "a", "k double", "v string"),
        (0, "a", "k array<int>", "v string"),
        (0, "a", "k string", "k string"),
        (0, "a", "k string", "op_idx long"),
    ],
)
def test_bad_collections(spark, args):
    with pytest.raises(Invalid):
        CollectionSpec(*args)


def test_bad_states():
    with pytest.raises(Invalid, match="at least one"):
        StateSchema([])
    with pytest.raises(Invalid, match="duplicate collection id"):
        state(a=(0, "k string", "v string"), b=(0, "k string", "v string"))
    with pytest.raises(Invalid, match="derived"):
        StateSchema([CollectionSpec(0, "a", "k string", "v string")], {"a": lambda s: s["a"]})


def test_routing_and_lookup():
    schema = state(a=(0, "k string", "v string"), b=(7, "k long", "v string", False))
    assert schema.routed(7).name == "b" and schema.routed(99) is None
    assert not schema["b"].ordered
    with pytest.raises(Invalid):
        schema["c"]


def test_keys_and_values():
    spec = CollectionSpec(0, "a", "k int, j string", "x long, y string")
    assert spec.key_of((1, "b")) == (1, "b")
    assert spec.value_of({"y": "t", "x": 2}) == (2, "t")
    for bad in ((1, None), 1, (1 << 31, "b"), ("1", "b"), (True, "b")):
        with pytest.raises(Invalid):
            spec.key_of(bad)
    for bad in ({"x": 1}, (1, 2, 3), 5):
        with pytest.raises(Invalid):
            spec.value_of(bad)


def test_derived_schemas():
    @derive
    class Todos:
        items = collection(0, "k string", "title string, done boolean")
        hits = collection(3, "k long", "n long", ordered=False)
        cache = {}

        def open_items(state):
            return state["items"].filter("not done")

    assert [(s.id, s.name, s.ordered) for s in Todos.collections] == [(0, "items", True), (3, "hits", False)]
    assert list(Todos.derived) == ["open_items"]
    for bad in (type("E", (), {}), type("T", (), {"a": collection(0, "k int", "v int"), "b": collection(0, "k int", "v int")}), 5):
        with pytest.raises(Invalid):
            derive(bad)
