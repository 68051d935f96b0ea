"""The keyed state of the streams: one read and at most one write per group of keys, whatever the group holds."""

from __future__ import annotations

import hashlib
from types import SimpleNamespace as Row

from ledgerline.streaming import posting as XP
from ledgerline.streaming import rates as XR


class _State:
    """A value or list state that counts its calls."""

    def __init__(self):
        self.held, self.calls = [], 0

    def _called(self, held=None):
        self.calls += 1
        self.held = self.held if held is None else held
        return self.held

    def exists(self):
        return bool(self._called())

    def get(self):
        held = self._called()
        return held[0] if isinstance(self, _Value) else iter(held)

    def update(self, value):
        self._called([value])

    def put(self, values):
        self._called(values)

    def appendValue(self, value):
        self._called([*self.held, value])


class _Value(_State):
    pass


def _with(processor, state):
    processor.init(Row(getValueState=lambda *_: state, getListState=lambda *_: state))
    return lambda rows: [*processor.handleInputRows((0,), iter(rows), None)]


def test_many_clients_of_a_window_share_their_state_calls():
    state = _Value()
    run = _with(XR._limiter(2), state)
    rows = [Row(ip=f"c{i % 50}", at=i, request=f"r{i}") for i in reversed(range(150))] + [Row(ip=None, at=None, request="none")]
    got = {r.request: r.position for r in run(rows)}
    assert got == {f"r{i}": (1 + i // 50 if i < 100 else None) for i in range(150)} | {"none": 1}
    assert state.calls <= 3
    assert [(r.request, r.position) for r in run([Row(ip="c1", at=0, request="late"), Row(ip=None, at=1, request="two")])] == [("late", None), ("two", 2)]
    assert state.calls <= 6


def _ask(rid, body):
    return Row(request_id=rid, rejected=None, body=body)


def _letter(line):
    return Row(request_id=None, rejected=hashlib.sha256(line.encode()).hexdigest(), body=line)


def test_many_ids_share_their_state_calls():
    state = _State()
    run = _with(XP._guard(), state)

    def sent(*rows):
        before = state.calls
        out = sorted(((r.request_id, r.body, r.conflict) for r in run(rows)), key=repr)
        assert state.calls - before <= 2
        return out

    first = [_ask(i, "b") for i in range(500)] + [_ask(i, "b") for i in range(0, 500, 3)] + [_ask(700, "z"), _ask(700, "y"), _ask(700, "z")]
    bad = [_letter("x"), _letter("x"), _letter("w"), Row(request_id=None, rejected=None, body="n")]
    want = [(i, "b", False) for i in range(500)] + [(700, "y", True), (None, "x", False), (None, "w", False), (None, "n", False)]
    assert sent(*first, *bad) == sorted(want, key=repr)
    assert sent(*first[:500], _letter("w")) == []
    assert sent(_ask(7, "other"), _ask(7, "third"), _ask(7, "b")) == [(7, "other", True)]
    assert sent(_ask(7, "fourth"), _ask(700, "x")) == []
    for i in range(1000, 1040):  # elements are merged from time to time, and nothing is forgotten
        assert sent(_ask(i, "b")) == [(i, "b", False)]
    assert len(state.held) <= 16
    assert sent(*first[:500], *(_ask(i, "b") for i in range(1000, 1040)), _ask(7, "x"), _letter("x"), _letter("w"), _ask(-1, "m")) == [(-1, "m", False)]
