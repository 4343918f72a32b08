"""One direction of an LSTM with its emissions as an ONNX graph, written in the format's own bytes, and its onnxruntime session."""

from __future__ import annotations

import functools

import numpy as np

FLOAT, INT32 = 1, 6  # the format's element types


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(place: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _number(place << 3) + _number(value)
    value = value.encode() if isinstance(value, str) else value
    return _number(place << 3 | 2) + _number(len(value)) + value


def _attribute(name: str, value: int | bytes) -> bytes:
    """An integer, or a graph."""
    return _field(1, name) + (_field(3, value) + _field(20, 2) if isinstance(value, int) else _field(6, value) + _field(20, 5))


def _node(kind: str, takes: str, gives: str, **attributes: int | bytes) -> bytes:
    names = [_field(1, n) for n in takes.split()] + [_field(2, n) for n in gives.split()]
    return b"".join([*names, _field(4, kind), *(_field(5, _attribute(*a)) for a in attributes.items())])


def _value(name: str, kind: int, *shape: int | str) -> bytes:
    sides = b"".join(_field(1, _field(2 if isinstance(s, str) else 1, s)) for s in shape)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, sides)))


def _graph(nodes: list[bytes], takes: list[bytes], gives: list[bytes], constants: tuple[bytes, ...] = ()) -> bytes:
    parts = ((1, nodes), (2, [b"g"]), (5, constants), (11, takes), (12, gives))
    return b"".join(_field(place, v) for place, values in parts for v in values)


def lstm_graph(hidden: int, tags: int) -> bytes:
    """The steps of many rows: from the states ``h0`` and ``c0`` and the codes ``x`` (step, row), the emissions (step, tag, row) and the last states.

    Inputs are also the weights: ``in`` by code, ``re``, ``out`` (hidden, tag) and
    ``bias`` (tag, 1), with the gates i, f, o, u one after the other.
    """
    state = [_value("h", FLOAT, "n", hidden), _value("c", FLOAT, "n", hidden)]
    step = _graph(
        [
            _node("Gather", "in code", "own", axis=0),
            _node("Gemm", "h re own", "g"),
            _node("Split", "g sizes", "gi gf go gu", axis=1),
            *(_node("Tanh" if k == "u" else "Sigmoid", "g" + k, k) for k in "ifou"),
            _node("Mul", "f c", "kept"),
            _node("Mul", "i u", "new"),
            _node("Add", "kept new", "c_"),
            _node("Tanh", "c_", "tc"),
            _node("Mul", "o tc", "h_"),
            _node("Gemm", "out h_ bias", "e", transA=1, transB=1),
        ],
        [*state, _value("code", INT32, "n")],
        [_value("h_", FLOAT, "n", hidden), _value("c_", FLOAT, "n", hidden), _value("e", FLOAT, tags, "n")],
    )
    weights = [_value("in", FLOAT, "codes", 4 * hidden), _value("re", FLOAT, hidden, 4 * hidden), _value("out", FLOAT, hidden, tags), _value("bias", FLOAT, tags, 1)]
    start = [_value("h0", FLOAT, "n", hidden), _value("c0", FLOAT, "n", hidden), _value("x", INT32, "t", "n")]
    last = [_value("h1", FLOAT, "n", hidden), _value("c1", FLOAT, "n", hidden)]
    sizes = _field(1, 4) + _field(2, 7) + _field(8, "sizes") + _field(9, np.full(4, hidden, "<i8").tobytes())
    whole = _graph([_node("Scan", "h0 c0 x", "h1 c1 scores", body=step, num_scan_inputs=1)], [*start, *weights], [_value("scores", FLOAT, "t", tags, "n"), *last], (sizes,))
    return _field(1, 8) + _field(7, whole) + _field(8, _field(1, "") + _field(2, 17))


@functools.cache
def lstm_session(hidden: int, tags: int):
    """A session of one thread, kept by the process; None where onnxruntime is not installed."""
    try:
        import onnxruntime
    except ImportError:
        return None
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    return onnxruntime.InferenceSession(lstm_graph(hidden, tags), options, providers=["CPUExecutionProvider"])
