"""ABI kernel: golden vectors from the reference, and encode → decode round trips with a
small test-side encoder of the public ABI spec."""

import json

import pytest

from chainframe.functions import abi as K
from chainframe.functions.evm import push4_selectors_py


def test_tron_golden_vector():
    assert K.hex_to_tron("000000000000000000000000a2c2426d23bb43809e6eba1311afddde8d45f5d8") == "TQooBX9o8iSSprLWW96YShBogx7Uwisuim"


def test_collapse_tuple():
    p = {"type": "tuple", "components": [{"type": "address"}, {"type": "uint256"}, {"type": "bytes"}]}
    assert K.collapse_type(p) == "(address,uint256,bytes)"


def _w(n: int) -> bytes:
    return (n % (1 << 256)).to_bytes(32, "big")


def enc(types, values) -> bytes:
    heads, tails = [], []
    size = sum(32 if K.is_dynamic(t) else K.static_size(t) for t in types)
    for t, v in zip(types, values):
        if K.is_dynamic(t):
            heads.append(_w(size + sum(len(x) for x in tails)))
            tails.append(enc_one(t, v))
        else:
            heads.append(enc_one(t, v))
    return b"".join(heads) + b"".join(tails)


def enc_one(t, v) -> bytes:
    arr = K._array(t)
    if arr:
        base, n = arr
        body = enc([base] * len(v), v)
        return body if n is not None else _w(len(v)) + body
    if t.startswith("("):
        return enc(K._split_tuple(t), v)
    if t in ("bytes", "string"):
        raw = v.encode() if t == "string" else v
        return _w(len(raw)) + raw + b"\0" * (-len(raw) % 32)
    if t == "address":
        return b"\0" * 12 + bytes.fromhex(v[2:])
    if t == "bool":
        return _w(int(v))
    if t.startswith("bytes"):
        return v + b"\0" * (32 - len(v))
    return _w(v)


CASES = [
    (["address", "uint256"], ["0x" + "ab" * 20, 10 ** 30]),
    (["string", "uint8[]", "bytes"], ["héllo", [1, 2, 3], b"\x01\x02"]),
    (["(address,uint256,bytes)", "int256"], [("0x" + "01" * 20, 5, b"xyz"), -7]),
    (["uint256[2][]", "bytes32"], [[[1, 2], [3, 4]], b"\x11" * 32]),
    (["string[]", "bool"], [["a", "bc"], True]),
]


@pytest.mark.parametrize("types,values", CASES)
def test_round_trip(types, values):
    got = K.decode_tuple(types, enc(types, values))
    norm = json.loads(json.dumps([K._jsonable(x) for x in got]))
    exp = json.loads(json.dumps([K._jsonable(x) for x in values]))
    assert norm == exp


def test_short_and_dirty_payloads_raise():
    with pytest.raises(K.AbiError):
        K.decode_tuple(["uint256", "uint256"], _w(1))
    with pytest.raises(K.AbiError):
        K.decode_tuple(["address"], b"\x01" + b"\0" * 31)


def test_typed_decode_json_shape():
    abi = json.dumps({"name": "f", "type": "function", "inputs": [
        {"name": "p", "type": "tuple", "components": [{"name": "a", "type": "address"}, {"name": "n", "type": "uint256"}]},
        {"name": "b", "type": "bytes"}]})
    data = "0x12345678" + enc(["(address,uint256)", "bytes"], [("0x" + "0f" * 20, 9), b"\xab"]).hex()
    out = json.loads(K.decode_input_typed(abi, data))
    assert out == {"method": "f((address,uint256),bytes)", "parameter": {"p": {"a": "0x" + "0f" * 20, "n": 9}, "b": "ab"}}


def test_indexed_and_log_decode():
    abi = json.dumps({"name": "Transfer", "type": "event", "inputs": [
        {"name": "from", "type": "address", "indexed": True}, {"name": "", "type": "uint256", "indexed": False},
        {"name": "to", "type": "address", "indexed": True}]})
    topics = "[0xdd,0x" + "00" * 12 + "aa" * 20 + ",0x" + "00" * 12 + "bb" * 20 + "]"
    out = json.loads(K.decode_log(abi, topics, "0x" + _w(42).hex()))
    assert out["parameter"] == {"from": "0x" + "aa" * 20, "to": "0x" + "bb" * 20, "__idx_2": 42,
                                "__idx_0": "0x" + "aa" * 20, "__idx_1": "0x" + "bb" * 20}
    assert out["method"] == "Transfer(address from, address to, uint256 )"


def test_push4_walk_skips_push_data():
    code = "0x6080604052" + "63a9059cbb14" + "7f" + "63095ea7b3".ljust(64, "0") + "00"
    assert push4_selectors_py(code) == ["0xa9059cbb"]


NATIVE_CASES = [
    (["address", "uint256", "bool"], ["0x" + "ab" * 20, 2 ** 256 - 1, True]),
    (["int8", "int256", "uint64", "bytes4", "bytes32"], [-128, -(2 ** 255), 2 ** 64 - 1, b"abcd", b"\x11" * 32]),
    (["bytes", "string", "uint16[]"], [b"\x00\xff" * 40, "plain text (ASCII) {}", [1, 2, 65535]]),
    (["address[]", "int32[]", "bool[]", "bytes"], [["0x" + "01" * 20], [-1, 5], [], b""]),
    (["string", "uint8"], ["quote \" and back\\slash", 3]),  # left to the kernel
    (["(address,uint256)", "bytes32[]"], [("0x" + "02" * 20, 9), [b"\x01" * 32, b"\x02" * 32]]),
    (["(address,(bool,bytes)[],uint8)", "int24"], [("0x" + "03" * 20, [(True, b"ab"), (False, b"")], 7), -5]),
    (["uint256[2][]", "bytes[]", "int128[3]"], [[[1, 2 ** 255], [3, 4]], [b"\x05" * 33, b"", b"z"], [-1, 0, 2 ** 127 - 1]]),
    (["bytes4[2]", "(uint8,(uint8,bytes3))[2]", "bool[9]"], [[b"abcd", b"efgh"], [(1, (2, b"xyz")), (3, (4, b"abc"))], [True] * 9]),
    (["uint8[][]", "(string,string[])"], [[[1], [], [2, 3]], ("in a tuple", ["a", "b c"])]),
    (["bytes2[][]", "int64", "int56"], [[[b"ab"]], -(2 ** 63), 2 ** 55 - 1]),
    ([], []),
]


def _tuple(name, t):
    """A parameter of a canonical type; tuples with named components."""
    if not t.startswith("("):
        return {"name": name, "type": t}
    end = t.rindex(")") + 1
    return {"name": name, "type": "tuple" + t[end:], "components": [_tuple(f"c{k}", x) for k, x in enumerate(K._split_tuple(t[:end]))]}


def _abi(types):
    inputs = []
    for i, t in enumerate(types):
        p = {"name": f"p{i}", "type": t}
        if t.startswith("("):
            p = _tuple(f"p{i}", t)
        inputs.append(p)
    return json.dumps({"name": "f", "type": "function", "inputs": inputs})


def test_native_decoding_equals_the_kernel(spark):
    from chainframe.operators import abi_jobs as AJ

    sigs, txs = [], []
    for n, (types, values) in enumerate(NATIVE_CASES):
        address, abi = f"0x{n:040x}", _abi(types)
        sigs.append((address, "0x12345678", abi, "f(...)"))
        body = enc(types, values).hex()
        hostile = ["f" * 64 + body[64:], body[:64 * len(types)], body[:-2], "", body + "zz", body[:64] + "f" * 64 + body[128:], body.upper()]
        for k, b in enumerate([body, *hostile]):
            txs.append((f"{n}-{k}", address, "0x12345678" + b))
    s = spark.createDataFrame(sigs, "address string, byte_sign string, abi string, prototype string")
    t = spark.createDataFrame(txs + [("x", "0x" + "9" * 40, "0x12345678"), ("y", None, None)], "txhash string, to_address string, input string")
    abi_of = {a: b for a, _, b, _ in sigs}
    for mode in ("typed", "indexed", "lookup"):
        got = {r.txhash: r.decoded for r in AJ.decode_inputs(t, s, mode=mode).collect()}
        assert len(got) == len(txs) + 2
        assert got["x"] == got["y"] == "{}"
        for h, address, data in txs:
            try:
                want = (K.decode_input_typed(abi_of[address], data) if mode == "typed"
                        else K.decode_input_indexed(abi_of[address], data, "f(...)" if mode == "lookup" else None))
            except Exception:  # noqa: BLE001
                want = "{}"
            assert got[h] == want, (mode, h, data)


def test_only_escapes_repeated_names_and_rare_shapes_reach_the_kernel(spark, monkeypatch):
    from chainframe.operators import abi_jobs as AJ

    def plan(cases, names=None):
        sigs = [(f"0x{n:040x}", "0x12345678", names or _abi(types), "f(...)") for n, (types, _) in enumerate(cases)]
        s = spark.createDataFrame(sigs, "address string, byte_sign string, abi string, prototype string")
        t = spark.createDataFrame([("h", "0x" + "0" * 40, "0x12345678")], "txhash string, to_address string, input string")
        return AJ.decode_inputs(t, s)._jdf.queryExecution().executedPlan().toString()

    without = [c for c in NATIVE_CASES if not any("string" in t for t in c[0])]
    assert "ArrowEvalPython" not in plan(without) and len(without) > 7
    assert "ArrowEvalPython" in plan([(["string"], [""])])
    twice = json.dumps({"name": "f", "inputs": [{"name": "a", "type": "bool"}] * 2})
    assert "ArrowEvalPython" in plan([(["bool"], [True])], twice)
    monkeypatch.setattr(AJ, "MOST_PROGRAMS", 2)
    assert "ArrowEvalPython" in plan(without)


def test_events_equal_the_kernel(spark):
    from chainframe.operators import abi_jobs as AJ

    word = "0x" + "00" * 12 + "aa" * 20
    events = {
        "plain": [("from", "address", True), ("to", "address", True), ("value", "uint256", False)],
        "hashed": [("s", "string", True), ("xs", "uint8[]", True), ("n", "int16", False), ("b", "bytes", False)],
        "nested": [("rows", "uint256[2][]", False), ("who", "address", True)],
        "four": [("a", "bool", False), ("b", "bool", False), ("c", "bool", False), ("d", "uint8", False)],
        "none": [],
    }
    bodies = {"plain": enc(["uint256"], [7]), "hashed": enc(["int16", "bytes"], [-3, b"xy"]), "nested": enc(["uint256[2][]"], [[[1, 2]]]),
              "four": enc(["bool"] * 3 + ["uint8"], [True, False, True, 9]), "none": b""}
    sigs, logs = [], []
    for k, (name, inputs) in enumerate(events.items()):
        kind = "event" if name != "four" else "function"
        abi = json.dumps({"name": name, "type": kind, "inputs": [{"name": n, "type": t, "indexed": i} for n, t, i in inputs]})
        sigs.append((f"0x{k}", "0xdd", abi, f"{name}(...)"))
        for n in range(6):
            for data in ("0x" + bodies[name].hex(), "0x", "0xzz", "0x" + "00" * 160):
                for zero in (word, "0x" + "00" * 32, "0x12"):
                    logs.append((len(logs), f"0x{k}", "[" + ",".join(["0xdd", *[zero] * n]) + "]", data))
    logs.append((len(logs), "0x0", None, "0x"))
    s = spark.createDataFrame(sigs, "address string, byte_sign string, abi string, prototype string")
    x = spark.createDataFrame(logs, "id long, address string, topics string, data string")
    abi_of = {a: (b, p) for a, _, b, p in sigs}
    for lookup in (False, True):
        got = {r.id: r.decoded for r in AJ.decode_logs(x, s, lookup=lookup).collect()}
        for i, address, topics, data in logs:
            abi, proto = abi_of[address]
            try:
                want = K.decode_log(abi, topics, data, proto if lookup else None, check_type=not lookup)
            except Exception:  # noqa: BLE001
                want = "{}"
            assert got[i] == want, (lookup, address, topics, data)


def test_byte_arrays_are_lists():
    out = json.loads(K.decode_input_typed(_abi(["bytes32[]", "bytes[]"]), "0x12345678" + enc(
        ["bytes32[]", "bytes[]"], [[b"\x01" * 32, b"\x02" * 32], [b"\x03" * 33]]).hex()))
    assert out["parameter"]["p0"] == ["01" * 32, "02" * 32]
    assert out["parameter"]["p1"] == ["03" * 32, "03".ljust(64, "0")]
