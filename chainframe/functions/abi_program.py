"""ABI shapes compiled to column expressions.

A program holds the parameters of one shape. Decoding follows the public ABI encoding over the
payload's hex text: a static value is read at a position known when the plan is built; a dynamic
one at the position that its head word gives. Every emitted expression is JSON text, NULL where
the payload is short, padded wrongly or otherwise not decodable. Loops over elements of arrays are
the only higher-order functions; everything else compiles to straight column arithmetic.

Positions count hex digits from 1 and are numbers or columns; 64 digits are a word.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainframe.functions import abi as K
from chainframe.functions import u256 as U

_UNROLLED = 8  # fixed arrays of up to so many elements are written out
_PLAIN_HEX = r"^(2[013-9a-f]|[34][0-9a-f]|5[0-9abdef]|6[0-9a-f]|7[0-9a-e])*$"  # ASCII that JSON holds unescaped
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_BASIC = re.compile(r"address|bool|u?int(\d*)|bytes(\d+)|tuple")
At = int | Column


@dataclass
class Program:
    shape: str
    params: list[dict]  # type, name, components
    typed: bool  # tuples by component name, byte arrays in pieces
    types: str  # canonical types, for a method's text
    strings: bool  # holds a string: its text may need escapes


def compile_program(params: list[dict], typed: bool, shape: str = "") -> Program | None:
    """The program of a shape; None where only the per-row kernel can follow it."""
    if not all(_supported(p, typed) for p in params):
        return None
    strings = any("string" in K.collapse_type(p) for p in params)
    return Program(shape, params, typed, ",".join(map(K.collapse_type, params)), strings)


def _supported(p: dict, typed: bool) -> bool:
    t = p["type"] or ""
    if arr := K._array(t):
        return arr[1] != 0 and _supported({**p, "type": arr[0]}, typed)
    if t == "tuple" and typed:
        names, parts = [c["name"] or "" for c in p["components"]], p["components"]
        return bool(parts) and len(set(names)) == len(names) and all(map(_NAME.fullmatch, names)) and all(_supported(c, typed) for c in parts)
    if t in ("bytes", "string"):
        return True
    m = _BASIC.fullmatch(t)
    if not m:
        return False
    return int(m[1] or 256) in range(8, 257, 8) if m[1] is not None else int(m[2] or 1) in range(1, 33)


def arguments(program: Program, payload: Column) -> Column:
    """Values of a call's payload."""
    return _values(_Emitter(payload, program.typed).sequence(program.params, 1), payload)


def _values(values: list[Column], payload: Column) -> Column:
    """An array of values; without any, one NULL where the payload isn't hex."""
    if values:
        return F.array(*values)
    return F.when(payload.isNotNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit(None).cast("string")))


def event(program: Program, topics: list[Column], payload: Column) -> Column:
    """Values of a log: the first inputs each from a topic, the others from the payload."""
    head = [_Emitter(t, program.typed).value(p, 1) for t, p in zip(topics, program.params)]
    rest = _Emitter(payload, program.typed).sequence(program.params[len(topics) :], 1)
    # a payload that isn't hex fails even where nothing is read from it
    return _values([*[F.when(payload.isNotNull(), v) for v in head], *rest], payload)


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: fn(x)), 1)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _number(w: Column) -> Column:
    """An offset or length in bytes; NULL unless it is a whole word below 2^28."""
    small = (F.length(w) == 64) & (F.substring(w, 1, 57) == F.lit("0" * 57))
    return F.when(small, F.conv(F.substring(w, 58, 7), 16, 10).cast("int"))


def word_text(t: str, w: Column) -> Column:
    """JSON text of a one-word value; NULL for wrong padding or a short word."""
    whole = F.length(w) == 64
    if t == "address":
        return F.when(whole & (F.substring(w, 1, 24) == F.lit("0" * 24)), F.concat(F.lit('"0x'), F.substring(w, 25, 40), F.lit('"')))
    if t == "bool":
        return F.when(w == F.lit("0" * 64), F.lit("false")).when(w == F.lit("0" * 63 + "1"), F.lit("true"))
    if t == "tuple":  # as a bare type it isn't decodable
        return F.lit(None).cast("string")
    m = _BASIC.fullmatch(t)
    if m[2]:
        used = 2 * int(m[2])
        text = _quoted(F.substring(w, 1, used))
        return F.when(whole & (F.substring(w, used + 1, 64 - used) == F.lit("0" * (64 - used))) if used < 64 else whole, text)
    bits = int(m[1] or 256)
    high = (256 - bits) // 4
    if t.startswith("uint"):
        ok = whole & (F.substring(w, 1, high) == F.lit("0" * high)) if high else whole
        return F.when(ok, F.conv(F.substring(w, high + 1, 64 - high), 16, 10) if bits <= 64 else U.word_to_u256(w))
    negative = F.substring(w, high + 1, 1) >= "8"
    ok = whole
    if high:
        ok = whole & (F.substring(w, 1, high) == F.when(negative, F.lit("f" * high)).otherwise(F.lit("0" * high)))
    if bits <= 64:  # two's complement of 64 bits is a long
        low = F.conv(F.substring(w, 49, 16), 16, -10)
        return F.when(ok, low)
    inverted = U.word_to_u256(F.translate(w, "0123456789abcdef", "fedcba9876543210"))
    below = _let(inverted, lambda x: U.limbs_to_string([-l - (1 if k == 0 else 0) for k, l in enumerate(U.to_limbs(x))]))
    return F.when(ok, F.when(negative, below).otherwise(U.word_to_u256(w)))


class _Emitter:
    def __init__(self, payload: Column, typed: bool) -> None:
        self._p, self._typed = payload, typed

    def _word(self, at: At) -> Column:
        return F.substring(self._p, at, 64) if isinstance(at, int) else F.substr(self._p, at, F.lit(64))

    def _left(self, at: Column) -> Column:
        """Hex digits from a position on."""
        return F.length(self._p) - at + 1

    def sequence(self, params: list[dict], base: At) -> list[Column]:
        """Values of a tuple's parameters; offsets count from ``base``."""
        out, head = [], base
        for p in params:
            t = K.collapse_type(p)
            if K.is_dynamic(t):
                out.append(_let(_number(self._word(head)) * 2 + base, functools.partial(self.value, p)))
                head = head + 64
            else:
                out.append(self.value(p, head))
                head = head + 2 * K.static_size(t)
        return out

    def value(self, p: dict, at: At) -> Column:
        """The value whose encoding starts at a position."""
        t = p["type"]
        if arr := K._array(t):
            return self._array({**p, "type": arr[0]}, arr[1], at)
        if t == "tuple" and self._typed:
            parts = self.sequence(p["components"], at)
            texts = [x for c, v in zip(p["components"], parts) for x in (F.lit(f'"{c["name"]}": '), v, F.lit(", "))][:-1]
            return F.concat(F.lit("{"), *texts, F.lit("}"))
        if t in ("bytes", "string"):
            return self._bytes(at, lambda raw: _quoted(raw) if t == "bytes" else F.when(
                raw.rlike(_PLAIN_HEX), _quoted(F.decode(F.unhex(raw), "UTF-8"))))
        return word_text(t, self._word(at))

    def _bytes(self, at: At, shown: Callable[[Column], Column]) -> Column:
        at = F.lit(at) if isinstance(at, int) else at
        return _let(_number(self._word(at)), lambda n: F.when(
            n * 2 <= self._left(at) - 64, _let(F.substr(self._p, at + 64, n * 2), shown)))

    def _array(self, item: dict, n: int | None, at: At) -> Column:
        """An array's text: of ``n`` elements, or as many as its first word says."""
        pieces = self._typed and item["type"].startswith("byte")
        if n is not None:
            return self._elements(item, F.lit(n), n, at, pieces)
        at = F.lit(at) if isinstance(at, int) else at
        return _let(_number(self._word(at)), lambda size: F.when(size == 0, F.lit("[]")).otherwise(
            self._elements(item, size, None, at + 64, pieces)))

    def _elements(self, item: dict, n: Column, fixed: int | None, at: At, pieces: bool) -> Column:
        if pieces and K._array(item["type"]):
            return F.lit(None).cast("string")  # an array of byte arrays has no text in this mode
        t = K.collapse_type(item)
        dynamic, size = K.is_dynamic(t), 64 if K.is_dynamic(t) else 2 * K.static_size(t)
        read = (lambda where: self._pieces(item["type"], where)) if pieces else (lambda where: self.value(item, where))

        def element(k: At) -> Column:
            head = at + k * size
            if dynamic:
                return _let(_number(self._word(head)) * 2 + at, read)
            return read(head)

        if fixed is not None and fixed <= _UNROLLED and not pieces:
            texts = [x for k in range(fixed) for x in (element(k), F.lit(", "))][:-1]
            return F.concat(F.lit("["), *texts, F.lit("]"))
        start = F.lit(at) if isinstance(at, int) else at
        items = F.transform(F.sequence(F.lit(0), n - 1), element)
        if pieces:
            joined = lambda x: F.array_join(F.flatten(x), ", ")
        else:
            joined = lambda x: F.array_join(x, ", ")
        text = _let(items, lambda x: F.when(F.forall(x, lambda v: v.isNotNull()), F.concat(F.lit("["), joined(x), F.lit("]"))))
        return F.when(n * size <= self._left(start), text)  # before a sequence of that length is made

    def _pieces(self, t: str, at: At) -> Column:
        """A byte string as pieces of 64 digits, the last padded right."""
        def cut(raw: Column) -> Column:
            at = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(raw) / 64).cast("int") - 1, F.lit(0)))
            parts = F.transform(at, lambda k: _quoted(F.rpad(F.substr(raw, k * 64 + 1, F.lit(64)), 64, "0")))
            return F.when(F.length(raw) == 0, F.array().cast("array<string>")).otherwise(parts)

        if t == "bytes":
            return self._bytes(at, cut)
        text = word_text(t, self._word(at))
        return F.when(text.isNotNull(), F.array(_quoted(F.rpad(F.regexp_replace(text, '"', ""), 64, "0"))))
