"""Exact uint256 (and signed 256-bit) arithmetic as Catalyst expressions — no Python UDF.

Storage: canonical base-10 STRING. Compute: five little-endian base-10^18 limbs
(``DECIMAL(38,0)``), 90 digits in total, enough for 2^256 (78 digits) plus carries.

* ``to_limbs``    string → limb columns (a leading ``-`` negates every limb)
* ``to_parts``    string → ten LONG columns, for sums by keys that are many
* ``sum_u256``    one built-in ``sum()`` per limb (partial/final hash aggregation with map-side
                  combine), then a single carry pass on the grouped rows
* ``limbs_to_string`` carry/borrow pass with ``aggregate()`` over the limb array (expression
                  size linear in limbs), sign from the top carry, canonical string out
* ``hex_to_u256`` Horner over 64-bit words (``conv`` is exact to 64 bits) in limb space
* ``order_key``   fixed-width key whose string order equals numeric order
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NLIMBS = 5
LIMB_DIGITS = 18
BASE = 10 ** LIMB_DIGITS
WIDTH = NLIMBS * LIMB_DIGITS
DEC = "decimal(38,0)"
MAX_U256 = 2 ** 256 - 1
_TWO64 = 2 ** 64


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _padded(digits: Column, width: int) -> Column:
    """Left-padded with zeros; more than ``width`` digits give NULL instead of a prefix."""
    return F.when(F.length(digits) <= width, F.lpad(digits, width, "0"))


def to_limbs(col) -> list[Column]:
    """Limb columns (least significant first) of a decimal string; NULL stays NULL, and a
    number of more than 90 digits is NULL."""
    c = _c(col)
    neg = c.startswith("-")
    padded = _padded(F.regexp_replace(c, r"^[-+]", ""), WIDTH)
    out = []
    for k in range(NLIMBS):
        limb = F.substring(padded, WIDTH - LIMB_DIGITS * (k + 1) + 1, LIMB_DIGITS).cast(DEC)
        out.append(F.when(neg, -limb).otherwise(limb))
    return out


def to_parts(col) -> list[Column]:
    """Ten LONG columns of nine digits each (least significant first) of a decimal string: a sum of
    them takes 8 bytes in an aggregate, and over nine billion rows fit a key. NULL as ``to_limbs``."""
    c = _c(col)
    neg = c.startswith("-")
    padded = _padded(F.when(neg | c.startswith("+"), F.substring(c, 2, 2 ** 31 - 1)).otherwise(c), WIDTH)
    out = []
    for k in range(2 * NLIMBS):
        part = F.substring(padded, WIDTH - 9 * (k + 1) + 1, 9).cast("long")
        out.append(F.when(neg, -part).otherwise(part))
    return out


def limbs_of_parts(parts: list) -> list[Column]:
    """Limbs of (summed) parts, to be carried by ``limbs_to_string``."""
    p = [_c(x).cast(DEC) for x in parts]
    return [(p[2 * k + 1] * F.lit(10 ** 9).cast("decimal(10,0)") + p[2 * k]).cast(DEC) for k in range(NLIMBS)]


def _normalize(arr: Column) -> Column:
    """Carry-normalise a little-endian limb array → struct(c: top carry, o: limbs in [0, B))."""
    b = F.lit(str(BASE)).cast(DEC)
    init = F.struct(F.lit(0).cast(DEC).alias("c"), F.array().cast(f"array<{DEC}>").alias("o"))

    def merge(acc, x):
        t = (x + acc["c"]).cast(DEC)
        r = F.pmod(t, b).cast(DEC)
        return F.struct(((t - r) / b).cast(DEC).alias("c"), F.array_append(acc["o"], r).alias("o"))

    return F.aggregate(arr, init, merge)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` refers to it."""
    return F.transform(F.array(value), body)[0]


def _render(norm: Column) -> Column:
    """Non-negative normalised struct → canonical decimal string (two references to ``norm``)."""
    body = F.array_join(F.transform(F.reverse(norm["o"]), lambda x: F.lpad(x.cast("string"), LIMB_DIGITS, "0")), "")
    head = F.when(norm["c"] > 0, norm["c"].cast("string")).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(head, body), r"^0+(?=.)", "")


def limbs_to_string(limbs: list) -> Column:
    """Canonical signed decimal string of a limb vector (limbs may be any sign/size < 10^37)."""
    cols = [_c(x).cast(DEC) for x in limbs]
    neg = _normalize(F.array(*[-x for x in cols]))
    out = _let(_normalize(F.array(*cols)), lambda pos: F.when(
        pos["c"] < 0, F.concat(F.lit("-"), _let(neg, _render))).otherwise(_render(pos)))
    if len(cols) > 1:  # what two limbs hold fits one decimal
        b = F.lit(str(BASE)).cast(DEC)
        low = functools_and([x == 0 for x in cols[2:]] + [F.abs(cols[1]) < b])
        out = F.when(low, (cols[1] * b + cols[0]).cast(DEC).cast("string")).otherwise(out)
    any_null = functools_or([x.isNull() for x in cols])
    return F.when(any_null, F.lit(None).cast("string")).otherwise(out)


def functools_or(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def functools_and(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def canonical(col) -> Column:
    """Normalise a decimal string (strip sign '+', leading zeros; '-0' → '0')."""
    return limbs_to_string(to_limbs(col))


def add(a, b) -> Column:
    return limbs_to_string([x + y for x, y in zip(to_limbs(a), to_limbs(b))])


def sub(a, b) -> Column:
    """Signed ``a - b`` as a canonical string."""
    return limbs_to_string([x - y for x, y in zip(to_limbs(a), to_limbs(b))])


def combine(terms: list[tuple[int, object]]) -> Column:
    """Signed linear combination Σ sign·x of decimal strings (NULL terms count as 0)."""
    acc = None
    for sign, col in terms:
        ls = [F.coalesce(x, F.lit(0).cast(DEC)) for x in to_limbs(col)]
        ls = [x if sign > 0 else -x for x in ls]
        acc = ls if acc is None else [p + q for p, q in zip(acc, ls)]
    return limbs_to_string(acc)


def order_key(col) -> Column:
    """Fixed-width string whose lexicographic order is numeric order (non-negative values);
    NULL for more digits than a uint256 can have."""
    return _padded(_c(col), 78)


def sum_u256(df: DataFrame, by: list[str], values: dict[str, object], extra_aggs: list[Column] = ()) -> DataFrame:
    """Exact grouped sums: ``values`` maps output name → decimal-string column (signed ok).

    The per-limb ``sum()`` is a plain algebraic aggregate, so Spark combines map-side before
    the shuffle and a hot group costs one partial row per task.
    """
    aggs = list(extra_aggs)
    for name, col in values.items():
        for k, limb in enumerate(to_limbs(col)):
            aggs.append(F.sum(limb).alias(f"__{name}_l{k}"))
    g = df.groupBy(*by).agg(*aggs)
    out = [F.col(c) for c in g.columns if not c.startswith("__")]
    for name in values:
        out.append(limbs_to_string([F.col(f"__{name}_l{k}") for k in range(NLIMBS)]).alias(name))
    return g.select(*out)


def limb_sums(col, name: str) -> list[Column]:
    """Aggregate expressions (one ``sum`` per limb) to combine later with ``limbs_to_string``."""
    return [F.sum(limb).alias(f"{name}_l{k}") for k, limb in enumerate(to_limbs(col))]


def _low_half(p32: Column) -> Column:
    """32 hex digits, of which the first is 0, as decimal text."""
    hi, lo = (F.conv(F.substring(p32, i, 16), 16, 10).cast(DEC) for i in (1, 17))
    return (hi * F.lit(str(_TWO64)).cast(DEC) + lo).cast(DEC).cast("string")


def _whole(p64: Column) -> Column:
    """64 hex digits as decimal text: Horner in limb space over four 64-bit words."""
    words = F.array(*[F.conv(F.substring(p64, 16 * i + 1, 16), 16, 10).cast(DEC) for i in range(4)])
    two64, zero = F.lit(str(_TWO64)).cast(DEC), F.lit(0).cast(DEC)

    def step(acc, w):  # acc·2^64 + w, re-normalised; one aggregate, no unrolled copies
        raw = F.transform(acc, lambda x, i: (x * two64 + F.when(i == 0, w).otherwise(zero)).cast(DEC))
        return _normalize(raw)["o"]

    limbs = F.aggregate(words, F.array(*[zero] * NLIMBS), step)
    return _render(F.struct(zero.alias("c"), limbs.alias("o")))


def word_to_u256(w: Column) -> Column:
    """Decimal text of a clean 32-byte word (64 lower-case hex digits, not checked)."""
    return F.when(F.substring(w, 1, 33) == F.lit("0" * 33), _low_half(F.substring(w, 33, 32))).otherwise(_whole(w))


def hex_to_u256(col, strict: bool = False) -> Column:
    """Hex text (optional 0x, any case, up to 64 digits) → canonical decimal string.

    Invalid input (non-hex digits, more than 64 digits, empty) gives NULL, or raises with
    ``strict=True``.
    """
    c = _c(col)
    # a clean word needs no regular expression; below 2^64 conv() gives the text itself
    low = F.substring(c, 49, 16)
    tiny = (F.length(c) == 64) & c.startswith("0" * 48) & F.unhex(low).isNotNull()
    clean = (F.length(c) == 64) & F.unhex(c).isNotNull()
    body = F.regexp_replace(F.trim(c), r"^0[xX]", "")
    valid = body.rlike(r"^[0-9a-fA-F]{1,64}$")
    # fast path: < 2^124 (31 significant hex digits) fits DECIMAL(38,0): hi·2^64 + lo, codegen'd
    sig = F.regexp_replace(body, r"^0+", "")
    fast, slow = _low_half(F.lpad(sig, 32, "0")), _whole(F.lpad(body, 64, "0"))
    out = F.when(F.length(sig) <= 31, fast).otherwise(slow)
    words = F.when(tiny, F.conv(low, 16, 10)).when(clean, word_to_u256(c))
    if strict:
        return words.when(c.isNull(), None).when(valid, out).otherwise(
            F.raise_error(F.concat(F.lit("invalid hex for uint256: "), c)))
    return words.when(valid, out)


def u256_to_double(col) -> Column:
    """Approximate value (for ratios/prices only; never for balances)."""
    return _c(col).cast("double")
