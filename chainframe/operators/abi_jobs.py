"""ABI decoding as Spark jobs.

The signature lookup (one SQL query per row in the reference) is a de-duplicated equi-join.
Every distinct shape of an ABI (its types and component names) is compiled once, when the plan is
built, to a program: a flat list of steps (head position, kind), each a column expression whose
types, positions and masks are constants (``functions/abi_program.py``). Tuples, fixed arrays,
arrays of byte strings and their nestings are steps like any others. Rows carry the number of
their program and are decoded in one projection; names and method texts are fragments joined from
the signature table. A per-row kernel in Python is left for strings and names that JSON must
escape, names that repeat, and shapes beyond the ``MOST_PROGRAMS`` most frequent.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainframe.functions import abi as K
from chainframe.functions import abi_program as P
from chainframe.functions import evm as E
from chainframe.functions import u256 as U
from chainframe.operators import derive as DV
from chainframe.session import stored


def dedupe_signatures(sigs: DataFrame) -> DataFrame:
    """One signature per (address, byte_sign), chosen deterministically (the reference takes
    an arbitrary ``LIMIT 1``)."""
    key = ("address", "byte_sign")
    rest = [c for c in sigs.columns if c not in (*key, "abi", "prototype")]
    top = sigs.groupBy(*key).agg(F.min(F.struct("abi", "prototype", *rest)).alias("__m"))
    return top.select(*[F.col(c) if c in key else F.col("__m")[c].alias(c) for c in sigs.columns])


def signature_join(rows: DataFrame, sigs: DataFrame, address: Column, selector: Column) -> DataFrame:
    """Attach ``abi``/``prototype`` by (contract address, selector or topic0).
    Plain equi-join: the de-duplicated signature table is broadcast when Spark's size
    estimate allows, otherwise both sides are hash-partitioned."""
    return _attach(rows, dedupe_signatures(sigs), ["abi", "prototype"], address, selector)


def _attach(rows: DataFrame, sigs: DataFrame, cols: list[str], address: Column, selector: Column) -> DataFrame:
    s = sigs.select(F.col("address").alias("__sa"), F.col("byte_sign").alias("__sb"), *cols)
    r = rows.withColumn("__ra", address).withColumn("__rs", selector)
    return r.join(s, (r["__ra"] == s["__sa"]) & (r["__rs"] == s["__sb"]), "left").drop("__ra", "__rs", "__sa", "__sb")


# --- programs -------------------------------------------------------------------------------

MOST_PROGRAMS = 64  # shapes compiled at once; a program is one branch of a projection
_DEPTH = 5  # nested components that signatures are parsed to
_NAME = r"^[A-Za-z_$][A-Za-z0-9_$]*$"
_PLAIN = r"^[ !#-\[\]-~]*$"  # printable ASCII that JSON text holds unescaped


def _input_type(depth: int) -> str:
    inner = f", components: array<{_input_type(depth - 1)}>" if depth else ""
    return f"struct<name: string, type: string, indexed: boolean{inner}>"


def _shape(p: Column, depth: int, top: bool) -> Column:
    """A parameter without its own name at the top: what a program depends on."""
    parts = [p["type"].alias("t")] + ([] if top else [p["name"].alias("n")])
    if depth:
        parts.append(F.transform(p["components"], lambda c: _shape(c, depth - 1, False)).alias("c"))
    return F.struct(*parts)


def _params(shape: list | None) -> list[dict]:
    return [{"type": p.get("t"), "name": p.get("n"), "components": _params(p.get("c"))} for p in shape or []]


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _parsed(sigs: DataFrame, events: bool) -> DataFrame:
    """One row per (address, byte_sign) with its ABI's name, type, inputs (for events the indexed
    ones first), shape and whether names are plain and differ."""
    inputs_type = f"array<{_input_type(_DEPTH)}>"
    s = dedupe_signatures(sigs).withColumn("__f", F.from_json("abi", f"name string, type string, inputs {inputs_type}"))
    inputs = F.coalesce(F.col("__f.inputs"), F.array().cast(inputs_type))
    if events:
        indexed = lambda p: F.coalesce(p["indexed"], F.lit(False))
        inputs = F.concat(F.filter(inputs, indexed), F.filter(inputs, lambda p: ~indexed(p)))
    s = s.withColumn("__inputs", inputs).withColumn("__names", F.col("__inputs.name"))
    plain = F.forall("__names", lambda n: F.coalesce(n.rlike(_NAME) & ~n.startswith("__idx_"), F.lit(False)))
    ok = (F.col("__f.name").rlike(r"^[A-Za-z0-9_$]+$") & plain & (F.size(F.array_distinct("__names")) == F.size("__names"))
          & F.coalesce(F.col("prototype"), F.lit("")).rlike(_PLAIN))
    shape = F.to_json(F.transform("__inputs", lambda p: _shape(p, _DEPTH, True)))
    return s.withColumn("__plain", F.coalesce(ok, F.lit(False))).withColumn("__shape", F.when(F.col("__plain"), shape))


def _compiled(parsed: DataFrame, typed: bool) -> tuple[DataFrame, list[P.Program], bool]:
    """``parsed`` with ``__prog`` (NULL: none) and ``__types`` (the method's types), the programs,
    and whether any row may need the kernel."""
    spark = parsed.sparkSession
    counts = parsed.filter("__shape is not null").groupBy("__shape").agg(F.count(F.lit(1)).alias("c"))
    shapes = [r["__shape"] for r in counts.orderBy(F.desc("c"), "__shape").limit(MOST_PROGRAMS).collect()]
    programs = [p for p in (P.compile_program(_params(json.loads(x)), typed, shape=x) for x in shapes) if p is not None]
    table = spark.createDataFrame([(p.shape, k, p.types) for k, p in enumerate(programs)], "__shape string, __prog int, __types string")
    out = parsed.join(F.broadcast(table), "__shape", "left")
    others = out.filter("__prog is null").limit(1).count() > 0
    return out, programs, others or any(p.strings for p in programs)


def _fragments(method: Column, aliases: bool) -> list[Column]:
    """``__head`` and ``__frags``: the JSON text around the values, once a signature."""
    head = F.concat(F.lit('{"method": "'), method, F.lit('", "parameter": {'))
    frags = F.transform("__names", lambda n: F.concat(_quoted(n), F.lit(": ")))
    if aliases:
        frags = F.concat(frags, F.transform("__names", lambda n, i: F.concat(F.lit('"__idx_'), i.cast("string"), F.lit('": '))))
    return [head.alias("__head"), frags.alias("__frags")]


def _document(values: Column, aliases: bool) -> Column:
    """The JSON text of a row; NULL if a value is."""
    every = F.concat(values, values) if aliases else values
    body = F.array_join(F.zip_with("__frags", every, lambda f, v: F.concat(f, v)), ", ")
    return F.when(F.forall(values, lambda v: v.isNotNull()), F.concat("__head", body, F.lit("}}")))


def _clean_hex(c: Column) -> Column:
    """Lower-case hex text; NULL unless it is whole bytes."""
    return F.when(c.rlike("^([0-9a-fA-F]{2})*$"), F.lower(c))


def _safe(fn, on_error: str):
    def run(*args):
        try:
            return fn(*args)
        except Exception:  # noqa: BLE001 — library-compatible: any decode error → '{}'
            if on_error == "raise":
                raise
            return "{}"
    return run


def _branches(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case that holds, NULL if none."""
    out = F.lit(None).cast("array<string>")
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def _decoded(j: DataFrame, none: Column, known: Column, texts: Column, strings: Column, needs_kernel: bool, kernel, args: list[str],
             on_error: str, keep: list[str]) -> DataFrame:
    """``decoded``: ``{}`` where ``none``; where ``known`` the text of the program (``{}`` or an error
    where it is NULL); the Python kernel in Arrow batches for the rest, also for NULL texts of
    programs with ``strings``. Only where some signature may need the kernel are rows stored, once,
    and taken apart."""
    failed = F.lit("{}") if on_error != "raise" else F.raise_error(F.lit("not decodable by its ABI")).cast("string")
    if not needs_kernel:
        return j.withColumn("decoded", F.when(none, F.lit("{}")).otherwise(F.coalesce(texts, failed))).select(*keep, "decoded")
    native = none | (F.coalesce(known, F.lit(False)) & (F.col("__text").isNotNull() | ~strings))
    j = j.withColumn("__text", F.when(none, F.lit("{}")).when(known, texts))
    j = stored(j.select(*dict.fromkeys([*keep, *args]), "__text", native.alias("__native")), "abi-rows")
    run = _safe(kernel, on_error)

    @F.pandas_udf(T.StringType())
    def udf(*cols: pd.Series) -> pd.Series:
        return pd.Series([run(*row) for row in zip(*cols)], dtype=object)

    own = j.filter("__native").withColumn("decoded", F.coalesce("__text", failed))
    rest = j.filter("not __native").withColumn("decoded", udf(*[F.col(c) for c in args]))
    return own.unionByName(rest).select(*keep, "decoded")


def decode_inputs(txs: DataFrame, sigs: DataFrame, *, mode: str = "typed", on_error: str = "empty") -> DataFrame:
    """Decoded transaction input as JSON text (``{}`` when no signature or on error
    in safe mode). ``mode``: ``typed`` (nested, collapsed tuple types), ``indexed`` (flat with
    ``__idx_n`` aliases) or ``lookup`` (indexed, method text = stored prototype)."""
    typed, aliases = mode == "typed", mode != "typed"
    parsed, programs, needs_kernel = _compiled(_parsed(sigs, events=False), typed)
    named = F.array_join(F.transform("__inputs", lambda p: F.concat(p["type"], F.lit(" "), p["name"])), ", ")
    method = F.concat(F.col("__f.name"), F.lit("("), F.col("__types") if typed else named, F.lit(")"))
    if mode == "lookup":
        method = F.coalesce("prototype", method)
    s = parsed.select("address", "byte_sign", "abi", "prototype", "__prog", *_fragments(method, aliases))
    j = _attach(txs, s, ["abi", "prototype", "__prog", "__head", "__frags"], F.col("to_address"), F.substring("input", 1, 10))
    j = j.withColumn("__p", _clean_hex(F.expr("substring(input, 11)")))
    payload, at = F.col("__p"), F.col("__prog")
    j = j.withColumn("__v", _branches([(at == k, P.arguments(p, payload)) for k, p in enumerate(programs)]))
    none = F.col("abi").isNull() | F.col("input").isNull()

    def kernel(abi, data, proto):
        if mode == "typed":
            return K.decode_input_typed(abi, data)
        return K.decode_input_indexed(abi, data, proto if mode == "lookup" else None)

    strings = at.isin([k for k, p in enumerate(programs) if p.strings])
    return _decoded(j, none, at.isNotNull(), _document(F.col("__v"), aliases), strings, needs_kernel, kernel,
                    ["abi", "input", "prototype"], on_error, [*txs.columns, "abi", "prototype"])


def decode_logs(logs: DataFrame, sigs: DataFrame, *, on_error: str = "empty", lookup: bool = False) -> DataFrame:
    """Decoded event log as JSON text; signatures by (address, topics_0). The lookup
    variant uses the stored prototype and, like the reference, does not check ``type``. Indexed
    inputs come first; as many inputs as there are further topics are read from them."""
    parsed, programs, needs_kernel = _compiled(_parsed(sigs, events=True), typed=False)
    named = F.array_join(F.transform("__inputs", lambda p: F.concat(p["type"], F.lit(" "), p["name"])), ", ")
    method = F.concat(F.col("__f.name"), F.lit("("), named, F.lit(")"))
    if lookup:
        method = F.coalesce("prototype", method)
    s = parsed.select("address", "byte_sign", "abi", "prototype", "__prog", F.col("__f.type").alias("__kind"), *_fragments(method, True))
    topics = E.split_topics(F.col("topics"))
    j = _attach(logs, s, ["abi", "prototype", "__prog", "__kind", "__head", "__frags"], F.col("address"), F.element_at(topics, 1))
    j = j.withColumn("__p", _clean_hex(F.expr("substring(data, 3)")))
    j = j.withColumn("__w", F.transform(topics, lambda w: _clean_hex(F.substring(w, 3, 1 << 20))))
    payload, at, words = F.col("__p"), F.col("__prog"), F.col("__w")
    cases, most = [], 3  # further topics of a log: at most three
    for k, p in enumerate(programs):
        for n in range(min(most, len(p.params)) + 1):
            # the last case takes all the topics there are
            enough = F.size(words) - 1 >= n if n == len(p.params) else F.size(words) - 1 == n
            cases.append(((at == k) & enough, P.event(p, [F.get(words, i + 1) for i in range(n)], payload)))
    j = j.withColumn("__v", _branches(cases))
    text = _document(F.col("__v"), True)
    if not lookup:
        text = F.when(F.col("__kind") == "event", text).otherwise(F.lit("{}"))
    none = F.col("abi").isNull() | F.col("topics").isNull() | F.col("data").isNull()
    sizes = F.create_map(*[x for k, p in enumerate(programs) for x in (F.lit(k), F.lit(len(p.params)))]) if programs else None
    known = at.isNotNull() & ((F.size(words) - 1 <= most) | (sizes[at] <= most)) if programs else F.lit(False)

    def kernel(abi, topics, data, proto):
        return K.decode_log(abi, topics, data, proto if lookup else None, check_type=not lookup)

    strings = at.isin([k for k, p in enumerate(programs) if p.strings]) | ~known
    return _decoded(j, none, known, text, strings, needs_kernel or any(len(p.params) > most for p in programs), kernel,
                    ["abi", "topics", "data", "prototype"], on_error, [*logs.columns, "abi", "prototype"])


def decode_coverage(decoded: DataFrame, by: str = "byte_sign_seen") -> DataFrame:
    """rows per outcome: decoded / empty (signature found, decode failed) / no_signature."""
    outcome = F.when(F.col("abi").isNull(), "no_signature").when(F.col("decoded") == "{}", "empty").otherwise("decoded")
    return decoded.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))


_STATIC = {"address", "bool"}


def decode_static(rows: DataFrame, abi_json: str, data_col: str = "input", selector_len: int = 10) -> DataFrame:
    """native decode for ABIs whose inputs are all static one-word types (address,
    bool, uintN, signed intN, bytesN): one column per input plus ``decode_ok`` (short
    payload or dirty padding → false and NULL values). No Python worker involved."""
    f = json.loads(abi_json)
    payload = F.lower(F.substring(F.col(data_col), selector_len + 1, 1 << 30))
    cols, oks = [], [F.length(payload) >= 64 * len(f["inputs"])]
    for i, p in enumerate(f["inputs"]):
        t, name = p["type"], p.get("name") or f"__idx_{i}"
        w = E.word(payload, i)
        if t == "address":
            oks.append(F.substring(w, 1, 24) == F.lit("0" * 24))
            cols.append((name, E.topic_address(w)))
        elif t == "bool":
            oks.append(w.isin("0" * 64, "0" * 63 + "1"))
            cols.append((name, w == F.lit("0" * 63 + "1")))
        elif t.startswith("uint"):
            bits = int(t[4:] or 256)
            zeros = (256 - bits) // 4
            if zeros:
                oks.append(F.substring(w, 1, zeros) == F.lit("0" * zeros))
            cols.append((name, U.hex_to_u256(w)))
        elif t.startswith("int"):
            bits = int(t[3:] or 256)
            negative = F.substring(w, 1, 1) >= "8"
            fill = (256 - bits) // 4  # sign extension
            if fill:
                body = F.substring(w, fill + 1, 1) >= "8"
                oks.append(F.substring(w, 1, fill) == F.when(body, F.lit("f" * fill)).otherwise(F.lit("0" * fill)))
            inverted = F.translate(w, "0123456789abcdef", "fedcba9876543210")
            below = U.limbs_to_string([-x - (1 if k == 0 else 0) for k, x in enumerate(U.to_limbs(U.hex_to_u256(inverted)))])
            cols.append((name, F.when(negative, below).otherwise(U.hex_to_u256(w))))
        elif t.startswith("bytes") and t != "bytes":
            n = int(t[5:])
            if n < 32:
                oks.append(F.substring(w, 2 * n + 1, 64 - 2 * n) == F.lit("0" * (64 - 2 * n)))
            cols.append((name, F.substring(w, 1, 2 * n)))
        else:
            raise ValueError(f"not a static one-word type: {t}")
    ok = oks[0]
    for o in oks[1:]:
        ok = ok & o
    return rows.select("*", *[F.when(ok, c).alias(n) for n, c in cols], ok.alias("decode_ok"))


@F.pandas_udf(T.StringType())
def _tron_udf(h: pd.Series) -> pd.Series:
    return h.map(lambda x: None if x is None or len(x) < 40 else K.hex_to_tron(x))


def with_tron_address(df: DataFrame, col: str, out: str = "tron_address") -> DataFrame:
    """base58check Tron address for a hex address column, computed once per distinct
    address (Arrow batches) and joined back on the hex value."""
    d = df.select(F.col(col).alias("__h")).distinct().withColumn(out, _tron_udf(F.col("__h")))
    return df.join(d, df[col] == d["__h"], "left").drop("__h")


def tron_transfers(logs: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Token transfers of a Tron chain: the same logs, addresses in base58check. Each
    distinct address is converted once and joined back."""
    x = DV.erc20_transfers(logs, tokens).drop("item_id")
    roles = ("token_address", "from_address", "to_address")
    who = x.select(F.explode(F.array(*roles)).alias("__h")).distinct().withColumn("__t", _tron_udf(F.col("__h")))
    for r in roles:
        m = who.select(F.col("__h").alias(f"__h_{r}"), F.col("__t").alias(f"__t_{r}"))
        x = x.join(m, F.col(r) == F.col(f"__h_{r}"), "left")
    return x.select(*[F.col(f"__t_{c}").alias(c) if c in roles else F.col(c) for c in x.columns if not c.startswith("__")])
