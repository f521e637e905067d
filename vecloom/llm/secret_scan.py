"""Secret scan: known shapes by pattern, others by a battery of randomness tests.

Long runs of key characters are candidates. The smallest alphabet that holds a candidate (hex, base32,
base36, base62, base64) is its encoding, and three tests say how well it fits a string drawn evenly from
it: chi-squared of the symbol counts, Wald and Wolfowitz runs of digits and other symbols, and correlation
of neighbours. Their p-values become one by Fisher's method. Of truly random strings, p is spread evenly;
words and paths have small ones. So the strings with p above 1/2 tell how many random ones a class of like
encoding and length holds, and each class gets the lowest threshold at which at most a tenth of what
passes is not random. Longer strings show their order more clearly and get a lower threshold.

All steps are DataFrame operations: one scan of the texts, then a table of spans without texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom import session
from vecloom.llm.text import own_columns, read, whole

#: Base kinds in the order of reports: pattern, the group that counts, and its least length.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))" r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KINDS = {"assign": (ASSIGN, 2, 8), "access": ("AKIA[A-Z0-9]+", 0, 16), "hex": ("[0-9a-f]{32,}", 0, 32)}

#: Shortest candidate of the test battery.
LEAST_CHARS = 20
CANDIDATE = "[A-Za-z0-9+/_-]{%d,}" % LEAST_CHARS

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from small to large: what a candidate looks like, and the alphabet; one letter case at a
#: time where the alphabet has one only.
ENCODINGS = {
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + _LOWER[:6]),
    "base32": ("^[A-Z2-7]+$", _UPPER + _DIGITS[2:8]),
    "base36": ("^([0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER),
    "base62": ("^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    "base64": ("^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    "base64url": ("^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
}
_FOLDED = ("hex", "base36")

#: Lengths at which a class of candidates begins.
LENGTHS = (20, 32, 48, 64, 128)

#: Thresholds of p, in thousandths, and the share of false discoveries, in thousandths too.
GRID = (1, 5, 10, 20, 50, 100, 200, 300, 500)
FALSE_SHARE = 100

#: Matches whose lengths are summed at a time.
_STRIDE = 512
_MAX_Z = 6.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, x: total + x)


def _matches(text: Column, pattern: str, group: int, keep: Callable[[Column], Column]) -> Column:
    """`start, end, value` of the matches whose value passes `keep`, in code points, end exclusive.

    A text is the pieces between matches and the matches in turn, so their lengths give the places; they
    are summed by strides, or a text with very many matches would take the square of their number.
    """
    found = F.struct(
        F.split(text, pattern, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
    )

    def steps(s):
        each = F.transform(
            s["matches"], lambda m, i: F.char_length(F.get(s["pieces"], i)) + F.char_length(m)
        )
        return F.struct(s["matches"].alias("matches"), s["values"].alias("values"), each.alias("steps"))

    def strides(s):
        n = F.floor(F.size(s["steps"]) / _STRIDE)
        firsts = F.aggregate(
            F.sequence(F.lit(0).cast("bigint"), n),
            F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at")),
            lambda done, b: F.struct(
                F.concat(done["starts"], F.array(done["at"])).alias("starts"),
                (done["at"] + _sum(F.slice(s["steps"], (b * _STRIDE + 1).cast("int"), _STRIDE))).alias("at"),
            ),
            lambda done: done["starts"],
        )
        return F.struct(s.alias("s"), firsts.alias("firsts"))

    def places(t):
        s = t["s"]

        def place(match, i):
            stride = F.floor(i / _STRIDE).cast("int")
            inside = F.slice(s["steps"], stride * _STRIDE + 1, i - stride * _STRIDE + 1)
            end = F.get(t["firsts"], stride) + _sum(inside)
            return F.struct(
                (end - F.char_length(match)).alias("start"), end.alias("end"), F.get(s["values"], i).alias("value")
            )

        return F.filter(F.transform(s["matches"], place), lambda m: keep(m["value"]))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    placed = _let(_let(_let(found, steps), strides), places)
    return F.when(F.rlike(text, F.lit(pattern)), placed).otherwise(none)


def _tail(z: Column) -> Column:
    """Two-sided p-value of a normal deviate, by the logistic approximation of its distribution."""
    size = F.least(F.abs(z), F.lit(_MAX_Z))
    return F.lit(2.0) / (F.exp(F.lit(1.5976) * size + F.lit(0.07056) * size * size * size) + 1.0)


def _step(a: Column, symbol: Column) -> Column:
    """Running sums over a string's symbols: their values, and runs of digits and others."""
    v, begins = symbol["value"], a["last"] < 0
    changes = begins | (symbol["digit"] != a["was"])
    return F.struct(
        v.alias("last"),
        symbol["digit"].alias("was"),
        (a["sum"] + v).alias("sum"),
        (a["squares"] + v * v).alias("squares"),
        (a["products"] + F.when(begins, 0).otherwise(a["last"] * v)).alias("products"),
        (a["runs"] + F.when(changes, 1).otherwise(0)).alias("runs"),
        (a["digits"] + F.when(symbol["digit"], 1).otherwise(0)).alias("digits"),
        F.when(begins, v).otherwise(a["first"]).alias("first"),
    )


def _evidence(x: Column) -> Column:
    """Minus the logarithm of the product of the three p-values."""
    a, n, m = x["a"], x["n"], x["m"]
    number = lambda name: a[name].cast("double")
    # Chi-squared by the cube root of Wilson and Hilferty.
    chi = m * x["squares"].cast("double") / n - n
    spread = F.lit(2.0) / (F.lit(9.0) * (m - 1.0))
    z_chi = (F.cbrt(chi / (m - 1.0)) - (F.lit(1.0) - spread)) / F.sqrt(spread)
    both = F.lit(2.0) * number("digits") * (n - number("digits"))
    z_runs = (number("runs") - (both / n + 1.0)) / F.sqrt(both * (both - n) / (n * n * (n - 1.0)))
    z_runs = F.when(both > n, z_runs).otherwise(F.lit(_MAX_Z))
    mean = number("sum") / n
    below = number("squares") - mean * number("sum")
    ends = (a["sum"] * 2 - a["first"] - a["last"]).cast("double")
    above = number("products") - mean * ends + (n - 1.0) * mean * mean
    z_serial = (n * (above / below) + 1.0) * F.sqrt(n - 1.0) / (n - 2.0)
    z_serial = F.when(below > 0, z_serial).otherwise(F.lit(_MAX_Z))
    return -(F.log(_tail(z_chi)) + F.log(_tail(z_runs)) + F.log(_tail(z_serial)))


def _p_value(symbols: Column, alphabet: Column) -> Column:
    """How well a string fits even draws from `alphabet`: p of the three tests by Fisher's method."""

    def facts(x):
        counts = F.transform(
            F.split(x["alphabet"], ""),
            lambda c: F.char_length(x["symbols"]) - F.char_length(F.replace(x["symbols"], c, F.lit(""))),
        )
        values = F.transform(
            F.array_remove(F.split(x["symbols"], ""), ""),
            lambda c: F.struct((F.instr(x["alphabet"], c) - 1).alias("value"), c.between("0", "9").alias("digit")),
        )
        zero, none = F.lit(0).cast("bigint"), F.lit(-1)
        sums = [zero.alias(c) for c in ("sum", "squares", "products", "runs", "digits")]
        start = F.struct(none.alias("last"), F.lit(False).alias("was"), *sums, none.alias("first"))
        return F.struct(
            F.aggregate(values, start, _step).alias("a"),
            F.aggregate(counts, zero, lambda total, c: total + c.cast("bigint") * c).alias("squares"),
            F.char_length(x["symbols"]).cast("double").alias("n"),
            F.char_length(x["alphabet"]).cast("double").alias("m"),
        )

    evidence = _let(_let(F.struct(symbols.alias("symbols"), alphabet.alias("alphabet")), facts), _evidence)
    return _let(evidence, lambda e: F.exp(-e) * (F.lit(1.0) + e + e * e / 2.0))


def _length_class(n: Column) -> Column:
    return sum((F.when(n >= least, 1).otherwise(0) for least in LENGTHS[1:]), F.lit(0))


def _tested(span: Column) -> Column:
    """`start, end, class, p` of a candidate; no class if it fits no encoding."""
    value = span["value"]
    number, alphabet = F.lit(None).cast("int"), F.lit("")
    for i, (shape, symbols) in reversed(list(enumerate(ENCODINGS.values()))):
        fits = value.rlike(shape)
        number = F.when(fits, F.lit(i)).otherwise(number)
        alphabet = F.when(fits, F.lit(symbols)).otherwise(alphabet)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    number = F.when(mixed, number)
    folded = number.isin(*(i for i, name in enumerate(ENCODINGS) if name in _FOLDED))
    p = _p_value(F.when(folded, F.lower(value)).otherwise(value), alphabet)
    return F.struct(
        span["start"].alias("start"),
        span["end"].alias("end"),
        (number * len(LENGTHS) + _length_class(F.char_length(value))).alias("class"),
        F.when(number.isNotNull(), p).alias("p"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """`doc_id`, an array of spans (`start, end, value`) per base kind, and `tested`: all candidates with
    their class and p. One scan of the texts, no shuffle."""
    documents = own_columns(docs, doc_id=F.col("doc_id"), text=whole(F.col("text")))
    text = F.col("text")
    columns = {
        kind: _matches(text, pattern, group, lambda v, least=least: F.char_length(v) >= least)
        for kind, (pattern, group, least) in KINDS.items()
    }
    candidates = _matches(text, CANDIDATE, 0, lambda v: F.lit(True))
    tested = F.filter(F.transform(candidates, _tested), lambda c: c["class"].isNotNull())
    return documents.select("doc_id", *(c.alias(k) for k, c in columns.items()), tested.alias("tested"))


def thresholds(scanned: DataFrame) -> dict[int, int]:
    """The threshold of p, in thousandths, of every class of candidates.

    Twice the strings with p above 1/2 are the random ones; of those, a share of 1 - t passes t. What
    else passes is a false discovery. At 1/2 there is none by this count, so every class has a threshold.
    """
    one = scanned.select(F.explode("tested").alias("c")).select("c.class", "c.p")
    passed = [F.count(F.when(F.col("p") * 1000 > g, 1)).alias(f"n{g}") for g in GRID]
    rows = one.groupBy("class").agg(*passed).collect()  # one row per class, at most 30
    out = {}
    for row in rows:
        def is_clean(g, row=row):
            random = 2 * row["n500"] * (1000 - g)
            return 1000 * row[f"n{g}"] - random <= FALSE_SHARE * row[f"n{g}"]

        out[row["class"]] = next(g for g in GRID if is_clean(g))
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """`doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random` of every row of `docs`.

    Spans are `kind:start:end` in code points, end exclusive, by start and then by kind (assign, access,
    hex, random), joined by commas. A candidate of the test battery that passes its class's threshold is
    a `random` span unless it overlaps one of a base kind; base spans always stay. `base_sha256` is of
    the base spans alone, joined likewise. Null text is empty and has no spans; every row is scanned by
    itself, also with a null or repeated id; other columns are ignored; an empty table gives no rows.
    """
    scanned, _ = session.cut(scan(docs), "secret-spans")
    least = thresholds(scanned)
    by_class = F.create_map(*(F.lit(x) for pair in sorted(least.items()) for x in pair)) if least else None
    base = F.concat(*(_listed(F.col(kind), order) for order, kind in enumerate(KINDS)))
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    passes = (lambda c: c["p"] * 1000 > F.element_at(by_class, c["class"])) if least else lambda c: F.lit(False)
    counted = scanned.select("doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS), base.alias("base"), "tested")
    added = F.filter("tested", lambda c: passes(c) & free(c))
    named = counted.select("*", _listed(added, len(KINDS)).alias("added"))
    return named.select(
        "doc_id",
        *(f"n_{k}" for k in KINDS),
        F.sha2(_report(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _report(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("bigint").alias("n_random"),
    )


def _listed(spans: Column, order: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind"), s["end"].alias("end"))
    )


def _report(spans: Column) -> Column:
    names = F.array(*map(F.lit, [*KINDS, "random"]))
    each = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), each), ",")


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))


def _sql_pattern(kind: str) -> str:
    """The pattern of a kind for DuckDB, whose own folding of letter case goes beyond A-Z."""
    if kind != "assign":
        return KINDS[kind][0]
    words = ["password", "passwd", "secret", "token", "api_?key"]
    either = ["".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words]
    return ASSIGN.replace("(?i:" + "|".join(words) + ")", "|".join(either)).replace("'", "''")


def _sql_found() -> str:
    kinds = [(_sql_pattern(kind), group, least) for kind, (_, group, least) in KINDS.items()]
    kinds.append((CANDIDATE, 0, LEAST_CHARS))
    return " UNION ALL ".join(
        f"""SELECT id, {i} AS kind, {least} AS least, regexp_extract_all(text, '{pattern}', 0) AS m,
        regexp_extract_all(text, '{pattern}', {group}) AS v, string_split_regex(text, '{pattern}') AS pieces
        FROM d WHERE regexp_matches(text, '{pattern}')"""
        for i, (pattern, group, least) in enumerate(kinds)
    )


def _sql_case(results) -> str:
    whens = (f"WHEN regexp_matches(value, '{shape}') THEN {out}" for (shape, _), out in results)
    return f"CASE {' '.join(whens)} END"


def _sql_tail(z: str) -> str:
    size = f"least(abs({z}), {_MAX_Z}::DOUBLE)"
    return f"2.0::DOUBLE / (exp(1.5976::DOUBLE * {size} + 0.07056::DOUBLE * {size} * {size} * {size}) + 1.0)"


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_sql_found()}),
one AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
span AS (
  SELECT id, kind, v[i] AS value, length(m[i]) AS n,
    list_sum(list_transform(pieces[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM one WHERE length(v[i]) >= least),
coded AS (
  SELECT *, {_sql_case(zip(ENCODINGS.values(), range(len(ENCODINGS)), strict=True))} AS code,
    {_sql_case((e, f"'{e[1]}'") for e in ENCODINGS.values())} AS alphabet
  FROM span WHERE kind = {len(KINDS)} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')),
folded AS (
  SELECT id, s, n, code, alphabet, length(alphabet)::DOUBLE AS m,
    CASE WHEN code IN (0, 2) THEN lower(value) ELSE value END AS symbols
  FROM coded WHERE code IS NOT NULL),
listed AS (
  SELECT *, list_transform(string_split(symbols, ''), lambda c: instr(alphabet, c) - 1) AS v,
    list_transform(string_split(symbols, ''), lambda c: c BETWEEN '0' AND '9') AS digit FROM folded),
facts AS (
  SELECT *, n::DOUBLE AS x, list_sum(v)::DOUBLE AS total,
    list_sum(list_transform(string_split(alphabet, ''),
      lambda c: (n - length(replace(symbols, c, ''))) * (n - length(replace(symbols, c, '')))))::DOUBLE AS same,
    list_sum(list_transform(v, lambda y: y * y))::DOUBLE AS squares,
    list_sum(list_transform(range(1, n), lambda i: v[i] * v[i + 1]))::DOUBLE AS products,
    (1 + len(list_filter(range(1, n), lambda i: digit[i] <> digit[i + 1])))::DOUBLE AS runs,
    len(list_filter(digit, lambda y: y))::DOUBLE AS digits, (v[1] + v[n])::DOUBLE AS ends
  FROM listed),
parts AS (
  SELECT *, m * same / x - x AS chi, 2.0::DOUBLE / (9.0::DOUBLE * (m - 1.0)) AS spread,
    2.0::DOUBLE * digits * (x - digits) AS pairs, total / x AS mean FROM facts),
scores AS (
  SELECT *, (cbrt(chi / (m - 1.0)) - (1.0::DOUBLE - spread)) / sqrt(spread) AS z1,
    CASE WHEN pairs > x THEN (runs - (pairs / x + 1.0)) / sqrt(pairs * (pairs - x) / (x * x * (x - 1.0)))
      ELSE {_MAX_Z} END AS z2,
    CASE WHEN squares - mean * total > 0 THEN
      (x * ((products - mean * (total * 2 - ends) + (x - 1.0) * mean * mean) / (squares - mean * total)) + 1.0)
        * sqrt(x - 1.0) / (x - 2.0)
      ELSE {_MAX_Z} END AS z3
  FROM parts),
summed AS (
  SELECT id, s, n, code * {len(LENGTHS)} + {" + ".join(f"(n >= {x})::INT" for x in LENGTHS[1:])} AS class,
    -(ln({_sql_tail("z1")}) + ln({_sql_tail("z2")}) + ln({_sql_tail("z3")})) AS e
  FROM scores),
tested AS (SELECT *, exp(-e) * (1.0::DOUBLE + e + e * e / 2.0) * 1000 AS p FROM summed),
passed AS (
  SELECT class, g, count(*) FILTER (WHERE p > g) AS n, count(*) FILTER (WHERE p > 500) AS n_half
  FROM tested, (SELECT unnest({list(GRID)}) AS g) GROUP BY class, g),
threshold AS (
  SELECT class, min(g) AS g FROM passed
  WHERE 1000 * n - 2 * n_half * (1000 - g) <= {FALSE_SHARE} * n GROUP BY class),
spans AS (
  SELECT id, kind, s, s + n AS e FROM span WHERE kind < {len(KINDS)}
  UNION ALL
  SELECT t.id, {len(KINDS)}, t.s, t.s + t.n FROM tested t JOIN threshold USING (class)
  WHERE p > g AND NOT EXISTS (
    SELECT 1 FROM span b WHERE b.id = t.id AND b.kind < {len(KINDS)} AND b.s < t.s + t.n AND t.s < b.s + b.n)),
named AS (
  SELECT id, kind, s, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || s || ':' || e AS name FROM spans)
SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
  count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE kind = 3) AS n_random,
  sha256(coalesce(string_agg(name, ',' ORDER BY s, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
  coalesce(string_agg(name, ',' ORDER BY s, kind), '') AS spans
FROM d LEFT JOIN named USING (id) GROUP BY id, doc_id
"""
