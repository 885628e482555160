"""Secret scans: stated patterns, and a battery of randomness tests over long tokens.

Base spans come from three patterns (keyword assignments, access keys, hex runs). The battery looks at
every run of 20 or more key characters, infers the smallest alphabet that holds it, and tests it as a
random draw from that alphabet: chi-squared uniformity, runs about the alphabet's middle, and lag-one
serial correlation. A token is a *discovery* if its letters are much more even than text would be; the
p-values of that test are judged by Benjamini-Hochberg within strata of alphabet and length, from a
histogram of all tokens, so a token of a length at which text often looks random must be far more even.
A span is added for discoveries that no test of the battery rejects as random. Positions are code
points with exclusive ends.

Tokens of digits only have no model of ordinary text (dates, amounts and identifiers are as even as random digits), so
they are never a discovery.

All steps are DataFrame functions on one row a document; nothing is shuffled but a histogram of at most
``strata x bins`` rows. A lambda computes anew whatever it names, so what is used more than once is bound first (``let``).

Defined results: null text counts as empty and has no spans; repeated rows are scanned each; texts of
any length are scanned whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

# The base patterns. Of `assign`, group 1 is the value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the whole run of 18 or more; shorter runs never match
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"  # a run is met at its start only
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets from the smallest: pattern, letters, and the sums of squares and cubes of the letter
#: frequencies of ordinary text written in it (a hexadecimal word has only a to f).
ALPHABETS = (
    ("[0-9]+", _DIGITS, None, None),
    ("[0-9a-f]+", _DIGITS + "abcdef", 0.26, 0.0857),
    ("[0-9A-F]+", _DIGITS + "ABCDEF", 0.26, 0.0857),
    ("[a-z]+", _LOWER, 0.066, 0.0055),
    ("[A-Z]+", _UPPER, 0.066, 0.0055),
    ("[A-Z2-7]+", _UPPER + "234567", 0.066, 0.0055),
    ("[a-z0-9]+", _LOWER + _DIGITS, 0.066, 0.0055),
    ("[A-Z0-9]+", _UPPER + _DIGITS, 0.066, 0.0055),
    ("[A-Za-z0-9]+", _UPPER + _LOWER + _DIGITS, 0.066, 0.0055),
    ("[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/", 0.066, 0.0055),
    ("[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_", 0.066, 0.0055),
    ("[A-Za-z0-9+/_-]+", _UPPER + _LOWER + _DIGITS + "+/-_", 0.066, 0.0055),
)
ALPHA_RANDOM = 0.001  #: the battery rejects randomness below this, over its three tests
FALSE_DISCOVERY = 0.01
BINS_PER_DECADE, LAST_BIN = 20, 600
LENGTHS = (24, 32, 40, 48, 64, 96, 128)
BLOCK = 256  #: elements that are appended to one array before it joins the others
SPANS = "array<struct<start:int,end:int,got:int>>"
MARKS = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def walk(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Struct(at, out) after going through ``items``: ``step`` of state and item gives the next state and an
    array of what it puts out. Arrays are appended to by blocks, so the time is near linear in the items."""
    none, nothing = F.expr(f"cast(array() as {kind})"), F.expr(f"cast(array() as array<{kind}>)")

    def one(s: Column, x: Column) -> Column:
        at, out = step(s["at"], x)
        return F.struct(at.alias("at"), F.concat(s["out"], out).alias("out"))

    def block(s: Column, xs: Column) -> Column:
        end = F.aggregate(xs, F.struct(s["at"].alias("at"), none.alias("out")), one)
        return let(end, lambda e: F.struct(e["at"].alias("at"), F.concat(s["out"], F.array(e["out"])).alias("out")))

    def whole(xs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(xs) / BLOCK).cast("int") - 1))
        return F.aggregate(F.transform(numbers, lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))), F.struct(state.alias("at"), nothing.alias("out")), block)

    return let(let(items, whole), lambda e: F.struct(e["at"].alias("at"), F.flatten(e["out"]).alias("out")))


def spans_of(text: Column, pattern: str, group: int = 0, needs: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,got>>, ``got`` being a group's length.

    ``needs`` is a cheap condition without which there is no match; the pattern then need not be tried.

    Splitting by the pattern gives what lies between the matches; adding up the code points of both
    gives the positions.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    steps = F.zip_with(F.zip_with(between, found, lambda b, m: F.struct(F.char_length(b).alias("b"), F.char_length(m).alias("m"))), values, lambda x, v: F.struct(x["b"].alias("b"), x["m"].alias("m"), F.char_length(v).alias("v")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start, end = at + x["b"], at + x["b"] + x["m"]
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), x["v"].alias("got")))

    walked = walk(F.filter(steps, lambda x: x["m"].isNotNull()), F.lit(0), SPANS, step)["out"]
    found = text.rlike(pattern)
    return F.when(found if needs is None else needs & found, walked).otherwise(F.expr(f"cast(array() as {SPANS})"))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by a rational fit good to 1e-7 near the middle."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(token: Column) -> Column:
    """Struct(stratum, bin, as_random) of a token: see the module's text."""
    kinds = F.array(*(F.struct(F.lit(i).alias("which"), F.lit(a[1]).alias("letters"), F.lit(float(len(a[1]))).alias("k"), F.lit(a[2]).cast("double").alias("s2"), F.lit(a[3]).cast("double").alias("s3")) for i, a in enumerate(ALPHABETS)))
    which = F.coalesce(*(F.when(token.rlike(f"^{p}$"), F.lit(i)) for i, (p, *_) in enumerate(ALPHABETS)))
    pairs = lambda xs: F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def placed(of: Column) -> Column:
        at = F.transform(F.split(token, ""), lambda c: F.call_function("instr", of["letters"], c) - 1)
        squares = F.aggregate(F.split(of["letters"], ""), F.lit(0.0), lambda s, c: s + F.pow(F.char_length(token) - F.char_length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
        return let(F.struct(at.alias("at"), F.transform(at, lambda i: (i * 2 >= of["k"]).cast("int")).alias("high"), squares.alias("squares")), lambda x: summed(of, x))

    def summed(of: Column, x: Column) -> Column:
        middle = (of["k"] - 1) / 2
        sums = F.struct(
            F.char_length(token).cast("double").alias("n"),
            F.aggregate(x["high"], F.lit(0), lambda s, i: s + i).cast("double").alias("ones"),
            (1 + F.aggregate(pairs(x["high"]), F.lit(0), lambda s, y: s + (y["a"] != y["b"]).cast("int"))).alias("runs"),
            F.aggregate(x["at"], F.lit(0.0), lambda s, i: s + (i - middle) * (i - middle)).alias("power"),
            F.aggregate(pairs(x["at"]), F.lit(0.0), lambda s, y: s + (y["a"] - middle) * (y["b"] - middle)).alias("lag"),
        )
        return let(sums, lambda y: let(x["squares"] * of["k"] / y["n"] - y["n"], lambda chi: judged(of, y, chi)))

    return let(let(which, lambda w: F.element_at(kinds, w + 1)), placed)


def judged(of: Column, sums: Column, chi: Column) -> Column:
    """The battery's result, of an alphabet, the sums over a token, and its chi-squared."""
    k, s2, s3, n, ones = of["k"], of["s2"], of["s3"], sums["n"], sums["ones"]
    mean_runs = 1 + 2 * ones * (n - ones) / n
    z_runs = F.when((ones == 0) | (ones == n), F.lit(9.0)).otherwise((sums["runs"] - mean_runs) / F.sqrt(F.greatest(F.lit(0.25), (mean_runs - 1) * (mean_runs - 2) / (n - 1))))
    z_serial = sums["lag"] / sums["power"] * F.sqrt(n)
    z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    tails = F.array(let(z_chi, upper_tail), 2 * let(F.abs(z_runs), upper_tail), 2 * let(F.abs(z_serial), upper_tail))
    p_random = 3 * F.array_min(tails)
    text_mean = k * (1 + (n - 1) * s2) - n
    text_var = F.pow(k / n, F.lit(2.0)) * (2 * n * (n - 1) * s2 + 4 * n * (n - 1) * (n - 2) * s3 - 2 * n * (n - 1) * (2 * n - 3) * s2 * s2)
    p_text = F.coalesce(let(-(chi - text_mean) / F.sqrt(text_var), upper_tail), F.lit(1.0))
    band = sum((n >= x).cast("int") for x in LENGTHS)
    return F.struct(
        (of["which"] * (len(LENGTHS) + 1) + band).alias("stratum"),
        F.least(F.lit(LAST_BIN), F.floor(-F.log10(F.greatest(p_text, F.lit(1e-300))) * BINS_PER_DECADE).cast("int")).alias("bin"),
        (p_random >= ALPHA_RANDOM).alias("as_random"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans in order, and tested tokens of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def kind(spans: Column, order: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("kind"), x["end"].alias("end")))

    tokens = F.zip_with(spans_of(text, TOKEN), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(t).alias("test")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        kind(F.filter(spans_of(text, ASSIGN, 1, text.contains("=") | text.contains(":")), lambda x: x["got"] >= ASSIGN_LEAST), 0).alias("assign"),
        kind(spans_of(text, ACCESS, needs=text.contains("AKIA")), 1).alias("access"),
        kind(spans_of(text, HEX), 2).alias("hex"),
        F.when(text.rlike(TOKEN), tokens).alias("tokens"),
    )


def discovery_bins(scanned: DataFrame) -> dict[int, int]:
    """Lowest bin that is a discovery, by stratum: Benjamini-Hochberg over the histogram of all tokens.

    A bin counts as its largest p-value, so the control holds. At most one row a stratum comes back.
    """
    bins = scanned.select(F.explode("tokens").alias("t")).select("t.test.stratum", "t.test.bin").groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    down = W.partitionBy("stratum").orderBy(F.desc("bin"))
    ranked = bins.select("stratum", "bin", F.sum("n").over(down).alias("found"), F.sum("n").over(W.partitionBy("stratum")).alias("m"))
    most_p = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    return {r[0]: r[1] for r in ranked.where(most_p * F.col("m") <= FALSE_DISCOVERY * F.col("found")).groupBy("stratum").agg(F.min("bin")).collect()}


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document the base spans by kind and, as ``random``, the spans the battery adds."""
    scanned = stored(scan(docs), "secrets")
    least = discovery_bins(scanned)
    bounds = F.create_map(*(F.lit(x) for pair in least.items() for x in pair)) if least else F.expr("cast(map() as map<int,int>)")
    base = F.array_sort(F.concat("assign", "access", "hex"))
    kept = F.filter(
        F.coalesce("tokens", F.expr("cast(array() as array<struct<start:int,end:int,test:struct<stratum:int,bin:int,as_random:boolean>>>)")),
        lambda t: t["test"]["as_random"] & (t["test"]["bin"] >= F.coalesce(F.element_at(bounds, t["test"]["stratum"]), F.lit(LAST_BIN + 1))),
    )
    marks = F.transform(kept, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    found = scanned.select("doc_id", "assign", "access", "hex", base.alias("base"), marks.alias("marks"))
    found = found.withColumn("added", F.when(F.size("marks") > 0, apart(F.col("base"), F.col("marks"))).otherwise(F.col("marks")))
    return found.select("doc_id", "assign", "access", "hex", "base", F.array_sort(F.concat("base", "added")).alias("all"), F.size("added").alias("n_random"))


def apart(base: Column, marks: Column) -> Column:
    """Those of ``marks``, which do not overlap each other, that overlap no base span.

    One pass in order of start: a mark waits until the next span shows where it starts, and base spans move ``reach``.
    """
    waiting = f"cast(array() as {MARKS})"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        clear = F.filter(at["waiting"], lambda t: t["end"] <= x["start"])
        is_base = x["kind"] < 3
        mine = F.when(~is_base & (at["reach"] <= x["start"]), F.array(x)).otherwise(F.expr(waiting))
        reach = F.when(is_base, F.greatest(at["reach"], x["end"])).otherwise(at["reach"])
        return F.struct(reach.alias("reach"), mine.alias("waiting")), clear

    walked = walk(F.array_sort(F.concat(base, marks)), F.struct(F.lit(0).alias("reach"), F.expr(waiting).alias("waiting")), MARKS, step)
    return let(walked, lambda e: F.concat(e["out"], e["at"]["waiting"]))


def op10_randomness_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
        F.col("n_random").cast("long").alias("n_random"),
    )
