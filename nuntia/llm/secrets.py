r"""Secret scan with DataFrame functions alone.

Three kinds of base spans come from patterns (`assign`, `access`, `hex`; either case means A-Z and a-z). Spark has no function for the places of
regular expression matches, so a text is split at the same pattern: lengths of the pieces and matches, added up, are
the places. Lengths are code points.

Running sums and maxima over the matches of a text are taken in pieces of PIECE matches, first over pieces and then within
them, as an array that grows match by match would be copied at each; so the work grows with the text's length.

Kind `random` comes from a battery of randomness tests on long runs of key characters. The run's encoding (hex, base
32, letters, base 36, base 62 or base 64) gives the alphabet. Three tests are put to the hypothesis that the run is
random: a chi-squared test of uniform use of the alphabet (as the number of agreeing pairs of characters, to which it is
equivalent; for short runs, where few agree, against the Poisson distribution), a runs test about the alphabet's middle
and a lag-1 serial correlation test (against the normal distribution, corrected for continuity and bias). The smallest
p-value, times three, is the battery's. All runs of a band of lengths (powers of two) go through Benjamini-Hochberg
control: the runs that it discovers to be not random, at a false rate of LOST, are no secrets.
Of what is left, short runs may be text that merely was not caught, as they carry little evidence. So a run must also
speak against ordinary text, by too few coincidences of characters and too many changes of character class, and these
p-values go through Benjamini-Hochberg control in the same bands, at FALSE_RATE.
For that control histograms of p-values are all that is aggregated: a fixed number of bins, at whose edges the bounds
are tested (on the safe side). Runs of digits alone are left to the base kinds.

Defined results: an empty table gives no rows; null and empty texts have no spans; base_sha256 is then that of the empty
string. Repeated rows are scanned alike; a very long text is scanned whole; extra columns are ignored (redact() keeps them).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nuntia.llm.common import discard, table, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a run of these characters that is too short can hold no long enough match, so the length is part of the pattern
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
SPAN = "struct<start:int,kind:int,end:int>"
#: By band of lengths: the battery's -log10 p from which a run is not random, the -log10 p against text that a secret needs.
Limits = dict[int, tuple[float, float]]
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: Encodings by what a run consists of, in order: pattern, alphabet.
ENCODINGS = (
    (r"^[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", UPPER + "234567"),
    (r"^[a-z]+$", LOWER),
    (r"^[a-z0-9]+$", DIGITS + LOWER),
    (r"^[A-Z0-9]+$", DIGITS + UPPER),
    (r"^[A-Za-z0-9]+$", DIGITS + LOWER + UPPER),
    ("", DIGITS + LOWER + UPPER + "+/_-"),
)
#: Chance that two characters of ordinary text agree, capitals or not: in words, and in what looks like hex.
AGREE, AGREE_HEX = 0.06, 0.10
#: Chance that ordinary text changes between small letters, capitals, digits and signs; larger for names in camel case.
CHANGE, CHANGE_MIXED = 0.10, 0.30
LOST, FALSE_RATE, BIN, MOST_BINS = 0.01, 0.01, 0.25, 120
#: Matches of a text that are taken together, and expected agreeing pairs up to which their number is held against Poisson's distribution.
PIECE, RARE = 256, 30.0


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is evaluated once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column, together: Callable[[Column, Column], Column]) -> Column:
    """For an array of int: what `together` (from 0) makes of all values before each one."""
    zero, none = F.lit(0), F.array().cast("array<int>")

    def upto(start: Column, array: Column) -> Column:
        first = F.struct(start.alias("at"), none.alias("out"))
        step = lambda a, v: F.struct(together(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(array, first, step, lambda a: a["out"])

    def in_pieces(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PIECE).cast("int")), lambda i: F.slice(v, i * PIECE + 1, PIECE))
        return bound(cut, lambda c: F.flatten(F.zip_with(upto(zero, F.transform(c, lambda x: F.aggregate(x, zero, together))), c, upto)))

    return bound(values, lambda v: F.when(F.size(v) > 0, in_pieces(v)).otherwise(none))


def placed(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, end) of the matches whose group has at least `least` characters."""
    p = F.lit(pattern)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("x"), F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.regexp_extract_all(text, p, F.lit(group)).alias("g"))
    sizes = F.transform(parts, lambda v: F.struct(F.length(v["x"]).alias("x"), F.coalesce(F.length(v["m"]), F.lit(0)).alias("m"), F.coalesce(F.length(v["g"]), F.lit(-1)).alias("g")))

    def spans(v: Column) -> Column:
        before = running(F.transform(v, lambda s: s["x"] + s["m"]), lambda a, b: a + b)
        each = F.zip_with(v, before, lambda s, at: F.when(s["g"] >= least, F.struct((at + s["x"]).alias("start"), F.lit(kind).alias("kind"), (at + s["x"] + s["m"]).alias("end"))))
        return F.filter(each, lambda s: s.isNotNull())

    return F.when(text.rlike(pattern), bound(sizes, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def log10_tail(z: Column) -> Column:
    """-log10 of the normal upper tail beyond z, by Boerjesson and Sundberg's approximation, 0 for z <= 0."""
    z = F.greatest(z, F.lit(0.0))
    return F.greatest(F.lit(0.0), z * z * 0.21714724095 + 0.3990899342 + F.log10(0.661 * z + 0.339 * F.sqrt(z * z + 5.51)))


def battery(core: Column) -> Column:
    """For a run of key characters: (against double, evidence double, n int): -log10 p of the battery, for the run being random,
    and -log10 p of what tells it from ordinary text, for its being that."""
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(core.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    # one-element arrays bind values once for the expressions below
    def counted(v: Column) -> Column:
        codes, size = v["codes"], v["size"]
        n = F.size(codes).cast("double")
        counts = F.transform(F.sequence(F.lit(1), size.cast("int")), lambda k: F.size(F.filter(codes, lambda x: x == k)))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        folded = F.transform(F.array_distinct(v["folded"]), lambda k: F.size(F.filter(v["folded"], lambda x: x == k)))
        agreeing = F.aggregate(folded, F.lit(0.0), lambda a, c: a + c * (c - 1) / 2)
        middle = size / 2
        pairs = F.arrays_zip(F.slice(codes, 1, F.size(codes) - 1).alias("a"), F.slice(codes, 2, F.size(codes) - 1).alias("b"))
        turns = F.size(F.filter(pairs, lambda p: (p["a"] > middle) != (p["b"] > middle)))
        changes = F.size(F.filter(F.arrays_zip(F.slice(v["classes"], 1, F.size(codes) - 1).alias("a"), F.slice(v["classes"], 2, F.size(codes) - 1).alias("b")), lambda p: p["a"] != p["b"]))
        mean = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n
        spread = F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean))
        joint = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        return F.struct(n.alias("n"), size.alias("size"), squares.alias("squares"), agreeing.alias("agreeing"), turns.alias("turns"), changes.alias("changes"), spread.alias("spread"), joint.alias("joint"))

    def judged(s: Column) -> Column:
        n, size = s["n"], s["size"].cast("double")
        pairs = n * (n - 1) / 2
        # the chi-squared statistic is linear in the number of agreeing pairs, whose mean is pairs / size
        equal, mean = (s["squares"] - n) / 2, pairs / size
        term = lambda k: F.exp(k * F.log(mean) - mean - F.when(k > 1, k * F.log(k) - k + 0.5 * F.log(6.283185307179586 * k) + 1 / (12 * k)).otherwise(0.0))
        below = F.aggregate(F.sequence(F.lit(0), F.greatest(equal.cast("int") - 1, F.lit(0))), F.lit(0.0), lambda a, k: a + term(k.cast("double")))
        rare = F.when(equal < 1, F.lit(0.0)).otherwise(-F.log10(F.greatest(1 - below, F.lit(1e-9))))
        chi = F.when((mean <= RARE) & (equal <= 4 * RARE), rare).otherwise(log10_tail((equal - 0.5 - mean) / F.sqrt(mean * (1 - 1 / size))))
        runs = (F.abs(s["turns"] - (n - 1) / 2) - 0.5) / F.sqrt((n - 1) / 4)
        serial = F.when(s["spread"] > 0, F.abs(s["joint"] / s["spread"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        worst = F.greatest(chi, log10_tail(runs) - 0.30103, log10_tail(serial) - 0.30103) - 0.4771213
        agree = F.when(size == 16, AGREE_HEX).otherwise(AGREE)
        few = (pairs * agree - s["agreeing"]) / F.sqrt(pairs * agree * (1 - agree))
        change = F.when(size > 36, CHANGE_MIXED).otherwise(CHANGE)
        many = (s["changes"] - change * (n - 1)) / F.sqrt(change * (1 - change) * (n - 1))
        return F.struct(F.greatest(worst, F.lit(0.0)).alias("against"), log10_tail((few + many) / 1.4142135623730951).alias("evidence"), n.cast("int").alias("n"))

    chars = F.split(core, "")
    chars = F.filter(chars, lambda c: c != "")
    kind = lambda c: F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)
    values = F.transform(F.array(alphabet), lambda a: F.struct(F.transform(chars, lambda c: F.call_function("locate", c, a)).alias("codes"), F.transform(chars, lambda c: F.lower(c)).alias("folded"), F.transform(chars, kind).alias("classes"), F.length(a).alias("size")))
    return F.element_at(F.transform(F.transform(values, counted), judged), 1)


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(placed(text, ASSIGN, 0, 2, 12), placed(text, ACCESS, 1), placed(text, HEX, 2)))


def tested(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, and runs: (span, test) of each run of key characters in the column text that is not all digits."""
    tokens = F.when(F.col(text).rlike(CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = df.select(*keep, placed(F.col(text), CANDIDATE, 3).alias("spans"), tokens.alias("tokens"))
    lettered = F.filter(F.arrays_zip("spans", "tokens"), lambda v: ~v["tokens"].rlike("^[0-9]+$"))
    return found.select(*keep, F.transform(lettered, lambda v: F.struct(v["spans"].alias("span"), battery(F.rtrim(v["tokens"], F.lit("="))).alias("test"))).alias("runs"))


def band(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def passes(test: Column, limits: Limits) -> Column:
    """Whether the battery doesn't find a run not random and the evidence against ordinary text is enough for its length."""
    each = [(band(test["n"]) == b) & (test["against"] < most) & (test["evidence"] >= least) for b, (most, least) in limits.items()]
    return reduce(or_, each, F.lit(False))


def discovered(runs: str, base: str, limits: Limits) -> Column:
    """Spans of the runs that pass their band's limits and that no base span covers."""
    marked = lambda s, ok: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), ok.alias("ok"))
    every = F.array_sort(F.concat(F.transform(base, lambda b: marked(b, F.lit(False))), F.transform(F.filter(runs, lambda v: passes(v["test"], limits)), lambda v: marked(v["span"], F.lit(True)))))

    def kept(v: Column) -> Column:
        # sorted by start and kind, so the base spans that begin with a run or before it stand before it
        reach = running(F.transform(v, lambda s: F.when(s["ok"], 0).otherwise(s["end"])), lambda a, b: F.greatest(a, b))
        each = F.zip_with(v, reach, lambda s, r: F.when(s["ok"] & (r < s["end"]), F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
        return F.filter(each, lambda s: s.isNotNull())

    return bound(every, kept)


def scan(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, base and added: arrays of (start, kind, end) spans, kinds numbered as in KINDS, base ones sorted."""
    text = documents.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    found = written(tested(text.select(id_column, "text", base_spans(F.col("text")).alias("base")), "text", [id_column, "base"]), "secrets")
    return found.select(id_column, "base", discovered("runs", "base", discoveries(found)).alias("added"))


def masked(text: Column, pattern: str, mark: str, is_secret: Callable[[Column, Column], Column], group: int = 0) -> Column:
    """text with the mark in place of each match that is a secret, by the match and its group."""
    p = F.lit(pattern)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("x"), F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.regexp_extract_all(text, p, F.lit(group)).alias("g"))
    each = F.transform(parts, lambda v: F.when(v["m"].isNull(), v["x"]).when(is_secret(v["m"], v["g"]), F.concat(v["x"], F.lit(mark))).otherwise(F.concat(v["x"], v["m"])))
    return F.when(text.rlike(pattern), F.array_join(each, "")).otherwise(text)


def redact(documents: DataFrame, text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """documents with the mark in place of every secret; a null text stays null. Kind by kind, in their order, each in
    what the ones before it left: a mark ends a run, so what a secret of an earlier kind overlapped is judged by its rest.

    Two passes, as the first one sets the limits for all texts; nothing but the results of tests is written or shuffled.
    """
    names = documents.columns
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    limits = discoveries(tested(packed, "text", []))
    text = masked(F.col("text"), ASSIGN, mark, lambda m, g: F.length(g) >= 12, 2)
    clean = packed.select("row", masked(masked(text, ACCESS, mark, lambda m, g: F.lit(True)), HEX, mark, lambda m, g: F.lit(True)).alias("text"))
    random = masked(F.col("text"), CANDIDATE, mark, lambda m, g: ~m.rlike("^[0-9]+$") & bound(battery(F.rtrim(m, F.lit("="))), lambda t: passes(t, limits)))
    out = F.when(F.col(f"row.`{text_column}`").isNotNull(), random)
    return clean.select(*[(out if c == text_column else F.col(f"row.`{c}`")).alias(c) for c in names])


def discoveries(found: DataFrame) -> Limits:
    """By length band: the battery's value from which runs are not random (LOST false discoveries), and the evidence from
    which the others count as secrets (FALSE_RATE)."""
    each = found.select(F.explode("runs").alias("v")).select("v.test.*").select(band(F.col("n")).alias("band"), "against", "evidence")
    in_bin = lambda c: F.least(F.floor(F.col(c) / BIN), F.lit(MOST_BINS))
    bins = each.groupBy("band", in_bin("against").alias("against"), in_bin("evidence").alias("evidence")).agg(F.count("*").alias("n"))
    bins = written(bins, "bins")  # at most MOST_BINS + 1 squared rows a band

    def limits(rows: DataFrame, value: str, rate: float) -> DataFrame:
        """The lowest bin at whose edge the expected false discoveries are at most `rate` of all."""
        own = Window.partitionBy("band")
        summed = rows.groupBy("band", value).agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
        counted = summed.withColumn("m", F.sum("n").over(own)).withColumn("above", F.sum("k").over(own.orderBy(F.desc(value))))
        fits = counted.where((F.col("above") > 0) & (-F.col(value) * BIN <= F.log10(F.lit(rate) * F.col("above") / F.col("m"))))
        return fits.groupBy("band").agg((F.min(value) * BIN).alias(value))

    not_random = {r["band"]: r["against"] for r in limits(bins.withColumn("k", F.col("n")), "against", LOST).collect()}
    is_left = reduce(or_, [(F.col("band") == b) & (F.col("against") * BIN >= most) for b, most in not_random.items()], F.lit(False))
    found_ = limits(bins.withColumn("k", F.when(is_left, 0).otherwise(F.col("n"))), "evidence", FALSE_RATE).collect()
    discard(bins)
    return {r["band"]: (not_random.get(r["band"], float("inf")), r["evidence"]) for r in found_}


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans of every document."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
