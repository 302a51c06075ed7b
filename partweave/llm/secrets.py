"""Secret scan: fixed patterns plus a battery of randomness tests.  DataFrame functions only.

The battery looks at every maximal run of key-like characters that is long enough.  It infers the encoding (hex,
base32, base64, or the smallest alphabet of ENCODINGS that holds a string of two of the three character classes), maps characters to symbol values, and tests the hypothesis "symbols are drawn at random" three ways:
chi-squared uniformity over the alphabet, a runs test around the middle of the alphabet, and lag-1 serial correlation.
The three p-values are combined by Fisher's method.  Benjamini-Hochberg, run apart for each length class so that many
short strings don't set the bar for long ones, bounds the share of random strings among those that are dismissed as
not random; what it doesn't dismiss is reported as a secret of kind ``random``.

Defined results: null and empty texts have no spans; repeated rows are scanned one by one and count one by one in the
false-discovery control; a span of the battery that overlaps a span of a pattern is dropped, since that text is
reported already; ties in position order by kind; extra columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Fixed values of the contract: pattern, group whose length is tested, least length.
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
KINDS = [*PATTERNS, "random"]

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"

#: Encodings in the order in which they are tried: pattern, alphabet.  Each asks for two of the character classes digit,
#: upper and lower case at least, since a run of one class is a word in most texts.
ENCODINGS = [
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_-]+=*$",
     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base32_lower", r"^(?=.*[2-7])(?=.*[a-z])[a-z2-7]+=*$", _LOWER + "234567"),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+=*$", _LOWER + _DIGITS),
    ("base36_upper", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+=*$", _UPPER + _DIGITS),
    ("letters", r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z]+=*$", _UPPER + _LOWER),
    ("base38", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9+/_-]+=*$", _LOWER + _DIGITS + "+/"),
    ("base38_upper", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9+/_-]+=*$", _UPPER + _DIGITS + "+/"),
    ("letters_signs", r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z+/_-]+=*$", _UPPER + _LOWER + "+/"),
]
LENGTH_CLASSES = [20, 32, 48, 96]
P_BINS = 400


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches as (start, end, value, tested): positions in code points, from the lengths between the matches."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string,tested:string>>)")

    def walk(ps: Column, ms: Column) -> Column:
        steps = F.transform(ms, lambda m, i: F.struct(
            F.get(ps, i).cast("long").alias("gap"), m["m"].alias("m"), m["g"].alias("g")))
        start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
        return F.aggregate(steps, start, lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + F.length(s["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + F.length(s["m"])).alias("end"),
                s["m"].alias("value"), s["g"].alias("tested")))).alias("out")), lambda acc: acc["out"])

    return F.when(text.rlike(pattern), let(pieces, lambda ps: let(found, lambda ms: walk(ps, ms)))).otherwise(empty)


def pattern_spans(text: Column) -> dict[str, Column]:
    return {kind: F.filter(located(text, pattern, group), lambda m: F.length(m["tested"]) >= least)
            for kind, (pattern, group, least) in PATTERNS.items()}


def _normal_tail(z: Column) -> Column:
    """P(Z > z), a rational approximation of the error function with absolute error under 1.5e-7."""
    x = F.abs(z) / (2.0 ** 0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(1.0 - half)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * _normal_tail(F.abs(z)))


def encoding_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern, _ in reversed(ENCODINGS):
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return out


def randomness(tokens: DataFrame, value="value") -> DataFrame:
    """Add encoding, p_uniform, p_runs, p_serial and the combined ``p_random``; tokens without encoding are dropped."""
    # A map, not a chain of comparisons: the optimiser would repeat the encoding's patterns in each of them.
    alphabet = F.try_element_at(F.create_map(*[F.lit(x) for name, _, letters in ENCODINGS for x in (name, letters)]), F.col("encoding"))
    plain = F.rtrim(F.col(value), F.lit("="))
    plain = F.when(F.col("encoding") == "hex", F.lower(plain)).otherwise(F.translate(plain, "-_", "+/"))
    length, size = F.col("_n").cast("double"), F.col("_a").cast("double")
    # sum of squared symbol counts
    squares = F.aggregate(F.array_distinct(F.split("_plain", "")), F.lit(0.0), lambda acc, c: acc + F.pow(
        (F.col("_n") - F.length(F.replace(F.col("_plain"), c, F.lit("")))).cast("double"), 2.0))
    chi2, df = size / length * squares - length, size - 1.0
    wilson = (F.pow(F.greatest(chi2, F.lit(0.0)) / df, 1.0 / 3.0) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df))
    symbols = F.transform(F.split("_plain", ""), lambda c: F.instr(F.col("_alphabet"), c).cast("double") - 1.0)

    def serial(s: Column) -> Column:
        mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / length
        return let(mean, lambda m: let(F.transform(s, lambda x: x - m), lambda d: F.try_divide(
            F.aggregate(F.zip_with(d, F.slice(d, 2, F.size(d)), lambda x, y: x * F.coalesce(y, F.lit(0.0))),
                        F.lit(0.0), lambda a, x: a + x),
            F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))))

    high = F.transform("_symbols", lambda x: F.when(x >= size / 2.0, 1).otherwise(0))
    n1 = F.aggregate("_high", F.lit(0), lambda a, x: a + x).cast("double")
    n0 = length - n1
    runs = 1.0 + F.aggregate(F.zip_with("_high", F.slice("_high", 2, F.size("_high")), lambda x, y: F.when(
        x != y, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    expected = 2.0 * n1 * n0 / length + 1.0
    spread = (expected - 1.0) * (expected - 2.0) / (length - 1.0)
    fisher = -2.0 * sum(F.log(F.greatest(F.col(p), F.lit(1e-15))) for p in ("p_uniform", "p_runs", "p_serial"))
    return (
        tokens.withColumn("encoding", encoding_of(F.col(value))).withColumn("_plain", plain)
        .withColumn("_n", F.length("_plain"))
        .withColumn("_alphabet", alphabet).withColumn("_a", F.length("_alphabet"))
        .filter(F.col("encoding").isNotNull() & (F.col("_n") >= LENGTH_CLASSES[0]))
        .withColumn("_symbols", symbols).withColumn("_high", high)
        .withColumn("p_uniform", _normal_tail(wilson))
        .withColumn("p_runs", F.when((n1 == 0) | (n0 == 0), 0.0).otherwise(_two_sided((runs - expected) / F.sqrt(spread))))
        .withColumn("p_serial", _two_sided((F.coalesce(serial(F.col("_symbols")), F.lit(1.0)) + 1.0 / length)
                                           * F.sqrt(length)))
        .withColumn("_f", fisher / 2.0)
        .withColumn("p_random", F.exp(-F.col("_f")) * (1.0 + F.col("_f") + F.col("_f") * F.col("_f") / 2.0))
        .drop("_plain", "_alphabet", "_a", "_symbols", "_high", "_f")
    )


def dismissal_limits(tested: DataFrame, q: float) -> DataFrame:
    """(length_class, limit): strings with a p-value bin up to ``limit`` are dismissed as not random.

    Benjamini-Hochberg over a histogram of ``P_BINS`` bins of -ln p per length class, upper bin edges standing for
    their members, so the control holds; the histogram has a fixed number of rows whatever the corpus holds."""
    counts = tested.groupBy("length_class", "p_bin").agg(F.count(F.lit(1)).alias("n"))
    classes = counts.groupBy("length_class").agg(
        F.sum("n").alias("m"),
        F.array_sort(F.collect_list(F.struct("p_bin", "n"))).alias("bins"))  # at most P_BINS entries
    # bins run from small p (0) to large p
    passing = lambda bins, m: F.filter(F.transform(bins, lambda b: F.struct(
        b["p_bin"].alias("p_bin"),
        F.aggregate(F.filter(bins, lambda o: o["p_bin"] <= b["p_bin"]), F.lit(0).cast("long"),
                    lambda a, o: a + o["n"]).alias("upto"))),
        lambda b: bin_edge(b["p_bin"]) * m <= F.lit(q) * b["upto"])
    return classes.select("length_class", F.coalesce(F.array_max(F.transform(
        passing(F.col("bins"), F.col("m")), lambda b: b["p_bin"])), F.lit(-1)).alias("limit"))


def p_bin(p: Column) -> Column:
    """0 for the smallest p-values, P_BINS - 1 for p = 1; ten bins to a factor e."""
    return F.greatest(F.lit(0), (P_BINS - 1) - F.floor(-10.0 * F.log(F.greatest(p, F.lit(1e-300))))).cast("int")


def bin_edge(b: Column) -> Column:
    return F.exp(-((P_BINS - 1) - b) / 10.0)


def length_class(n: Column) -> Column:
    out = F.lit(LENGTH_CLASSES[0])
    for least in LENGTH_CLASSES[1:]:
        out = F.when(n >= least, least).otherwise(out)
    return out


def random_tokens(docs: DataFrame, doc_id="doc_id", text="text", q=0.05) -> DataFrame:
    """(doc_id, start, end, value, encoding, p_random) of the strings that the battery doesn't dismiss."""
    body = F.coalesce(F.col(text), F.lit(""))
    runs = r"[A-Za-z0-9+/_-]{%d,}=*" % LENGTH_CLASSES[0]
    tokens = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.filter(
        located(body, runs), lambda m: encoding_of(m["value"]).isNotNull())).alias("_t")).select(
        "doc_id", "_t.start", "_t.end", "_t.value")
    tested = (
        randomness(tokens).withColumn("length_class", length_class(F.col("_n")))
        .withColumn("p_bin", p_bin(F.col("p_random")))
    )
    limits = F.broadcast(dismissal_limits(tested, q))  # one row per length class
    return tested.join(limits, "length_class").filter(F.col("p_bin") > F.col("limit")).select(
        "doc_id", "start", "end", "value", "encoding", "p_random")


def secret_spans(docs: DataFrame, doc_id="doc_id", text="text", q=0.05) -> DataFrame:
    """One row per document: ``base`` and ``extra``, arrays of (start, end, kind number, kind)."""
    body = F.coalesce(F.col(text), F.lit(""))
    kind = lambda name: (F.lit(KINDS.index(name)).alias("rank"), F.lit(name).alias("kind"))
    base = F.array_sort(F.concat(*[F.transform(spans, lambda m: F.struct(m["start"], m["end"], *kind(name)))
                                   for name, spans in pattern_spans(body).items()]))
    extra = random_tokens(docs, doc_id, text, q).groupBy("doc_id").agg(F.collect_list(
        F.struct("start", "end", *kind("random"))).alias("extra"))  # bounded by the document's length
    free = F.filter(F.coalesce(F.col("extra"), F.expr(
        "cast(array() as array<struct<start:bigint,end:bigint,rank:int,kind:string>>)")), lambda e: ~F.exists(
        "base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    return docs.select(F.col(doc_id).alias("doc_id"), base.alias("base")).join(extra, "doc_id", "left").select(
        "doc_id", "base", free.alias("extra"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
