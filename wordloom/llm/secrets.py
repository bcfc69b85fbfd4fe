"""Secret scans by a battery of randomness tests.

Base patterns (assignments, access keys, long hex) are found first; their spans always stay.  The
method adds random-looking tokens that no base span touches.  A candidate is a run of at least
``LEAST`` base-64 characters.  Its encoding is inferred from the characters it has, and in that
alphabet of k symbols three tests are made: chi-squared uniformity, the runs test about the
alphabet's middle, and lag-1 serial correlation.  The battery's statistic is their sum, chi-squared
plus the squares of the other two z: in a random token the three do not depend on each other
(composition, then order) and the sum is chi-squared with k + 1 degrees of freedom.  A token is
compared with ordinary text of its length and encoding: there the statistic is non-central, with the
excess per character that the candidates of that encoding show over the whole corpus, so a short
token cannot look random by having too few characters for the test.  Where runs or serial
correlation alone reject randomness (|z| over ``LIMIT_Z``, as in an alphabet written out) the token
is no discovery whatever the sum says.  Benjamini-Hochberg control at ``FDR`` then runs inside each
(encoding, length band), on counts of binned probabilities from all documents.

Everything runs on DataFrame expressions.  Spans are code points, end exclusive.  Only sums per
stratum (at most 6 encodings x 8 bands) and bins come to the driver.  Null and empty texts have no
spans.  Rows do not depend on their neighbours, so ties and repeated rows keep their own results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The base patterns and the characters of candidates.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a shorter run has no match inside it either
HEX = r"[0-9a-f]{32,}"
LEAST = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
ENCODINGS = [  # name, what all characters are, alphabet in order
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("base36", r"^(?:[a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
]
FDR = 0.01
LIMIT_Z = 3.3
BIN, BINS = 10, 400  #: bins a decade of probability, and their number
LETTER_MATCH = 0.065  #: chance that two letters of ordinary text are equal


def least_excess(encoding: int) -> float:
    """What ordinary text has at least of excess chi-squared per character in an alphabet."""
    return max(0.5, LETTER_MATCH * len(ENCODINGS[encoding][2]) - 1)


def _normal_log10_tail(z: Column) -> Column:
    """log10 of the lower normal tail at z (the Abramowitz-Stegun polynomial, its asymptote far out)."""
    far = -(z * z) / 2 / 2.302585092994046 - F.log10(F.sqrt(z * z + F.lit(1.0)) * 2.5066282746310002)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-(z * z) / 2) * 0.3989422804014327 * poly
    return F.when(z < -5, far).when(z < 0, F.log10(upper)).otherwise(F.log10(1 - upper))


def places(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Array of ``(start, kind, end, token)`` of the pattern's matches that ``keep`` accepts, by start."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)  # what lies between: one more than there are matches
    none = F.array().cast("array<struct<start:int,kind:int,end:int,token:string>>")
    state = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["token"])
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["token"].alias("token")))
        return F.struct(end.alias("at"), (F.when(keep(pair["token"]), F.concat(acc["out"], one)).otherwise(acc["out"]) if keep else F.concat(acc["out"], one)).alias("out"))

    pairs = F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("gap"), found.alias("token"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, state, step, lambda acc: acc["out"])).otherwise(none)


def base_places(text: Column) -> Column:
    long_value = lambda token: F.length(F.regexp_extract(token, ASSIGN, 1)) >= 8
    return F.concat(places(text, ASSIGN, 0, long_value), places(text, ACCESS, 1), places(text, HEX, 2))


def _with(found: Column, keep: list[str], **new) -> Column:
    """Array of structs with further fields; each step's fields are computed once and then only read."""
    return F.transform(found, lambda c: F.struct(*[c[k].alias(k) for k in keep], *[f(c).alias(k) for k, f in new.items()]))


def _battery(found: Column) -> Column:
    """Candidates with their encoding, chi-squared statistic, degrees of freedom and the other tests' z."""

    def encoding(c):
        out = F.lit(len(ENCODINGS) - 1)
        for number in range(len(ENCODINGS) - 2, -1, -1):
            out = F.when(c["token"].rlike(ENCODINGS[number][1]), number).otherwise(out)
        return out

    def total(values, f):
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + f(v))

    place, what = ["start", "end"], ["start", "end", "encoding", "n"]
    found = _with(found, [*place, "token"], encoding=encoding, n=lambda c: F.length(c["token"]).cast("double"))
    found = _with(found, what, alphabet=lambda c: F.element_at(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), c["encoding"] + 1),
                  text=lambda c: F.when(c["encoding"].isin(1, 4), F.lower(c["token"])).otherwise(c["token"]))
    found = _with(found, [*what, "text"], k=lambda c: F.length(c["alphabet"]).cast("double"), chars=lambda c: F.split(c["text"], ""), alphabet=lambda c: c["alphabet"])
    found = _with(found, [*what, "k"], values=lambda c: F.transform(c["chars"], lambda x: F.call_function("instr", c["alphabet"], x).cast("double")),
                  squares=lambda c: total(F.array_distinct(c["chars"]), lambda x: F.pow(c["n"] - F.length(F.replace(c["text"], x, F.lit(""))), F.lit(2.0))))
    found = _with(found, [*what, "k", "squares", "values"], behind=lambda c: F.array_append(F.slice(c["values"], F.lit(2), F.size(c["values"])), F.element_at(c["values"], 1)))
    found = _with(
        found, [*what, "k", "squares"], sum=lambda c: total(c["values"], lambda v: v), power=lambda c: total(c["values"], lambda v: v * v),
        lagged=lambda c: total(F.zip_with(c["values"], c["behind"], lambda x, y: x * y), lambda v: v),
        high=lambda c: total(c["values"], lambda v: F.when(v > c["k"] / 2, 1.0).otherwise(0.0)),
        flips=lambda c: total(F.zip_with(c["values"], c["behind"], lambda x, y: F.when((x > c["k"] / 2) != (y > c["k"] / 2), 1.0).otherwise(0.0)), lambda v: v)
        + F.when((F.element_at(c["values"], 1) > c["k"] / 2) != (F.element_at(c["values"], -1) > c["k"] / 2), 0.0).otherwise(1.0),
    )
    found = _with(found, [*what, "k", "squares", "lagged", "flips", "sum"], spread=lambda c: c["n"] * c["power"] - c["sum"] * c["sum"], mean=lambda c: 2 * c["high"] * (c["n"] - c["high"]) / c["n"] + 1)
    found = _with(found, [*what, "k", "squares", "lagged", "flips", "sum", "spread", "mean"], variance=lambda c: (c["mean"] - 1) * (c["mean"] - 2) / (c["n"] - 1))
    return _with(
        found, what, band=lambda c: F.least(F.floor(F.log2(c["n"] / LEAST) * 2), F.lit(7)).cast("int"), chi2=lambda c: c["k"] / c["n"] * c["squares"] - c["n"], df=lambda c: c["k"] - 1,
        runs=lambda c: F.when(c["variance"] <= 0, 99.0).otherwise((c["flips"] - c["mean"]) / F.sqrt(c["variance"])),
        serial=lambda c: F.when(c["spread"] <= 0, 99.0).otherwise((c["n"] * c["lagged"] - c["sum"] * c["sum"]) / c["spread"] * F.sqrt(c["n"])),
    )


def _sum(c: Column) -> Column:
    """The battery's statistic: chi-squared of ``df + 2`` degrees of freedom for a random token."""
    return c["chi2"] + c["runs"] * c["runs"] + c["serial"] * c["serial"]


def _ordered_like_random(c: Column) -> Column:
    return (F.abs(c["runs"]) <= LIMIT_Z) & (F.abs(c["serial"]) <= LIMIT_Z)


def _score(c: Column, excess: Column) -> Column:
    """Bin of -log10 of the probability that ordinary text passes the battery as well as the candidate."""
    shift, df = (c["n"] - 1) * excess, c["df"] + 2
    z = (_sum(c) - df - shift) / F.sqrt(2 * df + 4 * shift)
    p = F.when(_ordered_like_random(c), -_normal_log10_tail(z)).otherwise(0.0)
    return F.least(F.floor(p * BIN), F.lit(BINS)).cast("int")


def candidates(text: Column, base: Column) -> Column:
    found = places(text, CANDIDATE, 3)
    free = F.filter(found, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return _battery(free)


def excesses(spans: DataFrame) -> dict[int, float]:
    """Excess of the battery's statistic per character of each encoding, at least that of letters.

    Over all candidates that could be a discovery: one whose order tests reject randomness (a rule of
    dashes, say) would stretch the null distribution of all others.
    """
    c = spans.select(F.explode(F.filter("candidates", _ordered_like_random)).alias("c"))
    rows = c.groupBy("c.encoding").agg(F.sum(_sum(F.col("c")) - F.col("c.df") - 2).alias("x"), F.sum(F.col("c.n") - 1).alias("n")).collect()
    return {r.encoding: max(least_excess(r.encoding), r.x / r.n) for r in rows}


def cuts(scored: DataFrame) -> dict[tuple[int, int], int]:
    """Benjamini-Hochberg in every (encoding, length band): the least bin that is called random."""
    rows = scored.select(F.explode("candidates").alias("c")).select("c.encoding", "c.band", "c.bin").groupBy("encoding", "band", "bin").agg(F.count("*").alias("n")).collect()
    strata: dict[tuple[int, int], dict[int, int]] = {}
    for r in rows:  # at most encodings x bands x bins
        strata.setdefault((r.encoding, r.band), {})[r.bin] = r.n
    out = {}
    for key, bins in strata.items():
        tests, rank = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            rank += bins[b]
            if 10.0 ** (-b / BIN) * tests <= FDR * rank:
                out[key] = b
    return out


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (the input row), ``text`` (null: empty) and ``spans``: array of (start, kind, end), sorted."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"))
    own = rows.select("*", base_places(F.col("text")).alias("base"))
    own = own.select("*", candidates(F.col("text"), F.col("base")).alias("candidates"))
    excess = excesses(own)
    shares = F.array(*[F.lit(float(excess.get(e, least_excess(e)))) for e in range(len(ENCODINGS))])
    scored = own.select("row", "text", "base", F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["encoding"].alias("encoding"), c["band"].alias("band"), _score(c, F.element_at(shares, c["encoding"] + 1)).alias("bin"))).alias("candidates"))
    bars = cuts(scored)
    accept = lambda c: F.element_at(F.array(*[F.lit(bars.get((e, b), BINS + 1)) for e in range(len(ENCODINGS)) for b in range(8)]), c["encoding"] * 8 + c["band"] + 1) <= c["bin"]
    plain = lambda c, kind: F.struct(c["start"].alias("start"), kind.alias("kind"), c["end"].alias("end"))
    base = F.transform("base", lambda c: plain(c, c["kind"]))
    added = F.transform(F.filter("candidates", accept), lambda c: plain(c, F.lit(3)))
    return scored.select("row", "text", F.array_sort(F.concat(base, added)).alias("spans"))


def digest(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs``, all columns; in the text every span (overlapping ones together) is ``mark``."""
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    found = scan(docs, text_col)
    return found.select(*[F.when(F.size("spans") > 0, whole).otherwise(F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return found.select("row.doc_id", count(0), count(1), count(2), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
