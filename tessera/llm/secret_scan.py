"""Secrets: fixed shapes, and a randomness battery for the rest. Expressions only.

Base shapes (assign, access, hex) are found by pattern; positions come from the
lengths of the pieces between the matches, added up in passes of doubling
distance, so that a text's cost is n log n in its matches. Further candidates are
runs of 20 or more base64 characters. Each candidate's encoding is inferred from
its characters (hex, hex in dashed groups of 4 and more as in a UUID, base32,
base36 in one case, base64); runs without one (no digit, no letter, or one case
with other dashes) are no candidates.

Three tests ask whether a candidate is random in that alphabet: chi-squared for
uniformity, the runs test and the lag-1 serial correlation. The smallest p-value,
times three, is the candidate's, and below RANDOM_LEVEL it is no secret. Passing
them proves little for a short string, so a discovery needs evidence of its own:
the null hypothesis is a name (identifier, path, words with digits), whose
characters follow the letter frequencies of words and rarely change between
lower case, upper case, digits and marks. Its likelihood ratio R against
uniformly random characters has mean 1 under the null, so 1 / R bounds the
p-value; it falls with length. Benjamini-Hochberg inside each (encoding, length
band) keeps the share of names among the discoveries below ``fdr``. p-values are
rounded up to hundredths of a decade, so that the step-up needs a histogram of
bounded size, not a global sort.

Edge cases: a null text is empty and has no span; repeated rows are answered
each; very long texts and tokens are read whole; ties in start go by kind as
listed; a null id stays null; an empty table gives an empty result; positions
count code points; only the id and text columns are read, so others can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty, write_table

BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "dashed": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
# Letters of a to z in percent of English words.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0,
           2.4, 0.15, 2.0, 0.07)
# A name's next character by the one before: lower case, upper case, digit, mark.
NEXT = ((0.85, 0.08, 0.02, 0.05), (0.75, 0.20, 0.03, 0.02), (0.10, 0.10, 0.60, 0.20), (0.60, 0.25, 0.13, 0.02))
FIRST = (0.60, 0.25, 0.13, 0.02)
MARKS = 5                # + / _ - =
RANDOM_LEVEL = 1e-3
FDR = 0.05
P_FLOOR = 30.0          # p-values below 10^-30 count as that


def running_sums(numbers: Column) -> Column:
    """Prefix sums of an array, by passes of doubling distance."""
    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int") - 1, F.lit(0)))
    return F.aggregate(passes, numbers, lambda a, k: F.transform(
        a, lambda x, i: x + F.coalesce(F.get(a, i - F.pow(F.lit(2), k).cast("int")), F.lit(0))))


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """array<struct<kind, start, end, value>> of the pattern's matches."""
    def located(values: Column, gaps: Column) -> Column:
        sizes = F.transform(values, F.char_length)
        ends = running_sums(F.zip_with(F.slice(gaps, 1, F.size(values)), sizes, lambda g, n: g + n))
        return F.zip_with(values, ends, lambda v, e: F.struct(
            F.lit(kind).alias("kind"), (e - F.char_length(v)).alias("start"), e.alias("end"), v.alias("value")))
    spans = located(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.transform(F.split(text, pattern, -1), F.char_length))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), F.filter(spans, lambda s: keep(s["value"]))).otherwise(none)


def base_spans(text: Column) -> Column:
    return F.concat(
        _spans(text, ASSIGN, "assign", lambda v: F.char_length(F.regexp_extract(v, ASSIGN, 1)) >= 8),
        _spans(text, ACCESS, "access", lambda v: F.char_length(v) >= 16),
        _spans(text, HEX, "hex", lambda v: F.char_length(v) >= 32))


def _encoding(v: Column) -> Column:
    has = lambda cls: v.rlike(f"[{cls}]")
    return F.when(v.rlike("^([0-9a-f]+|[0-9A-F]+)$") & has("0-9") & has("A-Fa-f"), "hex") \
        .when(v.rlike("^([0-9a-f]{4,}(-[0-9a-f]{4,})+|[0-9A-F]{4,}(-[0-9A-F]{4,})+)$") & has("0-9") & has("A-Fa-f"), "dashed") \
        .when(v.rlike("^[A-Z2-7]+=*$") & has("2-7") & has("A-Z"), "base32") \
        .when(v.rlike("^([a-z0-9]+|[A-Z0-9]+)$") & has("0-9") & has("A-Za-z"), "base36") \
        .when(has("0-9") & has("A-Z") & has("a-z"), "base64")


def _tail(z: Column) -> Column:
    """Upper tail of the normal law (logistic approximation)."""
    return 1 / (1 + F.exp(F.least(F.greatest(1.5976 * z + 0.07056 * z * z * z, F.lit(-700.0)), F.lit(700.0))))


def randomness(cands: DataFrame) -> DataFrame:
    """Rows with ``value`` and ``encoding`` get ``p``: how well the string
    agrees with random characters of its alphabet."""
    alphabet = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])
    core = F.regexp_replace("value", "=+$", "")
    core = F.when(F.col("encoding").isin("hex", "base36"), F.lower(core)) \
        .when(F.col("encoding") == "dashed", F.lower(F.replace(core, F.lit("-")))) \
        .when(F.col("encoding") == "base64", F.translate(core, "-_", "+/")).otherwise(core)
    c = cands.withColumns({"core_": core, "abc_": alphabet[F.col("encoding")]})
    c = c.withColumns({"n_": F.length("core_").cast("double"), "k_": F.length("abc_").cast("double"),
                       "chars_": F.split("core_", "")})
    c = c.withColumn("x_", F.expr("transform(chars_, ch -> double(instr(abc_, ch)) - 1)"))
    c = c.withColumns({
        "sq_": F.expr("aggregate(array_distinct(chars_), double(0), (a, ch) -> a + pow(n_ - length(replace(core_, ch, '')), 2))"),
        "hi_": F.expr("transform(x_, x -> int(x >= k_ / 2))"),
        "s_": F.expr("aggregate(x_, double(0), (a, x) -> a + x)"),
        "s2_": F.expr("aggregate(x_, double(0), (a, x) -> a + x * x)"),
        "s11_": F.expr("aggregate(zip_with(x_, slice(x_, 2, size(x_)), (a, b) -> coalesce(a * b, double(0))), double(0), (a, b) -> a + b)")})
    c = c.withColumns({
        "n1_": F.expr("aggregate(hi_, double(0), (a, b) -> a + b)"),
        "runs_": F.expr("1 + aggregate(zip_with(hi_, slice(hi_, 2, size(hi_)), (a, b) -> if(b IS NOT NULL AND a <> b, 1, 0)), double(0), (a, b) -> a + b)"),
        # sums of whole numbers: linear in the token's length
        "cov_": F.expr("s11_ - s_ / n_ * (2 * s_ - x_[0] - x_[size(x_) - 1]) + (n_ - 1) * pow(s_ / n_, 2)"),
        "var_": F.expr("(n_ * s2_ - s_ * s_) / n_")})
    df = F.col("k_") - 1
    chi = F.col("k_") / F.col("n_") * F.col("sq_") - F.col("n_")
    z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    mean = 2 * F.col("n1_") * (F.col("n_") - F.col("n1_")) / F.col("n_") + 1
    spread = (mean - 1) * (mean - 2) / (F.col("n_") - 1)
    z_runs = F.when(spread > 0, F.abs(F.col("runs_") - mean) / F.sqrt(spread)).otherwise(F.lit(9.0))
    z_serial = F.when(F.col("var_") > 0, F.abs(F.col("cov_") / F.col("var_")) * F.sqrt("n_")).otherwise(F.lit(9.0))
    p = F.least(F.lit(1.0), 3 * F.least(_tail(z_chi), 2 * _tail(z_runs), 2 * _tail(z_serial)))
    return c.withColumn("p", p).drop("core_", "abc_", "n_", "k_", "chars_", "x_", "sq_", "hi_", "s_", "s2_", "s11_", "n1_",
                                     "runs_", "cov_", "var_")


def _name_tables() -> tuple[list[int], list[float]]:
    """By ASCII code: the class (0 to 3) and the bits of a character within it."""
    classes, bits = [3] * 128, [math.log2(MARKS)] * 128
    total = sum(LETTERS)
    for i, share in enumerate(LETTERS):
        for kind, first in ((0, "a"), (1, "A")):
            classes[ord(first) + i], bits[ord(first) + i] = kind, -math.log2(share / total)
    for i in range(10):
        classes[ord("0") + i], bits[ord("0") + i] = 2, math.log2(10)
    return classes, bits


def name_bits(value: Column) -> Column:
    """Bits of a string of base64 characters as a name."""
    classes, bits = _name_tables()
    step = F.lit([-math.log2(p) for row in NEXT for p in row])
    codes = F.transform(F.split(value, ""), F.ascii)
    kinds = F.transform(codes, lambda c: F.get(F.lit(classes), c))
    within = F.aggregate(codes, F.lit(0.0), lambda a, c: a + F.get(F.lit(bits), c))
    moves = F.zip_with(kinds, F.slice(kinds, 2, F.size(kinds)), lambda a, b: F.coalesce(F.get(step, 4 * a + b), F.lit(0.0)))
    first = F.get(F.lit([-math.log2(p) for p in FIRST]), F.get(kinds, F.lit(0)))
    return within + F.aggregate(moves, first, lambda a, b: a + b)


def name_p(cands: DataFrame) -> DataFrame:
    """Rows with ``value`` and ``encoding`` get ``q``: at most so likely does a
    name look so much more like random characters than like a name."""
    core = F.regexp_replace("value", "=+$", "")
    random_bits = F.coalesce(*[F.when(F.col("encoding") == e, F.lit(math.log2(len(abc)))) for e, abc in ALPHABETS.items()]) \
        * F.when(F.col("encoding") == "dashed", F.length(F.replace(core, F.lit("-")))).otherwise(F.length(core))
    # the dashes of a dashed key are a fixed layout: no evidence
    told = F.when(F.col("encoding") == "dashed", F.replace(core, F.lit("-"))).otherwise(core)
    return cands.withColumn("q", F.least(F.lit(1.0), F.pow(F.lit(2.0), random_bits - name_bits(told))))


def discovered_from(cands: DataFrame, fdr: float = FDR) -> DataFrame:
    """(encoding, band, cut): Benjamini-Hochberg per class over a histogram of
    q in hundredths of a decade; bins from ``cut`` up are discoveries."""
    bins = cands.groupBy("encoding", "band", "bin").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("encoding", "band").orderBy(F.desc("bin"))
    whole = Window.partitionBy("encoding", "band")
    steps = bins.withColumns({"rank": F.sum("n").over(up), "m": F.sum("n").over(whole)})
    ok = F.pow(F.lit(10.0), -F.col("bin") / 100) <= fdr * F.col("rank") / F.col("m")
    return steps.groupBy("encoding", "band").agg(F.min(F.when(ok, F.col("bin"))).alias("cut"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """(doc_id, spans): every row with its spans (kind, start, end, value), the
    base kinds by start, then those of kind ``random`` by start."""
    body = F.col("text_")
    read = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
                       text_or_empty(text).alias("text_"))
    found = write_table(read.select("rid", "doc_id", base_spans(body).alias("base"), F.filter(
        _spans(body, TOKEN, "random", lambda v: _encoding(v).isNotNull()), lambda s: s["value"].isNotNull()).alias("more")),
        "secrets-found")
    c = found.where(F.size("more") > 0).select("rid", F.explode("more").alias("s")) \
        .select("rid", "s", F.col("s.value").alias("value"), _encoding(F.col("s.value")).alias("encoding"))
    band = F.least(F.floor(F.log2(F.length("value") / 20)), F.lit(6)).cast("int")
    c = name_p(randomness(c.withColumn("band", band))).withColumn(
        "bin", F.floor(F.least(-100 * F.log10(F.greatest("q", F.lit(10 ** -P_FLOOR))), F.lit(100 * P_FLOOR))).cast("int"))
    c = write_table(c.select("rid", "s", "encoding", "band", "p", "q", "bin"), "secrets-tested")
    cuts = F.broadcast(discovered_from(c, fdr))  # a row for each encoding and band: 35 at most
    stay = c.join(cuts, ["encoding", "band"]).where((F.col("bin") >= F.col("cut")) & (F.col("p") >= RANDOM_LEVEL))
    stay = stay.groupBy("rid").agg(F.array_sort(F.collect_list("s"), lambda a, b: a["start"] - b["start"]).alias("random"))
    by_start = F.array_sort("base", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                            .otherwise(_order(a["kind"]) - _order(b["kind"])))
    return found.join(stay, "rid", "left").select(
        "doc_id", F.concat(by_start, F.coalesce("random", F.slice("base", 1, 0))).alias("spans"))


def _order(kind: Column) -> Column:
    return F.array_position(F.lit(list(BASE_KINDS)), kind).cast("int")
