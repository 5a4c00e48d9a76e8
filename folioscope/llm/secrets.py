"""Secret scans: fixed patterns, and a battery of randomness tests with control of false discoveries.

Tokens of 20 and more characters that no pattern has claimed are read in the smallest encoding that fits (hex,
base32, base64). Three tests ask whether the symbols could be drawn uniformly from it: chi-squared over the alphabet,
runs above and below its middle, and correlation of neighbours. Fisher's sum joins their p-values. A random token's p
is uniform and ordinary words crowd at 0, so in each encoding and class of lengths the number of random tokens is read
off the p-values over a quarter, and a token counts as a secret where, among tokens with a p as large as its own, the
expected share of ordinary words is small, one standard error of that number allowed; one with a p under 1/64 never does.
Classes of lengths are apart since short tokens give little evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.matching import laid_out
from folioscope.llm.common import materialize, quoted, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
BINS = 64
CLEAR = 10  # class of lengths from which a token says enough by itself: 32 symbols
SPAN = "array<struct<start:int,rank:int,end:int>>"


def _spans(text: Column, pattern: str, rank: int, group: int | None = None, least: int = 0, also: bool = False) -> Column:
    """(start, rank, end[, token]) of the pattern's matches, in code points; the gaps between matches give the starts."""
    gaps, met = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else met
    parts = F.filter(F.arrays_zip(gaps.alias("g"), met.alias("m"), value.alias("v")), lambda x: x["m"].isNotNull())
    kind = SPAN.replace("end:int", "end:int,token:string") if also else SPAN
    width = lambda x: F.length(x["g"]) + F.length(x["m"])
    one = lambda at, x: F.struct(
        (at + F.length(x["g"])).alias("start"), F.lit(rank).alias("rank"), (at + width(x)).alias("end"), F.length(x["v"]).alias("size"), *([x["m"].alias("token")] if also else [])
    )
    out = laid_out(parts, width, one, kind.replace("end:int", "end:int,size:int"))
    out = F.transform(F.filter(out, lambda x: x["size"] >= least), lambda x: F.struct(*(x[c].alias(c) for c in ("start", "rank", "end", *(["token"] if also else [])))))
    return F.when(F.regexp_like(text, F.lit(pattern)), out).otherwise(F.array().cast(kind))


def _tail(z: str) -> str:
    """SQL: the share of a standard normal above z (a rational fit of erfc, good to 2e-7)."""
    x = f"abs({z}) / sqrt(2D)"
    t = f"(1 / (1 + 0.3275911D * {x}))"
    poly = f"(((((1.061405429D * {t} - 1.453152027D) * {t} + 1.421413741D) * {t} - 0.284496736D) * {t} + 0.254829592D) * {t})"
    half = f"({poly} * exp(-pow({x}, 2)) / 2)"
    return f"if({z} >= 0, {half}, 1 - {half})"


def battery(tokens: str = "tokens") -> Column:
    """Over an array of (start, end, token): array of (start, end, enc, cls, p), p the joint p-value of the three tests.

    Each step binds what the next one uses. Counting is by string length, so a token of any length takes linear time.
    """
    pick = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALPHABETS.items())
    half = " ".join(f"WHEN '{k}' THEN '{'0' * (len(v) // 2)}{'1' * (len(v) // 2)}'" for k, v in ALPHABETS.items())
    steps = [
        "named_struct('start', c.start, 'end', c.end, 'w', translate(rtrim('=', c.token), '-_', '+/'))",
        "named_struct('start', c.start, 'end', c.end, 'w', c.w, 'enc', CASE WHEN c.w RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 'hex' WHEN c.w RLIKE '^[A-Z2-7]+$' THEN 'base32' ELSE 'base64' END)",
        f"named_struct('start', c.start, 'end', c.end, 'w', if(c.enc = 'hex', lower(c.w), c.w), 'enc', c.enc, 'abc', CASE c.enc {pick} END, 'half', CASE c.enc {half} END)",
        "named_struct('start', c.start, 'end', c.end, 'enc', c.enc, 'a', length(c.abc), 'n', greatest(length(c.w), 2), 'bits', translate(c.w, c.abc, c.half), 'codes', transform(filter(split(c.w, ''), x -> x <> ''), x -> instr(c.abc, x) - (1 + length(c.abc)) / 2D), 'squares', aggregate(split(c.abc, ''), 0D, (s, x) -> s + if(x = '', 0, pow(length(c.w) - length(replace(c.w, x, '')), 2))))",
        "named_struct('start', c.start, 'end', c.end, 'enc', c.enc, 'n', c.n, 'z1', (c.a / c.n * c.squares - c.n - (c.a - 1)) / sqrt(2 * (c.a - 1) * (1 - 1 / c.n)), 'z2', abs((length(c.bits) - length(replace(c.bits, '01', '')) + length(c.bits) - length(replace(c.bits, '10', ''))) / 2 - (c.n - 1) / 2) / sqrt((c.n - 1) / 4), 'z3', abs(aggregate(zip_with(slice(c.codes, 1, c.n - 1), slice(c.codes, 2, c.n - 1), (x, y) -> x * y), 0D, (s, x) -> s + coalesce(x, 0D))) / ((c.a * c.a - 1) / 12 * sqrt(c.n - 1)))",
        f"named_struct('start', c.start, 'end', c.end, 'enc', c.enc, 'n', c.n, 'x', -ln(greatest({_tail('c.z1')}, 1e-300D)) - ln(greatest(least(1D, 2 * ({_tail('c.z2')})), 1e-300D)) - ln(greatest(least(1D, 2 * ({_tail('c.z3')})), 1e-300D)))",
        "named_struct('start', c.start, 'end', c.end, 'enc', c.enc, 'cls', least(cast(floor(2 * log2(c.n)) as int), 32), 'p', exp(-c.x) * (1 + c.x + c.x * c.x / 2))",
    ]
    out = tokens
    for step in steps:
        out = f"transform({out}, c -> {step})"
    return F.expr(out)


def thresholds(tested: DataFrame, rate: float, least: int = 64) -> dict[tuple[str, int], float]:
    """(encoding, class of lengths) -> least p that counts as random, from the p-values of all tokens.

    A class of fewer than ``least`` tokens is taken together with the nearest classes of its encoding. Where these are few
    too, nothing can be learned of the ordinary words among them: a token of 32 symbols and more then counts as random
    unless its own p is under ``rate``, a shorter one doesn't. The table collected has a row for each encoding, class and
    bin of p: some thousands at most, whatever the input.
    """
    c = tested.select(F.explode("tested").alias("c")).select("c.enc", "c.cls", F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    held: dict[tuple[str, int], list[int]] = {}
    for enc, cls, b, n in c.groupBy("enc", "cls", "bin").count().collect():
        held.setdefault((enc, cls), [0] * BINS)[b] = n
    out = {}
    for enc, cls in sorted(held):
        n = [0] * BINS
        for _, other in sorted((abs(k - cls), k) for e, k in held if e == enc):
            if sum(n) >= least:
                break
            n = [x + y for x, y in zip(n, held[enc, other], strict=True)]
        if sum(n) < least:
            if cls >= CLEAR:
                out[enc, cls] = rate
            continue
        uniform = sum(n[BINS // 4 :]) / (BINS - BINS // 4)  # random tokens in each bin
        for b in range(1, BINS // 2 + 1):
            over = sum(n[b:])
            if over - uniform * (BINS - b) <= rate * over + over**0.5:
                out[enc, cls] = b / BINS
                break
    return out


def _scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """row (all columns), base and tested of each input row."""
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = F.col("t")
    base = F.array_sort(F.concat(_spans(t, ASSIGN, 0, 2, 6), _spans(t, ACCESS, 1), _spans(t, HEX, 2)))
    rows = rows.select("row", base.alias("base"), _spans(t, TOKEN, 3, also=True).alias("tokens"))
    free = F.filter("tokens", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return rows.select("row", "base", free.alias("tokens")).select("row", "base", battery().alias("tested"))


def _all_spans(bounds: dict[tuple[str, int], float]) -> Column:
    """Base spans and the tokens over their bound, in order."""
    if not bounds:
        return F.col("base")
    known = F.create_map(*(F.lit(x) for (enc, cls), p in sorted(bounds.items()) for x in (f"{enc}{cls}", p)))
    random = lambda c: c["p"] >= F.coalesce(F.element_at(known, F.concat(c["enc"], c["cls"].cast("string"))), F.lit(2.0))
    added = F.transform(F.filter("tested", random), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end")))
    return F.array_sort(F.concat("base", added))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """One row for each input row: id, base and spans, arrays of (start, kind, end) in order of start, then kind.

    ``base`` are the fixed patterns' matches, ``spans`` those and the tokens the tests add, which never overlap them.
    A null text is empty. Rows that repeat are scanned alike (and count as often in the p-values), an empty table gives
    an empty result, other columns are ignored.
    """
    rows = materialize(_scanned(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").select("row.id", "base", "tested"), "secrets")
    bounds = thresholds(rows, rate)
    named = lambda spans: F.transform(spans, lambda c: F.struct(c["start"].alias("start"), F.element_at(F.array(*map(F.lit, KINDS)), c["rank"] + 1).alias("kind"), c["end"].alias("end")))
    return rows.select(F.col("id").alias(id_col), named(F.col("base")).alias("base"), named(_all_spans(bounds)).alias("spans"))


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", rate: float = 0.05) -> DataFrame:
    """The documents with each span that was found replaced; one that overlaps an earlier one is masked along with it.

    Texts are scanned twice, first for the bounds and then in their rows, so nothing is joined: rows that repeat an id or
    have none are masked like others. A null text stays null, an empty table empty; other columns pass through whatever
    their names.
    """
    bounds = thresholds(_scanned(docs.select(F.col(text_col).alias("text")), "text"), rate)
    rows = _scanned(docs, text_col).select("row", _all_spans(bounds).alias("spans"))
    # what a span leaves open: from the furthest end before it to its start
    text, spans = F.col("row").getField(text_col), F.col("spans")
    furthest = lambda i: F.array_max(F.transform(F.slice(spans, 1, i), lambda c: c["end"]))
    kept = F.transform(spans, lambda c, i: F.struct(F.when(i > 0, furthest(i)).otherwise(F.lit(0)).alias("from"), c["start"].alias("to")))
    pieces = F.transform(F.filter(kept, lambda k: k["to"] >= k["from"]), lambda k: F.concat(text.substr(k["from"] + 1, k["to"] - k["from"]), F.lit(mask)))
    rest = text.substr(F.array_max(F.transform(spans, lambda c: c["end"])) + 1, F.length(text))
    cut = F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)
    return rows.select(*(cut.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def op10(spark, sf_dir: str) -> DataFrame:
    """Query op10_secret_scan: every row of ``documents``."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))
