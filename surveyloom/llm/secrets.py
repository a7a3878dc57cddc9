"""Secret scans with a randomness test battery, in SQL functions only.

Patterns give the base spans. Beyond them, runs of key-like characters are read
in an inferred encoding and tested for randomness. What is reported is what
the tests show to be random, so each test's null hypothesis is a way of not
being so:

* chi-squared uniformity over groups of the alphabet, against the noncentral
  distribution that it has for words of a natural language;
* runs about the alphabet's middle, against listings and alternations: a border
  is as often crossed as in one of five, or four of five, places;
* serial correlation, against a correlation of 0.8 either way.

A run is random only if all of these fail, so its p-value is the largest of the
three. Within each encoding and length class a Benjamini-Hochberg step-up over
all runs of all texts decides which are reported; the rate bounds the share of
ordinary runs among them. A run whose bytes, decoded, are all of 7-bit text is
encoded text and is not tested. A run that meets base spans is cut there, and
what fits no encoding whole is cut for each one at the characters it lacks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, written

#: kind: (pattern, group whose length counts, least length); the order of kinds.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: What the pattern can't match without; keeps the searches off most texts.
HINTS = {"assign": r"(?i)passw|secret|token|api_?key", "access": "AKIA", "hex": "[0-9a-f]{32}"}
RUN = r"[A-Za-z0-9+/_-]+"
RUN_HINT = r"[A-Za-z0-9+/_-]{24}"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: encoding: (what a run must match, alphabet in order of value, least length).
#: A run must hold a digit and, but for hex and base32, letters of both cases.
ENCODINGS = {
    "hex_lower": (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef", 32),
    "hex_upper": (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF", 32),
    "base32": (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567", 24),
    "base64": (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 24),
    "base64url": (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 24),
}
# Letters by how often natural languages of Latin script use them.
FREQUENT, MIDDLING, SELDOM = "eaisntorh", "dlcumwfgypb", "vkjxqz"
#: encoding: groups of its alphabet with the share each has in ordinary words,
#: identifiers and paths (in hexadecimal digits: in numbers).
GROUPS = {
    "hex_lower": (("01234", 0.48), ("56789", 0.48), ("abc", 0.02), ("def", 0.02)),
    "hex_upper": (("01234", 0.48), ("56789", 0.48), ("ABC", 0.02), ("DEF", 0.02)),
    "base32": ((FREQUENT.upper(), 0.66), (MIDDLING.upper(), 0.27), (SELDOM.upper(), 0.02), ("234567", 0.05)),
    "base64": ((UPPER, 0.08), (FREQUENT, 0.57), (MIDDLING, 0.23), (SELDOM, 0.02), (DIGITS, 0.06), ("+/", 0.04)),
    "base64url": ((UPPER, 0.08), (FREQUENT, 0.57), (MIDDLING, 0.23), (SELDOM, 0.02), (DIGITS, 0.06), ("-_", 0.04)),
}
LENGTH_CLASSES = (32, 48, 96)
#: Standard deviates beyond which a statistic is not that of random symbols.
EVEN = 4.3
#: p-values are counted in bins of this many to a factor of ten.
PER_TEN = 20
MOST_BIN = 40 * PER_TEN


HIT = "struct<gap:int,size:int,fits:boolean,t:string>"


def _hits(text: Column, pattern: str, group: int, least: int, hint: str | None = None) -> Column:
    """array of HIT: a pattern's leftmost non-overlapping matches in order.

    gap is the length of what lies before a match, from the end of the one
    before; all in code points. ``hint`` keeps the search off most texts.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    both = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), sized.alias("sized"))
    hits = F.transform(both, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), (F.length(x["sized"]) >= least).alias("fits"), x["hit"].alias("t")))
    return F.when(text.rlike(hint), hits).otherwise(F.expr(f"cast(array() as array<{HIT}>)")) if hint else hits


def _placed(rows: DataFrame, keys: list[str], hits: Column) -> DataFrame:
    """(keys, s, e, t) of the hits that fit: sums of what comes before them in one text."""
    out = rows.select(*keys, F.posexplode(hits).alias("place", "hit"))
    upto = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("hit.gap") + F.col("hit.size")).over(upto).cast("int")
    out = out.select(*keys, end.alias("e"), F.col("hit.size").alias("size"), F.col("hit.fits").alias("fits"), F.col("hit.t").alias("t"))
    return out.filter("fits").select(*keys, (F.col("e") - F.col("size")).alias("s"), "e", "t")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once; plain reuse would copy its tree."""
    return F.get(F.transform(F.array(value), then), 0)


def _normal_tail(z: Column) -> Column:
    """P(Z > z) by Zelen and Severo's rational approximation (error below 1e-7)."""
    # Fixed values of the approximation.
    c = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

    def tail(a: Column) -> Column:
        poly = lambda t: t * (c[0] + t * (c[1] + t * (c[2] + t * (c[3] + t * c[4]))))
        return F.exp(-a * a / 2) / 2.5066282746310002 * _let(1 / (1 + 0.2316419 * a), poly)

    return _let(z, lambda z: _let(tail(F.abs(z)), lambda p: F.when(z >= 0, p).otherwise(1 - p)))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double"))


def _neighbours(xs: Column, f) -> Column:
    return F.zip_with(F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(xs, F.lit(2), F.size(xs) - 1), f)


def _pick(encoding: Column, values: dict[str, Column], kind: str) -> Column:
    return reduce(lambda rest, x: F.when(encoding == x[0], x[1]).otherwise(rest), values.items(), F.lit(None).cast(kind))


def _p_ordinary(run: Column, encoding: Column) -> Column:
    """How likely words have so even a chi-squared statistic over the GROUPS; 1 if
    random symbols would hardly have so uneven a one (beyond EVEN deviates).

    The statistic of words has a noncentral distribution with the noncentrality
    n * sum((share - even)² / even). The cube roots are about normal.
    """
    n = F.length(run).cast("double")

    def of(groups: tuple) -> Column:
        alphabet = sum(len(g) for g, _ in groups)
        even = [len(g) / alphabet for g, _ in groups]
        shift = sum((share - u) ** 2 / u for (_, share), u in zip(groups, even))
        seen = [n - F.length(F.translate(run, g, "")) for g, _ in groups]
        parts = [F.pow(x - n * u, F.lit(2.0)) / (n * u) for x, u in zip(seen, even)]
        df = len(groups) - 1.0
        lam = n * shift
        mean = 1 - 2 * (df + 2 * lam) / (9 * F.pow(df + lam, F.lit(2.0)))
        spread = F.sqrt(2 * (df + 2 * lam) / (9 * F.pow(df + lam, F.lit(2.0))))
        root = lambda x, k: F.pow(x / k, F.lit(1 / 3))
        even_enough = lambda x: (root(x, df) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5 <= EVEN
        return _let(reduce(lambda a, b: a + b, parts), lambda x: F.when(even_enough(x), (root(x, df + lam) - mean) / spread))

    return _let(_pick(encoding, {k: of(g) for k, g in GROUPS.items()}, "double"), lambda z: F.when(z.isNull(), 1.0).otherwise(_normal_tail(-z)))


def _p_listed(values: Column, m: Column) -> Column:
    """How likely so many crossings of the alphabet's middle are where each place has one
    with a chance of a fifth, or of four fifths."""
    places = (F.size(values) - 1).cast("double")

    def of(high: Column) -> Column:
        crossed = _total(_neighbours(high, lambda a, b: (a != b).cast("int")))
        spread = F.sqrt(places * 0.16)
        return F.greatest(_normal_tail((crossed - 0.5 - 0.2 * places) / spread), _normal_tail((0.8 * places - crossed - 0.5) / spread))

    return _let(F.transform(values, lambda v: (v * 2 >= m).cast("int")), of)


def _p_serial(values: Column) -> Column:
    """How likely so small a correlation with the next symbol is where it truly is 0.8;
    1 if random symbols would hardly have so large a one."""
    n = F.size(values).cast("double")

    def of(off: Column) -> Column:
        square = _total(F.transform(off, lambda x: x * x))
        product = _total(_neighbours(off, lambda a, b: a * b))
        r = F.when(square > 0, F.abs(product / F.when(square > 0, square) + 1 / n)).otherwise(1.0)
        return _let(r, lambda r: F.when(r * F.sqrt(n) > EVEN, 1.0).otherwise(_normal_tail((0.8 - r) / F.sqrt((1 - 0.8**2) / n))))

    return _let(_total(values) / n, lambda avg: _let(F.transform(values, lambda v: v - avg), of))


def _p_value(run: Column, encoding: Column) -> Column:
    """Of "ordinary in some way": the largest p-value of the battery."""
    alphabet = _pick(encoding, {k: F.lit(x[1]) for k, x in ENCODINGS.items()}, "string")
    symbols = F.filter(F.split(run, ""), lambda c: c != "")
    values = _let(alphabet, lambda a: F.transform(symbols, lambda c: F.instr(a, c) - 1))
    rest = _let(values, lambda v: F.greatest(_p_listed(v, F.length(alphabet)), _p_serial(v)))
    return F.greatest(_p_ordinary(run, encoding), rest)


def _is_text(run: Column, encoding: Column) -> Column:
    """Whether the bytes that a run encodes are all below 128."""
    standard = F.translate(run, "-_", "+/")
    whole = standard.substr(F.lit(1), (F.length(run) / 4).cast("int") * 4)
    base64 = F.hex(F.unbase64(F.when(encoding.startswith("base64"), whole).otherwise("")))
    digits = F.when(encoding.startswith("hex"), F.upper(run.substr(F.lit(1), (F.length(run) / 2).cast("int") * 2))).otherwise(base64)
    return F.when(encoding == "base32", False).otherwise(digits.rlike("^(?:[0-7].)+$"))


def _encoding(run: Column) -> Column:
    """The first encoding that a whole run fits, or null."""
    return reduce(
        lambda rest, x: F.when(run.rlike(x[1][0]) & (F.length(run) >= x[1][2]), F.lit(x[0])).otherwise(rest), reversed(ENCODINGS.items()), F.lit(None).cast("string")
    )


def _pieces(found: DataFrame, least: int) -> DataFrame:
    """(row, s, run): runs whole where they fit an encoding and meet no base span.

    Others are cut at the base spans, with one joining character beside each, and
    what then fits no encoding at the characters that each lacks; pieces of two
    encodings may overlap.
    """
    runs = found.select("row", F.explode("runs").alias("r"), "base").select("row", "r.s", "r.e", "r.t", "base")
    met = F.sort_array(F.filter("base", lambda b: (b["s"] < F.col("e")) & (F.col("s") < b["e"])))
    none = F.expr("named_struct('at', s, 'out', cast(array() as array<struct<s:int,e:int>>))")
    part = lambda a, b: F.array(F.struct(a.alias("s"), b.alias("e")))

    def step(acc: Column, b: Column) -> Column:
        out = F.when(acc["at"] < b["s"], F.concat(acc["out"], part(acc["at"], b["s"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], b["e"]).alias("at"), out.alias("out"))

    parts = F.aggregate(met, none, step, lambda acc: F.concat(acc["out"], part(acc["at"], F.col("e"))))
    at = lambda k: F.col("t").substr(k - F.col("s") + 1, F.lit(1)).rlike("[+/_-]").cast("int")
    left = F.when(F.col("p.s") > F.col("s"), at(F.col("p.s"))).otherwise(0)
    right = F.when(F.col("p.e") < F.col("e"), at(F.col("p.e") - 1)).otherwise(0)
    ends = runs.withColumn("p", F.explode(parts)).filter(F.col("p.e") - F.col("p.s") >= least).select("row", "s", "t", (F.col("p.s") + left).alias("a"), (F.col("p.e") - right).alias("b"))
    whole = ends.select("row", F.col("a").alias("s"), F.col("t").substr(F.col("a") - F.col("s") + 1, F.col("b") - F.col("a")).alias("run"))
    run = F.col("run")
    classes = ["[" + alphabet.replace("-", r"\-") + "]+" for _, alphabet, _ in ENCODINGS.values()]
    fits = whole.filter(_encoding(run).isNotNull()).select("row", "s", "run")
    cuts = whole.filter(_encoding(run).isNull()).select("row", F.col("s").alias("from"), "run", F.explode(F.array(*[F.lit(k) for k in range(len(classes))])).alias("class"))
    hits = reduce(lambda rest, x: F.when(F.col("class") == x[0], _hits(run, x[1], 0, least)).otherwise(rest), enumerate(classes), F.expr(f"cast(array() as array<{HIT}>)"))
    parts = _placed(cuts, ["row", "from", "class"], hits)
    return fits.unionAll(parts.select("row", (F.col("from") + F.col("s")).alias("s"), F.col("t").alias("run")).distinct())


def _tested(runs: DataFrame) -> DataFrame:
    """Adds encoding, class and the p-value's bin to rows (..., run)."""
    n = F.length("run")
    known = runs.withColumn("encoding", _encoding(F.col("run"))).filter("encoding is not null")
    known = cut(known.filter(~_is_text(F.col("run"), F.col("encoding"))))
    size = reduce(lambda c, at: c + (n >= at).cast("int"), LENGTH_CLASSES, F.lit(0))
    p = _p_value(F.col("run"), F.col("encoding"))
    # Rounded down, so that a bin stands for its largest p-value.
    binned = F.least(F.lit(MOST_BIN), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * PER_TEN).cast("int"))
    return cut(known.select("row", "s", "run", "encoding", size.alias("class"), binned.alias("bin")))


def _cuts(tested: DataFrame, rate: float) -> dict[tuple[str, int], int]:
    """Per encoding and class the least bin that the step-up reports.

    At most five encodings, four classes and 801 bins come to the driver.
    """
    counts = tested.groupBy("encoding", "class", "bin").count().collect()
    by: dict[tuple[str, int], dict[int, int]] = {}
    for r in counts:
        by.setdefault((r["encoding"], r["class"]), {})[r["bin"]] = r["count"]
    cuts = {}
    for key, bins in by.items():
        m, passed = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            passed += bins[b]
            if 10 ** (-b / PER_TEN) <= rate * passed / m:  # a bin's largest p
                cuts[key] = b
    return cuts


def find_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id and spans: array<struct<kind, start, end>> by start, then kind.

    Kinds are those of BASE, then ``random``; positions are code points, the
    end exclusive. Random spans meet no base span; where a run is cut for two
    encodings, they may overlap. Null and empty texts have no spans; repeated rows give repeated
    results; an empty table gives no rows.
    """
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    least_run = min(least for _, _, least in ENCODINGS.values())
    hits = [_hits(text, p, g, least, HINTS[k]) for k, (p, g, least) in BASE.items()] + [_hits(text, RUN, 0, least_run, RUN_HINT)]
    # One kind of hits a column, so that each is found once; most are empty.
    columns = [h.alias(f"hits{o}") for o, h in enumerate(hits)]
    every = written(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), *columns), "secret-hits")
    placed = [_placed(every.filter(F.size(f"hits{o}") > 0), ["row"], F.col(f"hits{o}")).withColumn("o", F.lit(o)) for o in range(len(hits))]
    placed = cut(reduce(DataFrame.unionAll, placed))
    span = F.struct("s", "o", "e", F.element_at(F.array(*[F.lit(k) for k in (*BASE, "random")]), F.col("o") + 1).alias("kind"), "t")
    part = lambda mine, name: F.collect_list(F.when(mine, span)).alias(name)
    found = cut(placed.groupBy("row").agg(part(F.col("o") < len(BASE), "base"), part(F.col("o") == len(BASE), "runs")))

    tested = _tested(_pieces(found, least_run))
    random = F.lit(False)
    for (encoding, size), b in _cuts(tested, rate).items():
        random = random | ((F.col("encoding") == encoding) & (F.col("class") == size) & (F.col("bin") >= b))
    added = F.struct("s", F.lit(len(BASE)).alias("o"), (F.col("s") + F.length("run")).alias("e"), F.lit("random").alias("kind"), F.col("run").alias("t"))
    kept = tested.filter(random).groupBy("row").agg(F.collect_set(added).alias("added"))
    none = F.expr("cast(array() as array<struct<s:int,o:int,e:int,kind:string,t:string>>)")
    spans = found.join(kept, "row", "full").select("row", F.concat(F.coalesce("base", none), F.coalesce("added", none)).alias("spans"))
    out = every.select("doc_id", "row").join(spans, "row", "left")
    spans_all = F.sort_array(F.coalesce("spans", none))
    return out.select("doc_id", F.transform(spans_all, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("start"), x["e"].alias("end"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns, from the operator's spans."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(F.array_join(F.transform(base, one), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", one), ",").alias("spans"),
    )
