"""PII [native]: high-recall generators, boosted trees over format and context, calibrated thresholds.

Base detectors (email, ip, card, phone) are exact rules and always stay. Loose generators propose what
the rules miss: masked addresses, plain national numbers, cards with other separators, and random-looking
strings (secret). Two views of a candidate are kept apart, as in co-training. Its check is what a value
of the kind must fulfil when written plainly (digits and their checksum, parts, a top-level name, changes
between letters and digits). Its features are surroundings and style: words before it, characters beside it,
separators, brackets, length class of strings; the check is none of them. Trees learn from all
spans of the exact forms, labelled by the check, so what they decide is whether such surroundings hold
real values or version, order and price numbers. Gradient boosting of depth-two trees is fitted
to fold 0; fold 1 sets, per kind, the least margin at which the precision of all above is PRECISION. A loose
candidate is added if its check holds and its margin passes; one that a base span or an earlier added
one reaches into is not.

One aggregation counts all examples of the corpus by feature cell and fold, so what reaches the driver is
bounded by the number of cells (product of the bins), not by the data. Trees become one SQL expression. No
Python runs on executors: positions are sums of the lengths of the text between and inside matches, added in
blocks, so a text with very many spans takes little more than time in proportion.

Cases: null text counts as empty and has no spans; ties of start are ordered by kind; equal texts give
equal spans; repeated rows are kept; an empty table or no positive example fits no trees and adds no
spans; other columns pass through `redact` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import Cut, clear_of, table, text_of

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds of the exact rules.
RULES = KINDS[:4]
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_LOCAL = "A-Za-z0-9._%+-"
# The rules of the contract; what stands before a match only keeps the search from starting inside a run
# that failed at its start, which changes no match and keeps the search linear.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"\x20?(?:\(at\)|\[at\])\x20?", r"(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.)"
LOOSE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++(?:{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++|@[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){0,2}(?:\[\.\]|\(\.\))[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){0,2}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?<!\+[0-9]{1,3}[\x20.-])(?<!\+[0-9]{1,3}\x20\()\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+",
}
#: Cheap conditions without which a kind cannot occur.
GATE = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9]\.[0-9]|[0-9][\[(]\.", "card": r"[0-9][\x20./_-]?[0-9][\x20./_-]?[0-9][\x20./_-]?[0-9][\x20./_-]?[0-9]", "phone": r"\+[0-9]|[0-9]{3}\)?[\x20.-]", "secret": "[A-Za-z_-][0-9]|[0-9][A-Za-z_-]"}
CONTEXT = (r"version|isbn|order|invoice|serial|release|build|price|model|part|item|sku", r"phone|tel|call|fax|mobile|whatsapp|dial|number", r"mail|contact|write|send|reach", r"card|visa|credit|pay|iban|account", r"\bip\b|host|server|addr|ping", r"passw|token|secret|key|pwd|auth|login", r"commit|hash|sha|md5|digest|checksum|uuid")
REACH = 24
FEATURES = {"kind": 5, "marks": 5, "paren": 2, "context": 8, "left": 5, "right": 5, "length": 5}
ROUNDS, RATE, PRECISION = 30, 0.3, 0.95


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element, what the elements before it join to. In blocks of the root of the size, as every step
    of an aggregation copies the array that it appends to."""
    scan = lambda x: F.aggregate(x, F.array(zero), lambda s, v: F.concat(s, F.array(join(F.element_at(s, -1), v))))

    def blocks(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: scan(F.slice(v, b * width + 1, width)))
        ahead = lambda p: scan(F.transform(p, lambda x: F.element_at(x, -1)))
        whole = lambda p, before: F.flatten(F.zip_with(p, F.slice(before, 1, F.size(p)), lambda x, o: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: join(o, y))))
        return let(parts, lambda p: let(ahead(p), lambda before: whole(p, before)))

    return F.when(F.size(values) > 0, let(values, blocks)).otherwise(F.slice(values, 1, 0))


def matches(text: Column, pattern: str, gate: str) -> Column:
    """Array of (start, end, m): all matches from left to right, in code points."""
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, m: STRING>>)")
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def placed(x: Column) -> Column:
        pairs = F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], lambda g, m: F.struct((F.length(g) + F.length(m)).alias("n"), m.alias("m")))
        starts = lambda p: running(F.transform(p, lambda y: y["n"]), F.lit(0), lambda a, b: a + b)
        span = lambda y, b: F.struct((b + y["n"] - F.length(y["m"])).alias("start"), (b + y["n"]).alias("end"), y["m"].alias("m"))
        return let(pairs, lambda p: F.zip_with(p, starts(p), span))

    return F.when(text.rlike(gate), let(both, lambda x: F.when(F.size(x["found"]) > 0, placed(x)).otherwise(none))).otherwise(none)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.reverse(digits_of(m))
    at = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(d))), F.lit(0), lambda s, i: s + F.coalesce(F.when(i % 2 == 0, twice(at(i))).otherwise(at(i)), F.lit(0)))
    return total % 10 == 0


def fulfils(kind: str, m: Column, exact: bool = False) -> Column:
    """The check of a value of this kind; exact: as the contract words it."""
    if kind == "ip":
        return F.regexp_replace(m, r"[\[\]()]", "").rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits_of(m)).between(14, 19) & luhn(m)
    if kind == "phone":
        return F.length(digits_of(m)).between(10, 15)
    if kind == "email":
        return F.lit(True) if exact else m.rlike("[A-Za-z]{2,}$")
    return F.regexp_count(m, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")) >= 3


def spans(text: Column, rules: dict[str, str], only_valid: bool) -> Column:
    """Array of (start, kind, end, m) of all kinds, sorted by start, then kind."""
    def of_kind(name: str) -> Column:
        found = matches(text, rules[name], GATE[name])
        if only_valid and name != "email":
            found = F.filter(found, lambda x: fulfils(name, x["m"], True))
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(name)).alias("kind"), x["end"].alias("end"), x["m"].alias("m")))

    return F.array_sort(F.concat(*[of_kind(name) for name in rules]))


def side(c: Column) -> Column:
    """Class of a neighbouring character: 0 none or white space, 1 letter, 2 digit, 3 quote or sign of assignment, 4 other."""
    return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike(r"^\p{L}$"), 1).when(c.rlike("^[0-9]$"), 2).when(c.rlike("^[=:\"'`]$"), 3).otherwise(4)


def featured(text: Column, x: Column) -> Column:
    """The binned features of a candidate."""
    m, kind = x["m"], x["kind"]
    marks = F.regexp_replace(m, r"[0-9A-Za-z()\[\]+@]", "")
    before = F.lower(F.substring(text, F.greatest(F.lit(1), x["start"] - REACH + 1), F.least(F.lit(REACH), x["start"])))

    def words(c: Column) -> Column:
        out = F.lit(0)
        for k in reversed(range(len(CONTEXT))):
            out = F.when(c.rlike(CONTEXT[k]), k + 1).otherwise(out)
        return out

    n = F.length(m)
    return F.struct(
        kind.cast("int").alias("kind"),
        F.when(marks == "", 0).when(marks.rlike(r"^\x20+$"), 1).when(marks.rlike("^-+$"), 2).when(marks.rlike(r"^\.+$"), 3).otherwise(4).alias("marks"),
        m.contains("(").cast("int").alias("paren"),
        let(before, words).alias("context"),
        F.when(x["start"] > 0, side(F.substring(text, x["start"], F.lit(1)))).otherwise(0).alias("left"),
        side(F.substring(text, x["end"] + 1, F.lit(1))).alias("right"),
        F.when(kind != KINDS.index("secret"), 0).when(n < 20, 1).when(n < 33, 2).when(n < 65, 3).otherwise(4).alias("length"),
    )


PLAIN = "ARRAY<STRUCT<start: INT, kind: INT, end: INT>>"


def candidates(docs: DataFrame, names: list[str]) -> DataFrame:
    """Adds under three names: spans of the rules; features `f` and label `y` of all spans of the exact forms and of
    strings; loose candidates (start, kind, end, f, ok)."""
    text, (first, seeds, more) = text_of(docs), names
    body, exact, loose = clear_of(docs.select("*", *[F.lit(0).alias(n) for n in names]), "_text", "_exact", "_loose")
    out = docs.withColumn(body, text).withColumns({exact: spans(F.col(body), BASE, False), loose: spans(F.col(body), LOOSE, False)})
    pick = lambda x, how: F.coalesce(*[F.when(x["kind"] == KINDS.index(k), how(k, x["m"])) for k in KINDS])
    valid = lambda x: pick(x, lambda k, m: fulfils(k, m, True))
    is_secret = lambda x: x["kind"] == KINDS.index("secret")
    example = lambda x: F.struct(featured(F.col(body), x).alias("f"), pick(x, fulfils).cast("int").alias("y"))
    offer = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), featured(F.col(body), x).alias("f"), pick(x, fulfils).alias("ok"))
    plain = F.transform(F.filter(exact, valid), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return out.withColumns({
        first: plain,
        seeds: F.transform(F.concat(exact, F.filter(loose, is_secret)), example),
        more: F.transform(loose, offer),
    }).drop(body, exact, loose)


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = ROUNDS) -> list[tuple]:
    """Trees (feature, bin, ((feature, bin, below, above) for each side)) on weighted cells; logistic loss, Newton leaves."""
    g, trees = np.zeros(len(y)), []
    tests = [(f, b) for f, n in enumerate(FEATURES.values()) for b in range(n - 1)]
    masks = [x[:, f] <= b for f, b in tests]

    def leaf(where: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[float, float]:
        a, h = grad[where].sum(), hess[where].sum() + 1.0
        return RATE * a / h, a * a / h

    def best(where: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[float, int, float, float]:
        found = (-1.0, 0, 0.0, 0.0)
        for k, mask in enumerate(masks):
            (v1, q1), (v2, q2) = leaf(where & mask, grad, hess), leaf(where & ~mask, grad, hess)
            found = max(found, (q1 + q2, -k, v1, v2))
        return found

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-g))
        grad, hess = w * (y - p), w * p * (1 - p)
        _, k, *_ = best(np.ones(len(y), bool), grad, hess)
        mask, sides = masks[-k], []
        for where in (mask, ~mask):
            _, k2, v1, v2 = best(where, grad, hess)
            sides.append((*tests[-k2], v1, v2))
            g = g + np.where(where, np.where(masks[-k2], v1, v2), 0.0)
        trees.append((*tests[-k], tuple(sides)))
    return trees


def margins(x: np.ndarray, trees: list[tuple]) -> np.ndarray:
    g = np.zeros(len(x))
    for f, b, sides in trees:
        for where, (f2, b2, v1, v2) in zip((x[:, f] <= b, x[:, f] > b), sides, strict=True):
            g += np.where(where, np.where(x[:, f2] <= b2, v1, v2), 0.0)
    return g


def margin_of(f: Column, trees: list[tuple]) -> Column:
    """The trees as one expression."""
    names, total = list(FEATURES), F.lit(0.0)
    part = lambda s: F.when(f[names[s[0]]] <= s[1], float(s[2])).otherwise(float(s[3]))
    for feature, b, sides in trees:
        total = total + F.when(f[names[feature]] <= b, part(sides[0])).otherwise(part(sides[1]))
    return total


def fit(found: DataFrame, names: list[str], fold: Column) -> dict:
    """trees and the threshold of each kind (infinite: none of its candidates is trusted), from a table of candidates()."""
    cells = found.select((F.pmod(fold, F.lit(2))).alias("fold"), F.explode(names[1]).alias("c")).groupBy("fold", *[F.col(f"c.f.{n}").alias(n) for n in FEATURES], F.col("c.y").alias("y")).agg(F.count("*").alias("n"))
    rows = cells.collect()  # at most 2 * 2 * the product of the bins
    rows.sort(key=lambda r: tuple(r))
    x = np.asarray([[r[n] for n in FEATURES] for r in rows], dtype=np.int64).reshape(len(rows), len(FEATURES))
    y, w, half = (np.asarray([r[k] for r in rows], dtype=np.float64) for k in ("y", "n", "fold"))
    out = {"trees": [], "thresholds": [math.inf] * len(KINDS)}
    if not y[half == 0].any():
        return out
    out["trees"] = boost(x[half == 0], y[half == 0], w[half == 0])
    g = margins(x, out["trees"])
    for k in range(len(KINDS)):
        own = (half == 1) & (x[:, 0] == k)
        for t in sorted(set(g[own].tolist())):
            above = own & (g >= t)
            if (w * y)[above].sum() >= PRECISION * w[above].sum():
                out["thresholds"][k] = t
                break
    return out


def chosen(first: Column, more: Column, model: dict) -> Column:
    """Array of (start, kind, end): the spans of the rules and those that are added, sorted."""
    if not model["trees"]:
        return first

    def trusted(x: Column) -> Column:
        t = F.lit(math.inf)
        for k, v in enumerate(model["thresholds"]):
            t = F.when(x["kind"] == k, float(v)).otherwise(t)
        return x["ok"] & (margin_of(x["f"], model["trees"]) >= t - 1e-9)

    # rules first where starts are equal, then the longer, then by kind
    row = lambda x, own: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), (-x["end"]).alias("back"), x["kind"].alias("kind"))
    far = F.lit((1 << 31) - 1)
    ends = lambda s, own: running(F.transform(s, lambda x: F.when(x["own"] == own, -x["back"]).otherwise(0)), F.lit(0), F.greatest)
    starts = lambda s: F.reverse(running(F.transform(F.reverse(s), lambda x: F.when(x["own"] == 0, x["start"]).otherwise(far)), far, F.least))

    def resolve(s: Column) -> Column:
        free = lambda before, after: F.filter(s, lambda x, i: (x["own"] == 0) | (F.get(before, i) <= x["start"]) & (F.get(after, i) >= -x["back"]))
        first_of = lambda t: let(ends(t, 1), lambda reach: F.filter(t, lambda x, i: (x["own"] == 0) | (F.get(reach, i) <= x["start"])))
        left = let(ends(s, 0), lambda before: let(starts(s), lambda after: let(free(before, after), first_of)))
        return F.transform(left, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), (-x["back"]).alias("end")))

    added = F.filter(more, trusted)
    every = lambda a: F.array_sort(F.concat(F.transform(first, lambda x: row(x, 0)), F.transform(a, lambda x: row(x, 1))))
    return let(added, lambda a: F.when(F.size(a) == 0, first).otherwise(F.array_sort(let(every(a), resolve))))


def named(spans_column: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans_column, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names, cut = ["base", "seeds", "more"], Cut(spark)
    found = cut(candidates(docs, names).select("doc_id", F.xxhash64("text").alias("fold"), *names))
    model = fit(found, names, F.col("fold"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(RULES)]
    return found.select("doc_id", *counts, F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(chosen(F.col("base"), F.col("more"), model)).alias("spans"))


#: Spans of a text from which pieces are taken from an array of its characters: finding a place in a string takes time with its distance.
MANY = 32


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; n_chars follows where it is there."""
    names = clear_of(docs, "_pii_base", "_pii_seeds", "_pii_more", "_pii_spans", "_pii_clean")
    found = Cut(docs.sparkSession)(candidates(docs, names[:3]))
    model = fit(found, names, F.xxhash64("text"))
    kept, new = F.col(names[3]), F.col(names[4])
    out = found.withColumn(names[3], chosen(F.col(names[0]), F.col(names[2]), model))
    text = text_of(out)
    mark = lambda x: F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), x["kind"] + 1)

    def clean(piece: Callable[[Column, Column], Column]) -> Column:
        # overlapping spans go as a whole: a later one that reaches further is marked too
        reach = running(F.transform(kept, lambda x: x["end"]), F.lit(0), F.greatest)
        parts = F.zip_with(kept, reach, lambda x, at: F.when(x["end"] <= at, "").otherwise(F.concat(piece(at, F.greatest(F.lit(0), x["start"] - at)), mark(x))))
        last = F.array_max(F.transform(kept, lambda x: x["end"]))
        return F.concat(F.array_join(parts, ""), piece(last, F.length(text) - last))

    few = clean(lambda at, n: F.substring(text, at + 1, n))
    many = let(F.split(text, ""), lambda c: clean(lambda at, n: F.array_join(F.slice(c, at + 1, n), "")))
    out = out.withColumn(names[4], F.when(F.size(kept) == 0, F.col("text")).when(F.size(kept) <= MANY, few).otherwise(many))
    value = {"text": new.alias("text")}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.when(F.size(kept) > 0, F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[value.get(c, F.col(c)) for c in docs.columns])
