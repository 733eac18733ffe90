"""Selection of the better of two names, with its source and the reason, or an abstention.

All rules are expressions over per-side scores; scores are computed once per side in a lower projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text as t
from tallyframe.functions.once import once
from tallyframe.operators.names import same, with_forms
from tallyframe.operators.profile import share_of_all

# Words that stay lower-case inside names, and elided particles before an apostrophe (fixed values).
PARTICLES = (
    "de", "del", "della", "delle", "dei", "degli", "dello",
    "di", "da", "du", "des", "la", "le", "les", "l",
    "el", "los", "las", "do", "da", "dos", "das",
    "van", "von", "den", "der", "het",
    "of", "the", "and", "in", "at", "by", "for", "to", "on",
    "e", "y",
)
ELISIONS = ("d", "l", "n", "s", "c", "qu", "j", "m")
# Words that say what a place is (fixed values).
BUSINESS = (
    "hotel", "motel", "inn", "hostel", "resort", "lodge",
    "bar", "pub", "cafe", "café", "bistro", "restaurant", "grill",
    "pizzeria", "trattoria", "brasserie", "tavern", "cantina",
    "spa", "salon", "studio", "clinic", "pharmacy", "apotheke",
    "hospital", "medical", "dental",
    "supermarket", "market", "mart", "grocery", "store", "shop",
    "boutique", "gallery", "museum", "theater", "theatre", "cinema",
    "school", "academy", "university", "college", "institute",
    "church", "mosque", "temple", "cathedral",
    "gym", "fitness", "arena", "stadium",
    "bank", "insurance", "agency",
    "sportsbar", "brewpub", "coffeehouse",
    "inc", "llc", "ltd", "gmbh", "srl", "corp", "plc",
    "ag", "sa", "ltda", "pty", "co",
    "branch", "outlet", "location", "mall", "plaza", "center", "centre",
    "atm",
)

LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
UPPER, LOWER = "\\p{Lu}", "\\p{Ll}"
APOSTROPHE = "['’]"


def times(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(c, "\\s+", " ")), " "), lambda w: w != "")


def latin_of(w: Column) -> Column:
    return F.regexp_replace(w, f"[^{LATIN}]", "")


def good_apostrophes(c: Column) -> Column:
    """Apostrophes that language explains: at a word's end after three letters, before a capital after at most
    two letters (or none), and before anything else."""
    end = times(c, f"(?<=\\p{{L}}\\p{{L}}\\p{{L}}){APOSTROPHE}(?= |$)")
    capital = times(c, f"(?<!\\p{{L}}\\p{{L}}\\p{{L}}){APOSTROPHE}(?={UPPER})")
    other = times(c, f"{APOSTROPHE}(?! |$|{UPPER})")
    return F.coalesce(end + capital + other, F.lit(0))


def branded(c: Column) -> Column:
    """A small letter before a capital inside a word that is not all capitals."""
    return F.exists(F.filter(tokens(c), lambda w: w.rlike(f"{LOWER}{UPPER}")), lambda w: (latin_of(w) != "") & (latin_of(w) != F.upper(latin_of(w))))


def word_facts(w: Column) -> Column:
    """What the score of a word looks at, computed once a word."""
    latin = latin_of(w)
    bare = F.regexp_replace(F.lower(w), "['.,;:!?]+$", "")
    return F.struct(w.alias("w"), latin.alias("latin"), F.lower(latin).alias("low"), F.upper(latin).alias("up"), bare.isin(*PARTICLES).alias("particle"), w.rlike(APOSTROPHE).alias("marked"))


def word_score(f: Column, i: Column) -> Column:
    w, latin = f["w"], f["latin"]
    lower, upper = latin == f["low"], latin == f["up"]

    def before(mark: str) -> Column:
        return F.when(F.instr(w, mark) > 1, F.substring_index(w, mark, 1))

    def elision(mark: str) -> Column:
        p = before(mark)
        return F.when((i > 0) & F.lower(p).isin(*ELISIONS), F.when(p == F.lower(p), 2).otherwise(-1)).otherwise(0)

    def shouted(mark: str) -> Column:
        return F.when((F.length(before(mark)) > 2) & w.rlike(f"^[^{mark}]+{mark}{UPPER}"), -3).otherwise(0)

    particle = F.when(lower, 2).when(upper, -1).otherwise(1)
    content = F.when(upper & (F.length(latin) > 4), -1).when(upper, 3).when(latin.rlike(f"^{UPPER}") & (F.substring(latin, 2, 1 << 20) == F.substring(f["low"], 2, 1 << 20)), 2).otherwise(0)
    own = F.when(f["particle"] & (i > 0), particle).otherwise(content)
    marks = ("'", "’")
    extra = F.when(f["marked"], elision(marks[0]) + elision(marks[1]) + shouted(marks[0]) + shouted(marks[1])).otherwise(0)
    return F.when(latin == "", 0).otherwise(own + extra)


def casing_score(c: Column) -> Column:
    """Points for title case, small particles and short capitals; minus for shouting and misplaced capitals."""
    words = F.aggregate(F.transform(F.transform(tokens(c), word_facts), word_score), F.lit(0), lambda s, x: s + x)
    latin = latin_of(c)
    bonus = F.when(t.has_cjk(c) & (latin != "") & latin.rlike(f"^{UPPER}+$"), 5).otherwise(0)
    return F.coalesce(words + bonus, F.lit(0))


def with_scores(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Adds the scores of both names, each computed once; null for rows that do not meet `where`. Casing, the dearest,
    is scored where the scores before it decide nothing, and null elsewhere."""
    out = {}
    for s in ("alt", "base"):
        c = F.col(f"{s}_name")
        out |= {
            f"{s}_brand": branded(c).cast("int"),
            f"{s}_apos": good_apostrophes(c),
            f"{s}_acc": t.accented(c),
            f"{s}_dot": c.contains("・").cast("int"),
            f"{s}_periods": times(c, "\\."),
            f"{s}_loose": times(c, "(?<![\\p{L}\\p{N}_])[\\p{L}\\p{N}_]\\.  ?[\\p{L}\\p{N}_]\\."),
            f"{s}_tight": times(c, "(?<![\\p{L}\\p{N}_])[\\p{L}\\p{N}_]\\.[\\p{L}\\p{N}_]\\."),
            f"{s}_dash": c.rlike("[\\p{L}\\p{N}_]-[\\p{L}\\p{N}_]").cast("int"),
            f"{s}_spaces": times(c, " "),
            f"{s}_number": c.rlike("\\s[0-9]+\\s*$"),
            f"{s}_small": c.rlike("(?<![A-Za-z])[a-z]{4,}(?![A-Za-z])"),
            f"{s}_title": c.rlike("(?<![A-Za-z])[A-Z][A-Za-z]{3,}"),
        }
    df = once(df, {k: c if where is None else F.when(where, c) for k, c in out.items()})
    tied = reduce(lambda x, y: x & y, [~F.coalesce(test, F.lit(False)) for test, _ in before_casing()], F.lit(True) if where is None else where)
    return once(df, {f"{s}_casing": F.when(tied, casing_score(F.col(f"{s}_name"))) for s in ("alt", "base")})


def chosen(side: str, reason: str) -> Column:
    name = F.col(f"{side}_name") if side != "abstain" else F.lit("")
    return F.struct(name.alias("name"), F.lit(side).alias("source"), F.lit(reason).alias("reason"))


def more(form: str, reason: str) -> list[tuple[Column, Column]]:
    return [(F.col(f"{a}_{form}") > F.col(f"{b}_{form}"), chosen(a, reason)) for a, b in (("alt", "base"), ("base", "alt"))]


def before_casing() -> list[tuple[Column, Column]]:
    """The tests that come before casing, in order, with what each selects."""
    steps = [step for form, reason in (("brand", "branded_casing"), ("apos", "has_apostrophe"), ("acc", "has_accents"), ("dot", "has_nakaguro")) for step in more(form, reason)]
    for a, b in (("alt", "base"), ("base", "alt")):
        steps.append(((F.col(f"{a}_periods") > 0) & (F.col(f"{b}_periods") == 0), chosen(a, "has_periods")))
    for a, b in (("alt", "base"), ("base", "alt")):
        steps.append(((F.col("alt_periods") > 0) & (F.col("base_periods") > 0) & (F.col(f"{a}_tight") > F.col(f"{a}_loose")) & (F.col(f"{b}_loose") > F.col(f"{b}_tight")), chosen(a, "compact_abbreviation")))
    steps += more("dash", "has_compound_dash")
    for few, many in (("alt", "base"), ("base", "alt")):
        fewer = F.col(f"{few}_spaces") < F.col(f"{many}_spaces")
        steps.append((fewer & F.col(f"{many}_number") & ~F.col(f"{few}_number"), chosen(many, "prefer_spaced_number")))
        steps.append((fewer & ~(F.col(f"{few}_small") & F.col(f"{many}_title")), chosen(few, "prefer_compound")))
    return steps


def select_normalized() -> Column:
    """The better written of two equivalent names: struct of name, source and reason. Needs with_scores()."""
    steps = before_casing() + more("casing", "better_casing")
    for a, b in (("alt", "base"), ("base", "alt")):
        steps.append((F.length(f"{a}_name") < F.length(f"{b}_name"), chosen(a, "shorter")))
    out = F.when(*steps[0])
    for test, value in steps[1:]:
        out = out.when(test, value)
    return out.otherwise(chosen("abstain", "tiebreaker_undecidable"))


def select_subset() -> Column:
    """Of a name and a longer one that holds it: struct of name, source, reason and extra. Needs with_forms()."""
    alt_short = F.length("alt_ns") <= F.length("base_ns")
    side = lambda c, long: F.when(alt_short, F.col(f"{'base' if long else 'alt'}_{c}")).otherwise(F.col(f"{'alt' if long else 'base'}_{c}"))
    long, short = side("name", True), side("name", False)
    source = lambda want_long: F.when(alt_short, F.lit("base" if want_long else "alt")).otherwise(F.lit("alt" if want_long else "base"))
    plain = t.excess(side("nc", True), side("nc", False))
    extra = F.when(plain != "", plain).otherwise(t.excess(side("ns", True), side("ns", False)))
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(short, r"\s*[\(（【\[].*?[\)）】\]]", "")), r"\s*\|.*$", ""))
    generic = (F.length(bare) <= 6) | (F.size(tokens(bare)) <= 1)
    business = F.arrays_overlap(tokens(F.lower(extra)), F.array(*map(F.lit, dict.fromkeys(BUSINESS))))
    pick = lambda want_long, reason: F.struct((long if want_long else short).alias("name"), source(want_long).alias("source"), F.lit(reason).alias("reason"), extra.alias("extra"))
    return F.when(t.has_cjk(long) | t.has_thai(long), pick(True, "prefer_specific_cjk_thai")).when(generic, pick(True, "short_name_too_generic")).when(business, pick(True, "has_business_type")).otherwise(pick(False, "prefer_core_name"))


def conflict_type() -> Column:
    """agreement, casing, normalized, subset or different; compares sorted characters, unlike the two tiers."""
    a, b = F.col("alt_name"), F.col("base_name")
    chars = lambda s: t.sorted_chars(t.nospace(F.col(f"{s}_hira")))
    equal = same("nc") | same("ns") | same("conj") | same("conj", False) | same("spell") | same("hira") | same("hira", False) | ((F.length(t.nospace(F.col("alt_hira"))) > 0) & (chars("alt") == chars("base"))) | F.col("typo")
    inside = t.is_subset(F.col("alt_nc"), F.col("base_nc")) | t.is_subset(F.col("alt_ns"), F.col("base_ns")) | t.is_subset(t.nospace(F.col("alt_hira")), t.nospace(F.col("base_hira")))
    return F.when(a.isNull() | b.isNull(), "different").when(a == b, "agreement").when(F.lower(a) == F.lower(b), "casing").when(equal, "normalized").when(inside, "subset").otherwise("different")


def typed(df: DataFrame) -> DataFrame:
    """Adds the forms and conflict_type, and selects nothing."""
    return once(with_forms(df), {"conflict_type": conflict_type()})


def golden_subsets(df: DataFrame) -> DataFrame:
    """The rows of golden() whose one name holds the other, without scoring how names are written."""
    out = once(typed(df).where("conflict_type = 'subset'"), {"_subset": select_subset()})
    return out.select(*df.columns, "conflict_type", F.col("_subset.name").alias("golden_name"), F.col("_subset.source").alias("golden_source"), F.concat(F.lit("subset:"), F.col("_subset.reason")).alias("golden_reason"), F.col("_subset.extra").alias("extra_content"))


def golden(df: DataFrame) -> DataFrame:
    """Adds conflict_type, golden_name, golden_source, golden_reason and extra_content."""
    out = typed(df)
    kind = F.col("conflict_type")
    written = kind.isin("casing", "normalized")
    out = with_scores(out, written)
    out = once(out, {"_written": F.when(written, select_normalized()), "_subset": F.when(kind == "subset", select_subset())})
    whole = F.struct(F.col("alt_name").alias("name"), F.lit("both").alias("source"), F.lit("agreement").alias("reason"))
    open_pair = F.struct(F.lit("").alias("name"), F.lit("abstain").alias("source"), F.lit("genuinely_different").alias("reason"))
    pick = lambda f, tag: F.struct(F.col(f"{f}.name").alias("name"), F.col(f"{f}.source").alias("source"), F.concat(tag, F.lit(":"), F.col(f"{f}.reason")).alias("reason"))
    result = F.when(kind == "agreement", whole).when(kind.isin("casing", "normalized"), pick("_written", kind)).when(kind == "subset", pick("_subset", kind)).otherwise(open_pair)
    out = once(out, {"_golden": result})
    return out.select(*df.columns, "conflict_type", F.col("_golden.name").alias("golden_name"), F.col("_golden.source").alias("golden_source"), F.col("_golden.reason").alias("golden_reason"), F.when(kind == "subset", F.col("_subset.extra")).otherwise("").alias("extra_content"))


def golden_summary(df: DataFrame) -> DataFrame:
    return share_of_all(golden(df).groupBy("conflict_type", "golden_source", "golden_reason").agg(F.count("*").alias("row_count")))
