"""Two-tier classes of name disagreement, and the staircases of ever stronger forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import text as t
from tallyframe.functions.once import once
from tallyframe.operators.profile import both_sides, share_of, share_of_all

# Patterns of what longer names add (fixed values).
BIZ_SUFFIX = (
    r"(?i),?\s*\b(llc|l\.l\.c\.|inc|inc\.|corp|corp\.|ltd|ltd\.|co\.|company|incorporated|gmbh|g\.m\.b\.h\.|ag|sa|sarl|s\.a\.r\.l\."
    r"|srl|s\.r\.l\.|snc|s\.n\.c\.|sas|s\.a\.s\.|kg|ohg|ug|pty|plc|lp|llp|pllc|pa|pc|dba|cpa|dmd|dds|md|do"
    r"|pvt|oy|ab|as|aps|hf|ehf|kft|zrt|sp\.?\s*z\.?\s*o\.?\s*o\.?|e\.v\.|mbh)\b\.?\s*$"
)
SEO = "(?i)(hours|address|near me|official site|official|directions|reviews|location|best |menu)"
BRANCH = r"(店|支店|出張所|営業所|イオン|モール|マルイ|สาขา|ถนน|ซอย|ต\.|อ\.|จ\.)|(?i)\b(branch|store|outlet|location|mall|plaza|center|centre)\b"
FACILITY = r"(?i)(バス停|bus\s*stop|atm|cash\s*machine|substation)"
BRACKETS = r"[()（）【】\[\]]"
PLAIN_SUFFIX = r",?\s+(llc|l\.l\.c\.|inc|inc\.|corp|corp\.|ltd|ltd\.|co\.|company|incorporated|gmbh|srl|s\.r\.l\.)\.?\s*$"


def ascii_edges(pattern: str) -> str:
    """The pattern with \\b between ASCII word characters and all others, as in the SQL; Java's own takes accented letters as word characters."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


SIDES = ("alt", "base")


def with_forms(df: DataFrame) -> DataFrame:
    """Adds {alt,base}_{nc,ns,conj,spell,sorted,hira} and typo: the forms that the classes compare, each computed once.

    Names with text whose first form is equal are decided by it: their later forms are null.
    """
    name = lambda s, form: F.col(f"{s}_{form}")
    both = lambda form: {f"{s}_{k}": c for s in SIDES for k, c in form(s).items()}
    out = once(df, both(lambda s: {"fold": t.fold(name(s, "name"))}))
    out = once(out, both(lambda s: {"nc": t.l2(name(s, "fold"))}))
    is_open = ~F.coalesce((F.col("alt_nc") == F.col("base_nc")) & (F.length("alt_nc") > 0), F.lit(False))
    amp = lambda s: t.squeezed(t.letters(F.replace(F.lower(f"{s}_fold"), F.lit("&"), F.lit(" and "))))
    kana = lambda s: F.when(name(s, "fold").rlike(t.KATAKANA), t.l2(t.fold(t.kata_to_hira(name(s, "fold"))))).otherwise(name(s, "nc"))
    forms = both(lambda s: {"conj": t.conjoined(amp(s)), "hira": kana(s), "spell": t.americanised(name(s, "nc")), "sorted": t.sorted_tokens(name(s, "nc"))})
    out = once(out, both(lambda s: {"ns": t.nospace(name(s, "nc"))}) | {k: F.when(is_open, c) for k, c in forms.items()})
    return once(out, {"typo": t.is_typo(F.col("alt_nc"), F.col("base_nc"))}).drop("alt_fold", "base_fold")


def same(form: str, spaced: bool = True) -> Column:
    """Both sides have this form and it is equal, with or without spaces."""
    a, b = F.col(f"alt_{form}"), F.col(f"base_{form}")
    return (F.length(a) > 0) & ((a == b) if spaced else (t.nospace(a) == t.nospace(b)))


def tier1() -> Column:
    a, b = F.col("alt_name"), F.col("base_name")
    equal = [same("nc"), same("ns"), same("conj"), same("conj", False), same("spell"), same("sorted"), same("hira"), same("hira", False), F.col("typo")]
    inside = [t.is_subset(F.col("alt_nc"), F.col("base_nc")), t.is_subset(F.col("alt_ns"), F.col("base_ns")), t.is_subset(t.nospace(F.col("alt_hira")), t.nospace(F.col("base_hira")))]
    either = lambda tests: reduce(lambda x, y: x | y, tests)
    return F.when(a.isNull() | b.isNull(), "genuinely_different").when(F.lower(a) == F.lower(b), "casing_only").when(either(equal), "normalization_equivalent").when(either(inside), "subset").otherwise("genuinely_different")


def equivalence_tags() -> Column:
    """What makes two names equivalent; empty where no single thing does."""
    a, b = F.lower("alt_name"), F.lower("base_name")
    bare = lambda c: F.regexp_replace(c, "[^\\p{L}\\p{N}_\\s]", "")
    da, db = bare(a), bare(b)
    apart = F.col("alt_nc") != F.col("base_nc")
    spaces = lambda c: t.squeezed(F.regexp_replace(c, "\\p{Z}", " "))
    tags = {
        "punctuation": (a != b) & ((da != a) | (db != b)) & ((da == db) | (t.nospace(da) == t.nospace(db))),
        "diacritic": (t.l2(F.col("alt_name")) != t.l2(F.col("base_name"))) & ~apart,
        "spacing": F.when((a != b) & (spaces(a) == spaces(b)), True).otherwise(apart & (F.col("alt_ns") == F.col("base_ns"))),
        "conjunction": apart & (F.col("alt_conj") == F.col("base_conj")),
        "spelling": apart & (F.col("alt_spell") == F.col("base_spell")),
        "word_reorder": apart & (F.col("alt_sorted") == F.col("base_sorted")),
        "script_form": apart & (F.col("alt_hira") == F.col("base_hira")),
    }
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tags.items()]))


def subset_tags() -> Column:
    """What the longer name adds; empty where it has no class of its own."""
    alt_long = F.length("alt_nc") >= F.length("base_nc")
    pick = lambda c: (F.when(alt_long, F.col(f"alt_{c}")).otherwise(F.col(f"base_{c}")), F.when(alt_long, F.col(f"base_{c}")).otherwise(F.col(f"alt_{c}")))
    (long, short), (long_nc, short_nc) = pick("name"), pick("nc")
    more = t.excess(long_nc, short_nc)
    only = lambda p: long.rlike(p) & ~short.rlike(p)
    tags = {"parenthetical": only(BRACKETS), "biz_suffix": only(ascii_edges(BIZ_SUFFIX)), "seo_junk": only(SEO), "branch_suffix": more.rlike(ascii_edges(BRANCH)), "facility_suffix": more.rlike(FACILITY)}
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tags.items()]))


def classified(df: DataFrame) -> DataFrame:
    """Adds tier1 and tier2 (an array of tags, empty where the class has none); agreement rows are left out."""
    apart = df.where(F.col("alt_name").isNull() | F.col("base_name").isNull() | (F.col("alt_name") != F.col("base_name")))
    out = once(with_forms(apart), {"tier1": tier1()})
    tier, none = F.col("tier1"), F.array().cast("array<string>")
    tags = F.when(tier == "normalization_equivalent", equivalence_tags()).when(tier == "subset", subset_tags()).otherwise(none)
    rest = F.when(tier == "subset", "descriptor").when(F.col("typo"), "typo").otherwise("minor_variant")
    out = once(out, {"tier2": tags})
    return out.withColumn("tier2", F.when((F.size("tier2") > 0) | ~tier.isin("normalization_equivalent", "subset"), F.col("tier2")).otherwise(F.array(rest)))


def agreement(alt_json: Column, base_json: Column, a: Column, b: Column) -> Column:
    """full_agreement, primary_agrees_json_differs or primary_conflict (also where a primary is missing)."""
    return F.when(alt_json == base_json, "full_agreement").when(a == b, "primary_agrees_json_differs").otherwise("primary_conflict")


def words_of(c: Column) -> Column:
    return F.size(F.split(F.trim(c), " ")).cast("long")


def structure_flags(df: DataFrame) -> DataFrame:
    """Long form: side, value and its structural flags; both names must be there."""
    long = both_sides(df.where("alt_name IS NOT NULL AND base_name IS NOT NULL"), "alt_name", "base_name", "id")
    c = F.col("value")
    return long.select(
        "id",
        "side",
        F.length(c).cast("long").alias("chars"),
        words_of(c).alias("words"),
        ((c == F.upper(c)) & (c != F.lower(c))).alias("all_caps"),
        ((c == F.lower(c)) & (c != F.upper(c))).alias("all_lower"),
        c.rlike("[\\s#-]+[0-9]{3,}\\s*$").alias("trailing_number"),
        F.lower(c).rlike(PLAIN_SUFFIX).alias("biz_suffix"),
        c.rlike(SEO).alias("seo"),
        (words_of(c) > 8).alias("excessive"),
    )


def structure_summary(df: DataFrame) -> DataFrame:
    flags = ["all_caps", "all_lower", "trailing_number", "biz_suffix", "seo", "excessive"]
    return structure_flags(df).groupBy("side").agg(F.count("*").alias("row_count"), *[F.count_if(f).alias(f) for f in flags], F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"), F.median("chars").alias("median_chars"), F.sum("words").alias("words"))


def length_distribution(df: DataFrame) -> DataFrame:
    n = F.col("chars")
    bucket = F.when(n <= 5, "1-5").when(n <= 10, "6-10").when(n <= 20, "11-20").when(n <= 30, "21-30").when(n <= 50, "31-50").otherwise(">50")
    return share_of(structure_flags(df).groupBy("side", bucket.alias("bucket")).agg(F.count("*").alias("row_count")), "side")


def word_distribution(df: DataFrame) -> DataFrame:
    return share_of(structure_flags(df).groupBy("side", "words").agg(F.count("*").alias("row_count")), "side")


def casing(a: Column, b: Column) -> Column:
    """Which casing each side of a pair has, by priority."""
    kind = lambda c: F.when((c == F.upper(c)) & (c != F.lower(c)), "caps").when((c == F.lower(c)) & (c != F.upper(c)), "lower").otherwise("mixed")
    x, y = kind(a), kind(b)
    return F.when((x == "caps") & (y != "caps"), "alt_all_caps").when((y == "caps") & (x != "caps"), "base_all_caps").when((x == "lower") & (y != "lower"), "alt_all_lower").when((y == "lower") & (x != "lower"), "base_all_lower").when((x == "mixed") & (y == "mixed"), "both_mixed").otherwise("same_extreme")


def casing_patterns(df: DataFrame) -> DataFrame:
    only = classified(df).where("tier1 = 'casing_only'")
    return share_of_all(only.groupBy(casing(F.col("alt_name"), F.col("base_name")).alias("pattern")).agg(F.count("*").alias("row_count")))


def tier1_summary(df: DataFrame) -> DataFrame:
    return share_of_all(classified(df).groupBy("tier1").agg(F.count("*").alias("row_count")))


def tag_summary(df: DataFrame) -> DataFrame:
    return classified(df).select("tier1", F.explode("tier2").alias("tag")).groupBy("tier1", "tag").agg(F.count("*").alias("row_count"))


STAGES = ("S0_raw", "S1_casing", "S2_unicode", "S3_punctuation", "S4_spacing", "S5_conjunction", "S6_spelling", "S7_script", "S8_reorder")


def with_stages(df: DataFrame, profile: str = "full") -> DataFrame:
    """Adds {alt,base}_s0 to _s8: the forms S0 to S8 of both names. 'scale' strips '&' before it could become a word,
    folds y and e at the ends too, joins words before spelling is looked up, and turns kana last. S8 is S7 where that is
    equal on both sides, else its characters sorted."""
    stage = lambda s, k: F.col(f"{s}_s{k}")
    add = lambda make: {f"{s}_{k}": c for s in SIDES for k, c in make(s).items()}
    low = lambda s: {"s0": F.coalesce(f"{s}_name", F.lit("")), "s1": F.lower(F.coalesce(f"{s}_name", F.lit("")))}
    out = once(df, add(low))
    out = once(out, add(lambda s: {"s2": t.fold(stage(s, 1))}))
    plain = lambda c: t.squeezed(t.letters(c))
    if profile == "full":
        spaced = lambda c: t.conjoined(plain(F.replace(c, F.lit("&"), F.lit(" and "))))
        out = once(out, add(lambda s: {"s3": plain(stage(s, 2)), "c": spaced(stage(s, 2))}))
        out = once(out, add(lambda s: {"s4": t.nospace(stage(s, 3)), "s5": t.nospace(F.col(f"{s}_c")), "s6": t.nospace(t.americanised(F.col(f"{s}_c")))}))
        kana = lambda s: t.nospace(t.americanised(spaced(t.fold(F.lower(t.kata_to_hira(stage(s, 0)))))))
        out = once(out, add(lambda s: {"s7": F.when(stage(s, 0).rlike(t.KATAKANA), kana(s)).otherwise(stage(s, 6))}))  # without katakana S7 is S6
    else:
        one = lambda c: F.regexp_replace(c, f"(?<![^ ])({'|'.join(t.CONJUNCTIONS + t.INNER_CONJUNCTIONS)})(?![^ ])", "and")
        table = F.create_map(*[F.lit(x) for pair in t.SPELLING.items() for x in pair])
        out = once(out, add(lambda s: {"s3": plain(stage(s, 2))}))
        out = once(out, add(lambda s: {"s4": t.nospace(stage(s, 3)), "s5": t.nospace(one(stage(s, 3)))}))
        out = once(out, add(lambda s: {"s6": F.coalesce(F.try_element_at(table, stage(s, 5)), stage(s, 5))}))
        out = once(out, add(lambda s: {"s7": t.kata_to_hira(stage(s, 6))}))
    last = F.col("alt_s7") == F.col("base_s7")  # equal forms stay equal when sorted, and need not be
    return once(out, add(lambda s: {"s8": F.when(last, stage(s, 7)).otherwise(t.sorted_chars(stage(s, 7)))})).select(*df.columns, *[f"{s}_s{k}" for s in SIDES for k in range(len(STAGES))])


def first_equal() -> Column:
    """Index of the first stage with equal forms; null if none. Needs with_stages()."""
    return F.coalesce(*[F.when(F.col(f"alt_s{k}") == F.col(f"base_s{k}"), k) for k in range(len(STAGES))])


def staircase(df: DataFrame, profile: str = "full") -> DataFrame:
    """stage, conflicts, total, rate, improvement.

    full: every stage counts on its own, and S9 takes typos off what S8 leaves. scale: a row that a
    stage resolves stays resolved.
    """
    both = with_stages(df, profile)
    apart = [F.col(f"alt_s{k}") != F.col(f"base_s{k}") for k in range(len(STAGES))]
    if profile == "scale":
        apart = [reduce(lambda x, y: x & y, apart[: k + 1]) for k in range(len(STAGES))]
    names, tests = list(STAGES), list(apart)
    if profile == "full":
        names.append("S9_typo")
        tests.append(apart[-1] & ~t.is_typo(F.col("alt_s7"), F.col("base_s7")))
    wide = both.agg(F.count("*").alias("n"), *[F.count_if(x).alias(f"c{k}") for k, x in enumerate(tests)])
    rows = wide.select("n", F.inline(F.array(*[F.struct(F.lit(k).alias("o"), F.lit(s).alias("stage"), F.col(f"c{k}").alias("conflicts")) for k, s in enumerate(names)])))
    prev = F.lag("conflicts").over(Window.orderBy("o"))  # a row per stage
    better = F.when(prev == 0, F.lit(0.0)).otherwise((prev - F.col("conflicts")) / prev)
    return rows.select("stage", "conflicts", F.col("n").alias("total"), (F.col("conflicts") / F.when(F.col("n") > 0, F.col("n"))).alias("rate"), better.alias("improvement"))


def scale_summary(df: DataFrame) -> DataFrame:
    """Outcome of all pairs in the scale profile: what resolves, and of the rest subset, typo or different."""
    rows = with_stages(df, "scale")
    first, a3, b3 = first_equal(), F.col("alt_s3"), F.col("base_s3")
    inside = F.contains(a3, b3) | F.contains(b3, a3)  # empty is inside anything here
    outcome = F.when(first == 0, "agreement").when(first.isNotNull(), "resolved").when(inside, "subset").when(t.is_typo(a3, b3), "typo").otherwise("different")
    counts = rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("row_count"))
    return share_of_all(counts)


def inflation(outcomes: DataFrame) -> DataFrame:
    """raw_conflicts, different and how many times more there are of the first: from counts of scale_summary()."""
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("outcome").isin(*kinds), F.col("row_count"))), F.lit(0))
    raw = F.coalesce(F.sum(F.when(F.col("outcome") != "agreement", F.col("row_count"))), F.lit(0))
    counts = outcomes.agg(raw.alias("raw_conflicts"), of("different").alias("different"))
    return counts.withColumn("inflation", F.round(F.col("raw_conflicts") / F.greatest(F.col("different"), F.lit(1)), 1))


#: Order in which classes are listed (fixed values).
TIER_ORDER = ("genuinely_different", "subset", "normalization_equivalent", "casing_only")


def conflict_export(df: DataFrame) -> DataFrame:
    """Disagreements with their labels for review: by class, the greatest difference of length first, then by id."""
    rows = classified(df).select("id", "alt_name", "base_name", "tier1", F.array_join("tier2", "|").alias("tags"), F.abs(F.length("alt_name") - F.length("base_name")).cast("long").alias("length_gap"))
    rank = F.coalesce(*[F.when(F.col("tier1") == name, k) for k, name in enumerate(TIER_ORDER)])
    return rows.orderBy(rank, F.desc_nulls_last("length_gap"), "id")


def agreement_export(df: DataFrame) -> DataFrame:
    """Agreements with a label of how they are written, by id."""
    low = F.col("alt_name") == F.lower("alt_name")
    label = F.when(F.col("alt_name") == "", "empty").when(low & (F.col("alt_name") == F.upper("alt_name")), "no_case").when(low, "lower").when(F.col("alt_name") == F.upper("alt_name"), "caps").otherwise("mixed")
    return df.where("alt_name = base_name").select("id", F.col("alt_name").alias("name"), label.alias("label")).orderBy("id")


def unicode_summary(df: DataFrame) -> DataFrame:
    """Per mark: rows whose alt, base or either name has it, and the ratio of all rows."""
    kinds = ("dakuten", "handakuten", "thai_tone", "small_kana", "korean", "any_mark")
    flags = once(df, {s: t.mark_flags(F.col(f"{s}_name")) for s in SIDES})
    tests = {"alt": lambda k: F.col(f"alt.{k}"), "base": lambda k: F.col(f"base.{k}"), "either": lambda k: F.col(f"alt.{k}") | F.col(f"base.{k}")}
    wide = flags.agg(F.count("*").alias("n"), *[F.count_if(test(k)).alias(f"{k}__{side}") for k in kinds for side, test in tests.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("mark"), *[F.col(f"{k}__{side}").alias(f"{side}_rows") for side in tests], F.col("n").alias("total_rows")) for k in kinds])
    return wide.select(F.inline(rows)).withColumn("ratio", F.col("either_rows") / F.when(F.col("total_rows") > 0, F.col("total_rows")))
