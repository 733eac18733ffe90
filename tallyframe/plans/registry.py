"""All queries of the library by name, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from tallyframe.functions import json as js
from tallyframe.functions import text as t
from tallyframe.operators import evaluation as ev
from tallyframe.operators import extra, golden, names, ngrams, order_stats, pairing, phones, profile, providers
from tallyframe.plans import sql
from tallyframe.plans.fixtures import NAME_PAIRS, PHONE_PAIRS, SET_ROWS, from_table, name_pairs, phone_pairs, set_files
from tallyframe.session import ready
from tallyframe.sources.evaluation_sets import read_sets, rejected, usable
from tallyframe.streaming import labels as stream
from tallyframe.streaming import pairs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(ready(spark), sf_dir)
    if sql:
        ORACLE_SQL[name] = sql


def ppm(c) -> Column:
    """A ratio or mean in millionths: sums of doubles differ in their last bits between engines."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1e6 + 0.5).cast("long")


PPM = "CAST(floor(({}) * 1e6 + 0.5) AS BIGINT)"
I = "CAST({} AS BIGINT)"  # noqa: E741

# --- phones ---------------------------------------------------------------------------------------
S = "('[null]', '[\"\"]', '[\"NULL\"]', '[\"null\"]', '')"
S_IMPACT = "('[null]', '[\"\"]', '[\"NULL\"]', '[\"null\"]')"
P = f"""WITH pp AS ({PHONE_PAIRS}),
raw AS (SELECT *, CASE WHEN phones IN {S} THEN NULL ELSE phones END AS ar, CASE WHEN base_phones IN {S} THEN NULL ELSE base_phones END AS br FROM pp),
d AS (SELECT *, regexp_replace(ar, '[^0-9]', '', 'g') AS a, regexp_replace(br, '[^0-9]', '', 'g') AS b FROM raw),
u AS (SELECT *, coalesce(length(a) > 0, false) AS ua, coalesce(length(b) > 0, false) AS ub FROM d)"""
EITHER = "({0} OR {1})"


def two_ways(rule: str) -> str:
    """A rule about x (longer) and y on both orders of a and b."""
    return "(" + rule.replace("$x", "a").replace("$y", "b") + " OR " + rule.replace("$x", "b").replace("$y", "a") + ")"


E_SQL = {
    2: "(a = b)",
    3: two_ways("(length($x) = 11 AND substr($x, 1, 1) = '1' AND length($y) = 10 AND substr($x, 2) = $y)"),
    4: two_ways("(length($x) = length($y) + 1 AND substr($x, 2) = $y)"),
    5: two_ways("(substr($y, 1, 1) = '0' AND length($x) = length($y) + 1 AND length($x) >= 3 AND length($y) >= 2 AND substr($x, 3) = substr($y, 2))"),
    6: two_ways("(substr($y, 1, 1) = '0' AND length($x) = length($y) + 2 AND length($x) >= 4 AND length($y) >= 2 AND substr($x, 4) = substr($y, 2))"),
    7: two_ways("(length($x) = length($y) + 2 AND length($x) >= 3 AND length($y) >= 1 AND substr($x, 3) = $y)"),
    8: two_ways("(length($x) = length($y) + 3 AND length($x) >= 4 AND length($y) >= 1 AND substr($x, 4) = $y)"),
    9: two_ways("(length($x) = length($y) + 1 AND substr($x, 3, 1) = '0' AND substr($x, 1, 2) = substr($y, 1, 2) AND substr($x, 4) = substr($y, 3))"),
}
RU = two_ways("(length($x) = length($y) AND substr($x, 1, 1) = '7' AND substr($y, 1, 1) = '8' AND substr($x, 2) = substr($y, 2))")
STAGE_NAMES = ["S0_null_normalization", "S1_raw_string", *phones.RULES]
_open = {1: "ar <> br"} | {k: "NOT (" + " OR ".join(E_SQL[j] for j in range(2, k + 1)) + ")" for k in range(2, 10)}
_rows = " UNION ALL ".join(f"SELECT {k} AS o, '{s}' AS stage, n AS both_usable_count, {f'c{k}' if k else 'NULL::BIGINT'} AS conflict_count FROM w" for k, s in enumerate(STAGE_NAMES))
register(
    "phone_staged",
    lambda s, d: phones.staged_report(phone_pairs(s, d)),
    f"""{P}, w AS (SELECT count(*) FILTER (WHERE ua AND ub) AS n, {", ".join(f"count(*) FILTER (WHERE ua AND ub AND {x}) AS c{k}" for k, x in _open.items())} FROM u),
r AS ({_rows})
SELECT stage, both_usable_count, conflict_count, conflict_count / nullif(both_usable_count, 0)::DOUBLE AS conflict_rate,
CASE WHEN lag(conflict_count) OVER (ORDER BY o) = 0 THEN 0.0::DOUBLE ELSE (lag(conflict_count) OVER (ORDER BY o) - conflict_count) / (lag(conflict_count) OVER (ORDER BY o))::DOUBLE END AS improvement FROM r""",
)
register(
    "phone_residual",
    lambda s, d: phones.residual(phone_pairs(s, d)),
    f"""{P} SELECT id, CASE WHEN ua AND ub THEN 'both_present' WHEN ua THEN 'alt_only' ELSE 'base_only' END AS residual_type, ar AS alt_raw, br AS base_raw, a AS alt_digits, b AS base_digits
FROM u WHERE (ua OR ub) AND NOT coalesce(ua AND ub AND ({" OR ".join(E_SQL.values())}), false)""",
)
C = f"""{P}, c AS (SELECT *, CASE WHEN NOT ua AND NOT ub THEN 'both_missing' WHEN NOT ub THEN 'alt_only' WHEN NOT ua THEN 'base_only' WHEN {" OR ".join(E_SQL[k] for k in E_SQL if k != 3)} OR {RU} THEN 'resolved' ELSE 'true_conflict' END AS conflict_class FROM u)"""
register("phone_classify", lambda s, d: phones.class_counts(phone_pairs(s, d)), f"{C} SELECT conflict_class, count(*) AS row_count, count(*) / (sum(count(*)) OVER ())::DOUBLE AS ratio FROM c GROUP BY 1")
register(
    "phone_conf_summary",
    lambda s, d: phones.confidence_summary(phone_pairs(s, d)).select("conflict_class", "row_count", *[ppm(c).alias(c) for c in ("avg_alt", "avg_base", "avg_diff", "median_gap")], "alt_higher", "base_higher", "tied"),
    f"""{C} SELECT conflict_class, count(*) AS row_count, {PPM.format("avg(confidence)")} AS avg_alt, {PPM.format("avg(base_confidence)")} AS avg_base, {PPM.format("avg(confidence - base_confidence)")} AS avg_diff, {PPM.format("median(abs(confidence - base_confidence))")} AS median_gap,
count(*) FILTER (WHERE confidence > base_confidence) AS alt_higher, count(*) FILTER (WHERE base_confidence > confidence) AS base_higher, count(*) FILTER (WHERE confidence = base_confidence) AS tied FROM c GROUP BY 1""",
)
_shares = {"p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}
register(
    "phone_conf_percentiles",
    lambda s, d: phones.confidence_percentiles(phone_pairs(s, d), _shares),
    f"{C}, v AS (SELECT 'alt' AS side, conflict_class, confidence AS x FROM c UNION ALL SELECT 'base', conflict_class, base_confidence FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY side, conflict_class ORDER BY x) AS k, count(*) OVER (PARTITION BY side, conflict_class) AS n FROM v) SELECT side, conflict_class, "
    + ", ".join(f"max(CASE WHEN k = greatest(ceil(n * {p}::DOUBLE), 1) THEN x END) AS {name}" for name, p in _shares.items()) + " FROM r GROUP BY 1, 2",
)
register(
    "phone_conf_detail",
    lambda s, d: phones.confidence_detail(phone_pairs(s, d)),
    f"""{C} SELECT id, conflict_class, a AS alt_digits, b AS base_digits, confidence AS alt_confidence, base_confidence, confidence - base_confidence AS confidence_diff, abs(confidence - base_confidence) AS confidence_gap,
CASE WHEN confidence > base_confidence THEN 'alt' WHEN base_confidence > confidence THEN 'base' ELSE 'tied' END AS higher_side FROM c WHERE conflict_class IN ('true_conflict', 'alt_only', 'base_only')""",
)
L = f"{C}, l AS (SELECT 'alt' AS side, conflict_class, CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS h FROM c UNION ALL SELECT 'base', conflict_class, CAST(floor(base_confidence * 100 + 0.5) AS BIGINT) FROM c)"
register("phone_conf_hist", lambda s, d: phones.confidence_histogram(phone_pairs(s, d)), f"{L} SELECT side, conflict_class, h AS hundredths, count(*) AS row_count, count(*) / (sum(count(*)) OVER (PARTITION BY side, conflict_class))::DOUBLE AS ratio FROM l GROUP BY 1, 2, 3")
_band = "CASE WHEN h IS NULL THEN '0.59 – 0.00' " + " ".join(f"WHEN h = {k} THEN '{v}'" for k, v in phones.EXACT_BANDS.items()) + " " + " ".join(f"WHEN h >= {k} THEN '{v}'" for k, v in phones.LOWER_ENDS) + " ELSE '0.59 – 0.00' END"
register("phone_conf_bands", lambda s, d: phones.confidence_bands(phone_pairs(s, d)), f"{L} SELECT side, conflict_class, {_band} AS bucket, count(*) AS row_count, count(*) / (sum(count(*)) OVER (PARTITION BY side, conflict_class))::DOUBLE AS ratio FROM l GROUP BY 1, 2, 3")
FEATURE = f"""{P}, v AS (SELECT id, 'alt' AS side, ar AS value, a AS digits FROM u UNION ALL SELECT id, 'base', br, b FROM u),
f AS (SELECT id, side, digits, {I.format("length(digits)")} AS digit_len, strpos(value, '+') > 0 AS has_plus, strpos(value, '(') > 0 AS has_parens, strpos(value, '-') > 0 AS has_hyphen,
regexp_matches(regexp_replace(value, '^\\[\\s*"?(.*?)"?\\s*\\]$', '\\1'), '^[0-9]+$') AS pure_numeric,
CASE WHEN length(digits) < 7 THEN '<7' WHEN length(digits) <= 9 THEN '7-9' WHEN length(digits) = 10 THEN '10' WHEN length(digits) = 11 THEN '11' WHEN length(digits) <= 15 THEN '12-15' ELSE '>15' END AS len_bucket FROM v WHERE length(digits) > 0)"""
register("phone_features", lambda s, d: phones.features(phone_pairs(s, d)), f"{FEATURE} SELECT * FROM f")
register("phone_structure", lambda s, d: phones.structure(phone_pairs(s, d)), f"{FEATURE} SELECT side, count(*) AS usable, {', '.join(f'count(*) FILTER (WHERE {x}) AS {x}' for x in ('has_plus', 'has_parens', 'has_hyphen', 'pure_numeric'))}, min(digit_len) AS min_len, max(digit_len) AS max_len FROM f GROUP BY 1")
register("phone_len_dist", lambda s, d: phones.length_distribution(phone_pairs(s, d)), f"{FEATURE} SELECT side, len_bucket, count(*) AS row_count, count(*) / (sum(count(*)) OVER (PARTITION BY side))::DOUBLE AS ratio FROM f GROUP BY 1, 2")
register("phone_flags", lambda s, d: profile.distribution(phones.features(phone_pairs(s, d)), ["has_plus", "has_parens", "has_hyphen", "pure_numeric"]), f"{FEATURE} SELECT has_plus, has_parens, has_hyphen, pure_numeric, count(*) AS row_count, count(*) / (sum(count(*)) OVER ())::DOUBLE AS ratio FROM f GROUP BY 1, 2, 3, 4")
register("hash_sample_phones", lambda s, d: ev.stratified(phone_pairs(s, d), F.coalesce(F.col("phones") != F.col("base_phones"), F.lit(False)), (60, 40), "phones").select("id", "phones", "base_phones", "sample_type"), f"WITH pp AS ({PHONE_PAIRS}) SELECT * FROM (SELECT id, phones, base_phones, 'conflict' AS sample_type FROM pp WHERE coalesce(phones <> base_phones, false) ORDER BY md5(concat(id, 'phones')), id LIMIT 60) UNION ALL SELECT * FROM (SELECT id, phones, base_phones, 'match' FROM pp WHERE NOT coalesce(phones <> base_phones, false) ORDER BY md5(concat(id, 'phones')), id LIMIT 40)")

# --- profile --------------------------------------------------------------------------------------
COLUMNS = ("id", "phones", "base_phones", "confidence", "base_confidence", "sources")


def _coverage_sql(test: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{'base' if c.startswith('base_') else 'alt'}' AS side, count(*) FILTER (WHERE {test.format(c=c)}) AS present, count(*) AS total_rows, count(*) FILTER (WHERE {test.format(c=c)}) / count(*)::DOUBLE AS ratio FROM pp" for c in COLUMNS)
    return f"WITH pp AS ({PHONE_PAIRS}) {each}"


register("coverage_strict", lambda s, d: profile.coverage(phone_pairs(s, d), True), _coverage_sql("""{c} IS NOT NULL AND CAST({c} AS VARCHAR) NOT IN ('[null]', '[""]', '')"""))
register("coverage_sql", lambda s, d: profile.coverage(phone_pairs(s, d), False), _coverage_sql("{c} IS NOT NULL"))
ATTRS = ("phones", "confidence")


def _conflict_sql(columns: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT '{a}' AS attribute, count({a}) AS alt_present, count(base_{a}) AS base_present, count(*) FILTER (WHERE {a} IS NOT NULL AND base_{a} IS NOT NULL) AS both_present, count(*) FILTER (WHERE {a} <> base_{a}) AS conflict, count(*) FILTER (WHERE {a} IS NOT NULL AND base_{a} IS NULL) AS alt_only, count(*) FILTER (WHERE {a} IS NULL AND base_{a} IS NOT NULL) AS base_only, count(*) FILTER (WHERE {a} IS NULL AND base_{a} IS NULL) AS neither, count(*) AS total_rows FROM pp"
        for a in ATTRS
    )
    return f"WITH pp AS ({PHONE_PAIRS}), w AS ({each}) SELECT attribute, {columns} FROM w"


for _name, _cols in {
    "conflict_summary": ["alt_present", "base_present", "both_present", "conflict", "total_rows"],
    "conflict_breakdown": ["conflict", "alt_only", "base_only", "neither", "total_rows"],
}.items():
    register(_name, lambda s, d, cols=_cols: profile.conflicts(phone_pairs(s, d), list(ATTRS)).select("attribute", *cols), _conflict_sql(", ".join(_cols)))
register("decision_pressure", lambda s, d: profile.conflicts(phone_pairs(s, d), list(ATTRS)).select("attribute", "decision_pressure"), _conflict_sql("(conflict + alt_only + base_only) / total_rows::DOUBLE AS decision_pressure"))
_audit = {"sql_null": "{c} IS NULL", "empty_string": "{c} = ''", "json_null": "{c} = '[null]'", "json_empty": "{c} = '[\"\"]'", "json_word": "{c} IN ('[\"NULL\"]', '[\"null\"]')", "holds_word": "lower({c}) LIKE '%null%'"}
register("null_audit", lambda s, d: profile.null_audit(phone_pairs(s, d), ["phones", "base_phones"]), f"WITH pp AS ({PHONE_PAIRS}) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, " + ", ".join(f"count(*) FILTER (WHERE {x.format(c=c)}) AS {k}" for k, x in _audit.items()) + ", count(*) AS total_rows FROM pp" for c in ("phones", "base_phones")))
_status = "CASE WHEN {a} IS NULL AND {b} IS NULL THEN 'both_null' WHEN {a} IS NULL THEN 'base_only' WHEN {b} IS NULL THEN 'alt_only' WHEN {a} = {b} THEN 'agree' ELSE 'conflict' END"
_null = f"CASE WHEN {{c}} IN {S_IMPACT} THEN NULL ELSE {{c}} END"
register("null_impact", lambda s, d: profile.null_impact(phone_pairs(s, d), "phones", "base_phones"), f"WITH pp AS ({PHONE_PAIRS}), x AS (SELECT phones AS p, base_phones AS q, {_null.format(c='phones')} AS a, {_null.format(c='base_phones')} AS b FROM pp) SELECT {_status.format(a='p', b='q')} AS before, {_status.format(a='a', b='b')} AS after, count(*) AS row_count, count(*) / (sum(count(*)) OVER ())::DOUBLE AS ratio FROM x GROUP BY 1, 2")


# --- sources: the fixture has one JSON column; the base side is the other entry order of the same rows
def source_pairs(s: SparkSession, d: str) -> DataFrame:
    base = F.when(F.substring("id", -1, 1) != "7", F.replace("sources", F.lit("seg"), F.lit("survey")))
    return phone_pairs(s, d).select("id", "sources", base.alias("base_sources"))


SRC = f"""WITH pp AS (SELECT id, sources, CASE WHEN substr(id, -1, 1) <> '7' THEN replace(sources, 'seg', 'survey') END AS base_sources FROM ({PHONE_PAIRS}) q),
e AS (SELECT 'alt' AS side, id, unnest(from_json(coalesce(sources, '[]'), '[{{"dataset": "VARCHAR", "property": "VARCHAR"}}]')) AS x FROM pp UNION ALL SELECT 'base', id, unnest(from_json(coalesce(base_sources, '[]'), '[{{"dataset": "VARCHAR", "property": "VARCHAR"}}]')) FROM pp),
l AS (SELECT side, id, x.dataset AS dataset, x.property AS property FROM e WHERE x.dataset IS NOT NULL), k AS (SELECT * FROM l WHERE property IS NULL OR property <> '/properties/existence')"""
register("source_property_values", lambda s, d: providers.property_values(source_pairs(s, d)), f"{SRC} SELECT side, property, count(*) AS entry_count FROM l GROUP BY 1, 2")
register("source_contributors", lambda s, d: providers.contributors(source_pairs(s, d)), f"{SRC} SELECT side, attr_contributors, count(*) AS row_count FROM (SELECT side, id, count(*) FILTER (WHERE property IS NULL OR property <> '/properties/existence') AS attr_contributors FROM l GROUP BY 1, 2) GROUP BY 1, 2")
register("source_provider", lambda s, d: providers.provider_counts(source_pairs(s, d)), f"{SRC} SELECT side, dataset, count(DISTINCT id) AS row_count, count(DISTINCT id) / (SELECT count(*) FROM pp)::DOUBLE AS ratio FROM k GROUP BY 1, 2")
register("source_pairings", lambda s, d: providers.pairings(source_pairs(s, d)), f"{SRC}, o AS (SELECT *, row_number() OVER (PARTITION BY side, id ORDER BY property, dataset) AS rn FROM k) SELECT coalesce(b.dataset, 'none') AS base_provider, coalesce(a.dataset, 'none') AS alt_provider, count(*) AS row_count, count(*) / (sum(count(*)) OVER ())::DOUBLE AS ratio FROM pp LEFT JOIN o b ON pp.id = b.id AND b.side = 'base' AND b.rn = 1 LEFT JOIN o a ON pp.id = a.id AND a.side = 'alt' AND a.rn = 1 GROUP BY 1, 2")

class Sql(str):
    """SQL with one place {0}; other braces are its own."""

    def format(self, x: str) -> Sql:
        return Sql(self.replace("{0}", x))

    def replace(self, a: str, b: str) -> Sql:
        return Sql(super().replace(a, b))


# --- names ----------------------------------------------------------------------------------------
N = f"WITH np AS ({NAME_PAIRS})"
L2 = Sql(r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{L}\p{N}\p{M} \t\n]', '', 'g'), '\s+', ' ', 'g'))")
NC = L2.format("strip_accents({0})")
AMP = Sql(r"trim(regexp_replace(regexp_replace(replace(lower(strip_accents({0})), '&', ' and '), '[^\p{L}\p{N}\p{M} \t\n]', '', 'g'), '\s+', ' ', 'g'))")
CONJ = Sql("array_to_string(list_transform(string_split({0}, ' '), lambda w, i: CASE WHEN w IN ('and', 'et', 'und') OR (w IN ('y', 'e') AND i > 1 AND i < len(string_split({0}, ' '))) THEN 'and' ELSE w END), ' ')")
SPELL = Sql("array_to_string(list_transform(string_split({0}, ' '), lambda w: CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.SPELLING.items()) + " ELSE w END), ' ')")
TOKENS = Sql("array_to_string(list_sort(string_split({0}, ' ')), ' ')")
CHARS = Sql("array_to_string(list_sort(string_split({0}, '')), '')")
DIGITS = "CASE WHEN length({a}) = length({b}) THEN {a} <> {b} AND len(list_filter(range(1, length({a}) + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1) AND NOT regexp_matches(substr({a}, i, 1), '[0-9]') AND NOT regexp_matches(substr({b}, i, 1), '[0-9]'))) = 0 WHEN length({a}) > length({b}) THEN rtrim(regexp_replace({a}, '[0-9]+$', '')) = rtrim({b}) ELSE rtrim(regexp_replace({b}, '[0-9]+$', '')) = rtrim({a}) END"
TYPO = "(length({a}) >= 5 AND length({b}) >= 5 AND levenshtein({a}, {b}) <= 2 AND 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE >= 0.85 AND NOT (" + DIGITS + "))"
SUBSET = "(length({a}) > 0 AND length({b}) > 0 AND length({a}) <> length({b}) AND (contains({a}, {b}) OR contains({b}, {a})))"
FORMS = f"""{N}, f0 AS (SELECT *, {NC.format("alt_name")} AS a_nc, {NC.format("base_name")} AS b_nc, {AMP.format("alt_name")} AS a_amp, {AMP.format("base_name")} AS b_amp FROM np),
f AS (SELECT *, replace(a_nc, ' ', '') AS a_ns, replace(b_nc, ' ', '') AS b_ns, {CONJ.format("a_amp")} AS a_conj, {CONJ.format("b_amp")} AS b_conj, {SPELL.format("a_nc")} AS a_spell, {SPELL.format("b_nc")} AS b_spell, {TOKENS.format("a_nc")} AS a_sorted, {TOKENS.format("b_nc")} AS b_sorted, {TYPO.format(a="a_nc", b="b_nc")} AS typo FROM f0)"""
NORM = "((a_nc = b_nc AND a_nc <> '') OR (a_ns = b_ns AND a_ns <> '') OR (a_conj = b_conj AND a_conj <> '') OR (replace(a_conj, ' ', '') = replace(b_conj, ' ', '') AND a_conj <> '') OR (a_spell = b_spell AND a_spell <> '') OR (a_sorted = b_sorted AND a_sorted <> '') OR typo)"
INSIDE = f"({SUBSET.format(a='a_nc', b='b_nc')} OR {SUBSET.format(a='a_ns', b='b_ns')})"
TIER1 = f"CASE WHEN lower(alt_name) = lower(base_name) THEN 'casing_only' WHEN {NORM} THEN 'normalization_equivalent' WHEN {INSIDE} THEN 'subset' ELSE 'genuinely_different' END"
T = f"{FORMS}, t1 AS (SELECT *, {TIER1} AS tier1 FROM f WHERE alt_name <> base_name)"


def form_query(form: str, spark_form: Callable[[Column], Column], sql: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        return name_pairs(s, d).select("id", spark_form(F.col("alt_name")).alias("alt_form"), spark_form(F.col("base_name")).alias("base_form"))

    register(form, run, f"{N} SELECT id, {sql.format('alt_name')} AS alt_form, {sql.format('base_name')} AS base_form FROM np")


form_query("name_norm_compare", lambda c: t.norm_compare(c), NC)
form_query("name_norm_conj", lambda c: t.norm_conj(c), CONJ.replace("{0}", AMP))
form_query("name_norm_spelling", lambda c: t.norm_spelling(c), SPELL.replace("{0}", NC))
form_query("name_sorted_tokens", lambda c: t.sorted_tokens(t.norm_compare(c)), TOKENS.replace("{0}", NC))
register("name_fold_arrow", lambda s, d: name_pairs(s, d).select("id", t.fold(F.col("alt_name"), "arrow").alias("alt_form"), t.fold(F.col("base_name"), "arrow").alias("base_form")), f"{N} SELECT id, strip_accents(alt_name) AS alt_form, strip_accents(base_name) AS base_form FROM np")
# words of several scripts after each name, and what their fold is
_scripts = {"ｶﾞｰﾃﾞﾝ": "ガーデン", "ＡＢＣ①": "ABC1", "ﬁﬂ": "fifl", "\u1112\u1161\u11ab\u1100\u116e\u11a8": "한국", "ห้อง": "ห้อง", "ハ\u309aン": "パン", "Й\u0301": "И", "ệ": "e", "㍿": "株式会社", "日本": "日本"}
_case = lambda xs: "CASE CAST(CAST(substr(id, -1, 1) AS INT) AS INT) " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(xs)) + " END"
register("name_fold_scripts", lambda s, d: name_pairs(s, d).select("id", t.fold(F.concat("alt_name", F.lit(" "), F.expr(_case(_scripts)))).alias("form")), f"{N} SELECT id, concat(strip_accents(alt_name), ' ', {_case(_scripts.values())}) AS form FROM np")
register("name_typo", lambda s, d: names.with_forms(name_pairs(s, d)).select("id", "typo"), f"{FORMS} SELECT id, typo FROM f")
register("name_subset", lambda s, d: names.with_forms(name_pairs(s, d)).select("id", t.is_subset(F.col("alt_nc"), F.col("base_nc")).alias("inside")), f"{FORMS} SELECT id, {SUBSET.format(a='a_nc', b='b_nc')} AS inside FROM f")
register("name_tier1", lambda s, d: names.classified(name_pairs(s, d)).select("id", "tier1"), f"{T} SELECT id, tier1 FROM t1")
register("name_tier1_summary", lambda s, d: names.tier1_summary(name_pairs(s, d)), f"{T} SELECT tier1, count(*) AS row_count, count(*) / (sum(count(*)) OVER ())::DOUBLE AS ratio FROM t1 GROUP BY 1")
_suffix = names.BIZ_SUFFIX
_long = "CASE WHEN length(a_nc) >= length(b_nc) THEN {0} ELSE {1} END"
_x = {"l": _long.format("alt_name", "base_name"), "s": _long.format("base_name", "alt_name"), "ln": _long.format("a_nc", "b_nc"), "sn": _long.format("b_nc", "a_nc")}
_bare = "regexp_replace({}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
_only = lambda p: f"regexp_matches(l, '{p}') AND NOT regexp_matches(s, '{p}')"
_jp = names.BRANCH.split("|(?i)")[0]
TAGS = f"""{T}, g AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _x.items())}, lower(alt_name) AS la, lower(base_name) AS lb, {_bare.format("lower(alt_name)")} AS da, {_bare.format("lower(base_name)")} AS db FROM t1),
h AS (SELECT *, trim(CASE WHEN strpos(ln, sn) > 0 THEN substr(ln, 1, strpos(ln, sn) - 1) || substr(ln, strpos(ln, sn) + length(sn)) ELSE ln END) AS more FROM g),
n AS (SELECT id, tier1, typo, list_filter([CASE WHEN la <> lb AND (da <> la OR db <> lb) AND (da = db OR replace(da, ' ', '') = replace(db, ' ', '')) THEN 'punctuation' END,
 CASE WHEN {L2.format("alt_name")} <> {L2.format("base_name")} AND a_nc = b_nc THEN 'diacritic' END,
 CASE WHEN (la <> lb AND trim(regexp_replace(la, '\\s+', ' ', 'g')) = trim(regexp_replace(lb, '\\s+', ' ', 'g'))) OR (a_nc <> b_nc AND a_ns = b_ns) THEN 'spacing' END,
 CASE WHEN a_nc <> b_nc AND a_conj = b_conj THEN 'conjunction' END, CASE WHEN a_nc <> b_nc AND a_spell = b_spell THEN 'spelling' END, CASE WHEN a_nc <> b_nc AND a_sorted = b_sorted THEN 'word_reorder' END], lambda z: z IS NOT NULL) AS eq,
 list_filter([CASE WHEN {_only(names.BRACKETS)} THEN 'parenthetical' END, CASE WHEN {_only(_suffix)} THEN 'biz_suffix' END, CASE WHEN {_only(names.SEO)} THEN 'seo_junk' END,
 CASE WHEN regexp_matches(more, '{_jp}') OR regexp_matches(more, '(?i)\\b(branch|store|outlet|location|mall|plaza|center|centre)\\b') THEN 'branch_suffix' END, CASE WHEN regexp_matches(more, '{names.FACILITY}') THEN 'facility_suffix' END], lambda z: z IS NOT NULL) AS sub FROM h),
tags AS (SELECT tier1, unnest(CASE WHEN tier1 = 'normalization_equivalent' THEN CASE WHEN len(eq) > 0 THEN eq WHEN typo THEN ['typo'] ELSE ['minor_variant'] END WHEN tier1 = 'subset' THEN CASE WHEN len(sub) > 0 THEN sub ELSE ['descriptor'] END ELSE [] END) AS tag FROM n)"""
register("name_subtags", lambda s, d: names.tag_summary(name_pairs(s, d)), f"{TAGS} SELECT tier1, tag, count(*) AS row_count FROM tags GROUP BY 1, 2")
FLAGS = f"""{N}, v AS (SELECT id, 'alt' AS side, alt_name AS c FROM np UNION ALL SELECT id, 'base', base_name FROM np),
w AS (SELECT id, side, {I.format("length(c)")} AS chars, {I.format("len(string_split(trim(c), ' '))")} AS words, c = replace(upper(c), 'ẞ', 'SS') AND c <> lower(c) AS all_caps, c = lower(c) AND c <> upper(c) AS all_lower, regexp_matches(c, '[\\s#-]+[0-9]{{3,}}\\s*$') AS trailing_number,
regexp_matches(lower(c), '{names.PLAIN_SUFFIX}') AS biz_suffix, regexp_matches(c, '{names.SEO}') AS seo, len(string_split(trim(c), ' ')) > 8 AS excessive FROM v WHERE c IS NOT NULL)"""
register("name_features", lambda s, d: names.structure_flags(name_pairs(s, d)), f"{FLAGS} SELECT * FROM w")
register("name_structure", lambda s, d: names.structure_summary(name_pairs(s, d)), f"{FLAGS} SELECT side, count(*) AS row_count, {', '.join(f'count(*) FILTER (WHERE {x}) AS {x}' for x in ('all_caps', 'all_lower', 'trailing_number', 'biz_suffix', 'seo', 'excessive'))}, min(chars) AS min_chars, max(chars) AS max_chars, median(chars)::DOUBLE AS median_chars, {I.format('sum(words)')} AS words FROM w GROUP BY 1")
register("name_len_dist", lambda s, d: names.length_distribution(name_pairs(s, d)), f"{FLAGS} SELECT side, CASE WHEN chars <= 5 THEN '1-5' WHEN chars <= 10 THEN '6-10' WHEN chars <= 20 THEN '11-20' WHEN chars <= 30 THEN '21-30' WHEN chars <= 50 THEN '31-50' ELSE '>50' END AS bucket, count(*) AS row_count, count(*) / (sum(count(*)) OVER (PARTITION BY side))::DOUBLE AS ratio FROM w GROUP BY 1, 2")
register("name_wordcount_dist", lambda s, d: names.word_distribution(name_pairs(s, d)), f"{FLAGS} SELECT side, words, count(*) AS row_count, count(*) / (sum(count(*)) OVER (PARTITION BY side))::DOUBLE AS ratio FROM w GROUP BY 1, 2")
_kind = "CASE WHEN {0} = replace(upper({0}), 'ẞ', 'SS') AND {0} <> lower({0}) THEN 'caps' WHEN {0} = lower({0}) AND {0} <> upper({0}) THEN 'lower' ELSE 'mixed' END"
register("name_casing", lambda s, d: names.casing_patterns(name_pairs(s, d)), f"{T}, k AS (SELECT {_kind.format('alt_name')} AS x, {_kind.format('base_name')} AS y FROM t1 WHERE tier1 = 'casing_only') SELECT CASE WHEN x = 'caps' AND y <> 'caps' THEN 'alt_all_caps' WHEN y = 'caps' AND x <> 'caps' THEN 'base_all_caps' WHEN x = 'lower' AND y <> 'lower' THEN 'alt_all_lower' WHEN y = 'lower' AND x <> 'lower' THEN 'base_all_lower' WHEN x = 'mixed' AND y = 'mixed' THEN 'both_mixed' ELSE 'same_extreme' END AS pattern, count(*) AS row_count, count(*) / (sum(count(*)) OVER ())::DOUBLE AS ratio FROM k GROUP BY 1")

_low = "lower({0})"
_s2 = "strip_accents(lower({0}))"
_s3 = NC
_conj_full = CONJ.replace("{0}", AMP)
_full = [Sql(x) for x in ("{0}", _low, _s2, _s3, f"replace({_s3}, ' ', '')", f"replace({_conj_full}, ' ', '')", f"replace({SPELL.replace('{0}', _conj_full)}, ' ', '')", f"replace({SPELL.replace('{0}', _conj_full)}, ' ', '')")]
_s5_scale = "array_to_string(list_transform(string_split(" + _s3 + ", ' '), lambda w: CASE WHEN w IN ('and', 'et', 'und', 'y', 'e') THEN 'and' ELSE w END), '')"
_s6_scale = "CASE " + _s5_scale + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.SPELLING.items()) + " ELSE " + _s5_scale + " END"
_scale = [Sql(x) for x in ("{0}", _low, _s2, _s3, f"replace({_s3}, ' ', '')", _s5_scale, _s6_scale, _s6_scale)]


def _stairs_sql(forms: list[str], profile_name: str) -> str:
    cols = ", ".join(f"{f.format('alt_name')} AS a{k}, {f.format('base_name')} AS b{k}" for k, f in enumerate(forms))
    tests = [f"a{k} <> b{k}" for k in range(8)] + [f"{CHARS.format('a7')} <> {CHARS.format('b7')}"]
    stage_names = list(names.STAGES)
    if profile_name == "scale":
        tests = [" AND ".join(tests[: k + 1]) for k in range(9)]
    else:
        tests.append(f"{tests[8]} AND NOT {TYPO.format(a='a7', b='b7')}")
        stage_names.append("S9_typo")
    rows = " UNION ALL ".join(f"SELECT {k} AS o, '{s}' AS stage, c{k} AS conflicts, n AS total FROM w" for k, s in enumerate(stage_names))
    return f"""{N}, f AS (SELECT {cols} FROM np), w AS (SELECT count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {x}) AS c{k}" for k, x in enumerate(tests))} FROM f), r AS ({rows})
SELECT stage, conflicts, total, conflicts / nullif(total, 0)::DOUBLE AS rate, CASE WHEN lag(conflicts) OVER (ORDER BY o) = 0 THEN 0.0::DOUBLE ELSE (lag(conflicts) OVER (ORDER BY o) - conflicts) / (lag(conflicts) OVER (ORDER BY o))::DOUBLE END AS improvement FROM r"""


register("name_staircase_full", lambda s, d: names.staircase(name_pairs(s, d), "full"), _stairs_sql(_full, "full"))
register("name_staircase_scale", lambda s, d: names.staircase(name_pairs(s, d), "scale"), _stairs_sql(_scale, "scale"))
_eq = " OR ".join([f"{f.format('alt_name')} = {f.format('base_name')}" for f in _scale[1:]] + [f"{CHARS.format(_s6_scale).format('alt_name')} = {CHARS.format(_s6_scale).format('base_name')}"])
register("scale_summary", lambda s, d: names.scale_summary(name_pairs(s, d)), f"{N}, f AS (SELECT *, {_s3.format('alt_name')} AS a, {_s3.format('base_name')} AS b FROM np), o AS (SELECT CASE WHEN alt_name = base_name THEN 'agreement' WHEN {_eq} THEN 'resolved' WHEN contains(a, b) OR contains(b, a) THEN 'subset' WHEN {TYPO.format(a='a', b='b')} THEN 'typo' ELSE 'different' END AS outcome FROM f) SELECT outcome, count(*) AS row_count, count(*) / (sum(count(*)) OVER ())::DOUBLE AS ratio FROM o GROUP BY 1")


def flat_records(s: SparkSession, d: str) -> DataFrame:
    turns = s.read.parquet(f"{d}/conversations.parquet")
    return turns.select(F.col("conv_id").alias("id"), F.col("text").alias("name"), F.col("turn").alias("position"), F.col("role").alias("provider"))


register("pair_up", lambda s, d: pairing.pair_up(flat_records(s, d)), "WITH r AS (SELECT conv_id AS id, text AS name, turn, role FROM conversations WHERE trim(coalesce(text, '')) <> '') SELECT a.id, a.name AS alt_name, a.role AS alt_provider, b.name AS base_name, b.role AS base_provider FROM r a JOIN r b ON a.id = b.id AND a.turn < b.turn")
# one id holds half of the records and more than a block
_half = "CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE s_nationkey END"
register(
    "pair_up_hot",
    lambda s, d: pairing.pair_up(s.read.parquet(f"{d}/supplier.parquet").select(F.expr(_half).cast("long").alias("id"), F.col("s_suppkey").alias("position"), F.col("s_name").alias("name"), F.lower("s_name").alias("provider")), block=16),
    f"WITH r AS (SELECT CAST({_half} AS BIGINT) AS id, s_suppkey AS k, s_name AS n, lower(s_name) AS p FROM supplier) SELECT a.id, a.n AS alt_name, a.p AS alt_provider, b.n AS base_name, b.p AS base_provider FROM r a JOIN r b ON a.id = b.id AND a.k < b.k",
)
register("hash_sample_names", lambda s, d: ev.stratified(name_pairs(s, d), t.squeezed(F.lower("alt_name")) != t.squeezed(F.lower("base_name")), (160, 40), "names"), f"{N}, x AS (SELECT *, trim(regexp_replace(lower(alt_name), '\\s+', ' ', 'g')) <> trim(regexp_replace(lower(base_name), '\\s+', ' ', 'g')) AS c FROM np) SELECT * FROM (SELECT id, alt_name, base_name, 'conflict' AS sample_type FROM x WHERE c ORDER BY md5(concat(id, 'names')), id LIMIT 160) UNION ALL SELECT * FROM (SELECT id, alt_name, base_name, 'match' FROM x WHERE NOT c ORDER BY md5(concat(id, 'names')), id LIMIT 40)")

# --- JSON -----------------------------------------------------------------------------------------
register("json_primary", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid")), "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")


JSON_ROWS = """SELECT c_custkey AS id,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 11 = 0 THEN concat('{"primary":', c_custkey, ',"common":null}') ELSE concat('{"primary":"', c_name, '","x":1}') END AS names,
  CASE WHEN c_custkey % 7 = 1 THEN NULL WHEN c_custkey % 5 = 1 THEN concat('[', c_name) WHEN c_custkey % 11 = 1 THEN '[]' ELSE concat('[{"freeform":"', c_name, '","locality":"', lower(c_mktsegment), '"', CASE WHEN c_custkey % 2 = 0 THEN ',"region":"R"' ELSE '' END, '}]') END AS addresses
FROM customer"""


def json_fields(s: SparkSession, d: str) -> DataFrame:
    rows = from_table(s, d, JSON_ROWS, "customer")
    place = lambda k: js.field(F.col("addresses"), js.PATHS[k], "null").alias(k)
    return rows.select("id", js.field(F.col("names"), js.PATHS["primary"]).alias("primary_name"), place("freeform"), place("locality"), place("region"))


register("json_fields", json_fields, f"WITH j AS ({JSON_ROWS}) SELECT id, CASE WHEN json_valid(names) THEN json_extract_string(names, '$.primary') ELSE names END AS primary_name, " + ", ".join(f"CASE WHEN json_valid(addresses) THEN json_extract_string(addresses, '{js.PATHS[k]}') END AS {k}" for k in ("freeform", "locality", "region")) + " FROM j")


def json_pairs(s: SparkSession, d: str) -> DataFrame:
    """Names as JSON: the primary of one side, and an added field on every third row."""
    p = name_pairs(s, d)
    a = F.concat(F.lit('{"n":'), F.length("alt_name").cast("string"), F.lit("}"))
    b = F.when(F.substring("id", -1, 1) == "3", F.concat(F.lit('{"n":'), F.length("base_name").cast("string"), F.lit(',"x":1}'))).otherwise(F.concat(F.lit('{"n":'), F.length("base_name").cast("string"), F.lit("}")))
    return p.select("id", a.alias("a"), b.alias("b"))


JP = f"""{N}, j AS (SELECT id, '{{"n":' || length(alt_name) || '}}' AS a, '{{"n":' || length(base_name) || CASE WHEN substr(id, -1, 1) = '3' THEN ',"x":1}}' ELSE '}}' END AS b FROM np),
g AS (SELECT id, a, b, CASE WHEN a = b THEN 'full_agreement' WHEN json_extract_string(a, '$.n') = json_extract_string(b, '$.n') THEN 'primary_agrees_json_differs' ELSE 'primary_conflict' END AS agreement_type FROM j)"""


def agreed(s: SparkSession, d: str) -> DataFrame:
    return json_pairs(s, d).withColumn("agreement_type", names.agreement(F.col("a"), F.col("b"), F.get_json_object("a", "$.n"), F.get_json_object("b", "$.n")))


def top_three(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    total = agreed(s, d).groupBy("agreement_type").agg(F.count("*").alias("type_rows"))
    first = agreed(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("agreement_type").orderBy("id"))).where("rn <= 3")
    return first.join(F.broadcast(total), "agreement_type").select("agreement_type", "id", "rn", "type_rows")  # three classes


register("agreement_breakdown", lambda s, d: profile.distribution(agreed(s, d), ["agreement_type"]), f"{JP} SELECT agreement_type, count(*) AS row_count, count(*) / (sum(count(*)) OVER ())::DOUBLE AS ratio FROM g GROUP BY 1")
register("agreement_top3", top_three, f"{JP} SELECT agreement_type, id, CAST(rn AS INT) AS rn, type_rows FROM (SELECT *, row_number() OVER (PARTITION BY agreement_type ORDER BY id) AS rn, count(*) OVER (PARTITION BY agreement_type) AS type_rows FROM g) WHERE rn <= 3")

# --- selection and what longer names add ----------------------------------------------------------
CT = f"CASE WHEN alt_name = base_name THEN 'agreement' WHEN lower(alt_name) = lower(base_name) THEN 'casing' WHEN (a_nc = b_nc AND a_nc <> '') OR (a_ns = b_ns AND a_ns <> '') OR (a_conj = b_conj AND a_conj <> '') OR (replace(a_conj, ' ', '') = replace(b_conj, ' ', '') AND a_conj <> '') OR (a_spell = b_spell AND a_spell <> '') OR (a_ns <> '' AND {CHARS.format('a_ns')} = {CHARS.format('b_ns')}) OR typo THEN 'normalized' WHEN {INSIDE} THEN 'subset' ELSE 'different' END"
_words = lambda c: f"list_filter(string_split({c}, ' '), lambda z: z <> '')"
_biz = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(golden.BUSINESS)) + "]"
SUB = f"""{FORMS}, ct AS (SELECT *, {CT} AS conflict_type FROM f),
q AS (SELECT id, CASE WHEN length(a_ns) <= length(b_ns) THEN alt_name ELSE base_name END AS sh, CASE WHEN length(a_ns) <= length(b_ns) THEN base_name ELSE alt_name END AS lo, CASE WHEN length(a_ns) <= length(b_ns) THEN a_nc ELSE b_nc END AS sn, CASE WHEN length(a_ns) <= length(b_ns) THEN b_nc ELSE a_nc END AS ln, length(a_ns) <= length(b_ns) AS alt_short, alt_name, base_name FROM ct WHERE conflict_type = 'subset'),
x AS (SELECT *, trim(CASE WHEN strpos(ln, sn) > 0 THEN substr(ln, 1, strpos(ln, sn) - 1) || substr(ln, strpos(ln, sn) + length(sn)) ELSE ln END) AS ex FROM q),
y AS (SELECT *, CASE WHEN ex <> '' THEN ex ELSE replace(ln, ' ', '') END AS extra, trim(regexp_replace(trim(regexp_replace(sh, '\\s*[\\(（【\\[].*?[\\)）】\\]]', '', 'g')), '\\s*\\|.*$', '')) AS bare FROM x),
z AS (SELECT *, CASE WHEN length(bare) <= 6 OR len({_words("bare")}) <= 1 THEN 'short_name_too_generic' WHEN list_has_any({_words("extra")}, {_biz}) THEN 'has_business_type' ELSE 'prefer_core_name' END AS reason FROM y)"""
register("conflict_type_summary", lambda s, d: golden.typed(name_pairs(s, d)).groupBy("conflict_type").agg(F.count("*").alias("row_count")), f"{FORMS}, ct AS (SELECT {CT} AS conflict_type FROM f) SELECT conflict_type, count(*) AS row_count FROM ct GROUP BY 1")
register("golden_subset_rules", lambda s, d: golden.golden_subsets(name_pairs(s, d)).select("id", "golden_name", "golden_source", "golden_reason", "extra_content"), f"{SUB} SELECT id, CASE WHEN reason = 'prefer_core_name' THEN sh ELSE lo END AS golden_name, CASE WHEN (reason = 'prefer_core_name') = alt_short THEN 'alt' ELSE 'base' END AS golden_source, 'subset:' || reason AS golden_reason, extra AS extra_content FROM z")
register("golden_summary", lambda s, d: golden.golden_summary(name_pairs(s, d)))
_set = lambda c: f"regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+')"
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"
_title = "upper(substr(w, 1, 1)) || substr(w, 2)"
_own = f"list_filter({_set('extra')}, lambda w: regexp_matches(w, '^[a-z]{{3,}}$'))"
register(
    "extra_rule_classify",
    lambda s, d: golden.golden_subsets(name_pairs(s, d)).select("id", extra.rule_label(F.col("extra_content"), F.when(F.length("alt_name") <= F.length("base_name"), F.col("base_name")).otherwise(F.col("alt_name"))).alias("label")),
    f"{SUB} SELECT id, CASE WHEN list_has_any({_set('extra')}, {_list(extra.NOISE)}) OR regexp_matches(extra, '#[0-9]{{3,}}') THEN 'noise' WHEN list_has_any({_set('extra')}, {_list(extra.BIZ_FULL)}) THEN 'business_type' WHEN len({_own}) BETWEEN 1 AND 4 AND len(list_filter({_own}, lambda w: list_contains({_set('CASE WHEN length(alt_name) <= length(base_name) THEN base_name ELSE alt_name END')}, {_title}))) / len({_own})::DOUBLE >= 0.6 THEN 'location' ELSE 'disambiguation' END AS label FROM z",
)
# the same with the vocabulary that was drawn up before any labels were seen
register(
    "extra_rule_classify_blind",
    lambda s, d: golden.golden_subsets(name_pairs(s, d)).select("id", extra.rule_label(F.col("extra_content"), F.when(F.length("alt_name") <= F.length("base_name"), F.col("base_name")).otherwise(F.col("alt_name")), extra.BIZ_BLIND).alias("label")),
    ORACLE_SQL["extra_rule_classify"].replace(_list(extra.BIZ_FULL), _list(extra.BIZ_BLIND)),
)
_prep = extra.PREPOSITION.replace("(?iu)", "(?i)")
_nouns = f"list_filter(list_filter({_set('extra')}, lambda w: regexp_matches(w, '^[a-z]{{3,}}$')), lambda w: NOT list_contains({_list(extra.COMPOUND_BIZ)}, w) AND list_contains({_set('ll')}, {_title}))"
_scan = f"{SUB}, m AS (SELECT id, extra, CASE WHEN length(alt_name) <= length(base_name) THEN base_name ELSE alt_name END AS ll FROM z), o AS (SELECT id, len(list_intersect({_set('extra')}, {_list(extra.COMPOUND_BIZ)})) AS n_biz, CASE WHEN regexp_matches(extra, '{_prep}') THEN 'spatial_prep' WHEN regexp_matches(extra, '{extra.SEPARATED}') THEN 'sep_cap' WHEN len({_nouns}) > 0 THEN 'proper_noun:' || list_extract({_nouns}, 1) END AS location FROM m)"
register(
    "compound_scan",
    lambda s, d: extra.compound_scan(golden.golden_subsets(name_pairs(s, d))).select("id", "kind", "location", F.size("biz").cast("long").alias("n_biz")),
    _scan + " SELECT id, CASE WHEN n_biz > 0 AND location IS NOT NULL THEN 'candidate' WHEN n_biz > 0 THEN 'biz_only' ELSE 'none' END AS kind, location, CAST(n_biz AS BIGINT) AS n_biz FROM o",
)
register("faithfulness", lambda s, d: name_pairs(s, d).select("id", extra.is_faithful(F.col("base_name"), F.col("alt_name"), F.lit("latin")).alias("faithful"), extra.is_faithful(F.col("base_name"), F.col("alt_name"), F.lit("cjk")).alias("by_character")), f"{N} SELECT id, len(list_filter({_words('''regexp_replace(lower(base_name), '[ \\t\\n]+', ' ', 'g')''')}, lambda w: NOT contains(lower(alt_name), w))) = 0 AS faithful, len(list_filter(string_split(base_name, ''), lambda c: trim(c) <> '' AND NOT contains(alt_name, c))) = 0 AS by_character FROM np")
# how names relate, and what is built of them, by the rules that stand in for models
_sides = "SELECT id, extra, CASE WHEN length(alt_name) <= length(base_name) THEN alt_name ELSE base_name END AS ss, CASE WHEN length(alt_name) <= length(base_name) THEN base_name ELSE alt_name END AS ll FROM z"
register(
    "name_relation",
    lambda s, d: extra.compound_scan(golden.golden_subsets(name_pairs(s, d))).select("id", extra.relation(F.col("short_name"), F.col("long_name"), F.col("extra_content")).alias("relation")),
    f"{_scan} SELECT o.id, CASE WHEN coalesce(trim(m.extra), '') = '' THEN 'none' WHEN n_biz > 0 AND location IS NOT NULL THEN 'compound' WHEN n_biz > 0 THEN 'business' WHEN location IS NOT NULL THEN 'place' ELSE 'other' END AS relation FROM o JOIN m ON o.id = m.id",
)
_trades = f"list_intersect({_set('extra')}, {_list(extra.COMPOUND_BIZ)})"
_built = f"coalesce(array_to_string(list_filter(string_split(trim(regexp_replace(ll, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '), lambda w: list_has_any({_set('lower(w)')}, list_concat({_set('lower(ss)')}, {_trades}))), ' '), '')"
register(
    "name_construct",
    lambda s, d: extra.compound_scan(golden.golden_subsets(name_pairs(s, d))).select("id", extra.construct(F.col("short_name"), F.col("long_name"), F.col("extra_content")).alias("built")),
    f"{SUB} SELECT id, CASE WHEN len({_trades}) > 0 THEN {_built} END AS built FROM ({_sides}) t",
)
register("relation_router", lambda s, d: extra.compound_scan(golden.golden_subsets(name_pairs(s, d))).select("id", extra.route(F.col("kind") == "candidate", F.col("biz"), extra.is_faithful(F.col("short_name"), F.col("long_name"), F.lit("latin"))).alias("action")), f"{_scan}, fa AS (SELECT id, len(list_filter({_words('''regexp_replace(lower(CASE WHEN length(alt_name) <= length(base_name) THEN alt_name ELSE base_name END), '[ \\t\\n]+', ' ', 'g')''')}, lambda w: NOT contains(lower(CASE WHEN length(alt_name) <= length(base_name) THEN base_name ELSE alt_name END), w))) = 0 AS faithful FROM z) SELECT o.id, CASE WHEN n_biz > 0 AND location IS NOT NULL THEN CASE WHEN faithful THEN 'construct' ELSE 'abstain_unfaithful' END ELSE 'keep_shorter' END AS action FROM o JOIN fa ON o.id = fa.id")
_marks = {k: p for k, p in t.MARK_CLASSES.items()} | {"any_mark": "|".join(t.MARK_CLASSES.values())}
register("unicode_audit", lambda s, d: name_pairs(s, d).select("id", t.mark_flags(F.col("alt_name")).alias("m")).select("id", "m.*"), f"{N} SELECT id, " + ", ".join(f"regexp_matches(alt_name, '{p}') AS {k}" for k, p in _marks.items()) + " FROM np")


def marked_pairs(s: SparkSession, d: str) -> DataFrame:
    """Names with marks of several scripts: the fixture's names with a word by the last digit of the id."""
    return from_table(s, d, MARKED, "documents")


MARKED = NAME_PAIRS.rstrip().removesuffix("FROM d") + ", CASE kind WHEN 0 THEN 'ガーデン' WHEN 1 THEN 'パン' WHEN 2 THEN 'ห้อง' WHEN 3 THEN 'ゃ' WHEN 4 THEN '한국' WHEN 5 THEN '日本' ELSE '' END AS extra FROM d"
MARKED = f"SELECT id, concat(alt_name, ' ', extra) AS alt_name, CASE WHEN extra IN ('ガーデン', '한국') THEN base_name ELSE concat(base_name, extra) END AS base_name FROM ({MARKED}) q"
register("unicode_summary", lambda s, d: names.unicode_summary(marked_pairs(s, d)), f"WITH np AS ({MARKED}), w AS (" + " UNION ALL ".join(f"SELECT '{k}' AS mark, count(*) FILTER (WHERE regexp_matches(alt_name, '{p}')) AS alt_rows, count(*) FILTER (WHERE regexp_matches(base_name, '{p}')) AS base_rows, count(*) FILTER (WHERE regexp_matches(alt_name, '{p}') OR regexp_matches(base_name, '{p}')) AS either_rows, count(*) AS total_rows FROM np" for k, p in _marks.items()) + ") SELECT *, either_rows / nullif(total_rows, 0)::DOUBLE AS ratio FROM w")
register("conflict_export", lambda s, d: names.conflict_export(name_pairs(s, d)).select("id", "alt_name", "base_name", "tier1", "length_gap"), f"{T} SELECT id, alt_name, base_name, tier1, CAST(abs(length(alt_name) - length(base_name)) AS BIGINT) AS length_gap FROM t1")
register("agreement_export", lambda s, d: names.agreement_export(name_pairs(s, d)), f"{N} SELECT id, alt_name AS name, CASE WHEN alt_name = '' THEN 'empty' WHEN alt_name = lower(alt_name) AND alt_name = replace(upper(alt_name), 'ẞ', 'SS') THEN 'no_case' WHEN alt_name = lower(alt_name) THEN 'lower' WHEN alt_name = replace(upper(alt_name), 'ẞ', 'SS') THEN 'caps' ELSE 'mixed' END AS label FROM np WHERE alt_name = base_name")
register("top_values", lambda s, d: profile.top_values(s.read.parquet(f"{d}/documents.parquet"), "source"), "SELECT source, count(*) AS row_count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 15")
register("inflation", lambda s, d: names.inflation(names.scale_summary(name_pairs(s, d))), ORACLE_SQL["scale_summary"].replace("SELECT outcome, count(*) AS row_count, count(*) / (sum(count(*)) OVER ())::DOUBLE AS ratio FROM o GROUP BY 1", "SELECT count(*) FILTER (WHERE outcome <> 'agreement') AS raw_conflicts, count(*) FILTER (WHERE outcome = 'different') AS different, round(count(*) FILTER (WHERE outcome <> 'agreement') / greatest(count(*) FILTER (WHERE outcome = 'different'), 1)::DOUBLE, 1) AS inflation FROM o"))


# --- evaluation: votes are three fixed functions of the labels ------------------------------------
def voted(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/labels.parquet")
    name = lambda c: F.element_at(F.array(*map(F.lit, extra.LABELS)), (F.pmod(c, F.lit(4)) + 1).cast("int"))
    votes = F.array(name(F.col("doc_id")), name(F.col("doc_id") + F.col("quality")), name(F.floor(F.col("doc_id") / 3)), F.when(F.col("toxic") == 0, name(F.col("doc_id") + 1)))
    return rows.select("doc_id", name(F.col("doc_id")).alias("truth"), ev.majority_vote(votes, 0.5).alias("vote"))


_name = lambda c: f"list_extract(['business_type', 'location', 'disambiguation', 'noise'], CAST(({c}) % 4 AS INT) + 1)"
V = f"""WITH v AS (SELECT doc_id, {_name("doc_id")} AS truth, unnest([{_name("doc_id")}, {_name("doc_id + quality")}, {_name("doc_id // 3")}, CASE WHEN toxic = 0 THEN {_name("doc_id + 1")} END]) AS x FROM labels),
c AS (SELECT doc_id, truth, x, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS m, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, CASE WHEN x = 'business_type' THEN 0 ELSE 1 END, x) AS rn FROM c),
vote AS (SELECT doc_id, truth, CASE WHEN n / m::DOUBLE >= 0.5 THEN x END AS vote FROM r WHERE rn = 1)"""
register("majority_vote", voted, f"{V} SELECT doc_id, truth, vote FROM vote")
register("vote_accuracy", lambda s, d: ev.accuracy(voted(s, d), "truth", "vote"), f"{V}, a AS (SELECT count(*) AS row_count, count(vote) AS answered, count(*) FILTER (WHERE truth = vote) AS correct FROM vote) SELECT *, correct / nullif(answered, 0)::DOUBLE AS accuracy, row_count - answered AS abstained FROM a")
register("class_accuracy", lambda s, d: ev.class_accuracy(voted(s, d), "truth", "vote"), f"{V} SELECT truth AS label, count(*) AS row_count, count(*) FILTER (WHERE truth = vote) AS correct, count(*) FILTER (WHERE truth = vote) / count(*)::DOUBLE AS accuracy FROM vote GROUP BY 1")
register("selection_accuracy", lambda s, d: ev.accuracy(voted(s, d).select(extra.selection_action(F.col("truth")).alias("t"), F.when(F.col("vote").isNotNull(), extra.selection_action(F.col("vote"))).alias("p")), "t", "p"), f"{V}, s AS (SELECT truth = 'business_type' AS t, CASE WHEN vote IS NOT NULL THEN vote = 'business_type' END AS p FROM vote), a AS (SELECT count(*) AS row_count, count(p) AS answered, count(*) FILTER (WHERE t = p) AS correct FROM s) SELECT *, correct / nullif(answered, 0)::DOUBLE AS accuracy, row_count - answered AS abstained FROM a")
register("confusion_matrix", lambda s, d: ev.confusion(s.read.parquet(f"{d}/labels.parquet"), "quality", "toxic", [0, 1, 2]), "SELECT c.actual, count(*) FILTER (WHERE toxic = 0) AS pred_0, count(*) FILTER (WHERE toxic = 1) AS pred_1, count(*) FILTER (WHERE toxic = 2) AS pred_2 FROM (SELECT unnest(['0', '1', '2']) AS actual) c LEFT JOIN labels l ON CAST(l.quality AS VARCHAR) = c.actual GROUP BY 1")
register("mode_class", lambda s, d: ev.mode(voted(s, d), "truth"), f"{V} SELECT truth, count(*) AS row_count FROM vote GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def both_parts(s: SparkSession, d: str) -> DataFrame:
    train, test = ev.hash_split(s.read.parquet(f"{d}/labels.parquet"), "doc_id", 0.6)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


register("hash_split", both_parts, "SELECT *, CASE WHEN CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '42'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.6 THEN 'train' ELSE 'test' END AS part FROM labels")
_places = "SELECT *, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) AS k, floor(count(*) OVER () * 0.6::DOUBLE) AS t FROM labels"
register("exact_split", lambda s, d: order_stats.exact_split(s.read.parquet(f"{d}/labels.parquet"), "doc_id", 0.6, 80, 0.75).select("doc_id", "part"), f"SELECT doc_id, CASE WHEN k > t THEN 'test' WHEN k > least(t, 80) THEN 'spare' WHEN k > floor(least(t, 80) * 0.75::DOUBLE) THEN 'tune' ELSE 'fit' END AS part FROM ({_places}) p")
register("label_sanitizer", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", extra.sanitize(F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, ("Business Type", "it is noise-ish", "LOCATION", "no idea"))), (F.col("event_id") % 4 + 1).cast("int")), F.lit(" "))).alias("label")), "SELECT event_id, list_extract(['business_type', 'noise', 'location', 'disambiguation'], CAST(event_id % 4 AS INT) + 1) AS label FROM events")


def _predicted(s: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    def rule(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": batch["id"], "predicted": batch["alt_name"].str.len().map(lambda n: "long" if n > 30 else "short")})

    return ev.predict(name_pairs(s, d).select("id", "alt_name"), rule, "id string, predicted string")


_found = lambda s, d: golden.golden_subsets(name_pairs(s, d)).select("id", "extra_content")
_has = lambda words: f"list_has_any(string_split(lower(extra), ' '), {_list(words)})"
register("rule_predictor", lambda s, d: ev.predict(_found(s, d), extra.rule_predictor, "id string, predicted string"), f"{SUB} SELECT id, CASE WHEN {_has(extra.NOISE)} THEN 'noise' WHEN {_has(extra.BIZ_FULL)} THEN 'business_type' ELSE 'disambiguation' END AS predicted FROM z")
register("model_adapter", _predicted, f"{N} SELECT id, CASE WHEN length(alt_name) > 30 THEN 'long' ELSE 'short' END AS predicted FROM np")


def gram_rows(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("base_name").endswith("Hotel"), "hotel").when(F.col("base_name").endswith("GmbH"), "legal").otherwise("other")
    return name_pairs(s, d).select("id", F.col("base_name").alias("text"), kind.alias("label"))


_grams = {
    "word": "SELECT id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM (SELECT id, regexp_extract_all(lower(base_name), '[\\p{L}\\p{N}_]{2,}') AS t FROM np) q",
    "char_wb": "SELECT id, substr(w, i, n) AS term FROM (SELECT id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM (SELECT id, ' ' || w || ' ' AS w, unnest([3, 4, 5]) AS n FROM (SELECT id, unnest(string_split_regex(lower(base_name), '\\s+')) AS w FROM np) q WHERE w <> '') r WHERE length(w) >= n) x",
}
for _kind, _size in (("word", 500), ("char_wb", 1000)):
    register(
        f"tfidf_weights_{_kind}",
        lambda s, d, kind=_kind, size=_size: ngrams.tfidf_weights(gram_rows(s, d), "id", "text", kind, size).select("id", "term", ppm("weight").alias("weight")),
        f"{N}, g AS ({_grams[_kind]}), v AS (SELECT term, ln((1 + (SELECT count(*) FROM np))::DOUBLE / (1 + count(DISTINCT id))) + 1 AS idf FROM g GROUP BY term ORDER BY count(*) DESC, encode(term) LIMIT {_size}), w AS (SELECT id, term, count(*) * idf AS w FROM g JOIN v USING (term) GROUP BY id, term, idf) SELECT id, term, {PPM.format('w / sqrt(sum(w * w) OVER (PARTITION BY id))')} AS weight FROM w",
    )


def predictions(s: SparkSession, d: str, kind: str, size: int) -> DataFrame:
    """The rows of the exact test split with the label that a model of the training rows gives them."""
    rows = order_stats.exact_split(gram_rows(s, d), "id", 0.6)
    model = ngrams.ngram_model(rows.where("part = 'train'"), "text", "label", kind, size)
    return ngrams.ngram_predictions(model, rows.where("part = 'test'"), "label").select("id", "label", "predicted")


register("ngram_predictions_word", lambda s, d: predictions(s, d, "word", 500))
register("ngram_predictions_char_wb", lambda s, d: predictions(s, d, "char_wb", 1000))


def tfidf_lr(s: SparkSession, d: str) -> DataFrame:
    return ev.class_accuracy(predictions(s, d, "word", 500), "label", "predicted")


register("tfidf_lr", tfidf_lr)


# --- several models: predictions that are three fixed functions of the labels, two of them with gaps
def models(s: SparkSession, d: str) -> dict[str, DataFrame]:
    rows = s.read.parquet(f"{d}/labels.parquet")
    name = lambda c: F.element_at(F.array(*map(F.lit, extra.LABELS)), (F.pmod(c, F.lit(4)) + 1).cast("int"))
    made = {"a": (name(F.col("doc_id")), "true"), "b": (name(F.col("doc_id") + F.col("quality")), "doc_id % 9 <> 0"), "c": (name(F.floor(F.col("doc_id") / 3)), "doc_id % 7 <> 0")}
    return {k: rows.where(test).select("doc_id", c.alias("predicted")) for k, (c, test) in made.items()}


def aligned(s: SparkSession, d: str) -> DataFrame:
    return ev.align(models(s, d), ["doc_id"]).withColumn("truth", F.element_at(F.array(*map(F.lit, extra.LABELS)), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")))


A = f"""WITH al AS (SELECT a.doc_id, a.p AS pred_a, b.p AS pred_b, c.p AS pred_c, {_name("a.doc_id")} AS truth FROM (SELECT doc_id, min({_name("doc_id")}) AS p FROM labels GROUP BY 1) a
JOIN (SELECT doc_id, min({_name("doc_id + quality")}) AS p FROM labels WHERE doc_id % 9 <> 0 GROUP BY 1) b ON a.doc_id = b.doc_id JOIN (SELECT doc_id, min({_name("doc_id // 3")}) AS p FROM labels WHERE doc_id % 7 <> 0 GROUP BY 1) c ON a.doc_id = c.doc_id)"""
_top = "CASE WHEN pred_a = pred_b AND pred_b = pred_c THEN 3 WHEN pred_a = pred_b OR pred_a = pred_c OR pred_b = pred_c THEN 2 ELSE 1 END"
_vote = "CASE WHEN pred_a = pred_b OR pred_a = pred_c THEN pred_a WHEN pred_b = pred_c THEN pred_b WHEN 'business_type' IN (pred_a, pred_b, pred_c) THEN 'business_type' ELSE least(pred_a, pred_b, pred_c) END"
register("ensemble_align", lambda s, d: aligned(s, d), f"{A} SELECT * FROM al")
register("agreement_histogram", lambda s, d: ev.agreement_histogram(aligned(s, d)), f"{A} SELECT CAST({_top} AS BIGINT) AS agreeing, count(*) AS row_count, count(*) / (sum(count(*)) OVER ())::DOUBLE AS ratio FROM al GROUP BY 1")
register("coverage_at", lambda s, d: ev.coverage_at(aligned(s, d), "truth", [0.3, 0.6, 0.9]), f"{A}, v AS (SELECT truth, {_vote} AS vote, {_top} / 3.0::DOUBLE AS share FROM al), w AS (" + " UNION ALL ".join(f"SELECT {x}::DOUBLE AS threshold, count(*) AS row_count, count(*) FILTER (WHERE share >= {x}) AS answered, count(*) FILTER (WHERE share >= {x} AND vote = truth) AS correct FROM v" for x in (0.3, 0.6, 0.9)) + ") SELECT *, answered / nullif(row_count, 0)::DOUBLE AS coverage, correct / nullif(answered, 0)::DOUBLE AS accuracy FROM w")
register("exact_match", lambda s, d: ev.exact_match(aligned(s, d), "pred_b", "pred_c", F.col("pred_a") == "noise"), f"{A}, w AS (SELECT count(*) FILTER (WHERE pred_a = 'noise') AS masked, count(*) FILTER (WHERE pred_a = 'noise' AND pred_b = pred_c) AS matched FROM al) SELECT *, matched / nullif(masked, 0)::DOUBLE AS ratio FROM w")
register("recorded_predictions", lambda s, d: ev.recorded(s.read.parquet(f"{d}/labels.parquet").select("doc_id"), models(s, d)["b"], ["doc_id"]), f"SELECT l.doc_id, coalesce(m.p, 'error') AS predicted FROM labels l LEFT JOIN (SELECT doc_id, min({_name('doc_id + quality')}) AS p FROM labels WHERE doc_id % 9 <> 0 GROUP BY 1) m ON l.doc_id = m.doc_id")
_point = "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '{0}'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
register("nested_split", lambda s, d: ev.nested_split(s.read.parquet(f"{d}/labels.parquet"), "doc_id", cap=50).select("doc_id", "part"), f"WITH p AS (SELECT doc_id, CASE WHEN {_point.replace('{0}', '42')} >= 0.6 THEN 'test' WHEN {_point.replace('{0}', '42sub')} < 0.75 THEN 'fit' ELSE 'tune' END AS part FROM labels), k AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM p WHERE part = 'fit') q ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id LIMIT 50) SELECT doc_id, CASE WHEN part = 'fit' AND doc_id NOT IN (SELECT doc_id FROM k) THEN 'spare' ELSE part END AS part FROM p")
register("conformed", lambda s, d: profile.conform(s.read.parquet(f"{d}/labels.parquet").select("doc_id", F.expr("nullif(toxic, 0)").alias("actual")), {"correct_answer": -1, "note": ""}, {"actual": "correct_answer"}), "SELECT doc_id, coalesce(CAST(nullif(toxic, 0) AS INTEGER), -1) AS correct_answer, '' AS note FROM labels")
register("latency", lambda s, d: ev.latency(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").cast("double").alias("latency_s"))).select(ppm("rows_per_min").alias("rows_per_min"), ppm("mean_s").alias("mean_s"), "min_s", "max_s"), f"SELECT {PPM.format('60 * count(*) / sum(l_linenumber)::DOUBLE')} AS rows_per_min, {PPM.format('avg(l_linenumber::DOUBLE)')} AS mean_s, min(l_linenumber)::DOUBLE AS min_s, max(l_linenumber)::DOUBLE AS max_s FROM lineitem")
register("sessions", lambda s, d: stream.sessions(s.read.parquet(f"{d}/events.parquet")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "row_count"), "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS row_count FROM n GROUP BY user_id, k")
register("known_candidates", lambda s, d: extra.known(extra.compound_scan(golden.golden_subsets(name_pairs(s, d))).select("id", "short_name", "long_name"), name_pairs(s, d).where("substr(id, -2, 1) IN ('1', '2', '3')").select(F.upper("alt_name").alias("short_name"), F.col("base_name").alias("long_name"))).select("id", "is_known"), f"{SUB}, m AS (SELECT id, CASE WHEN length(alt_name) <= length(base_name) THEN alt_name ELSE base_name END AS s, CASE WHEN length(alt_name) <= length(base_name) THEN base_name ELSE alt_name END AS l FROM z), k AS (SELECT DISTINCT lower(trim(replace(upper(alt_name), 'ẞ', 'SS'))) AS ks, lower(trim(base_name)) AS kl FROM np WHERE substr(id, -2, 1) IN ('1', '2', '3')) SELECT id, ks IS NOT NULL AS is_known FROM m LEFT JOIN k ON lower(trim(s)) = ks AND lower(trim(l)) = kl")
register("event_label_counts", lambda s, d: stream.label_counts(s.read.parquet(f"{d}/events.parquet"), F.col("event_type")), "SELECT date_trunc('hour', ts) AS start, event_type AS label, count(*) AS row_count FROM events GROUP BY 1, 2")


# --- intervals and searches: predictions are fixed functions of the labels ------------------------
_names = ", ".join(f"'{x}'" for x in extra.LABELS)
_truth = "element_at({0}, CAST(doc_id % 4 + 1 AS INT))"
_edges = ", ".join(map(str, ev._POISSON))


def judged(s: SparkSession, d: str) -> DataFrame:
    """doc_id, part, truth and a prediction that is wrong for a third of some rows."""
    rows = s.read.parquet(f"{d}/labels.parquet")
    return rows.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("part"), F.expr(_truth.format(f"array({_names})")).alias("truth"), F.expr(_truth.replace("doc_id", "(doc_id + CASE WHEN doc_id % 7 < 2 THEN 1 ELSE 0 END)").format(f"array({_names})")).alias("predicted"))


_judged = f"SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'none') AS part, {_truth.format(f'[{_names}]')} AS truth, {_truth.replace('doc_id', '(doc_id + CASE WHEN doc_id % 7 < 2 THEN 1 ELSE 0 END)').format(f'[{_names}]')} AS predicted FROM labels".replace("element_at(", "list_extract(")
register(
    "accuracy_interval",
    lambda s, d: ev.accuracy_interval(judged(s, d), "doc_id", "truth", "predicted", ["part"], 60).select("part", "row_count", "correct", *[ppm(c).alias(c) for c in ("accuracy", "low", "high")]),
    f"""WITH j AS ({_judged}), e AS (SELECT part, CASE WHEN truth = predicted THEN 1 ELSE 0 END AS ok, b, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '#' || CAST(b AS VARCHAR)), 1, 8) AS BIGINT) AS u FROM j, range(60) r(b)),
s AS (SELECT part, b, sum(w) AS n, sum(w * ok) / sum(w)::DOUBLE AS x FROM (SELECT *, len(list_filter([{_edges}], lambda t: t <= u)) AS w FROM e) q GROUP BY 1, 2),
o AS (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY x) AS k, count(*) OVER (PARTITION BY part) AS m FROM s WHERE n > 0),
c AS (SELECT part, max(CASE WHEN k = greatest(ceil(m * ((1 - 0.95::DOUBLE) / 2)), 1) THEN x END) AS low, max(CASE WHEN k = greatest(ceil(m * ((1 + 0.95::DOUBLE) / 2)), 1) THEN x END) AS high FROM o GROUP BY 1),
t AS (SELECT part, count(*) AS row_count, {I.format("count(*) FILTER (WHERE truth = predicted)")} AS correct FROM j GROUP BY 1)
SELECT part, row_count, correct, {PPM.format("correct / row_count::DOUBLE")} AS accuracy, {PPM.format("low")} AS low, {PPM.format("high")} AS high FROM t JOIN c USING (part)""",
)
# what candidate c says: right where a digest of row and candidate is below a bound of its own
_say = "CASE WHEN substr(md5(concat(CAST(doc_id AS {0}), '/', CAST(candidate AS {0}))), 1, 1) < substr('3579bdf8', CAST(candidate AS INT) + 1, 1) THEN truth ELSE 'none' END"


def halving(s: SparkSession, d: str) -> DataFrame:
    said = judged(s, d).join(F.broadcast(s.range(8).withColumnRenamed("id", "candidate"))).select("candidate", "doc_id", F.expr(_say.format("STRING")).alias("predicted"))  # recorded predictions
    return ev.demo_search(s.range(8).withColumnRenamed("id", "candidate"), judged(s, d), lambda left, rows: said.join(left, "candidate").join(rows.select("doc_id"), "doc_id"), "truth", "doc_id", 40)


def _rung(r: int) -> str:
    src = "cand" if r == 0 else f"(SELECT candidate FROM r{r - 1} WHERE kept)"
    return f"r{r} AS (SELECT {r} AS rung, candidate, row_count, correct, row_number() OVER (ORDER BY correct DESC, candidate) <= ceil(count(*) OVER () / 2.0) AS kept FROM (SELECT candidate, count(*) AS row_count, count(*) FILTER (WHERE {_say.format('VARCHAR')} = truth) AS correct FROM o, {src} c WHERE k <= {40 << r} GROUP BY 1) q)"


register("demo_search", halving, f"WITH j AS ({_judged}), o AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) AS k FROM j), cand AS (SELECT range AS candidate FROM range(8)), {', '.join(_rung(r) for r in range(3))} " + " UNION ALL ".join(f"SELECT * FROM r{r}" for r in range(3)))


def searched_demos(s: SparkSession, d: str) -> DataFrame:
    """Demonstrations drawn from the rows for fitting, scored by the nearest of them on the rows for tuning."""
    rows = ev.nested_split(gram_rows(s, d), "id")
    candidates = s.range(16).withColumnRenamed("id", "candidate")
    demos = ev.drawn_demos(rows.where("part = 'fit'").select("id", "text", "label"), candidates, 8)
    return ev.demo_search(candidates, rows.where("part = 'tune'"), ev.nearest_demo(demos, "text", "label"), "label", "id", 40)


register("demo_search_nearest", searched_demos)

# --- pairs of a stream, over its whole table ------------------------------------------------------
register(
    "event_pairs",
    lambda s, d: pairs.pair_stream(s.read.parquet(f"{d}/events.parquet"), "ts", "1 hour", "user_id", "event_type", "event_id", "event_type").select("user_id", "alt_name", "base_name", F.col("alt_time").cast("timestamp_ntz").alias("alt_time"), F.col("base_time").cast("timestamp_ntz").alias("base_time")),
    "SELECT a.user_id, a.event_type AS alt_name, b.event_type AS base_name, a.ts AS alt_time, b.ts AS base_time FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR WHERE trim(a.event_type) <> '' AND trim(b.event_type) <> ''",
)


# --- evaluation sets, from files that are written first -------------------------------------------
def sets(s: SparkSession, d: str) -> DataFrame:
    return read_sets(s, set_files(s, d), {"doc_id": "long", "predicted": "string", "note": "string"}, ["doc_id", "predicted"], {"predicted": ("good", "bad")}, least=2)


_cells = " UNION ALL ".join(f"SELECT '{name}' AS set_name, doc_id, {'predicted' if name != 'c' else 'NULL'} AS predicted, note FROM ({text}) {name}" for name, text in SET_ROWS.items())
_sets = f"""WITH cells AS ({_cells}), judged AS (SELECT set_name, TRY_CAST(doc_id AS BIGINT) AS doc_id, nullif(predicted, 'NA') AS predicted, note, CASE
WHEN set_name = 'c' THEN 'no column: predicted' WHEN doc_id IS NULL THEN 'no value: doc_id' WHEN predicted = 'NA' THEN 'no value: predicted'
WHEN TRY_CAST(doc_id AS BIGINT) IS NULL THEN 'not a long: doc_id' WHEN predicted NOT IN ('good', 'bad') THEN 'not valid: predicted' END AS reason FROM cells)"""
register("evaluation_rows", lambda s, d: usable(sets(s, d)), f"{_sets} SELECT set_name, doc_id, predicted, note FROM judged WHERE reason IS NULL")
register("evaluation_rejects", lambda s, d: rejected(sets(s, d)).groupBy("set_name", "reason").agg(F.count("*").alias("row_count")), f"{_sets} SELECT set_name, reason, count(*) AS row_count FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2")


# --- the same through SQL text only -----------------------------------------------------------------
def through_sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        sql.register_functions(s)
        sql.create_views(phone_pairs(s, d), name_pairs(s, d))
        return s.sql(text)

    return run


register("sql_phone_staged", through_sql("SELECT * FROM tf_phone_staged"), ORACLE_SQL["phone_staged"])
register("sql_norm_spelling", through_sql("SELECT id, tf_norm_spelling(alt_name) AS alt_form, tf_norm_spelling(base_name) AS base_form FROM tf_name_pairs"), ORACLE_SQL["name_norm_spelling"])
register("sql_name_typo", through_sql("SELECT id, tf_is_typo(tf_norm_compare(alt_name), tf_norm_compare(base_name)) AS typo FROM tf_name_pairs"), ORACLE_SQL["name_typo"])
register("sql_name_tier1_summary", through_sql("SELECT tier1, count(*) AS row_count, count(*) / sum(count(*)) OVER () AS ratio FROM tf_name_classes GROUP BY tier1"), ORACLE_SQL["name_tier1_summary"])
