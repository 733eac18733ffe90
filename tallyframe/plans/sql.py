"""The library for SQL users: temporary functions of the row expressions and temporary views of the reports."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import nulls
from tallyframe.functions import text as t
from tallyframe.operators import extra, names, phones, profile

_QUOTED = re.compile(r"('(?:[^'\\]|\\.)*')")
_OPERATOR = re.compile(r"(?<![\w`])(and|or|not|in|[!=<>+\-*/%|&^~]+)\(")


def sql_text(c: Column) -> str:
    """A column as SQL text. Operators are printed as functions of their names, which SQL takes in back quotes."""
    parts = _QUOTED.split(c._jc.node().sql())
    return "".join(x if k % 2 else _OPERATOR.sub(r"`\1`(", x) for k, x in enumerate(parts))


def functions() -> dict[str, tuple[str, str, Column]]:
    """Name -> (parameters, type of the result, expression)."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    one = {
        "digits_only": nulls.digits_only(c), "unify_null": nulls.null_if_encoded(c), "fold": t.fold(c), "norm_compare": t.norm_compare(c),
        "norm_conj": t.norm_conj(c), "norm_spelling": t.norm_spelling(c), "nospace": t.nospace(c), "sorted_tokens": t.sorted_tokens(c),
        "sorted_chars": t.sorted_chars(c), "kata_to_hira": t.kata_to_hira(c), "sanitize_label": extra.sanitize(c),
    }
    tests = {"is_usable": nulls.usable(c), "is_present": nulls.present_strict(c), "has_cjk": t.has_cjk(c), "has_thai": t.has_thai(c)}
    pairs = {"is_typo": t.is_typo(a, b), "is_subset": t.is_subset(a, b)} | {f"phone_{k.lower()}": rule(a, b) for k, rule in phones.RULES.items()}
    out = {k: ("c STRING", "STRING", x) for k, x in one.items()} | {k: ("c STRING", "BOOLEAN", x) for k, x in tests.items()}
    out |= {k: ("a STRING, b STRING", "BOOLEAN", x) for k, x in pairs.items()}
    return out | {"excess": ("a STRING, b STRING", "STRING", t.excess(a, b)), "value_status": ("a STRING, b STRING", "STRING", profile.status(a, b))}


def register_functions(spark: SparkSession, prefix: str = "tf_") -> list[str]:
    """Makes all functions known to the session's SQL, under the prefix; returns their names."""
    out = []
    for name, (parameters, kind, c) in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {sql_text(c)}")
        out.append(prefix + name)
    return out


#: Reports of a table of phone pairs (id, phones, base_phones, confidence, base_confidence) and of name pairs (id, alt_name, base_name).
PHONE_VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "phone_staged": phones.staged_report, "phone_residual": phones.residual, "phone_classes": phones.classify, "phone_features": phones.features,
    "phone_structure": phones.structure, "phone_confidence": phones.confidence_summary, "phone_bands": phones.confidence_bands,
}
NAME_VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "name_forms": names.with_forms, "name_classes": names.classified, "name_staircase": names.staircase, "name_stages": names.with_stages, "name_scale": names.scale_summary,
}


def create_views(phone_pairs: DataFrame | None = None, name_pairs: DataFrame | None = None, prefix: str = "tf_") -> list[str]:
    """Temporary views, under the prefix, of the given pairs (phone_pairs, name_pairs) and of each report on them; all are lazy."""
    out = []
    for base, df, views in (("phone_pairs", phone_pairs, PHONE_VIEWS), ("name_pairs", name_pairs, NAME_VIEWS)):
        if df is not None:
            for name, make in {base: lambda x: x, **views}.items():
                make(df).createOrReplaceTempView(prefix + name)
                out.append(prefix + name)
    return out
