"""Mixing sources to target weights: iterative proportional fitting.

Token weights are raked to source, language and topic marginals. Documents are counted into cells
(source, language, topic) by one aggregation; the categories are those that the targets name and one
for all others, so the cell table is bounded by the targets, not by the data. The fitted cell masses
become rates under a token budget: with repeats, a document of a cell whose rate passes 1 counts as often
as the rate says (m_copies), so the sample has the fitted weights at any budget; without repeats such a cell is taken
whole and the rest shares what is left, and the sample can stay far from the targets. Each document is drawn by a
hash of its id: the same documents at any number of partitions, with hot sources spread like all rows.

Cases: null source or language and unnamed values fall into the category of others; null and empty
texts have no tokens, count for no mass and are kept or dropped with their cell (a cell without any tokens
is kept); a category whose target is zero or not named, others included, is dropped as a whole; targets of categories
without tokens are left out and the rest scaled to one; a dimension without targets is not raked; repeated
rows of one id share their draw; an empty table gives no rows; other columns pass through whatever their
names, but those that are added (m_...) take the place of columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import WORD, Cut, clear_of, table, text_of

OTHER = "(other)"
DIMENSIONS = ("source", "lang", "topic")
TARGETS = {
    "source": {"src0": 0.2, **{f"src{k}": 0.04 for k in range(1, 20)}, OTHER: 0.04},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.14, OTHER: 0.01},
    "topic": {"numeric": 0.1, "list": 0.2, "long": 0.3, "prose": 0.4},
}
ROUNDS = 40
#: Tokens of the sample as a share of all tokens.
BUDGET = 0.8


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def topic_of(text: Column) -> Column:
    """A topic by form, as the tables carry none: many digits, many short lines, long, other prose."""
    size = F.length(text)
    digits, lines = F.length(F.regexp_replace(text, "[^0-9]", "")), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.when(digits * 50 >= size, "numeric").when(lines * 120 >= size, "list").when(size >= 6000, "long").otherwise("prose")


def measured(docs: DataFrame, targets: dict) -> DataFrame:
    """Adds the named category of each dimension (m_source, ...) and m_tokens."""
    text = text_of(docs)
    named = lambda c, values: F.when(c.isin(*values), c).otherwise(OTHER) if values else F.lit(OTHER)
    value = lambda d: topic_of(text) if d == "topic" else F.col(d)
    return docs.withColumns({"m_tokens": token_count(text), **{f"m_{d}": named(value(d), targets.get(d)) for d in DIMENSIONS}})


def rake(cells: dict[tuple, float], targets: dict, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Cell masses with the target marginals, as near to the given ones as can be; they sum to one."""
    mass = {c: float(x) for c, x in cells.items() if x > 0}
    total = sum(mass.values()) or 1.0
    mass = {c: x / total for c, x in mass.items()}
    for _ in range(rounds):
        for k, d in enumerate(DIMENSIONS):
            margin: dict[str, float] = {}
            for c in sorted(mass):
                margin[c[k]] = margin.get(c[k], 0.0) + mass[c]
            wanted = {v: targets[d].get(v, 0.0) if targets.get(d) else 1.0 for v in margin}
            scale = sum(wanted[v] for v in sorted(wanted)) or 1.0
            mass = {c: x * wanted[c[k]] / scale / margin[c[k]] if margin[c[k]] else 0.0 for c, x in mass.items()}
    return mass


def probabilities(cells: dict[tuple, float], mass: dict[tuple, float], budget: float) -> dict[tuple, float]:
    """Chance of each cell's documents so that the expected tokens are the budget; full cells are taken whole."""
    left, out, open_cells = budget, dict.fromkeys(mass, 0.0), {c for c in mass if mass[c] > 0}
    while open_cells:
        share = sum(mass[c] for c in sorted(open_cells))
        full = {c for c in open_cells if left * mass[c] / share >= cells[c]}
        if not full:
            out |= {c: left * mass[c] / share / cells[c] for c in open_cells}
            break
        out |= dict.fromkeys(full, 1.0)
        left -= sum(cells[c] for c in sorted(full))
        open_cells -= full
    return out


def rates(cells: dict[tuple, float], mass: dict[tuple, float], budget: float) -> dict[tuple, float]:
    """Expected copies of each cell's documents so that every cell has its share of the budget."""
    return {c: budget * x / cells[c] for c, x in mass.items()}


def draw(key: Column) -> Column:
    """A number in [0, 1) from the md5 of the id: the same in any engine."""
    return F.conv(F.substring(F.md5(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def drawn(counted: DataFrame, targets: dict, budget: float, repeats: bool) -> DataFrame:
    """measured() rows with m_mass (target share of the cell), m_prob, m_kept and m_copies."""
    keys = [f"m_{d}" for d in DIMENSIONS]
    # at most the product of the targets' sizes, here and in the table that is broadcast
    rows = counted.groupBy(*keys).agg(F.sum("m_tokens").alias("n")).collect()
    cells = {tuple(r[k] for k in keys): float(r["n"]) for r in rows}
    mass = rake(cells, targets)
    chance = (rates if repeats else probabilities)(cells, mass, budget * sum(cells.values()))
    (rate,) = clear_of(counted, "_rate")
    looked = [(*c, mass.get(c, 0.0), chance.get(c, 1.0)) for c in sorted(cells)]
    lookup = counted.sparkSession.createDataFrame(looked, ", ".join(f"{k} string" for k in keys) + f", m_mass double, {rate} double")
    out = counted.drop("m_mass", "m_prob", "m_kept", "m_copies").join(F.broadcast(lookup), keys, "left")
    sure = F.floor(rate)
    out = out.withColumn("m_copies", sure + (draw(F.col("doc_id")) < F.col(rate) - sure).cast("long"))
    return out.withColumns({"m_prob": F.least(F.col(rate), F.lit(1.0)), "m_kept": F.col("m_copies") > 0}).drop(rate)


def mix(docs: DataFrame, targets: dict | None = None, budget: float = BUDGET, repeats: bool = False) -> DataFrame:
    """docs with m_source, m_lang, m_topic, m_tokens, m_mass (target share of the cell), m_prob, m_kept and m_copies."""
    targets = targets or TARGETS
    return drawn(measured(docs, targets), targets, budget, repeats)


def weigh(docs: DataFrame, targets: dict | None = None, budget: float = BUDGET, repeats: bool = False) -> DataFrame:
    """mix() without the texts: doc_id and the m_ columns. The texts are read once; what is counted is written."""
    targets = targets or TARGETS
    narrow = measured(docs, targets).select("doc_id", *[f"m_{d}" for d in DIMENSIONS], "m_tokens")
    return drawn(Cut(docs.sparkSession)(narrow), targets, budget, repeats)


def op1_mix_ipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weigh(table(spark, sf_dir, "documents"), repeats=True)
    return out.select("doc_id", "m_source", "m_lang", "m_topic", "m_tokens", F.floor(F.col("m_prob") * 1e6 + 0.5).cast("long").alias("prob_ppm"), F.col("m_kept").alias("kept"), F.col("m_copies").alias("copies"))
