"""What a longer name adds: rule labels, the compound scan, faithfulness of built names, and the router."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.once import once
from tallyframe.operators.golden import tokens

LABELS = ("business_type", "location", "disambiguation", "noise")

# Vocabularies (fixed values).
BIZ_BLIND = (
    "hotel", "motel", "inn", "resort", "lodge", "hostel", "suites",
    "bar", "pub", "tavern", "lounge", "brewery", "winery",
    "cafe", "bistro", "diner", "eatery", "canteen",
    "restaurant", "pizzeria", "steakhouse", "grill", "kitchen", "buffet", "deli",
    "bakery", "spa", "salon", "barbershop",
    "supermarket", "market", "mall", "plaza", "centre", "center",
    "hospital", "clinic", "pharmacy", "medical", "dental", "veterinary",
    "museum", "gallery", "theater", "cinema", "studio",
    "school", "university", "institute", "academy",
    "gym", "fitness", "bank", "insurance",
    "shop", "store", "boutique", "outlet",
    "orthodontist", "dentist", "agency", "agent", "advisor",
    "dance", "photography",
    "fachmarkt", "praxis", "therapien", "heizung", "technik",
    "immobilien", "sachverstandige",
)
BIZ_FULL = BIZ_BLIND + (
    "church", "natatorium", "florists", "senior", "retirement", "apartments",
    "design", "transport", "care", "community", "arena", "photo", "lab",
    "propane", "chocolate", "bulbs", "prosthetics", "orthotics",
    "engenharia", "estacionamento", "saude", "terraza", "lanches", "kirjasto",
    "vibrationstechnik", "autofficina", "ankauf", "verkauf", "sushi", "acessorios",
    "bistrot", "ristorante", "trattoria",
)
NOISE = (
    "nmls", "facog", "md", "dds", "fnp", "inh", "ek",
    "llc", "inc", "corp", "ltd", "gmbh", "srl", "plc", "limited", "unlimited",
    "omg", "bba", "vip", "mcx", "vintage", "batch", "online", "internet", "borghi",
)
COMPOUND_BIZ = (
    "hotel", "motel", "inn", "resort", "lodge", "hostel", "suites", "apartments",
    "bar", "pub", "tavern", "lounge", "brewery", "winery", "cafe", "bistro",
    "diner", "eatery", "canteen", "restaurant", "pizzeria", "steakhouse", "grill",
    "kitchen", "buffet", "deli", "bakery", "bistrot", "ristorante", "trattoria",
    "sushi", "lanches",
    "spa", "salon", "barbershop", "clinic", "pharmacy", "medical", "dental",
    "veterinary", "orthodontist", "dentist", "natatorium", "hospice", "therapists",
    "physiotherapie", "praxis", "therapien",
    "supermarket", "market", "mall", "plaza", "shop", "store", "boutique",
    "outlet", "centre", "center", "florists", "cosmetics", "acessorios",
    "museum", "gallery", "theater", "cinema", "studio", "school", "university",
    "institute", "academy", "kirjasto",
    "gym", "fitness", "bank", "insurance", "agency", "agent", "advisor",
    "dance", "photography", "design", "transport", "care", "community",
    "arena", "photo", "lab", "propane", "chocolate", "bulbs", "prosthetics",
    "orthotics", "senior", "retirement",
    "fachmarkt", "immobilien", "sachverstandige", "engenharia", "estacionamento",
    "saude", "terraza", "vibrationstechnik", "autofficina", "ankauf", "verkauf",
    "opticians", "audiologists", "training", "domicile", "serviceburo",
    "geschäftsstelle", "contrôle", "technique", "automobile", "bacaro",
    "kfz-prüfstelle", "zerspanungstechnik", "รีสอร์ท",
    "services", "solutions", "group", "consulting", "management", "logistics",
    "construction", "engineering", "technologies", "systems", "associates",
    "partners", "industries", "enterprises", "international",
    "rental", "dealership", "garage", "autohaus",
)
# Patterns of places in names (fixed values).
PREPOSITION = "(?iu)\\b(in|de|del|da|at|near|von|im|en|af|v|w)\\s+[A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝ]"
SEPARATED = "[-/|–]\\s*[A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝ][a-z]{2,}"


def vocabulary(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, dict.fromkeys(words)))


def word_set(c: Column) -> Column:
    """Runs of letters, numbers and underscores."""
    return F.regexp_extract_all(c, F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def plain_words(c: Column, least: int) -> Column:
    """Words of small ASCII letters only."""
    return F.filter(word_set(c), lambda w: w.rlike(f"^[a-z]{{{least},}}$"))


def titled(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))


def rule_label(extra: Column, long_name: Column, biz: tuple[str, ...] = BIZ_FULL) -> Column:
    """noise, business_type, location or disambiguation, in this order of tests."""
    low = F.lower(extra)
    words, own = word_set(low), plain_words(low, 3)
    capital = F.size(F.filter(own, lambda w: F.array_contains(word_set(long_name), titled(w))))
    location = F.size(own).between(1, 4) & (capital / F.when(F.size(own) > 0, F.size(own)) >= 0.6)
    return F.when(F.arrays_overlap(words, vocabulary(NOISE)) | low.rlike("#[0-9]{3,}"), "noise").when(F.arrays_overlap(words, vocabulary(biz)), "business_type").when(location, "location").otherwise("disambiguation")


def biz_matches(extra: Column) -> Column:
    return F.array_intersect(word_set(F.lower(extra)), vocabulary(COMPOUND_BIZ))


def location_reason(extra: Column, long_name: Column) -> Column:
    """spatial_prep, sep_cap, proper_noun:word or null."""
    nouns = F.filter(plain_words(F.lower(extra), 3), lambda w: ~F.array_contains(vocabulary(COMPOUND_BIZ), w) & F.array_contains(word_set(long_name), titled(w)))
    return F.when(extra.rlike(PREPOSITION), "spatial_prep").when(extra.rlike(SEPARATED), "sep_cap").when(F.size(nouns) > 0, F.concat(F.lit("proper_noun:"), F.try_element_at(nouns, F.lit(1))))


def compound_scan(golden_rows: DataFrame) -> DataFrame:
    """Subset rows of golden() by what the longer name adds: candidate (trade and place), biz_only or none."""
    short_alt = F.length("alt_name") <= F.length("base_name")
    long_name = F.when(short_alt, F.col("base_name")).otherwise(F.col("alt_name"))
    rows = golden_rows.where("conflict_type = 'subset'").select("id", F.when(short_alt, F.col("alt_name")).otherwise(F.col("base_name")).alias("short_name"), long_name.alias("long_name"), "extra_content")
    rows = once(rows, {"biz": biz_matches(F.col("extra_content")), "location": location_reason(F.col("extra_content"), F.col("long_name"))})
    kind = F.when((F.size("biz") > 0) & F.col("location").isNotNull(), "candidate").when(F.size("biz") > 0, "biz_only").otherwise("none")
    return rows.withColumn("kind", kind)


def known(scan: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds is_known: the pair of names is in a table of known candidates (short_name, long_name), case aside."""
    name = lambda c: F.lower(F.trim(F.col(c)))
    keys = candidates.select(name("short_name").alias("_s"), name("long_name").alias("_l")).distinct().withColumn("is_known", F.lit(True))
    joined = scan.withColumn("_s", name("short_name")).withColumn("_l", name("long_name")).join(keys, ["_s", "_l"], "left")
    return joined.withColumn("is_known", F.coalesce("is_known", F.lit(False))).drop("_s", "_l")


def is_faithful(built: Column, long_name: Column, script: Column) -> Column:
    """Everything in the built name is in the longer one: each character for cjk, else each lower-case word."""
    chars = F.forall(F.filter(F.split(built, ""), lambda c: F.trim(c) != ""), lambda c: F.contains(long_name, c))
    words = F.forall(tokens(F.lower(built)), lambda w: F.contains(F.lower(long_name), w))
    return F.when(script == "cjk", chars).otherwise(words)


def route(compound: Column, biz: Column, faithful: Column) -> Column:
    return F.when(compound & (F.size(biz) > 0), F.when(faithful, "construct").otherwise("abstain_unfaithful")).when(compound, "abstain_no_biz_tokens").otherwise("keep_shorter")


def sanitize(raw: Column, labels: tuple[str, ...] = LABELS, default: str = "disambiguation") -> Column:
    """A model's words as a label: exact, else the first label inside, else the default."""
    c = F.regexp_replace(F.lower(F.trim(raw)), "[ -]", "_")
    out = F.when(c.isin(*labels), c)
    for label in labels:
        out = out.when(c.contains(label), label)
    return out.otherwise(default)


def selection_action(label: Column) -> Column:
    return F.when(label == "business_type", "keep_longer").otherwise("keep_shorter")


def relation(short_name: Column, long_name: Column, extra: Column) -> Column:
    """How a longer name relates to a shorter one, by rule: the default of the pair classifier. compound (trade and
    place), business (trade only), place, other; none where nothing is added."""
    trade, place = F.size(biz_matches(extra)) > 0, location_reason(extra, long_name).isNotNull()
    return F.when(F.coalesce(F.trim(extra), F.lit("")) == "", "none").when(trade & place, "compound").when(trade, "business").when(place, "place").otherwise("other")


def construct(short_name: Column, long_name: Column, extra: Column) -> Column:
    """A name built from the shorter one and what says its trade in the longer one, in the longer one's order and
    spelling; null where there is no such word."""
    trades = biz_matches(extra)
    core = word_set(F.lower(short_name))
    words = F.filter(tokens(long_name), lambda w: F.exists(word_set(F.lower(w)), lambda x: F.array_contains(core, x) | F.array_contains(trades, x)))
    return F.when(F.size(trades) > 0, F.array_join(words, " "))


def rule_predictor(batch):
    """The default predictor of the model adapter, free of any model: id, extra_content -> id, predicted."""
    import pandas as pd

    noise, biz = set(NOISE), set(BIZ_FULL)

    def label(text: str | None) -> str:
        words = set((text or "").lower().split())
        return "noise" if words & noise else "business_type" if words & biz else "disambiguation"

    return pd.DataFrame({"id": batch["id"], "predicted": batch["extra_content"].map(label)})
