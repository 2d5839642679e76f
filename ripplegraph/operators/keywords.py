"""Layers and sub-categories of names by keywords."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords and their order decide results.
HEALTH = [
    "mortal", "death", "health", "disease", "illness", "hospital", "patient", "cardio", "respiratory", "asthma", "stroke", "dehydration", "morbid", "admission", "emergency", "medical", "mental", "anxiety", "depression",
    "kidney", "renal", "lung", "heart", "blood", "human", "elder", "child", "infant", "pregnan", "worker", "occupat", "sleep", "cognitive", "fatality", "injury", "heat.?related",
]
ECOLOGICAL = [
    "species", "ecosystem", "coral", "reef", "marine", "fish", "bird", "insect", "plant", "tree", "forest", "vegetation", "crop", "wheat", "rice", "maize", "yield", "photosyn", "chlorophyll", "algae", "phyto", "biodiversity",
    "habitat", "fauna", "flora", "larvae", "soil", "microb", "biomass", "canopy", "leaf", "root", "seed", "pollen", "livestock", "cattle", "ecology", "trophic", "spawn",
]
BIOLOGICAL = [
    "coral", "fish", "marine", "species", "organism", "biological", "ecological", "ecosystem", "biodiversity", "genotype", "phenotype", "gene", "microbiota", "bacteria", "virus", "disease", "pathogen", "health", "physiological",
    "metabolism", "photosynthesis", "biomass", "vegetation", "crop", "yield", "animal", "livestock", "mortality", "morbidity", "death", "bleaching", "reproduction", "growth", "survival", "adaptation", "evolution",
]
PHYSICAL = [
    "heat", "temp", "warm", "hot", "thermal", "drought", "dry", "precipitation", "rain", "water", "climate", "weather", "flood", "storm", "cyclone", "extreme", "wind", "humidity", "radiation", "solar", "atmosphere", "ocean",
    "sea", "ice", "snow", "cold", "frost", "air", "ozone", "cloud", "pressure", "monsoon", "geopotential", "convect", "aerosol", "albedo", "emission", "fire", "wildfire", "uhi", "urban.?heat",
]
ECONOMIC = [
    "cost", "loss", "gdp", "labor", "productiv", "job", "employ", "price", "market", "trade", "infrastruct", "grid", "power", "transport", "energy", "damage", "income", "wage", "insura", "expendit", "econom", "financ", "invest",
    "capital", "revenue", "profit", "industr", "manufactur", "electric",
]
SOCIAL = [
    "social", "communit", "inequ", "vulnerab", "populat", "demographic", "migrat", "displac", "policy", "govern", "resilien", "justice", "equity", "household", "gender", "educat", "awareness", "percept", "behavio", "shelter",
    "housing", "neighbor", "civic", "welfare", "access", "conflict", "crime", "violence",
]
SUBCATEGORIES = {
    "physical": {
        "Heatwave": ["heat", "temp", "warm", "hot", "thermal"],
        "Drought": ["drought", "dry", "precipitation", "rain", "water"],
        "Compound Events": ["compound", "flood", "storm", "cyclone", "extreme", "climate", "wind", "fire"],
    },
    "biological": {
        "Public Health": ["health", "disease", "mortality", "morbidity", "virus", "vector", "human", "death"],
        "Agriculture": ["crop", "yield", "food", "wheat", "rice", "maize", "agri", "farm", "soil", "plant", "vegetat"],
        "Marine Ecosystems": ["marine", "fish", "coral", "species", "biodiversity", "ecosystem", "forest", "ocean", "reef"],
    },
    "social": {
        "Policy": ["policy", "govern", "regulat", "law", "institution", "plan", "manag"],
        "Community": ["community", "social", "public", "population", "urban", "city", "resident", "people"],
        "Adaptation": ["adapt", "resilien", "mitigat", "response", "capacity", "vulnerab", "aware"],
    },
    "economic": {
        "Labor Productivity": ["labor", "work", "productivity", "job", "employment", "occupat"],
        "Food Security": ["security", "supply", "price", "market", "trade", "availab"],
        "Infrastructure": ["infrastructure", "grid", "power", "transport", "energy", "damage", "loss", "gdp", "cost", "econom"],
    },
}
# End of fixed values.

#: In this order: the first that has a keyword in the name wins.
BY_KEYWORD = {"biological": BIOLOGICAL, "physical": PHYSICAL, "economic": ECONOMIC, "social": SOCIAL}


def any_of(words: list[str]) -> str:
    return "|".join(words)


def layer(name: Column) -> Column:
    out = F.lit("unknown")
    for layer_, words in reversed(BY_KEYWORD.items()):
        out = F.when(F.lower(name).rlike(any_of(words)), layer_).otherwise(out)
    return out


def split_biological(name: Column, layer_: Column) -> Column:
    """health before ecological before biological; other layers as they are."""
    finer = F.when(F.lower(name).rlike(any_of(HEALTH)), "health").when(F.lower(name).rlike(any_of(ECOLOGICAL)), "ecological").otherwise("biological")
    return F.when(layer_ == "biological", finer).otherwise(layer_)


def subcategory(name: Column, layer_: Column) -> Column:
    """The layer's first sub-category with a keyword in the name, else its last; Other for an unknown layer."""
    out = F.lit("Other")
    for key, subs in SUBCATEGORIES.items():
        found = F.lit(list(subs)[-1])
        for sub, words in reversed(subs.items()):
            found = F.when(F.lower(name).rlike(any_of(words)), sub).otherwise(found)
        out = F.when(layer_ == key, found).otherwise(out)
    return out


# --- the same as SQL, for checks --------------------------------------------------------


def _case(tests: list[tuple[str, str]], last: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in tests) + f" ELSE {last} END"


def _has(name: str, words: list[str]) -> str:
    return f"regexp_matches(lower({name}), '{any_of(words)}')"


def layer_sql(name: str) -> str:
    return _case([(_has(name, words), f"'{key}'") for key, words in BY_KEYWORD.items()], "'unknown'")


def split_biological_sql(name: str, layer_: str) -> str:
    return _case([(f"{layer_} <> 'biological'", layer_), (_has(name, HEALTH), "'health'"), (_has(name, ECOLOGICAL), "'ecological'")], "'biological'")


def subcategory_sql(name: str, layer_: str) -> str:
    return _case([(f"{layer_} = '{key}'", _case([(_has(name, words), f"'{sub}'") for sub, words in subs.items()], f"'{list(subs)[-1]}'")) for key, subs in SUBCATEGORIES.items()], "'Other'")


def literal(words: list[str]) -> bool:
    """No word has a regular expression's sign but the one optional character."""
    return all(re.fullmatch(r"[a-z]+(\.\?[a-z]+)?", w) for w in words)
