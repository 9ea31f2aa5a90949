"""Offence text: separators, ordered rule cascades and class attributes as Columns.

A cascade is data (class, pattern, guard); ``cascade`` folds it into one CASE
expression, so the rules stay inside whole-stage codegen and any taxonomy can
be supplied.  Patterns run with Unicode classes, ignoring case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the taxonomy's lookup tables and patterns ---------------
RANK_OF_SUBCATEGORY = {
    "Larceny Theft - Pickpocket": 1,
    "Larceny Theft - Purse Snatch": 1,
    "Larceny - From Vehicle": 2,
    "Theft From Vehicle": 2,
    "Larceny Theft - Shoplifting": 2,
    "Larceny Theft - From Building": 3,
    "Larceny Theft - Other": 3,
    "Burglary - Residential": 4,
    "Burglary - Hot Prowl": 4,
    "Burglary - Other": 4,
    "Larceny Theft - Bicycle": 4,
    "Larceny - Auto Parts": 5,
    "Burglary - Commercial": 5,
}
CLASS_OF_SUBCATEGORY = {
    "Motor Vehicle Theft": "MVT",
    "Motor Vehicle Theft (Attempted)": "MVT",
    "Vandalism": "NO_LOOT",
    "Arson": "NO_LOOT",
    "Robbery - Street": "ROBBERY",
    "Robbery - Other": "ROBBERY",
    "Robbery - Commercial": "ROBBERY",
    "Robbery - Residential": "ROBBERY",
    "Robbery - Carjacking": "ROBBERY",
}
CLASS_KG = {"MASS_1": 0.3, "MASS_2": 2.0, "MASS_3": 7.0, "MASS_4": 14.0, "MASS_5": 25.0}
THEFT_CLASSES = ["MASS_1", "MASS_2", "MASS_3", "MASS_4", "MASS_5"]
PROPERTY_CLASSES = THEFT_CLASSES + ["MVT", "NO_LOOT"]
ALL_CLASSES = PROPERTY_CLASSES + ["ROBBERY", "OTHER"]

PARTS_AHEAD = r"(?!\s*(part|accessor|licen|plate|tag))"
RULES_V1 = [
    ("MASS_2",
     r"(burglary[\s,\-]*(from|of)?[\s,\-]*(a )?(motor )?vehicle|"
     r"vehicle burglary|burglary\s*-\s*motor vehicle)", None),
    ("MVT",
     r"(motor vehicle theft|auto theft|vehicle theft|stolen (motor )?vehicle|"
     r"(motor ?)?(vehicle|auto)[\s,\-]+(attempt )?stolen|"
     r"theft of (a )?(motor )?vehicle" + PARTS_AHEAD + r"|gta\b|veh theft|"
     r"larceny of motor vehicle" + PARTS_AHEAD + r")", None),
    ("NO_LOOT",
     r"(vandal|criminal damag|malicious mischief|arson|graffiti|"
     r"destruction of property|damage to property|criminal mischief)", None),
    ("MASS_1", r"(pickpocket|pick-pocket|pocket.?pick|purse.?snatch)", None),
    ("MASS_5",
     r"(catalytic|auto part|vehicle part|burglary.?-?\s*commercial|"
     r"commercial burglary|burglary business|non.?residential burglary)", None),
    ("MASS_4", r"(burglar|breaking and entering|b\s*&\s*e\b|bicycle|bike theft)", None),
    ("MASS_2",
     r"(from (a )?(motor )?vehicle|from auto|\bf[\s/]*auto\b|from car|shoplift|"
     r"retail theft|theft from (a )?person|from motor veh|larceny from mv\b)", None),
    ("MASS_3", r"(larceny|theft|stolen property|embezzle)", None),
    ("ROBBERY", r"(robbery|carjack)", None),
]
THEFT_CONTEXT = r"(theft|larceny|stolen|steal|tbut|burglar|taking)"
RULES_V2 = [
    ("OTHER",
     r"(identity theft|ident theft|theft of (labor|service)|embezzle|"
     r"forgery|counterfeit|credit card|wire fraud|bank fraud|"
     r"false pretens|swindle|confidence game|white.collar|"
     r"unauth\w*\s+use\s+of\s+(a\s+)?(credit|debit|financial|access|card|"
     r"device|ftd)|"
     r"stolen property\s*(offense|buy|sell|rec|possess)|"
     r"(receiv|possess|buy|sell)\w*\s+stolen property)", None),
    ("ROBBERY", r"(robbery|carjack)", None),
    ("NO_LOOT",
     r"(vandal|criminal damag|malicious mischief|arson|graffiti|"
     r"destruction of property|damage to property|criminal mischief)", None),
    ("MASS_1",
     r"(pickpocket|pick-pocket|pocket.?pick|purse.?snatch|"
     r"(larceny|theft)\s+from\s+(a\s+)?person)", None),
    ("MASS_5",
     r"(catalytic|auto part|vehicle part|"
     r"part\w*\s+from\s+(a\s+)?(motor\s+)?(vehicle|auto|car)|"
     r"(burglar\w*|b\s*&\s*e|breaking\s+(or|and)\s+entering)"
     r"[^.]{0,40}(commercial|business|non.?resid|nonresid)|"
     r"(commercial|business|non.?resid|nonresid)"
     r"[^.]{0,25}(burglar\w*|b\s*&\s*e|breaking\s+(or|and)\s+entering))", None),
    ("MASS_2",
     r"(from\s+(a\s+)?(motor\s+)?(vehicle|veh\b|auto|car\b|mv\b)|"
     r"\bf\s*/?\s*auto\b|shoplift|retail theft|"
     r"(vehicle|auto|car)\s+burglar|"
     r"burglar\w*\W{0,4}(of\s+|from\s+|to\s+)?(a\s+)?(motor\s+)?"
     r"(vehicle|veh\b|auto|car\b))", None),
    ("MVT",
     r"(motor vehicle theft|auto theft|vehicle theft|"
     r"stolen\s*[,;]?\s*(motor\s+)?(vehicle|auto|car)\b|"
     r"\bauto\b\s*[,;]\s*stolen|"
     r"theft of (a )?(motor )?vehicle" + PARTS_AHEAD + r"|gta\b|veh theft|"
     r"larceny of motor vehicle" + PARTS_AHEAD + r")", None),
    ("MASS_4", r"(burglar|breaking and entering|b\s*&\s*e\b)", None),
    ("MASS_4", r"(bicycle|bike)", THEFT_CONTEXT),
    ("MASS_3", r"(larceny|theft)", None),
]
ARSON_WORDS = r"\barson\b|\bincendiar"
VANDAL_WORDS = (r"vandal|criminal damag|malicious mischief|criminal mischief|graffiti|"
                r"destruction/damage|destruction of property|damage to property")
SEPARATORS = r"[-_/|]+"
# ---- end of fixed values ----------------------------------------------------

FLAGS = "(?iU)"
# Words of which every match of a rule holds at least one, in rule order.  A plain substring
# test is an order of magnitude cheaper than a pattern, and most text fails all of them.
NEEDS_V1 = [
    ["burglary"],
    ["theft", "stolen", "gta", "larceny"],
    ["vandal", "criminal", "malicious", "arson", "graffiti", "destruction", "damage"],
    ["pocket", "purse"],
    ["catalytic", "part", "burglary"],
    ["burglar", "breaking and entering", "&", "bicycle", "bike"],
    ["from", "auto", "shoplift", "retail theft"],
    ["larceny", "theft", "stolen property", "embezzle"],
    ["robbery", "carjack"],
]
NEEDS_V2 = [
    ["theft", "embezzle", "forgery", "counterfeit", "card", "fraud", "pretens", "swindle", "confidence", "collar", "unauth", "stolen"],
    ["robbery", "carjack"],
    ["vandal", "criminal", "malicious", "arson", "graffiti", "destruction", "damage"],
    ["pocket", "purse", "person"],
    ["catalytic", "part", "burglar", "&", "breaking"],
    ["from", "auto", "shoplift", "retail theft", "burglar"],
    ["theft", "stolen", "gta", "larceny"],
    ["burglar", "breaking and entering", "&"],
    ["bicycle", "bike"],
    ["larceny", "theft"],
]


def _found(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def _folded(text: Column) -> Column:
    """Lower case, with the letters that only fold to i, s and k under Unicode rules."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))


def norm_text(text: Column) -> Column:
    """Runs of hyphen, underscore, slash and pipe become one space; null becomes ''."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " ")


def concat_desc(*cols: Column) -> Column:
    """Join description fields with a space, nulls as empty, so no field empties the row."""
    return F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def cascade(text: Column, rules, default: str = "OTHER", needs=None) -> Column:
    """First matching rule wins; a rule with a guard also needs the guard to match.

    ``needs`` lists, per rule, words of which any match must hold one; they are
    tried first on case-folded text.  The text and its folding are bound once
    per row by a one-element ``transform``.
    """
    if not rules:
        return F.lit(default)
    t = F.coalesce(text, F.lit(""))

    def classed(s: Column) -> Column:
        out = None
        for i, (klass, pattern, guard) in enumerate(rules):
            hit = _found(s["t"], pattern)
            if needs:
                any_word = s["f"].contains(needs[i][0])
                for word in needs[i][1:]:
                    any_word = any_word | s["f"].contains(word)
                hit = any_word & hit
            if guard:
                hit = hit & _found(s["t"], guard)
            out = F.when(hit, klass) if out is None else out.when(hit, klass)
        return out.otherwise(default)

    bound = F.transform(F.array(t), lambda x: F.struct(x.alias("t"), _folded(x).alias("f")))
    return F.get(F.transform(bound, classed), F.lit(0))


def classify_text(text: Column) -> Column:
    return cascade(text, RULES_V1, needs=NEEDS_V1)


def classify_text_v2(text: Column) -> Column:
    return cascade(norm_text(text), RULES_V2, needs=NEEDS_V2)


def _lookup(key: Column, table: dict, typ: str) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key).cast(typ)


def classify_exact(subcategory: Column) -> Column:
    """Exact taxonomy code to class; anything unlisted is OTHER."""
    table = {k: f"MASS_{v}" for k, v in RANK_OF_SUBCATEGORY.items()}
    table.update(CLASS_OF_SUBCATEGORY)
    return F.coalesce(_lookup(subcategory, table, "string"), F.lit("OTHER"))


def loot_rank(klass: Column) -> Column:
    return F.when(klass.startswith("MASS_"), F.substring(klass, 6, 1).cast("int"))


def class_kg(klass: Column) -> Column:
    return _lookup(klass, CLASS_KG, "double")


def noloot_subclass(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (F.when(_found(t, ARSON_WORDS), "ARSON")
             .when(_found(t, VANDAL_WORDS), "VANDALISM")
             .otherwise("OTHER_NOLOOT"))


def offence_group(klass: Column, text: Column) -> Column:
    return (F.when(klass.isin(THEFT_CLASSES), "THEFT")
             .when(klass == "NO_LOOT", noloot_subclass(text))
             .otherwise("SKIP"))


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_")
