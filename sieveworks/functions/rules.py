"""Fields read from the rows of a rule table: numbers, names, limits, labels, states, conditions.

Texts of several cells are joined by bars. Nulls are empty texts, and a rule
that doesn't say something has null or '' there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scope
from .conditions import NUMBER_PATTERN, joined_labels, numbers_in, one_space

#: Words of a category cell, of a number cell without numbers, of a deleted row, of kinds of restriction.
CATEGORY_WORDS = ["급성", "만성", "생태"]
NO_NUMBER_WORDS = ["-", "부여되지 않음", "미부여"]
DELETED_WORDS = ["삭제", "<삭제>", "삭 제", "deleted", "abolished"]
PROHIBITED_WORDS = ["금지물질", "금지대상"]
RESTRICTED_WORDS = ["제한물질", "제한대상"]
NOTICE = r"(\d{4})\s*-\s*0*(\d+)"
#: What in a text asks for more than a number.
USE = r"용도|사용용도|특정\s*용도|용도로"
TIME = r"시행일|유예|경과조치|\d{4}\s*년\s*\d{1,2}\s*월"
PERMISSION = r"허가|승인|신고|금지|제한"
MASS = r"(?iU)\d+(?:\.\d+)?\s*(?:kg|킬로그램|톤|ton|t)\b"
PERCENT = r"\d+(?:\.\d+)?\s*%"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def cells(c: Column) -> Column:
    return F.transform(F.split(text(c), r"\|"), lambda x: F.trim(x))


def _category_at(parts: Column) -> Column:
    """Place of the first short cell with a category word, null for none."""
    has = lambda p: (F.length(p) <= 40) & reduce(lambda a, b: a | b, [F.contains(p, F.lit(w)) for w in CATEGORY_WORDS])
    return F.array_min(F.filter(F.transform(parts, lambda p, i: F.when(has(p), i)), lambda i: i.isNotNull()))


def direct_numbers(direct: Column, source: Column) -> Column:
    """The numbers of the field, else those of the fourth cell before the category."""
    listed = F.filter(F.transform(F.split(text(direct), ";"), lambda x: F.trim(x)), lambda x: x != "")
    parts = cells(source)
    at = _category_at(parts)
    cell = F.when(at >= 4, F.get(parts, (at - 4).cast("int")))
    found = F.when(cell.isNotNull() & ~cell.isin(*NO_NUMBER_WORDS), numbers_in(cell))
    return F.when(F.size(listed) > 0, listed).otherwise(F.coalesce(found, F.array().cast("array<string>")))


def old_limits(reference: Column, source: Column) -> tuple[Column, Column]:
    """(general limit, special limits): the reference's number or that which begins the text after the category; pairs of name and number after it."""
    parts = cells(source)
    at = _category_at(parts)
    tail = F.when(at.isNotNull(), F.array_join(F.slice(parts, (at + 2).cast("int"), F.greatest(F.size(parts), F.lit(1))), " ")).otherwise("")
    number = r"(\d+(?:\.\d+)?)"
    general = F.coalesce(F.regexp_extract(F.trim(text(reference)), "^" + number, 1).try_cast("double"), F.regexp_extract(tail, r"^\s*" + number, 1).try_cast("double"))
    pair = r"([^:]{1,120}):\s*" + number
    name = lambda m: F.trim(F.regexp_replace(F.trim(F.regexp_extract(m, pair, 1)), r"^\d+(?:\.\d+)?\s*", ""))
    specials = F.transform(F.regexp_extract_all(tail, F.lit(pair), F.lit(0)), lambda m: F.struct(name(m).alias("name"), F.regexp_extract(m, pair, 2).cast("double").alias("limit")))
    return general, specials


def least_limit(columns: Sequence[Column]) -> Column:
    """The lowest of the limits that are numbers, null for none."""
    known = [F.when(~F.isnan(c), c) for c in columns]
    return F.least(*known) if len(known) > 1 else known[0]


def first_number(c: Column) -> Column:
    """The first registry number in a text, '' for none."""
    return F.regexp_extract(text(c), NUMBER_PATTERN, 1)


def bare_number(c: Column) -> Column:
    """A number's text without any blanks."""
    return F.regexp_replace(text(c), r"(?U)\s+", "")


def notice_label(number: Column, date: Column) -> Column:
    """'year-number' of a notice, from its number, else from the date's year and the last number; '' if neither tells."""
    n, d = text(number), text(date)
    last = F.try_element_at(F.regexp_extract_all(n, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).try_cast("long")
    full = F.concat_ws("-", F.regexp_extract(n, NOTICE, 1), F.regexp_extract(n, NOTICE, 2).try_cast("long").cast("string"))
    return F.when(n.rlike(NOTICE), full).when(d.rlike(r"^\d{4}") & last.isNotNull(), F.concat_ws("-", F.substring(d, 1, 4), last.cast("string"))).otherwise("")


def notice_key(label: Column) -> Column:
    """(year, number) for ordering; a label that is none comes before all."""
    part = lambda i: F.coalesce(F.regexp_extract(text(label), NOTICE, i).try_cast("int"), F.lit(-1))
    return F.struct(part(1).alias("year"), part(2).alias("number"))


def target_id(category: Column, parent: Column, rule: Column, mixture: Column) -> Column:
    """Target of a case with the prefix of its kind; null where the kind or its key is missing."""
    kinds = {"PARENT_SALT": ("PS::", bare_number(parent)), "CHEMICAL_GROUP": ("CG::", F.trim(text(rule))), "MIXTURE": ("MX::", F.trim(text(mixture)))}
    return F.coalesce(*[F.when((category == k) & (v != ""), F.concat(F.lit(prefix), v)) for k, (prefix, v) in kinds.items()])


def target_category(target: Column) -> Column:
    """Kind of a target by its prefix, NOT_FOUND or OTHER."""
    named = {"PS::": "PARENT_SALT", "CG::": "CHEMICAL_GROUP", "MX::": "MIXTURE"}
    return F.coalesce(F.when(target == "NOT_FOUND", "NOT_FOUND"), *[F.when(target.startswith(p), k) for p, k in named.items()], F.lit("OTHER"))


def title_form(c: Column) -> Column:
    """A title in lower case without blanks and punctuation."""
    return F.lower(F.regexp_replace(text(c), r"(?U)[\s\p{P}]+", ""))


def title_matches(title: Column, wanted: str, terms: Sequence[str]) -> Column:
    """Whether a title is the wanted one, or holds every term."""
    t = title_form(title)
    return (t == title_form(F.lit(wanted))) | (F.lit(bool(terms)) & reduce(lambda a, b: a & b, [F.contains(t, title_form(F.lit(x))) for x in terms], F.lit(True)))


def before_list(c: Column) -> Column:
    """The designation before its list of members."""
    return F.trim(F.regexp_replace(text(c), rf"(?iUs){scope.LIST_MARK}.*$", ""))


def guessed_name(c: Column) -> Column:
    """The nearest telling cell before a text's first number; '' for none.

    Item marks and words for the number are taken off; long cells and cells
    without letters don't tell.
    """
    before = F.when(text(c).rlike(NUMBER_PATTERN), F.regexp_extract(text(c), rf"(?s)^(.*?){NUMBER_PATTERN}", 1)).otherwise(text(c))
    item, label = r"^\s*(?:제?\d+(?:[-–.]\d+)*[.)]?|[가-하][.)])\s*", r"(?i)CAS\s*(?:No\.?|RN)?\s*[:：]?\s*$"
    parts = F.transform(F.split(before, r"[|\t\n]"), lambda p: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(p), item, "")), label, "")))
    good = F.filter(parts, lambda p: (p != "") & (F.length(p) <= 180) & p.rlike(r"\p{L}"))
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first value that isn't blank, '' for none."""
    return F.coalesce(*[F.when(F.trim(text(c)) != "", F.trim(text(c))) for c in columns], F.lit(""))


def deleted_row(name: Column, source: Column, numbers: Column, states: Mapping[str, Column]) -> Column:
    """Why a row is only the mark of a deleted one; null for living rows. A text that merely mentions a deletion lives."""
    n, s = one_space(text(name)), one_space(text(source))
    gone = lambda c: F.lower(c).isin(*DELETED_WORDS)
    empty = n.isin("", "-", "–", "—") & (F.size(numbers) == 0) & s.rlike(r"^<?\s*삭\s*제\s*>?$")
    return F.coalesce(
        F.when(gone(n), "SUBSTANCE_NAME_DELETED_PLACEHOLDER"),
        F.when(gone(s), "SOURCE_TEXT_DELETED_PLACEHOLDER"),
        *[F.when(gone(one_space(text(c))), f"STATUS_COLUMN_DELETED:{k}") for k, c in states.items()],
        F.when(empty, "EMPTY_IDENTITY_DELETED_PLACEHOLDER"),
    )


def for_notice(own: Column, notice: str) -> Column:
    """Rules of a notice, and those that name none."""
    return F.trim(text(own)).isin("", notice)


def executable(mode: Column, reference: Column, required: Column, low: Column, high: Column, members: Column, least: Column) -> Column:
    """(ok, reason) whether a rule held as a row can be run; members: the numbers it lists, as an array."""
    m = F.upper(F.trim(text(mode)))
    filled = lambda c: F.trim(text(c)) != ""
    known = lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
    says = lambda ok, reason: F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"))
    several = (F.size(members) >= 2) | F.coalesce(known(least) & (least >= 2), F.lit(False))
    mixed = m.isin("MIXTURE_COMPONENT", "REACTION_MASS")
    return (
        F.when((m == "SALT_PARENT") & filled(reference), says(True, "REFERENCE_PARENT_SMILES_REQUIRED"))
        .when(m == "SALT_PARENT", says(False, "REFERENCE_PARENT_SMILES_REQUIRED"))
        .when((m == "SUBSTRUCTURE") & ~filled(required), says(False, "REQUIRED_SMARTS_MISSING"))
        .when(m == "SUBSTRUCTURE", says(True, "SMARTS_MUST_PARSE"))
        .when((m == "STRUCTURAL_RANGE") & ~known(low) & ~known(high), says(False, "CARBON_RANGE_REQUIRED"))
        .when(m == "STRUCTURAL_RANGE", says(True, "STRUCTURAL_RANGE_EXECUTABLE"))
        .when(mixed & (F.size(members) == 0), says(False, "CONSTITUENT_CAS_CRITERIA_REQUIRED"))
        .when((m == "REACTION_MASS") & ~several, says(False, "REACTION_MASS_REQUIRES_MULTI_CONSTITUENT_DEFINITION"))
        .when(mixed, says(True, "COMPOSITION_RULE_EXECUTABLE"))
        .otherwise(says(False, "MANUAL_OR_UNSUPPORTED_RULE_MODE"))
    )


def restriction(c: Column) -> Column:
    """PROHIBITED or RESTRICTED where a text names just one of them; null carries the last one on."""
    t = F.regexp_replace(text(c), r"(?U)\s+", "")
    names = lambda words: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
    no, less = names(PROHIBITED_WORDS), names(RESTRICTED_WORDS)
    return F.when(no & ~less, "PROHIBITED").when(less & ~no, "RESTRICTED")


def dimensions(c: Column, limit: Column, use: Column, amount: Column, time: Column, permission: Column) -> dict[str, Column]:
    """What a rule asks for besides the number: from its own fields, else from its text."""
    t = text(c)
    filled = lambda x: F.trim(text(x)) != ""
    return {
        "concentration": F.coalesce(limit.isNotNull() & ~F.isnan(limit), F.lit(False)) | t.rlike(PERCENT),
        "use": filled(use) | t.rlike(USE),
        "quantity": filled(amount) | t.rlike(MASS),
        "time": filled(time) | t.rlike(TIME),
        "authorization": filled(permission) | t.rlike(PERMISSION),
    }


def rule_route(c: Column, has_number: Column, asks: Mapping[str, Column]) -> dict[str, Column]:
    """How far a rule can be decided by fields alone: route, dimensions and the fields it needs."""
    wordy = asks["use"] | asks["time"] | asks["authorization"]
    salts = scope.says(text(c), scope.BROAD_SALT_PATTERNS) & text(c).rlike(NUMBER_PATTERN)
    route = (
        F.when(has_number & wordy, "AI_ASSISTED_CONDITION_CANDIDATE")
        .when(has_number, "DETERMINISTIC_AUTO_CANDIDATE")
        .when(salts, "AI_ASSISTED_IDENTITY_CANDIDATE")
        .otherwise("REVIEW_REQUIRED")
    )
    needs = {"concentration": "concentration_pct", "use": "use_description", "quantity": "annual_quantity_kg", "time": "as_of_date", "authorization": "authorization_status"}
    return {"route": route, "dimensions": joined_labels(dict(asks)), "required_fields": joined_labels({"cas": F.lit(True)} | {needs[k]: v for k, v in asks.items()})}


def carbon_count(structure: Column) -> Column:
    """Carbon atoms in a structure string, aromatic ones included; null for blank."""
    s = F.trim(text(structure))
    count = lambda c, pattern: F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    plain = F.regexp_replace(s, r"\[[^\]]*\]", "")
    return F.when(s != "", count(plain, r"C(?!l)|c") + count(s, r"\[\d*(?:C(?![adeflmnorsu])|c)"))


def capability(model: Column, large: float = 30.0, middle: float = 7.0) -> Column:
    """Tier of a model by the billions of parameters in its name, UNKNOWN without any."""
    size = F.regexp_extract(F.lower(text(model)), r"(\d+(?:\.\d+)?)\s*b(?![a-z0-9])", 1).try_cast("double")
    return F.when(size.isNull(), "UNKNOWN").when(size >= large, "LARGE").when(size >= middle, "MIDDLE").otherwise("SMALL")
