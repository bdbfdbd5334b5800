"""What a rule's text covers: ordered classes with their reasons and evidence.

Each cascade is a table of cases, tried in order; a case has a condition, the
class it gives, its reasons and the words that show it. Texts are searched
without case, with Unicode word boundaries and blanks. Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the texts, in the order they are tried.
BROAD_SALT_PATTERNS = [
    r"(?:와|과|및)\s*그\s*염류",
    r"(?:와|과|및)\s*그\s*염\b",
    r"\band\s+(?:all\s+)?(?:its|their)\s+salts\b",
]
MIXTURE_PATTERNS = [
    r"혼합물",
    r"반응혼합물",
    r"반응생성물",
    r"\bmixture\b",
    r"reaction mixture",
    r"reaction product",
    r"공중합체",
    r"\bcopolymer\b",
]
GENERIC_GROUP_PATTERNS = [r"화합물", r"\bcompounds?\b", r"유도체", r"\bderivatives?\b"]
SALT_FAMILY_PATTERNS = [r"염류", r"\bsalts\b"]
STRUCTURAL_RANGE_PATTERNS = [r"C\s*=\s*\d+\s*[~∼\-]\s*\d+", r"탄소수\s*\d+\s*[~∼\-]\s*\d+"]
EXCLUSION = [r"다만", r"단[\s,，:]", r"제외(?:한다|함|되는|한)?", r"excluding", r"except(?:ion)?", r"with\s+the\s+exception"]
BROAD_SALT_REL = [r"(?:와|과|및)\s*(?:그\s*)?염(?:류)?\b", r"\band\s+(?:all\s+)?(?:its|their)\s+salts?\b"]
SALT_FAMILY = [r"염류", r"염\s*(?:및|또는|등)", r"salts?\b"]
COMPOUND_REL = [r"(?:와|과|및)\s*(?:그\s*)?화합물(?:군|류)?\b", r"\band\s+(?:all\s+)?(?:its|their)\s+compounds?\b"]
GENERIC_COMPOUND = [r"화합물군", r"화합물류", r"화합물", r"\bcompounds?\b"]
DERIVATIVE_REL = [r"(?:와|과|및)\s*(?:그\s*)?유도체(?:류)?\b", r"\band\s+(?:all\s+)?(?:its|their)\s+derivatives?\b"]
GENERIC_DERIVATIVE = [r"유도체류", r"\bderivatives\b"]
REACTION_PRODUCT = [r"reaction\s+(?:product|products)", r"반응\s*생성물"]
MIXTURE_UVCB = [r"reaction\s+mixture", r"\bmixtures?\b", r"혼합물", r"\buvcb\b", r"\bpolymers?\b", r"고분자", r"중합체"]
STRUCTURAL_RANGE = [r"C\s*=?\s*\d+\s*(?:~|[-–—]|to|∼)\s*C?\s*=?\s*\d+", r"탄소수\s*\d+\s*(?:~|[-–—]|에서|∼)\s*\d+"]
GROUP_LIST = [r"/\s*구체적\s*목록", r"총칭으로\s*지정"]
LIST_MARK = r"/\s*구체적\s*목록"
SPECIFIC_DERIVATIVE = [r"deriv(?:ative)?s?\.?", r"유도체"]
SPECIFIC_COMPOUND = [r"\bcompd\.?\b", r"\bcompound\b", r"화합물", r"착화합물"]


def words(patterns: Sequence[str]) -> str:
    """One expression for any of the patterns."""
    return f"(?iU)(?:{'|'.join(patterns)})"


def says(c: Column, patterns: Sequence[str]) -> Column:
    return c.rlike(words(patterns))


def phrase(c: Column, patterns: Sequence[str]) -> Column:
    """The first words that match, with single blanks; '' for none."""
    return F.trim(F.regexp_replace(F.regexp_extract(c, words(patterns), 0), r"(?U)\s+", " "))


class Case(NamedTuple):
    label: str
    reason: str
    text: Column
    patterns: Sequence[str]
    only: Column | None = None


def _decided(cases: Sequence[Case], prefix: Sequence[str] = ()) -> list[Column]:
    """A struct (scope, positive, reasons, evidence) for each case, null where it doesn't hold."""
    out = []
    for c in cases:
        holds = says(c.text, c.patterns) if c.only is None else c.only & says(c.text, c.patterns)
        reasons = F.array(*[F.lit(r) for r in (*prefix, c.reason)])
        out.append(F.when(holds, _result(c.label, True, reasons, phrase(c.text, c.patterns))))
    return out


def _result(scope: str, positive: bool, reasons: Column, evidence: Column) -> Column:
    return F.struct(F.lit(scope).alias("scope"), F.lit(positive).alias("positive"), F.array_join(reasons, ";").alias("reasons"), evidence.alias("evidence"))


def classified(source: Column, name: Column, has_number: Column) -> Column:
    """(scope, positive, reasons, evidence) of a designation.

    positive: a number alone doesn't tell what is covered. An exclusion decides
    first; then texts without a number by the kind they name; then numbers whose
    text reaches beyond them, by relation or by a list of members; the rest
    stands for its number, with the words that might have misled as reasons.
    """
    source, name = F.coalesce(source, F.lit("")), F.coalesce(name, F.lit(""))
    text = F.trim(F.concat_ws(" ", name, source))
    group = F.trim(F.regexp_replace(source, rf"(?iUs){LIST_MARK}.*$", ""))
    listed, bare = says(source, GROUP_LIST), ~has_number
    kinds = [
        ("REACTION_PRODUCT", REACTION_PRODUCT, "REACTION_PRODUCT"),
        ("MIXTURE_OR_UVCB", MIXTURE_UVCB, "MIXTURE_OR_UVCB"),
        ("BROAD_SALT", SALT_FAMILY, "SALT_FAMILY"),
        ("DERIVATIVE_FAMILY", GENERIC_DERIVATIVE, "DERIVATIVE_FAMILY"),
        ("COMPOUND_GROUP", GENERIC_COMPOUND, "COMPOUND_GROUP"),
        ("STRUCTURAL_RANGE", STRUCTURAL_RANGE, "STRUCTURAL_RANGE"),
    ]
    of_list = [
        ("BROAD_SALT", SALT_FAMILY, "GENERIC_SALT_DESIGNATION"),
        ("REACTION_PRODUCT", REACTION_PRODUCT, "GENERIC_REACTION_PRODUCT_DESIGNATION"),
        ("MIXTURE_OR_UVCB", MIXTURE_UVCB, "GENERIC_MIXTURE_UVCB_DESIGNATION"),
        ("DERIVATIVE_FAMILY", DERIVATIVE_REL, "GENERIC_DERIVATIVE_DESIGNATION"),
        ("DERIVATIVE_FAMILY", GENERIC_DERIVATIVE, "GENERIC_DERIVATIVE_DESIGNATION"),
        ("COMPOUND_GROUP", COMPOUND_REL, "GENERIC_COMPOUND_DESIGNATION"),
        ("COMPOUND_GROUP", GENERIC_COMPOUND, "GENERIC_COMPOUND_DESIGNATION"),
        ("STRUCTURAL_RANGE", STRUCTURAL_RANGE, "GENERIC_STRUCTURAL_RANGE"),
    ]
    beyond = [Case("BROAD_SALT", "DIRECT_CAS_PLUS_EXPLICIT_BROAD_SALT_SCOPE", group, BROAD_SALT_REL)]
    beyond += [Case(label, f"{reason}_WITH_SPECIFIC_CAS_LIST", group, p, listed) for label, p, reason in of_list]
    beyond += [
        Case("COMPOUND_GROUP", "DIRECT_CAS_PLUS_EXPLICIT_COMPOUND_FAMILY_SCOPE", text, COMPOUND_REL),
        Case("DERIVATIVE_FAMILY", "DIRECT_CAS_PLUS_EXPLICIT_DERIVATIVE_FAMILY_SCOPE", text, DERIVATIVE_REL),
    ]
    misled = [
        ("SALT_WORD", SALT_FAMILY), ("REACTION_PRODUCT_WORD", REACTION_PRODUCT), ("MIXTURE_UVCB_WORD", MIXTURE_UVCB),
        ("DERIVATIVE_WORD", SPECIFIC_DERIVATIVE), ("COMPOUND_WORD", SPECIFIC_COMPOUND), ("STRUCTURAL_RANGE", STRUCTURAL_RANGE),
    ]
    markers = F.array_compact(F.array(F.lit("DIRECT_CAS_ASSIGNED_AND_NO_EXPLICIT_SCOPE_EXTENSION"), *[F.when(says(name, p) | says(source, p), F.lit(f"{w}_IN_SPECIFIC_NAME")) for w, p in misled]))
    return F.coalesce(
        *_decided([Case("EXPLICIT_EXCEPTION", "EXPLICIT_EXCEPTION_CLAUSE", text, EXCLUSION)]),
        *_decided([Case(label, f"NO_DIRECT_CAS_{reason}", text, p, bare) for label, p, reason in kinds], ["NO_DIRECT_CAS"]),
        F.when(bare, _result("NO_DIRECT_CAS_OTHER", True, F.array(F.lit("NO_DIRECT_CAS")), F.lit(""))),
        *_decided(beyond),
        _result("DIRECT_CAS_ONLY", False, markers, F.lit("")),
    )


def semantic_scope(text: Column, has_number: Column) -> Column:
    """Class of a text; words for groups and salts count only where there is no number."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(says(t, BROAD_SALT_PATTERNS), "BROAD_SALT_SCOPE")
        .when(says(t, MIXTURE_PATTERNS), "MIXTURE_OR_REACTION")
        .when(says(t, STRUCTURAL_RANGE_PATTERNS), "STRUCTURAL_RANGE")
        .when(has_number, "SINGLE_OR_DIRECT_CAS")
        .when(says(t, GENERIC_GROUP_PATTERNS), "GENERIC_GROUP_OR_DERIVATIVE")
        .when(says(t, SALT_FAMILY_PATTERNS), "SALT_FAMILY")
        .otherwise("OTHER")
    )


def needs_more_than_number(text: Column, has_number: Column) -> Column:
    """Whether what is covered can't be told by numbers alone."""
    return ~has_number | says(F.coalesce(text, F.lit("")), BROAD_SALT_PATTERNS)


def identity_class(text: Column) -> Column:
    """The plain order of classes, whether or not there is a number."""
    t = F.coalesce(text, F.lit(""))
    ordered = [
        ("BROAD_SALT", BROAD_SALT_PATTERNS), ("MIXTURE", MIXTURE_PATTERNS), ("STRUCTURAL_RANGE", STRUCTURAL_RANGE_PATTERNS),
        ("GENERIC_GROUP", GENERIC_GROUP_PATTERNS), ("SALT_FAMILY", SALT_FAMILY_PATTERNS),
    ]
    return F.coalesce(*[F.when(says(t, p), label) for label, p in ordered], F.lit("OTHER"))


def traced(numbers: Column, text: Column) -> Column:
    """Whether every number stands in the text; true of none."""
    return F.forall(F.coalesce(numbers, F.array().cast("array<string>")), lambda n: F.contains(F.coalesce(text, F.lit("")), n))
