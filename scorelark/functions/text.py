"""Column functions over one line of text. All run in the JVM; none needs a shuffle.

Words of a line are put between blanks once (``spaced``), and lists are sought
there with one regular expression each, which Spark compiles once and calls from
generated code. Lambdas run row by row in an interpreter, so they are left to
what few lines reach: the forms of a word that may be a verb.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelark.functions import lexicons as lx

# ---- fixed values: patterns that must be these for right results ----
COUNTED_WORD = r"[A-Za-z0-9][A-Za-z0-9'/&.+-]*"
WORD = r"[A-Za-z][A-Za-z'/-]*"
LENGTH_TOKEN = r"[A-Za-z0-9][A-Za-z0-9'/%$.,-]*"
YEAR = r"\b(?:19|20)\d{2}\b"
#: Money, percentages, 12K, 3x, plain counts.
NUMBER = r"(?:\$\s?\d[\d,]*(?:\.\d+)?\s?[kKmMbB]?|\d[\d,]*(?:\.\d+)?\s?%|\b\d[\d,]*(?:\.\d+)?\s?[kKmMbB]\b|\b\d+\s?[xX]\b|\b\d[\d,]*(?:\.\d+)?\+?\b)"
RATIO = r"\b\d\.\d{1,2}\s*/\s*\d(?:\.\d+)?\b"
ROMAN = r"\b(?:I{1,3}|IV|VI{0,3}|IX|XI{0,2})\b(?:\s*[-–]\s*(?:I{1,3}|IV|VI{0,3}|IX|XI{0,2})\b)?"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}"
URL = r"(?i)(?:https?://|www\.)[A-Za-z0-9./_%?=&#-]+"
LIST_LABEL = r"(?i)^\s*(?:relevant\s+|selected\s+|core\s+|key\s+|technical\s+)?(?:course\s?work|courses|classes|curriculum|skills|tools|technologies|technical\s+skills|programming(?:\s+languages)?|languages|frameworks|libraries|software|platforms|interests|hobbies|activities|certifications|awards|honou?rs|publications)\s*[:–—-]"
DETAIL_LABEL = r"(?i)^\s*(?:cumulative\s+|overall\s+|major\s+|degree\s+)?(?:gpa|g\.p\.a\.?|grade|grades|major|minor|concentration|specialization|specialisation|thesis|dissertation|advisor|adviser|expected\s+graduation|graduation|honors|honours|distinction)\s*[:–—-]"
CREDENTIAL = r"(?i)^[^.]{0,70}?\b(?:19|20)\d{2}\b[^.]{0,30}?\b(?:accepted|published|presented|poster|proceedings|workshop|in\s+review|under\s+review|submitted|forthcoming|to\s+appear)\b"
REFERENCES = r"(?i)references?\s+(?:available|upon|on)\s+request"
ADVERB = r"^\s*[A-Za-z]+ly\b"
SEPARATOR = r"\s[—–|]\s|:\s"
DATE_ONLY = r"(?i)^[\s\-–—|,.]*(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?|\d{4}|\d{1,2}|present|current|to|now|[\s\-–—|,.])+$"
BOLD = r"(?i)bold|black|heavy|semib|demi|medi|cmbx|sfbx|cmssbx|-bd|,b$|-b$"
ITALIC = r"(?i)italic|oblique|cmti|cmmi|-it\b|,i$|ti\d"
# ---- end of the fixed values ----


def found(text: Column, pattern: str) -> Column:
    """All matches, as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: a filter on a plain column is pushed below it, and computes it again for every mention."""
    if len(columns) == 1:
        ((name, column),) = columns.items()
        return df.select("*", F.explode(F.array(column)).alias(name))
    made = df.select("*", F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias("__computed"))
    return made.select(*df.columns, *(F.col("__computed")[k].alias(k) for k in columns))


def any_of(words) -> str:
    """A pattern for any of the words, as they stand; those in front are tried first."""
    return "(?:" + "|".join(re.sub(r"([^\w ])", r"\\\1", w) for w in words) + ")"


def words(text: Column) -> Column:
    return found(text, WORD)


def spaced(text: Column) -> Column:
    """The words of a line, each with a blank on either side."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def word_hits(text: Column, listed, sp: Column | None = None) -> Column:
    """How many words of a line are among those listed, whatever their case. ``sp``, here and below: ``spaced(text)``, if it is there already."""
    return F.size(found(F.lower(spaced(text) if sp is None else sp), f" {any_of(listed)}(?= )"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    return F.size(found(text, COUNTED_WORD))


def body_text(text: Column) -> Column:
    """Without the glyphs and blanks in front, however many."""
    return F.regexp_replace(text, r"^[•●▪◦‣⁃·■○∙\-–—*o>\s]+|\s+$", "")


def is_bare(body: Column) -> Column:
    """Whether a text without its glyph has too little in it."""
    return F.length(F.regexp_replace(body, "[^A-Za-z0-9]", "")) < 2


def is_stray(text: Column) -> Column:
    return is_bare(body_text(text))


def is_bullet(text: Column) -> Column:
    """Whether a line begins with a glyph; an ambiguous one needs a blank behind it, and no dashed date."""
    t = F.regexp_replace(text, r"^\s+", "")
    plain = t.rlike(r"^[•●▪◦‣⁃·■○∙](?:$|[\sA-Za-z0-9])")
    return plain | t.rlike(r"^[-–—*o>]\s") & ~t.rlike(r"^[-–—]\s*\d")


def glyph(text: Column) -> Column:
    """The glyph of a bullet, else an empty string."""
    return F.when(is_bullet(text), F.substring(F.regexp_replace(text, r"^\s+", ""), 1, 1)).otherwise("")


def is_list(text: Column) -> Column:
    return text.rlike(LIST_LABEL)


def is_detail(text: Column) -> Column:
    return text.rlike(DETAIL_LABEL)


def is_credential(text: Column) -> Column:
    """A paper or talk with its year, unless the line is a list."""
    t = stripped(text)
    return ~is_list(t) & t.rlike(CREDENTIAL)


def is_date_only(text: Column) -> Column:
    """Whether a line is nothing but dates and what stands between them."""
    return stripped(text).rlike(DATE_ONLY)


def is_all_caps(text: Column) -> Column:
    """A letter at least, and none that is not a capital."""
    return text.rlike(r"\p{L}") & ~text.rlike(r"[\p{L}&&[^\p{Lu}]]")


def numbers(text: Column) -> Column:
    """Quantities of a line, kind by kind: numbers but for years, ratios, roman numerals, spelled numbers. One stretch may count twice."""
    masked = F.regexp_replace(text, YEAR, " ")
    spelled = F.regexp_extract_all(spaced(text), F.lit(f" ((?i:{any_of(lx.SPELLED_NUMBERS)}))(?= )"), F.lit(1))
    return F.concat(F.transform(found(masked, NUMBER), lambda x: F.trim(x)), found(masked, RATIO), found(text, ROMAN), spelled)


def number_count(text: Column, sp: Column | None = None) -> Column:
    """How many quantities a line has."""
    masked = F.regexp_replace(text, YEAR, " ")
    # without a digit there is neither a number nor a ratio
    digits = F.when(text.rlike("[0-9]"), F.size(found(masked, NUMBER)) + F.size(found(masked, RATIO))).otherwise(F.lit(0))
    return digits + F.size(found(text, ROMAN)) + word_hits(text, lx.SPELLED_NUMBERS, sp)


def phrase_count(text: Column, phrases) -> Column:
    """How often the phrases stand between blanks, without overlap within a phrase. Few lines have any, which one look tells."""
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    each = reduce(Column.__add__, [F.floor((F.length(low) - F.length(F.replace(low, F.lit(f" {p} "), F.lit("")))) / (len(p) + 2)) for p in phrases]).cast("int")
    return F.when(low.rlike(f" {any_of(phrases)} "), each).otherwise(F.lit(0))


#: A pronoun that isn't in capitals, or one in capitals before a word in lower case.
_SAID = f" (?:(?=[^ ]*[a-z])(?i:{any_of(lx.FIRST_PERSON)})(?= )|{any_of([w.upper() for w in lx.FIRST_PERSON])}(?= [a-z]))"


def pronoun_count(text: Column, sp: Column | None = None) -> Column:
    """First and second person, and phrases of them. One in capitals counts only before a word in lower case."""
    return F.size(found(spaced(text) if sp is None else sp, _SAID)) + phrase_count(text, lx.PRONOUN_PHRASES)


#: Words that are counted as filler. Buzzwords of several words never equal one word.
FILLERS = [w for w in (*lx.FILLER_ADVERBS, *lx.BUZZWORDS, *lx.ARTICLES) if " " not in w]


def filler_count(text: Column, sp: Column | None = None) -> Column:
    return word_hits(text, FILLERS, sp) + phrase_count(text, lx.WEASEL_PHRASES)


def avoided(text: Column, sp: Column | None = None) -> Column:
    """The distinct expressions of a line that a bullet should do without, sorted: more than those that cost points."""
    low = F.lower(text)
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    listed = (*lx.FILLER_ADVERBS, *lx.PRONOUNS, *(w for w in lx.BUZZWORDS if " " not in w), *lx.ARTICLES)
    single = F.regexp_extract_all(F.lower(spaced(text) if sp is None else sp), F.lit(f" ({any_of(listed)})(?= )"), F.lit(1))
    vague = found(low, rf"\b{any_of([w for w in lx.VAGUE_QUANTIFIERS if ' ' not in w])}\b")
    several = [w for w in lx.VAGUE_QUANTIFIERS if " " in w]
    phrases = [F.when(padded.contains(f" {p} ") | stripped(low).startswith(p), p) for p in lx.WEASEL_PHRASES] + [F.when(padded.contains(f" {p} "), p) for p in several]
    there = F.when(low.rlike(any_of((*lx.WEASEL_PHRASES, *several))), F.array_compact(F.array(*phrases))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(single, vague, there)))


_PARTICIPLE = f"(?:{any_of(lx.IRREGULAR_PARTICIPLES)}|(?!{any_of(lx.WEAK_VERBS)} )[^ ]{{3,}}ed)"


def is_passive(text: Column, sp: Column | None = None) -> Column:
    """A form of be or get, and a participle among the next two words."""
    return F.lower(spaced(text) if sp is None else sp).rlike(f" {any_of(lx.BE_VERBS)} (?:[^ ]+ )?{_PARTICIPLE} ")


def _endings(tok: Column) -> list[Column]:
    """Bases that a word's ending allows; null where it doesn't."""
    n = F.length(tok)
    less = lambda k: F.substring(tok, F.lit(1), n - k)
    return [
        F.when(tok.endswith("ied") | tok.endswith("ies") & (n > 4), F.concat(less(3), F.lit("y"))),
        F.when(tok.endswith("ed"), less(2)), F.when(tok.endswith("ed"), less(1)),
        F.when(tok.endswith("ing"), less(3)), F.when(tok.endswith("ing"), F.concat(less(3), F.lit("e"))),
        F.when(tok.endswith("s") & ~tok.endswith("ss"), less(1)),
    ]


PREFIXES = ("co-", "co", "re-", "pre-", "cross-", "self-", "e-")


def lemmas(token: Column) -> Column:
    """The set of words that a word may be a form of, itself included."""
    past = F.create_map(*(F.lit(x) for pair in lx.IRREGULAR_PAST.items() for x in pair))

    def forms(t: Column) -> Column:
        n = F.length(t)
        doubled = (n > 4) & (t.endswith("ed") | t.endswith("ing")) & (F.substring(t, n - 2, F.lit(1)) == F.substring(t, n - 3, F.lit(1)))
        own = F.array_compact(F.array(t, F.try_element_at(past, t), *_endings(t), F.when(doubled, F.substring(t, F.lit(1), n - 3))))

        def stripped(out: Column, prefix: Column) -> Column:
            k = F.length(prefix)
            rest = F.substring(t, k + 1, n)
            cut = F.filter(F.transform(out, lambda x: F.substring(x, k + 1, F.length(x))), lambda x: F.length(x) > 2)
            return F.when(t.startswith(prefix) & (n > k + 2), F.concat(out, cut, F.array_compact(F.array(rest, *_endings(rest))))).otherwise(out)

        return F.aggregate(F.array(*map(F.lit, PREFIXES)), own, stripped)

    bare = F.regexp_replace(F.lower(token), r"^[.,;:()\[\]]+|[.,;:()\[\]]+$", "")
    return F.array_distinct(F.filter(bound(bare, forms), lambda x: x != ""))


def _starts(verbs) -> list[str]:
    """What the first three letters of any form of the verbs can be."""
    forms = {v + x for v in verbs for x in ("", "s", "e", "i", v[-1])} | {v[:-1] + x for v in verbs for x in "ie"}
    return sorted({f[:3] for f in forms} | {past[:3] for past in lx.IRREGULAR_PAST})


def form_of(token: Column, verbs) -> Column:
    """Whether a word may be a form of one of the verbs."""
    low = F.lower(token)
    may = F.substring(low, 1, 3).isin(*_starts(verbs)) | reduce(Column.__or__, [low.startswith(p) for p in PREFIXES])
    return F.when(may, F.arrays_overlap(lemmas(token), F.array(*map(F.lit, verbs)))).otherwise(F.lit(False))


def tier_of(token: Column, standard: list[str]) -> Column:
    """strong, standard or weak; null for a word that is no form of a listed verb."""

    def tier(forms: Column) -> Column:
        among = lambda verbs: F.arrays_overlap(forms, F.array(*map(F.lit, verbs))) if verbs else F.lit(False)
        return F.when(among(lx.STRONG_VERBS), "strong").when(among(standard), "standard").when(among(lx.WEAK_VERBS), "weak")

    low = F.lower(token)
    may = F.substring(low, 1, 3).isin(*_starts([*lx.STRONG_VERBS, *standard, *lx.WEAK_VERBS])) | reduce(Column.__or__, [low.startswith(p) for p in PREFIXES])
    return F.when(may, bound(lemmas(token), tier))


def verb(text: Column, standard: list[str]) -> Column:
    """How a bullet opens: ``tier`` (strong, standard, weak or none) and the ``token`` that tells."""
    result = lambda tier, token: F.struct(tier.alias("tier"), token.alias("token"))
    opener = F.regexp_extract(F.lower(text), rf"^\s*({any_of((*lx.NON_VERB_OPENERS, *lx.NOUN_PHRASE_OPENERS))})", 1)
    two = rf"^[^A-Za-z]*({WORD})[^A-Za-z]*({WORD})?"
    first, second = F.regexp_extract(text, two, 1), F.regexp_extract(text, two, 2)
    # what follows the first separator in the first 90 characters
    before = F.length(F.regexp_extract(F.substring(text, 1, 90), rf"(?s)^(.*?(?:{SEPARATOR}))", 1))
    third = F.when(before > 0, F.regexp_extract(F.substring(text, before + 1, F.length(text)), WORD, 0)).otherwise("")

    def known(token: Column) -> Column:
        tier = tier_of(token, standard)
        return F.when((token != "") & tier.isNotNull(), result(tier, token))

    gerund = F.when(F.lower(first).endswith("ing"), "weak").otherwise("none")
    told = F.coalesce(F.when(text.rlike(ADVERB), known(second)), known(first), known(third), result(gerund, first))
    return F.when(opener != "", result(F.lit("none"), opener)).when(first == "", result(F.lit("none"), F.lit(""))).otherwise(told)


def verb_tier(text: Column, standard: list[str]) -> Column:
    return verb(text, standard)["tier"]


_SINGLE_TOOLS = rf"(?<![a-z]){any_of([t for t in lx.TOOLS if ' ' not in t])}(?![a-z])"


def tools(text: Column) -> Column:
    """Tools named in a line, sorted: several words by containment, single ones between other characters than letters."""
    low = F.lower(text)
    several = [F.when(low.contains(t), t) for t in lx.TOOLS if " " in t]
    return F.array_sort(F.array_distinct(F.concat(found(low, _SINGLE_TOOLS), F.array_compact(F.array(*several)))))


def heading_key(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), r"^\s+|\s+$", "")
    t = F.regexp_replace(t, r"[|:•·\-–—_]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"^[|:•·\-–—_]+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"[.,;:]+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\s+", " ")


def squashed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9&]", "")
