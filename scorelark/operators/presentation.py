"""Presentation: the checks of format and details, pages, sections, spelling, as columns over ``facts.document_facts``.

A check that is null or true passes. Apart from the graded parts, a part is full
marks or nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelark.functions import lexicons as lx
from scorelark.functions import text as tx
from scorelark.operators import facts, layout
from scorelark.rules import Rules

POINTS_AN_INCH = 72.0
# ---- fixed values ----
PHONE_FOUND = r"(?:\+?\d{1,3}[\s.\-]*)?(?:\(\s*\d{3}\s*\)|\d{3})[\s.\-]?\d{3}[\s.\-]?\d{4}"
PHONE_FINE = r"^(?:\(\d{3}\)\s?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})$"
LABELS = {
    "bullet_alignment": "Bullet Alignment", "bullet_check": "Bullet Check", "bullet_count": "Bullet Count", "date_formatting": "Date Formatting",
    "font_size_check": "Font Size Check", "references": "References", "page_margins": "Page Margins", "objective_summary_length": "Objective/Summary Length",
    "section_styling": "Section Styling", "image_check": "Image Check", "section_spacing": "Section Spacing", "phone_number": "Phone Number",
    "contact_font_size": "Font Size Check", "name_check": "Name Check", "email_address": "Email Address", "gpa_check": "GPA Check",
    "degree_styling": "Degree Styling", "university_name": "University Name", "university_styling": "University Styling", "job_title_styling": "Job Title Styling",
}
# ---- end of the fixed values ----
SUBS = ("overall_format", "number_of_pages", "essential_sections", "section_specific", "spell_check")


def format_checks(rules: Rules) -> dict[str, Column]:
    """All checks of the format, whether a profile asks for them or not."""
    geometry = lambda name: rules[f"presentation.geometry.{name}"]
    clusters = F.size(layout.anchored(F.array_sort("indents"), geometry("bullet_indent_tolerance_pt")))
    least = geometry("margin_min_in") * POINTS_AN_INCH - geometry("margin_slack_pt")
    return {
        "bullet_alignment": ~F.col("two_column") & ((F.col("n_marked") == 0) | (clusters <= 1)),
        "bullet_check": ~F.col("odd_glyphs") & ((F.col("n_ended") == 0) | (F.col("n_ended") == F.col("n_prose"))),
        "bullet_count": ~F.col("listed_bullets"),
        "date_formatting": ~F.col("bad_month") & ~F.col("odd_date") & ~(F.col("full_month") & F.col("short_month")),
        "font_size_check": F.size("sizes") <= geometry("max_distinct_body_font_sizes"),
        "references": ~F.col("references"),
        "page_margins": F.coalesce(F.col("least_margin") >= least, F.lit(True)),
        "objective_summary_length": F.lit(True),
        "section_styling": (F.col("thin_heads") == 0) & (F.col("italic_heads") == 0) & (F.size("cases") <= 1) & (F.size("aligns") <= 1),
        "image_check": F.coalesce(F.col("n_images"), F.lit(0)) == 0,
        "section_spacing": F.lit(True),
    }


def detail_checks(rules: Rules) -> dict[str, Column]:
    """The checks of personal details, education and experience. What a document doesn't mention can't fail."""
    phone = F.trim(F.regexp_extract("blob", PHONE_FOUND, 0))
    degrees = rules.profile["degrees"]
    bad = F.col("bad_degrees") if "italics" not in degrees else F.col("bad_degrees") + F.col("italic_degrees")
    mixed = F.size("degree_styles") > 1 if degrees == "consistent" else F.lit(False)
    return {
        "phone_number": phone.rlike(PHONE_FINE), "contact_font_size": F.lit(True), "name_check": F.col("name") != "", "email_address": F.col("blob").rlike(tx.EMAIL),
        "gpa_check": F.col("gpa").isNull() | F.col("gpa.text").rlike(facts.GPA_SCALE), "degree_styling": (bad == 0) & ~mixed,
        "university_name": F.lit(True), "university_styling": F.lit(True), "job_title_styling": F.size("title_styles") <= 1,
    }


def failed(checks: dict[str, Column]) -> Column:
    """The keys of the checks that fail, in order."""
    return F.array_compact(F.array(*(F.when(~passed, k) for k, passed in checks.items()), F.lit(None).cast("string")))


def profile_checks(rules: Rules) -> dict[str, Column]:
    """The format checks that the profile asks for, in its order; unknown names are left out."""
    every = format_checks(rules)
    return {k: every[k] for k in rules.profile["format_checks"] if k in every}


def page_points(rules: Rules) -> Column:
    """Full marks within the limit, half for a nearly empty page beyond it, else none; before all-or-nothing."""
    most, limit = rules["presentation.number_of_pages"], rules["presentation.geometry.page_limit"]
    nearly = (F.col("n_pages") == limit + 1) & (F.col("last_fill") <= rules["presentation.geometry.page_limit_grace"])
    return F.when(F.col("n_pages") <= limit, most).when(nearly, 0.5 * most).otherwise(0.0)


def section_losses(rules: Rules) -> dict[str, Column]:
    """What missing, unknown and too many sections cost, before the part's limit."""
    most = rules["presentation.essential_sections"]
    has = lambda names: F.arrays_overlap("canonicals", F.array(*map(F.lit, names)))
    per = most / len(lx.ESSENTIAL)
    unknown = rules["presentation.points_per_unknown_section"]
    return {
        "education": F.when(has(["education"]), 0.0).otherwise(per), "experience": F.when(has(lx.EXPERIENCE_CLASS), 0.0).otherwise(per),
        "unknown": F.least(F.lit(rules["presentation.max_unknown_section_loss"]), unknown * F.col("n_unknown")),
        "many": F.when(F.col("n_heads") > rules["presentation.many_sections"], most * rules["presentation.many_sections_share"]).otherwise(0.0),
    }


def _clamped(value: Column, most: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(most), value))


def points(rules: Rules) -> dict[str, tuple[Column, Column]]:
    """Of each part the points and whether it fails (has an error that costs), from facts with ``n_red``, ``n_yellow``, ``failed_format`` and ``failed_details``."""
    get = lambda name: rules[f"presentation.{name}"]
    format_failed, details_failed = F.size("failed_format") > 0, F.size("failed_details") > 0
    losses = section_losses(rules)
    lost = losses["education"] + losses["experience"] + losses["unknown"] + losses["many"]
    pages_failed = page_points(rules) < get("number_of_pages")
    whole = lambda bad, name: F.when(bad, 0.0).otherwise(get(name))
    return {
        "overall_format": (whole(format_failed, "overall_format"), format_failed),
        "number_of_pages": (whole(pages_failed, "number_of_pages"), pages_failed),
        "essential_sections": (_clamped(get("essential_sections") - lost, get("essential_sections")), losses["education"] + losses["experience"] + losses["unknown"] > 0),
        "section_specific": (whole(details_failed, "section_specific"), details_failed),
        "spell_check": (_clamped(get("spell_check") - get("points_per_misspelling") * F.col("n_red"), get("spell_check")), F.col("n_red") > 0),
    }


def statuses(rules: Rules) -> dict[str, Column]:
    """The chips: a part that fails needs work; spelling with words to look at again is on track; all else is good."""
    out = {k: F.when(bad, "Needs Work!").otherwise("Good Job!") for k, (_, bad) in points(rules).items()}
    out["spell_check"] = F.when(F.col("n_red") > 0, "Needs Work!").when(F.col("n_yellow") > 0, "On Track!").otherwise("Good Job!")
    return out
