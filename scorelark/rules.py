"""The rules as data: points, limits and profiles, read by dotted names.

A file in YAML with any part of this tree takes the place of that part; its path
is given, or named by the environment, or there is none and the tree below holds.
Rules are read on the driver and become literals of the plan.
"""

from __future__ import annotations

import copy
import os
from typing import Any

ENVIRONMENT = "SCORELARK_RULES"

# ---- fixed values ----
DEFAULT: dict[str, Any] = {
    "meta": {"zones": {"red": [0, 32], "yellow": [33, 85], "green": [86, 100]}, "min_words_for_score": 200},
    "modules": {"impact": 40.0, "presentation": 30.0, "competencies": 30.0},
    "impact": {
        "action_oriented": 12.0, "specifics": 12.0, "overuse": 8.0, "avoided_words": 8.0, "extracurriculars": {"points": 6.0},
        "bullets": {"min_words": 8, "ideal_min_words": 12, "ideal_max_words": 55, "max_words": 80, "min_bullets_per_entry": 2, "skip_sections": ["skills", "coursework", "interests", "languages", "certifications", "summary"]},
        "verb_weights": {"strong": 1.0, "standard": 0.92, "weak": 0.35, "none": 0.0},
        "specifics_rules": {"quantified_bullet_target": 0.6, "tools_named_target": 0.15, "quantification_weight": 0.5, "passive_voice_penalty_per_bullet": 0.5, "passive_most": 0.25},
        "overuse_rules": {"flag_at_occurrences": 3, "max_reported": 2, "full_loss_at_groups": 6.0, "chip_needs_work_at_groups": 3, "skip_sections": ["education", "coursework", "skills", "interests", "languages", "certifications"]},
        "avoided_words_rules": {"filler_weight": 0.6, "pronoun_weight": 0.4, "filler_full_at": 16.0, "pronoun_full_at": 8.0},
        "chip_good_job_ratio": 5 / 6, "chip_on_track_ratio": 2.5 / 6,
    },
    "presentation": {
        "overall_format": 16.0, "number_of_pages": 1.0, "essential_sections": 9.0, "section_specific": 1.0, "spell_check": 3.0,
        "graded_subs": ["essential_sections", "spell_check"], "points_per_unknown_section": 1.0, "max_unknown_section_loss": 2.0,
        "points_per_failed_format_check": 3.1, "points_per_failed_detail_check": 1.5, "points_per_misspelling": 1.0, "many_sections": 8, "many_sections_share": 0.15,
        "geometry": {"page_limit": 1, "page_limit_grace": 0.15, "margin_min_in": 0.35, "margin_slack_pt": 2.0, "max_distinct_body_font_sizes": 1, "bullet_indent_tolerance_pt": 3.0},
    },
    "competencies": {"points_each": 6.0, "rounding_step": 0.5, "chip_good_job_at": 5.0, "chip_on_track_at": 2.5, "units_for_full_credit": 5.0, "skip_sections": ["summary"], "list": ["analytical", "communication", "leadership", "teamwork", "initiative"]},
    "profiles": {
        "default": "standard",
        "technical": {
            "format_checks": ["bullet_alignment", "bullet_check", "bullet_count", "date_formatting", "font_size_check", "references", "page_margins", "objective_summary_length", "section_styling", "image_check", "section_spacing"],
            "degrees": "consistent", "impact_subparameters": ["action_oriented", "specifics", "overuse", "avoided_words"],
        },
        "standard": {
            "format_checks": ["bullet_alignment", "bullet_check", "date_formatting", "font_size_check", "references", "page_margins", "section_styling", "image_check", "section_spacing"],
            "degrees": "no italics", "impact_subparameters": ["action_oriented", "specifics", "overuse", "avoided_words", "extracurriculars"],
        },
    },
    "benchmark": {"default": "general", "general": {"label": "General cohort", "n": 0, "mean": 70.0, "stdev": 14.0}},
}
# ---- end of the fixed values ----


def _over(base: dict, more: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in more.items():
        out[k] = _over(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


class Rules:
    def __init__(self, tree: dict[str, Any] | None = None):
        self.tree = DEFAULT if tree is None else tree

    @classmethod
    def load(cls, path: str | None = None) -> Rules:
        path = path or os.environ.get(ENVIRONMENT)
        if not path:
            return cls()
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls(_over(DEFAULT, yaml.safe_load(f) or {}))

    def get(self, dotted: str, default: Any = None) -> Any:
        """The value at a dotted name; the default where any part of it is missing."""
        at: Any = self.tree
        for part in dotted.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def __getitem__(self, dotted: str) -> Any:
        got = self.get(dotted, self)
        if got is self:
            raise KeyError(dotted)
        return got

    @property
    def profile(self) -> dict[str, Any]:
        return self[f"profiles.{self['profiles.default']}"]

    def with_profile(self, name: str | None) -> Rules:
        """These rules with another profile; an unknown one changes nothing, and these rules stay as they are."""
        if not name or not isinstance(self.get(f"profiles.{name}"), dict):
            return self
        return Rules(_over(self.tree, {"profiles": {"default": name}}))
