"""From facts to a score: parts, modules, zones, percentiles, cohorts, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelark.functions import lexicons as lx
from scorelark.operators import presentation
from scorelark.rules import Rules

#: First score of the yellow and of the green zone.
YELLOW, GREEN = 33.0, 86.0
COHORT = {"name": "default", "mean": 70.0, "stdev": 14.0}
PUBLIC = ("name", "label", "n", "mean", "stdev", "median", "min", "max")
SEVERITY = {"error": 0, "warn": 1, "info": 2, "good": 3}


def zone(score: Column) -> Column:
    return F.when(score < YELLOW, "red").when(score < GREEN, "yellow").otherwise("green")


def normal_share(z: Column) -> Column:
    """The standard normal's share below z, by formula 7.1.26 of Abramowitz and Stegun (wrong by 1.5e-7 at most)."""
    x = F.abs(z) / 1.4142135623730951
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = F.signum(z) * (1 - poly * F.exp(-x * x))
    return 0.5 * (1 + erf)


def percentile(score: Column, mean: float = COHORT["mean"], stdev: float = COHORT["stdev"]) -> Column:
    """Of a cohort, to one decimal; a cohort without spread puts everyone in the middle."""
    return F.bround(100 * normal_share((score - mean) / stdev), 1) if stdev > 0 else F.lit(50.0)


GOOD, TRACK, NEEDS = "Good Job!", "On Track!", "Needs Work!"


def chip(ratio: Column, rules: Rules) -> Column:
    return F.when(ratio >= rules["impact.chip_good_job_ratio"], GOOD).when(ratio >= rules["impact.chip_on_track_ratio"], TRACK).otherwise(NEEDS)


def _clamped(value: Column, most: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(most), value))


def _share(part: str, of: str) -> Column:
    return F.when(F.col(of) > 0, F.col(part) / F.col(of))


#: The parts of the wording; the last is of some profiles only.
IMPACT = ("action_oriented", "specifics", "overuse", "avoided_words", "extracurriculars")


def most(rules: Rules) -> dict[str, dict[str, float]]:
    """Of each module its parts, in order, and the most points of each: those of the wording are scaled to what the module is worth."""
    of = {k: rules[f"impact.{k}"] if k != "extracurriculars" else rules["impact.extracurriculars.points"] for k in IMPACT}
    wanted = [k for k in rules.profile["impact_subparameters"] if k in of] or list(IMPACT)[:4]
    scale = rules["modules.impact"] / sum(of[k] for k in wanted)
    scale = scale if abs(scale - 1) * rules["modules.impact"] > 0.01 else 1.0
    return {
        "impact": {k: of[k] * scale for k in wanted}, "presentation": {k: rules[f"presentation.{k}"] for k in presentation.SUBS},
        "competencies": {c: rules["competencies.points_each"] for c in rules["competencies.list"]},
    }


def impact_parts(rules: Rules) -> dict[str, tuple[float, Column, Column]]:
    """Of each part of the wording its most points, its points and its chip, over ``facts.document_facts``."""
    get = lambda name: rules[f"impact.{name}"]
    weights = get("verb_weights")
    mean = lambda kind, n: reduce(Column.__add__, [F.lit(w) * F.col(f"{kind}_{t}") for t, w in weights.items()]) / F.col(n)
    # detail lines count only if there are no others
    weight = F.when(F.col("n_plain") > 0, mean("n", "n_plain")).when(F.col("n_bullets") > 0, mean("all", "n_bullets")).otherwise(0.0)
    whole = get("action_oriented")
    action = _clamped(whole * weight, whole)
    spec = get("specifics_rules")
    q, t = _share("n_quantified", "n_bullets"), _share("n_tooled", "n_bullets")
    raw = spec["quantification_weight"] * F.least(F.lit(1.0), q / spec["quantified_bullet_target"]) + (1 - spec["quantification_weight"]) * F.least(F.lit(1.0), t / spec["tools_named_target"])
    less = F.least(F.lit(spec["passive_most"]), _share("n_passive", "n_bullets") * spec["passive_voice_penalty_per_bullet"])
    specifics = F.coalesce(_clamped(get("specifics") * (raw - less), get("specifics")), F.lit(0.0))
    concrete = F.when(F.col("n_bullets") == 0, NEEDS).when((q >= spec["quantified_bullet_target"]) & (F.size("poor") == 0), GOOD).when((F.col("n_quantified") > 0) | (t >= spec["tools_named_target"]), TRACK).otherwise(NEEDS)
    over, n_over = get("overuse_rules"), F.size("overused")
    shown = F.least(n_over, F.lit(over["max_reported"]))
    overuse = F.when(F.col("n_over_units") == 0, 0.0).otherwise(_clamped(get("overuse") - get("overuse") * F.least(F.lit(1.0), shown / over["full_loss_at_groups"]), get("overuse")))
    repeated = F.when(F.col("n_over_units") == 0, NEEDS).when(n_over == 0, GOOD).when(n_over >= over["chip_needs_work_at_groups"], NEEDS).otherwise(TRACK)
    avoid = get("avoided_words_rules")
    lost = get("avoided_words") * F.least(F.lit(1.0), avoid["filler_weight"] * F.least(F.lit(1.0), F.col("n_filler") / avoid["filler_full_at"]) + avoid["pronoun_weight"] * F.least(F.lit(1.0), F.col("n_pronouns") / avoid["pronoun_full_at"]))
    avoided = F.when(F.col("n_units") == 0, 0.0).otherwise(_clamped(get("avoided_words") - lost, get("avoided_words")))
    plain = F.when(F.col("n_units") == 0, NEEDS).when(F.col("n_pronouns") > 0, NEEDS).when(F.col("n_filler") > 0, TRACK).otherwise(GOOD)
    extra = F.arrays_overlap("canonicals", F.array(*map(F.lit, lx.EXTRACURRICULAR)))
    parts = {
        "action_oriented": (whole, action, chip(action / whole, rules)), "specifics": (get("specifics"), specifics, concrete),
        "overuse": (get("overuse"), overuse, repeated), "avoided_words": (get("avoided_words"), avoided, plain),
        "extracurriculars": (get("extracurriculars.points"), F.when(extra, get("extracurriculars.points")).otherwise(0.0), F.when(extra, GOOD).otherwise(NEEDS)),
    }
    return {k: (m, parts[k][1] * (m / parts[k][0]), parts[k][2]) for k, m in most(rules)["impact"].items()}


def competency_parts(rules: Rules) -> dict[str, tuple[float, Column, Column]]:
    """Points in steps of a half, ties to the even step, by the distinct terms of a competency."""
    get = lambda name: rules[f"competencies.{name}"]
    out = {}
    for c in get("list"):
        units = F.size(F.array_distinct(f"terms_{c}"))
        p = F.bround(get("points_each") * F.least(F.lit(1.0), units / get("units_for_full_credit")) / get("rounding_step")) * get("rounding_step")
        out[c] = (get("points_each"), p, F.when(p >= get("chip_good_job_at"), GOOD).when(p >= get("chip_on_track_at"), TRACK).otherwise(NEEDS))
    return out


def presentation_parts(rules: Rules) -> dict[str, tuple[float, Column, Column]]:
    chips = presentation.statuses(rules)
    return {k: (rules[f"presentation.{k}"], p, chips[k]) for k, (p, _) in presentation.points(rules).items()}


MODULES = {"impact": impact_parts, "presentation": presentation_parts, "competencies": competency_parts}


def _total(module: str) -> Column:
    return F.aggregate(F.filter("parts", lambda x: x["module"] == module), F.lit(0.0), lambda acc, x: acc + x["points"])


def scores(facts: DataFrame, rules: Rules) -> DataFrame:
    """``facts`` (with ``n_red`` and ``n_yellow``) with ``failed_format``, ``failed_details``, ``parts`` (module, part, points, most, status), the points of the
    modules, ``overall``, ``zone``, ``percentile``, ``delta``, ``blockers`` and ``scored``.
    """
    out = facts.withColumns({"failed_format": presentation.failed(presentation.profile_checks(rules)), "failed_details": presentation.failed(presentation.detail_checks(rules))})
    rows = []
    for module, of in MODULES.items():
        rows += [F.struct(F.lit(module).alias("module"), F.lit(k).alias("part"), p.cast("double").alias("points"), F.lit(float(m)).alias("most"), status.alias("status")) for k, (m, p, status) in of(rules).items()]
    out = out.withColumn("parts", F.array(*rows))
    for module, parts in most(rules).items():
        worth, declared = rules[f"modules.{module}"], sum(parts.values())
        out = out.withColumn(module, _clamped(_total(module) * (worth / declared if abs(declared - worth) > 0.01 else 1.0), worth))
    cohort = rules[f"benchmark.{rules['benchmark.default']}"]
    overall = F.bround(F.col("impact") + F.col("presentation") + F.col("competencies"), 1)
    few = rules["meta.min_words_for_score"]
    blockers = F.array_compact(F.array(
        F.when(F.col("n_words") < few, F.concat(F.lit("Only "), F.col("n_words").cast("string"), F.lit(f" words. At least {few} are needed before a score means anything: add "), (few - F.col("n_words")).cast("string"), F.lit(" more."))),
        F.when(F.col("n_lines") == 0, F.lit("No extractable text: this looks like a scanned image or has non-embedded fonts.")),
    ))
    out = out.withColumn("overall", overall).withColumn("blockers", blockers)
    return out.withColumns({"zone": zone(F.col("overall")), "percentile": percentile(F.col("overall"), cohort["mean"], cohort["stdev"]), "delta": F.bround(F.col("overall") - cohort["mean"], 1), "scored": F.size("blockers") == 0})


def wide(scored: DataFrame, parts: list[str]) -> DataFrame:
    """A row a document: the points of the parts and modules, ``overall``, ``zone`` and ``percentile``."""
    of = F.map_from_entries(F.transform("parts", lambda x: F.struct(x["part"], x["points"])))
    return scored.withColumn("__of", of).select("doc_id", *(F.col("__of")[p].alias(p) for p in parts), *MODULES, "overall", "zone", "percentile")


def subscores(scored: DataFrame) -> DataFrame:
    """One row a document and part: ``doc_id``, ``module``, ``part``, ``points``, ``most``, ``status``."""
    return scored.select("doc_id", F.explode("parts").alias("x")).select("doc_id", "x.*")


def findings(parts: DataFrame, of: dict[str, float]) -> DataFrame:
    """One row a document and part: what it lost, and how bad that is."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(p).alias("part"), (F.lit(m) - F.coalesce(F.col(p), F.lit(0.0))).alias("lost"), F.lit(m).alias("most")) for k, (p, m) in enumerate(of.items()))))
    severity = F.when(F.col("lost") > 0.5 * F.col("most"), "error").when(F.col("lost") > 0.01, "warn").otherwise("good")
    return parts.select("doc_id", rows.alias("x")).select("doc_id", "x.*").withColumn("severity", severity)


def top_actions(found: DataFrame, k: int = 10) -> DataFrame:
    """The k largest losses of a document; ties by severity, then in order."""
    rank = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))[F.col("severity")]
    order = Window.partitionBy("doc_id").orderBy(F.desc("lost"), rank, "seq")
    fit = found.where((F.col("lost") > 0.01) & (F.col("severity") != "good"))
    return fit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc_id", "rank", "part", "severity", "lost")


def reconcile(claims: DataFrame, digits: int = 3) -> DataFrame:
    """``doc_id``, ``seq``, ``claim``, ``deficit``: claims scaled so that they add up to the document's deficit; none if there is none."""
    side = Window.partitionBy("doc_id")
    total = F.sum("claim").over(side)
    scaled = F.when((F.col("deficit") <= 0) | (total <= 0), 0.0).otherwise(F.bround(F.col("claim") * F.col("deficit") / total, digits))
    return claims.withColumn("lost", scaled)


def cohort(scores: DataFrame, by: str, score: str = "overall") -> DataFrame:
    """Statistics of the groups that have two scores at least; a group without spread has a deviation of 1."""
    s = F.col(score)
    out = scores.groupBy(F.col(by).alias("name")).agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("stdev"), F.median(s).alias("median"), F.min(s).alias("min"), F.max(s).alias("max"))
    return out.where(F.col("n") >= 2).withColumn("stdev", F.when(F.col("stdev") == 0, 1.0).otherwise(F.col("stdev")))


def difference(before: DataFrame, after: DataFrame, keys: list[str], points: str = "points") -> DataFrame:
    """Parts whose points differ by more than 0.05; a part that one side lacks counts 0 there."""
    both = before.withColumnRenamed(points, "before").join(after.withColumnRenamed(points, "after"), keys, "full")
    b, a = F.coalesce("before", F.lit(0.0)), F.coalesce("after", F.lit(0.0))
    return both.select(*keys, b.alias("before"), a.alias("after"), (a - b).alias("change")).where(F.abs(F.col("change")) > 0.05)


def rolled_up(found: DataFrame) -> DataFrame:
    """What is lost by part, by module, and in all (nulls stand for all): ``doc_id``, ``module``, ``part``, ``lost``, ``n``."""
    out = found.rollup("doc_id", "module", "part").agg(F.sum("points_lost").alias("lost"), F.count("*").alias("n"))
    return out.where(F.col("doc_id").isNotNull())


def modules_apart(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, module, before, after, change) of the modules and the whole of two scores; a module that the first lacks counts 0 there."""
    def each(cards: DataFrame, name: str) -> DataFrame:
        rows = F.explode(F.array(*(F.struct(F.lit(m).alias("module"), F.col(m).alias(name)) for m in (*MODULES, "overall"))))
        return cards.select("doc_id", rows.alias("x")).select("doc_id", "x.*")

    both = each(after, "after").join(each(before, "before"), ["doc_id", "module"], "left").withColumn("before", F.coalesce("before", F.lit(0.0)))
    return both.select("doc_id", "module", "before", "after", (F.col("after") - F.col("before")).alias("change"))


def anchors(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """How far scores lie from those given (``doc_id``, ``given``): their number, the mean and the largest error."""
    off = F.abs(F.col("overall") - F.col("given"))
    return scored.join(truth, "doc_id").agg(F.count("*").alias("n"), F.avg(off).alias("mean_error"), F.max(off).alias("worst"))


def peer_curve(spark: SparkSession, mean: float = COHORT["mean"], stdev: float = COHORT["stdev"]) -> DataFrame:
    """The cohort's density at 0 to 100."""
    x = F.col("id").cast("double")
    return spark.range(101).select(F.col("id").alias("score"), F.exp(-0.5 * F.pow((x - mean) / stdev, F.lit(2.0))).alias("density"))


