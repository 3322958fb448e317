"""Matching people who have stated their preferences to openings. Declared data only; nothing here reads the event log.

profiles(employee_id, name, skills, projects, experience, years_experience, familiar_components, primary_role,
current_component, location, preferred_locations, open_to_relocation), preferences(employee_id, preferred_shift,
work_areas, availability, open_to_other_teams, submitted_at), openings(opening_id, repo, component, required_skills,
work_areas, shift, availability, location).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import MOST_ROWS, measured

# Weights of the five sub-scores, and the years that count as full experience.
WEIGHTS = (("skill", 0.35), ("experience", 0.25), ("preference", 0.20), ("availability", 0.10), ("familiarity", 0.10))
FULL_YEARS, AREA_SHARE, SHIFT_SHARE, FLEXIBLE = 6.0, 0.6, 0.4, 0.85
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri")
UNINFORMATIVE = ("unassigned", "(root)", "", "none")


def norm(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def norms(c: str) -> Column:
    return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), norm)


def nameable(profiles: DataFrame, preferences: DataFrame) -> DataFrame:
    """G1: the consent gate: only people who have stated preferences have a name here."""
    return profiles.join(preferences, "employee_id")


def anonymous_count(profiles: DataFrame, preferences: DataFrame) -> DataFrame:
    """G1: how many others there are."""
    return profiles.join(preferences, "employee_id", "left_anti").agg(F.count("*").alias("n_anonymous"))


def requirements(openings: DataFrame, taxonomy: DataFrame, languages: DataFrame) -> DataFrame:
    """Skills an opening needs: as stated, else from the longest taxonomy token in its component and the repository's languages.

    taxonomy(token, skills, areas) and languages(repo, languages) are small reference tables. thin: no skill signal.
    """
    known = openings.withColumn("_stated", F.filter(F.coalesce("required_skills", F.array().cast("array<string>")), lambda s: F.trim(s) != ""))
    hits = known.select("opening_id", "component").join(F.broadcast(taxonomy), F.lower(F.col("component")).contains(F.col("token")))
    best = hits.groupBy("opening_id").agg(F.max_by(F.struct("skills", "areas"), F.struct(F.length("token"), F.col("token"))).alias("b"))
    joined = known.join(best, "opening_id", "left").join(languages, "repo", "left")
    none = F.array().cast("array<string>")
    derived = F.array_distinct(F.concat(F.coalesce("b.skills", none), F.coalesce("languages", none)))
    stated = F.size("_stated") > 0
    thin = ~stated & (F.lower("component").isin(*UNINFORMATIVE) | (F.size(F.coalesce("b.skills", none)) == 0))
    days = F.filter(F.coalesce("availability", none), lambda d: d.isin(*WEEKDAYS))
    shift = F.when(F.col("shift").isin("morning", "afternoon", "evening", "flexible"), F.col("shift")).otherwise("flexible")
    return joined.select(
        "opening_id", "repo", "component", "location", F.when(stated, F.col("_stated")).otherwise(derived).alias("required_skills"), F.coalesce("b.areas", none).alias("work_areas"),
        shift.alias("shift"), F.when(F.size(days) > 0, days).otherwise(F.array(*[F.lit(d) for d in WEEKDAYS])).alias("availability"), thin.alias("thin"),
    )


def _share(hits: Column, of: Column, empty: float) -> Column:
    return F.when(F.size(of) > 0, F.size(hits) / F.size(of)).otherwise(empty)


def _asked(required: DataFrame) -> DataFrame:
    return required.select("opening_id", F.col("component").alias("target"), "required_skills", F.col("work_areas").alias("areas"), F.col("shift").alias("wanted_shift"), F.col("availability").alias("wanted_days"))


def _cheap() -> tuple[dict[str, Column], Column, Column]:
    """Of a candidate beside an opening: the sub-scores that compare lists and numbers (of experience, the part of the years), shared days and matched skills."""
    have, wanted = norms("skills"), F.col("required_skills")
    matched = F.filter(wanted, lambda s: F.array_contains(have, norm(s)))
    shift = F.when(F.col("preferred_shift") == F.col("wanted_shift"), 1.0).when((F.col("preferred_shift") == "flexible") | (F.col("wanted_shift") == "flexible"), FLEXIBLE).otherwise(0.0)
    area = F.when(F.arrays_overlap("preferred_areas", "areas"), 1.0).otherwise(0.0)
    days = F.array_intersect("availability", "wanted_days")
    subs = {
        "skill": _share(matched, wanted, 0.0),
        "experience": 0.5 * F.least(F.lit(1.0), F.col("years_experience") / FULL_YEARS),
        "preference": F.when(F.size("areas") > 0, AREA_SHARE * area + SHIFT_SHARE * shift).otherwise(shift),
        "availability": _share(days, F.col("wanted_days"), 1.0),
        "familiarity": F.lit(0.0),
    }
    return subs, days, matched


def _scored(pairs: DataFrame) -> DataFrame:
    """Reasons, sub-scores, contributions and score of candidates beside openings."""
    subs, days, matched = _cheap()
    wanted = F.col("required_skills")
    corpus = norm(F.array_join(F.concat("projects", "experience"), " "))
    topical = _share(F.filter(wanted, lambda s: F.contains(corpus, norm(s))), wanted, 0.0)
    declared, target = F.filter(norms("familiar_components"), lambda c: c != ""), norm(F.col("target"))
    near = F.exists(declared, lambda c: F.contains(target, c) | F.contains(c, target))
    subs |= {"experience": subs["experience"] + 0.5 * topical, "familiarity": F.when(F.array_contains(declared, target), 1.0).when(near, 0.5).otherwise(0.0)}
    reason = F.when(~F.col("open_to_other_teams"), "not open to other teams").when(F.size(days) == 0, "available on none of the days").when((F.size(wanted) > 0) & (F.size(matched) == 0), "none of the skills")
    scored = pairs.withColumns({f"sub_{n}": F.round(c, 4) for n, c in subs.items()} | {f"part_{n}": F.round(F.lit(dict(WEIGHTS)[n]) * c, 4) for n, c in subs.items()} | {"excluded_reason": reason, "n_matched": F.size(matched)})
    total = F.lit(0.0)
    for n, _ in WEIGHTS:
        total = total + F.col(f"part_{n}")
    return scored.withColumn("score", F.round(total, 4)).select("opening_id", "employee_id", "name", "excluded_reason", "n_matched", *[f"sub_{n}" for n, _ in WEIGHTS], *[f"part_{n}" for n, _ in WEIGHTS], "score")


def fit_scores(candidates: DataFrame, required: DataFrame) -> DataFrame:
    """Every candidate against every opening: why they are not eligible (null: they are), sub-scores, contributions and score.

    Each candidate meets each opening, so the result has that many rows; the openings are broadcast if they measure small.
    For the best of each opening see `best_candidates`, which scores far fewer.
    """
    return _scored(candidates.crossJoin(measured(_asked(required))))


def _barred(rows: DataFrame, value: str, k: int) -> DataFrame:
    """opening_id and _bar, the k-th largest `value` of each opening with so many: from counts of equal values, so no task sorts its pairs."""
    counts = rows.groupBy("opening_id", value).agg(F.count("*").alias("_c"))
    above = Window.partitionBy("opening_id").orderBy(F.col(value).desc())
    return counts.withColumn("_c", F.sum("_c").over(above)).where(F.col("_c") >= k).groupBy("opening_id").agg(F.max(value).alias("_bar"))


def _broadcast_if_few(bars: DataFrame, required: DataFrame) -> DataFrame:
    """Bars have a row an opening at most: openings are counted, not what the bars come from."""
    return F.broadcast(bars) if required.count() <= MOST_ROWS else bars


def shortlist(candidates: DataFrame, required: DataFrame, k: int) -> DataFrame:
    """The pairs that can be among an opening's k best, with all columns that `_scored` reads.

    An index from skills to people gives an opening's people who have any of its skills; others are not eligible, unless it
    asks for none. A pair is taken at the first skill it shares, so nothing is made distinct or joined back. What compares
    lists and numbers gives each pair a least and a greatest possible score. The k-th best least score of an opening is
    its bar, and only pairs whose greatest score reaches it are kept.
    """
    asked = _asked(required)
    # people are dealt anew, since few bytes of them become many pairs: their number of tasks must not follow from their size
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    people = candidates.where("open_to_other_teams").repartition(parts, "employee_id")
    held = people.withColumn("_have", F.array_distinct(F.array_compact(norms("skills")))).withColumn("_skill", F.explode("_have"))
    sought = asked.withColumn("_want", F.array_distinct(F.transform("required_skills", norm))).withColumn("_skill", F.explode("_want"))
    linked = held.join(measured(sought), "_skill").where(F.col("_skill") == F.get(F.array_intersect("_have", "_want"), F.lit(0))).drop("_have", "_want", "_skill")
    anyone = people.crossJoin(measured(asked.where(F.size("required_skills") == 0)))
    subs, days, _ = _cheap()
    least = F.lit(0.0)
    for n, weight in WEIGHTS:
        least = least + weight * subs[n]
    w = dict(WEIGHTS)
    # 0.001: each part and the score are rounded to four digits
    most = F.col("_least") + w["experience"] * 0.5 + w["familiarity"] + 0.001
    pairs = linked.unionByName(anyone).where(F.size(days) > 0).withColumn("_least", least)
    bars = _barred(pairs, "_least", k).withColumn("_bar", F.col("_bar") - 0.001)
    return pairs.join(_broadcast_if_few(bars, required), "opening_id", "left").where(F.col("_bar").isNull() | (most >= F.col("_bar"))).drop("_least", "_bar")


def best_candidates(candidates: DataFrame, required: DataFrame, n: int, alternates: int = 3) -> DataFrame:
    """`rank_candidates` of `fit_scores`, with only those pairs scored that can be among the best of their opening."""
    return rank_candidates(_scored(shortlist(candidates, required, n + alternates)), n, alternates)


def candidates(profiles: DataFrame, preferences: DataFrame) -> DataFrame:
    """People behind the consent gate with the columns that `fit_scores` reads."""
    return nameable(profiles, preferences).withColumnRenamed("work_areas", "preferred_areas")


def eligible(scores: DataFrame) -> DataFrame:
    """Pairs that may be ranked."""
    return scores.where("excluded_reason is null")


def excluded(scores: DataFrame) -> DataFrame:
    """Pairs that may not, with the reason."""
    return scores.where("excluded_reason is not null").select("opening_id", "employee_id", "excluded_reason")


def rank_candidates(scores: DataFrame, n: int, alternates: int = 3) -> DataFrame:
    """The best n of each opening and so many alternates; equal scores by id."""
    w = Window.partitionBy("opening_id").orderBy(F.col("score").desc(), "employee_id")
    ranked = eligible(scores).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n + alternates)
    return ranked.select("opening_id", "position", "employee_id", "score", F.when(F.col("position") <= n, "chosen").otherwise("alternate").alias("role"))


def fit_points(scores: DataFrame) -> DataFrame:
    """Contributions as whole points that add up to the rounded score: the largest remainders are rounded up."""
    terms = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("term"), (F.col(f"part_{n}") * 100).alias("exact")) for i, (n, _) in enumerate(WEIGHTS)])
    long = scores.select("opening_id", "employee_id", F.round(F.col("score") * 100, 0).cast("int").alias("headline"), F.explode(terms).alias("t")).select("*", "t.*").drop("t")
    pair = Window.partitionBy("opening_id", "employee_id")
    floor = F.floor(F.round("exact", 6))
    ranked = long.withColumns({"short": F.col("headline") - F.sum(floor).over(pair), "position": F.row_number().over(pair.orderBy((F.round("exact", 6) - floor).desc(), "i"))})
    return ranked.select("opening_id", "employee_id", "term", (floor + F.when(F.col("position") <= F.col("short"), 1).otherwise(0)).cast("int").alias("points"), "headline")


def opportunities(candidates: DataFrame, required: DataFrame, threshold: int = 50) -> DataFrame:
    """Openings from an employee's side: skills (18 each, 45 at most), place, shift and days; above the threshold or not."""
    r = required.select("opening_id", F.concat_ws("/", "repo", F.col("component")).alias("component_key"), F.col("location").alias("place"), "required_skills", F.col("shift").alias("wanted_shift"), F.col("availability").alias("wanted_days"))
    pairs = candidates.crossJoin(measured(r))
    have = norms("skills")
    wanted = norms("required_skills")
    n_skills = F.size(F.filter(have, lambda s: F.array_contains(wanted, s)))
    there = F.col("location") == F.col("place")
    place = F.when(there, 15).when(F.col("open_to_relocation") & F.array_contains("preferred_locations", F.col("place")), 12).when(F.col("open_to_relocation"), 4).otherwise(0)
    shift = F.when((F.col("preferred_shift") == F.col("wanted_shift")) | (F.col("preferred_shift") == "flexible") | (F.col("wanted_shift") == "flexible"), 13).otherwise(0)
    covered = F.size(F.filter("wanted_days", lambda d: F.array_contains(F.col("availability"), d)))
    days = F.when(covered == F.size("wanted_days"), 12).when(covered > 0, 6).otherwise(0)
    asked = F.when(F.array_contains("preferred_components", F.col("component_key")), 15).otherwise(0)
    fit = F.least(F.lit(45), n_skills * 18) + asked + place + shift + days
    return pairs.select("employee_id", "opening_id", F.least(F.lit(100), fit).cast("int").alias("fit"), (~there).alias("relocation_required"), (F.least(F.lit(100), fit) >= threshold).alias("shown"))


def save_preferences(preferences: DataFrame, new: DataFrame, profiles: DataFrame) -> DataFrame:
    """The newest preferences of each employee; those of unknown employees are not kept."""
    latest = Window.partitionBy("employee_id").orderBy(F.col("submitted_at").desc(), F.col("_new").desc())
    both = preferences.withColumn("_new", F.lit(0)).unionByName(new.join(profiles, "employee_id", "left_semi").withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_new")
