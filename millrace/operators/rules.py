"""Small decision rules: alignment of evidence, labels from indicators, strict joins, ranked lists and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import checkpointed
from millrace.functions.text import tokens

# Words that show a refusal or a state, and results that say nothing.
NEGATIVE_TERMS = ("reject", "rejected", "deny", "denied", "invalid", "expired", "blocked", "locked", "missing", "error", "fail", "failure", "unauthorized")
STATE_TERMS = ("remain", "persist", "state", "created", "updated", "deleted", "locked", "unlocked", "associated", "unchanged")
WEAK_ORACLES = ("works", "works correctly", "looks correct", "looks good", "ok", "okay", "success", "successful", "pass")
# Package names that stand for none.
AMBIGUOUS = ("", "(default)", "(default package)", "(path-unresolved)", "(package-unresolved)", "pending")


def alignment(expected: Column, actual: Column) -> Column:
    """How far the words of ``expected`` occur in ``actual`` (arrays of distinct words): 45 % of them count as all."""
    share = F.size(F.array_intersect(expected, actual)) / F.size(expected)
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share / 0.45))


def list_alignment(expected: Column, actual: Column) -> Column:
    """Mean alignment of a list of word arrays; an empty list is aligned."""
    total = F.aggregate(expected, F.lit(0.0), lambda s, e: s + alignment(e, actual))
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(total / F.size(expected))


def _any_of(text: Column, terms: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def scenario_alignment(behaviour: Column, constraints: Column, text: Column) -> Column:
    """How well the text of evidence fits the kind of behaviour: refusals, boundaries (share of constraints named), states."""
    low = F.lower(text)
    named = F.size(F.filter(constraints, lambda c: F.contains(low, F.lower(c)))) / F.size(constraints)
    kind = F.upper(behaviour)
    return (
        F.when(kind == "NEGATIVE", F.when(_any_of(low, NEGATIVE_TERMS), 1.0).otherwise(0.25))
        .when(kind == "BOUNDARY", F.when(F.size(constraints) == 0, 0.5).otherwise(named))
        .when(kind.isin("STATE", "STATE_TRANSITION"), F.when(_any_of(low, STATE_TERMS), 1.0).otherwise(0.4))
        .otherwise(1.0)
    )


def oracle_strength(kind: Column, assertions: Column, expected: Column) -> Column:
    """What decides a test: its assertions, or the result that a manual one expects."""
    said = F.trim(F.coalesce(expected, F.lit("")))
    manual = F.when(said == "", 0.0).when(F.lower(said).isin(*WEAK_ORACLES), 0.2).when(F.size(tokens(said)) >= 4, 0.9).otherwise(0.6)
    return F.when(kind == "AUTOMATED_TEST", F.when(assertions > 0, 1.0).otherwise(0.3)).otherwise(manual)


def unambiguous(rows: DataFrame, key: str, names: Sequence[str] = AMBIGUOUS) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & ~F.trim(key).isin(*names))


def optional(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows that equal every given value; a value of None asks for nothing."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


def violation_label(indicators: Sequence[Column], least: int = 1) -> Column:
    """1 if the indicators sum to ``least``, 0 if not, null if one is missing; a negative one is an error."""
    known, total, negative = F.lit(True), F.lit(0), F.lit(False)
    for x in indicators:
        known, total, negative = known & x.isNotNull(), total + x, negative | F.coalesce(x < 0, F.lit(False))
    return F.when(negative, F.raise_error(F.lit("Violation counts cannot be negative")).cast("int")).when(known, (total >= least).cast("int"))


def strict_left_join(rows: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with its one match; rows without a match, and keys that the right side repeats, are an error."""
    if not right.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("the right side repeats keys")
    missing = rows.join(right, list(keys), "left_anti").select(*keys).head(10)
    if missing:
        raise ValueError(f"rows without a match: {missing}")
    return rows.join(right, list(keys))


def same_sets(left: DataFrame, right: DataFrame, owner: str, member: str) -> DataFrame:
    """(owner, matched): owners of ``left`` whose set of members equals that of exactly one owner of ``right``.

    Sets meet by the count, the sum and the xor of their members' hashes, and no set is gathered in one row. Sets of one
    outline are the same where they have no more members together than each; only others are compared owner by owner.
    """
    key = ["n", "s", "x"]

    def outline(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        own = rows.select(F.col(owner).alias(name), F.col(member).alias("member")).where("member is not null").repartition(name).distinct()
        h = F.xxhash64("member")
        return own, own.groupBy(name).agg(F.count("*").alias("n"), F.sum(F.shiftright(h, 8)).alias("s"), F.bit_xor(h).alias("x"))

    (a, a_sums), (b, b_sums) = outline(left, "owner"), outline(right, "matched")
    alone = b_sums.groupBy(*key).agg(F.count("*").alias("owners"), F.min("matched").alias("matched")).where("owners = 1")
    members = a.join(a_sums, "owner").select(*key, "member").unionByName(b.join(b_sums, "matched").select(*key, "member")).distinct()
    mixed = checkpointed(members.groupBy(*key).agg(F.count("*").alias("held")).where("held > n").select(*key))
    if mixed.isEmpty():
        return a_sums.join(alone, key).select(F.col("owner").alias(owner), "matched")
    met = a_sums.join(mixed, key, "left_semi").join(b_sums, key).select("owner", "matched")
    wrong = met.join(a, "owner").join(b, ["matched", "member"], "left_anti").select("owner", "matched").distinct()
    good = met.join(wrong, ["owner", "matched"], "left_anti")
    one = good.groupBy("owner").agg(F.count("*").alias("n"), F.min("matched").alias("matched")).where("n = 1").select("owner", "matched")
    plain = a_sums.join(mixed, key, "left_anti").join(alone, key).select("owner", "matched")
    return plain.unionByName(one).select(F.col("owner").alias(owner), "matched")


def reason_counts(rows: DataFrame, reasons: str, sep: str = ";") -> DataFrame:
    """(reason, rows): how often each of the joined reasons occurs; null counts as ``missing``."""
    return rows.select(F.explode(F.split(F.coalesce(reasons, F.lit("missing")), sep)).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def factors(names: Sequence[str]) -> tuple[Column, Column]:
    """The factors as a map and as JSON."""
    return F.create_map(*(x for n in names for x in (F.lit(n), F.col(n)))), F.to_json(F.struct(*names))


def page(rows: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page of 1 to 5000 ordered rows."""
    if not 1 <= limit <= 5000:
        raise ValueError("limit must be from 1 to 5000")
    return rows.orderBy(*order).offset(offset).limit(limit)


def priority_list(requirements: DataFrame, limit: int = 6) -> DataFrame:
    """The requirements of high risk that are not adequate yet, those least covered first."""
    return requirements.where("risk = 'HIGH' and status <> 'ADEQUATE'").orderBy("rvc_percent", "requirement_id").limit(limit)


def gap_list(gaps: DataFrame, limit: int = 8) -> DataFrame:
    """The gravest gaps, one of each requirement and type."""
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).when(F.col("severity") == "LOW", 2).otherwise(9)
    first = gaps.groupBy("requirement_id", "gap_type").agg(F.min(F.struct(rank.alias("rank"), "rvu_id", "severity")).alias("g"))
    return first.select("requirement_id", "gap_type", "g.rank", "g.rvu_id", "g.severity").orderBy("rank", "requirement_id", "gap_type").limit(limit).drop("rank")


def recommendations(explained: DataFrame, rules: DataFrame, key: Sequence[str], limit: int = 5, high: float = 0.1) -> DataFrame:
    """For each key, the ``limit`` features that push its score up most and have a rule (feature, title, action)."""
    rows = explained.where("shap_value > 0").join(rules, "feature")
    order = Window.partitionBy(*key).orderBy(F.desc("shap_value"), "feature")
    ranked = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return ranked.withColumn("priority", F.when(F.col("shap_value") >= high, "High").otherwise("Medium"))


def spot_check(rows: DataFrame, group: str, id_col: str, sparse: Column, limit: int = 100, seed: str = "spot") -> DataFrame:
    """A sample for reading: the first row of each group in hash order, the second and third of sparse groups, then
    second rows of the others, up to ``limit``."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")).cast("binary"))
    ranked = rows.withColumn("h", h).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("h", id_col)))
    tier = F.when(F.col("place") == 1, 0).when(sparse & F.col("place").isin(2, 3), 1).when(~sparse & (F.col("place") == 2), 2)
    return ranked.withColumn("tier", tier).where("tier is not null").orderBy("tier", "h", id_col).limit(limit).drop("h", "place")


def review_bands(pairs: DataFrame, top: int = 25, band: tuple[float, float] = (0.8, 0.9), sample: int = 25, seed: str = "review_band") -> DataFrame:
    """Pairs (a, b, cosine) to read: the closest ones, and a hash sample of a band of similarity below."""
    named = pairs.withColumn("pid", F.concat_ws("|", "a", "b"))
    first = named.orderBy(F.desc("cosine"), "pid").limit(top).withColumn("selection", F.lit("top"))
    inside = named.where((F.col("cosine") >= band[0]) & (F.col("cosine") < band[1])).join(first.select("pid"), "pid", "left_anti")
    second = inside.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "pid").cast("binary"))).limit(sample).withColumn("selection", F.lit("band"))
    return first.unionByName(second)


UNRELATED = "The quarterly catering invoice was filed in the archive."


def mutations(text: Column) -> Mapping[str, Column]:
    """Texts whose meaning is changed, by the name of the change; ``cosmetic_control`` leaves the meaning alone."""
    negated = F.replace(F.replace(F.regexp_replace(text, r"\bshall\b(?! not)", "shall not"), F.lit("=="), F.lit("!=")), F.lit("True"), F.lit("False"))
    return {
        "unrelated_replacement": F.lit(UNRELATED),
        "negate_behavior": negated,
        "change_numbers": F.regexp_replace(F.regexp_replace(text, r"(\d+)", "$107"), r"\b0+(?=\d)", ""),
        "strip_to_first_sentence": F.element_at(F.split(F.trim(text), r"(?<=[.!?])\s|\n", 2), 1),
        "cosmetic_control": F.concat(text, F.lit("\n(Reformatted; no functional change.)")),
    }


def decay_accuracy(outcomes: DataFrame, control: str = "cosmetic_control") -> DataFrame:
    """(injected, detected, decay_detection_accuracy, false_decay_rate) of outcomes (mutation, decayed)."""
    breaking, decayed = F.col("mutation") != control, F.col("decayed").cast("int")
    sums = outcomes.agg(*(F.coalesce(F.sum(F.when(c, v)), F.lit(0)).alias(n) for n, c, v in (("injected", breaking, F.lit(1)), ("detected", breaking, decayed), ("controls", ~breaking, F.lit(1)), ("false", ~breaking, decayed))))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.select("injected", "detected", rate("detected", "injected").alias("decay_detection_accuracy"), rate("false", "controls").alias("false_decay_rate"))


def artifacts(nodes: DataFrame, labels: Sequence[str] = (), project: str | None = None) -> DataFrame:
    """Nodes (id, label, project, ...) of the given labels and project; no label or project asks for all."""
    rows = nodes.where(F.col("label").isin(*labels)) if labels else nodes
    return optional(rows, project=project)


def traces(edges: DataFrame, status: str | None = None, project: str | None = None) -> DataFrame:
    return optional(edges, status=status, project=project)


def projects(nodes: DataFrame) -> DataFrame:
    """(project, artifacts) of all nodes that have a project."""
    return nodes.where("project is not null").groupBy("project").agg(F.count("*").alias("artifacts"))


def subgraph(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges that touch a node of ``keep`` (id), and the nodes at their ends."""
    touched = edges.join(keep.select(F.col("id").alias("source_id")), "source_id", "left_semi").unionByName(edges.join(keep.select(F.col("id").alias("target_id")), "target_id", "left_semi")).distinct()
    ends = touched.select(F.col("source_id").alias("id")).unionByName(touched.select(F.col("target_id").alias("id"))).unionByName(keep.select("id")).distinct()
    return nodes.join(ends, "id", "left_semi"), touched
