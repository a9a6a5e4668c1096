"""Retry policies: backoff bounds, presets, and the first policy that matches an error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.sources.shared import saved


@dataclass(frozen=True)
class Policy:
    """Attempts (none: without bound), seconds of the first delay, longest delay, and classes that are retried (none: all)."""

    name: str
    attempts: int | None
    base: float
    cap: float
    classes: tuple[str, ...] | None = None

    @property
    def budget_key(self) -> str:
        """What a policy's attempts are counted under: its classes, whatever their order, or a star."""
        return "*" if self.classes is None else ",".join(sorted(self.classes))

    def matches(self, error_class: Column) -> Column:
        return F.lit(True) if self.classes is None else F.coalesce(error_class.isin(*self.classes), F.lit(False))

    def delay(self, attempt: Column) -> Column:
        return F.least(F.lit(float(self.cap)), F.lit(float(self.base)) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))))

    def retries(self, attempt: Column) -> Column:
        return F.lit(True) if self.attempts is None else attempt < self.attempts


#: Defaults of steps, workflows and waits (fixed values).
STEP, WORKFLOW, WAIT = Policy("step", 3, 1, 30), Policy("workflow", 10, 1, 600), Policy("wait", None, 1, 30, ())
#: Policies in order, for an example of routing.
POLICIES = (Policy("flaky", 5, 1, 30, ("Err1", "Err0")), Policy("strict", 1, 1, 30, ("Err2",)), Policy("any", 3, 1, 30))


def resolve(call: Policy | None = None, own: Policy | None = None, wait: bool = False) -> Policy:
    """The policy that holds: the call's, else the workflow class's (waits skip it), else the default."""
    return call or (WAIT if wait else own or STEP)


def most_attempts(policies: tuple[Policy, ...]) -> int | None:
    """The loosest bound of several policies; none if one of them has none."""
    bounds = [p.attempts for p in policies]
    return None if None in bounds else max(bounds)


def backoff_bounds(errors: DataFrame, policy: Policy = STEP) -> DataFrame:
    """Least and most seconds before the next try with equal jitter, and whether there is one."""
    attempt = F.col("attempt")
    delay = policy.delay(attempt)
    return errors.select("id", F.lit(policy.name).alias("policy"), "attempt", (delay / 2).alias("backoff_min"), delay.alias("backoff_max"), (policy.retries(attempt) & policy.matches(F.col("error_class"))).alias("retries"))


def _budgeted(errors: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """Errors with their ``policy`` and ``budget_key``: the error's number within the workflow's budget, and the bounds of the delay if it is retried."""
    used = F.row_number().over(Window.partitionBy("workflow_id", "budget_key").orderBy("created_at", "id"))
    d = errors.withColumn("used", used)
    of = lambda value: F.coalesce(*(F.when(F.col("policy") == p.name, value(p)) for p in policies))
    retries = F.coalesce(of(lambda p: p.retries(F.col("used"))), F.lit(False))
    most = F.when(retries, of(lambda p: p.delay(F.col("used"))))
    return d.select("id", "policy", "budget_key", F.when(F.col("policy").isNotNull(), F.col("used")).alias("used"), retries.alias("retries"), (most / 2).alias("backoff_min"), most.alias("backoff_max"))


def routed(errors: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The first policy that matches an error, the error's number within the workflow's budget for it, and the bounds of the delay if it is retried.

    The budget is counted by the policy's classes, so that it doesn't depend on the policies' order.
    """
    chosen = lambda value: F.coalesce(*(F.when(p.matches(F.col("error_class")), value(p)) for p in policies))
    return _budgeted(errors.withColumns({"policy": chosen(lambda p: F.lit(p.name)), "budget_key": chosen(lambda p: F.lit(p.budget_key))}), policies)


#: The class that a policy without classes retries, with all below it.
ROOT = "StandardError"


def ancestors(classes: DataFrame) -> DataFrame:
    """``class``, ``ancestor`` of all rows of ``classes`` (``class``, ``parent``), every class being its own ancestor too.

    Paths double in length from round to round, so there are as many rounds as the depth's
    logarithm.  Classes with several parents have the ancestors of all; a cycle ends, as
    a pair that is there already adds nothing.  Rows without a class or parent add none.
    """
    names = classes.select("class").unionByName(classes.select(F.col("parent").alias("class"))).where("class is not null").distinct()
    steps = classes.where("class is not null and parent is not null").select("class", F.col("parent").alias("ancestor"))
    reach, n = saved(steps.unionByName(names.select("class", F.col("class").alias("ancestor"))).distinct(), "ancestors"), -1
    while (found := reach.count()) != n:
        n = found
        further = reach.select(F.col("class").alias("ancestor"), F.col("ancestor").alias("further"))
        reach = saved(reach.join(further, "ancestor").select("class", F.col("further").alias("ancestor")).distinct(), "ancestors")
    return reach


def policy_of_class(names: DataFrame, classes: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """``error_class`` and the first of ``policies`` that has the class or one of its ancestors (``policy``, ``budget_key``); none where no policy has.

    A policy without classes takes all below ``ROOT``, and classes that ``classes`` doesn't know.
    """
    reach, known = ancestors(classes), F.col("ancestor").isNotNull()
    rules = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(p.name).alias("policy"), F.lit(p.budget_key).alias("budget_key"), F.lit(None if p.classes is None else list(p.classes)).cast("array<string>").alias("classes")) for k, p in enumerate(policies)))
    each = names.select("error_class").where("error_class is not null").distinct().join(reach, F.col("error_class") == F.col("class"), "left").select("error_class", F.coalesce("ancestor", "error_class").alias("is_a"), known.alias("known"), F.inline(rules))
    fits = F.when(F.col("classes").isNull(), ~F.col("known") | (F.col("is_a") == ROOT)).otherwise(F.array_contains("classes", F.col("is_a")))
    first = each.where(fits).groupBy("error_class").agg(F.min(F.struct("place", "policy", "budget_key")).alias("x"))
    return first.select("error_class", "x.policy", "x.budget_key")


def routed_by_class(errors: DataFrame, classes: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """``routed`` where a policy's class stands for all classes below it, by ``classes`` (``class``, ``parent``).

    Policies are looked up for each different class, not each error.  An error without a class has no policy.
    """
    found = policy_of_class(errors, classes, policies)
    return _budgeted(errors.join(found, "error_class", "left"), policies)


def loosest(policies: DataFrame) -> DataFrame:
    """Most attempts of every composite policy (rows ``composite``, ``attempts``): without bound (null) as soon as one of its policies is."""
    return policies.groupBy("composite").agg(F.when(F.bool_or(F.col("attempts").isNull()), None).otherwise(F.max("attempts")).alias("attempts"))


def resolved(calls: DataFrame, own: dict[str, Policy], given: tuple[Policy, ...] = ()) -> DataFrame:
    """The policy that holds for every step: the one of its call (``call``, a name in ``given``), else its workflow class's (``own``; waits skip it), else the default.

    ``calls`` has ``id``, ``job_class``, ``kind`` and ``call``; ``attempts`` is null without a bound.
    """
    row = lambda p: F.struct(F.lit(p.name).alias("policy"), F.lit(p.attempts).cast("int").alias("attempts"), F.lit(float(p.base)).alias("base"), F.lit(float(p.cap)).alias("cap"))
    named = lambda column, table: F.coalesce(F.lit(None).cast("struct<policy:string,attempts:int,base:double,cap:double>"), *(F.when(F.col(column) == name, row(p)) for name, p in table.items()))
    waits = F.col("kind").isin("wait", "continue")
    default = F.when(waits, row(WAIT)).otherwise(row(STEP))
    found = F.coalesce(named("call", {p.name: p for p in given}), F.when(~waits, named("job_class", own)), default)
    return calls.select("id", found.alias("x")).select("id", "x.*")
