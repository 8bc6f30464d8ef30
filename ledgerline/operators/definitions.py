"""Checks of definitions, migrations and requests: one ordered list of rules each, the first failing one is told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.logs import first_failing
from ledgerline.sources.tables import checkpointed

STEPS, ATTEMPTS, TRANSITIONS = 128, 64, 512
QUOTA_CAPACITY, DIAGNOSTIC_BYTES = 1_000_000, 4096


def validate_linear(definitions: DataFrame, steps: DataFrame, key: str, step: str, attempts: str, compensation_attempts: str) -> DataFrame:
    """(key, n_steps, code) of each linear definition; one aggregation, no arrays.

    ``steps`` has a row for each step; compensation attempts are null without a compensation.
    """
    seen = steps.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(step).alias("u"), F.greatest(F.max(attempts), F.max(compensation_attempts)).alias("most"))
    n = F.coalesce("n", F.lit(0))
    code = first_failing(("EmptyDefinition", n == 0), ("DefinitionStepLimitExceeded", n > STEPS), ("DuplicateStepId", F.col("u") < n), ("RetryAttemptLimitExceeded", F.col("most") > ATTEMPTS))
    return definitions.select(key).join(seen, key, "left").select(key, n.alias("n_steps"), code.alias("code"))


def validate_graph(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, key: str, depth: int = STEPS) -> DataFrame:
    """(key, code) of each graph definition: graphs (key, entry), nodes (key, step), edges (key, src, outcome, dst).

    Reachable steps grow by one join a level over all graphs at once, until a
    level adds none; a graph has at most 128 steps, so there are at most that
    many levels. Only counts come to the driver.
    """
    n = nodes.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("step").alias("u"))
    m = edges.groupBy(key).agg(F.count("*").alias("m"))
    has = nodes.select(key, "step").distinct()
    entry = graphs.join(has.withColumnRenamed("step", "entry").withColumn("__e", F.lit(True)), [key, "entry"], "left").select(key, F.col("__e").isNotNull().alias("entry_known"))
    joined = edges.join(has.select(key, F.col("step").alias("src"), F.lit(True).alias("__s")), [key, "src"], "left").join(has.select(key, F.col("step").alias("dst"), F.lit(True).alias("__d")), [key, "dst"], "left")
    bad = joined.groupBy(key).agg(
        F.count_if(F.col("__s").isNull()).alias("no_src"), F.count_if(F.col("dst").isNotNull() & F.col("__d").isNull()).alias("no_dst"),
        F.count_if(F.col("dst").isNull() & (F.col("outcome") == "R")).alias("no_retry"), (F.count("*") - F.count_distinct("src", "outcome")).alias("twice"),
    )
    links = edges.where(F.col("dst").isNotNull()).select(key, F.col("src").alias("step"), "dst").distinct()
    seen = graphs.select(key, F.col("entry").alias("step"))
    front = seen
    for _ in range(depth):
        front = checkpointed(front.join(links, [key, "step"]).select(key, F.col("dst").alias("step")).distinct().join(seen, [key, "step"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    lost = has.join(seen, [key, "step"], "left_anti").groupBy(key).agg(F.count("*").alias("lost"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    code = first_failing(
        ("EmptySteps", zero("n") == 0), ("StepLimitExceeded", F.col("n") > STEPS), ("TransitionLimitExceeded", zero("m") > TRANSITIONS), ("DuplicateStep", F.col("u") < F.col("n")), ("UnknownEntryStep", ~F.col("entry_known")),
        ("UnknownSourceStep", zero("no_src") > 0), ("UnknownDestinationStep", zero("no_dst") > 0), ("MissingDestination", zero("no_retry") > 0), ("DuplicateTransition", zero("twice") > 0), ("UnreachableStep", zero("lost") > 0),
    )
    every = graphs.select(key)
    for part in (n, m, entry, bad, lost):
        every = every.join(part, key, "left")
    return every.select(key, code.alias("code"))


def compatibility(same_id: Column, same_version: Column, same_digest: Column, same_steps: Column) -> Column:
    """Exact, RequiresMigration (equal id and version, other content) or Incompatible."""
    return F.when(~(same_id & same_version), "Incompatible").when(~(same_digest & same_steps), "RequiresMigration").otherwise("Exact")


def migration_code(no_op: Column, source_matches: Column, destination_matches: Column) -> Column:
    """The first failing rule of a migration between two definitions, or null."""
    return first_failing(("NoOp", no_op), ("SourceMismatch", ~source_matches), ("DestinationMismatch", ~destination_matches))


def compare_pins(pins: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """(key, compatibility, exact) of each process's pinned definition against the one in force under its id.

    pins: (key, definition, version, digest, steps); definitions: (definition,
    version, digest, steps), one of each id. A pin whose id isn't there is
    Incompatible; exact tells whether a process may go on without a migration.
    """
    there = definitions.select("definition", *[F.col(c).alias(f"__{c}") for c in ("version", "digest", "steps")])
    same = lambda c: F.col(c).eqNullSafe(F.col(f"__{c}"))
    told = compatibility(F.col("__version").isNotNull(), same("version"), same("digest"), same("steps"))
    return pins.join(there, "definition", "left").select(key, told.alias("compatibility"), (told == "Exact").alias("exact"))


def validate_migrations(migrations: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """(key, code) of each migration (key, source, source_digest, destination, destination_digest) against the definitions (definition, digest)."""
    source = definitions.select(F.col("definition").alias("source"), F.col("digest").alias("__s"))
    destination = definitions.select(F.col("definition").alias("destination"), F.col("digest").alias("__d"))
    both = migrations.join(source, "source", "left").join(destination, "destination", "left")
    no_op = (F.col("source") == F.col("destination")) & (F.col("source_digest") == F.col("destination_digest"))
    code = migration_code(no_op, F.col("__s").eqNullSafe(F.col("source_digest")), F.col("__d").eqNullSafe(F.col("destination_digest")))
    return both.select(key, code.alias("code"))


def require_digest(stored: Column, derived: Column) -> Column:
    """DigestMismatch where a stored canonical digest isn't the one derived from the content, else null."""
    return F.when(~stored.eqNullSafe(derived), "DigestMismatch")


def task_definition_code(schema: Column, attempts: Column, timeout: Column, cpu: Column, deadline: Column, history: Column) -> Column:
    """InvalidDefinition if a bound that must not be zero is, or the history has fewer than 4 records; else null."""
    return F.when((F.least(schema, attempts, timeout, cpu, deadline) < 1) | (history < 4), "InvalidDefinition")


def quota_code(requested: Column, capacity: Column) -> Column:
    """The first failing rule of a quota request, or null."""
    return first_failing(("CapacityExceeded", capacity > QUOTA_CAPACITY), ("QuotaExceeded", requested > capacity))


def diagnostic_code(metadata: Column) -> Column:
    """TooLarge for diagnostic metadata over 4,096 bytes, else null."""
    return F.when(F.octet_length(metadata) > DIAGNOSTIC_BYTES, "TooLarge")
