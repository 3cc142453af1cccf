"""Applying a stream of inserts, updates and deletes in the right order.

Per-key ordered replay: changes are repartitioned by key and sorted by sequence
within the partitions; a state machine runs over each key's run of rows. Its
state is the last delete, and for each column the last change that set it; a row
whose sequence equals the one before was applied already and is skipped. The
states of parts of one key merge by taking the later register of each column, so
a hot key is replayed in salted parts, and a stream batch by batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.skew import hot_keys, is_hot

SET, DELETE = "set", "delete"
#: Parts that a hot key is split into.
SALT = 64


def _states(changes: DataFrame, key: str, by: list[str], columns: list[str]) -> DataFrame:
    """One row of registers for each group of ``by``: ``_del``, ``_set``, and ``_r_<column>`` = (seq, value)."""
    order = ["_seq", "_op", *(F.desc(c) for c in columns)]  # of changes with one sequence the first counts, whatever the order of arrival
    parts = changes.repartition(*by).sortWithinPartitions(*by, *order)
    w = Window.partitionBy(*by).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = F.coalesce(F.lag("_seq").over(w) != F.col("_seq"), F.lit(True))
    sets, deletes = F.col("_op") == SET, F.col("_op") == DELETE
    parts = parts.withColumn("_fresh", fresh).withColumn("_end", F.lead(F.lit(True)).over(w).isNull())
    state = {
        "_del": F.last(F.when(F.col("_fresh") & deletes, F.col("_seq")), True).over(so_far),
        "_set": F.last(F.when(F.col("_fresh") & sets, F.col("_seq")), True).over(so_far),
    } | {
        f"_r_{c}": F.last(F.when(F.col("_fresh") & sets & F.col(c).isNotNull(), F.struct(F.col("_seq").alias("seq"), F.col(c).alias("value"))), True).over(so_far)
        for c in columns
    }
    return parts.withColumns(state).where("_end").select(key, *state)


def merge_states(states: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Registers of parts of a key into one: the later one of each holds. Associative and idempotent."""
    return states.groupBy(key).agg(
        F.max("_del").alias("_del"), F.max("_set").alias("_set"), *(F.max(f"_r_{c}").alias(f"_r_{c}") for c in columns)
    )


def replay_states(changes: DataFrame, key: str, sequence: list[Column | str], op: Column | str, columns: list[str]) -> DataFrame:
    """Registers of each key after all its changes; see ``replay_changes`` for the arguments."""
    seq = F.struct(*(F.coalesce(c if isinstance(c, Column) else F.col(c)).alias(f"s{i}") for i, c in enumerate(sequence)))
    own = changes.select(
        F.col(key).cast("string").alias(key), seq.alias("_seq"), (op if isinstance(op, Column) else F.col(op)).alias("_op"), *columns
    ).where(F.col(key).isNotNull() & F.col("_op").isin(SET, DELETE))
    hot = hot_keys(own, key)
    cold = _states(own.where(~is_hot(key, hot)) if hot else own, key, [key], columns)
    if not hot:
        return cold
    salted = own.where(is_hot(key, hot)).withColumn("_salt", F.pmod(F.xxhash64("_seq"), F.lit(SALT)))
    return cold.unionByName(merge_states(_states(salted, key, [key, "_salt"], columns), key, columns))


def current_rows(states: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows that exist: keys set after their last delete, with the columns set since then."""
    after = lambda c: F.coalesce(F.col(c) > F.col("_del"), F.col(c).isNotNull())
    return states.where(F.coalesce(after("_set"), F.lit(False))).select(
        key, *(F.when(after(f"_r_{c}.seq"), F.col(f"_r_{c}.value")).alias(c) for c in columns)
    )


def replay_changes(changes: DataFrame, key: str, sequence: list[Column | str], op: Column | str, columns: list[str]) -> DataFrame:
    """The current rows of a table, from its change feed in any order and with repetitions.

    ``sequence`` orders a key's changes (strings by bytes, nulls first); two
    changes of a key with one sequence are one change: a delete before a set, then the
    set with the largest values. Values are of types that can be ordered. ``op`` is ``set`` (insert or partial update: a null column is
    left as it was) or ``delete`` (removes the row and all its columns). Rows
    with a null key or another ``op`` are no changes. An empty feed gives an
    empty table. Only the named columns are read, so other columns of the feed
    may have any name.
    """
    return current_rows(replay_states(changes, key, sequence, op, columns), key, columns)


def fact_changes(tx: DataFrame) -> DataFrame:
    """Changes of settled facts in the log: (fact_key, op, wall, counter, portal, id, tx_id).

    A promote sets its key, a retract removes each of its keys. Rows without an
    id, and payloads that are no JSON of that form, hold no change.
    """
    at = lambda i: F.get("hlc", F.lit(i))
    promote = F.array(F.get_json_object("payload", "$.decision.key"))
    retract = F.from_json(F.get_json_object("payload", "$.keys"), "array<string>")
    rows = tx.where(F.col("kind").isin("promote", "retract") & F.col("id").isNotNull()).select(
        "id", "portal", at(0).alias("wall"), at(1).alias("counter"), "kind", F.when(F.col("kind") == "promote", promote).otherwise(retract).alias("keys")
    )
    return rows.select(
        F.explode("keys").alias("fact_key"), F.when(F.col("kind") == "promote", SET).otherwise(DELETE).alias("op"),
        "wall", "counter", "portal", "id", F.col("id").alias("tx_id"),
    ).where(F.col("fact_key").isNotNull())


def settled_keys(tx: DataFrame) -> DataFrame:
    """Fact keys that are settled now, each with the promote that set its present version."""
    return replay_changes(fact_changes(tx), "fact_key", ["wall", "counter", "portal", "id"], "op", ["tx_id"])


def settled_decisions(tx: DataFrame) -> DataFrame:
    """(fact_key, tx_id, support, rule): settled keys with what the promotes since their last retraction say, column by column.

    A promote that leaves support or rule out changes only the columns it has.
    """
    said = tx.where("kind = 'promote' and id is not null").select(F.col("id").alias("tx_id"), F.get_json_object("payload", "$.decision.support").cast("bigint").alias("support"), F.get_json_object("payload", "$.decision.rule").alias("rule"))
    changes = fact_changes(tx).join(said.distinct(), "tx_id", "left")
    return replay_changes(changes, "fact_key", ["wall", "counter", "portal", "id"], "op", ["tx_id", "support", "rule"])
