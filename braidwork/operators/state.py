"""Relational state: sessions, chats, jobs, prompt versions. Writers return the new table; readers are plain queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.text import prompt_valid
from braidwork.sources.shared import written

# Job states and limits.
TERMINAL = ("completed", "failed", "cancelled")
KEEP_JOBS, HISTORY, HISTORY_CHARS, TITLE = 500, 6, 500, 42
#: Rows of a task's share of a join by id, about.
ROWS = 1 << 19


def session_users(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Users of sessions that have not run out."""
    return sessions.filter(F.col("expires_at") > now).join(users, sessions.user_id == users.id).select("token_hash", users.id.alias("user_id"), "username")


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.filter(F.col("expires_at") > now)


def merged(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Keyed merge: the newest change of a key wins over its row, value by value where the change has one."""
    names = [c for c in table.columns if c != key]
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in names if c in changes.columns]), order).alias("_new"))
    both = table.join(newest, key, "full_outer")
    return both.select(key, *[(F.coalesce(F.col(f"_new.{c}"), F.col(c)) if c in changes.columns else F.col(c)).alias(c) for c in names])


def newest(rows: DataFrame, by: str, order: str, k: int, tie: str) -> DataFrame:
    """The k newest rows of each `by`."""
    w = Window.partitionBy(by).orderBy(F.desc(order), F.desc(tie))
    return rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def pruned_jobs(jobs: DataFrame, keep: int = KEEP_JOBS) -> DataFrame:
    """Jobs without the oldest finished ones beyond `keep` in all; unfinished jobs always stay.

    The cut is a position among finished jobs only: the newest of them fill what unfinished ones leave.
    """
    done = jobs.filter(F.col("status").isin(*TERMINAL))
    room = jobs.agg(F.greatest(F.lit(0), F.lit(keep) - F.count_if(~F.col("status").isin(*TERMINAL))).alias("room"))
    cut = done.select("created_at", "id").orderBy(F.desc("created_at"), F.desc("id")).limit(keep)
    kept = cut.withColumn("n", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id")))).crossJoin(F.broadcast(room)).filter("n <= room")
    return jobs.filter(~F.col("status").isin(*TERMINAL)).unionByName(done.join(kept.select("id"), "id", "left_semi"))


def next_status(status: Column, request: Column) -> Column:
    """What a request makes of a job: cancel stops unfinished ones, retry queues failed and cancelled ones; else nothing changes."""
    return F.when((request == "cancel") & status.isin("pending", "running"), "cancelled").when((request == "retry") & status.isin("failed", "cancelled"), "pending").otherwise(status)


def rollback_target(activations: DataFrame) -> DataFrame:
    """For every prompt the version its last change came from."""
    return activations.filter("from_hash IS NOT NULL").groupBy("name").agg(F.max_by("from_hash", "id").alias("target"))


def prompt_list(versions: DataFrame, active: DataFrame) -> DataFrame:
    return versions.join(active.select("name", "hash", F.lit(True).alias("_on")), ["name", "hash"], "left").withColumn("active", F.coalesce("_on", F.lit(False))).drop("_on")


def registered(versions: DataFrame, prompts: DataFrame) -> DataFrame:
    """versions with prompts (name, prompt) that are not in yet, by hash."""
    fresh = prompts.withColumn("hash", F.sha2("prompt", 256)).dropDuplicates(["name", "hash"])
    return versions.unionByName(fresh.join(versions, ["name", "hash"], "left_anti").select(*versions.columns))


def by_prefix(versions: DataFrame, name: str, prefix: str) -> DataFrame:
    """The one version whose hash starts with prefix: no row if there is none or more than one; matches tells which."""
    hits = versions.filter((F.col("name") == name) & F.col("hash").startswith(prefix))
    return hits.agg(F.count("*").alias("matches"), F.min("hash").alias("hash")).withColumn("hash", F.when(F.col("matches") == 1, F.col("hash")))


def recent_turns(messages: DataFrame, k: int = HISTORY, chars: int = HISTORY_CHARS) -> DataFrame:
    """The last k messages of each conversation, each cut to `chars`."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= k).withColumn("text", F.substring("text", 1, chars))


def follow_ups(messages: DataFrame) -> DataFrame:
    """User turns with the turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return messages.withColumn("previous", F.lag("text").over(w)).filter((F.col("role") == "user") & F.col("previous").isNotNull())


def chat_with_messages(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per chat with its messages in order."""
    held = messages.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("id", "role", "text"))).alias("messages"))
    return chats.join(held, chats.id == held.chat_id, "left").drop("chat_id")


def titled(title: Column, question: Column, default: str = "New chat") -> Column:
    """A chat gets its first question's start as title, once."""
    return F.when(title == default, F.substring(question, 1, TITLE)).otherwise(title)


def without_user(table: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    return table.join(users.select(F.col("id").alias(key)), key, "left_anti")


def added_files(files: Column, more: Column) -> Column:
    return F.array_union(files, more)


def ingest_note(names: Column, indexed: Column, failed: Column, total: Column, done: Column, status: Column, most: int = 20) -> Column:
    """The note an ingest leaves in its chat."""
    listed = F.array_join(F.array_sort(F.transform(names, lambda n: F.regexp_replace(n, "^[0-9a-f]{32}_", ""))), ", ")
    added = F.when(indexed > most, F.concat(indexed.cast("string"), F.lit(" documents"))).otherwise(listed)
    parts = F.array(
        F.when(indexed > 0, F.concat(F.lit("Added "), added, F.lit(" to this chat."))),
        F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" could not be indexed."))),
        F.when(status == "cancelled", F.concat(F.lit("Indexing was cancelled after "), done.cast("string"), F.lit(" files."))).when(status == "failed", F.concat(F.lit("Indexing stopped with an error after "), done.cast("string"), F.lit(" files."))),
    )
    return F.array_join(parts, " ")


def activated(active: DataFrame, changes: DataFrame, events: DataFrame, at: Column, actor: str) -> tuple[DataFrame, DataFrame]:
    """The active versions (name, hash) after changes (name, hash), and the activation log with one more row per real change."""
    old = active.select("name", F.col("hash").alias("from_hash"))
    real = changes.select("name", F.col("hash").alias("to_hash")).join(old, "name", "left").filter(F.col("from_hash").isNull() | (F.col("from_hash") != F.col("to_hash")))
    kept = active.select("name", "hash").join(real.select("name"), "name", "left_anti")
    logged = real.select("name", "from_hash", "to_hash", at.alias("at"), F.lit(actor).alias("actor"))
    return kept.unionByName(real.select("name", F.col("to_hash").alias("hash"))), events.select(*logged.columns).unionByName(logged)


#: Names of prompts.
NAME = "^[a-z][a-z0-9._-]*$"


def register(versions: DataFrame, active: DataFrame, events: DataFrame, prompts: DataFrame, now: Column, actor: str = "application") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables versions (name, hash, prompt, required_fields, created_at, created_by), active (name, hash) and events (name, from_hash, to_hash, action, actor, at) after prompts (name, prompt, required_fields) are registered.

    A version that is in stays as it is. The first version of a name becomes active, and that is logged. A name that is
    no name, or a prompt that does not name exactly its fields, fails the job.
    """
    good = F.col("name").rlike(NAME) & prompt_valid(F.col("prompt"), F.col("required_fields"))
    checked = prompts.withColumn("_ok", F.assert_true(F.coalesce(good, F.lit(False)), F.concat(F.lit("not a valid prompt: "), F.coalesce("name", F.lit("null"))))).filter("_ok IS NULL").drop("_ok")
    rows = checked.select("name", F.sha2("prompt", 256).alias("hash"), "prompt", F.array_sort("required_fields").alias("required_fields"), now.alias("created_at"), F.lit(actor).alias("created_by")).dropDuplicates(["name", "hash"])
    all_versions = versions.unionByName(rows.join(versions, ["name", "hash"], "left_anti"))
    first = rows.groupBy("name").agg(F.min("hash").alias("hash")).join(active.select("name"), "name", "left_anti")
    logged = first.select("name", F.lit(None).cast("string").alias("from_hash"), F.col("hash").alias("to_hash"), F.lit("initialize").alias("action"), F.lit(actor).alias("actor"), now.alias("at"))
    return all_versions, active.select("name", "hash").unionByName(first), events.unionByName(logged)


def created_chats(chats: DataFrame, fresh: DataFrame, now: Column, title: str = "New chat") -> DataFrame:
    """chats with new ones (id, user_id); ids that are there stay as they are."""
    rows = fresh.join(chats.select("id"), "id", "left_anti").select("id", "user_id", F.lit(title).alias("title"), now.alias("created_at"), now.alias("updated_at"))
    return chats.unionByName(rows, allowMissingColumns=True)


def deleted_chats(chats: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chats and messages without the chats (id, user_id) that their own users delete."""
    own = written(_met(chats, gone.select("id", "user_id"), ["id", "user_id"], "left_semi").select("id"), "deleted")
    return _met(chats, own, ["id"], "left_anti"), _met(messages, own.withColumnRenamed("id", "chat_id"), ["chat_id"], "left_anti")


def _met(rows: DataFrame, others: DataFrame, on: list[str], how: str) -> DataFrame:
    """A semi or anti join in as many parts as the counted rows need: a task holds its part of the others and sorts nothing, so its memory does not grow with the tables, or with the rows of one key."""
    parts = -(-max(rows.count(), others.count()) // ROWS)
    if parts <= 1:
        return rows.join(others, on, how)
    return rows.repartition(parts, *on).join(others.repartition(parts, *on).distinct().hint("shuffle_hash"), on, how)


def own_chats(chats: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (id, user_id) with exists: whether the chat is there and the user's."""
    known = chats.select("id", "user_id", F.lit(True).alias("_there")).distinct()
    return asked.join(known, ["id", "user_id"], "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there")


def resolved(shipped: DataFrame, versions: DataFrame, active: DataFrame) -> DataFrame:
    """The active text of every shipped prompt (name, prompt); the shipped one where none is active."""
    now = active.select("name", "hash").join(versions.select("name", "hash", F.col("prompt").alias("_active")), ["name", "hash"])
    return shipped.join(now.select("name", "_active"), "name", "left").select("name", F.coalesce("_active", "prompt").alias("prompt"))


def password_changed(users: DataFrame, sessions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users with new password hashes (id, password_hash) and no lock, and the sessions of all others."""
    new = changes.select("id", F.col("password_hash").alias("_new"))
    out = users.join(new, "id", "left")
    for c, cleared in (("failed_logins", 0), ("locked_until", None)):
        if c in users.columns:
            out = out.withColumn(c, F.when(F.col("_new").isNotNull(), F.lit(cleared)).otherwise(F.col(c)))
    out = out.withColumn("password_hash", F.coalesce("_new", "password_hash")).drop("_new")
    return out, without_user(sessions, changes)


def standalone(question: Column, rewritten: Column, most: int | Column = 2000) -> Column:
    """A follow-up as a question of its own; the typed one where the rewrite is empty or too long."""
    return F.when(F.length(F.trim(F.coalesce(rewritten, F.lit("")))).between(F.lit(1), F.lit(most)), F.trim(rewritten)).otherwise(question)
