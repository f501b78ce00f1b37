"""Reviews, comment threads, permissions, templates and versions as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.sources import shared

#: The levels of permission, and what they allow.
LEVELS = {"owner": 3, "write": 2, "read": 1, "none": 0}
#: The states of a review.
STATES = ["pending", "approved", "rejected", "needs_changes"]


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The newest review of each example of a dataset; of several at one time the first entered (the least
    review_id). Reduced before the shuffle."""
    at = F.struct(F.col("created_at"), -F.col("review_id"))
    return reviews.groupBy("dataset_id", "example_id").agg(F.max_by(F.struct(*[c for c in reviews.columns if c not in ("dataset_id", "example_id")]), at).alias("r")).select("dataset_id", "example_id", "r.*")


def approved(reviews: DataFrame) -> DataFrame:
    """Examples whose newest review approves."""
    return latest_reviews(reviews).where("status = 'approved'").select("dataset_id", "example_id")


def review_summary(reviews: DataFrame) -> DataFrame:
    """One row a dataset: reviews, examples with one, and examples by the state of their newest review."""
    each = latest_reviews(reviews).groupBy("dataset_id").agg(F.count("*").alias("n_examples"), *(F.count_if(F.col("status") == s).alias(s) for s in STATES))
    return reviews.groupBy("dataset_id").agg(F.count("*").alias("n_reviews")).join(each, "dataset_id")


def most_active(rows: DataFrame, group: str, who: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent of each group, with their rank; ties to the smaller."""
    counts = rows.groupBy(group, who).agg(F.count("*").alias("n"))
    place = Window.partitionBy(group).orderBy(F.desc("n"), who)
    return counts.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def threads(comments: DataFrame) -> DataFrame:
    """comment_id, root (the comment without a parent that it descends from) and depth. Comments whose
    parent is missing are roots; those in a circle have none and are left out. Pointers double each
    round, so rounds follow the logarithm of the depth."""
    known = comments.select(F.col("comment_id").alias("parent_id"), F.lit(1).alias("there"))
    whole = comments.select("comment_id", "parent_id")
    own = whole.where("parent_id IS NOT NULL").join(known, "parent_id", "left").select("comment_id", F.when(F.col("there") == 1, F.col("parent_id")).alias("up"))
    own = own.unionByName(whole.where("parent_id IS NULL").select("comment_id", F.col("parent_id").alias("up")))
    now = shared.cut(own.select("comment_id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.when(F.col("up").isNull(), F.col("comment_id")).alias("root")))
    done, now, last = [now.where("root IS NOT NULL")], now.where("root IS NULL"), None
    # those with a root stay where they were written: without an ``up`` they would all meet in one task
    while (left := now.count()) and left != last:
        last = left
        above = reduce(DataFrame.unionByName, done, now).select(F.col("comment_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("root").alias("root2"))
        turned = shared.cut(now.join(above, "up").select("comment_id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("root2").alias("root")))
        done, now = [*done, turned.where("root IS NOT NULL")], turned.where("root IS NULL")
    return reduce(DataFrame.unionByName, done).select("comment_id", "root", "depth")


def descendants(comments: DataFrame, of: DataFrame) -> DataFrame:
    """comment_id of the given comments that exist and of all replies to them, however deep."""
    found = shared.cut(comments.join(of.select("comment_id").distinct(), "comment_id", "left_semi").select("comment_id"))
    new = found
    while not new.isEmpty():
        replies = comments.join(new.select(F.col("comment_id").alias("parent_id")), "parent_id", "left_semi").select("comment_id")
        new = shared.cut(replies.join(found, "comment_id", "left_anti"))
        found = shared.cut(found.unionByName(new))
    return found


def without_threads(comments: DataFrame, of: DataFrame) -> DataFrame:
    """The comments that stay when the given ones go with all replies to them."""
    return comments.join(descendants(comments, of), "comment_id", "left_anti")


def comment_totals(comments: DataFrame) -> DataFrame:
    """One row: comments, resolved and not, without a parent and with one."""
    n, done, reply = F.count("*"), F.count_if("resolved"), F.count_if(F.col("parent_id").isNotNull())
    return comments.agg(n.alias("total"), done.alias("resolved"), (n - done).alias("unresolved"), (n - reply).alias("roots"), reply.alias("replies"))


def level(name: Column) -> Column:
    """The rank of a permission level; 0 for unknown ones."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair)), name), F.lit(0))


def allowed(permissions: DataFrame, required: str) -> DataFrame:
    """dataset_id and user_id whose permission is ``required`` or higher."""
    return permissions.where(level(F.col("permission_level")) >= LEVELS[required]).select("dataset_id", "user_id")


def permission_totals(permissions: DataFrame) -> DataFrame:
    """One row: permissions, by level, and how many datasets and users they are of."""
    each = [F.count_if(F.col("permission_level") == name).alias(f"n_{name}") for name in LEVELS]
    return permissions.agg(F.count("*").alias("total"), *each, F.count_distinct("dataset_id").alias("n_datasets"), F.count_distinct("user_id").alias("n_users"))


def with_tags(templates: DataFrame, tags: list[str]) -> DataFrame:
    """Templates that have all the tags."""
    return templates.where(F.forall(F.array(*map(F.lit, tags)), lambda t: F.array_contains("tags", t)))


def matching(templates: DataFrame, query: str) -> DataFrame:
    """Templates with the query in name, description or a tag, whatever its case."""
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(query.lower())
    return templates.where(has(F.col("name")) | has(F.col("description")) | F.coalesce(F.exists("tags", has), F.lit(False)))


def subscribed(hooks: DataFrame, event: str) -> DataFrame:
    """Hooks that listen to the event, or to all."""
    return hooks.where(F.arrays_overlap("events", F.array(F.lit(event), F.lit("all"))))


def version_totals(versions: DataFrame) -> DataFrame:
    """One row a dataset: versions, rows in the first and the latest, rows added by those that grew, the next
    number and whether the latest has the content of the first."""
    by_number = Window.partitionBy("dataset_id").orderBy("version_number")
    grown = versions.withColumn("added", F.greatest(F.col("examples_count") - F.lag("examples_count").over(by_number), F.lit(0)))
    return grown.groupBy("dataset_id").agg(
        F.count("*").alias("n_versions"), F.min_by("examples_count", "version_number").alias("first_count"), F.max_by("examples_count", "version_number").alias("latest_count"),
        F.coalesce(F.sum("added"), F.lit(0)).alias("total_added"), (F.max("version_number") + 1).alias("next_number"),
        (F.min_by("examples_hash", "version_number") == F.max_by("examples_hash", "version_number")).alias("same_content"),
    )


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a hash of a table's content that does not depend on the rows' order."""
    each = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.md5(F.coalesce(F.sum(each), F.lit(0)).cast("string").cast("binary")).alias("hash"), F.count("*").alias("n"))


def version_history(versions: DataFrame) -> DataFrame:
    """Each version beside the one before it of its dataset: examples_count_diff and is_same_content, null for the first."""
    by_number = Window.partitionBy("dataset_id").orderBy("version_number")
    before = lambda c: F.lag(c).over(by_number)
    return versions.select("dataset_id", "version_number", "examples_count", (F.col("examples_count") - before("examples_count")).alias("examples_count_diff"), (F.col("examples_hash") == before("examples_hash")).alias("is_same_content"))


def versions_compared(one: DataFrame, two: DataFrame) -> DataFrame:
    """dataset_id, examples_count_diff and is_same_content of a version of each dataset in both tables."""
    both = one.alias("a").join(two.alias("b"), "dataset_id")
    return both.select("dataset_id", (F.col("b.examples_count") - F.col("a.examples_count")).alias("examples_count_diff"), (F.col("a.examples_hash") == F.col("b.examples_hash")).alias("is_same_content"))
