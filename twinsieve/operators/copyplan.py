"""Copy plan for the selected (``copied``) targets: J7 collision join, W2 first free
numeric suffix, P3/P12 path building.

For every selected file, its destination is ``out/<rel_path>``:

* nothing there -> ``write``;
* same size and same content hash there -> ``already_present`` (nothing to do);
* something else there -> ``rename`` to ``<stem>_<k><suffix>`` in the same
  directory with the smallest k >= 1 that is not occupied; occupied names are
  the existing tree plus every planned destination of this run, so the plan is
  deterministic (no race between writers).  There is no upper limit on k.

The smallest free k is found without collecting any list: candidates are 1 and
every taken k + 1, minus the taken set (anti-join), then ``min``.  All steps
are equi-joins or aggregations keyed by (dir, stem, suffix), so a directory
holding a third of all files is still spread over many keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_hash
from ..functions.paths import name_of, parent_of, stem_of, suffix_of
from ..session import materialise

KEY = ["dir", "stem", "suffix"]
COUNTER_PATTERN = r"^(.*)_([1-9][0-9]*)$"
# The first free number is at most the number of occupied names + 1, so numbers that do
# not fit a bigint can never be it and need not be read.
MAX_COUNTER_DIGITS = 18


def _join_dir(d, name):
    return F.when(d == "", name).otherwise(F.concat(d, F.lit("/"), name))


def _taken_numbers(occupied: DataFrame, groups: DataFrame) -> DataFrame:
    """(dir, stem, suffix, k) for every occupied name of the form ``<stem>_<k><suffix>``
    whose (dir, stem, suffix) is in ``groups``.

    A name is read both with its own suffix and with an empty suffix, which
    covers original names with and without a suffix.  Names are filtered by
    the counter pattern and semi-joined to the rename groups *before* the
    distinct, so only counter-named files of groups that need a rename are
    shuffled - not every name of the output tree.
    """
    o = occupied.select(parent_of("rel_path").alias("dir"), name_of("rel_path").alias("nm"))
    with_sfx = o.select(
        "dir",
        F.regexp_extract(stem_of("nm"), COUNTER_PATTERN, 1).alias("stem"),
        F.regexp_extract(stem_of("nm"), COUNTER_PATTERN, 2).alias("k"),
        suffix_of("nm").alias("suffix"),
    )
    no_sfx = o.select(
        "dir",
        F.regexp_extract("nm", COUNTER_PATTERN, 1).alias("stem"),
        F.regexp_extract("nm", COUNTER_PATTERN, 2).alias("k"),
        F.lit("").alias("suffix"),
    )
    both = with_sfx.unionByName(no_sfx).filter((F.col("k") != "") & (F.length("k") <= MAX_COUNTER_DIGITS))
    return both.select(*KEY, F.col("k").try_cast("bigint").alias("k")).join(groups, KEY, "left_semi").distinct()


def selection(matched: DataFrame) -> DataFrame:
    """The targets to copy (readable, no exact and no perceptual match), as narrow
    rows (path, rel_path, size, content_hash; the hash is NULL where it is not known yet)."""
    keep = F.col("exact_path").isNull() & F.col("near_path").isNull()
    if "error" in matched.columns:
        keep = keep & F.col("error").isNull()
    known = [F.col(c) for c in ("content_hash", "full_hash") if c in matched.columns]
    h = F.coalesce(*known) if known else F.lit(None).cast("string")
    return matched.filter(keep).select("path", "rel_path", "size", h.alias("content_hash"))


def copy_plan(
    selected: DataFrame,
    existing: DataFrame,
    algo: str = "sha256",
    hash_sources: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """(src, planned_dst, final_dst, op) for every selected target.

    ``selected``: path, rel_path, size, and content (or content_hash).  ``existing``:
    rel_path, size, content_hash of the destination tree before the run, hashed
    with the same algorithm; an entry of unknown size (a link, a directory) is
    occupied and never equal.  ``hash_sources(frame, gate)`` hashes source files by
    path: it is asked only where a same-size destination exists and the source's
    hash is not known, so no comparison ever meets a NULL.
    """
    ex = existing.select(
        F.col("rel_path").alias("planned_dst"), F.lit(True).alias("there"), F.col("size").alias("ex_size"), F.col("content_hash").alias("ex_hash")
    )
    sel = selected.select(
        F.col("path").alias("src"),
        F.col("rel_path").alias("planned_dst"),
        "size",
        *(["content"] if "content" in selected.columns else []),
        *(["content_hash"] if "content_hash" in selected.columns else []),
    )
    j = sel.join(ex, "planned_dst", "left").withColumn("same_size", F.coalesce(F.col("ex_size") == F.col("size"), F.lit(False)))
    if "content_hash" not in j.columns:
        j = j.withColumn("content_hash", F.when(F.col("same_size"), content_hash("content", algo)))
    elif "content" in j.columns:
        j = j.withColumn("content_hash", F.coalesce("content_hash", F.when(F.col("same_size"), content_hash("content", algo))))
    elif hash_sources is not None:
        j = j.withColumnRenamed("content_hash", "known").withColumnRenamed("src", "path")
        j = hash_sources(j.withColumn("ask", F.col("same_size") & F.col("known").isNull()), "ask")
        j = j.withColumn("content_hash", F.coalesce("known", "content_hash")).withColumnRenamed("path", "src")
    equal = F.col("same_size") & F.coalesce(F.col("content_hash") == F.col("ex_hash"), F.lit(False))
    op = F.when(F.col("there").isNull(), "write").when(equal, "already_present").otherwise("rename")
    planned = j.select("src", "planned_dst", op.alias("op"))
    if hash_sources is not None:
        planned = materialise(planned, "planned")  # narrow rows; no source file is read twice

    renames = planned.filter(F.col("op") == "rename").select(
        "src",
        "planned_dst",
        parent_of("planned_dst").alias("dir"),
        stem_of(name_of("planned_dst")).alias("stem"),
        suffix_of(name_of("planned_dst")).alias("suffix"),
    )
    occupied = existing.select("rel_path").unionByName(sel.select(F.col("planned_dst").alias("rel_path")))
    groups = renames.select(*KEY).distinct()
    taken = _taken_numbers(occupied, groups)
    cands = groups.withColumn("k", F.lit(1).cast("bigint")).unionByName(taken.select(*KEY, (F.col("k") + 1).alias("k")))
    # Shuffled: the estimate of the taken numbers is that of the packed tables their names were read from.
    first_free = cands.join(taken.hint("merge"), KEY + ["k"], "left_anti").groupBy(*KEY).agg(F.min("k").alias("k"))
    renamed = renames.join(first_free, KEY).select(
        "src",
        "planned_dst",
        _join_dir(F.col("dir"), F.concat(F.col("stem"), F.lit("_"), F.col("k").cast("string"), F.col("suffix"))).alias("final_dst"),
        F.lit("rename").alias("op"),
    )
    kept = planned.filter(F.col("op") != "rename").select(
        "src", "planned_dst", F.col("planned_dst").alias("final_dst"), "op"
    )
    return kept.unionByName(renamed)
