"""Written names with errors: a deletion neighbourhood joined by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftline.functions import text as X
from liftline.operators.keyed import skew_safe_join

# Shortest alias that may have one error, and two.
ONE_ERROR, TWO_ERRORS = 4, 7


def allowed_errors(length: Column) -> Column:
    """Errors that an alias of this length may have: a short one would match anything."""
    return F.when(length >= TWO_ERRORS, 2).when(length >= ONE_ERROR, 1).otherwise(0)


def _shorter(word: Column) -> Column:
    """The word without one of its characters, for each of them."""
    places = F.when(F.length(word) > 0, F.sequence(F.lit(1), F.length(word))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def deletions(word: Column, errors: Column) -> Column:
    """The different strings left when up to ``errors`` (0 to 2) characters are deleted."""
    one = _shorter(word)
    two = F.flatten(F.transform(one, _shorter))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(word), F.when(errors >= 1, one).otherwise(none), F.when(errors >= 2, two).otherwise(none)))


def match_names(written: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """``name``, ``launch_id``, ``errors``: the nearest alias of each different written name.

    Names and aliases are compared without blanks around and case. A character too
    many, missing or wrong is an error; :func:`allowed_errors` says how many an alias may
    have. The fewest errors decide, then the least launch_id. A name near no alias has no row.

    Two words at most two errors apart share a string that at most two deletions leave
    of either, so candidates meet in an equality join on such strings, and the exact number
    of errors is counted for those only. Different names are compared, not their mentions;
    a name that is longer than the longest alias by more than two is compared with none.
    """
    known = aliases.select(F.lower(X.trim_all(F.col("alias"))).alias("alias"), "launch_id").where("alias is not null")
    known = known.groupBy("alias").agg(F.min("launch_id").alias("launch_id"))
    longest = known.agg(F.coalesce(F.max(F.length("alias")), F.lit(-3))).first()[0]
    asked = written.select(name, F.lower(X.trim_all(F.col(name))).alias("_word")).where(F.length("_word") <= longest + 2).distinct()
    words = asked.select("_word").distinct()
    left = words.select("_word", F.explode(deletions(F.col("_word"), allowed_errors(F.length("_word") + 2))).alias("_left"))
    right = known.select("alias", "launch_id", F.explode(deletions(F.col("alias"), allowed_errors(F.length("alias")))).alias("_left"))
    pairs = skew_safe_join(left, right, ["_left"], "inner").select("_word", "alias", "launch_id").distinct()
    near = pairs.withColumn("errors", F.levenshtein("_word", "alias")).where(F.col("errors") <= allowed_errors(F.length("alias")))
    best = near.groupBy("_word").agg(F.min(F.struct("errors", "launch_id")).alias("best"))
    return skew_safe_join(asked, best, ["_word"], "inner").select(name, "best.launch_id", "best.errors")
