"""Set ids, set types and category configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import first_of, insert_missing, without_ids

#: Entries with one tag that are matched as one share; a tag of more entries is dealt into several.
SHARE = 100_000


def matching_types(entries: DataFrame, types: DataFrame, key: str = "uid") -> DataFrame:
    """Entries (a unique key, keys array) with each set type (type_id, tags array) all of whose tags are among the keys.

    An equi-join on single tags and a count, so neither table has to be small.
    Types without tags match every entry. Entries of a common tag are dealt into
    shares by their key, and the types that want it are copied to each share, so no
    task gets all entries of a tag; copies are fewer than matches by a factor of SHARE.
    """
    # a tag that every entry holds and only types without tags want
    none = F.array(F.struct(F.lit("").alias("tag"), F.lit(True).alias("every")))
    named = lambda tags: F.transform(F.array_distinct(tags), lambda t: F.struct(t.alias("tag"), F.lit(False).alias("every")))
    wanted = types.select("type_id", F.when(F.size("tags") > 0, named(F.col("tags"))).otherwise(none).alias("asked"))
    tagged = wanted.select("type_id", F.size("asked").alias("wanted"), F.explode("asked").alias("tag"))
    held = entries.select(key, F.explode(F.concat(named(F.coalesce("keys", F.array().cast("array<string>"))), none)).alias("tag"))
    # of n held tags, fewer than n / SHARE are common
    common = F.broadcast(held.groupBy("tag").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")).where("shares > 1"))
    n = F.coalesce("shares", F.lit(1))
    dealt = held.join(common, "tag", "left").select(key, "tag", F.pmod(F.xxhash64(key), n).cast("int").alias("share"))
    copied = tagged.join(common, "tag", "left").select("type_id", "wanted", "tag", F.explode(F.sequence(F.lit(0), n - 1)).alias("share"))
    met = dealt.join(copied, ["tag", "share"]).groupBy(key, "type_id", "wanted").agg(F.count("*").alias("met")).where("met = wanted").select(key, "type_id")
    return entries.join(met, key)


def resolve_categories(own: DataFrame, inherited: DataFrame, links: DataFrame) -> DataFrame:
    """set_id, name, source: a set's own categories, and those of its type (links: set_id, type_id) that it does not name itself."""
    theirs = inherited.join(links, "type_id").select("set_id", "name").join(own, ["set_id", "name"], "left_anti")
    return own.select("set_id", "name", F.lit("own").alias("source")).unionByName(theirs.withColumn("source", F.lit("inherited")))


def effective_categories(configured: DataFrame, defaults: list[str], disabled: DataFrame, sets: DataFrame) -> DataFrame:
    """Configured categories, and defaults (a list of names) that are not disabled for the set; disabling does not touch configured ones."""
    names = F.array(*[F.lit(n) for n in defaults]) if defaults else F.array().cast("array<string>")
    every = sets.select("set_id", F.explode(names).alias("name"))
    kept = every.join(disabled, ["set_id", "name"], "left_anti").join(configured, ["set_id", "name"], "left_anti")
    return configured.select("set_id", "name").unionByName(kept)


def sets_of_category(inherited: DataFrame, own: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Sets that get a category from their type and do not override it."""
    given = inherited.where(F.col("name") == name).join(links, "type_id").select("set_id")
    return given.join(own.where(F.col("name") == name), "set_id", "left_anti").distinct()


def set_config(configs: DataFrame, new: DataFrame) -> DataFrame:
    """configs(set_id, ...) with the new rows in place of those of their sets; of several new rows of a set the one of the least hash."""
    given = first_of(new.select(*configs.columns), ["set_id"], [F.xxhash64(*configs.columns)])
    return configs.join(given.select("set_id"), "set_id", "left_anti").select(*configs.columns).unionByName(given)


def register_type(links: DataFrame, new: DataFrame) -> DataFrame:
    """links(set_id, type_id) with new ones; a set that has a type keeps it."""
    return insert_missing(links, new, ["set_id"])


def disable(disabled: DataFrame, new: DataFrame) -> DataFrame:
    """disabled(set_id, name) with new rows, each once."""
    return insert_missing(disabled, new, ["set_id", "name"])


def with_tags(categories: DataFrame, tags: DataFrame) -> DataFrame:
    """categories(id, ...) with the sorted (name, description) of their tags(id, category_id, name, description)."""
    lists = tags.groupBy(F.col("category_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("name", "description"))).alias("tags"))
    return categories.join(lists, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast(lists.schema["tags"].dataType)))


def cloned(categories: DataFrame, tags: DataFrame, pairs: DataFrame, name: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(categories, tags) with deep copies: pairs(id, new_id, set_id) say what to copy, under which id, into which set. Copied tags get an id from the new category's and the tag's own."""
    kept = [c for c in categories.columns if c not in ("id", "set_id")]
    copies = categories.drop("set_id").join(pairs, "id").select(F.col("new_id").alias("id"), "set_id", *kept)
    copies = copies if name is None else copies.withColumn("name", name)
    others = [c for c in tags.columns if c not in ("id", "category_id")]
    moved = tags.join(pairs.select(F.col("id").alias("category_id"), "new_id"), "category_id")
    tag_copies = moved.select(F.concat_ws("/", "new_id", "id").alias("id"), F.col("new_id").alias("category_id"), *others)
    return categories.unionByName(copies.select(*categories.columns)), tags.unionByName(tag_copies.select(*tags.columns))


def delete_category(categories: DataFrame, tags: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(categories, tags) without the given categories (first column) and their tags."""
    return without_ids(categories, ids, "id"), without_ids(tags, ids, "category_id")


def add_types(types: DataFrame, new: DataFrame) -> DataFrame:
    """types(type_id, org_id, tags) with new ones; a type of the same organisation and tags, in any order, is got and not made."""
    marked = lambda df: df.withColumn("__tags", F.array_join(F.array_sort("tags"), "\u0001"))
    fresh = marked(new).join(marked(types).select("org_id", "__tags"), ["org_id", "__tags"], "left_anti")
    return types.unionByName(fresh.select(*types.columns))


def all_sets(matched: DataFrame, entries: DataFrame, defaults: list[Column], key: str = "uid") -> DataFrame:
    """key, set_id: the matched sets (key, set_id) and the default ones of each entry, once each; defaults that are null are left out."""
    given = entries.select(key, F.explode(F.filter(F.array(*defaults), lambda x: x.isNotNull())).alias("set_id"))
    return matched.select(key, "set_id").unionByName(given).distinct()


def common_sets(parts: list[DataFrame]) -> DataFrame:
    """Sets (set_id) that all the parts of an AND name."""
    found = parts[0].select("set_id").distinct()
    for part in parts[1:]:
        found = found.join(part.select("set_id").distinct(), "set_id", "left_semi")
    return found
