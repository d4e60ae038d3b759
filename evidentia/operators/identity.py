"""Who a mention may be: exact mail addresses, ranked names, and the directory policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.plans.lineage import cut


def persons(df: DataFrame) -> DataFrame:
    """Rows of named entities; where the frame tells their `kind`, of persons only: nothing else is ever who a mention is."""
    rows = df.where("trim(entity_id) <> ''")
    return rows.where("kind = 'person'").drop("kind") if "kind" in df.columns else rows


def email_matches(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """mention_id, n_owners and the entity if exactly one owns the (normalised) address.

    mentions: (mention_id, email); aliases: (entity_id, email) and, if known, kind.
    """
    owners = persons(aliases).where("email <> ''").groupBy("email").agg(F.count_distinct("entity_id").alias("n_owners"), F.min("entity_id").alias("entity_id"))
    hit = mentions.where("email <> ''").join(owners, "email")
    return hit.select("mention_id", "n_owners", F.when(F.col("n_owners") == 1, F.col("entity_id")).alias("entity_id"))


def name_confidence(mention_tokens: Column, tokens: Column) -> Column:
    """Share of the mention's tokens, repeats counted, that the name has, over the longer of the two."""
    shared = F.size(F.filter(mention_tokens, lambda t: F.array_contains(tokens, t)))
    return shared / F.greatest(F.size(mention_tokens), F.size(tokens))


def _clean(rows: DataFrame) -> DataFrame:
    return rows.where("name <> '' AND NOT contains(name, '@')")


def _name_scores(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """(name, known, confidence): distinct names of mentions with those of entities that share a word with them."""
    spoken = _clean(mentions).select("name").distinct().withColumn("m", F.split("name", " "))
    known = _clean(persons(names)).select(F.col("name").alias("known")).distinct().withColumn("k", F.split("known", " "))
    left = spoken.select("name", "m", F.explode(F.array_distinct("m")).alias("token"))
    right = known.select("known", "k", F.explode(F.array_distinct("k")).alias("token"))
    # a word's place: rare ones first; a pair is made under the first word that both have
    often = left.select("token").unionByName(right.select("token")).groupBy("token").agg(F.count("*").alias("often"))

    def placed(rows, own, words):
        at = rows.join(often, "token").groupBy(own, words).agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("order"))
        return at.select(own, words, F.transform("order", lambda x: x["token"]).alias("order"))

    spoken, known = placed(left, "name", "m"), placed(right, "known", "k")
    left = spoken.select("name", "m", F.col("order").alias("m_order"), F.explode("order").alias("token"))
    right = known.select("known", "k", F.explode("order").alias("token"))
    shared = F.get(F.filter("m_order", lambda t: F.array_contains(F.col("k"), t)), F.lit(0))
    pairs = left.join(right, "token").where(shared == F.col("token"))
    return pairs.select("name", "known", F.when(F.col("name") == F.col("known"), 1.0).otherwise(name_confidence(F.col("m"), F.col("k"))).alias("confidence"))


def rank_names(mentions: DataFrame, names: DataFrame, top: int | None = None, ids: int = 50_000, rows: int = 500_000) -> DataFrame:
    """All entities that share a word with a mention, by confidence, then id: (mention_id, rank, entity_id, confidence, via).

    mentions: (mention_id, name), names: (entity_id, name, is_alias) and, if known, kind, all normalised; names with @
    take no part, and of kinds only persons. An alias counts only where it is strictly better than the display name. top: how many to give of each
    mention (a report); by default all.

    Equal names are compared once: distinct mention names meet distinct names of entities under the words that
    they share. A pair meets under the rarest of these only, so of two words the common one makes no pairs that
    another makes too; a name whose only shared word is common is met through it, as each such pair is a result.

    Entities of the same names are judged once. A rank is the number of entities before a range of ids (of about `ids`
    entities) at a confidence, and the place in it, so no task holds a name's entities; a task has about `rows` rows.
    """
    own = F.array_sort(F.collect_set(F.struct(F.col("name").alias("known"), "is_alias"))).alias("own")
    held = _clean(persons(names)).groupBy("entity_id").agg(own).withColumn("alike", F.unhex(F.sha2(F.to_json("own"), 256)))
    held = cut(held)
    alike = held.select("alike", "own").distinct().select("alike", F.inline("own"))
    shown = F.max(F.when(~F.col("is_alias"), F.col("confidence")))
    best = alike.join(_name_scores(mentions, names), "known").groupBy("name", "alike").agg(F.max("confidence").alias("confidence"), shown.alias("shown"))
    # a confidence as a whole number: a double as key is shuffled once more, as it is normalised
    level = (F.col("confidence") * 1e15).cast("long").alias("level")
    best = best.select("name", "alike", "confidence", level, F.coalesce(F.col("shown") == F.col("confidence"), F.lit(False)).alias("display"))
    # entities by ranges of their ids; a range has its part of each name's ranks
    parts = -(-held.count() // ids)
    held = held.select("entity_id", "alike")
    held = cut(held.repartitionByRange(parts, "entity_id").withColumn("part", F.spark_partition_id())) if parts > 1 else held.withColumn("part", F.lit(0))
    here = cut(held.groupBy("part", "alike").agg(F.count("*").alias("n")).join(best, "alike"))
    tasks = -(-(here.agg(F.sum("n")).first()[0] or 1) // rows)
    group = ["part", "name", "level"]
    before = F.sum("n").over(Window.partitionBy("name").orderBy(F.col("level").desc(), "part").rowsBetween(Window.unboundedPreceding, -1))
    before = here.groupBy(*group).agg(F.sum("n").alias("n"), F.max("confidence").alias("confidence")).select(*group, "confidence", F.coalesce(before, F.lit(0)).alias("before"))
    told = _clean(mentions).select("mention_id", "name").join(before, "name")
    met = held.repartition(tasks, "part", "alike").join(here.drop("n", "confidence").repartition(tasks, "part", "alike"), ["part", "alike"]).drop("alike")
    met = met.repartition(tasks, *group).withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("entity_id")))
    met = met if top is None else met.where(F.col("place") <= top)
    out = met.join(told.repartition(tasks, *group), group).withColumn("rank", (F.col("before") + F.col("place")).cast("int"))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select("mention_id", "rank", "entity_id", "confidence", F.when(F.col("display"), "display").otherwise("alias").alias("via"))


def resolve(mentions: DataFrame, names: DataFrame, emails: DataFrame) -> DataFrame:
    """Each mention's one outcome: `automatic` with the entity that alone owns its address, else `ranked` candidates or `none`.

    mentions: (mention_id, name, email), names: (entity_id, name, is_alias), emails: (entity_id, email), all
    normalised, both with `kind` if it is known: only persons count. (mention_id, outcome, entity_id, rank, confidence, reason): one row if automatic or none, else one
    row for each candidate. An address owned by several entities makes each of them no match.
    """
    exact = email_matches(mentions.select("mention_id", "email"), emails).where("entity_id is not null").select("mention_id", "entity_id")
    one = exact.select("mention_id", F.lit("automatic").alias("outcome"), "entity_id", F.lit(1).alias("rank"), F.lit(1.0).alias("confidence"), F.lit("exact-email").alias("reason"))
    rest = mentions.join(exact.select("mention_id"), "mention_id", "left_anti")
    ranked = rank_names(rest.select("mention_id", "name"), names)
    many = ranked.select("mention_id", F.lit("ranked").alias("outcome"), "entity_id", "rank", "confidence", F.concat(F.lit("name-"), "via").alias("reason"))
    met = _clean(rest).join(_name_scores(rest, names).select("name").distinct(), "name", "left_semi")
    none = rest.select("mention_id").join(met.select("mention_id"), "mention_id", "left_anti")
    null = lambda kind: F.lit(None).cast(kind)
    none = none.select("mention_id", F.lit("none").alias("outcome"), null("string").alias("entity_id"), null("int").alias("rank"), null("double").alias("confidence"), null("string").alias("reason"))
    return one.unionByName(many).unionByName(none)


def directory_verdict(lookups: DataFrame, profiles: DataFrame, owners: DataFrame, links: DataFrame, domains: list[str]) -> DataFrame:
    """What a directory lookup by address decides: no_match, ambiguous, review, matched with an entity, or matched new.

    lookups: (lookup_id, email, automatic), profiles: (email, subject_id), owners and links: (email|subject_id,
    entity_id). A lookup whose domain is not approved is not asked.
    """
    domain = F.substring_index("email", "@", -1)
    n = profiles.groupBy("email").agg(F.count_distinct("subject_id").alias("n_profiles"), F.min("subject_id").alias("subject_id"))
    own = owners.groupBy("email").agg(F.count_distinct("entity_id").alias("n_owners"), F.min("entity_id").alias("owner"))
    linked = links.groupBy("subject_id").agg(F.count_distinct("entity_id").alias("n_links"), F.min("entity_id").alias("link"))
    rows = lookups.join(n, "email", "left").join(own, "email", "left").join(linked, "subject_id", "left")
    many, one = F.coalesce("n_links", F.lit(0)), F.coalesce("n_owners", F.lit(0))
    verdict = (
        F.when(~domain.isin(*domains), "not-asked").when(F.coalesce("n_profiles", F.lit(0)) == 0, "no_match").when(F.col("n_profiles") > 1, "ambiguous")
        .when(~F.col("automatic"), "review").when((one > 1) | (many > 1) | ((many == 1) & (one == 1) & (F.col("link") != F.col("owner"))), "review")
        .when((many == 1) & (one == 0), "review").when(one == 1, "matched").otherwise("matched-new")
    )
    return rows.select("lookup_id", verdict.alias("verdict"), F.when(verdict == "matched", F.col("owner")).alias("entity_id"))


def lookup_work(mentions: DataFrame, decided: DataFrame, attempts: DataFrame, now: Column, fresh: str) -> DataFrame:
    """Undecided mentions with flags: a conclusive attempt fresher than `fresh` can be reused, a retry still waits."""
    of = attempts.groupBy("mention_id").agg(
        F.max(F.when(F.col("conclusive"), F.col("attempted_at"))).alias("last"), F.max(F.coalesce(F.col("retry_after") > now, F.lit(False))).alias("blocked")
    )
    rows = mentions.join(decided.select("mention_id").distinct(), "mention_id", "left_anti").join(of, "mention_id", "left")
    reuse = F.coalesce(F.col("last") + F.expr(f"INTERVAL {fresh}") > now, F.lit(False))
    return rows.select("mention_id", reuse.alias("reusable"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
